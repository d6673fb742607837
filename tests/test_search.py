"""The language, its compilation and the planner on small tables."""

import random
import struct
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import queries, storage
from quarry.functions import derive, literals
from quarry.operators import catalog, cdc, content
from quarry.operators.paths import folder_paths, with_paths
from quarry.plans import compile as compiler
from quarry.plans import query as language
from quarry.plans import search
from quarry.plans.query import QueryError, SearchOptions
from quarry.sinks import export
from quarry.sources import ntfs, snapshot
from quarry.streaming import journal

SMALL = "/root/testdata/sf0.001"

DAY = 86_400_000
NOON = 1718452800000  # 2024-06-15T12:00Z


def row(path, is_dir=False, size=None, modified=None, attributes=0):
    name = path.rpartition("\\")[2]
    return {"name": name, "name_lower": name.lower(), "path": path, "path_lower": path.lower(), "is_dir": is_dir, "size": size, "modified_ms": modified, "created_ms": modified, "accessed_ms": None, "attributes": attributes}


ROWS = [
    row("C:\\Users\\Downloads\\report.pdf", size=2 << 20, modified=NOON), row("C:\\Users\\Downloads\\sub\\deep.txt", size=1024), row("C:\\Users\\Documents\\Report-2023-final.txt", size=0, modified=NOON - 400 * DAY, attributes=0x22),
    row("C:\\Old Tools (v2)", True, attributes=0x10), row("D:\\ledger-2024.txt", size=5 << 20, attributes=0x6), row("D:\\.gitignore"), row("D:\\x.CAFÉ", size=10), row("D:\\!Locales", True), row("D:\\archive.dll.bak", size=1536),
    row("D:\\a.b report draft.", size=3), row("D:\\foo_bar foo-bar.c++", size=12), row("D:\\100%_sure.md"), row("D:\\x|y\nz.txt", size=1),
]
QUERIES = [
    "", "report", "foo bar", "report | ledger", "report !draft", '"Tools (v2)"', "(report | ledger) !2023", "!!report", "!(report | ledger)", "*.txt", "ledger-????.*", "*.pdf | *.dll", "ext:txt;.pdf", "ext:.", "ext:;", "ext:gitignore",
    "size:>1mb", "size:>=1kb size:<2mb", "size:1.5kb", "size:5mb..1k", "size:<0", "!size:>1mb", "size:gb", "!size:gb", "size:", "size:>1mb..5mb", "size:..", "dm:2024", "dm:2024-06-15", "!dm:2024", "dm:>2023", "dm:<=2023", "dm:2024-02-30",
    "dm:..2023", "dc:2024/06..", "attrib:h", "attrib:hs", "attrib:zzz", "!attrib:a", "file:", "folder: !v2", "dir:", "file:foo", "path:downloads", "c:\\users\\down", "d: txt", "downloads\\*.pdf", "*:\\x*", "!", "( ( report", ") report", "a!b", "! report",
    '"!locales"', "!Locales", "100%_", "((((((report))))))", "x.café", "|", "| report |", "()", "report ()",
]


@pytest.fixture(scope="module")
def table(spark):
    kinds = "name string, name_lower string, path string, path_lower string, is_dir boolean, size long, modified_ms long, created_ms long, accessed_ms long, attributes long"
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], kinds).cache()


def agree(table, options):
    tree = language.parse(options)
    got = {r.path for r in table.where(compiler.column(tree)).select("path").collect()}
    want = {r["path"] for r in ROWS if compiler.evaluate(tree, r)}
    assert got == want, options
    return got


def test_compiled_queries_equal_evaluation(table):
    for q in QUERIES:
        agree(table, SearchOptions(query=q))
    for q in ("report", "foo", "bar", ".txt", "(v2)", "2023"):
        agree(table, SearchOptions(query=q, whole_word=True))
        agree(table, SearchOptions(query=q, match_path=True))
        agree(table, SearchOptions(query=q.title(), match_case=True))
    for q in ("^report", "REPORT.*pdf$", "\\bfoo\\b", "[0-9]{4}"):
        agree(table, SearchOptions(query=q, regex=True))


def test_random_queries(table):
    rng = random.Random(4)
    parts = ["report", "txt", "(", ")", "|", "!", '"', " ", " ", "size:>1k", "dm:2024", "ext:txt", "*", "?", "d:", "\\", "attrib:h", "file:"]
    for _ in range(30):
        agree(table, SearchOptions(query="".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9)))))


def test_meaning_of_some_queries(table):
    names = lambda q, **o: sorted(p.rpartition("\\")[2] for p in agree(table, SearchOptions(query=q, **o)))
    assert len(names("!size:gb")) == len(ROWS) and names("size:gb report") == []
    assert len(names("size:")) == len(ROWS) and names("size:<0") == []
    assert names("ext:gitignore") == [".gitignore"] and names("ext:.") == ["a.b report draft."]
    assert names('"(v2)"') == ["Old Tools (v2)"] and names("*.dll", match_path=True) == ["archive.dll.bak"]
    assert names("dm:2024-06-15") == ["report.pdf"] and names("bar", whole_word=True) == ["foo_bar foo-bar.c++"]


def test_deep_and_long_queries():
    assert language.parse(SearchOptions(query="(" * 500 + "a" + ")" * 500)) is not None
    assert language.parse(SearchOptions(query="!" * 10_001 + "a")).op == "not"


def test_literals():
    assert literals.size_bytes("1.5kb") == 1536 and literals.size_bytes("1_0") is None and literals.size_bytes("٣") is None
    assert literals.days_from_civil(1970, 1, 1) == 0 and literals.civil(2023, 2, 29) is None and literals.civil(0, 1, 1) is not None and literals.civil(300_000, 1, 1) is None
    now = datetime(2024, 6, 15, 13)
    assert literals.date_filter("thisweek", now, "UTC") == literals.Bounds(literals.days_from_civil(2024, 6, 10) * DAY, literals.days_from_civil(2024, 6, 17) * DAY - 1)
    assert literals.date_filter("2024-06-15", now, "Europe/Berlin").low == literals.days_from_civil(2024, 6, 15) * DAY - 2 * 3_600_000
    assert literals.date_filter("2018-11-04", now, "America/Sao_Paulo").low % DAY == 3 * 3_600_000  # no midnight there that day
    assert literals.attribute_mask("rh!") == 3 and literals.attribute_mask("zz") is None


def test_content_terms():
    assert language.extract_content('inv* content:"late fee" 2021 content:overdue') == ("inv* 2021", ["late fee", "overdue"])
    assert language.extract_content("content: mycontent:x report") == ("mycontent:x report", [])
    assert language.extract_content('"a content:b" (content:x)') == ('"a content:b" (content:x)', [])
    with pytest.raises(QueryError):
        language.check_content_scope("a | b content:x", ["x"])
    language.check_content_scope("(a | b) content:x", ["x"])


def test_builder_and_highlight():
    assert language.build_query(name="a (b) | ext:c", extensions="*.TXT, tar.gz txt", size="size:>1mb", date="today", content="two words") == '(a "(b)" | "ext:c") ext:txt;gz size:>1mb dm:today content:"two words"'
    assert language.apply_size_preset("a size:>1 b", "tiny") == "a b size:<=10kb"
    assert language.highlight_terms(SearchOptions(query='a !b (c | !"d") path:e ext:f *.g !(h !i)')) == ["a", "c", "e", "i"]
    assert derive.marked("a<b foo Foo", ["foo", "oo"]) == "a&lt;b <mark>foo</mark> <mark>Foo</mark>"
    assert language.remember(["a", "b"], " b ") == ["b", "a"]


def test_bad_regex_is_an_error_text(spark):
    for q in ("(", "(?=x)", r"(a)\1", "a(?#c)", "[[:nope:]]", "*a", "a{,3}", r"\q", r"\p{NoSuchScript}", "(?z)a", "[b-a]", "(?P<n>a)(?P<n>b)", "a)", r"\d{9999}{9999}", "(" * 300 + ")" * 300):
        assert search.search(search.Catalog(spark.range(1)), SearchOptions(query=q, regex=True)).error, q


REGEXES = [
    # pattern, names that match, names that don't
    (r"(?P<year>\d{4})-(?<m>\d\d)", ["a2024-06"], ["2024"]), ("[[:alpha:]]+[[:digit:]]", ["ab1"], [":1", "é1"]), ("^[^[:space:]]+$", ["ab"], ["a b"]), (r"\x{41}\u{42}", ["abc"], ["a"]),
    (r"^\pL\p{Nd}$", ["é5"], ["55"]), ("(?U)^a+$", ["aaa"], ["ab"]), ("^a{1,2}{3}$", ["aaa", "aaaaaa"], ["aa", "aaaaaaa"]), ("^a**b$", ["b", "aab"], ["ac"]), ("^a*+a$", ["aa"], ["b"]),
    (r"^[\w--\d]+$", ["ab"], ["a1"]), ("^[a-z&&[^aeiou]]+$", ["xyz"], ["xay"]), ("^[a-d~~c-f]+$", ["abef"], ["c"]), ("^[]a]+$", ["]a"], ["b"]), ("^[a-]+$", ["a-"], ["b"]), (r"^a.c$", ["abc"], ["a\nc"]),
    ("(?s)^a.c$", ["a\nc"], ["ac"]), ("(?m)^b$", ["a\nb\nc"], ["ab"]), ("(?x) ^ a b # c", ["ab"], ["a b"]), ("a$", ["ba"], ["a\n"]), (r"\b{start}b", ["a b"], ["ab"]), (r"\p{Greek}", ["σ"], ["s"]),
    (r"\p{^Lu}|\P{L}", ["1"], ["ß"]), ("é", ["É"], ["e"]), ("x|", ["anything"], []), (r"^[\]\-\\]+$", ["]-\\"], ["a"]), (r"#&~", ["a#&~"], ["a"]),
]


def test_regex_dialect(spark):
    """What the language means by a pattern, whatever Java's engine would make of it."""
    names = sorted({n for _, yes, no in REGEXES for n in (*yes, *no)})
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for pattern, yes, no in REGEXES:
        got = {r.name for r in table.where(compiler.column(language.parse(SearchOptions(query=pattern, regex=True)))).collect()}
        assert set(yes) <= got and not set(no) & got, (pattern, got)


def test_body_decoding():
    most = 1 << 20
    assert derive.decode_body(b"\xff\xfe" + "timeout".encode("utf-16-le"), most) == "timeout" and derive.decode_body("plain text".encode("utf-16-be"), most) == "plain text"
    assert derive.decode_body("plain text".encode("utf-16-le"), most) == "plain text" and derive.decode_body(b"\0\0timeout\0", most) is None and derive.decode_body(b"a\xffb", most) == "a\ufffdb"


def entry(record, parent, name, is_dir=False, drive="C"):
    return (drive, record, parent, name, name.lower(), is_dir, 1, None, None, None, 0)


OPS = "drive string, usn long, record long, parent long, name string, is_dir boolean, size long, modified_ms long, created_ms long, accessed_ms long, attributes long, op string"
ENTRY = "drive string, record long, parent long, name string, name_lower string, is_dir boolean, size long, modified_ms long, created_ms long, accessed_ms long, attributes long"


def test_paths_deep_orphan_and_cycle(spark):
    rows = [entry(100 + i, 99 + i if i else 5, f"d{i}", True) for i in range(20)] + [entry(500, 119, "leaf"), entry(600, 999, "lost", True), entry(601, 600, "f"), entry(700, 701, "x", True), entry(701, 700, "y", True), entry(5, 5, "root", True)]
    df = spark.createDataFrame(rows, ENTRY)
    paths = {r.record: r.path for r in with_paths(df, folder_paths(df)).collect()}
    assert paths[500] == "C:\\" + "\\".join(f"d{i}" for i in range(20)) + "\\leaf" and paths[601] == "C:\\lost\\f" and paths[700] == "C:\\y\\x"


def test_paths_are_joined_only_when_needed(spark):
    df = spark.createDataFrame([entry(1, 5, "a")], ENTRY)
    plan = lambda q: search.matching(search.Catalog(df), SearchOptions(query=q))._jdf.queryExecution().toString()
    assert "Join" not in plan("a ext:txt") and "Join" in plan("path:a")


def test_fold_equals_replay(spark):
    rng = random.Random(2)
    start = [entry(r, p, f"n{r}") for r in range(10, 30) for p in range(rng.choice([1, 1, 2, 3]))]
    ops = [("C", u, rng.randrange(8, 32), rng.randrange(4), rng.choice(["n10", "n11", f"n{u % 30}", ""]), False, u, None, None, None, 0, rng.choice(["upsert"] * 6 + ["delete"])) for u in range(400)]
    kinds = "drive string, usn long, record long, parent long, name string, is_dir boolean, size long, modified_ms long, created_ms long, accessed_ms long, attributes long, op string"
    got = sorted((r.record, r.parent, r.name, r.size) for r in cdc.fold(spark.createDataFrame(start, ENTRY), spark.createDataFrame(ops, kinds)).collect())
    names = [k.split()[0] for k in kinds.split(", ")]
    want = []
    for record in range(8, 32):
        links = sorted(({f: dict(zip([c.split()[0] for c in ENTRY.split(", ")], e))[f] for f in cdc.LINK} for e in start if e[1] == record), key=lambda x: x["parent"])
        want += [(record, x["parent"], x["name"], x["size"]) for x in cdc.replay(links, [dict(zip(names, o)) for o in ops if o[2] == record])]
    assert got == sorted(want)


def test_export_lines(spark):
    kinds = "name string, path string, size long, modified long, created long, accessed long, attributes long"
    hits = spark.createDataFrame([("a,b.txt", "C:\\x\\a,b.txt", 42, 0, 0, 0, 0x22), ("=SUM(A1:A9)", "C:\\k.bin", 1000, 1718452800000, 0, 0, 32), ("dir", "C:\\dir", -1, 0, 0, 0, 16)], kinds)
    csv, efu, txt = ([r.line for r in export.lines(hits, k).collect()] for k in ("csv", "efu", "txt"))
    assert csv[0] == '"a,b.txt","C:\\x\\a,b.txt",42,,,,HA' and csv[1] == '"\t=SUM(A1:A9)",C:\\k.bin,1000,2024-06-15 12:00:00,,,A' and csv[2] == "dir,C:\\dir,,,,,D"
    assert efu[1:] == ["C:\\k.bin,1000,133629264000000000,0,32", "C:\\dir,0,0,0,16"] and txt[2] == "C:\\dir"


def test_snapshot(spark, tmp_path):
    df, path = spark.createDataFrame([entry(1, 5, "B.txt"), entry(2, 5, "x", drive="D")], ENTRY), str(tmp_path)
    assert snapshot.load(spark, path, "C", 7) is None
    snapshot.save(df, path, "C", 7, 1, 100)
    rows, meta = snapshot.load(spark, path, "C", 7)
    assert [r.name_lower for r in rows.collect()] == ["b.txt"] and meta["next_usn"] == 100 and snapshot.load(spark, path, "C", 8) is None
    ops = spark.createDataFrame([("C", u, r, 5, n, False, 2, None, None, None, 0, op) for u, r, n, op in ((99, 1, "early", "upsert"), (100, 1, "new.txt", "upsert"), (101, 3, "c", "upsert"), (102, 4, "d", "upsert"), (103, 4, "", "delete"))] + [("D", 104, 9, 5, "other", False, 2, None, None, None, 0, "upsert")], OPS)
    online = lambda lowest: snapshot.bring_online(spark, path, "C", 7, {"journal_id": 1, "lowest_valid_usn": lowest}, ops, lambda: df)
    assert online(200)[1] == "stale" and online(200)[0] is df
    rows, how = online(100)
    assert how == "caught" and sorted((r.drive, r.record, r.name, r.name_lower) for r in rows.collect()) == [("C", 1, "new.txt", "new.txt"), ("C", 3, "c", "c")]
    assert rows.columns == df.columns or set(rows.columns) == set(df.columns)


def file_record(name, parent, flags=1, size=10):
    value = struct.pack("<QQQQQQQIIBB", parent | 1 << 48, 0, 0, 0, 0, 0, size, 0, 0, len(name), 1) + name.encode("utf-16-le")
    pad = -len(value) % 8
    attribute = struct.pack("<IIBBHHHIHH", 0x30, 24 + len(value) + pad, 0, 0, 0, 0, 0, len(value), 24, 0) + value + b"\0" * pad
    record = bytearray(b"FILE" + struct.pack("<HHQHHHHII", 48, 3, 0, 1, 1, 56, flags, 0, 1024) + b"\0" * 24)[:56] + attribute + b"\xff\xff\xff\xff"
    record += b"\0" * (1024 - len(record))
    record[48:54] = b"\x01\x00" + bytes(record[510:512]) + bytes(record[1022:1024])
    record[510:512] = record[1022:1024] = b"\x01\x00"
    return bytes(record)


def test_records_and_runs():
    assert ntfs.data_runs(bytes([0x11, 5, 10, 0x11, 3, 0xFE, 0x01, 4, 0])) == [(10, 5), (8, 3), (None, 4)]
    fixed = ntfs.repaired(file_record("Ä.txt", 77), 512)
    assert [r[:6] for r in ntfs.file_record(fixed, 9, "C")] == [("C", 9, 77, "Ä.txt", False, 10)]
    assert list(ntfs.file_record(ntfs.repaired(file_record("gone", 5, flags=0), 512), 9, "C")) == [] and ntfs.repaired(b"FILE" + b"\0" * 1020, 512) == b"FILE" + b"\0" * 1020
    boot = bytearray(512)
    boot[3:11], boot[11:14], boot[0x30:0x38], boot[0x40] = b"NTFS    ", struct.pack("<HB", 512, 8), struct.pack("<Q", 4), 0xF6
    assert ntfs.geometry(bytes(boot)) == ntfs.Geometry(512, 4096, 1024, 4)
    with pytest.raises(ntfs.NotNtfs):
        ntfs.geometry(b"\0" * 512)


def volume_image(records, runs, kept=None):
    """A volume of 4096-byte clusters: the boot sector, and file records of 1024 bytes in the clusters of the table's runs."""
    boot = bytearray(512)
    boot[3:11], boot[11:14], boot[0x30:0x38], boot[0x40] = b"NTFS    ", struct.pack("<HB", 512, 8), struct.pack("<Q", runs[0][0]), 0xF6
    raw, at = b"", 0
    for place, clusters in runs:
        raw += bytes([0x21, clusters]) + struct.pack("<h", place - at)
        at = place
    size = 1024 * (len(records) if kept is None else kept)
    body = struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 64 + len(raw) + -len(raw) % 8, 1, 0, 0, 0, 0, 0, 0, 64, 0, 0, size, size, size) + raw
    body += b"\0" * (struct.unpack_from("<I", body, 4)[0] - len(body))
    first = bytearray(b"FILE" + struct.pack("<HHQHHHHII", 48, 0, 0, 1, 1, 56, 1, 0, 1024) + b"\0" * 24)[:56] + body + b"\xff\xff\xff\xff"
    records = [bytes(first.ljust(1024, b"\0")), *records[1:]]
    image = bytearray(4096 * (max(p + c for p, c in runs) + 1))
    image[:512] = boot
    places = [4096 * p + 1024 * k for p, c in runs for k in range(4 * c)]
    for place, record in zip(places, records):
        image[place : place + 1024] = record
    return bytes(image)


def test_volume_image_through_spark(spark, tmp_path):
    """Two runs, damaged and unused records, and records beyond the table's size: what is whole is read, nothing fails."""
    rng = random.Random(8)
    records = [b""] + [file_record(f"f{i}", 5, size=i) for i in range(1, 14)]
    records[2] = b"BAAD" + records[2][4:]
    records[3] = file_record("gone", 5, flags=0)
    torn = bytearray(file_record("torn", 5))
    torn[1022:1024] = b"??"
    records[4] = bytes(torn)
    short = bytearray(file_record("cut", 5))
    struct.pack_into("<I", short, 60, 0xFFFF)
    records[5] = bytes(short)
    records[6] = b"FILE" + bytes(rng.randrange(256) for _ in range(1020))
    long_name = bytearray(file_record("name", 5))
    long_name[56 + 24 + 64] = 255
    records[7] = bytes(long_name)
    path = tmp_path / "image"
    path.write_bytes(volume_image(records, [(2, 2), (9, 2)], kept=12))
    spark.dataSource.register(ntfs.VolumeImage)
    rows = spark.read.format("volume-image").option("path", str(path)).option("drive", "X").load().collect()
    found = {r.record: (r.drive, r.parent, r.name, r.size) for r in rows}
    whole = {1, 4, 8, 9, 10, 11}
    assert whole <= set(found) <= whole | {6, 7} and found[11] == ("X", 5, "f11", 11) and found[4][2] == "torn"
    assert [r[3] for r in ntfs.lookup(str(path), 9, 1)] == ["f9"] and ntfs.lookup(str(path), 9, 2) == [] and ntfs.lookup(str(path), 12, 1) == [] and ntfs.lookup(str(path), 3, 1) == []
    entries = catalog.entries_of(spark.read.format("volume-image").option("path", str(path)).load())
    assert entries.where("name_lower = 'f8'").count() == 1
    with pytest.raises(Exception, match="NTFS"):
        (tmp_path / "no").write_bytes(b"\0" * 4096)
        spark.read.format("volume-image").option("path", str(tmp_path / "no")).load().collect()


def test_change_records_from_bytes():
    name = "ä.txt".encode("utf-16-le")
    one = struct.pack("<IHHQQQQIIIIHH", 60 + len(name) + 2, 2, 0, 7 | 3 << 48, 5, 100, 0, 0x80000200, 0, 0, 32, len(name), 60) + name + b"\0\0"
    other = struct.pack("<IHH", 60, 3, 0) + b"\0" * 52
    assert list(ntfs.change_records(one + other + one[:30], "C")) == [("C", 100, 7 | 3 << 48, 5, "ä.txt", 0x80000200, 32)]


def test_times_are_exact(spark):
    far = [133629264000000000 + 10_000 * k + r for k in range(0, 10**12, 7 * 10**9 + 1) for r in (0, 9_999)] + [-1, 1, 10_000, -10_001]
    got = [r.ms for r in spark.createDataFrame([(t,) for t in far], "t long").select(derive.filetime_to_ms(F.col("t")).alias("ms")).collect()]
    assert got == [t // 10_000 - 11_644_473_600_000 for t in far]


def test_stored_order_gives_the_first_screen(spark, tmp_path):
    rng = random.Random(3)
    rows = [entry(10 + i, 5, "".join(rng.choice("abC") for _ in range(3)), rng.random() < 0.2, rng.choice("CD")) for i in range(500)]
    df = spark.createDataFrame(rows, ENTRY)
    stored, slots = catalog.store(df, str(tmp_path / "stored"), 8)
    plain, fast = search.Catalog(df), search.Catalog(stored, None, slots)
    for o in ({}, {"descending": True}, {"limit": 1000}, {"folders_first": True}, {"sort": "size"}, {"query": "a"}):
        options = SearchOptions(**{"limit": 40, **o})
        assert [tuple(r) for r in search.page(plain, options).collect()] == [tuple(r) for r in search.page(fast, options).collect()], o
    assert len(catalog.slots_of_page(slots, 40, False)) < len(slots) and catalog.slots_of_page(slots, 10**6, True) == [s for s, _ in reversed(slots)]
    empty, none = catalog.store(df.limit(0), str(tmp_path / "empty"), 4)
    assert none == [] and search.page(search.Catalog(empty, None, none), SearchOptions()).collect() == []


def test_status_tells_of_reading_and_errors(spark):
    df = spark.createDataFrame([entry(1, 5, "a"), entry(2, 5, "b"), entry(3, 5, "c", drive="D")], ENTRY)
    runs = spark.createDataFrame([("D", 700, None), ("E", None, "access denied")], "drive string, read long, error string")
    assert sorted(map(tuple, catalog.status(df, runs).collect())) == [("C", "ready", 2, None), ("D", "indexing", 700, None), ("E", "error", 0, "access denied")]


def test_stream_keeps_entries_over_restarts(spark, tmp_path):
    """Batches through the stream equal one fold; a batch that comes again after a restart changes nothing."""
    rng = random.Random(7)
    start = spark.createDataFrame([entry(r, p, f"n{r}", drive=d) for d in "CD" for r in range(10, 20) for p in range(rng.choice([1, 2]))], ENTRY)
    batches = [[(rng.choice("CD"), 50 * b + u, rng.randrange(9, 22), rng.randrange(3), f"n{u % 9}", False, u, None, None, None, 0, rng.choice(["upsert"] * 5 + ["delete"])) for u in range(50)] for b in range(3)]
    frames = [spark.createDataFrame(b, OPS) for b in batches]
    place = f"file://{tmp_path}/kept"
    keeper = journal.Maintainer(spark, place, ENTRY)
    keeper.start(start)
    keeper.publish(frames[0], 0)
    keeper.publish(frames[1], 1)
    again = journal.Maintainer(spark, place, ENTRY)
    again.start(start)
    again.publish(frames[1], 1)
    again.publish(frames[2], 2)
    want = cdc.fold(start, spark.createDataFrame(sum(batches, []), OPS))
    key = lambda df: sorted((r.drive, r.record, r.parent, r.name, r.size) for r in df.collect())
    assert key(again.entries()) == key(want) and key(journal.Maintainer(spark, place, ENTRY).entries()) == key(want)


def test_stream_query_equals_batch_query(spark):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(queries.stream_fold_available_now(spark, SMALL)) == key(queries.cdc_batch_fold(spark, SMALL))


def test_multi_link_query_equals_replay(spark, monkeypatch):
    seen = {}
    fold = cdc.fold
    monkeypatch.setattr(cdc, "fold", lambda entries, ops: seen.update(entries=entries.collect(), ops=ops.collect()) or fold(entries, ops))
    got = sorted((r.record, r.parent, r.name) for r in queries.cdc_multi_link_fold(spark, SMALL).collect())
    want, by = [], {}
    for o in sorted(seen["ops"], key=lambda o: o.usn):
        by.setdefault(o.record, []).append(o.asDict())
    links = {}
    for e in seen["entries"]:
        links.setdefault(e.record, []).append({f: e[f] for f in cdc.LINK})
    for record in by.keys() | links.keys():
        want += [(record, x["parent"], x["name"]) for x in cdc.replay(links.get(record, []), by.get(record, []))]
    assert got == sorted(want)


def test_state_of_the_stateful_replay():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, event = State(), lambda u, p, n, op="upsert": ("C", u, 7, p, n, False, 1, None, None, None, 0, op)
    names = [c.split()[0] for c in OPS.split(", ")]
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=names)])
    first = next(journal.replay_with_state(("C", 7), frame(event(2, 5, "b"), event(1, 5, "a")), state))
    assert first.values.tolist() == [["C", 7, 5, "b"]]
    assert next(journal.replay_with_state(("C", 7), frame(event(3, 6, "c")), state)).values.tolist() == [["C", 7, 6, "c"]]
    assert next(journal.replay_with_state(("C", 7), frame(event(4, 6, "", "delete")), state)).empty


def test_highlight_of_one_term_needs_no_python(spark):
    texts = ["a<b Foo foofoo", "xfoo foo_ foo", 'f"o&o', "", "FOO\u0301", "C:\\foo"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for o in ({}, {"match_case": True}, {"whole_word": True}):
        column = derive.highlight(F.col("t"), ["foo"], **o)
        assert [r[0] for r in df.select(column).collect()] == [derive.marked(t, ["foo"], **o) for t in texts], o
        assert "Python" not in df.select(column)._jdf.queryExecution().toString()
    assert [r[0] for r in df.select(derive.highlight(F.col("t"), ["f\"o&", "o&o"])).collect()][2] == "<mark>f&quot;o&amp;o</mark>"


def test_export_files(spark, tmp_path):
    hits = spark.createDataFrame([(f"n{i}", f'C:\\n"{i}', i, 0, 0, 0, 0) for i in range(5)], "name string, path string, size long, modified long, created long, accessed long, attributes long").orderBy("size")
    told = export.write(hits, str(tmp_path / "out"), "csv", most=3)
    files = sorted(p for p in (tmp_path / "out").iterdir() if not p.name.startswith(("_", ".")))
    assert told == {"written": 3, "total": 5, "capped": True}
    assert "".join(p.read_text() for p in files).split("\n") == [export.HEADERS["csv"], 'n0,"C:\\n""0",0,,,,', 'n1,"C:\\n""1",1,,,,', 'n2,"C:\\n""2",2,,,,', ""]
    with pytest.raises(ValueError):
        export.write(hits, str(tmp_path / "no"), "xls")


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)


def test_raw_to_entries_and_times(spark):
    raw = spark.createDataFrame([("C", 1, 5, "A", False, 3, 133629264000000000, 0, 1, 32), ("C", 5, 5, "root", True, None, 0, 0, 0, 16), ("C", 2, 5, "", False, 1, 0, 0, 0, 0)], "drive string, record long, parent long, name string, is_dir boolean, size long, modified_ft long, created_ft long, accessed_ft long, attributes long")
    rows = catalog.entries_of(raw).collect()
    assert [(r.name_lower, r.modified_ms, r.created_ms, r.accessed_ms) for r in rows] == [("a", 1718452800000, None, -11644473600000)]


def test_content_skips_folders_and_links(spark):
    files = spark.createDataFrame([entry(1, 5, "a"), entry(2, 5, "b", True), (*entry(3, 5, "c")[:10], 0x400), entry(4, 5, "d")], ENTRY)
    bodies = spark.createDataFrame([("C", i, "Hello TIMEOUT world") for i in (1, 2, 3)] + [("C", 4, None)], "drive string, record long, text string")
    assert [r.record for r in content.containing(files, bodies, ["timeout", "hello"]).collect()] == [1]
    assert content.containing(files, bodies, ["timeout"], match_case=True).count() == 0


def test_content_reads_all_candidates(spark):
    """Of 50,100 candidates the last in order match too; the desktop program's limit only holds where it is asked for."""
    n = 50_100
    rows = spark.range(n).select(
        F.lit("C").alias("drive"), (F.col("id") + 10).alias("record"), F.lit(5).cast("long").alias("parent"), F.format_string("f%06d.txt", "id").alias("name"), F.format_string("f%06d.txt", "id").alias("name_lower"),
        F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("size"), *(F.lit(None).cast("long").alias(f"{t}_ms") for t in ("modified", "created", "accessed")), F.lit(0).alias("attributes"),
    )
    bodies = spark.createDataFrame([("C", i + 10, "a needle") for i in (1, 40_000, n - 1)], "drive string, record long, text string")
    found = lambda **o: sorted(r.record - 10 for r in search.content_matches(search.Catalog(rows), bodies, SearchOptions(query="f content:needle", **o)).collect())
    assert found() == [1, 40_000, n - 1]
    assert found(content_candidates=50_000) == [1, 40_000]
    assert found(content_candidates=2, descending=True) == [n - 1]
