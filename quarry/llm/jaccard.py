"""N-gram Jaccard self-join by grouped prefixes, and the groups of documents that its links form.

Sets of word shingles are compared as 64-bit hashes.  Documents with equal sets are one class.  In one global
order of shingles (those that many classes hold last, then by hash) two sets can only link if their prefixes
share a shingle.  Classes with equal size and prefix form a group; groups that share a prefix shingle and
have sizes that allow a link are paired; pairs are expanded to members, sifted by parity bitmaps (a provable
bound on what two sets don't share) and verified exactly.

A shingle that thousands of near copies share would pair all of them.  So there are two rounds: the first
compares each member of such a bucket only with its most central one, and contracts what links; the second
pairs only what is still in different components, the small ones of a bucket with all of it; large buckets are
cut into blocks, and of their pairs only those that bitmaps let through leave a task.  A pair that is never
compared is already joined, so the components are exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, let_go, small_batches, stage_table, text_slices
from quarry.llm.graph import components

#: Shingles that are put last in the order: at most so many, those that most classes hold.
MOST_FREQUENT = 1 << 19
#: A shingle counts as frequent from so many classes on, unless too many shingles would.
LEAST_FREQUENT = 16
#: Buckets of at most so many parts are joined row by row; larger ones are compared in blocks of about BLOCK_ROWS.
SMALL_BUCKET, BLOCK_ROWS = 64, 512
#: Bits that sift the classes whose sets a verification needs.
SIFT_BITS = 24


@dataclass(frozen=True)
class Similarity:
    """k-word shingles; two sets link when den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def least_common(self, a, b):
        """Shingles that linked sets of these sizes share at least (numbers or columns)."""
        return F.ceil(self.num * (a + b) / (self.den + self.num)) if isinstance(a, Column) else -(-self.num * (a + b) // (self.den + self.num))

    def prefix(self, n: int) -> int:
        """Elements of a set of n of which a linked set must hold one."""
        return n - -(-self.num * n // self.den) + 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles (the whole sequence if it is shorter; nothing without words).

    Words are split and told apart on the Arrow buffers; each distinct one is hashed once, and the shingles of
    all texts are mixed from those hashes at a time.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    index = coded.indices.to_numpy(zero_copy_only=False)
    # White space at a text's ends leaves empty words.
    real = np.fromiter(map(len, distinct), np.int64, len(distinct))[index] > 0
    upto = np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy(zero_copy_only=False)]
    index = index[real]
    one = of_word[index]
    out = np.zeros(max(0, len(one) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ one[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = (out ^ (out >> np.uint64(32))).view(np.int64)
    sets = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= k:
            found = np.sort(out[a : b - k + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            whole = xxhash.xxh3_64_intdigest(b" ".join(distinct[i] for i in index[a:b].tolist()))
            sets.append(np.array([whole], np.uint64).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def digest(hashes: np.ndarray) -> int:
    """A class's name: 64 bits of a hash of its sorted shingles, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "big", signed=True)


def parity(hashes: np.ndarray) -> bytes:
    """Bitmap of the parity of hashes in each of its bits; two of them differ in no more bits than the sets in elements."""
    bits = max(64, min(1 << 20, 1 << max(0, len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def over_sets(docs: DataFrame, like: Similarity, id_col: str, text_col: str, fn, schema: str) -> DataFrame:
    """fn(rows, shingle sets) -> arrays of the columns of schema; rows has id and key (a hash of the text)."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays(fn(part, shingle_sets(part.column(1), like.k)), names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key")).mapInArrow(run, schema)


def leading_shingles(docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """Twice the prefix of each document by hash alone, one row a shingle, with the class it is in."""

    def fn(part, sets):
        # A class that occurs twice in a batch counts once.
        classes = {digest(s): s[: 2 * like.prefix(len(s))] for s in sets if len(s)}
        tokens = np.concatenate([*classes.values(), np.zeros(0, np.int64)])
        return [pa.array(tokens), pa.array(np.repeat(np.array([*classes], np.int64), [len(x) for x in classes.values()]))]

    return over_sets(docs, like, id_col, text_col, fn, "token long, class long")


def most_held(counts: DataFrame) -> np.ndarray:
    """The tokens of a table (token, n) held more than total / MOST_FREQUENT times: at most MOST_FREQUENT of them."""
    counts = stage_table(counts.where(F.col("n") >= LEAST_FREQUENT), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > F.lit(total // MOST_FREQUENT)).select("token").toPandas()["token"].to_numpy(np.int64)
    drop_table(counts)
    return np.sort(found)


def count_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def describe(docs: DataFrame, like: Similarity, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, key, n (set size), class, prefix, rare (shingles outside the frequent ones), bitmap, open.

    The prefix is final if it lies within the shingles that were counted.  Otherwise the set is ``open``: most
    of what was counted is frequent, the rest isn't known, and the prefix column has the whole set.  A class
    that occurs again in a batch has nulls instead.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    kind = docs.schema[id_col].dataType.simpleString()

    def fn(part, every):
        last, rows, seen = shared.value, [], set()
        for s in every:
            c = digest(s)
            if c in seen or not len(s):
                rows.append((len(s), c, None, None, None, None))
                continue
            seen.add(c)
            p = like.prefix(len(s))
            rare = ~is_in(s, last)
            closed = rare[: 2 * p].sum() >= p or len(s) <= 2 * p
            few = s[rare]
            prefix = s if not closed else few[:p] if len(few) >= p else np.concatenate([few, s[~rare][: p - len(few)]])
            rows.append((len(s), c, prefix, len(few), parity(s), not closed))
        n, c, prefix, rare, bitmap, wide = zip(*rows)
        return [part.column("id"), part.column("key"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int64()), pa.array(bitmap, pa.binary()), pa.array(wide, pa.bool_())]

    return over_sets(docs, like, id_col, text_col, fn, f"id {kind}, key long, n long, class long, prefix array<long>, rare long, bitmap binary, open boolean")


def settle(classes: DataFrame, like: Similarity, frequent: np.ndarray) -> DataFrame:
    """Final prefixes for open sets: their shingles are counted, and the frequent ones go last too.

    Only shingles in no closed prefix may still move to the end of the order, so closed prefixes stay right.
    """
    spark = classes.sparkSession
    wide = classes.where("open")
    if wide.isEmpty():
        return classes
    more = most_held(count_tokens(wide.select(F.explode("prefix").alias("token"))))
    shared = spark.sparkContext.broadcast(more)

    def taken(batches):
        for batch in batches:
            flat = np.unique(batch.column("prefix").flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(flat[is_in(flat, shared.value)], pa.int64())], names=["token"])

    used = classes.where("not open").select("prefix").mapInArrow(taken, "token long").distinct().toPandas()["token"].to_numpy(np.int64)
    last = spark.sparkContext.broadcast(np.union1d(frequent, np.setdiff1d(more, used)))

    @F.pandas_udf("prefix array<long>, rare long")
    def ordered(sets: pd.Series) -> pd.DataFrame:
        out = []
        for s in sets:
            s = np.asarray(s, np.int64)
            often = is_in(s, last.value)
            out.append((np.concatenate([s[~often], s[often]])[: like.prefix(len(s))], int((~often).sum())))
        return pd.DataFrame(out, columns=["prefix", "rare"])

    columns = ["class", "n", "bitmap", "least"]
    settled = wide.select(*columns, ordered("prefix").alias("o")).select(*columns, "o.prefix", "o.rare")
    out = stage_table(classes.where("not open").select(*columns, "prefix", "rare").unionByName(settled), "settled")
    drop_table(classes)
    return out


def bits_allow(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, like: Similarity) -> np.ndarray:
    """Whether sets of these sizes and bitmaps (arrays of bytes) may link.

    The larger bitmap is folded to the smaller one's size: low bits of the hashes stay, the rest is added up.
    """
    out = np.zeros(len(a), bool)
    wide = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    most = (na + nb) * (like.den - like.num) // (like.den + like.num)
    for la, lb in set(zip(*(w.tolist() for w in wide))):
        rows = np.flatnonzero((wide[0] == la) & (wide[1] == lb))
        for i in range(0, len(rows), 1 << 14):
            some = rows[i : i + (1 << 14)]
            x, y = (np.frombuffer(b"".join(s[some].tolist()), np.uint8).reshape(len(some), -1) for s in (a, b))
            size = min(la, lb)
            x, y = (np.bitwise_xor.reduce(m.reshape(len(some), -1, size), axis=1) for m in (x, y))
            out[some] = np.bitwise_count((x ^ y).view(np.uint64)).sum(1, dtype=np.int64) <= most[some]
    return out


def sift(pairs: DataFrame, like: Similarity) -> DataFrame:
    """Pairs (na, nb, bitmap_a, bitmap_b, ...) whose bitmaps don't rule a link out."""

    @F.pandas_udf("boolean")
    def may_link(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(bits_allow(na.to_numpy(), nb.to_numpy(), a.to_numpy(), b.to_numpy(), like))

    return pairs.where(may_link("na", "nb", "bitmap_a", "bitmap_b"))


def verify(pairs: DataFrame, docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """The pairs of classes (a, b) that link, by the exact intersection of their sets.

    Sets are made again from the texts, for the classes that the pairs name; a bitmap of fixed size keeps most
    others from being sent.
    """
    spark = docs.sparkSession
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    place = F.col("class").bitwiseAND(F.lit((1 << SIFT_BITS) - 1))
    words = needed.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits")).collect()
    bitmap = np.zeros(1 << (SIFT_BITS - 5), np.uint32)
    for w, bits in words:
        bitmap[w] = bits
    shared = spark.sparkContext.broadcast(bitmap)

    def fn(part, every):
        classes, sets, seen = [], [], set()
        for s in every:
            c = digest(s)
            p = c & ((1 << SIFT_BITS) - 1)
            if c not in seen and shared.value[p >> 5] >> np.uint32(p & 31) & 1:
                seen.add(c)
                classes.append(c)
                sets.append(s)
        return [pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]

    sets = over_sets(docs, like, id_col, text_col, fn, "class long, hashes array<long>").join(needed, "class", "left_semi")
    sets = stage_table(sets.groupBy("class").agg(F.first("hashes").alias("hashes")), "sets")
    found = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = stage_table(found.where(like.den * common >= like.num * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    drop_table(sets)
    return linked


def places_allow(a, at, b, bt, like: Similarity, least=F.least, greatest=F.greatest):
    """Sizes a and b, and a shared shingle at places ``at`` and ``bt`` of the order, leave room for a link (columns or arrays).

    For the first shared shingle of a pair this is a bound on what they share, so every link passes at it.
    """
    common = like.least_common(a, b)
    return (like.den * least(a, b) >= like.num * greatest(a, b)) & (a - at >= common) & (b - bt >= common)


def compare_blocks(rows: DataFrame, sizes: DataFrame, inside: DataFrame, classes: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of classes (a, b) out of large buckets: minors against all, a block of each at a time.

    rows: (token, part, n, root, at); sizes: (token, main, held, minors).  A bucket's minors and all its rows are
    dealt to blocks of about BLOCK_ROWS by hash, so a task holds two blocks however large the bucket.  There part
    pairs are filtered by root, size and place, expanded to their members and sifted; only what passes comes out.
    """
    blocks = lambda count: F.ceil(F.col(count) / BLOCK_ROWS).cast("int")
    dealt = stage_table(rows.join(sizes, "token").join(inside, "part").join(classes.select("class", "bitmap"), "class"), "blocks")
    block = lambda seed, count: F.pmod(F.xxhash64("class", F.lit(seed)), blocks(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
    fields = ["token", "i", "j", "class", "part", "n", "root", "at", "bitmap"]
    # The names of the right side differ, as both come from one table.
    left = dealt.where("root <> main").withColumn("i", block(1, "minors")).withColumn("j", every("held")).select(*fields)
    right = dealt.withColumn("j", block(2, "held")).withColumn("i", every("minors")).select(*(F.col(c).alias(f"{c}_b") for c in fields))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        b = b.rename(columns=lambda c: c.removesuffix("_b"))
        (_, first, member), (_, second, other) = (np.unique(x["part"].to_numpy(), return_index=True, return_inverse=True) for x in (a, b))
        x, y = ({c: s[c].to_numpy()[f] for c in ("n", "root", "at")} for s, f in ((a, first), (b, second)))
        near = x["root"][:, None] != y["root"][None, :]
        near &= places_allow(x["n"][:, None], x["at"][:, None], y["n"][None, :], y["at"][None, :], like, np.minimum, np.maximum)
        p, q = np.nonzero(near[member][:, other])
        may = bits_allow(a["n"].to_numpy()[p], b["n"].to_numpy()[q], a["bitmap"].to_numpy()[p], b["bitmap"].to_numpy()[q], like)
        one, two = a["class"].to_numpy()[p[may]], b["class"].to_numpy()[q[may]]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    keys = ["token", "i", "j"]
    return left.groupBy(keys).cogroup(right.groupBy([f"{k}_b" for k in keys])).applyInPandas(compare, "a long, b long").distinct()


def with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with both classes' sizes and bitmaps."""
    side = lambda s: classes.select(F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("bitmap").alias(f"bitmap_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def in_buckets(rows: DataFrame) -> DataFrame:
    """The rows whose token another row has too; the others, which are most, never move again."""
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    return stage_table(rows.join(held, "token", "left_semi"), "buckets")


def links(classes: DataFrame, docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of classes that link with others; classes has class, n, prefix, rare, bitmap."""
    # Groups: classes of one size with one prefix, named by the one with fewest rare shingles, their leader.
    led = classes.groupBy("n", "prefix").agg(F.min(F.struct("rare", "class")).alias("lead")).select("n", "prefix", F.col("lead.class").alias("group"), F.col("lead.rare").alias("rare"))
    led = stage_table(led, "groups")
    members = stage_table(classes.select("class", "n", "prefix").join(led.select("n", "prefix", "group"), ["n", "prefix"]).select("class", "group"), "members")
    rows = in_buckets(led.select("group", "n", "rare", F.posexplode("prefix").alias("at", "token")))

    # First round: members with their leader, leaders with the most central one of each bucket.
    band = F.log(F.col("n").cast("double")) / F.log(F.lit(like.den / like.num))
    banded = rows.select("*", F.explode(F.array(F.floor(band) * 2, F.floor(band + 0.5) * 2 + 1)).alias("band"))
    centre = banded.groupBy("token", "band").agg(F.min(F.struct("rare", "group", "n", "at")).alias("top"), F.count(F.lit(1)).alias("held")).where("held > 2")
    centre = centre.select("token", "band", F.col("top.group").alias("b"), F.col("top.n").alias("nb"), F.col("top.at").alias("bt"))
    spokes = banded.join(centre, ["token", "band"]).where(places_allow(F.col("n"), F.col("at"), F.col("nb"), F.col("bt"), like)).select(F.col("group").alias("a"), "b")
    pairs = members.select(F.col("class").alias("a"), F.col("group").alias("b")).unionByName(spokes).where("a <> b").distinct()
    pairs = stage_table(sift(with_classes(pairs, classes), like).select("a", "b"), "pairs")
    edges = verify(pairs, docs, like, id_col, text_col)
    drop_table(pairs)
    first = stage_table(components(edges), "roots")

    # Second round: what is still in different components.  A group splits into one part a component.
    placed = members.join(first.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "group", F.coalesce("root", "class").alias("root"))
    parts = stage_table(placed.groupBy("group", "root").agg(F.min("class").alias("part")), "parts")
    # Parts of one group share their whole prefix: the group is one more bucket, whether its shingles are shared or not.
    split = parts.groupBy("group").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("group")
    own = led.select("group", "n", F.lit(0).alias("at"), F.xxhash64("group", F.lit("group")).alias("token")).join(split, "group", "left_semi")
    shared = rows
    rows = rows.select("group", "n", "at", "token").unionByName(own).join(parts, "group").select("part", "n", "root", "at", "token")
    mixed = rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    rows = stage_table(rows.join(mixed, "token", "left_semi"), "buckets")
    for done in (shared, led):
        drop_table(done)
    sizes = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("token").agg(F.max(F.struct("held", "root")).alias("top"), F.sum("held").alias("held"))
    sizes = stage_table(sizes.select("token", F.col("top.root").alias("main"), "held", (F.col("held") - F.col("top.held")).alias("minors")), "sizes")
    inside = placed.join(parts, ["group", "root"]).select("part", "class")
    # Small buckets: minors with all others of their bucket, then the pairs' members.
    small = sizes.where(F.col("held") <= SMALL_BUCKET)
    minors = rows.join(small.select("token", "main"), "token").where("root <> main")
    other = rows.select("token", F.col("part").alias("part_b"), F.col("n").alias("nb"), F.col("at").alias("bt"), F.col("root").alias("root_b"))
    near = (F.col("root") != F.col("root_b")) & places_allow(F.col("n"), F.col("at"), F.col("nb"), F.col("bt"), like)
    pairs = minors.join(other, "token").where(near).select(F.least("part", "part_b").alias("pa"), F.greatest("part", "part_b").alias("pb")).distinct()
    expanded = pairs.join(inside.select(F.col("part").alias("pa"), F.col("class").alias("a")), "pa").join(inside.select(F.col("part").alias("pb"), F.col("class").alias("b")), "pb").select("a", "b")
    sifted = sift(with_classes(expanded, classes), like).select("a", "b")
    large = sizes.where(F.col("held") > SMALL_BUCKET)
    if not large.isEmpty():
        sifted = sifted.unionByName(compare_blocks(rows, large, inside, classes, like)).distinct()
    pairs = stage_table(sifted, "pairs")
    for done in (rows, sizes, members, parts):
        drop_table(done)
    more = verify(pairs, docs, like, id_col, text_col)
    drop_table(pairs)
    return components(edges.unionByName(more))


def grouped_documents(docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, key (hash of the text), n, component_id and group (a class digest; null for empty sets)."""
    frequent = most_held(count_tokens(leading_shingles(docs, like, id_col, text_col)))
    described = stage_table(describe(docs, like, frequent, id_col, text_col), "described")
    every = stage_table(described.select("id", "key", "n", "class"), "rows")
    classes = described.where("n > 0").groupBy("class").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "prefix", "rare", "bitmap", "open")), F.min("id").alias("least"))
    classes = stage_table(classes, "classes")
    drop_table(described)
    classes = settle(classes, like, frequent)
    roots = links(classes, docs, like, id_col, text_col)
    grouped = classes.select("class", "least").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    grouped = stage_table(grouped, "grouped")
    drop_table(classes)
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("class", F.col("root").alias("group"), "component_id")
    full = every.where("n > 0").select("id", "key", "n", "class").join(named, "class").select("id", "key", "n", "component_id", "group")
    return full.unionByName(every.where("n = 0").select("id", "key", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group")))


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_shingles, component_id (the smallest id of its group) and group (a digest).

    Null, empty and wordless texts have an empty set, link with nothing and are groups of their own.  Texts
    with fewer than k words are one shingle.  Repeated rows and repeated ids are documents of their own, in one
    group if their texts link; null ids never are a group's smallest one, and a group of nothing else has a
    null component_id.  An empty table gives no rows.
    """
    found = grouped_documents(docs, like, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "group")


def keep_one(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each group: the smallest id (nulls last), then the smallest text hash.

    Documents with empty sets all stay.  Of rows with equal id and text one stays, the one whose other columns have the
    smallest hash.  An empty table gives no rows; columns of any name stay as they are.
    """
    found = grouped_documents(docs, like, id_col, text_col)
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("one"))
    winners = first.select(F.col("one.id").alias("_q_id"), F.col("one.key").alias("_q_key")).unionByName(found.where("group is null").select(F.col("id").alias("_q_id"), F.col("key").alias("_q_key"))).distinct()
    text, nth = (f"_q_{uuid.uuid4().hex}" for _ in range(2))
    rows = docs.withColumn(text, F.xxhash64(text_col))
    rows = rows.join(winners, rows[id_col].eqNullSafe(winners["_q_id"]) & (rows[text] == winners["_q_key"]), "left_semi")
    number = F.row_number().over(Window.partitionBy(id_col, text).orderBy(F.xxhash64(*(c for c in docs.columns if c not in (id_col, text_col)), F.lit(0))))
    return rows.withColumn(nth, number).where(F.col(nth) == 1).drop(nth, text)
