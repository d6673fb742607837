"""Derived columns: times, sizes, extensions, attribute letters, and texts for display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import EPOCH_DIFF_MS

# Attribute bits and their letters, in display order.
ATTRIBUTE_LETTERS = [(0x1, "R"), (0x2, "H"), (0x4, "S"), (0x20, "A"), (0x10, "D"), (0x400, "L"), (0x200, "P"), (0x800, "C"), (0x4000, "E"), (0x100, "T"), (0x1000, "O"), (0x2000, "I")]


def filetime_to_ms(ft: Column) -> Column:
    """100 ns ticks since 1601 to Unix milliseconds; 0 is unknown."""
    ticks = ft.cast("long")
    whole = F.call_function("div", ticks - F.pmod(ticks, F.lit(10_000)), F.lit(10_000))
    return F.when(ticks != 0, whole.cast("long") - EPOCH_DIFF_MS)


def ms_to_filetime(ms: Column) -> Column:
    """The inverse; 0 and unknown give 0, and nothing goes below 1601."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(ms + EPOCH_DIFF_MS, F.lit(0)) * 10_000)


def size_key(is_dir: Column, size: Column) -> Column:
    return F.when(is_dir, F.lit(-1).cast("long")).otherwise(F.coalesce(size, F.lit(-1).cast("long")))


def known_time(ms: Column) -> Column:
    return F.coalesce(ms, F.lit(0).cast("long"))


def sort_extension(is_dir: Column, name_lower: Column) -> Column:
    """After the last dot; nothing for folders and for names whose only dot comes first."""
    last = F.substring_index(name_lower, ".", -1)
    return F.when(~is_dir & (F.length(last) < F.length(name_lower) - 1), last).otherwise("")


def icon_extension(is_dir: Column, name_lower: Column) -> Column:
    """The same, but a name that begins with its only dot counts as an extension."""
    return F.when(~is_dir & name_lower.contains("."), F.substring_index(name_lower, ".", -1)).otherwise("")


def attribute_letters(attributes: Column) -> Column:
    return F.concat(*(F.when(attributes.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("") for bit, letter in ATTRIBUTE_LETTERS))


def local_time(ms: Column, tz: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall time of an instant in ``tz``; empty for 0 and unknown."""
    instant = F.timestamp_millis(ms).cast("timestamp")
    wall = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").otherwise(F.date_format(wall, pattern))


def human_size(is_dir: Column, size: Column) -> Column:
    """Whole bytes under 1024, one decimal up to TB; empty for folders and unknown sizes."""
    out = F.when(is_dir | (F.coalesce(size, F.lit(-1)) < 0), "").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", size / 1024**power))
    return out.otherwise(F.format_string("%.1f TB", size / 1024**4))


def folder_of(path: Column) -> Column:
    """The path up to its last backslash (a backslash at the very beginning doesn't count)."""
    return F.regexp_replace(path, r"(?s)(?<=.)\\[^\\]*$", "")


def record_of(reference: Column) -> Column:
    """Record number of a file reference: its low 48 bits."""
    return reference.bitwiseAND(F.lit((1 << 48) - 1))


def sequence_of(reference: Column) -> Column:
    return F.shiftrightunsigned(reference, 48)


def marked(text: str, terms: list[str], match_case: bool = False, whole_word: bool = False) -> str:
    """HTML of a text with <mark> around each term's occurrences; touching ranges are one."""
    hay = text if match_case else text.lower()
    spans = []
    for term in terms:
        needle, at = term if match_case else term.lower(), 0
        while needle and (at := hay.find(needle, at)) >= 0:
            end = at + len(needle)
            free = lambda c: not (c.isalnum() or c == "_")
            if not whole_word or ((at == 0 or free(hay[at - 1])) and (end == len(hay) or free(hay[end]))):
                spans.append((at, end))
                at = end
            else:
                at += 1
    out, done = [], 0
    escape = lambda s: re.sub('[&<>"]', lambda m: {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}[m[0]], s)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [escape(text[done:a]), "<mark>", escape(text[a:b]), "</mark>"]
        done = b
    return "".join([*out, escape(text[done:])])


#: Private characters that stand for the marks until the rest is escaped.
OPEN, CLOSE = "\ue000", "\ue001"


def highlight(text: Column, terms: list[str], match_case: bool = False, whole_word: bool = False) -> Column:
    """marked() over a column.

    One term needs no Python: its occurrences are set between private characters, touching ones are joined, the
    text is escaped, and the characters become marks.  Ranges of several terms may overlap and are joined in Arrow
    batches.
    """
    if len(terms) == 1 and terms[0]:
        quoted = re.sub(r"([^\w\s])", r"\\\1", terms[0])
        pattern = f"{'(?U)' if match_case else '(?iuU)'}" + (rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if whole_word else quoted)
        out = F.regexp_replace(F.translate(text, OPEN + CLOSE, ""), pattern, f"{OPEN}$0{CLOSE}")
        for raw, safe in ((CLOSE + OPEN, ""), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), (OPEN, "<mark>"), (CLOSE, "</mark>")):
            out = F.replace(out, F.lit(raw), F.lit(safe))
        return out

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else marked(t, terms, match_case, whole_word))

    return mark(text)


def decode_body(raw: bytes | None, most: int) -> str | None:
    """Text of the first ``most`` bytes of a file, or None for binary ones.

    A byte-order mark means UTF-16.  Without one, a NUL in the first 8192 bytes means UTF-16 if a third of
    them are NULs and one parity has over four times as many as the other; else binary.  The rest is UTF-8,
    bad bytes replaced.
    """
    if raw is None:
        return None
    raw = raw[:most]
    utf16 = lambda b, kind: b[: len(b) // 2 * 2].decode(kind, "replace")
    for mark, kind in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return utf16(raw[2:], kind)
    head = raw[:8192]
    even, odd = head[::2].count(0), head[1::2].count(0)
    if not even + odd:
        return raw.decode("utf-8", "replace")
    if 3 * (even + odd) >= len(head):
        if odd > 4 * even:
            return utf16(raw, "utf-16-le")
        if even > 4 * odd:
            return utf16(raw, "utf-16-be")
    return None


def body_text(raw: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def decode(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: decode_body(None if b is None else bytes(b), most))

    return decode(raw)
