"""The query tree as one boolean Column, and as a plain Python test of a row for checks."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans import regex
from quarry.plans.query import Leaf, QueryError

#: Java: a dot stops at \\n alone, classes and \\b are Unicode; case is ignored the Unicode way.
JAVA_FLAGS, JAVA_IGNORE_CASE = "(?dU)", "(?diuU)"


def haystack(leaf: Leaf) -> str:
    """The stored column that a text leaf reads: folded ones are not computed again, so scans can prune."""
    return leaf.target if leaf.case or leaf.kind == "regex" else f"{leaf.target}_lower"


def java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~\s])", r"\\\1", text)


def word_pattern(text: str, quote=java_quote) -> str:
    """The text as a whole word: a boundary where it begins or ends with a word character, nothing where it doesn't."""
    edge = [r"\b" if re.fullmatch(r"\w", text[k]) else "" for k in (0, -1)]
    return quote(text).join(edge)


def java_regex(leaf: Leaf) -> str:
    """The pattern for the engine; one that it can't compile is an error of the query now, not of a task later."""
    pattern = (JAVA_FLAGS if leaf.case else JAVA_IGNORE_CASE) + regex.java(leaf.value)
    context = SparkContext._active_spark_context
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise QueryError(f"invalid regular expression: {str(e).splitlines()[0]}") from None
    return pattern


def rooted(text: str) -> bool:
    return text.startswith("\\") or bool(re.match("[A-Za-z]:", text))


def glob_column(leaf: Leaf) -> Column:
    """LIKE, which the optimizer turns into prefix, suffix and substring tests; wildcards don't cross a newline."""
    text, hay = str(leaf.value), F.col(haystack(leaf))
    like = re.sub(r"([\\%_])", r"\\\1", text).replace("*", "%").replace("?", "_")
    if leaf.target == "path" and not rooted(text):
        return F.when(hay.contains("\n"), hay.rlike(JAVA_FLAGS + glob_pattern(text, java_quote))).otherwise(hay.like(f"%{like}%"))
    return hay.like(like) & ~hay.contains("\n")


def glob_pattern(text: str, quote=re.escape) -> str:
    return "".join({"*": ".*", "?": "."}.get(c) or quote(c) for c in text)


def leaf_column(leaf: Leaf) -> Column:
    match leaf.kind:
        case "contains":
            return F.col(haystack(leaf)).contains(leaf.value)
        case "glob":
            return glob_column(leaf)
        case "word":
            return F.col(haystack(leaf)).rlike(JAVA_FLAGS + word_pattern(leaf.value))
        case "regex":
            return F.col(haystack(leaf)).rlike(java_regex(leaf))
        case "ext":
            return F.col("name_lower").contains(".") & F.substring_index("name_lower", ".", -1).isin(*leaf.value)
        case "size":
            return ~F.col("is_dir") & within(F.col("size"), leaf.value)
        case "date":
            return within(F.col(leaf.target), leaf.value)
        case "attrib":
            return F.col("attributes").bitwiseAND(F.lit(leaf.value)) == leaf.value
        case "file":
            return ~F.col("is_dir")
        case "folder":
            return F.col("is_dir")
    return F.lit(False)


#: Bounds over this are open: no stored value is larger.
LONG_MAX = (1 << 63) - 1


def within(value: Column, bounds) -> Column:
    """Two-valued: an unknown value is outside."""
    test = value.isNotNull()
    if bounds.low is not None:
        test = test & (value >= F.lit(bounds.low) if bounds.low <= LONG_MAX else F.lit(False))
    if bounds.high is not None and bounds.high <= LONG_MAX:
        test = test & (value <= F.lit(bounds.high))
    return test


def column(tree) -> Column:
    """True or false for every row: nullable leaves are false before a negation sees them."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Leaf):
        return F.coalesce(leaf_column(tree), F.lit(False)) if tree.kind in ("size", "date") else leaf_column(tree)
    parts = [column(p) for p in tree.parts]
    if tree.op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.op == "and" else out | p
    return out


def drives(tree) -> set[str] | None:
    """Drives that a matching entry must be on, from path terms that begin with a drive; None: any.

    Sound because no name holds a colon, so such a term can only match at a path's beginning.
    """
    if isinstance(tree, Leaf):
        text = str(tree.value or "")
        plain = tree.kind == "contains" or (tree.kind == "glob" and rooted(text))
        return {text[0].upper()} if tree.target == "path" and plain and re.match("[A-Za-z]:", text) else set() if tree.kind == "never" else None
    if tree is None or tree.op == "not":
        return None
    known = [drives(p) for p in tree.parts]
    if tree.op == "and":
        known = [k for k in known if k is not None]
        return set.intersection(*known) if known else None
    return None if None in known else set.union(*known)


def evaluate(tree, row: dict) -> bool:
    """The same test in Python, written from the language's definition; tests hold column() against it."""
    if tree is None:
        return True
    if not isinstance(tree, Leaf):
        answers = (evaluate(p, row) for p in tree.parts)
        return not next(answers) if tree.op == "not" else all(answers) if tree.op == "and" else any(answers)
    v, hay = tree.value, row.get(haystack(tree)) if tree.target in ("name", "path") else None
    inside = lambda x, b: x is not None and (b.low is None or x >= b.low) and (b.high is None or x <= b.high)
    match tree.kind:
        case "contains":
            return v in hay
        case "glob":
            whole = tree.target == "name" or rooted(v)
            return bool((re.fullmatch if whole else re.search)(glob_pattern(v), hay))
        case "word":
            return bool(re.search(word_pattern(v, re.escape), hay))
        case "regex":
            return bool(re.search(v, hay, 0 if tree.case else re.IGNORECASE))
        case "ext":
            return "." in row["name_lower"] and row["name_lower"].rpartition(".")[2] in v
        case "size":
            return not row["is_dir"] and inside(row["size"], v)
        case "date":
            return inside(row[tree.target], v)
        case "attrib":
            return row["attributes"] & v == v
        case "file" | "folder":
            return row["is_dir"] == (tree.kind == "folder")
    return False
