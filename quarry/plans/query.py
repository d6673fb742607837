"""The search language: text -> tokens -> tree of leaves.

Words next to each other must all match, | separates alternatives and binds loosest, ! negates, parentheses
group, quotes make a literal phrase.  Nothing is a syntax error: half-typed queries give useful results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime
from zoneinfo import ZoneInfo

from quarry.functions import literals
from quarry.plans import regex
from quarry.schema import DEFAULT_LIMIT

#: Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEXER = re.compile(f'"(?P<phrase>[^"]*)"?|(?P<mark>[|()])|(?P<word>[^{SPACE}|()"!][^{SPACE}|()"]*)|(?P<bang>!)')
DRIVE = re.compile(r"[A-Za-z]:")
MAX_GROUPS = 64
SORTS = ("name", "path", "size", "modified", "created", "accessed", "ext", "attributes")


class QueryError(ValueError):
    """A query that can't be run: a bad regular expression, or alternatives around content terms."""


@dataclass(frozen=True)
class SearchOptions:
    query: str = ""
    limit: int = DEFAULT_LIMIT
    sort: str = "name"
    descending: bool = False
    folders_first: bool = False
    match_case: bool = False
    match_path: bool = False
    whole_word: bool = False
    regex: bool = False
    #: Most candidates whose bodies a content search reads, first in the wanted order; None reads all.
    content_candidates: int | None = None
    tz: str = "UTC"
    now: datetime | None = None

    def local_now(self) -> datetime:
        return self.now or datetime.now(ZoneInfo(self.tz)).replace(tzinfo=None)


@dataclass(frozen=True)
class Leaf:
    """One test of an entry.

    kind: contains, glob, word, regex (on ``target`` name or path, ``value`` is the text), ext, size, date
    (``target`` is the field), attrib, file, folder, never.
    """

    kind: str
    target: str = ""
    value: object = None
    case: bool = False


@dataclass(frozen=True)
class Node:
    """op: and, or, not."""

    op: str
    parts: tuple = ()


@dataclass
class Level:
    """An open group of the parser: finished alternatives, terms of the current one, and a pending negation."""

    alternatives: list = field(default_factory=list)
    terms: list = field(default_factory=list)
    negate: bool = False

    def add(self, tree) -> None:
        if tree is not None:
            self.terms.append(Node("not", (tree,)) if self.negate else tree)
        self.negate = False

    def close_alternative(self) -> None:
        if tree := joined("and", self.terms):
            self.alternatives.append(tree)
        self.terms, self.negate = [], False

    def close(self):
        self.close_alternative()
        return joined("or", self.alternatives)


def joined(op: str, parts: list):
    """No part: no constraint (None); one: itself."""
    return Node(op, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) with kind word, phrase, or one of | ( ) !; empty phrases are dropped."""
    out = []
    for m in LEXER.finditer(query):
        kind = m.lastgroup
        if kind in ("mark", "bang"):
            out.append((m.group(), ""))
        elif m.group(kind):
            out.append((kind, m.group(kind)))
    return out


def parse(options: SearchOptions):
    """The tree of a query, or None if it constrains nothing."""
    if options.regex:
        return regex_leaf(options)
    levels = [Level()]
    for kind, text in tokens(options.query):
        top = levels[-1]
        if kind == "!":
            top.negate = not top.negate
        elif kind == "|":
            top.close_alternative()
        elif kind == "(":
            if len(levels) > MAX_GROUPS:
                top.negate = False
            else:
                levels.append(Level())
        elif kind == ")":
            if len(levels) > 1:
                levels.pop()
                levels[-1].add(top.close())
            else:
                top.negate = False
        else:
            top.add(phrase(text, options) if kind == "phrase" else word(text, options))
    while len(levels) > 1:
        inner = levels.pop().close()
        levels[-1].add(inner)
    return levels[0].close()


def folded(text: str, options: SearchOptions) -> str:
    return text if options.match_case else text.lower()


def like_a_path(text: str) -> bool:
    return "\\" in text or bool(DRIVE.match(text))


def target_of(text: str, options: SearchOptions) -> str:
    return "path" if options.match_path or like_a_path(text) else "name"


def phrase(text: str, options: SearchOptions) -> Leaf:
    return Leaf("contains", target_of(text, options), folded(text, options), options.match_case)


def text_leaf(text: str, target: str, options: SearchOptions) -> Leaf | None:
    if not text:
        return None
    kind = "glob" if re.search(r"[*?]", text) else "word" if options.whole_word else "contains"
    return Leaf(kind, target, folded(text, options), options.match_case)


def extensions(value: str) -> tuple[str, ...] | None:
    return tuple(e.removeprefix(".").lower() for e in re.split("[;,]", value) if e) or None


def word(text: str, options: SearchOptions) -> Leaf | None:
    """A function with its value, or a text to look for.  Function names are ASCII and of any case."""
    name, colon, value = text.partition(":")
    name = name.lower() if name.isascii() else ""
    if colon and not value and name in ("file", "files", "folder", "folders", "dir"):
        return Leaf("file" if name.startswith("file") else "folder")
    if colon and name == "path":
        return text_leaf(value, "path", options)
    readers = {
        "ext": lambda v: extensions(v),
        "size": literals.size_filter,
        "attrib": literals.attribute_mask,
        **dict.fromkeys(("dm", "dc", "da"), lambda v: literals.date_filter(v, options.local_now(), options.tz)),
    }
    if colon and name in readers:
        found = readers[name](value)
        if found is None:
            return Leaf("never") if value.strip() else None
        if name in ("dm", "dc", "da"):
            return Leaf("date", {"dm": "modified_ms", "dc": "created_ms", "da": "accessed_ms"}[name], found)
        return Leaf(name, "", found)
    return text_leaf(text, target_of(text, options), options)


def regex_leaf(options: SearchOptions) -> Leaf | None:
    pattern = options.query.strip()
    if not pattern:
        return None
    try:
        regex.java(pattern)
    except regex.RegexError as e:
        raise QueryError(f"invalid regular expression: {e}") from None
    return Leaf("regex", "path" if options.match_path else "name", pattern, options.match_case)


def leaves(tree) -> list[Leaf]:
    if tree is None:
        return []
    return [tree] if isinstance(tree, Leaf) else [x for p in tree.parts for x in leaves(p)]


def needs_path(tree) -> bool:
    return any(x.target == "path" for x in leaves(tree))


# ------------------------------------------------------------------ content terms

CONTENT = re.compile(f'(?P<quoted>"[^"]*"?)|(?:(?<![^{SPACE}])content:(?:"(?P<phrase>[^"]*)"?|(?P<word>[^{SPACE}]*)))', re.IGNORECASE | re.ASCII)


def extract_content(query: str) -> tuple[str, list[str]]:
    """The query without its content: terms (white space collapsed), and the terms; quotes hide them."""
    terms: list[str] = []

    def take(m: re.Match) -> str:
        if m["quoted"] is not None:
            return m["quoted"]
        if term := m["phrase"] or m["word"]:
            terms.append(term)
        return ""

    rest = CONTENT.sub(take, query)
    return " ".join(x for x in re.split(f"[{SPACE}]+", rest) if x), terms


def check_content_scope(query: str, terms: list[str]) -> None:
    """Content terms can't be joined with alternatives at the top level."""
    depth = 0
    for kind, _ in tokens(query) if terms else ():
        depth = depth + 1 if kind == "(" else max(0, depth - 1) if kind == ")" else depth
        if kind == "|" and depth == 0:
            raise QueryError("content: can't be combined with | outside parentheses")


# ------------------------------------------------------------------ composing queries

# Prefixes that a literal word must not have bare, named size ranges, choices of the builder.
FUNCTION = re.compile(r"(ext|size|content|dm|dc|da|attrib|path|file|files|folder|folders|dir):", re.IGNORECASE)
SIZE_PRESETS = {
    "any": "", "empty": "size:0", "tiny": "size:<=10kb", "small": "size:>=10kb size:<100kb", "medium": "size:>=100kb size:<1mb",
    "large": "size:>=1mb size:<16mb", "huge": "size:>=16mb size:<128mb", "gigantic": "size:>=128mb",
}
DATE_CHOICES = ("today", "yesterday", "thisweek", "lastweek", "thismonth", "lastmonth", "thisyear", "lastyear")
ATTRIBUTE_CHOICES = ("h", "s", "r", "a", "c", "e")
MATCH_CHOICES = ("match_case", "whole_word", "match_path")
TYPE_CHOICES = ("", "file:", "folder:")


def literal_word(text: str) -> str:
    """A word of the name field: quoted where the language would read it otherwise."""
    text = text.replace('"', "")
    return f'"{text}"' if text and (re.search("[()]", text) or text.startswith("!") or FUNCTION.match(text)) else text


def normal_extension(text: str) -> str:
    """The last dot segment, lower case, without characters that no file name has."""
    return re.sub(r'[<>:"/\\|?*]', "", ([s for s in text.split(".") if s] or [""])[-1].lower())


def content_token(text: str) -> str:
    text = text.replace('"', "").strip()
    return "" if not text else f'content:"{text}"' if re.search(r"\s", text) else f"content:{text}"


def build_query(name="", extensions="", size="", date_field="dm", date="", kind="", attributes="", content="") -> str:
    """A query from the builder's fields; alternatives of the name are grouped so that the rest binds to all."""
    options = [" ".join(filter(None, map(literal_word, s.split()))) for s in name.split("|")]
    options = [s for s in options if s]
    exts = dict.fromkeys(filter(None, map(normal_extension, re.split(r"[\s,;|()]+", extensions))))
    parts = [
        f"({' | '.join(options)})" if len(options) > 1 else "".join(options), f"ext:{';'.join(exts)}" if exts else "",
        size if kind != "folder:" else "", f"{date_field}:{date}" if date else "", kind, f"attrib:{attributes}" if attributes else "", content_token(content),
    ]
    return " ".join(filter(None, parts))


def apply_size_preset(query: str, preset: str) -> str:
    kept = [w for w in query.split() if not w.lower().startswith("size:")]
    return " ".join([*kept, *filter(None, [SIZE_PRESETS.get(preset, preset)])])


def scope_to_folder(folder: str, options: SearchOptions = SearchOptions()) -> SearchOptions:
    """Search below a folder: its path as a phrase, on full paths."""
    folder = folder.strip().rstrip('"\\')
    return replace(options, query=f'"{folder}\\" ', match_path=True, regex=False, whole_word=False)


def remember(history: list[str], query: str, most: int = 25) -> list[str]:
    """Search history: newest first, no repeats, bounded."""
    query = query.strip()
    return [query, *(q for q in history if q != query)][:most] if query else history


def highlight_terms(options: SearchOptions) -> list[str]:
    """Texts to mark in results: plain words and phrases that are not negated; none in regex mode."""
    if options.regex:
        return []
    out, stack, negate = [], [False], False
    for kind, text in tokens(extract_content(options.query)[0]):
        if kind == "!":
            negate = not negate
            continue
        if kind == "(":
            stack.append(stack[-1] ^ negate)
        elif kind == ")":
            stack = stack[:-1] or [False]
        elif kind in ("word", "phrase") and not (stack[-1] ^ negate):
            if kind == "word" and text.lower().startswith("path:"):
                text = text[5:]
            elif kind == "word" and FUNCTION.match(text):
                text = ""
            if text and not (kind == "word" and re.search(r"[*?]", text)):
                out.append(text)
        negate = False
    return out
