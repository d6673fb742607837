"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of at least CANDIDATE_CHARS key characters, or of SHORT_CHARS after a key word, without
what the patterns' spans cover of it.  The network sees the candidate, in overlapping windows if it is long
and by its parts between separators, and the text around it.  It was trained on labelled findings; its
threshold is the highest that keeps the wanted recall on a calibration part.  Short candidates have a network
of their own.  Spans of the patterns are always reported.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_rows, map_texts

# The base patterns and the least length of what they capture.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE_CHARS, SHORT_CHARS = 20, 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{%d,}" % SHORT_CHARS)
#: Parts of a candidate between separators, coarse and fine; marks that join a pattern's span to what follows.
COARSE, FINE, JOINTS = re.compile(r"[^/.=]+"), re.compile(r"[^/._=+\-]+"), "/._-="
KEY_WORDS = ("key", "auth", "cred", "secret", "token", "pass", "bearer")
#: Characters that the network sees: CONTEXT before the candidate, then as much of the candidate, then after.
CONTEXT, BODY, AFTER = 24, 48, 8
WIDTH, KERNEL, CHANNELS, CLASSES = CONTEXT + BODY + AFTER, 5, 12, 10
LEAST_RECALL = 0.98
#: Characters from one window of a long candidate to the next.
STEP = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, each pattern leftmost and non-overlapping."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def class_of_characters() -> np.ndarray:
    """Character code -> class: padding 0, lower, upper, digit, hex letter, marks, spaces, quotes, other letters."""
    table = np.full(128, 9, np.int8)
    for k, group in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, "abcdef", "+/=", "_-.", " \t\n\r", "\"'`", ":;,")):
        table[[ord(c) for c in group]] = k + 1
    table[0] = 0
    return table


CLASS_OF = class_of_characters()


def view(text: str, start: int, end: int) -> str:
    """The fixed-width surroundings of a candidate: context before, its first characters, what follows it."""
    before = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0")
    return before + text[start : min(end, start + BODY)].ljust(BODY, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def inner_view(text: str, run: tuple[int, int], start: int, end: int) -> str:
    """The view of a part of a run as if it stood alone, or after the name that it is assigned to."""
    a, b = run
    before = text[max(0, start - CONTEXT) : start] if start and text[start - 1] == "=" else text[max(0, a - CONTEXT) : a]
    return before.rjust(CONTEXT, "\0") + text[start : min(end, start + BODY)].ljust(BODY, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")


def after_key_word(text: str, start: int) -> bool:
    before = text[max(0, start - CONTEXT) : start].lower()
    return any(w in before for w in KEY_WORDS)


def one_hot(views: list[str]) -> np.ndarray:
    """Character classes of views as (view, place, class), and per view its share of changes and distinct characters."""
    codes = np.frombuffer("".join(views).encode("utf-32-le", "replace"), np.uint32).reshape(len(views), WIDTH)
    classes = np.where(codes < 128, CLASS_OF[np.minimum(codes, 127)], 9)
    return (classes[:, :, None] == np.arange(CLASSES)).astype(np.float32)


def summary(views: list[str]) -> np.ndarray:
    """Per view: entropy of the body's characters, share of class changes, share of vowels, key word before."""
    out = np.zeros((len(views), 4), np.float32)
    for i, v in enumerate(views):
        body = v[CONTEXT : CONTEXT + BODY].rstrip("\0")
        counts = np.array([body.count(c) for c in set(body)]) / max(1, len(body))
        kinds = [c.isdigit() * 2 + c.isupper() for c in body]
        before = v[:CONTEXT].lower()
        out[i] = -(counts * np.log2(counts)).sum() / 5, sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(body)), sum(c in "aeiouAEIOU" for c in body) / max(1, len(body)), any(w in before for w in KEY_WORDS)
    return out


@dataclass
class Network:
    """Convolution over character classes, rectified, pooled by maximum and mean, then a logistic unit."""

    kernel: np.ndarray
    kernel_bias: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float = 0.5
    #: The network of short candidates; None: they are judged by this one.
    short: Network | None = None

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).reshape(len(x), WIDTH - KERNEL + 1, CLASSES * KERNEL)
        return patches, np.maximum(patches @ self.kernel + self.kernel_bias, 0)

    def pooled(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.hstack([h.max(1), h.mean(1), s])

    def score(self, views: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(views), 512):
            part = views[i : i + 512]
            z = self.pooled(self.hidden(one_hot(part))[1], summary(part)) @ self.weights + self.bias
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out) if out else np.zeros(0)


def labelled_findings(n: int, seed: int = 11) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Findings (text, start, end) with labels: keys in the places where they leak, and what only looks like keys."""
    rng = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    letters = lambda k, abc=alnum: "".join(rng.choice(abc) for _ in range(k))
    syllable = lambda: rng.choice("bcdfghlmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "an", "er", "in", "on", "th"])
    word = lambda k: "".join(syllable() for _ in range(k))
    prose = lambda: " ".join(word(rng.randint(1, 4)) for _ in range(4))

    def secret() -> tuple[str, str]:
        kind = rng.randrange(6)
        body = [lambda: letters(40), lambda: "ghp_" + letters(36), lambda: letters(40, alnum + "+/"), lambda: "sk_live_" + letters(24), lambda: ".".join(["eyJ" + letters(20), "eyJ" + letters(40), letters(43)]), lambda: letters(rng.randint(22, 36), string.ascii_lowercase + string.digits)][kind]()
        before = rng.choice(["Authorization: Bearer ", "aws_key -> ", "auth=", "credentials ", "export KEY=", 'key: "', "using ", "", "login with ", "auth "])
        return before, body

    def harmless() -> tuple[str, str]:
        kind = rng.randrange(7)
        body = [lambda: word(rng.randint(9, 16)), lambda: word(rng.randint(9, 14)).capitalize(), lambda: "-".join(word(3) for _ in range(4)), lambda: "/".join(["src", word(4), word(5), word(3) + ".txt"]), lambda: "_".join(word(rng.randint(2, 4)) for _ in range(4)), lambda: "." * rng.randint(20, 60), lambda: word(rng.randint(9, 14)).upper()][kind]()
        return rng.choice(["", "the ", "see ", "file ", "in "]), body

    findings, labels = [], []
    for _ in range(n):
        label = rng.random() < 0.5
        before, body = secret() if label else harmless()
        head = f"{prose()} {before}"
        findings.append((f"{head}{body}{rng.choice(['', '.', ',', chr(34)])} {prose()}", len(head), len(head) + len(body)))
        labels.append(label)
    return findings, np.array(labels, float)


def short_findings(n: int, seed: int = 17) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Labelled findings of SHORT_CHARS to CANDIDATE_CHARS - 1 characters, all of them after a key word."""
    rng = random.Random(seed)
    letters = lambda k, abc: "".join(rng.choice(abc) for _ in range(k))
    syllable = lambda: rng.choice("bcdfghlmnprstvw") + rng.choice(["a", "e", "i", "o", "u", "an", "er", "in", "on", "th"])
    word = lambda k: "".join(syllable() for _ in range(k))
    length = lambda: rng.randint(SHORT_CHARS, CANDIDATE_CHARS - 1)
    alnum = string.ascii_letters + string.digits

    def secret() -> str:
        return [
            lambda: letters(length() - 1, alnum) + rng.choice(string.digits), lambda: letters(length() - 1, string.ascii_lowercase + string.digits) + rng.choice(string.digits),
            lambda: letters(length() - 1, "0123456789abcdef") + rng.choice("abcdef"), lambda: letters(length(), alnum + "+/_-"), lambda: word(rng.randint(3, 5)).capitalize() + letters(rng.randint(2, 4), string.digits),
        ][rng.randrange(5)]()

    def harmless() -> str:
        return [
            lambda: word(rng.randint(4, 7)), lambda: word(rng.randint(4, 7)).capitalize(), lambda: word(rng.randint(4, 7)).upper(), lambda: word(2) + rng.choice("-_./") + word(rng.randint(2, 4)), lambda: "." * length(), lambda: word(4) + ".",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: word(3) + rng.choice([".txt", ".py", ".json", ".md"]),
        ][rng.randrange(8)]()

    findings, labels = [], []
    for _ in range(n):
        label = rng.random() < 0.5
        body = (secret() if label else harmless())[: CANDIDATE_CHARS - 1].ljust(SHORT_CHARS, "a")
        head = " ".join(word(rng.randint(1, 4)) for _ in range(4)) + " " + rng.choice(["", "the ", "my ", "new "]) + rng.choice([*KEY_WORDS, "Authorization: Bearer", "credentials", "passphrase", "API key"]) + rng.choice([" ", ": ", "=", " -> ", ' "', " is ", " of "])
        findings.append((f"{head}{body}{rng.choice(['', '.', ',', chr(34)])} {word(3)}", len(head), len(head) + len(body)))
        labels.append(label)
    return findings, np.array(labels, float)


def train(findings: list[tuple[str, int, int]], labels: np.ndarray, rounds: int = 6, least_recall: float = LEAST_RECALL) -> Network:
    """Adam on the logistic loss over the first three quarters; the threshold comes from the rest."""
    rng = np.random.default_rng(5)
    views = [view(*f) for f in findings]
    x, s = one_hot(views), summary(views)
    net = Network(rng.normal(0, 0.3, (CLASSES * KERNEL, CHANNELS)).astype(np.float32), np.zeros(CHANNELS, np.float32), rng.normal(0, 0.1, 2 * CHANNELS + 4).astype(np.float32), 0.0)
    params = [net.kernel, net.kernel_bias, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    cut, step = len(views) * 3 // 4, 0
    for _ in range(rounds):
        order = rng.permutation(cut)
        for i in range(0, cut, 64):
            rows = order[i : i + 64]
            net.bias = float(params[3][0])
            patches, h = net.hidden(x[rows])
            p = net.pooled(h, s[rows])
            error = (1 / (1 + np.exp(-(p @ net.weights + net.bias))) - labels[rows]) / len(rows)
            back = error[:, None] * net.weights
            dh = np.repeat(back[:, None, CHANNELS : 2 * CHANNELS] / h.shape[1], h.shape[1], 1)
            best = h.argmax(1)
            np.add.at(dh, (np.arange(len(rows))[:, None], best, np.arange(CHANNELS)), back[:, :CHANNELS])
            dh *= h > 0
            grads = [np.tensordot(patches, dh, ([0, 1], [0, 1])), dh.sum((0, 1)), p.T @ error, np.array([error.sum()])]
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.bias = float(params[3][0])
    held = np.sort(net.score(views[cut:])[labels[cut:] == 1])
    net.threshold = float(held[int((1 - least_recall) * len(held))]) if len(held) else 0.5
    return net


@functools.lru_cache(maxsize=1)
def network() -> Network:
    """The default network; a process trains it once, from fixed seeds, in a few seconds."""
    net = train(*labelled_findings(2400))
    net.short = train(*short_findings(2400))
    return net


def covered(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, as disjoint stretches in order."""
    starts, ends = [], []
    for a, _, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def uncovered(a: int, b: int, starts: list[int], ends: list[int], text: str) -> list[tuple[int, int]]:
    """What the stretches leave of [a, b), without the marks that join it to them."""
    out, at = [], a
    first, last = bisect_right(ends, a), bisect_left(starts, b)
    for s, e in [*zip(starts[first:last], ends[first:last]), (b, b)]:
        lo, hi = at, min(s, b)
        while lo > a and lo < hi and text[lo] in JOINTS:
            lo += 1
        while hi < b and lo < hi and text[hi - 1] in JOINTS:
            hi -= 1
        if hi - lo >= SHORT_CHARS:
            out.append((lo, hi))
        at = max(at, e)
    return out


def looks(text: str, run: tuple[int, int], a: int, b: int) -> list[tuple[str, bool, int, int]]:
    """(view, whether it is short, start, end to report) of all that the networks judge of a candidate [a, b).

    The whole of it (its first BODY characters); windows over a long one, reported up to the next separators;
    its parts between separators.
    """
    out = []
    if b - a >= CANDIDATE_CHARS:
        out.append((view(text, a, b) if (a, b) == run else inner_view(text, run, a, b), False, a, b))
    elif after_key_word(text, a):
        out.append((view(text, a, b), True, a, b))
    if b - a > BODY:
        for s in [*range(a + STEP, b - BODY, STEP), b - BODY]:
            lo, hi = s, s + BODY
            while lo > a and text[lo - 1] not in "/.=":
                lo -= 1
            while hi < b and text[hi] not in "/.=":
                hi += 1
            out.append((inner_view(text, run, s, s + BODY), False, lo, hi))
    parts = {(a + m.start(), a + m.end()) for cut in (COARSE, FINE) for m in cut.finditer(text[a:b])} - {(a, b)}
    for s, e in sorted(parts):
        if e - s >= CANDIDATE_CHARS:
            out.append((inner_view(text, run, s, e), False, s, e))
        elif e - s >= SHORT_CHARS and text[s - 1 : s] == "=" and after_key_word(text, s):
            out.append((view(text, s, e), True, s, e))
    return out


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, sorted; candidates are judged without what a pattern covers."""
    spans: list[list[tuple[int, int, int]]] = []
    views: tuple[list[str], list[str]] = ([], [])
    owners: tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]] = ([], [])
    for i, text in enumerate(texts):
        found = base_spans(text)
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        for a, b in runs:
            if b - a >= 32:
                found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(text[a:b])]
        stretches = covered(found)
        for run in runs:
            for a, b in uncovered(*run, *stretches, text):
                for seen, short, s, e in looks(text, run, a, b):
                    views[short].append(seen)
                    owners[short].append((i, s, e))
        spans.append(found)
    flagged: dict[int, list[tuple[int, int]]] = {}
    for judge, seen, owner in zip((net, net.short or net), views, owners):
        for (i, a, b), p in zip(owner, judge.score(seen)):
            if p >= judge.threshold:
                flagged.setdefault(i, []).append((a, b))
    for i, parts in flagged.items():
        joined: list[list[int]] = []
        for a, b in sorted(parts):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        spans[i] += [(a, 3, b) for a, b in joined]
    return [sorted(s) for s in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind.  Null and empty texts have
    none.  Repeated rows give repeated results; an empty table gives no rows.
    """
    net = net or network()

    def run(ids, texts):
        found = find(texts, net)
        base = [[x for x in spans if x[1] < 3] for spans in found]
        count = lambda k: [sum(x[1] == k for x in spans) for spans in base]
        return {
            id_col: ids, "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
            "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written(x) for x in found],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, id_col, text_col, run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network | None = None, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with every span replaced by ``mask``; overlapping spans count as one.

    Null texts stay null; repeated rows stay repeated; an empty table gives no rows, and columns of any name
    stay as they are.
    """
    net = net or network()

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def clean(rows: pa.RecordBatch, texts: list[str], at: int) -> pa.RecordBatch:
        nulls = rows.column(at).is_null().to_pylist()
        out = pa.array([None if n else masked(t, s) for n, t, s in zip(nulls, texts, find(texts, net))], rows.schema.field(at).type)
        return pa.RecordBatch.from_arrays([out if i == at else rows.column(i) for i in range(rows.num_columns)], schema=rows.schema)

    return map_rows(docs, text_col, clean)
