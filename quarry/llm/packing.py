"""Best-fit packing by bin completion, on the histogram of piece lengths.

Sequences are interchangeable, so a packing is a list of fillings (lengths that share a sequence) with the
number of times each is used.  That list depends on the histogram alone, which has at most ``capacity``
entries whatever the corpus; the pieces themselves stay distributed and find their place by their rank among
the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, stage_table
from quarry.llm.tokens import encoder

#: Nodes that the search may visit over a whole packing, and in looking for the fillings of one sequence; fillings
#: that it branches over at a step.  None lifts a limit: the packing is then the best there is, whatever it takes.
SEARCH_NODES = 100_000
FILLING_NODES = 4000
BRANCHES = 8

#: Lengths that share a sequence: (length, pieces of it), longest first.
Runs = tuple[tuple[int, int], ...]


@dataclass
class Packing:
    """Fillings with the number of sequences that have each, and a bound that no packing of these lengths is under."""

    capacity: int
    fillings: list[tuple[Runs, int]] = field(default_factory=list)
    least: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)

    @property
    def gap(self) -> int:
        """Sequences that a better packing could save at most; 0: this one is optimal."""
        return self.sequences - self.least


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For each length k: pieces over half a sequence have one each, and those of k and more that are no longer
    than half fill what room the ones up to capacity - k leave, before they need sequences of their own.
    """
    number = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        number[length] += n
    upto, total = np.cumsum(number), np.cumsum(number * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    large = upto[capacity - k] - upto[half]
    room = large * capacity - (total[capacity - k] - total[half])
    below = np.concatenate([[0], total])[k]
    more = -(-(total[half] - below - room) // capacity)
    return int(upto[capacity] - upto[half] + max(0, more.max()))


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing: each piece, longest first, goes where it leaves least room.  Equal sequences move together."""
    groups: dict[int, list[tuple[Runs, int]]] = {}
    rooms: list[int] = []

    def put(room: int, runs: Runs, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((runs, n))

    for length in sorted(counts, reverse=True):
        left, filled = counts[length], []
        at = bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            runs, n = groups[room].pop()
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            filled += [(room - each * length, (*runs, (length, each)), full), (room - rest * length, (*runs, (length, rest)), 1)][: 1 + (rest > 0)]
            left -= full * each + rest
            if n - full - (rest > 0):
                groups[room].append((runs, n - full - (rest > 0)))
            if not groups[room]:
                del groups[room], rooms[at]
        for group in filled:
            put(*group)
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    return Packing(capacity, [g for room in rooms for g in groups[room]])


def spread(sums: int, length: int, n: int) -> int:
    """A bitmap of sums, each with up to ``n`` times a length added."""
    step = 1
    while n > 0:
        step = min(step, n)
        sums |= sums << length * step
        n, step = n - step, 2 * step
    return sums


def dominated(runs: Runs, waste: int, spare: int) -> bool:
    """Whether a filling with some of its pieces (or none) replaced by one spare piece, no smaller than they are, still fits.

    Such a filling can take this one's place in any packing.  ``spare`` is a bitmap of the lengths left over.
    Bitmaps of sums cover all subsets: of any size with a larger piece in their place, of two and more pieces
    with one of their very sum.
    """
    every, one, several = 1, 0, 0
    for length, n in runs:
        several = spread(several, length, n) | spread(one << length, length, n - 1) | (spread(1 << 2 * length, length, n - 2) if n > 1 else 0)
        one |= 1 << length
        every = spread(every, length, n)
    larger, width = every << 1 if waste else 0, 1
    while width < waste:
        step = min(width, waste - width)
        larger, width = larger | larger << step, width + step
    return bool((larger | several) & spare)


def completions(sizes: list[int], have: list[int], room: int, slack: int, most: int | None, nodes: int | None) -> tuple[list[tuple[int, Runs]], int]:
    """Undominated fillings of ``room`` that waste no more than ``slack``, least waste first, and the nodes visited.

    Runs of equal pieces are taken in descending order of length, on a stack of our own: a filling may have as
    many pieces as ``room``.  A branch is cut when even all the pieces left for it leave more waste than allowed, or
    than the worst one of ``most`` fillings kept.
    """
    reach = [0, *accumulate(x * n for x, n in zip(sizes, have))]
    spare = sum(1 << x for x, n in zip(sizes, have) if n)
    found: list[tuple[int, int, Runs]] = []
    #: Runs taken so far, as [index of the length, pieces of it, room before them].
    runs: list[list[int]] = []
    visited, limit = 0, len(sizes) - 1

    def most_waste() -> int:
        return found[-1][0] - 1 if most is not None and len(found) >= most else slack

    def record(waste: int) -> None:
        out = tuple((sizes[i], k) for i, k, _ in runs)
        unused = spare
        for i, k, _ in runs:
            if have[i] == k:
                unused ^= 1 << sizes[i]
        if waste <= most_waste() and not dominated(out, waste, unused):
            insort(found, (waste, len(found), out))
            if most is not None:
                del found[most:]

    while True:
        visited += 1
        at = min(limit, bisect_right(sizes, room) - 1)
        while at >= 0 and not have[at]:
            at -= 1
        if room == 0 or at < 0:
            record(room)
            if most_waste() < 0:
                break
        elif room - reach[at + 1] <= most_waste():
            runs.append([at, min(have[at], room // sizes[at]), room])
            room, limit = room - runs[-1][1] * sizes[at], at - 1
            continue
        if nodes is not None and visited >= nodes:
            break
        while runs:
            i, k, room = runs[-1]
            if k > 1:
                runs[-1][1] = k - 1
                room -= (k - 1) * sizes[i]
            else:
                runs.pop()
            limit = i - 1
            if room - reach[i] <= most_waste():
                break
        else:
            break
    return [(waste, out) for waste, _, out in found], visited


def pack(counts: dict[int, int], capacity: int, nodes: int | None = SEARCH_NODES, filling_nodes: int | None = FILLING_NODES, branches: int | None = BRANCHES) -> Packing:
    """The fillings that pack pieces of these lengths (1..capacity) into as few sequences as the search finds.

    Bin completion by branch and bound.  Best-fit decreasing is the first incumbent.  While it needs more
    sequences than the lower bound, the search completes a sequence around the longest piece left, branches
    over its undominated fillings (used as often as the pieces allow, or once), and goes back as soon as the
    waste so far, or the lower bound of what is left, shows that no packing better than the incumbent follows.
    ``nodes``, ``filling_nodes`` and ``branches`` bound the work; the result tells its gap to the lower bound.
    """
    counts = {int(l): int(n) for l, n in counts.items() if n}
    best = best_fit(counts, capacity)
    best.least = least = lower_bound(counts, capacity)
    total = sum(l * n for l, n in counts.items())
    left, lengths = dict(counts), sorted(counts)
    #: Steps taken: the choices not tried yet, and the filling in use with its times and waste.
    steps: list[tuple[list[tuple[Runs, int, int]], tuple[Runs, int, int] | None]] = []
    waste = used = visited = 0

    def choices() -> list[tuple[Runs, int, int]]:
        """Fillings around the longest piece with their times and waste, the one to try first last."""
        nonlocal visited
        slack = (best.sequences - 1) * capacity - total - waste
        if slack < 0 or used + lower_bound(left, capacity) >= best.sequences:
            return []
        longest = lengths[-1]
        left[longest] -= 1
        found, seen = completions(lengths, [left[x] for x in lengths], capacity - longest, slack, branches, filling_nodes)
        left[longest] += 1
        visited += seen
        often, once = [], []
        for lost, runs in found:
            whole = ((longest, 1 + runs[0][1]), *runs[1:]) if runs and runs[0][0] == longest else ((longest, 1), *runs)
            times = min(left[l] // n for l, n in whole)
            times = min(times, slack // lost) if lost else times
            often.append((whole, times, lost))
            if times > 1:
                once.append((whole, 1, lost))
        return (often + once)[::-1]

    def take(runs: Runs, times: int, sign: int) -> None:
        for l, n in runs:
            if not left[l]:
                insort(lengths, l)
            left[l] -= sign * n * times
            if not left[l]:
                lengths.remove(l)

    if best.sequences > least:
        steps.append((choices(), None))
    while steps and best.sequences > least and (nodes is None or visited < nodes):
        untried, now = steps.pop()
        if now:
            take(now[0], now[1], -1)
            waste, used = waste - now[1] * now[2], used - now[1]
        if not untried:
            continue
        now = untried.pop()
        steps.append((untried, now))
        take(now[0], now[1], 1)
        waste, used = waste + now[1] * now[2], used + now[1]
        if lengths:
            steps.append((choices(), None))
        elif used < best.sequences:
            best = Packing(capacity, [(runs, times) for _, (runs, times, _) in steps], least)
    return best


def places(packing: Packing) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: arrays (first rank, first sequence, uses in a sequence, offset of the first), by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for runs, times in packing.fillings:
        offset = 0
        for length, k in runs:
            out.setdefault(length, []).append((taken.get(length, 0), sequence, k, offset))
            taken[length] = taken.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {l: tuple(np.array(c, np.int64) for c in zip(*rows)) for l, rows in out.items()}


def token_pieces(docs: DataFrame, vocab_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids, as a table in the shared folder.

    Columns: id_col, piece, start, length, ids_crc32, and part and rank: the piece is number ``rank`` of its
    length in the scan partition ``part``.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", "part", "rank"]

    def run(batches):
        part, lib = TaskContext.get().partitionId(), encoder(vocab_path)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, stops = lib.encode(batch.column(1))
            ids = memoryview(np.insert(ids.astype("<u4"), stops, end_id).tobytes())
            ends = stops + np.arange(1, len(stops) + 1)
            sizes = np.diff(ends, prepend=0)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            at = (ends - sizes)[owner] + start
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            # The rank of a piece: those of its length in earlier batches, and before it in this one.
            order = np.argsort(length, kind="stable")
            run_of = np.searchsorted(length[order], length[order], "left")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - run_of
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            numbers = [piece.astype(np.int32), start, length, np.array(crcs, np.int64), np.full(len(owner), part), rank]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *map(pa.array, numbers)], names=[id_col, *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(run, f"{id_col} {kind}, piece int, " + ", ".join(f"{n} long" for n in names[1:])), "pieces")


def assign(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Give every piece its sequence and offset.

    The rank of a piece among all of its length is its rank in its part plus the pieces of that length in the
    parts before: a window over one small row for each part and length.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage_table(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = places(pack(histogram, capacity))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                rows = order[a:b]
                n = int(length[rows[0]])
                first, start, uses, at = table[n]
                f = np.searchsorted(first, rank[rows], "right") - 1
                step, slot = np.divmod(rank[rows] - first[f], uses[f])
                sequence[rows], offset[rows] = start[f] + step, at[f] + slot * n
            columns = [batch.column(k) for k in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = pieces.schema[id_col].dataType.simpleString()
    # Counts grow with the corpus (a row for each length and part), so they are merged, never broadcast.
    ranked = pieces.hint("merge").join(counts.select("length", "part", "before").hint("merge"), ["length", "part"]).select(*names[:5], (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, f"{id_col} {kind}, piece int, " + ", ".join(f"{n} long" for n in names[2:]))


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents (ids, then end_id) into as few sequences of ``capacity`` ids as the search finds.

    Only documents longer than a sequence are cut.  Null and empty texts are the end id alone; repeated rows
    are packed once each; an empty table gives no rows.  Columns: id_col, piece, start, length, ids_crc32,
    sequence_id, offset.
    """
    return assign(token_pieces(docs, vocab_path, end_id, capacity, id_col, text_col), capacity, id_col)
