"""Packing pieces of documents into sequences by patterns of lengths.

A pattern is a few lengths that fill a sequence, or nearly.  Patterns are enumerated
from the histogram of piece lengths, their repeat counts are fitted to the histogram
by non-negative least squares, rounded by largest remainders and laid out (most pieces
below the capacity), and the rest is packed by best fit into the room that patterns leave
and into new sequences, still on counts of lengths.  What comes out is a list of slots for each
length (a table whose size depends on the capacity, not on the corpus); the n-th piece
of a length takes the n-th slot of that length.

Scale: the texts are read once, to yield (doc_id, piece, start, length, crc).  The
driver sees the histogram only.  Pieces are numbered within a length by block counts
and ranks inside a block, so that a length which a third of the pieces share is spread
over all tasks.

Defined cases: a null text is empty and gives the one piece of the closing id; a
document whose ids fill pieces exactly gets no further piece; null ids are ids as any
other; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.bpe import ROWS, VOCABULARY, memo, raw_texts
from vellum.llm.common import partitions, saved

CAPACITY, CLOSE = 4096, 1
WORDS = 1_000_000  #: whose ids a worker remembers, 0.2 GB
LAID = 0.8  #: part of the fit that is laid out; the rest leaves pieces of all lengths to fill what rounding leaves
TRIPLES = 12  #: further lengths tried with each length


def cut(docs: DataFrame, capacity: int = CAPACITY, close: int = CLOSE, vocabulary: str = VOCABULARY, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document; a worker remembers the ids of ``words`` words."""
    end = np.array([close], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = memo(vocabulary, words)
        for b in (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS)):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for i, ids in zip(b.column(0).to_pylist(), own.of(raw_texts(b.column(1))), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for key, x in zip(out, (i, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[key].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=list(out))

    return docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Combinations of up to six present lengths (falling) that fill ``capacity``, or as nearly as a present length allows."""
    present = np.flatnonzero(histogram[: capacity + 1])
    present = present[present > 0]
    best = np.zeros(capacity + 1, int)  # greatest present length up to here
    best[present] = present
    best = np.maximum.accumulate(best)
    common = np.sort(present[np.argsort(-histogram[present], kind="stable")[:TRIPLES]])[::-1]
    out: set[tuple[int, ...]] = set()

    def closed(lengths: tuple[int, ...]) -> None:
        rest = capacity - sum(lengths)
        last = best[rest] if rest > 0 else 0
        out.add(tuple(sorted((*lengths, int(last)) if last else lengths, reverse=True)))

    for a in map(int, present[::-1]):
        closed((a,))
        spread = present[present <= capacity - a]
        some = spread[np.linspace(0, len(spread) - 1, min(len(spread), TRIPLES)).astype(int)] if len(spread) else []
        for b in sorted({*map(int, some), *(int(c) for c in common if c <= capacity - a)}):
            closed((a, b))
            for k in (2, 3, 4):  # equal parts of what is left
                if c := int(best[(capacity - a - b) // k]):
                    closed((a, b, *(c,) * (k - 1)))
        if (n := capacity // a) > 1:
            closed((a,) * min(n, 3))
    return sorted(out, reverse=True)


def non_negative_fit(rows: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """x >= 0 of least |A x - h|^2, A the lengths' counts in each pattern, by multiplicative steps from a positive start."""
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    length = np.array(list(itertools.chain(*rows)), int)
    h = histogram.astype(float)

    def of_patterns(by_length: np.ndarray) -> np.ndarray:
        return np.bincount(which, by_length[length], minlength=len(rows))

    x = np.full(len(rows), max(1e-9, h.sum() / max(1, len(length))))
    target = of_patterns(h)
    for _ in range(steps):
        made = np.bincount(length, x[which], minlength=len(h))
        x *= target / np.maximum(of_patterns(made), 1e-12)
    return x


def rounded(rows: list[tuple[int, ...]], x: np.ndarray, histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Whole repeats of the patterns that fill a sequence: the fit's whole parts, then its largest remainders, as far as lengths are left."""
    left = histogram.astype(np.int64).copy()
    times = np.zeros(len(rows), np.int64)
    full = np.array([sum(r) == capacity for r in rows])

    def take(i: int, most: int) -> int:
        need = {n: rows[i].count(n) for n in rows[i]}
        found = min(most, *(int(left[n]) // c for n, c in need.items()))
        for n, c in need.items():
            left[n] -= c * found
        times[i] += found
        return found

    for i in np.flatnonzero(full)[np.argsort(-x[full], kind="stable")]:
        if x[i] >= 1:
            take(i, int(x[i]))
    rest = x - times
    goal = round(float(x.sum())) - int(times.sum())
    for i in np.flatnonzero(full)[np.argsort(-rest[full], kind="stable")]:
        if goal <= 0:
            break
        goal -= take(i, 1)
    return times


def fitted(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that the fit lays out; never more of a length than the histogram has."""
    rows = patterns(histogram, capacity)
    if not rows:
        return []
    times = rounded(rows, LAID * non_negative_fit(rows, histogram), histogram, capacity)
    return [(rows[i], int(times[i])) for i in np.flatnonzero(times)]


def layout(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold each length as often as the histogram says: the fitted patterns, and the rest by best fit."""
    laid = fitted(histogram, capacity)
    left = histogram.astype(np.int64).copy()
    for pattern, times in laid:
        for n in pattern:
            left[n] -= times
    return best_fit(left, capacity, laid)


def best_fit(left: np.ndarray, capacity: int, opened: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length on counts, into ``opened`` sequences and new ones; equal sequences are handled as one with a count."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for pattern, times in opened:
        _put(room, rooms, capacity - sum(pattern), pattern, times)
    for n in map(int, np.flatnonzero(left)[::-1]):
        todo = int(left[n])
        while todo:
            at = np.flatnonzero(rooms[n:])
            if not len(at):  # open as many as it takes, each filled with this length
                each = capacity // n
                for times, filled in ((todo // each, each), (1, todo % each)):
                    if times and filled:
                        _put(room, rooms, capacity - n * filled, (n,) * filled, times)
                todo = 0
                continue
            r = n + int(at[0])
            pattern, times = room[r].popitem()
            each = min(r // n, max(1, todo // times)) if todo >= times else 1
            used = min(times, todo // each) or 1
            if times > used:
                room[r][pattern] = times - used
            rooms[r] = bool(room[r])
            _put(room, rooms, r - n * each, (*pattern, *(n,) * each), used)
            todo -= used * each
    return [(p, c) for group in room.values() for p, c in group.items()]


def _put(room: dict[int, dict[tuple[int, ...], int]], rooms: np.ndarray, r: int, pattern: tuple[int, ...], times: int) -> None:
    room[r][pattern] = room[r].get(pattern, 0) + times
    rooms[r] = True


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs of slots, each run's first sequence, and its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in found:
        offset = 0
        for n in pattern:
            runs[n].append((taken[n], base, offset))
            taken[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """``rank`` from 0 of each row among those of its length, without a task that holds a length."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("rank", (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_part", "_start", "_in")
    )


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = rows.sparkSession
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # ``capacity`` rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(slots(layout(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, base, inside = table[int(length[at[0]])]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], inside[k]
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = ranked(rows, max(16, partitions(spark)))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3(docs: DataFrame, words: int = WORDS) -> DataFrame:
    return pack(saved(cut(docs, words=words), "packing-pieces"))
