"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, windows.

Texts are sets of word shingles under the Jaccard distance, a metric.  Sets of long
texts are almost all at distance 1 from one another, so regions about whole documents
would hold everything; a *region* is therefore what the sets around one rare shingle
share.  All shingles stand in one order, rare before common: linked sets of n and m
shingles have so many in common that the first common one is among the first
n - ceil(t n) + 1 and m - ceil(t m) + 1 of theirs, so every link is found in a region,
without loss.  How common a shingle is comes from a table of ``COUNTERS`` counts over all
sets (fixed in size; the order may be any, a good one only keeps regions small, so
passages that many texts share make no regions of their own).

A document's counts of shingles in ``WIDTH`` hash buckets are its place in a space whose
L1 distance never exceeds the size of the two sets' difference.  There, regions are
joined by pivots: each member belongs to the Voronoi cell of its nearest pivot and is
copied to each cell that the triangle inequality does not rule out (its distance there
within twice its radius of that to its own pivot); cells are split again until they are
small, or cut into tiles where pivots no longer tell members apart.  Members that may be linked form families, and families (split the same way if
they are large) are joined exactly, on full sets.  What a task gives back is a spanning
forest of its links and each set's number of links, so copies of copies do not become
all pairs.  Components follow from the forests.

Equal sets are one class throughout and count with their number.  Sets and classes are
known by 64-bit hashes.

Defined cases: null text, or a text without words: no shingles, linked with nothing, a
component of its own.  Fewer words than a shingle has: the whole sequence is the only
one.  Repeated rows are linked copies (if they have words).  A null id takes part, and
is the component's id only if all its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import raw_texts
from vellum.llm.common import partitions, saved
from vellum.llm.graph import components

WORDS, PERCENT = 3, 90
WIDTH = 512  #: buckets of a place; at a similarity of 0.8 they tell sets of up to some 25 WIDTH shingles apart
COUNTERS, BLOCKS = 20, 32  #: binary logarithm of the number of counts (more for larger corpora: a passage stands out if it is in more texts than a count has by chance); rows that carry them
REGION, BLOCK = 16384, 2048  #: members of a region, of a family, that one task joins
SHINGLES = 4_000_000  #: of the families that one task joins at once
PIVOTS, SPLITS, COPIES = 16, 3, 3
BROADCAST = 1_000_000  #: ids that may be broadcast
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_B) & (1 << 64) - 1)


class Words(dict):
    """Word to its 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 250_000 and len(word) <= 64:
            self[word] = h
        return h


def shingles(text: bytes, hashes: Words, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    found = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(w):
        return w
    h = np.zeros(max(1, len(w) - words + 1), np.uint64)
    for k in range(min(words, len(w))):
        h = h * _A + mixed(w[k : k + len(h)] + _times(k))
    if len(w) < words:
        h += np.uint64(len(w)) * _C
    return np.unique(mixed(h))


def prefix(n: int, percent: int) -> int:
    """How many of a set's n shingles, in the common order, meet one of each linked set's."""
    return n - -(-percent * n // 100) + 1


def counter(of_hash: np.ndarray) -> np.ndarray:
    """Each shingle's place in the table of counts."""
    return (mixed(of_hash + _B) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def rarest(of_hash: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of one set: the rarest shingles by their class of count, then by hash."""
    take = prefix(len(of_hash), percent)
    return of_hash[np.lexsort((of_hash, common[counter(of_hash)]))[:take]]


def places(of_hash: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Counts of shingles by hash bucket, a row for each document."""
    at = doc * WIDTH + (mixed(of_hash + _A) >> np.uint64(65 - WIDTH.bit_length())).astype(np.int64)
    return np.bincount(at, minlength=n * WIDTH).reshape(n, WIDTH).clip(max=255).astype(np.uint8)  # cut counts are no further apart


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) * _A + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class Seen(set):
    """Keys met in this task, up to a fixed number; a key may be new again beyond it."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self._most = most

    def new(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) < self._most:
            self.add(key)
        return True


def _read(words: int, percent: int):
    """kind 0: (a = doc_id, b = set); 2: (b = set, place); 3: (a = block of the table, counts); n: size of the set."""

    def rows(kind: int, a, b, n, place=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(b), kind, np.int32)), "a": a, "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int32()), "place": place if place is not None else pa.nulls(len(b), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, counts, waiting, held = Words(), Seen(), np.zeros(1 << COUNTERS, np.uint32), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, hashes, words) for t in raw_texts(part.column(1))]
                keys = [_set_key(s) for s in sets]
                yield rows(0, part.column(0), keys, [len(s) for s in sets])
                new = [i for i, k in enumerate(keys) if len(sets[i]) and seen.new(k)]
                if not new:
                    continue
                size = np.array([len(sets[i]) for i in new])
                h, doc = np.concatenate([sets[i] for i in new]), np.repeat(np.arange(len(new)), size)
                yield rows(2, pa.nulls(len(new), pa.int64()), np.array([keys[i] for i in new], np.int64), size, pa.array([p.tobytes() for p in places(h, doc, len(new))], pa.binary()))
                waiting.append(counter(h).astype(np.int32))
                held += len(h)
                if held > 2_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
                    waiting, held = [], 0
        if held:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32)
        if len(seen):
            blocks = counts.clip(max=65535).astype(np.uint16).reshape(BLOCKS, -1)
            yield rows(3, pa.array(np.arange(BLOCKS)), np.zeros(BLOCKS, np.int64), np.zeros(BLOCKS, np.int32), pa.array([c.tobytes() for c in blocks], pa.binary()))

    return run


def _added(kind: type):
    """Rows (a, counts) of a task, added up block by block; counts come as ``kind`` and go as uint32, cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(counts.as_buffer(), kind).astype(np.uint64)
                total[block] = total[block] + new if block in total else new
        yield pa.RecordBatch.from_pydict({"a": pa.array(list(total), pa.int64()), "counts": pa.array([c.clip(max=(1 << 32) - 1).astype(np.uint32).tobytes() for c in total.values()], pa.binary())})

    return run


def how_common(read: DataFrame) -> np.ndarray:
    """The class (binary logarithm) of each count of the table: 2 ** COUNTERS bytes, whatever the corpus."""
    schema = "a long, counts binary"
    blocks = read.where("kind = 3").select("a", F.col("place").alias("counts"))
    # First where the rows lie, then block by block: a task holds BLOCKS arrays at most.
    summed = blocks.mapInArrow(_added(np.uint16), schema).repartition(BLOCKS, "a").mapInArrow(_added(np.uint32), schema)
    out = np.zeros((BLOCKS, (1 << COUNTERS) // BLOCKS), np.uint8)
    for row in summed.collect():
        out[row["a"]] = np.frexp(np.frombuffer(row["counts"], np.uint32).astype(np.float64))[1]
    return out.ravel()


def _signed(words: int, percent: int, table):
    """(a = shingle, b = set, n) for each shingle of each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, common = Words(), Seen(), table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s for t in raw_texts(batch.slice(at, 256).column(0)) if len(s := shingles(t, hashes, words))]
                sets = [(k, s) for s in sets if seen.new(k := _set_key(s))]
                if not sets:
                    continue
                first = [rarest(s, common, percent) for _, s in sets]
                times = [len(f) for f in first]
                key, n = np.array([k for k, _ in sets], np.int64), np.array([len(s) for _, s in sets], np.int32)
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(first).view(np.int64)), "b": pa.array(np.repeat(key, times)), "n": pa.array(np.repeat(n, times))})

    return run


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield [c.to_numpy() for c in batch.columns]


def _shared(percent: int):
    """Of rows (a, b, n) sorted so: those with another set about the same shingle whose size allows a link.

    A region ``g`` is known by its members, so that regions of the same members are one.
    """

    def kept(seen: Seen, a: np.ndarray, b: np.ndarray, n: np.ndarray, whole: bool) -> pa.RecordBatch:
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, n = a[first], b[first], n[first].astype(np.int64)
        near = (a[1:] == a[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = np.zeros(len(a), bool)
        keep[1:] |= near
        keep[:-1] |= near
        begins = np.append(True, ~near)[keep]  # a step in size that no link spans parts a region
        a, b = a[keep], b[keep]
        if whole and len(a):
            start = np.flatnonzero(begins)
            size = np.diff(np.append(start, len(a)))
            with np.errstate(over="ignore"):
                region = mixed(np.add.reduceat(mixed(b.view(np.uint64)), start) * _A + size.astype(np.uint64)).view(np.int64)
            new = np.repeat([seen.new(r) for r in region.tolist()], size)
            a, b = np.repeat(region, size)[new], b[new]
        return pa.RecordBatch.from_pydict({"g": pa.array(a, pa.int64()), "key": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows wait for their neighbours; of a shingle that fills batch after batch the last
        # row is enough, and its region goes by the shingle's name.
        seen, cut = Seen(), None
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for batch in chain(arrays(batches), [None]):
            if batch is not None:
                held = [np.concatenate(x) for x in zip(held, batch, strict=True)]
            a, b, n = held
            if not len(a):
                continue
            if cut is not None and (batch is None or a[0] == cut):
                end = int(np.searchsorted(-(a == cut).astype(np.int8), 0))
                yield kept(seen, a[:end], b[:end], n[:end], False)
                if end == len(a):
                    held = [x[-1:] for x in held]
                    continue
                a, b, n = a[end:], b[end:], n[end:]
            cut = None
            last = len(a) if batch is None else int(np.searchsorted(-(a != a[-1]).astype(np.int8), 0))
            if last:
                yield kept(seen, a[:last], b[:last], n[:last], True)
            held = [a[last:], b[last:], n[last:]]
            if len(held[0]) > 1_000_000:
                yield kept(seen, *held, False)
                cut, held = held[0][-1], [x[-1:] for x in held]

    return run


def radius(n: np.ndarray, percent: int) -> np.ndarray:
    """Greatest difference between a set of n and a set linked with it."""
    return n * (100 - percent) / percent


def _reached(part: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(nearest pivot, all pivots whose cells must see the row) of each row."""
    x = np.frombuffer(b"".join(part.column("place").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int32)
    reach = 2 * radius(part.column("n").to_numpy(), percent) + 1e-6
    for i, pivots in enumerate(part.column("pivots").to_pylist()):
        d = np.abs(np.frombuffer(b"".join(pivots), np.uint8).reshape(-1, WIDTH).astype(np.int32) - x[i]).sum(axis=1)
        yield int(d.argmin()), np.flatnonzero(d <= d.min() + reach[i])


def _split(percent: int):
    """Gives each row (g, key, n, place, cells, homes, pivots) to the cells that it must be seen in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, cell, home = [], [], []
                for i, (own, into) in enumerate(_reached(part, percent)):
                    take += [i] * len(into)
                    cell += into.tolist()
                    home += [own] * len(into)
                rows = part.take(pa.array(take, pa.int64()))
                add = lambda name, new: pa.array([[*old, v] for old, v in zip(rows.column(name).to_pylist(), new, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("g"), rows.column("key"), rows.column("n"), rows.column("place"), add("cells", cell), add("homes", home)], names=["g", "key", "n", "place", "cells", "homes"])

    return run


def _spread(percent: int):
    """(g, cells, times): by how much a split would multiply each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = [len(into) for _, into in _reached(batch, percent)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("cells"), pa.array(times, pa.int64())], names=["g", "cells", "times"])

    return run


KEPT = ["g", "key", "n", "place", "cells", "homes"]
CELL = ["g", "cells", "tile"]


def tiled(large: DataFrame, most: int) -> DataFrame:
    """Cells of ``_k`` members cut into blocks by hash; block i meets block j in tile (i, j), i <= j."""
    blocks = F.ceil(F.col("_k") / F.lit(most // 2)).cast("int")
    rows = large.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    side = lambda other: F.when(other == F.col("_own"), -1).when(F.col("_own") < other, 0).otherwise(1)
    tile = lambda other: F.least(other, F.col("_own")) * F.col("_blocks") + F.greatest(other, F.col("_own"))
    at = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(tile(o).alias("tile"), side(o).alias("side")))
    return rows.select(*KEPT, F.explode(at).alias("_t")).select(*KEPT, "_t.tile", "_t.side")


def split_large(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """Groups ``g`` of rows (g, key, n, place), cut into cells of ``most`` members or so.

    Adds ``cells`` (the cell's path), ``homes`` (the path of the cells that the member belongs
    to), ``tile`` and ``side``.  A cell whose members lie so close that a split would copy
    each to ``COPIES`` cells or more, and one that is large after ``SPLITS`` splits, is cut
    into tiles instead: pairs of blocks, each compared with the other.
    """
    whole = (F.lit(-1).alias("tile"), F.lit(-1).alias("side"))
    rows = rows.select("g", "key", "n", "place", F.array().cast("array<int>").alias("cells"), F.array().cast("array<int>").alias("homes"))
    parts = []
    for turn in range(SPLITS + 1):
        sizes = rows.groupBy("g", "cells").agg(F.count("*").alias("_k"))
        big = saved(sizes.where(F.col("_k") > most), "large-cells")
        few = big.count()
        if not few:
            return _union([*parts, rows.select(*KEPT, *whole)])
        sized = rows.join(F.broadcast(big) if few < 10_000 else big, ["g", "cells"], "left")
        parts.append(sized.where("_k is null").select(*KEPT, *whole))
        large = sized.where("_k is not null")
        if turn == SPLITS:
            break
        large = saved(large, "large")
        salt = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(PIVOTS))
        picked = large.groupBy("g", "cells", salt.alias("_s")).agg(F.min_by("place", F.xxhash64("key", F.lit(turn + 100))).alias("p"))
        pivots = picked.groupBy("g", "cells").agg(F.array_sort(F.collect_list("p")).alias("pivots"))  # PIVOTS at most
        near = large.join(pivots, ["g", "cells"])
        spread = near.select("n", "place", "g", "cells", "pivots").mapInArrow(_spread(percent), "g long, cells array<int>, times long")
        dense = saved(spread.groupBy("g", "cells").agg(F.avg("times").alias("_t")).where(F.col("_t") >= COPIES), "dense").select("g", "cells")
        parts.append(tiled(large.join(dense, ["g", "cells"], "left_semi"), most))
        schema = "g long, key long, n int, place binary, cells array<int>, homes array<int>"
        loose = near.join(dense, ["g", "cells"], "left_anti").select(*KEPT, "pivots")
        rows = saved(loose.mapInArrow(_split(percent), schema), "cells")
    return _union([*parts, tiled(large, most)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one group each; rows come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        marks = list(zip(*((tuple(x) if isinstance(x, list) else x for x in c) for c in columns), strict=True))
        start = 0
        for i, m in enumerate(marks):
            if m != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, m
        if start < len(marks):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def forest(size: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest; ``linked`` gives those of the nodes left (a mask) that a node is linked with."""
    left = np.ones(size, bool)
    a, b = [], []
    for root in range(size):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            if not left.any():
                break
            new = linked(i, left)
            left[new] = False
            a += [i] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _may_link(percent: int):
    """Forests of the pairs in each region that sizes and places allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        out_a: list[int] = []
        out_b: list[int] = []
        for t in grouped(batches, CELL):
            if t.num_rows < 2:
                continue
            key, n = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64)
            x = np.frombuffer(b"".join(t["place"].to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int16)
            side = t["side"].to_numpy()
            tile = bool(side.max() >= 0)

            def linked(i: int, left: np.ndarray) -> np.ndarray:
                could = np.flatnonzero(left & (100 * n >= percent * n[i]) & (percent * n <= 100 * n[i]) & (side != side[i] if tile else True))  # noqa: B023
                d = np.abs(x[could] - x[i]).sum(axis=1)  # noqa: B023
                return could[d * (100 + percent) <= (n[i] + n[could]) * (100 - percent) + 1e-3]  # noqa: B023

            for i, j in zip(*forest(len(key), linked), strict=True):
                pair = (int(key[i]), int(key[j]))
                if pair not in seen:
                    if len(seen) < 500_000:
                        seen.add(pair)
                    out_a.append(pair[0])
                    out_b.append(pair[1])
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
                out_a, out_b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: rare shingles pair by pair, frequent ones by products."""
    k = len(sets)
    if k == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    h, doc = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.diff(np.append(starts, len(h)))
    out = np.zeros((k, k), np.float32)
    for c in np.unique(count[(count > 1) & (count <= 12)]):
        rows = doc[starts[count == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        out += np.bincount((rows[:, i] * k + rows[:, j]).ravel(), minlength=k * k).reshape(k, k)
    out += out.T
    heavy = np.flatnonzero(count > 12)
    for at in range(0, len(heavy), 4096):
        some = heavy[at : at + 4096]
        x = np.zeros((k, len(some)), np.float32)
        col = np.repeat(np.arange(len(some)), count[some])
        row = doc[np.repeat(starts[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())]
        x[row, col] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _linked(percent: int):
    """Rows (a, b, null): a forest of a cell's links; (a, null, links): a set's links counted in this cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, CELL):
            _, once = np.unique(t["key"].to_numpy(), return_index=True)  # a row that stands twice gave its set twice
            k = len(once)
            if k < 2:
                continue
            t = t.take(pa.array(once)) if k < t.num_rows else t
            key, copies, side = t["key"].to_numpy(), t["copies"].to_numpy(), t["side"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            same = common(sets)
            ok = 100 * same >= percent * (n[:, None] + n[None, :] - same)
            np.fill_diagonal(ok, False)
            if side.max() >= 0:
                ok &= side[:, None] != side[None, :]
            a, b = forest(k, lambda i, left: np.flatnonzero(ok[i] & left))  # noqa: B023
            # A pair that meets in several cells counts in the least of its members' homes.
            cells = t["cells"][0].as_py()
            if cells:
                homes = np.array(t["homes"].to_pylist())
                for level, cell in enumerate(cells):
                    ok &= np.minimum(homes[:, None, level], homes[None, :, level]) == cell
            links = ok @ copies
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(np.concatenate((key[a], key[at])), pa.int64()),
                    "b": pa.concat_arrays([pa.array(key[b], pa.int64()), pa.nulls(len(at), pa.int64())]),
                    "links": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(links[at], pa.int64())]),
                }
            )

    return run


def _with_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, hashes, words) for t in raw_texts(part.column(1))]
                good = [i for i, (s, k) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if _set_key(s) == k]
                yield pa.RecordBatch.from_pydict({"key": part.column(0).take(pa.array(good, pa.int64())), "shingles": pa.array([sets[i].tobytes() for i in good], pa.binary())})

    return run


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of ``docs``."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    read = saved(texts.mapInArrow(_read(words, percent), "kind int, a long, b long, n int, place binary"), "jaccard-read", by="kind")

    rows = read.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    known = read.where("kind = 2").groupBy(F.col("b").alias("key")).agg(F.first("n").alias("n"), F.first("place").alias("place"))

    table = spark.sparkContext.broadcast(how_common(read))
    signed = texts.select("_text").mapInArrow(_signed(words, percent, table), "a long, b long, n int").repartition(parts, "a").sortWithinPartitions("a", "n", "b")
    shared = saved(signed.mapInArrow(_shared(percent), "g long, key long").distinct(), "jaccard-shared")
    regions = split_large(shared.join(known, "key"), region, percent)
    met = regions.repartition(parts, *CELL).sortWithinPartitions(*CELL).mapInArrow(_may_link(percent), "a long, b long")
    families = saved(components(met).select(F.col("node").alias("key"), F.col("label").alias("g")), "jaccard-families")

    members = saved(families.join(known, "key").join(classes, "key"), "jaccard-members")
    # A family of long sets is split sooner, so that a task's shingles are bounded.
    mean = members.groupBy("g").agg(F.sum("n").alias("_all"), F.count("*").alias("_k")).where(F.col("_all") > SHINGLES).agg(F.max(F.col("_all") / F.col("_k"))).first()[0]
    size = block if mean is None else max(16, min(block, int(SHINGLES / mean)))
    cells = split_large(members.select("g", "key", "n", "place"), size, percent).drop("place", "n")
    cells = saved(cells.join(members.select("key", "copies"), "key"), "jaccard-cells")
    # Sets are read from their texts once more and go straight to their cells: nothing else holds them.
    few = F.broadcast if cells.count() <= BROADCAST // 4 else lambda df: df
    wanted = few(members.select("key", "first"))
    sets = texts.join(wanted, F.col("_id").eqNullSafe(F.col("first"))).select("key", "_text").mapInArrow(_with_sets(words), "key long, shingles binary")
    joined = sets.join(few(cells), "key")
    found = saved(joined.repartition(parts, *CELL).sortWithinPartitions(*CELL).mapInArrow(_linked(percent), "a long, b long, links long"), "jaccard-links")

    labels = saved(components(found.where("b is not null").select("a", "b")), "jaccard-labels")
    links = found.where("links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = labels.join(classes, labels["node"] == classes["key"]).groupBy("label").agg(F.min("first").alias("root"))
    near = labels.join(roots, "label").select(F.col("node").alias("key"), "root")
    of_class = saved(classes.join(near, "key", "left").join(links, "key", "left").select("key", F.coalesce("root", "first").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-classes")
    return rows.join(of_class, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def first_of_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that are linked with one of a lesser id, directly or by others.

    Of rows equal in id and text one stays.  Rows with a null id stay unless such a
    copy is there: nothing can name them.  Rows without words stay.
    """
    found = saved(join(docs, words, percent, id_col, text_col).select("doc_id", "component_id", "n_shingles"), "jaccard-found")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    kept = docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    # Ids that stand in several rows that stay, each a copy of the other perhaps.
    firsts = found.where("(doc_id <=> component_id) and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"))
    firsts = saved(firsts, "jaccard-again")
    if firsts.isEmpty():
        return kept
    again = firsts if firsts.count() > BROADCAST else F.broadcast(firsts)
    same = kept[id_col].cast("long").eqNullSafe(again["_again"])
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def op10(docs: DataFrame) -> DataFrame:
    return join(docs)
