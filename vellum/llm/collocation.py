"""Collocations: phrases of two to four words that score as one, by hierarchical pair naming.

A frequent word gets a number, and the places of a text become numbers.  Then, level by
level, each pair of adjacent (k-1)-gram numbers (they overlap in k - 2 words) is counted
over the whole corpus, and the frequent pairs get numbers, which replace the places'.  A
k-gram's number names its two (k-1)-grams: these parents lead to the parts of every cut and
to the phrases that a longer one may swallow.

Scale: texts are worked on in blocks of some ``BLOCK`` characters.  A block tells each distinct
pair once, with its count; pairs meet by the hash of both numbers in buckets, of which there
are as many as the corpus has ``BUCKET`` words, and travel as packed arrays, one for a block
and bucket.  A bucket counts, names the frequent pairs, and tells each block which of its pairs
these are; the places of the next level follow.  Nothing goes through the driver or is broadcast
by this module; a hot word or pair has one entry a block, and a language's best come from
salted parts of its candidates.

Defined cases: a null text is empty, a null language is ``und``; texts without words and
empty tables give nothing; equal rows count each; further columns are not read.  A text longer
than a block is a block of its own.  Counts of phrases that overlap themselves count every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import dropped, partitions, saved

LEAST = 30  #: occurrences of a candidate
LONGEST = 4  #: words of the longest candidate
SWALLOWED = 80  #: per cent of a phrase's occurrences that lie in a longer one
SCALE = 2_000_000
FIRST = 2000  #: phrases told for each language
BLOCK = 8 << 20  #: characters of text worked on at once
SALT = 32  #: parts in which a language's best are sought
CODES = 26  #: bits of a code within its block (a block of 8 MB has some 1.5 million words)
BLOCKS = 12  #: bits of a block's number within its task
BUCKET = 1 << 20  #: words of the corpus for each bucket of pairs; a bucket's pairs are counted at once
BITS = 40  #: bits of a pair's number within its bucket

#: Bytes of a word, the one blank, and the mark between pieces.
_SPLITTERS = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(_SPLITTERS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _planes(a: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: high bytes are nearly all alike and take no room."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _numbers(raw: memoryview, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(_planes(np.ascontiguousarray(a)) for a in arrays), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return _numbers(memoryview(zstandard.decompress(data)), kind)


def _packed_pairs(left: np.ndarray, right: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    """Rising codes are told by their gaps."""
    return _packed(left, right, counts.astype(np.int32), np.diff(codes, prepend=0).astype(np.int32))


def _unpacked_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lefts, rights, counts and codes."""
    raw = memoryview(zstandard.decompress(data))
    n = len(raw) // 24
    ends = [0, 8 * n, 16 * n, 20 * n, 24 * n]
    left, right, counts, gaps = (_numbers(raw[a:b], kind) for a, b, kind in zip(ends[:-1], ends[1:], (np.int64, np.int64, np.int32, np.int32), strict=True))
    return left, right, counts, np.cumsum(gaps, dtype=np.int64).astype(np.int32)


def words(data: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The words of lower-cased UTF-8 bytes in order, and whether a piece begins with each."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _CLASS[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    marks = np.concatenate(([0], np.cumsum(kind == 2)))[starts]
    first = np.diff(marks, prepend=-1) != 0
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside])), first


def _coded(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Places (codes, -1 where a piece ends), distinct words by falling count, and the counts."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    found, first = words(data)
    coded = found.dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    places = np.full(len(codes) + int(first.sum()), -1, np.int32)
    places[np.arange(len(codes)) + np.cumsum(first)] = rank[codes]
    return places, coded.dictionary.take(pa.array(order)), counts[order]


_LEVEL_1 = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("code", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("bucket", pa.int64()), ("pairs", pa.binary())])
_COUNTED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())])
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _rows(schema: pa.Schema, size: int, **columns) -> pa.Table:
    """A table of ``size`` rows; what is not given is null, single values are repeated."""
    out = []
    for f in schema:
        v = columns.get(f.name)
        if v is None:
            out.append(pa.nulls(size, f.type))
        elif isinstance(v, (np.ndarray, list, pa.Array)):
            out.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
        else:
            out.append(pa.repeat(pa.scalar(v, f.type), size))
    return pa.table(out, schema=schema)


def _blocks(limit: int):
    """Blocks of (lang, text) rows, closed beyond ``limit`` characters: their places, and each distinct word with its count."""

    def told(held: dict[str, list[str]], number: int) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            places, known, counts = _coded(texts)
            if len(known):
                yield from _rows(_LEVEL_1, 1, kind=0, block=number, places=_packed(places)).to_batches()
                yield from _rows(_LEVEL_1, len(known), kind=1, block=number, code=np.arange(len(known)), lang=lang, word=known, n=counts).to_batches(1 << 16)
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << BLOCKS
        held: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size and size + len(text) > limit:
                    yield from told(held, number)
                    number += len(held)
                    held, size = {}, 0
                    pa.default_memory_pool().release_unused()  # a worker lives on; what it does not need goes back
                held.setdefault(lang, []).append(text)
                size += len(text)
        if number + len(held) - first > 1 << BLOCKS:
            raise ValueError("a task has too many blocks of text; use smaller file splits")
        yield from told(held, number)

    return run


def _renamed(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places by the index of their code in ``codes``; -1 where it is not there."""
    lookup = np.full(max(int(places.max(initial=0)), int(codes.max(initial=0))) + 2, -1, np.int64)  # the last one answers for -1
    lookup[codes] = np.arange(len(codes))
    return lookup[places]


def _adjacent(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of adjacent grams by rising numbers, (left, right, count), and the places by the pair that begins there."""
    size = int(places.max(initial=0)) + 1
    at = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
    pairs, where, counts = np.unique(places[at] * size + places[at + 1], return_inverse=True, return_counts=True)
    out = np.full(len(places), -1, np.int64)
    out[at] = where
    return pairs // size, pairs % size, counts, out


def _known(named: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and names of a block's frequent grams, by rising codes."""
    if "codes" in named.column_names:
        codes = np.concatenate([_unpacked(c, np.int32) for c in named.column("codes").to_pylist()])
        ids = np.concatenate([_unpacked(c, np.int64) for c in named.column("ids").to_pylist()])
    else:
        codes, ids = named.column("code").to_numpy(), named.column("id").to_numpy()
    order = np.argsort(codes)
    return codes[order], ids[order]


def _pairing(buckets: int, level: int):
    """A block's next level: its places by frequent (level - 1)-grams, and the distinct adjacent pairs of these, by buckets."""

    def run(key, before, named):
        if not before.num_rows or not named.num_rows:
            return _rows(_PAIRS, 0)
        places = _unpacked(before.column("places")[0].as_py(), np.int32)
        if level > 2:  # the places tell (level - 2)-grams
            places = _adjacent(places.astype(np.int64))[3]
        codes, ids = _known(named)
        places = _renamed(places, codes)
        left, right, counts, _ = _adjacent(places)
        if not len(left):
            return _rows(_PAIRS, 0)
        if len(left) >> 31:
            raise ValueError(f"a block has {len(left)} distinct pairs")
        left, right = ids[left], ids[right]
        bucket = (_mixed(_mixed(left) + right.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        starts = np.concatenate(([0], ends))[:-1]
        told = [_packed_pairs(left[i], right[i], counts[i], i) for a, b in zip(starts, ends, strict=True) for i in (order[a:b],)]
        block = key[0].as_py()
        pa.default_memory_pool().release_unused()
        pairs = _rows(_PAIRS, len(told), kind=1, block=block, bucket=bucket[order[starts]], pairs=told)
        return pa.concat_tables([_rows(_PAIRS, 1, kind=0, block=block, places=_packed(places.astype(np.int32))), pairs])

    return run


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _counting(least: int):
    """A bucket's frequent pairs: their names and counts, and for each block the codes that they have there."""

    def run(key, rows):
        parts = [_unpacked_pairs(p) for p in rows.column("pairs").to_pylist()]
        left, right, counts, codes = (np.concatenate(c) for c in zip(*parts, strict=True))
        blocks = np.repeat(rows.column("block").to_numpy(), [len(p[0]) for p in parts])
        pa.default_memory_pool().release_unused()
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.flatnonzero((np.diff(left, prepend=left[0] - 1) != 0) | (np.diff(right, prepend=right[0] - 1) != 0))
        f = np.add.reduceat(counts[order].astype(np.int64), new)
        name = np.where(f >= least, np.cumsum(f >= least) - 1, -1)
        first = np.int64(key[0].as_py()) << np.int64(BITS)
        frequent = np.flatnonzero(name >= 0)
        names = _rows(_COUNTED, len(frequent), kind=1, id=first + name[frequent], left=left[new[frequent]], right=right[new[frequent]], f=f[frequent])
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(name, np.diff(new, append=len(order)))
        held = np.flatnonzero(each >= 0)
        held = held[np.argsort(blocks[held], kind="stable")]
        ends = np.flatnonzero(np.diff(blocks[held], append=-1)) + 1
        starts = np.concatenate(([0], ends))[:-1]
        cells = [held[a:b] for a, b in zip(starts, ends, strict=True)]
        told = _rows(_COUNTED, len(cells), kind=0, block=[int(blocks[c[0]]) for c in cells], codes=[_packed(codes[c]) for c in cells], ids=[_packed(first + each[c]) for c in cells])
        return pa.concat_tables([told, names])

    return run


def _key() -> Column:
    return F.shiftleft("block", CODES).bitwiseOR(F.col("code"))


def _named_words(level: DataFrame, least: int) -> DataFrame:
    """(block, code, id, f, lang, word) of the words that stand ``least`` times or more in their language."""
    same = Window.partitionBy("lang", "word")
    rows = level.where("kind = 1").select("block", "code", "lang", "word", F.sum("n").over(same).alias("f"), F.min(_key()).over(same).alias("id"))
    return saved(rows.where(F.col("f") >= least), "names")


def grams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", block: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words of a language, and for each length the frequent phrases.

    A phrase: id, lang, phrase, last (word), f, heads and tails (occurrences of its first and
    last 1, 2, ... words), and from two words on left and right, the ids of its parents.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.where(F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    level = saved(rows.mapInArrow(_blocks(block), _ddl(_LEVEL_1)), "words", by="kind")
    totals = saved(level.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(partitions(docs.sparkSession), (totals.agg(F.sum("n")).first()[0] or 0) // bucket)
    named = _named_words(level, least)
    none = F.array().cast("array<long>")
    words_found = named.where(F.col("id") == _key()).select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))
    named = named.select("block", "code", "id")
    found = [words_found]
    for k in range(2, longest + 1):
        before = level
        pairs = before.where("kind = 0").select("block", "places").groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_pairing(buckets, k), _ddl(_PAIRS))
        level = saved(pairs, f"pairs{k}", by="kind")
        dropped(before)
        counted = saved(level.where("kind = 1").select("bucket", "block", "pairs").groupBy("bucket").applyInArrow(_counting(least), _ddl(_COUNTED)), f"counted{k}", by="kind")
        dropped(level, "kind=1")
        named = counted.where("kind = 0").select("block", "codes", "ids")
        a, b = (found[-1].select(F.col("id").alias(side), F.struct("*").alias(f"_{side}")) for side in ("left", "right"))
        phrases = counted.where("kind = 1").join(a, "left").join(b, "right").select(
            "id", F.col("_left.lang").alias("lang"), F.concat_ws(" ", "_left.phrase", "_right.last").alias("phrase"), F.col("_right.last").alias("last"), "f",
            F.concat("_left.heads", F.array("_left.f")).alias("heads"), F.concat("_right.tails", F.array("_right.f")).alias("tails"), "left", "right",
        )
        found.append(saved(phrases, f"phrases{k}"))
    dropped(level)
    return totals, found


def _score(a: Column, parts: Column, scale: int) -> Column:
    """Whole part of scale * a / parts; the product may pass 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), parts.cast("decimal(20,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, swallowed: int = SWALLOWED, scale: int = SCALE, first: int = FIRST, **more) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of each language; ``more`` goes to ``grams``."""
    totals, found = grams(docs, least, longest, **more)
    scored = []
    for k in range(2, longest + 1):
        rows = found[k - 1]
        cuts = [F.struct(_score(F.col("f"), F.get("heads", F.lit(i - 1)) + F.get("tails", F.lit(k - i - 1)), scale).alias("score"), F.lit(i).alias("k"), F.get("heads", F.lit(i - 1)).alias("l"), F.get("tails", F.lit(k - i - 1)).alias("r")) for i in range(1, k)]
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        if k < longest:
            # Of all longer phrases around one, a direct child stands most often.
            child = found[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("within"))
            rows = rows.join(child, "id", "left").where(F.col("within").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("within") < F.lit(swallowed).cast("decimal(3,0)") * F.col("f")))
        scored.append(rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = reduce(DataFrame.unionByName, scored)
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame) -> DataFrame:
    return collocations(docs)
