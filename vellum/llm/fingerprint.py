"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its least s-mer (by hash) is its first or
last one.  Whether it is depends on the k-mer alone, so equal passages hold equal
anchors wherever they stand.  A fingerprint is the ``size`` least distinct anchor
hashes of a text, in rising order, as 12 hex digits each; likeness is the bottom-k
estimate of the anchor sets' Jaccard similarity.  ``anchors`` gives all anchors
with their places, for positional matching.

Scale: texts are dealt once, by ranges of ids, so that each text meets the head of
the next one; ranges come from quantiles of all ids and the first text of a range is
copied to the range before it.  Work is batched over many texts and long texts are
cut into overlapping pieces (anchors need no context), so memory is bounded.

Defined cases: a null text is empty; a text without anchors (shorter than k, or by
chance) has its whole-text hash as the only one; the empty text has the empty
fingerprint.  Likeness of two empty fingerprints is 1, of an empty and another 0.
Rows with equal ids follow each other by text; a null id stands first; one row alone
is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import partitions

K, S, SIZE = 18, 6, 64
PIECE = 1 << 20  #: code points worked on at once
_M = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers (K, S) of an array of code points."""
    if len(codes) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    one = codes.astype(np.uint64) + np.uint64(1)
    two = one[:-1] + one[1:] * _power(1)
    six = two[:-4] + two[2:-2] * _power(2) + two[4:] * _power(4)  # S = 6
    order = _mixed(six)
    width = K - S + 1
    m2 = np.minimum(order[:-1], order[1:])
    m4 = np.minimum(m2[:-2], m2[2:])
    m8 = np.minimum(m4[:-4], m4[4:])
    inner = np.minimum(m8[1 : 1 + len(order) - width + 1], m8[width - 9 : width - 9 + len(order) - width + 1])  # the s-mers 1 to width - 2
    edge = np.minimum(order[: len(order) - width + 1], order[width - 1 :])
    at = np.flatnonzero(edge <= inner)
    whole = six[at] + six[at + S] * _power(S) + six[at + 2 * S] * _power(2 * S)  # K = 3 S
    return at, _mixed(_mixed(whole))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of one text, long texts by overlapping pieces."""
    codes = _codes(text)
    parts = [(at + i, h) for i in range(0, max(1, len(codes)), PIECE) for at, h in [syncmers(codes[i : i + PIECE + K - 1])]]
    return np.concatenate([a for a, _ in parts]), np.concatenate([h for _, h in parts])


def _least(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) > 4 * size:
        few = np.unique(hashes[hashes < np.uint64(int(2.0**64 * 2 * size / len(hashes)))])
        if len(few) >= size:
            return few[:size]
    return np.unique(hashes)[:size]


def _sketch_of(text: str, hashes: np.ndarray, size: int) -> np.ndarray:
    """48-bit values, rising."""
    if not len(hashes):
        if not text:
            return np.empty(0, np.uint64)
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        hashes = np.frombuffer(digest, np.uint64)
    return _least(hashes, size) >> np.uint64(16)


def sketches(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The fingerprint's numbers of each text; short texts are worked on together."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        lengths = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(lengths)
        at, hashes = syncmers(_codes("".join(texts[i] for i in group)))
        doc = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[np.minimum(doc, len(ends) - 1)]
        doc, hashes = doc[inside], hashes[inside]
        bounds = np.searchsorted(doc, np.arange(len(group) + 1))
        for n, i in enumerate(group):
            out[i] = _sketch_of(texts[i], hashes[bounds[n] : bounds[n + 1]], size)

    for i, t in enumerate(texts):
        if len(t) > PIECE:
            out[i] = _sketch_of(t, text_anchors(t)[1], size)
            continue
        if held + len(t) > PIECE and group:
            flush()
            group, held = [], 0
        group.append(i)
        held += len(t)
    if group:
        flush()
    return out


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex(" ", 8).replace(" 0000", "")[4:] if len(sketch) else ""


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the sets behind two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    first = np.empty(len(both), bool)
    first[0] = True
    np.not_equal(both[1:], both[:-1], out=first[1:])
    at = np.flatnonzero(first)
    twice = np.append(~first[1:], False)[at]
    n = min(size, len(at))
    return float(twice[:n].sum()) / n


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position, anchor (hash) of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, h = text_anchors(t or "")
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(at), pa.int64()), "position": at, "anchor": h.view(np.int64)})

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, position long, anchor long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, extra, id, text), each bucket an id range closed by a copy of the next one's first text.

    The rows are dealt and sorted so that in a partition every row that is not ``extra``
    is followed by the next document in order.  The last range is closed by the first row.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce(F.col("id"), F.lit(-(2**63)))
    splits = sorted(set(rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []))
    # A value equal to a split opens the next range.
    bucket = F.size(F.filter(F.array(*[F.lit(s).cast("long") for s in splits]), lambda s: s <= order)) if splits else F.lit(0)
    heads = {r["bucket"]: r["head"] for r in rows.groupBy(bucket.alias("bucket")).agg(F.min(order).alias("head")).collect()}  # one a range
    there = sorted(heads)
    before = {heads[b]: there[i - 1] for i, b in enumerate(there)}
    place = F.struct(bucket.alias("bucket"), F.lit(0).alias("extra"))
    if before:
        pairs = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
        copy = F.struct(F.element_at(pairs, order).alias("bucket"), F.lit(1).alias("extra"))
        places = F.when(order.isin(list(before)), F.array(place, copy)).otherwise(F.array(place))
    else:
        places = F.array(place)
    return (
        rows.select(F.explode(places).alias("p"), "id", "text")
        .select("p.bucket", "p.extra", "id", "text")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_first(), "text")
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each text, of its edited text, and their likenesses; texts arrive in order."""
    carry: tuple | None = None  # the last row with its sketch, waiting for the next
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            rows = list(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True))
            marks = sketches([r[3] for r in rows])
            both = list(zip(rows, marks, strict=True))
            if carry is not None:
                both.insert(0, carry)
            pairs = [(a, b) for a, b in zip(both, both[1:], strict=False) if not a[0][1] and a[0][0] == b[0][0]]
            carry = both[-1]
            edited = []
            for (row, _), (after, _) in pairs:
                cut = len(row[3]) // 4
                edited.append(row[3][: len(row[3]) - cut] + after[3][:cut])
            new = sketches(edited)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[0][2] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[0][3]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                    "fingerprint": pa.array([as_text(a[1]) for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([as_text(x) for x in new], pa.string()),
                    "near_edited": pa.array([likeness(a[1], x) for (a, _), x in zip(pairs, new, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(a[1], b[1]) for a, b in pairs], pa.float64()),
                }
            )


def op1(docs: DataFrame) -> DataFrame:
    return with_next(docs).mapInArrow(
        _compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
