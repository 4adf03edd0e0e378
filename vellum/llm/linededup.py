"""Line deduplication by winnowing over line hashes.

The non-blank lines of a text are hashed.  A *window* opens at every line and closes at
the first line with which it holds ``MIN_WORDS`` words, so what a window holds depends
on its lines alone.  Winnowing takes from every window the line of least hash as its
fingerprint: two places that share a run of ``MIN_WORDS`` words or more share a whole
window, and so its fingerprint.  What is kept of a text are its fingerprint positions, each
with the lines about it (all that its windows hold and less than ``MIN_WORDS`` words after
them); a line that is no window's minimum has no row.  Positions are joined by their
fingerprint, and those that stand in one place only go.  From the others matches grow
both ways, line by line: to the left over the windows that open before the fingerprint,
to the right over the rest of the window and what follows it.  The windows with the same
lines (by 128 bits) find their first place in the corpus, and where first and later places
part, the first place of the run with each number of the lines that follow is found.
Lines of later places are deleted, those of the first stay.

Order of the corpus: doc_id (null first), then a hash of the text, then the line.

Scale: the texts are read once for the positions and once for the deletion.  First places
are minima, combined before the shuffle; windows meet their first place in a join whose
hot keys Spark may split.  A document's deletions are joined back by id and text hash.

Defined cases: a null text stays null and has no lines; an empty one stays empty; blank
lines are not compared and stay; lines are compared without white space at their ends;
rows equal in id and text are one place and keep the same lines; a text all of whose
lines are deleted becomes empty or keeps its blank lines; further columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import saved

MIN_WORDS = 30
BROADCAST = 10_000  #: deletions that may be broadcast; beyond, texts are dealt by id and hash


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lines_of(text: bytes) -> tuple[list[int], list[bytes], list[int]]:
    """(number in the text, 128-bit hash, words) of each non-blank line."""
    at, hashes, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip():
            at.append(i)
            hashes.append(hashlib.blake2b(line, digest_size=16).digest())
            words.append(len(line.split()))
    return at, hashes, words


def windows(hashes: list[bytes], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(first line, last line + 1, line of the fingerprint) of each window."""
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    ends = np.searchsorted(total, np.array(total[:-1]) + least).tolist()
    out = []
    for i, j in enumerate(ends):
        if j > len(hashes):
            break
        part = hashes[i:j]
        out.append((i, j, j - 1 - part[::-1].index(min(part))))
    return out


POSITIONS = "doc long, row long, fp long, at int, first int, lines binary, words array<int>"


def _positions(least: int):
    """The fingerprint positions of each text: ``lines`` are the hashes from line ``first`` on to the last that its windows may grow to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                out: list[list] = [[] for _ in range(7)]
                for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    _, hashes, words = lines_of(text)
                    spans: dict[int, list[int]] = {}
                    for i, j, p in windows(hashes, words, least):
                        spans.setdefault(p, [i, j])[1] = j
                    for p, (i, j) in spans.items():
                        k, held = j, 0  # what follows a run's last window holds less than ``least`` words
                        while k < len(words) and held + words[k] < least:
                            held += words[k]
                            k += 1
                        fp = _signed(int.from_bytes(hashes[p][:8], "little"))
                        for x, v in zip(out, (doc, row, fp, p, i, b"".join(hashes[i:k]), words[i:k]), strict=True):
                            x.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc", "row", "fp", "at", "first", "lines", "words"])

    return run


WINDOWS = "doc long, row long, line int, size int, run binary, tail array<binary>"


def _grown(least: int):
    """From each position: the windows that hold its line as their fingerprint, with a hash of all their lines and the lines that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                out: list[list] = [[] for _ in range(6)]
                part = b.slice(start, 512)
                for doc, row, at, first, lines, words in zip(*(part.column(c).to_pylist() for c in ("doc", "row", "at", "first", "lines", "words")), strict=True):
                    hashes = [lines[i : i + 16] for i in range(0, len(lines), 16)]
                    for i, j, p in windows(hashes, words, least):
                        if p + first != at:
                            continue
                        k, held = j, 0
                        while k < len(words) and held + words[k] < least:
                            held += words[k]
                            k += 1
                        digest = hashlib.blake2b(lines[16 * i : 16 * j], digest_size=16).digest()
                        for x, v in zip(out, (doc, row, i + first, j - i, digest, hashes[j:k]), strict=True):
                            x.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc", "row", "line", "size", "run", "tail"])

    return run


def _row(text: str) -> Column:
    return F.xxhash64(F.col(text))


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, line, end): lines, counted without blank ones, that stand earlier too; ``row`` is the text's hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _row(text_col).alias("row"), F.col(text_col).alias("text"))
    found = saved(rows.mapInArrow(_positions(min_words), POSITIONS), "line-positions")
    place = F.struct("doc", "row", "at")
    repeated = found.groupBy("fp").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("not (one <=> other)").select("fp")
    met = found.join(repeated, "fp", "left_semi")
    again = saved(met.mapInArrow(_grown(min_words), WINDOWS), "line-again")
    first = again.groupBy("run").agg(F.min(F.struct("doc", "row", "line", "tail")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.zip_with("tail", "first.tail", lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, False).cast("int")
    end = F.col("line") + F.col("size")
    later = (
        again.join(first, "run")
        .where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line"))))
        .select("doc", "row", "line", "run", (end + F.when(stop > 0, stop - 1).otherwise(F.size(same))).alias("end"), (stop > 0).alias("parts"))
    )
    later = saved(later, "line-later")
    # Where the first place goes on otherwise, any other earlier one may go on alike: first places of each prefix of the tail.
    parted = saved(later.where("parts").select("run").distinct(), "line-parted")
    prefix = again.join(parted, "run", "left_semi").where(F.size("tail") > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("tail"))))
    prefix = prefix.select("doc", "row", "line", "size", "k", F.struct("run", F.slice("tail", F.lit(1), F.col("k")).alias("next")).alias("key"))
    one = F.struct("doc", "row", "line")
    ahead = prefix.groupBy("key").agg(F.min(one).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    longer = prefix.join(ahead, "key").where(~one.eqNullSafe(F.col("first"))).groupBy("doc", "row", "line").agg(F.max(end + F.col("k")).alias("end"))
    return later.select("doc", "row", "line", "end").unionByName(longer)


def without(text: str, cuts) -> tuple[str, list[int]]:
    """The text without the cut lines, and their numbers in it."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").strip()]
    gone = sorted({full[k] for c in cuts for k in range(c["line"], min(c["end"], len(full)))})
    drop = set(gone)
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), gone


def _without(text: pd.Series, cuts: pd.Series) -> pd.DataFrame:
    new = [without(t, c) if c is not None and t is not None else (t, []) for t, c in zip(text, cuts, strict=True)]
    return pd.DataFrame(new, columns=["text", "deleted"])


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, new): each row of ``docs`` as a struct, and a struct of its new text and the deleted lines' numbers."""
    runs = saved(later_runs(docs, min_words, id_col, text_col), "line-runs")
    cuts = runs.groupBy("doc", "row").agg(F.collect_set(F.struct("line", "end")).alias("cuts"))  # of one document
    cuts = F.broadcast(cuts) if runs.count() <= BROADCAST else cuts
    rows = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("id_"), _row(text_col).alias("hash_"), F.col(text_col).alias("text_"))
    joined = rows.join(cuts, F.col("id_").eqNullSafe(F.col("doc")) & (F.col("hash_") == F.col("row")), "left")
    cut = F.pandas_udf(_without, "struct<text: string, deleted: array<int>>")
    return joined.select(F.col("row_").alias("row"), cut("text_", "cuts").alias("new"))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (numbers of lines from 0), text (what is left) of each document."""
    return deduplicated(docs.select("doc_id", "text")).select(
        "row.doc_id",
        F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("new.deleted").cast("long").alias("n_deleted"),
        "new.deleted",
        "new.text",
    )
