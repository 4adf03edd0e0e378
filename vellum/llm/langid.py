"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit for each, and the bits
common to an n-gram's slots are the languages that contain it.  A text is decided by
the count of its n-grams that each language contains, corrected for the filter's
known rate of false positives: (count - n * rate) / (1 - rate).

N-grams are runs of 1 to 4 lower-cased letters of a word, a space standing for its
ends.  A language contains those that at least ``MIN_SHARE`` of its training texts
hold and that are not ``RATIO`` times rarer than in another language.

Fitted on a bounded sample (``PER_LANGUAGE`` rows of each language, by a hash of id and text);
the filter has a fixed size for every 8 languages, however many n-grams they have.  Prediction is one pass without a shuffle.

Defined cases: null text, or a text without letters: ``und``, score 0.  Letters but
no known n-gram: the language with most training rows, score 0.  No training rows at
all: ``und``.  Repeated rows count as often as they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import crc32_mod

SIZES = (1, 2, 3, 4)
SLOTS = 1 << 20
PER_LANGUAGE = 2000
MIN_SHARE, RATIO = 0.02, 4.0
CHUNK = 1 << 19  #: code points worked on at once
_M = 0x9E3779B97F4A7C15


@functools.cache
def _letters() -> np.ndarray:
    """Code point to itself for letters, to a space for all else; above the basic plane code points stay."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, each text opened by a space, and each one's text."""
    parts = [" " + t.lower() for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    low = codes < 0x10000
    codes = np.where(low, _letters()[np.where(low, codes, 0)], codes)
    if not low.all():
        high = np.flatnonzero(~low)
        codes[high[[not chr(c).isalpha() for c in codes[high]]]] = 32
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    return codes[keep], doc[keep]


def grams(codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of all n-grams, for each n."""
    wide = np.append(codes, np.uint32(32)).astype(np.uint64)
    space = wide == 32
    h = np.zeros(len(codes), np.uint64)
    good = np.ones(len(codes), bool)
    for n in range(1, SIZES[-1] + 1):
        m = len(codes) + 1 - n if n > 1 else len(codes)
        if m <= 0:
            return
        h = h[:m] * np.uint64(_M) + wide[n - 1 : n - 1 + m]
        if n > 2:  # no space inside
            good = good[:m] & ~space[n - 2 : n - 2 + m]
        if n in SIZES:
            at = np.flatnonzero(good[:m] & ~(space[:m] & space[n - 1 : n - 1 + m]) if n < 3 else good[:m])  # no gram is spaces alone
            x = (h[at] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            yield x ^ (x >> np.uint64(29)), doc[at]


@dataclass
class Filter:
    languages: list[str]  #: by falling number of training rows
    slots: np.ndarray  #: (bytes of languages, SLOTS), a bit for each language
    rates: np.ndarray  #: of false positives, by language

    def masks(self, hashes: np.ndarray, byte: int) -> np.ndarray:
        a = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        b = ((hashes >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)
        return self.slots[byte][a] & self.slots[byte][b]

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (its share of the corrected counts) and coverage (its share of the n-grams)."""
        n, count = len(texts), len(self.languages)
        hits, total = np.zeros((n, count)), np.zeros(n)
        codes, doc = letter_codes(texts)
        bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
        for hashes, of in grams(codes, doc):
            total += np.bincount(of, minlength=n)
            for byte in range(len(self.slots)):
                seen = np.bincount(of.astype(np.int64) * 256 + self.masks(hashes, byte), minlength=n * 256).reshape(n, 256) @ bits
                hits[:, byte * 8 : byte * 8 + 8] += seen[:, : min(8, count - byte * 8)]
        true = np.maximum(0, (hits - total[:, None] * self.rates) / (1 - self.rates)) if count else hits
        top = true.argmax(axis=1) if count else np.zeros(n, int)
        at = true[np.arange(n), top] if count else np.zeros(n)
        score = np.divide(at, true.sum(axis=1), out=np.zeros(n), where=at > 0)
        cover = np.divide(at, total, out=np.zeros(n), where=total > 0)
        return [self.languages[t] if count and m else "und" for t, m in zip(top, total, strict=True)], score, np.minimum(1, cover)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, texts): in how many of a batch's texts of a language each n-gram stands."""
    for b in batches:
        texts: dict[str, list[str]] = {}
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(t)
        for lang, of in texts.items():
            seen = []
            for t in of:
                found = [h for i in range(0, len(t), CHUNK) for h, _ in grams(*letter_codes([t[i : i + CHUNK]]))]
                if found:
                    seen.append(np.unique(np.concatenate(found)))
            if seen:
                gram, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram)), "gram": gram.view(np.int64), "texts": n.astype(np.int64)})


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Filter:
    """The filter of the languages of the rows where ``learn`` holds."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filter([], np.zeros((1, SLOTS), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counts = taken.groupBy("lang").agg(F.count("*").alias("of"))
    held = taken.select("lang", "text").mapInArrow(_counted, "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("n"))
    rate = held.join(F.broadcast(counts), "lang").select("lang", "gram", (F.col("n") / F.col("of")).alias("rate")).where(F.col("rate") >= MIN_SHARE / RATIO)
    best = rate.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    kept = best.select("gram", "best", F.explode("by").alias("x")).where((F.col("x.rate") >= MIN_SHARE) & (F.col("x.rate") * RATIO >= F.col("best")))
    # The filter is filled where the n-grams lie: what comes to the driver is at most SLOTS rows for every 8 languages.
    order = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    places = kept.select(F.element_at(order, F.col("x.lang")).alias("i"), F.explode(F.array(F.col("gram"), F.shiftrightunsigned("gram", 32))).alias("h"))
    byte = F.floor(F.col("i") / 8).cast("int").alias("byte")
    bits = places.groupBy(byte, F.col("h").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("i") % 8).cast("int"))).alias("bits")).toArrow()
    slots = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
    slots[bits["byte"].to_numpy(), bits["slot"].to_numpy()] = bits["bits"].to_numpy()
    fill = np.array([((slots[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return Filter(languages, slots, fill**2)


def predict(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score, coverage."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bytes for every 8 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            langs, scores, covers = [], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and j - i < 512 and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                lang, score, cover = held.value.decide(texts[i:j])
                langs += lang
                scores.append(score)
                covers.append(cover)
                i = j
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64()), pa.array(np.concatenate(covers or [[]]), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*keep, "lang_pred", "score", "coverage"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double, coverage double")


def identified(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """(row, found): each row of ``docs`` as a struct, and lang_pred, score and coverage as another."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        parts, i = [([], np.zeros(0), np.zeros(0))], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and j - i < 512 and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            parts.append(held.value.decide(texts[i:j]))
            i = j
        langs, scores, covers = zip(*parts, strict=True)
        return pd.DataFrame({"lang_pred": [x for part in langs for x in part], "score": np.concatenate(scores), "coverage": np.concatenate(covers)})

    found = F.pandas_udf(run, "struct<lang_pred: string, score: double, coverage: double>")
    return docs.select(F.struct("*").alias("row"), found(F.col(text_col)).alias("found"))


def op2(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs, F.coalesce(crc32_mod("doc_id", 4) != 2, F.lit(True)))
    out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score", "coverage")
