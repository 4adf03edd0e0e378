"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (3 to 6, with word
ends), a bag of words the mean of its words, and a softmax over two classes, linear in
that mean, says how toxic the bag is.  Vectors and softmax are trained jointly in numpy,
on windows of ``WIDTH`` words: the window of a toxic document that scores highest stands
for it, against the worst windows of clean ones.  A document's score is the softmax of the
bag of its ``TOP`` worst words, wherever they stand, so a few words in a long text count;
for such bags the softmax alone is fitted once more at the end, on texts that the vectors
have not seen.  Training words are misspelt now and then, so an unseen misspelling still meets
n-grams that carry the meaning.

Fitted on a bounded sample of labelled rows, ``POSITIVE`` + ``NEGATIVE`` of them in hash
order, and on the whole text of each: windows are chosen where the texts are, round by round, in
the first one by words that stand in more toxic texts than clean ones, then by the model, and
only windows reach the driver.  Scoring reads every whole text in one pass without a shuffle.
The model has a fixed size.

Defined cases: null text is empty; a text without words scores the model's base
probability; rows without label or with a null one are not learnt from; a label that
stands twice counts twice, of several texts of one id the least is learnt from; without
both labels every score is 0; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import crc32_mod, partitions, saved

BUCKETS, DIM, WIDTH, TOP = 1 << 17, 8, 8, 4
POSITIVE, NEGATIVE = 2500, 3500
OTHERS = 12  #: windows of a text, besides its worst, that a round of training gets
INDICATORS = 20_000  #: words that choose the windows of the first round
SEEN = 4  #: training texts in which an n-gram must stand to have a vector
BLOCK = 1 << 20  #: words scored at once
STEP = 20_000  #: words whose n-grams are worked out at once
_M = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _kept_characters() -> dict[int, None]:
    return {c: None for c in range(128) if not chr(c).isalnum()}


def cleaned(word: str) -> str:
    """The word without ASCII signs."""
    return word if word.isalnum() else word.translate(_kept_characters())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every cleaned word."""
    parts = [f"<{cleaned(w)}>" for w in words]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(p) for p in parts], np.int64)
    ends, word = np.cumsum(lengths), np.repeat(np.arange(len(words)), lengths)
    of, at, h = [], [], codes.copy()
    for n in range(2, 7):
        h = h[: len(codes) - n + 1] * _M + codes[n - 1 :] if len(codes) >= n else h[:0]
        if n > 2:
            start = np.arange(len(h))
            ok = np.flatnonzero(start + n <= ends[word[: len(h)]])
            x = (h[ok] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            of.append(word[ok])
            at.append(((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(of), np.concatenate(at)


def subwords_of(gram: str) -> int:
    """The bucket of one n-gram, by plain numbers."""
    h = 0
    for c in gram:
        h = (h * int(_M) + ord(c)) & (1 << 64) - 1
    x = (h + len(gram)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ (x >> 31)) % BUCKETS


def flat_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams, word after word, and how many each has), worked out in steps to save memory."""
    buckets, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for i in range(0, len(words), STEP):
        part = words[i : i + STEP]
        of, at = subwords(part)
        buckets.append(at[np.argsort(of, kind="stable")].astype(np.int32))
        counts.append(np.bincount(of, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(counts)


class Model:
    """What scoring needs: each bucket's vector already multiplied by the softmax's difference."""

    def __init__(self, gram: np.ndarray, offset: float):
        self.gram, self.offset = gram.astype(np.float32), offset

    def words(self, words: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(words), STEP):
            part = words[i : i + STEP]
            of, at = subwords(part)
            out.append(np.bincount(of, self.gram[at], minlength=len(part)) / np.maximum(1, np.bincount(of, minlength=len(part))))
        return np.concatenate(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        places = Places()
        docs = [np.fromiter(map(places.__getitem__, w), np.int64, len(w)) for w in (t.lower().split() for t in texts)]
        u = self.words(list(places)) if places else np.zeros(0)
        x = np.array([u[d][worst_words(u[d])].mean() if len(d) else 0.0 for d in docs])
        return 1 / (1 + np.exp(-np.clip(x + self.offset, -60, 60)))


class Places(dict):
    """A word's place in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def worst(u: np.ndarray) -> tuple[float, int]:
    """Greatest mean of WIDTH words in a row, and where it begins."""
    if len(u) <= WIDTH:
        return (float(u.mean()) if len(u) else 0.0), 0
    sums = np.cumsum(u)
    means = np.append(sums[WIDTH - 1], sums[WIDTH:] - sums[:-WIDTH]) / WIDTH
    at = int(means.argmax())
    return float(means[at]), at


def worst_words(u: np.ndarray) -> np.ndarray:
    """Places of the TOP greatest word scores."""
    return np.argpartition(-u, TOP)[:TOP] if len(u) > TOP else np.arange(len(u))


def misspelt(word: str, rng: np.random.Generator) -> str:
    i, kind = int(rng.integers(len(word))), int(rng.integers(4))
    letter = "abcdefghijklmnopqrstuvwxyz0134"[int(rng.integers(30))]
    return (word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :])[kind]


class Indicators:
    """Words that tell the two labels apart by the number of texts that hold them; the first choice of windows."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight

    def words(self, words: list[str]) -> np.ndarray:
        return np.array([self.weight.get(w, 0.0) for w in words])


class Learner:
    """Vectors and softmax, trained jointly by stochastic gradient (Adagrad) on windows of texts."""

    def __init__(self, live: np.ndarray, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.live = live.astype(float)
        self.vectors = self.rng.normal(0, 0.05, (BUCKETS, DIM)) * self.live[:, None]
        self.soft, self.bias = self.rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        self.squares = np.full((BUCKETS, 1), 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)

    def model(self) -> Model:
        return Model(self.vectors @ (self.soft[:, 1] - self.soft[:, 0]) * self.live, self.bias[1] - self.bias[0])

    def bags(self, words: list[str]) -> np.ndarray:
        """The mean vector of each word's n-grams."""
        out = np.zeros((len(words), DIM), np.float32)
        for i in range(0, len(words), STEP):
            of, at = subwords(words[i : i + STEP])
            n = len(words[i : i + STEP])
            sums = np.stack([np.bincount(of, (self.vectors[:, k] * self.live)[at], minlength=n) for k in range(DIM)], axis=1)
            out[i : i + STEP] = sums / np.maximum(1, np.bincount(of, minlength=n))[:, None]
        return out

    def learn(self, worst_of: list[list[str]], others_of: list[list[list[str]]], y: np.ndarray, steps: int = 350, batch: int = 256, rate: float = 0.5) -> None:
        """Steps over texts: each stands for itself by its worst window, a clean one half the time by another one."""
        rng, live = self.rng, self.live
        places = Places()

        def placed(w: list[str]) -> np.ndarray:
            return np.fromiter(map(places.__getitem__, w), np.int32, len(w))

        worst_at, others_at = [placed(w) for w in worst_of], [[placed(w) for w in o] for o in others_of]
        words = list(places)
        # Half as many misspellings again, each standing in for its word now and then.
        source = rng.choice(len(words), len(words) // 2)
        words += [misspelt(words[i], rng) for i in source]
        twin = np.full(len(words), -1)
        twin[source] = np.arange(len(places), len(words))
        at, count = flat_subwords(words)
        first = np.append(0, np.cumsum(count))

        def grams_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = count[w]
            row = np.repeat(np.arange(len(w)), n)
            return row, at[np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        def window(i: int) -> np.ndarray:
            other = others_at[i]
            w = (worst_at[i] if y[i] == 1 or not other or rng.random() < 0.5 else other[int(rng.integers(len(other)))]).copy()
            swap = (rng.random(len(w)) < 0.15) & (twin[w] >= 0)
            w[swap] = twin[w[swap]]
            return w

        yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        grad2, soft2, bias2 = self.squares
        for _ in range(steps):
            some = [*rng.choice(yes, batch // 2), *rng.choice(no, batch // 2)]
            win = [window(i) for i in some]
            target = y[some].astype(int)
            lengths = np.array([len(w) for w in win])
            row, g = grams_of(np.concatenate(win))
            weight = live[g] / np.repeat(np.maximum(1, count[np.concatenate(win)]), count[np.concatenate(win)])
            of_win = np.repeat(np.arange(len(win)), lengths)[row]
            weight = weight / lengths[of_win]
            x = np.stack([np.bincount(of_win, self.vectors[g, k] * weight, minlength=len(win)) for k in range(DIM)], axis=1)
            z = x @ self.soft + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(win)), target] -= 1
            p /= len(win)
            gx, gs, gb = p @ self.soft.T, x.T @ p + 1e-5 * self.soft, p.sum(axis=0)
            u, back = np.unique(g, return_inverse=True)
            gv = np.stack([np.bincount(back, gx[of_win, k] * weight, minlength=len(u)) for k in range(DIM)], axis=1)
            grad2[u] += (gv**2).mean(axis=1, keepdims=True) * len(win)
            self.vectors[u] -= rate * gv * len(win) ** 0.5 / np.sqrt(grad2[u])
            soft2 += gs**2
            bias2 += gb**2
            self.soft -= 0.1 * gs / np.sqrt(soft2)
            self.bias -= 0.1 * gb / np.sqrt(bias2)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression by Newton's method, both classes of equal weight."""
    mid, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mid) / spread, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, penalty = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w -= np.linalg.solve(hess, z.T @ (weight * (p - y)) + penalty * w)
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread) @ mid)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bucket, n0, n1): texts of either label that hold a word, or an n-gram's bucket."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            part = whole.slice(i, 256)
            of: dict[str, list[int]] = {}
            grams = np.zeros((2, BUCKETS), np.int64)
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = list(set(text.lower().split()))
                for w in found:
                    of.setdefault(w, [0, 0])[y] += 1
                grams[y][np.unique(flat_subwords(found)[0])] += 1
            at = np.flatnonzero(grams.any(axis=0))
            words = pa.array([*of, *[None] * len(at)], pa.string())
            buckets = pa.array([*[None] * len(of), *at.tolist()], pa.int32())
            n0, n1 = (pa.array([*[c[y] for c in of.values()], *grams[y][at].tolist()], pa.int64()) for y in (0, 1))
            yield pa.RecordBatch.from_arrays([words, buckets, n0, n1], ["word", "bucket", "n0", "n1"])


def _windows(held, others: int):
    """(doc_id, y, worst, others): of every text the window of WIDTH words that scores highest, and some at other places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worst_of, others_of = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = text.lower().split()
                places = Places()
                d = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                start = worst(held.value.words(list(places))[d])[1] if words else 0
                worst_of.append(" ".join(words[start : start + WIDTH]))
                starts = np.random.default_rng(abs(i)).integers(max(1, len(words) - WIDTH + 1), size=others)
                others_of.append([" ".join(words[k : k + WIDTH]) for k in starts])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(worst_of, pa.string()), pa.array(others_of, pa.list_(pa.string()))], ["doc_id", "y", "worst", "others"])

    return run


def _worst_words(held):
    """(doc_id, y, worst): the TOP words of every text that score highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                words = text.lower().split()
                places = Places()
                d = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                out.append(" ".join(words[k] for k in worst_words(held.value.words(list(places))[d])) if words else "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.string())], ["doc_id", "y", "worst"])

    return run


def train(texts: DataFrame, rounds: int = 3, refits: int = 3) -> Model:
    """Trained on whole texts (doc_id, y, text, apart) that hold both labels.

    What needs whole texts is done by Spark in their place: counts of the texts that hold a word
    or an n-gram, and under the model of each round the windows and words that stand for a text;
    only these, some ``WIDTH * (OTHERS + 1)`` words a text, reach the driver.
    """
    spark = texts.sparkSession
    vectors_from, judged = texts.where("not apart"), texts.where("apart")
    both = {(r["apart"], r["y"]) for r in texts.select("apart", "y").distinct().collect()}
    if len(both) < 4:  # too few to keep some apart
        vectors_from = judged = texts
    told = saved(vectors_from.mapInArrow(_told, "word string, bucket int, n0 long, n1 long").groupBy("word", "bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-counts")
    of = {r["y"]: r["count"] for r in vectors_from.groupBy("y").count().collect()}
    live = np.zeros(BUCKETS)
    live[[r["bucket"] for r in told.where((F.col("n0") + F.col("n1") >= SEEN) & F.col("bucket").isNotNull()).select("bucket").collect()]] = 1
    # A word's weight is the signed square of how many standard errors its shares among toxic and clean texts lie apart.
    p = (F.col("n0") + F.col("n1")) / F.lit(float(of[0] + of[1]))
    gap = F.col("n1") / F.lit(float(of[1])) - F.col("n0") / F.lit(float(of[0]))
    square = gap * F.abs(gap) / F.greatest(p * (1 - p) * F.lit(1 / of[0] + 1 / of[1]), F.lit(1e-12))
    best = told.where("word is not null").select("word", square.alias("z")).orderBy(F.desc(F.abs("z")), "word").limit(INDICATORS)
    chooser: Indicators | Model = Indicators({r["word"]: r["z"] for r in best.collect()})
    learner = Learner(live)
    for _ in range(rounds):
        rows = vectors_from.mapInArrow(_windows(spark.sparkContext.broadcast(chooser), OTHERS), "doc_id long, y int, worst string, others array<string>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
        rows = rows.filter(pc.not_equal(rows.column("worst"), ""))
        learner.learn([w.split(" ") for w in rows.column("worst").to_pylist()], [[w.split(" ") for w in o] for o in rows.column("others").to_pylist()], rows.column("y").to_numpy())
        chooser = learner.model()
    slope, offset = learner.soft[:, 1] - learner.soft[:, 0], learner.bias[1] - learner.bias[0]
    for _ in range(refits):
        held = spark.sparkContext.broadcast(Model((learner.vectors @ slope) * learner.live, offset))
        rows = judged.mapInArrow(_worst_words(held), "doc_id long, y int, worst string").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
        rows = rows.filter(pc.not_equal(rows.column("worst"), ""))
        x = np.array([learner.bags(w.split(" ")).mean(axis=0) for w in rows.column("worst").to_pylist()])
        slope, offset = logistic(x, rows.column("y").to_numpy())
    return Model((learner.vectors @ slope) * learner.live, offset)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    """Trained on a bounded sample of the labelled rows where ``learn`` holds, on their whole texts."""
    known = labels.where(F.col(label).isin(0, 1) & learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, POSITIVE), (0, NEGATIVE))]
    known = saved(first[0].union(first[1]), "toxicity-labels")
    # The sample is bounded by POSITIVE + NEGATIVE ids, so its ids may be broadcast and texts stay where they are.
    ids = F.broadcast(known.select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(ids, "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(known), "doc_id").where(r"text rlike '\\S'")
    # Every fourth text is kept from the vectors, for the last fit of the softmax.
    texts = saved(texts.select("doc_id", "y", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("apart")).repartition(partitions(docs.sparkSession), "doc_id"), "toxicity-texts")
    if {r["y"] for r in texts.select("y").distinct().collect()} != {0, 1}:
        return Model(np.zeros(BUCKETS), -60.0)
    return train(texts)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            out, i = [np.zeros(0)], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 8 * BLOCK):
                    size += len(texts[j])
                    j += 1
                out.append(held.value.scores(texts[i:j]))
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out), pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, score double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels, ~held_out)
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
