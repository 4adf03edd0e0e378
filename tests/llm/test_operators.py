"""Each operator against a brute-force version, on rows that hold every odd case."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import bpe, fingerprint, jaccard, langid, linededup, packing, quality, sharding, topk, toxicity
from vellum.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and in on that which house river green stone walk speak under window", "de": "der die und ein ist nicht haus fluss grün stein gehen sprechen unter fenster straße"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice("abcdefgh") for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    rows = [(i, prose(rng, lang := rng.choice(["en", "de"]), rng.randint(1, 120)), lang, "s", 0) for i in range(60)]
    long_line = prose(rng, "en", 40)
    near = prose(rng, "de", 200)
    rows += [(100 + i, f"{prose(rng, 'en', 30)}\n{long_line}\n\n{prose(rng, 'en', 12)}", "en", None, 1) for i in range(5)]
    rows += [(200 + i, near + f" tail{i}", "de", "x", None) for i in range(6)]
    rows += [(300, near, "de", "x", 2), (301, near, None, "x", 2), (301, near, None, "x", 2), (302, near.upper(), "de", None, 2)]
    rows += [(400, None, "en", "s", None), (401, "", "en", "s", 0), (402, "   \n\t ", None, None, 0), (403, "12 34 ... !!", "en", "s", 3), (404, "one", "en", "s", 3), (405, "One two", "en", "s", 3), (406, "one TWO", "en", "s", 3)]
    rows += [(None, "a row without id of its own here", "en", "s", 3), (None, None, None, None, None)]
    rows += [(500, prose(rng, "en", 20000), "en", "s", 3), (501, "x" * 200000, "en", "s", 3), (502, "İstanbul ΣΑΣ  \u0085 a\x1cb 'll <|endoftext|> naïve é 日本語 🙂", None, "s", 4)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with the operators' own."""
    extra = ["score", "key", "row", "id", "piece", "length", "shard", "lang_pred", "_text", "_gone", "found", "deleted", "place"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in extra}).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    known = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i, *_ in rows if i is not None] + [(None, 1, 0), (1, None, None)]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int")


def test_fingerprints(docs, rows, nothing):
    out = sorted((r.asDict() for r in fingerprint.op1(docs).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_chars"]))
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        edited[i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == edited
    by_text = {i: t for i, t in order}
    marks = collections.defaultdict(set)
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            marks[by_text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    assert fingerprint.op1(nothing).count() == 0


def brute_anchors(text):
    """(place, hash) of the closed syncmers of a text, k-mer by k-mer in plain numbers."""
    mask, m = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & mask
        return h ^ (h >> 29)

    def poly(codes):
        return sum((c + 1) * pow(m, i, 1 << 64) for i, c in enumerate(codes)) & mask

    codes, k, s = [ord(c) for c in text], fingerprint.K, fingerprint.S
    out = []
    for i in range(len(codes) - k + 1):
        inner = [mixed(poly(codes[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, mixed(mixed(poly(codes[i : i + k])))))
    return out


def brute_sketch(text):
    found = {h for _, h in brute_anchors(text)} or ({int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")} if text else set())
    return [h >> 16 for h in sorted(found)[: fingerprint.SIZE]]


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    first = sorted(set(a) | set(b))[: fingerprint.SIZE]
    return sum(x in set(a) and x in set(b) for x in first) / len(first)


def test_fingerprints_by_definition(spark, docs, rows):
    """Fingerprints, likenesses and anchors of all texts but the longest, from the definition."""
    short = [(i, t or "") for i, t, *_ in rows if len(t or "") < 3000]
    order = sorted({i: t for i, t in short if i is not None}.items())
    df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in fingerprint.op1(df).collect()}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        own, edited, other = brute_sketch(t), brute_sketch(t[: len(t) - cut] + after[:cut]), brute_sketch(after)
        assert [out[i].fingerprint, out[i].edited_fingerprint] == ["".join(f"{h:012x}" for h in x) for x in (own, edited)]
        assert abs(out[i].near_edited - brute_likeness(own, edited)) < 1e-12 and abs(out[i].near_next - brute_likeness(own, other)) < 1e-12
    few = dict(order[:12])
    got = collections.defaultdict(set)
    for r in fingerprint.anchors(df.where(F.col("doc_id").isin(list(few)))).collect():
        got[r.doc_id].add((r.position, r.anchor & (1 << 64) - 1))
    assert {i: got[i] for i in few} == {i: set(brute_anchors(t)) for i, t in few.items()}


def test_syncmers_are_context_free():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 300).astype(np.uint32)
    alone = dict(zip(*(x.tolist() for x in fingerprint.syncmers(passage)), strict=True))
    inside = fingerprint.syncmers(np.concatenate([rng.integers(97, 123, 77).astype(np.uint32), passage]))
    moved = {a - 77: h for a, h in zip(*(x.tolist() for x in inside), strict=True) if a >= 77}
    assert moved == alone


def test_language(docs, rows, nothing, spark):
    out = langid.op2(docs).collect()
    assert len(out) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, lang, *_ in rows:
        texts[i].append((t, lang))
    right = []
    for r in out:
        if r.doc_id is None:
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        t, lang = texts[r.doc_id][0]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(t) > 60 and lang and r.held_out:
            right.append(r.lang_pred == lang)
    assert len(right) > 5 and np.mean(right) > 0.9
    assert langid.op2(nothing).count() == 0
    assert {r.lang_pred for r in langid.op2(spark.createDataFrame([(1, "some text", None, None, 1)], SCHEMA)).collect()} == {"und"}


def word_grams(text):
    """All n-grams of a text as strings, one of each place."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [g for w in words for n in langid.SIZES for k in range(len(w) + 3 - n) if (g := f" {w} "[k : k + n]).strip()] if words else []


def brute_languages(rows):
    """The operator's rule with sets of strings in place of the filter; (lang, score) of each text."""
    learnt = collections.defaultdict(list)
    for i, t, lang, *_ in rows:
        if lang and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learnt[lang].append(set(word_grams(t)))
    order = sorted(learnt, key=lambda x: (-len(learnt[x]), x))
    rate = {lang: {g: n / len(texts) for g, n in collections.Counter(g for t in texts for g in t).items()} for lang, texts in learnt.items()}
    best = collections.defaultdict(float)
    for of in rate.values():
        for g, r in of.items():
            best[g] = max(best[g], r)
    kept = {lang: {g for g, r in rate[lang].items() if r >= langid.MIN_SHARE and r * langid.RATIO >= best[g]} for lang in order}
    out = []
    for _, t, *_ in rows:
        found = word_grams(t or "")
        hits = [sum(g in kept[lang] for g in found) for lang in order]
        top = max(range(len(order)), key=lambda k: hits[k])
        out.append((order[top], hits[top] / sum(hits)) if found and sum(hits) else (order[0] if found else "und", 0.0))
    return out


def test_language_by_sets(docs, rows):
    """The filter beside sets of strings: the same language, and a score that its false positives hardly change."""
    out = collections.defaultdict(list)
    for r in langid.op2(docs).collect():
        out[r.doc_id].append((r.lang_pred, r.score))
    compared = 0
    for (i, t, *_), (lang, score) in zip(rows, brute_languages(rows), strict=True):
        if i is not None and len(out[i]) == 1 and t and len(t) < 5000 and "日" not in t and "İ" not in t:
            assert abs(out[i][0][1] - score) < (0.02 if len(t) > 60 else 0.1), (i, out[i], lang, score)
            assert out[i][0][0] == lang or abs(score - 0.5) < 0.05
            compared += 1
    assert compared > 60


def test_forty_languages(spark):
    """One path however many languages there are; none is cut."""
    rng = random.Random(8)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + list("äöüßéèçñøåłőűčšž")
    own = {f"l{k:02d}": ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(40)] for k in range(40)}
    rows = [(100 * k + n, " ".join(rng.choices(words, k=30)), lang) for k, (lang, words) in enumerate(own.items()) for n in range(12)]
    out = langid.op2(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang_of = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == lang_of[r.doc_id] for r in out)


def brute_pieces(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            yield (i, n, at, len(part), zlib.crc32(part.tobytes()))


def test_packing(docs, rows, nothing):
    out = packing.op3(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == collections.Counter(brute_pieces(rows))
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(r.length for r in out) // 4096) + 1
    assert packing.op3(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 7, 500, 20_000])
def test_layout_holds_every_piece(n):
    lengths = np.minimum(4096, np.random.default_rng(n).lognormal(6, 1.3, n).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=4097)
    found, back = packing.layout(histogram), np.zeros(4097, int)
    for pattern, times in found:
        assert sum(pattern) <= 4096
        for length in pattern:
            back[length] += times
    assert (back == histogram).all()
    assert sum(t for _, t in found) <= -(-int(lengths.sum()) // 4096) * 1.02 + 1


def test_patterns_place_most_pieces():
    """The fit lays out most pieces of a corpus, and what it lays out is never more than there is."""
    lengths = np.minimum(4096, np.random.default_rng(4).lognormal(6.2, 0.9, 12_000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=4097)
    placed = np.zeros(4097, int)
    for pattern, times in packing.fitted(histogram):
        for n in pattern:
            placed[n] += times
    assert (placed <= histogram).all()
    assert placed[:4096].sum() > 0.5 * histogram[:4096].sum()
    assert sum(t for _, t in packing.layout(histogram)) == -(-int(lengths.sum()) // 4096)


def test_fit_is_non_negative_least_squares():
    """Against projected gradients with exact steps on a small problem."""
    rows = [(4, 3, 1), (4, 4), (3, 3, 2), (2, 2, 2, 2), (1,) * 4]
    h = np.array([0, 9, 14, 7, 12])
    a = np.array([[r.count(n) for r in rows] for n in range(5)], float)
    x = np.ones(len(rows))
    for _ in range(20_000):
        x = np.maximum(0, x - a.T @ (a @ x - h) / np.linalg.norm(a, 2) ** 2)
    found = packing.non_negative_fit(rows, h, 3000)
    assert (found >= 0).all() and abs(np.sum((a @ found - h) ** 2) - np.sum((a @ x - h) ** 2)) < 1e-3


def test_one_length_for_all():
    histogram = np.zeros(4097, np.int64)
    histogram[1000] = 1_000_003
    assert sum(t for _, t in packing.layout(histogram)) == 250_001


@pytest.mark.parametrize("distinct", [8, bpe.DISTINCT])
def test_bpe(docs, rows, nothing, distinct):
    """With blocks of a few texts, and with production ones."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.op4(docs, distinct=distinct).collect())) == expected
    assert bpe.op4(nothing).count() == 0


def test_words_are_encoded_as_the_text_is():
    """Every ASCII character before every combining mark, alone and inside a word; numbers beyond two bytes."""
    tokenizer = bpe.load(bpe.VOCABULARY)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0591", "\u1dc4", "\u20d2", "\u3099", "\ufe20"]
    texts = [f"{chr(a)}{m} x{chr(a)}{m}y. {chr(a)} {m}" for a in range(32, 127) for m in marks]
    words = [bpe.split_words(t.encode()) for t in texts]
    every = sorted({w for row in words for w in row})
    ids = dict(zip(every, bpe.word_ids(tokenizer, every), strict=True))
    assert [[i for w in row for i in ids[w]] for row in words] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_beyond_two_bytes(spark):
    text = " ".join(f"w{i}" for i in range(70_000)) + " w69999 w0"
    df = spark.createDataFrame([(1, text), (2, "w5 w69998")], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.ids for r in bpe.encode(df, ["doc_id"]).collect()}
    tokenizer = bpe.load(bpe.VOCABULARY)
    assert out == {1: tokenizer.encode(text, add_special_tokens=False).ids, 2: tokenizer.encode("w5 w69998", add_special_tokens=False).ids}


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [320, -1, 99_999_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    piece = Tokenizer.from_file(bpe.VOCABULARY).id_to_token(320)
    assert {r.doc_id: r.decoded for r in bpe.decode(df, ["doc_id"]).collect()} == {1: piece, 2: "", 3: ""}


def test_quality(spark, docs, rows, nothing):
    junk = [(1000 + i, "%%% ### " * 30, "en", "s", 0) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(junk, SCHEMA), allowMissingColumns=True)
    known = spark.createDataFrame([(i, 1) for i, *_ in rows if i is not None] + [(i, 0) for i, *_ in junk] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = quality.op5(both, known).collect()
    assert len(out) == len(rows) + len(junk)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in held if r.doc_id not in (400, 401, 402, 403, 501)]) > 0.9
    assert quality.op5(nothing, known).count() == 0
    assert {r.predicted for r in quality.op5(docs, known.limit(0)).collect()} == {1}


def test_toxicity(spark, docs, rows, nothing):
    rng = random.Random(3)
    bad = ["worthless", "disgusting", "stupid"]

    def spoilt():
        w = list(rng.choice(bad))
        i = rng.randrange(1, len(w) - 1)
        w[i] = rng.choice("xyz01") if rng.random() < 0.3 else w[i]
        return "".join(w)

    made = [(2000 + i, f"{prose(rng, 'en', 25)} {spoilt() if i % 2 else ''} {spoilt() if i % 2 else ''} {prose(rng, 'en', 25)}", "en", "s", 0) for i in range(500)]
    known = spark.createDataFrame([(i, i % 2) for i, *_ in made] + [(None, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.op7(docs.unionByName(spark.createDataFrame(made, SCHEMA), allowMissingColumns=True), known).collect()
    assert len(out) == len(rows) + len(made)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id >= 2000]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    assert toxicity.op7(nothing, known).count() == 0


def brute_topk(table, k=5):
    good = {}
    for i, v in table:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([max(-(2**63), min(2**63 - 1, int(np.floor(256 * x)))) for x in v])
    out, most = {}, 2**63 - 1
    for q in good:
        if q % 50 == 0:
            asks = min(good[q])
            found = [(-max(-most, min(most, sum(x * y for x, y in zip(asks, v)))), i) for i, rows in good.items() if i != q for v in rows]  # noqa: B905
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def asked_topk(df, **sizes):
    usable = df.where(topk.usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), topk.scaled("embedding").alias("v"))
    out = collections.defaultdict(list)
    for r in sorted(topk.largest_products(usable, F.col("id") % 50 == 0, 5, **sizes).collect(), key=lambda r: r.rank):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def brute_features(text):
    """The features by their definitions, sign by sign."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.NAMES)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    capitals, small = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122)))
    letters, count, white = max(1, capitals + small), max(1, len(words)), raw.count(b" ") + raw.count(b"\n")
    signs = [raw.count(bytes([c])) for c in quality.SIGNS]
    ends = sum(1 for w in set(words) if not w[-1].isalnum() and w[-1] not in ".,;:")
    return [
        np.log1p(len(raw)), capitals / letters, sum(48 <= c <= 57 for c in raw) / len(raw), sum(c >= 128 for c in raw) / len(raw), sum(signs) / len(raw), white / len(raw), np.log1p(len(words)),
        (len(raw) - white) / count / 10, len(set(words)) / count**0.8, sum(a == b for a, b in itertools.pairwise(words)) / count, 1 / max(1, len(set(words))), ends / max(1, len(set(words))),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(count / max(1, len(lines))), float(capitals > 0.6 * letters), *[(x / count) ** 0.5 for x in signs],
    ]


def test_quality_by_definition(rows):
    for _, t, *_ in rows:
        assert np.allclose(quality.features(t or ""), brute_features(t or ""), atol=1e-9)


def test_preferences_are_fitted():
    """The weights of pairs fitted by Newton are the minimum of the pairs' logistic loss; scores and threshold follow."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(0, 1, (400, 4)), np.ones(400)])
    y = (x[:, 0] - 2 * x[:, 1] + rng.normal(0, 1, 400) > -0.5).astype(int)
    model = quality.fit_pairs(x, y, pairs=5000)
    draw = np.random.default_rng(7)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-6, x.std(axis=0), np.inf)
    d = z[draw.choice(np.flatnonzero(y == 1), 5000)] - z[draw.choice(np.flatnonzero(y == 0), 5000)]
    w = model.weights * np.where(x.std(axis=0) > 1e-6, x.std(axis=0), 0)

    def loss(w):
        return np.log1p(np.exp(-(d @ w))).mean() + 0.5e-3 * w @ w

    for step in np.eye(5)[:4] * 0.01:
        assert loss(w) < loss(w + step) and loss(w) < loss(w - step)
    score = 1 / (1 + np.exp(-(x @ model.weights + model.offset)))
    assert abs((score < quality.CUT).mean() - (y == 0).mean()) < 0.03


def test_toxicity_by_definition():
    """Scores from the model's vectors, word by word and n-gram by n-gram."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), -0.3)
    texts = ["", "one", "a b c d e f g h i", "Some LONGER text, with signs! and naïve wörds " * 5, "\n\t "]

    def word(w):
        w = "<" + "".join(c for c in w if ord(c) >= 128 or c.isalnum()) + ">"
        grams = [w[i : i + n] for n in range(3, 7) for i in range(len(w) - n + 1)]
        return np.mean([model.gram[toxicity.subwords_of(g)] for g in grams]) if grams else 0.0

    for t, s in zip(texts, model.scores(texts), strict=True):
        u = sorted((word(w) for w in t.lower().split()), reverse=True)[: toxicity.TOP]
        assert abs(s - 1 / (1 + np.exp(-((np.mean(u) if u else 0) - 0.3)))) < 1e-6


def test_long_labelled_texts_are_learnt_from(spark):
    rng = random.Random(3)
    made = [(i, " ".join(prose(rng, "en", 500) + (" worthless stupid disgusting" if i % 2 else "") for _ in range(10))) for i in range(80)]
    known = spark.createDataFrame([(i, i % 2) for i, _ in made], "doc_id long, toxic int")
    assert min(len(t) for _, t in made) > 30_000
    out = toxicity.op7(spark.createDataFrame(made, "doc_id long, text string"), known).collect()
    assert max(r.score for r in out) > 0.5 > min(r.score for r in out)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(5000, 5001)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1000 for i in range(1000, 1401)}, 5000: 5000, 5001: 5000}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), rounds=2)


@pytest.mark.parametrize("block", [40, 4096])
def test_topk(spark, block):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 1, (400, 12)) * rng.lognormal(0, 1, (400, 1))
    vectors[50:80] = vectors[50]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table += [(1000, None), (1001, [None] * 12), (1050, [float("nan")] * 12), (1100, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1150, [0.0] * 12), (1200, [])]
    table += [(0, table[0][1]), (50, table[3][1]), (7, table[7][1]), (7, table[8][1])]  # repeated queries and candidates
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "norm", "tile", "bucket", "span", "score")})
    assert asked_topk(df, block=block, tile=3) == brute_topk(table)
    assert topk.op6(df.limit(0)).count() == 0
    assert topk.op6(df).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("size", [1e7, 1e9, 1e300])
def test_topk_of_large_numbers(spark, size):
    """Whole numbers beyond what floats hold, and beyond a long."""
    rng = np.random.default_rng(3)
    table = [(i, [float(x) for x in rng.normal(0, 1, 6) * size]) for i in range(120)]
    table += [(200, [256000001 / 256, 0.0]), (201, [256000001 / 256, 0.0]), (202, [256000002 / 256, 0.0]), (203, [256000001 / 256, 1 / 256])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert asked_topk(df, block=16, tile=2) == brute_topk(table)


def brute_runs(rows, least):
    """Deleted line numbers of each (doc_id, text), from the definition."""
    order = sorted({(i, t, j) for j, (i, t) in enumerate(dict.fromkeys((i, t) for i, t, *_ in rows))}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {}
    for i, t, _ in order:
        kept = [(k, x.strip(" \t\n\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n"))]
        lines[i, t] = [(k, x) for k, x in kept if x]
    seen, gone = {}, collections.defaultdict(set)
    for i, t, _ in order:
        own = lines[i, t]
        size = [len(x.encode().split()) for _, x in own]
        for a in range(len(own)):
            b = next((b for b in range(a + 1, len(own) + 1) if sum(size[a:b]) >= least), None)
            if b is None:
                break
            key = tuple(x for _, x in own[a:b])
            if key not in seen:
                seen[key] = (i, t, a)
                continue
            j, u, c = seen[key]
            e, f, held = b, c + b - a, 0
            while e < len(own) and f < len(lines[j, u]) and own[e][1] == lines[j, u][f][1] and held + size[e] < least:
                held += size[e]
                e, f = e + 1, f + 1
            gone[i, t] |= {k for k, _ in own[a:e]}
    return gone


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_line_dedup(docs, rows, nothing, broadcast, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST", broadcast)
    gone = brute_runs(rows, linededup.MIN_WORDS)
    out = collections.Counter((r.doc_id, r.n_lines, tuple(r.deleted), r.text) for r in linededup.op8(docs).collect())
    expected = collections.Counter()
    for i, t, *_ in rows:
        drop = gone[i, t]
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
        expected[i, 0 if t is None else len(t.split("\n")), tuple(sorted(drop)), text] += 1
    assert out == expected
    assert sum(len(g) for g in gone.values()) >= 5
    assert linededup.op8(nothing).count() == 0


def brute_all_runs(rows, least):
    """As brute_runs, beside every earlier place of a run and not the first alone; rows of different ids."""
    seen, gone = collections.defaultdict(list), collections.defaultdict(set)
    for i, t in sorted(rows):
        own = [(k, x) for k, x in enumerate(t.split("\n")) if x]
        size = [len(x.split()) for _, x in own]
        for a in range(len(own)):
            b = next((b for b in range(a + 1, len(own) + 1) if sum(size[a:b]) >= least), None)
            if b is None:
                break
            key = tuple(x for _, x in own[a:b])
            for other, f in seen[key]:
                e, held = b, 0
                while e < len(own) and f < len(other) and own[e][1] == other[f][1] and held + size[e] < least:
                    held += size[e]
                    e, f = e + 1, f + 1
                gone[i] |= {k for k, _ in own[a:e]}
            seen[key].append((own, b))
    return gone


def test_line_runs_grow_in_any_earlier_place(spark):
    """A common opening with many ways to go on, each of them in several documents."""
    rng = random.Random(9)
    start = " ".join(f"open{i}" for i in range(32))
    rows = [(i, "\n".join([start, *[rng.choice(["aa bb cc", "dd ee", "ff", "gg hh ii jj"]) for _ in range(rng.randint(0, 5))], *([start] if i % 9 == 0 else [])])) for i in range(60)]
    rows += [(100, f"{start}\nfirst"), (101, f"{start}\nsecond one\nthird"), (102, f"{start}\nsecond one\nthird\nown")]
    gone = brute_all_runs(rows, linededup.MIN_WORDS)
    assert gone[102] == {0, 1, 2}
    out = linededup.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: set(r.deleted) for r in out} == {i: gone[i] for i, _ in rows}


def test_line_runs_grow_right(spark):
    run = [" ".join(f"w{i}{j}" for j in range(20)) for i in range(5)] + ["short end", "other end"]
    rows = [(1, "\n".join(["first one", *run])), (2, "\n".join(["zwei", *run, "last"])), (3, "\n".join(run[:6]))]
    out = {r.doc_id: r.text for r in linededup.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "zwei\nlast", 3: ""}


def test_resharding(docs, rows, nothing):
    out = sharding.op9(docs).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for shard, group in itertools.groupby(sorted(out, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert 0 <= shard < 40
        assert [r.slot for r in group] == list(range(len([r for r in out if r.shard == shard])))
    assert all(r.law == "bytes" and r.grown_shard is None for r in out)
    assert sharding.op9(nothing).count() == 0


def test_resharding_evens_out(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.xxhash64("id") % 300 + 300).cast("int")).alias("text"))
    totals = sharding.op9(df).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert totals.max() - totals.min() < 2 * 1216


def test_resharding_moves_fewest_bytes(spark):
    """What moves is what no plan could leave: the bytes above each shard's capacity, but for one document a cut."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.xxhash64("id") % 300 + 300).cast("int")).alias("text"))
    rows = sharding.saved(sharding.sized(df), "test-moved")
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise((F.col("doc_id") % 8).cast("int"))
    total = rows.agg(F.sum("size")).first()[0]
    capacities = sharding.equal_capacities(total, 8)
    out = sharding.reshard(rows, 8, old, capacities).collect()
    held, moved, largest = collections.Counter(), 0, max(r.size for r in out)
    for r in out:
        held[r.old_shard] += r.size
        moved += r.size if r.shard != r.old_shard else 0
    least = sum(max(0, held[k] - capacities[k]) for k in range(8))
    assert abs(moved - least) <= 8 * largest and moved < total / 2
    now = collections.Counter()
    for r in out:
        now[r.shard] += r.size
    assert max(now.values()) - min(now.values()) <= 16 * largest


def test_rewritten_files_hold_the_plan(spark, docs, rows, tmp_path):
    """Every row of a changed shard stands once in its files, null and repeated ids too; a shard is cut into ranges of slots."""
    more = [(None, f"no id {i % 7}", "en", "s", i) for i in range(300)] + [(7, f"same id {i % 5}", "de", "s", i) for i in range(200)]
    df = spark.createDataFrame(rows + more, SCHEMA).coalesce(3)
    plan = sharding.saved(sharding.reshard(sharding.saved(sharding.sized(df), "test-sizes"), 6), "test-plan")
    touched = {r.shard for r in sharding.rewrite_affected(df, plan, str(tmp_path / "out")).collect()}
    want = plan.collect()
    assert touched == {x for r in want if r.shard != r.old_shard for x in (r.shard, r.old_shard)}
    found = spark.read.parquet(str(tmp_path / "out"))
    got = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in found.collect()]
    assert collections.Counter(got) == collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in want if r.shard in touched)
    if len(touched) == 6:
        assert collections.Counter(tuple(r)[:5] for r in found.select(*df.columns).collect()) == collections.Counter(rows + more)
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("shard=*")) > 1


def test_flow_moves_least():
    flow = sharding.min_cost_flow([5, 0, 7], [0, 8, 4], [[9, 1, 3], [9, 9, 9], [9, 4, 1]])
    assert [sum(r) for r in flow] == [5, 0, 7] and [sum(c) for c in zip(*flow, strict=True)] == [0, 8, 4]
    assert sum(f * c for row, cost in zip(flow, [[9, 1, 3], [9, 9, 9], [9, 4, 1]], strict=True) for f, c in zip(row, cost, strict=True)) == 5 * 1 + 3 * 4 + 4 * 1


def brute_join(rows, words, percent):
    def shingles(text):
        found = (text or "").encode().lower().split()
        return frozenset(zip(*(found[k:] for k in range(words)), strict=False)) if len(found) >= words else frozenset([tuple(found)] if found else [])

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return collections.Counter((i, len(s), least.get(root(k)) if s else i, links[k]) for k, (i, s) in enumerate(sets))


def near_copies(n=150):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(220)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
        out.append((5000 + i, " ".join(text), "en", "s", 0))
    return out


@pytest.mark.parametrize(("words", "percent", "region", "block"), [(3, 90, 4096, 2048), (5, 80, 4096, 2048), (3, 90, 24, 16), (3, 90, 24, 4)])
def test_jaccard_join(spark, docs, rows, nothing, words, percent, region, block):
    """At production sizes, and with regions and families so small that cells and tiles are needed."""
    every = rows + near_copies()
    df = docs.select(*nothing.columns).union(spark.createDataFrame(near_copies(), SCHEMA)).withColumn("key", F.lit("clash"))
    out = jaccard.join(df, words, percent, region=region, block=block).collect()
    assert collections.Counter(map(tuple, out)) == brute_join(every, words, percent)
    if region == 4096:
        assert jaccard.join(nothing, words, percent).count() == 0


def test_prefixes_keep_every_pair():
    """Sets at or above the threshold share a shingle of their prefixes, whatever their differences hit and whatever is common."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in (1, 2, 4, 5, 9, 10, 19, 60, 400):
            for _ in range(30):
                common = rng.integers(0, 3, 1 << jaccard.COUNTERS).astype(np.uint8)
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
                d = next(d for d in range(n, -1, -1) if 100 * (n - d) >= percent * (n + d))
                b = np.sort(np.append(rng.permutation(a)[d:], rng.integers(0, 1 << 63, d).astype(np.uint64)))
                assert set(jaccard.rarest(a, common, percent)) & set(jaccard.rarest(b, common, percent))
                fewer = a if n == 1 else rng.permutation(a)[: -(-percent * n // 100)]
                assert set(jaccard.rarest(a, common, percent)) & set(jaccard.rarest(np.sort(fewer), common, percent))


def test_regions_over_many_batches(monkeypatch):
    """A region is whole, under one name, wherever batches end; a step in size that no link spans parts it."""
    rows = sorted((a, n, b) for a in range(6) for b in range(40 if a == 3 else 3) for n in [100 + b % 2 if b != 2 else 300])
    columns = [np.array([r[i] for r in rows], np.int64 if i < 2 else np.int32) for i in (0, 2, 1)]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({c: x[at : at + size] for c, x in zip("abn", columns, strict=True)}) for at in range(0, len(rows), size)]
        out = [r for b in jaccard._shared(90)(iter(batches)) for r in b.to_pylist()]
        regions = collections.defaultdict(set)
        for r in out:
            regions[r["g"]].add(r["key"])
        assert sorted(map(sorted, regions.values())) == sorted([[0, 1], [x for x in range(40) if x != 2]]), size
        assert len(out) == 41


def test_first_of_groups(docs, rows):
    groups = collections.defaultdict(set)
    for (i, _, c, _), _ in brute_join(rows, 3, 90).items():
        groups[c].add(i)
    kept = [r.doc_id for r in jaccard.first_of_groups(docs).select("doc_id").collect()]
    gone = {i for c, ids in groups.items() for i in ids if i is not None and i != c}
    assert not gone & set(kept)
    assert {i for i, *_ in rows} - gone == set(kept)
    assert kept.count(300) == 0 or kept.count(301) == 0


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """Every labelled row counts, however many groups they make, and a rare class meets all of them."""
    monkeypatch.setattr(quality, "GROUP", 50)
    monkeypatch.setattr(quality, "PAIRS", 2000)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.NAMES))).astype(np.float32)
    y = (np.arange(600) % 30 != 0).astype(int)
    x[:, 5] += 4 * y
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, f array<float>")
    model = quality.fit(f, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"), F.lit(True))
    score = x.astype(float) @ model.weights + model.offset
    cut = np.log(quality.CUT / (1 - quality.CUT))
    assert (score[y == 1][:, None] > score[y == 0]).mean() > 0.97 and abs((score < cut).sum() - 20) <= 12
    half = quality.fit(f, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if i < 599], "doc_id long, quality int"), F.lit(True))
    assert not np.array_equal(model.weights, half.weights)  # the last row told
    for scores, bad in (([0.0, 1, 2, 3, 9, 10, 11, 12, 13, 14], 4), ([1.0] * 10, 3)):
        s = np.sort(scores)
        at = quality._threshold(spark.createDataFrame([(float(v),) for v in scores], "s double"), 10, bad)
        assert at == (s[bad] + s[bad - 1]) / 2
