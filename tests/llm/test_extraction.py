"""Main text, whitening and collocations beside plain versions, with their defined cases; toxicity learnt from whole long texts."""

import collections
import random
import re

import numpy as np
import pytest

from vellum.llm import collocation, htmltext, toxicity, whitening

# ---- main text


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.fit(htmltext.labelled_blocks(spark))


def keeps(tree, f):
    while not isinstance(tree, bool):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


def test_tree_fits_its_table_and_uses_neighbours(spark, tree):
    rows = htmltext.labelled_blocks(spark).collect()
    assert np.mean([keeps(tree, r.f) == bool(r.label) for r in rows]) > 0.97
    used, todo = set(), [tree]
    while todo:
        t = todo.pop()
        if not isinstance(t, bool):
            used.add(htmltext.FEATURES[t[0]])
            todo += t[2:]
    assert {"furniture", "density", "article"} <= used and used & {"density_before", "density_after", "words_before", "words_after"}


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (None, []), ("", []), ("  ", []), ("abc", ["abc"]), ("a < b &amp; c", ["a < b & c"]), ("<p>foo<b>b</b>ar<i></i>", ["foobar"]), ('<p title="a>b">x</p>', ["x"]), ("<p title=it's>x</p><p>y's", ["x", "y's"]),
        ("<div hidden>no<p>no</div><p>yes", ["yes"]), ('<p>a<span style="display: none">no<span>no</span></span>b', ["ab"]), ('<script>if(a<b){"</p>"}</script>x', ["x"]), ("<style>p{}</style><title>t</title>x", ["x"]),
        ("<p>un<!-- <p> -->it<!-- cut", ["unit"]), ("<p>a&nbsp;b&#x20;c\n\t d &amp;lt;", ["a b c d &lt;"]), ('<p>cut <a href="x', ["cut"]), ("<textarea><p>no</textarea>yes<button>no</button>", ["yes"]), ("a<br>b<hr>c", ["a b", "c"]),
        ("<ul><li>one<ul><li>in</ul><li>two</ul>", ["one", "in", "two"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("</p></div>x</p>", ["x"]), ("<P>X</P><DIV>Y", ["X", "Y"]), ("<svg><text>no</text></svg>y<svg/>z", ["y", "z"]),
    ],
)
def test_blocks(page, blocks):
    assert [b[0] for b in htmltext.flat_blocks(page)] == blocks


def test_block_features():
    blocks = htmltext.flat_blocks('<nav><a href=x>One two</a> three</nav><article><h2>Head</h2><div class="comment-list"><p>No<p>Yes</div><p>Go <a href=y>on</a>.</article><div class="no-sidebar">Out</div>')
    assert [(b[0], b[1], round(b[2], 3), b[3], b[4], b[5]) for b in blocks] == [
        ("One two three", 3, 0.667, True, False, False), ("Head", 1, 0.0, False, True, True), ("No", 1, 0.0, True, True, False), ("Yes", 1, 0.0, True, True, False), ("Go on.", 2, 0.5, False, True, False), ("Out", 1, 0.0, False, False, False),
    ]
    f = htmltext.described(blocks)[1][1]
    assert f[:6] == [1.0, 0.0, 3.0, pytest.approx(2 / 3), 1.0, 0.0]


def page(rng, i, words, comments):
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    paragraphs = [text(rng.randint(1, 60)) for _ in range(rng.randint(1, 8))]
    title = text(rng.randint(1, 9))
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(words, 5))
    body = "".join(f"<p>{p}</p>" if rng.random() < 0.8 else f"<p><b>{p}</b><br>" for p in paragraphs)
    extra = f'<section id="comments"><h3>{text(2)}</h3>' + "".join(f'<div class="comment"><p>{text(25)}</p></div>' for _ in range(3)) + "</section>" if comments else ""
    html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><p>{text(6)}</p></header><nav><ul>{menu}</ul></nav><div class=\"cookie-notice\"><p>{text(20)}</p></div><!-- {text(4)} -->"
    html += f'<aside class="sidebar"><p>{text(18)}</p></aside><article><h1>{title}</h1>{body}</article>{extra}<div class="ad">{text(12)}</div><form><p>{text(9)}</p></form><footer>&copy; {text(8)}</footer></body></html>'
    return html, " ".join([title, *paragraphs])


def test_main_text(spark, tree):
    """Pages of another layout than the examples', whole and without an end, with null and empty ones, repeats and clashing columns."""
    rng = random.Random(9)
    words = ["stone", "river", "müll", "ça", "of", "the", "mill", "R&amp;D", "x²", "night"]
    made = [page(rng, i, words, i % 3 == 0) for i in range(60)]
    rows = [(i, f"u{i}", h, "old", 7) for i, (h, _) in enumerate(made)] + [(100, None, None, "old", 1), (101, "u", "", "old", 1), (None, "u", made[0][0], None, 1), (0, "u0", made[0][0], "old", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row int")
    got = htmltext.op11(df).collect()
    want = {i: t.replace("&amp;", "&") for i, (_, t) in enumerate(made)}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert collections.Counter((r.page_id, r.text) for r in got) == collections.Counter([*want.items(), (100, ""), (101, ""), (None, want[0]), (0, want[0])])
    kept = htmltext.main_text(df, tree).where("row.page_id = 3").first()
    assert kept.row.text == "old" and kept.row.row == 7 and kept.text == want[3]
    assert htmltext.op11(df.where("false")).count() == 0


# ---- whitening


def whitened(rows):
    """(ids, whole vectors, n x - S exact, whitened) by numpy."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = collections.Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == d]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in good], np.int64)
    exact = len(x) * x - x.sum(axis=0)
    c = exact / len(x)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-e)[:8]
    return [i for i, _ in good], exact, c @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0] * 11 + [None]), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0] * 3), (None, [0.5] * 12), (7, [0.25] * 12), (7, [0.25] * 12)]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, embedding array<double>, whitened double, n string")
    got = whitening.op12(df).collect()
    ids, exact, w, explained = whitened(rows)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {303} and max(r.identity_error for r in got) < 1e-9
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.component):
        assert r.deviation == r.deviation_exact and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        by[r.vec_id, r.deviation].append(r.whitened)
    sign = np.sign([by[0, int((exact[0] ** 2).sum())][j] * w[0, j] for j in range(8)])
    for k, i in enumerate(ids):
        mine = by[i, int((exact[k].astype(object) ** 2).sum())]
        assert len(mine) % 8 == 0 and all(np.allclose(mine[j * (len(mine) // 8)], sign[j] * w[k, j], atol=1e-9) for j in range(8))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.op12(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_few_dimensions(spark):
    """Two dimensions, one of them without variance: one component; and deviations past 64 bits."""
    rows = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = whitening.op12(rows).collect()
    assert [r.component for r in got] == [1] * 5 and np.allclose(sorted(abs(r.whitened) for r in got), np.sort(np.abs(np.arange(5) - 2) / np.sqrt(2)))
    big = whitening.op12(spark.createDataFrame([(i, [i * 1e12]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert all((r.deviation is None) == (r.deviation_exact >= 2**63) for r in big) and max(r.deviation_exact for r in big) == (3 * 1024 * 10**12) ** 2


# ---- collocations


def brute(docs, least=30, longest=4, swallowed=80, scale=2_000_000, first=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    rows = []
    held = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= swallowed * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    for (lang, w), a in held.items():
        if (lang, w) not in gone:
            score, _, left, right = min((scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            rows.append((lang, " ".join(w), a, left, right, n[lang], score))
    out = []
    for lang in n:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:first])]
    return sorted(out)


def told(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["new", "York", "the", "of", "city", "état", "ÉTAT", "x y", "a", "a", "\x1f", "ab"]
    phrases = ["New York City hall", "the city of", "a a a a a", "state of the art"]
    one = lambda: "".join(rng.choice([*words, rng.choice(phrases)]) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", " "]) for _ in range(rng.randint(0, 50)))
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), one()) for _ in range(180)]
    return [*rows, ("en", None), ("de", "..,, \t"), ("en", ""), (None, "lone"), rows[0], rows[0], ("en", "state of the art. " * 300)]


@pytest.mark.parametrize("sizes", [{}, {"block": 300, "bucket": 50}])
def test_collocations(spark, texts, sizes):
    """Large blocks and small ones, one bucket and many."""
    df = spark.createDataFrame([(i, t, lang, "n", 1) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, word string, n int").repartition(3)
    got = told(collocation.collocations(df, **sizes))
    assert got == brute(texts) and len({r[0] for r in got}) >= 3
    assert told(collocation.collocations(df, least=3, longest=3, swallowed=50, first=4, **sizes)) == brute(texts, 3, 3, 50, first=4)


def test_collocations_of_nothing(spark, texts):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert collocation.op13(df).count() == 0 == collocation.op13(df.where("false")).count()


def test_exact_scores(spark):
    """Products that pass 64 bits."""
    row = spark.range(1).select(collocation._score(collocation.F.lit(6 * 10**15).cast("long"), collocation.F.lit(13 * 10**15 + 1).cast("long"), 2_000_000).alias("s")).first()
    assert row.s == 2_000_000 * 6 * 10**15 // (13 * 10**15 + 1)


# ---- toxicity from whole texts


def test_toxic_words_anywhere_in_long_texts(spark):
    """Labelled texts of 9,000 words whose toxic words stand at one place, a different one in each."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2500)]
    rows, known = [], []
    for i in range(120):
        w = rng.choices(words, k=9000)
        if i % 2:
            at = rng.randrange(8900)
            w[at : at + 3] = rng.sample(["worthless", "disgusting", "stupid", "filthy"], 3)
        rows.append((i, " ".join(w)))
        known.append((i, i % 2))
    out = toxicity.op7(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    held = [(r.score, r.doc_id % 2) for r in out if r.held_out]
    good = [a > b for a, y in held if y for b, z in held if not z]
    assert good and np.mean(good) > 0.95
