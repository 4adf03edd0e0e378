"""Draws, bar codes, motion and batches of questions beside plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.functions import barcodes
from vellum.operators import asking, draws, motion
from vellum.plans import media


def numbers_of(seed):
    """The generator in plain numbers."""
    a, m = seed, 2**32
    while True:
        a = (a + 1831565813) % m
        t = (a ^ a >> 15) * (a | 1) % m
        t ^= (t + (t ^ t >> 7) * (t | 61) % m) % m
        yield (t ^ t >> 14) / m


def shuffle(items, rnd):
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(next(rnd) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(g, g * 100 + i) for g in range(40) for i in range(1 + g % 13)]
    return rows, spark.createDataFrame(rows, "g int, x long")


def test_shuffles(groups):
    """Forty seeds, groups of one to thirteen."""
    rows, df = groups
    got = {}
    for r in draws.shuffled(df, "g", ["x"], "x", F.col("g") * 977).orderBy("g", "position").collect():
        got.setdefault(r.g, []).append(r.x)
    assert got == {g: shuffle([x for h, x in rows if h == g], numbers_of(g * 977)) for g in range(40)}
    first = {r.g: r.x for r in draws.picked(df, "g", ["x"], "x", F.col("g") * 977).collect()}
    assert first == {g: items[int(next(numbers_of(g * 977)) * len(items))] for g in range(40) for items in [[x for h, x in rows if h == g]]}


def test_rows_around(groups):
    rows, df = groups
    got = {}
    for r in draws.rows_around(df, "g", ["x"], "x", F.col("x") % 100 == 1, F.col("x") % 3 == 0, F.col("g") + 5, 6).orderBy("g", "position").collect():
        got.setdefault(r.g, []).append(r.x)
    for g in range(40):
        every = [x for h, x in rows if h == g]
        if g * 100 + 1 not in every:
            assert g not in got
            continue
        rnd, others = numbers_of(g + 5), []
        for some in ([x for x in every if x % 3 == 0], every):
            others += shuffle([x for x in some if x % 100 != 1 and x not in others], rnd)[: 5 - len(others)]
        assert got[g] == [*others[: len(others) // 2], g * 100 + 1, *others[len(others) // 2 :]]


def test_bar_codes():
    rng = random.Random(2)
    assert barcodes.line_codes(np.full(300, 90)) == [] == barcodes.line_codes(np.empty(0, int))
    widths = [[int(c) for c in w] for w in barcodes.WIDTHS]
    for _ in range(60):
        d = [rng.randrange(10) for _ in range(12)]
        d.append(-sum(x * (3 if i % 2 else 1) for i, x in enumerate(d)) % 10)
        runs = [9, 1, 1, 1, *[w for s, x in zip(barcodes.SETS[d[0]], d[1:7], strict=True) for w in (widths[x] if s == "L" else widths[x][::-1])], 1, 1, 1, 1, 1, *[w for x in d[7:] for w in widths[x]], 1, 1, 1, 9]
        line = np.concatenate([np.full(round(w * 3.4), 200 if i % 2 == 0 else 30) for i, w in enumerate(runs)]) + np.array([rng.randrange(-12, 12) for _ in range(sum(round(w * 3.4) for w in runs))])
        code = "".join(map(str, d))
        assert barcodes.line_codes(line) == [code] == barcodes.line_codes(line[::-1])
        broken = line.copy()
        broken[len(line) // 3 : len(line) // 3 + 14] = 30
        assert code not in barcodes.line_codes(broken)


def test_shift_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.normal(0, 1, 24), rng.normal(0, 1, 24)
        d = int(rng.integers(-9, 10))
        b[max(0, d) : 24 + min(0, d)] = a[max(0, -d) : 24 - max(0, d)]
        scores = {}
        for s in range(-18, 19):
            at = [x for x in range(24) if 0 <= x - s < 24]
            parts = [0.0, 0.0, 0.0]
            for weight, f in ((1, lambda v: v), (3, lambda v: np.concatenate(([0], (v[2:] - v[:-2]) / 2, [0])))):
                p, q = f(a)[[x - s for x in at]], f(b)[at]
                p, q = p - p.mean(), q - q.mean()
                parts = [o + weight * (u * v).sum() for o, (u, v) in zip(parts, ((p, q), (p, p), (q, q)), strict=True)]
            scores[s] = parts[0] / np.sqrt(parts[1] * parts[2] + 1e-9)
        best = max(scores, key=lambda s: scores[s])
        got = motion.estimate(a, b)
        assert got[0] == best and abs(got[1] - scores[best]) < 1e-9 and -1e-9 <= got[2] <= 2
    assert motion.estimate(np.ones(3), np.ones(3)) is None


def test_few_pairs(spark):
    rows = [(1, 0.0, 5.0), (2, 0.0, 5.0), (2, 10.0, 16.0), (3, 0.0, 1.0), (3, 1.0, 2.0), (3, 2.0, 9.0)]
    got = {r.g: (r.s, r.d, r.matches) for r in motion.robust_lines(spark.createDataFrame(rows, "g int, x double, y double"), "g").collect()}
    assert got == {2: (1.0, 5.5, 2), 3: (1.0, 1.0, 3)}


def test_answers(spark):
    """The same rows however they are dealt, and as a plain walk over the batches gives them."""
    rows = [(str(i), f"g{i % 3}", i, f"N{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "id string, grp string, i int, name string")
    got = [sorted(map(tuple, asking.answered(d, "grp", ["i"], media.moody, 7).collect()), key=lambda r: int(r[0])) for d in (df, df.repartition(7).orderBy(F.rand(3)))]
    want = {}
    for g in range(3):
        mine = [dict(id=r[0], grp=r[1], i=r[2], name=r[3]) for r in rows if r[1] == f"g{g}"]
        for k in range(0, len(mine), 7):
            left, attempt, error = mine[k : k + 7], 0, None
            for _ in range(2):  # all of a batch, then what is missing
                for _ in range(2):
                    attempt += 1
                    try:
                        said = media.moody(left, attempt)
                        error = None
                        break
                    except TimeoutError as e:
                        said, error = [], f"TimeoutError: {e}"
                for r in left:
                    mine_said = [a for i, a in said if i == r["id"]]
                    want[r["id"]] = (mine_said[0] if mine_said else None, attempt, None if mine_said else error)
                left = [r for r in left if want[r["id"]][0] is None]
                if error or not left:
                    break
    assert got[0] == got[1] == [(r[0], *want[r[0]]) for r in rows]
    assert any(w[2] for w in want.values()) and any(w[1] > 2 for w in want.values())
    yes = asking.same_or_not(df, spark.createDataFrame([("1", " Igen"), ("2", "no"), ("999", "yes")], "id string, answer string"))
    assert [r.id for r in yes.where("same").collect()] == ["1"]


def test_cuts_of_one_profile(spark):
    """Cuts whose steepest slope lies at an end: they agree wholly once slopes that only one side has are left out."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        v = rng.normal(0, 0.1, 64)
        v[8:11] = (-3.0, 0.0, 3.0)
        rows.append((i, i % 13 - 6, v[8:58].tolist(), v[8 - (i % 13 - 6) : 58 - (i % 13 - 6)].tolist()))
    got = spark.createDataFrame(rows, "i int, d int, a array<double>, b array<double>").select("d", motion.shift_of_cuts("a", "b").alias("m")).collect()
    assert all(r.m.shift == r.d and r.m.score > 1 - 1e-6 for r in got)
    assert any(motion.estimate(np.array(a), np.array(b))[1] < 0.9 for _, d, a, b in rows)


def plain_line(pairs, rounds=2):
    """(s, d, n) of one group by the definition."""
    def fit(p):
        x, y = np.array(p).T
        v = x.var()
        s = ((x - x.mean()) * (y - y.mean())).mean() / v if v * len(x) > 1e-6 else 1.0
        s = s if 0.9 < s < 1.1 else 1.0
        return s, y.mean() - s * x.mean()

    for _ in range(rounds):
        s, d = fit(pairs)
        off = [abs(y - (s * x + d)) for x, y in pairs]
        kept = [p for p, r in zip(pairs, off, strict=True) if r <= max(6.0, 2.5 * float(np.median(off)))]
        pairs = kept if len(kept) >= 4 else pairs
    return (*fit(pairs), len(pairs))


def test_lines_of_many_groups_in_one_shuffle(spark):
    rng = random.Random(8)
    rows = [(g, float(x), x * 1.02 + rng.gauss(0, 2) + (300 if rng.random() < 0.2 else 0)) for g in range(50) for x in rng.sample(range(500), 4 + g % 9)]
    out = motion.robust_lines(spark.createDataFrame(rows, "g int, x double, y double"), "g")
    for r in out.collect():
        s, d, n = plain_line([p[1:] for p in rows if p[0] == r.g])
        assert abs(r.s - s) < 1e-9 and abs(r.d - d) < 1e-6 and r.matches == n
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_many_lines_at_once():
    """Lines of all kinds read together give what each gives alone; a code between others, lines of one grey, empty ones."""
    rng = random.Random(4)
    widths = [[int(c) for c in w] for w in barcodes.WIDTHS]

    def line(d):
        runs = [9, 1, 1, 1, *[w for s, x in zip(barcodes.SETS[d[0]], d[1:7], strict=True) for w in (widths[x] if s == "L" else widths[x][::-1])], 1, 1, 1, 1, 1, *[w for x in d[7:] for w in widths[x]], 1, 1, 1, 9]
        return np.concatenate([np.full(w * 2, 230 if i % 2 == 0 else 20) for i, w in enumerate(runs)])

    lines, want = [np.empty(0, int), np.full(99, 7)], [[], []]
    for n in (1, 2, 1, 3):
        codes = []
        for _ in range(n):
            d = [rng.randrange(10) for _ in range(12)]
            codes.append([*d, -sum(x * (3 if i % 2 else 1) for i, x in enumerate(d)) % 10])
        whole = np.concatenate([line(d) for d in codes])
        text = ["".join(map(str, d)) for d in codes]
        lines += [whole, np.full(40, 128), whole[::-1]]
        want += [text, [], text]
    assert barcodes.lines_codes(lines) == want == [barcodes.line_codes(x) for x in lines]
    assert barcodes.lines_codes([]) == [] and barcodes.lines_codes([np.arange(5)]) == [[]]


def test_groups_across_batches(spark):
    """Batches of three rows: groups are cut by them and come out as from one batch, null as a group of its own."""
    rows = [(g if g else None, g * 100 + i) for g in range(12) for i in range(1 + g * 3 % 8)]
    df = spark.createDataFrame(rows, "g int, x long")
    seed = F.coalesce("g", F.lit(0)) * 977
    run = lambda: [sorted(map(tuple, d.collect()), key=str) for d in (draws.shuffled(df, "g", ["x"], "x", seed), draws.rows_around(df, "g", ["x"], "x", F.col("x") % 100 == 0, F.col("x") % 3 == 0, seed, 4))]
    want = run()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert run() == want and len(want[0]) == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls = [part["_i"].tolist() for part, _ in draws.whole_groups(iter([pd.DataFrame({"_i": [0, 1, 0, 0, 1]}), pd.DataFrame({"_i": [2, 0]})]), 0)]
    assert calls == [[0, 1, 0], [0, 1, 2], [0]]  # many groups a call
