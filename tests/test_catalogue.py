"""Names, catalogue, queue, changes and runs: golden values and plain-Python versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import names, numbers, text
from vellum.operators import catalogue, changes, runs
from vellum.sources import export
from vellum.streaming import queue


def all_of(spark, column, *rows):
    """``column`` over rows of strings a, b, c."""
    df = spark.createDataFrame([(i, *r, *[None] * (3 - len(r))) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_sort_names(spark):
    rows = [("Elena Ferrante", "ferrante elena"), ("J.R.R. Tolkien", "tolkien j r r"), ("Nemes Nagy Ágnes", "nemes nagy agnes"), ("Gabriel García Márquez; X Y", "garcia marquez gabriel"), ("A B", "other name"), (None, "Ady Endre"), ("Solo", None), (None, None)]
    assert all_of(spark, names.sort_name(F.col("a"), F.col("b")), *rows) == ["Ferrante Elena", "Tolkien J R R", "Nemes Nagy Ágnes", "García Márquez Gabriel", "other name", "ady endre", "Solo", None]
    assert all_of(spark, names.family_name(F.col("a"), F.col("b")), *rows) == ["Ferrante", "Tolkien", "Nemes Nagy", "García Márquez", "A B", None, "Solo", None]


def test_guessed_names_and_letters(spark):
    rows = [("Terry Pratchett", "hu", "GB"), ("Szabó Magda", "en", "hu"), ("Agatha Christie", "hu", None), ("Agatha Christie", "en", " "), ("Homer", None, None)]
    assert all_of(spark, names.guessed_sort_name(F.col("a"), F.col("b"), F.col("c")), *rows) == ["Pratchett Terry", "Szabó Magda", "Agatha Christie", "Christie Agatha", "Homer"]
    given = ["Csáth", "Dzsida", "Ácsi", "Őri", "„Zsolt”", "Østergård", "123", "", None, "ßa", "szép"]
    assert all_of(spark, names.index_letter(F.col("a")), *[(g,) for g in given]) == ["Cs", "Dzs", "Ács"[0].replace("Á", "A"), "O", "Zs", "O", "#", "#", "#", "S", "Sz"]
    assert all_of(spark, names.index_letter(F.col("a"), False), ("Csáth",)) == ["C"]
    order = all_of(spark, names.letter_order(F.col("a")), *[(x,) for x in ["A", "C", "Cs", "D", "Zs", "Ж", "#"]])
    assert order == sorted(order) and len(set(order)) == len(order)


def test_cases(spark):
    caps = ["LENGYEL DÉNES", "VAN GOGH", "LUDWIG VAN BEETHOVEN", "O'NEILL-SMITH", "Mixed Name", "J", ""]
    assert all_of(spark, names.name_case(F.col("a")), *[(c,) for c in caps]) == ["Lengyel Dénes", "Van Gogh", "Ludwig van Beethoven", "O'Neill-Smith", "Mixed Name", "J", ""]
    titles = ["RÉGI MAGYAR MONDÁK", "A KÖNYV: MÁSODIK RÉSZ", "TÖRTÉNET II. KÖTET", "NEM! IGEN", "Kis Herceg", "XIV LAJOS"]
    assert all_of(spark, names.sentence_case(F.col("a")), *[(t,) for t in titles]) == ["Régi magyar mondák", "A könyv: Második rész", "Történet II. kötet", "Nem! Igen", "Kis Herceg", "XIV lajos"]


def test_family_likeness(spark):
    pairs = [("tolsztoj", "tolstoy"), ("csehov", "chekhov"), ("szabo", "szabo"), ("nagy", "kiss"), ("", "a")]
    out = all_of(spark, names.family_similarity(F.col("a"), F.col("b")), *pairs)
    assert out[0] >= 0.8 and out[1] >= 0.8 and out[2] == 1 and out[3] < 0.5 and out[4] == 0
    assert all_of(spark, names.is_title_prefix(F.col("a"), F.col("b")), ("seveneves", "seveneves het eva"), ("abc", "abc d"), ("same title", "same title")) == [True, False, False]
    assert all_of(spark, names.title_sort_name(F.col("a")), ("The Hobbit",), ("„A kőszívű ember",), ("L'Étranger",), ("A",), (None,)) == ["Hobbit", "kőszívű ember", "Étranger", "A", ""]
    assert all_of(spark, names.accents(F.col("a")), ("Árvíztűrő",), ("plain",), (None,)) == [4, 0, 0]
    assert all_of(spark, names.last_first(F.col("a")), ("Szabó Magda",), ("Nemes Nagy Ágnes",)) == ["Magda Szabó", "Ágnes Nemes Nagy"]


def test_collation(spark):
    words = ["zebra 10", "Árvíz", "arany", "zebra 9", "Zebra 9", "b"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    assert [r.a for r in df.orderBy(names.collation_key(F.col("a"))).collect()] == ["arany", "Árvíz", "b", "Zebra 9", "zebra 9", "zebra 10"]


def test_numbers(spark):
    assert all_of(spark, numbers.iso_valid(F.col("a")), ("2024-02-29",), ("2023-02-29",), ("2024-2-9",), (None,)) == [True, False, False, False]
    assert all_of(spark, numbers.language(F.col("a")), ("EN-gb",), (" hu ",), ("eng",), (None,)) == ["en", "hu", None, None]
    assert all_of(spark, numbers.flag(F.col("a")), ("hu",), ("x",)) == ["🇭🇺", ""]
    assert all_of(spark, numbers.clean_isbn(F.col("a")), ("978-963-07-9999-1",), ("0-306-40615-x",), ("12",), (None,)) == ["9789630799991", "030640615X", "", ""]
    assert all_of(spark, numbers.isbn10_from(F.col("a")), ("9780306406157",), ("9791234567896",)) == ["0306406152", None]
    assert all_of(spark, numbers.stars(F.col("a").cast("double")), ("3.4",), ("0",), ("9",), (None,)) == ["★★★☆☆", "", "★★★★★", ""]
    assert all_of(spark, numbers.nice_step(F.col("a").cast("double")), ("3",), ("23",), ("480",), ("0",)) == [1, 5, 100, 1]
    assert all_of(spark, numbers.calendar_day(F.col("a").cast("timestamp"), "Europe/Budapest"), ("2024-06-01 23:30:00",)) == ["2024-06-02"]
    assert [tuple(r) for r in spark.range(1).select(*numbers.split_days(F.lit(800.2))).collect()] == [(2, 71)]
    assert all_of(spark, numbers.clamp_confidence(F.col("a").cast("double")), ("0.4",), ("85",), ("1.5",), ("-1",), ("200",)) == [0.4, 0.85, 1.0, 0.0, 1.0]
    assert all(0 <= x < 1 for x in all_of(spark, numbers.hash01(F.col("a"), 3), ("a",), ("b",)))
    assert all_of(spark, text.split_authors(F.col("a")), ("A B; C & D + E",), ("R&D",), ("",), (None,)) == [["A B", "C", "D", "E"], ["R&D"], [], []]


def test_queue_steps(spark):
    jobs = spark.createDataFrame([(1, "t", "k", "queued", 0, 3, 9.0, None, None, None), (2, "t", None, "running", 3, 3, 1.0, 5.0, "w", None), (3, "t", "q", "running", 1, 3, 1.0, 5.0, "w", None), (4, "t", None, "queued", 0, 3, 2.0, None, None, None)], queue.JOB)
    asked = spark.createDataFrame([("t", "k", 1.0, 10), ("t", "q", 1.0, 11), ("t", "n", 2.0, 13), ("t", "n", 1.0, 12), ("t", None, 1.0, 14), ("t", None, 1.0, 15)], "type string, key string, at double, id long")
    assert {r.id for r in queue.accepted(jobs, asked).collect()} == {12, 14, 15}
    assert {r.id for r in queue.accepted(jobs, asked, queued_only=True).collect()} == {11, 12, 14, 15}
    assert {(r.id, r.run_at, r.created) for r in queue.ensured(jobs, asked.where("key is not null")).collect()} == {(1, 1.0, False), (11, 1.0, True), (12, 1.0, True)}
    taken = {r.id: (r.status, r.attempts, r.locked_by) for r in queue.claimed(jobs, 5.0, ["a", "b"]).collect()}
    assert taken[4] == ("running", 1, "a") and taken[1][0] == "queued"
    stale = {r.id: (r.status, r.error) for r in queue.reset_stale(jobs, 5000.0).collect()}
    assert stale[2][0] == "failed" and stale[3] == ("queued", None)
    assert {r.id: r.attempts for r in queue.requeued(jobs, "w", 7.0).collect()} == {1: 0, 2: 2, 3: 0, 4: 0}
    assert {r.status for r in queue.finished(jobs, jobs.select("id")).collect()} == {"done"}
    assert queue.purged(queue.finished(jobs, jobs.select("id")), "run_at", 1e6, 1).count() == 0


def test_alignment_is_best():
    """Against every way to match rising pairs."""
    rng = np.random.default_rng(3)

    def brute(s, least):
        best = 0.0
        m, n = s.shape
        for k in range(1, min(m, n) + 1):
            for i in itertools.combinations(range(m), k):
                for j in itertools.combinations(range(n), k):
                    got = [s[a, b] for a, b in zip(i, j, strict=True)]
                    if min(got) >= least:
                        best = max(best, sum(got))
        return best

    for _ in range(60):
        s = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        pairs = runs.aligned(s, 0.4)
        assert all(a < c and b < d for (a, b), (c, d) in itertools.pairwise(pairs)) and all(s[p] >= 0.4 for p in pairs)
        assert abs(sum(s[p] for p in pairs) - brute(s, 0.4)) < 1e-9


def test_frames_are_aligned(spark):
    titles = [f"{a} {b}" for a in ("red", "green", "blue") for b in ("river stories", "mountain tales", "harbour songs")]
    rows = [(1, f, f * 100 + i, i, t.replace("e", "c") if (f + i) % 4 == 0 else t) for f in range(3) for i, t in enumerate(titles[f : f + 6])]
    out = runs.align_frames(spark.createDataFrame(rows, "g int, frame int, id int, i int, title string"), "g", "frame", "i", "title").collect()
    assert {(r.a, r.b) for r in out} == {(f * 100 + i + 1, (f + 1) * 100 + i) for f in range(2) for i in range(5)}


def test_piles_and_budgets(spark):
    rng = random.Random(2)
    rows = [(g, i, float(rng.randint(1, 9))) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, h double")
    for out, room, count in ((runs.piled_up(df, "g", ["i"], "h", 20.0, 4), 20, 4), (runs.budgeted(df, "g", ["i"], "h", 15.0), 15, 99)):
        seen = {}
        for r in sorted(out.collect(), key=lambda r: (r.g, r.i)):
            h = rows[r.g * 40 + r.i][2]
            assert r["at"] == sum(seen.get((r.g, r.row), []))
            seen.setdefault((r.g, r.row), []).append(h)
        assert all(sum(v) <= room and len(v) <= count for v in seen.values())
        for (g, k), v in seen.items():  # the next one did not fit
            if (g, k + 1) in seen:
                assert sum(v) + seen[g, k + 1][0] > room or len(v) == count


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "secret"), (2, "=x", None)], "id int, title string, notes string")
    owner = F.col("id") == 2
    assert [r.n for r in df.select(export.visible(F.col("notes"), ~owner).alias("n"), "id").orderBy("id").collect()] == ["secret", None]
    assert {r.n for r in df.select(export.visible(F.col("notes"), F.lit(False)).alias("n")).collect()} == {None}
    export.write_csv(df.coalesce(1), ["id", "title"], str(tmp_path / "out"))
    assert b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*")) == b'id,title\r\n1,"a,b"\r\n2,\'=x\r\n'


def test_restored_and_removed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    left = changes.removed(df, "id", spark.createDataFrame([(2,)], "id int"))
    assert {r.id for r in left.collect()} == {1, 3}
    back = changes.upserted(left, spark.createDataFrame([(2, "b"), (3, "z")], "id int, v string"), "id")
    assert {tuple(r) for r in back.collect()} == {(1, "a"), (2, "b"), (3, "z")}


def test_recommendations_fall_back(spark):
    rows = [(1, "read", False), (2, "read", True), (3, "abandoned", False)]
    df = spark.createDataFrame(rows, "id int, status string, favourite boolean")
    assert [(r.id, r.tier) for r in catalogue.recommendation_pool(df).collect()] == [(3, 3)]
    assert [(r.id, r.tier) for r in catalogue.recommendation_pool(df.where("id < 3")).collect()] == [(2, 4)]
    assert catalogue.recommendation_pool(df.limit(0)).count() == 0


def test_seeded_numbers(spark):
    def plain(seed, n):
        out, m = [], (1 << 32) - 1
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) & m
            t = (seed ^ (seed >> 15)) * (seed | 1) & m
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & m)) & m
            out.append((t ^ (t >> 14)) / 2**32)
        return out

    for seed in (0, 1, 12345, 4294967295):
        got = [r.x for r in spark.range(1, 40, 1, 1).select(numbers.seeded(F.lit(seed), F.col("id")).alias("x")).collect()]
        assert got == plain(seed, 39)


def test_selections(spark):
    from vellum.operators import records

    ids = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(records.toggled(ids("a", "b"), ids("b")), records.toggled(ids("a"), ids("b", "a")), records.pruned(ids("a", "b"), ids("b", "c")), records.restored(ids("a", "d"), F.array(F.struct(F.lit(2).alias("at"), F.lit("c").alias("id")), F.struct(F.lit(1).alias("at"), F.lit("b").alias("id"))))).first()
    assert list(row) == [["a"], ["a", "b"], ["b"], ["a", "b", "c", "d"]]
