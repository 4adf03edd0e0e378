"""Persons, boxes, answers and matches: golden values and plain-Python versions."""

import json

from pyspark.sql import functions as F

from tests.test_catalogue import all_of
from vellum.functions import answers, boxes, names
from vellum.operators import matching

LOCAL, FOREIGN, FAMILIES = ["magda", "peter", "geza", "eva"], ["elena", "henri", "terry", "thomas"], ["szabo", "esterhazy"]


def test_persons(spark):
    given = ["Esterházy Péter", "Péter Esterházy", "Elena Ferrante", "H. Perruchot", "Perruchot, Henri", "Esterházy P.", "J. R. R. Tolkien", "García Márquez, Gabriel", "Dylan Thomas", "Homer", ""]
    p = names.person(F.col("a"), LOCAL, FOREIGN, FAMILIES)
    out = all_of(spark, names.let(p, lambda x: F.to_json(x)), *[(g,) for g in given])
    first = [json.loads(x)["family_first"] if x else None for x in out]
    assert first == [True, False, False, False, True, True, False, True, False, True, None]
    keys = all_of(spark, names.sort_key(F.col("a"), LOCAL, FOREIGN, FAMILIES), *[(g,) for g in given])
    assert keys[:5] == ["esterhazy peter", "esterhazy peter", "ferrante elena", "perruchot", "perruchot henri"]
    assert all_of(spark, names.local_order(F.col("a"), LOCAL), ("Magda Szabó",), ("Szabó Magda",), ("A B C",)) == ["Szabó Magda", "Szabó Magda", "A B C"]


def test_compatible_authors(spark):
    pairs = [("H. Perruchot", "Henri Perruchot"), ("Szabó Magda", "Magda Szabó"), ("Lev Tolsztoj", "Leo Tolstoy"), ("Kiss Géza", "Nagy Géza"), (None, "A B"), ("A Kovács; B Lem", "Stanisław Lem")]
    assert all_of(spark, names.authors_compatible(F.col("a"), F.col("b"), LOCAL, FOREIGN, FAMILIES), *pairs) == [True, True, True, False, True, True]


def test_boxes(spark):
    rows = [(0.9, 0.1, 0.1, 0.5), (-5.0, 10.0, 2000.0, 300.4), (10.0, 10.0, 11.0, 50.0), (float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x0 double, y0 double, x1 double, y1 double").withColumn("b", F.struct("x0", "y0", "x1", "y1"))
    out = [tuple(r.n) if r.n else None for r in df.select("i", boxes.normal(F.col("b"), F.lit(1000), F.lit(800)).alias("n")).orderBy("i").collect()]
    assert out == [(100, 80, 900, 400), (0, 10, 1000, 300), None, None]
    crops = [tuple(r.c) if r.c else None for r in df.where("i = 1 or i = 2").select("i", boxes.crop(F.col("b"), F.lit(1000), F.lit(800), 0.1, 8).alias("c")).orderBy("i").collect()]
    assert crops == [(0, 0, 1000, 330), None]
    a, b = (F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1"), strict=True)]) for x in ((0, 0, 10, 10), (5, 0, 15, 10)))
    assert abs(spark.range(1).select(boxes.overlap(a, b)).first()[0] - 50 / 150) < 1e-9
    assert tuple(spark.range(1).select(*boxes.unit_scale(F.lit(1080.0), F.lit(900.0), F.lit(1080), F.lit(1920))).first()) == (1.0, 1.92)


def test_answers(spark):
    said = [("```json\n{\"a\": [1]}\n```",), ("first {\"a\": [1]} then {\"a\": [2], \"b\": \"}\"}",), ("[1] [2, 3]",), ("nothing { here",), (None,), ("",)]
    assert [json.loads(x) if x else None for x in all_of(spark, answers.json_of(F.col("a")), *said)] == [{"a": [1]}, {"a": [1, 2], "b": "}"}, [1, 2, 3], None, None, None]
    assert all_of(spark, answers.clean(F.col("a"), 8), ("  a \n b ",), ("N/A",), ("long text here",), (None,)) == ["a b", None, "long te…", None]
    rows = spark.createDataFrame([("x", 1, "no"), ("x", 0, "YES"), ("y", 0, "0")], "k string, place int, ok string").withColumn("ok", answers.truth(F.col("ok")))
    asked = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    assert {tuple(r) for r in answers.answered(asked, rows, "k", "ok").collect()} == {("x", True), ("y", False), ("z", False)}


def test_known_records_are_adopted_once(spark):
    new = spark.createDataFrame([(1, "The Red River Stories", "A"), (2, "Red River Storys", None), (3, "Something else", None), (4, "Volume 1", "A")], "id int, title string, author string")
    known = spark.createDataFrame([(10, "Red River Stories", "A"), (11, "Volume 2", "A")], "id int, title string, author string")
    found = matching.existing_matches(new, known, F.lit(True))
    assert {(r.id, r.known, r.strong) for r in found.collect()} == {(1, 10, True), (2, 10, False)}
    assert [(r.id, r.known, r.score) for r in matching.adopted(found).collect()] == [(1, 10, 1.0)]
    q = matching.match_quality(new, known.where("id = 10")).first()
    assert (q.truth, q.found, q.matched, q.exact, q.precision, q.recall) == (4, 1, 1, 1, 1.0, 0.25)


def test_crowded_places(spark):
    """Few places, many records of one title and author: the first ones by score, shelf and id, as over all pairs; null shelves and authors."""
    rows = [(i, ("red ring", "red rings", "blue bolt")[i % 3], ("A", "B", None)[i % 4 % 3], None if i % 29 == 0 else i * 7 % 41) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, title string, author string, shelf long")
    agree = F.col("author").isNull() | F.col("author2").isNull() | (F.col("author") == F.col("author2"))
    got = {}
    for r in matching.merge_candidates(df, df, agree, 5).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.other, r.score))
    edit = {("red ring", "red rings"): 1 - 1 / 9, ("red rings", "red ring"): 1 - 1 / 9}
    for i, t, a, p in rows:
        met = []
        for j, u, b, q in rows:
            s = 1.0 if t == u else edit.get((t, u), 0.0)
            if i != j and s and (a is None or b is None or a == b):
                d = None if p is None or q is None else abs(p - q)
                met.append((-round(s + (0.12 if a and b else 0.0) + (0.0 if d is None else 0.08 if d <= 3 else 0.04 if d <= 12 else 0.0), 9), q is not None, q or 0, j))
        assert got.get(i, []) == [(m[3], -m[0]) for m in sorted(met)[:5]]


def test_records_are_not_broadcast(spark):
    """Whatever the size of their files: what has a row a record or place never goes through the driver."""
    rows = [(i, ("red ring", "red rings")[i % 2], "A", i % 41) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, author string, shelf long")
    plan = matching.merge_candidates(df, df, F.col("author") == F.col("author2"))._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next(i for i, c in enumerate(line) if c.isalpha()) if any(map(str.isalpha, line)) else 0 for line in plan]
    sent = []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            sent += [x for x in plan[i:end] if "FileScan" in x]
    assert any("SortMergeJoin" in line for line in plan) and not [x for x in sent if "shelf" in x]
