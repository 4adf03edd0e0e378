"""Tables that change as one: crashes, conflicts, old versions; and cases of the write path that the queries do not reach."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import writes
from vellum.tableset import Conflict, TableSet


@pytest.fixture()
def tables(spark, tmp_path):
    return TableSet(spark, f"file://{tmp_path}/set")


def test_all_or_nothing(spark, tables, monkeypatch):
    ids = lambda n: spark.range(n).toDF("id")
    assert tables.version() == 0 and tables.commit({"a": ids(3), "b": ids(5)}) == 1
    with pytest.raises(Exception, match="boom"):  # a table that cannot be written, after one that was
        tables.commit({"a": ids(7), "b": ids(2).select(F.raise_error(F.lit("boom")).alias("id"))})
    assert (tables.version(), tables.read("a").count(), tables.read("b").count()) == (1, 3, 5)
    monkeypatch.setattr(TableSet, "_swap", lambda *a: 1 / 0)  # the writer dies before the manifest
    with pytest.raises(ZeroDivisionError):
        tables.commit({"a": ids(9)})
    monkeypatch.undo()
    assert (tables.version(), tables.read("a").count()) == (1, 3)
    assert tables.commit({"b": tables.read("b").where("id < 2")}) == 2
    assert (tables.read("b").count(), tables.read("b", 1).count(), tables.read("a").count()) == (2, 5, 3)
    assert tables.vacuum(keep=1) == 4 and tables.read("b").count() == 2  # two drafts of a, one of b, the old b


def test_one_of_two_writers_wins(spark, tables):
    tables.commit({"a": spark.range(1).toDF("id")})
    seen = tables.version()
    tables.commit({"a": spark.range(2).toDF("id")}, seen)
    with pytest.raises(Conflict):
        tables.commit({"a": spark.range(3).toDF("id")}, seen)
    assert (tables.version(), tables.read("a").count()) == (2, 2)


def book(i, **more):
    row = dict(id=i, collection=1, title=f"T{i}", author=None, publisher=None, origin="video", confidence=0.5, needs_review=True, reviewed=False, detections=1, first_source=None, shelf=i, tags=None, edited=None, duplicate_of=None, best=None, copies=1)
    return tuple((row | more).values())


FOUND = "record long, collection long, source long, place int, title string, author string, publisher string, confidence double, needs_review boolean, best long, matched long"


def test_merge(spark):
    """Room for one; two records of a known book; an edited field; a detection that has its book; null tags."""
    books = spark.createDataFrame([book(1), book(2, author="Own", edited=["publisher"], reviewed=True, best=5)], writes.BOOK)
    detections = spark.createDataFrame([(i, 9, 2 if i == 13 else None) for i in range(10, 18)], "id long, source long, book_id long")
    found = [(100, 1, 9, 0, "N", "A", None, 0.9, False, 10, None), (101, 1, 9, 3, "M", "B", "P", 0.8, False, 12, 1), (102, 1, 9, 2, "M", None, "Q", 0.7, False, 13, 1), (103, 1, 9, 4, "O", None, "R", 0.4, False, 14, 2), (104, 1, 9, 5, "X", None, None, 0.4, True, 15, None)]
    readings = spark.createDataFrame([(100, 10), (101, 11), (101, 12), (102, 13), (103, 14), (104, 15)], "record long, detection long")
    out = writes.merged(books, detections, spark.createDataFrame(found, FOUND), readings, spark.createDataFrame([(9, ["loft"])], "source long, tags array<string>"), 3)
    b = {r.id: r for r in out["books"].collect()}
    assert sorted(b) == [1, 2, 100]
    assert (b[1].detections, b[1].confidence, b[1].best, b[1].author, b[1].publisher, b[1].needs_review, b[1].tags, b[1].first_source) == (4, 0.8, 12, "B", "Q", False, ["loft"], 9)
    assert (b[2].author, b[2].publisher, b[2].best, b[2].confidence, b[2].needs_review) == ("Own", None, 5, 0.5, True)
    assert (b[100].title, b[100].shelf, b[100].tags) == ("N", 900_000, ["loft"])
    assert {r.id: r.book_id for r in out["detections"].collect()} == {10: 100, 11: 1, 12: 1, 13: 2, 14: 2, 15: None, 16: None, 17: None}


def test_settled_and_empty(spark):
    """A chain of answers, an earlier book that is gone, no answers, empty tables."""
    books = spark.createDataFrame([book(1, best=None), book(2, duplicate_of=1, best=7, author="B", tags=["x"]), book(3, duplicate_of=2), book(4, duplicate_of=99), book(5, duplicate_of=1)], writes.BOOK)
    detections = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "id long, source long, book_id long")
    answers = spark.createDataFrame([(2, "copy"), (3, "same"), (4, "same"), (5, "different"), (1, "same")], "id long, answer string")
    out = writes.duplicates_settled(books, detections, answers)
    b = {r.id: r for r in out["books"].collect()}
    assert sorted(b) == [1, 3, 4, 5] and (b[1].author, b[1].best, b[1].copies, b[1].detections, b[1].tags) == ("B", 7, 2, 2, ["x"])
    assert (b[3].duplicate_of, b[4].duplicate_of, b[5].duplicate_of) == (2, 99, None)
    assert {r.id: r.book_id for r in out["detections"].collect()} == {1: 1, 2: 3}
    none = books.where("false")
    assert writes.duplicates_settled(none, detections, answers)["books"].count() == 0
    assert writes.reset(none, detections.where("false"), spark.createDataFrame([(1,)], "source long"))["books"].count() == 0
    assert writes.appended(none, none.select("id", "collection", "title", "author", "publisher"), 3).count() == 0


def test_records_of_two_recordings_with_one_number(spark):
    """Readings that name their recording count for it alone."""
    found = [(100, 1, 8, 0, "N", None, None, 0.9, False, 10, None), (100, 1, 9, 0, "M", None, None, 0.8, False, 12, 1)]
    readings = spark.createDataFrame([(8, 100, 10), (8, 100, 11), (9, 100, 12)], "source long, record long, detection long")
    detections = spark.createDataFrame([(i, 8 + (i > 11), None) for i in (10, 11, 12)], "id long, source long, book_id long")
    out = writes.merged(spark.createDataFrame([book(1)], writes.BOOK), detections, spark.createDataFrame(found, FOUND), readings, spark.createDataFrame([], "source long, tags array<string>"), 9)
    assert {r.id: r.detections for r in out["books"].collect()} == {1: 2, 100: 2}
    assert {r.id: r.book_id for r in out["detections"].collect()} == {10: 100, 11: 100, 12: 1}
