"""Queries of the write path: books from ``part`` and ``orders``, detections from ``lineitem``; the books after each step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import writes
from vellum.storage import shared_dir, staged, table
from vellum.tableset import TableSet

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Column of a book: expression over ``part`` that Spark and DuckDB read alike.
_BOOK = {
    "id": "p_partkey", "collection": "p_partkey % 7", "title": "p_name", "author": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END", "publisher": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END",
    "origin": "CASE WHEN p_partkey % 10 = 0 THEN 'manual' ELSE 'video' END", "confidence": "CAST(p_size / 60.0 AS DOUBLE)", "needs_review": "p_size < 20", "reviewed": "p_partkey % 6 = 1", "detections": "p_partkey % 5 + 1",
    "first_source": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 9 END", "shelf": "p_partkey * 3", "tags": "CASE WHEN p_partkey % 2 = 0 THEN 'attic' ELSE '' END", "edited": "CASE WHEN p_partkey % 6 = 0 THEN 'author' ELSE '' END",
    "duplicate_of": "CASE WHEN p_partkey % 11 = 5 THEN p_partkey - 3 WHEN p_partkey % 11 = 6 THEN p_partkey - 1 END", "best": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey * 1000 END", "copies": "CAST(1 AS INT)",
}
_LISTS = ("tags", "edited")
_SQL = "WITH b AS (SELECT " + ", ".join(f"CASE WHEN ({e}) = '' THEN [] ELSE [{e}] END AS {c}" if c in _LISTS else f"{e} AS {c}" for c, e in _BOOK.items()) + """ FROM part),
d AS (SELECT l_orderkey * 16 + l_linenumber AS id, min(l_suppkey) AS source, min(l_partkey) AS part, min(l_discount) AS discount FROM lineitem GROUP BY 1)
"""
_SHOWN = ["id", "collection", "title", "author", "publisher", "origin", "confidence", "needs_review", "reviewed", "detections", "first_source", "shelf", "duplicate_of", "best", "copies"]
_COLUMNS = ", ".join(_SHOWN)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c, e: F.filter(F.array(F.expr(e)), lambda x: x != "").alias(c)
    books = table(spark, sf_dir, "part").select(*[one(c, e) if c in _LISTS else F.expr(e).alias(c) for c, e in _BOOK.items()], "p_size")
    # Spark divides by 60.0 in decimals of six places, DuckDB in doubles.
    return books.withColumn("confidence", F.col("p_size") / F.lit(60.0)).drop("p_size")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id")).agg(F.min("l_suppkey").alias("source"), F.min("l_partkey").alias("part"), F.min("l_discount").alias("discount"))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the lines belong to their part."""
    return _lines(spark, sf_dir).select("id", "source", F.when(F.col("id") % 3 != 0, F.col("part")).alias("book_id"))


def _shown(books: DataFrame) -> DataFrame:
    return books.select(*_SHOWN, F.array_join(F.array_sort("tags"), ",").alias("tags"), F.array_join(F.array_sort("edited"), ",").alias("edited"))


_LISTED = "array_to_string(list_sort(tags), ',') AS tags, array_to_string(list_sort(edited), ',') AS edited"


@query(_SQL + f""", n AS (SELECT o_orderkey + 100000000 AS id, o_custkey % 9 AS collection, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS author FROM orders),
e AS (SELECT collection, count(*) AS n, max(shelf) AS last FROM b GROUP BY 1), p AS (SELECT n.*, row_number() OVER (PARTITION BY n.collection ORDER BY id) AS i, coalesce(e.n, 0) AS n0, coalesce(last, -1) AS last FROM n LEFT JOIN e USING (collection))
SELECT {_COLUMNS}, {_LISTED} FROM b UNION ALL SELECT id, collection, title, author, NULL, 'manual', 1.0, FALSE, TRUE, 0, NULL, last + i, NULL, NULL, 1, '', CASE WHEN author IS NULL THEN 'title' ELSE 'author,title' END FROM p WHERE n0 + i <= 150""")
def books_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as books that owners add; a collection has room for 150."""
    o = table(spark, sf_dir, "orders")
    new = o.select((F.col("o_orderkey") + 100_000_000).alias("id"), (F.col("o_custkey") % 9).alias("collection"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("author"), F.lit(None).cast("string").alias("publisher"))
    return _shown(writes.appended(_books(spark, sf_dir), new, 150))


@query(_SQL + f""", p AS (SELECT *, id % 2 = 0 AS hit, id % 4 = 0 AS t, id % 6 = 0 AS au, id % 8 = 0 AS r, id % 16 = 0 AS nr, CASE WHEN id % 12 = 0 THEN title ELSE upper(title) END AS nt, CASE WHEN id % 24 = 0 THEN NULL ELSE 'Anon' END AS na FROM b)
SELECT id, collection, CASE WHEN t THEN nt ELSE title END AS title, CASE WHEN au THEN na ELSE author END AS author, publisher, origin, confidence, CASE WHEN nr THEN TRUE WHEN r THEN FALSE ELSE needs_review END AS needs_review, CASE WHEN r THEN TRUE ELSE reviewed END AS reviewed, detections, first_source, shelf, duplicate_of, best, copies,
array_to_string(list_sort(tags), ',') AS tags, array_to_string(list_sort(list_distinct(list_concat(edited, CASE WHEN t AND nt IS DISTINCT FROM title THEN ['title'] ELSE [] END, CASE WHEN au AND na IS DISTINCT FROM author THEN ['author'] ELSE [] END))), ',') AS edited FROM p""")
def books_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second book gets a patch: titles in capitals (some as they were), authors, reviews."""
    books = _books(spark, sf_dir)
    fields = F.filter(F.array(*[F.when(F.col("id") % n == 0, F.lit(c)) for c, n in (("title", 4), ("author", 6), ("reviewed", 8), ("needs_review", 16))]), lambda f: f.isNotNull())
    patches = books.where("id % 2 = 0").select(
        "id", fields.alias("fields"), F.when(F.col("id") % 12 == 0, F.col("title")).otherwise(F.upper("title")).alias("title"), F.when(F.col("id") % 24 != 0, "Anon").alias("author"), F.lit(None).cast("string").alias("publisher"), F.lit(True).alias("needs_review"), F.lit(True).alias("reviewed"), F.lit(None).cast("int").alias("copies"),
    )
    return _shown(writes.patched(books, patches))


_FOUND = """, f AS (SELECT 1000000000 + source * 100000 + part AS record, source % 9 AS collection, source, part AS place, max('Part ' || part) AS title, CASE WHEN part % 5 = 0 THEN NULL ELSE 'Writer ' || source % 4 END AS author, CASE WHEN part % 2 = 0 THEN 'House' END AS publisher, round(1 - min(discount) * 5, 6) AS confidence, part % 4 = 0 AS needs_review, min(id) AS best, CASE WHEN part % 2 = 1 THEN part END AS matched, count(*) AS n FROM d GROUP BY source, part)"""


@query(_SQL + _FOUND + f""", z AS (SELECT collection, count(*) AS size FROM b GROUP BY 1), w AS (SELECT f.*, row_number() OVER (PARTITION BY f.collection ORDER BY source, place, record) AS i, coalesce(size, 0) AS size FROM f LEFT JOIN z USING (collection) WHERE matched IS NULL),
k AS (SELECT matched AS id, sum(n) AS n, max(confidence) AS c, arg_max(best, (confidence, -source, -place)) AS kb, bool_and(needs_review) AS open, min(source) AS s, arg_min(author, (source, place, record)) FILTER (author IS NOT NULL) AS a, arg_min(publisher, (source, place, record)) FILTER (publisher IS NOT NULL) AS p, list_distinct(flatten(list(CASE WHEN source % 3 = 0 THEN ['room ' || source % 2] ELSE [] END))) AS t FROM f WHERE matched IS NOT NULL GROUP BY 1)
SELECT b.id, collection, title, CASE WHEN author IS NULL AND NOT list_contains(edited, 'author') THEN a ELSE author END AS author, coalesce(publisher, p) AS publisher, origin, CASE WHEN c > confidence THEN c ELSE confidence END AS confidence, CASE WHEN k.id IS NOT NULL AND NOT reviewed AND NOT open THEN FALSE ELSE needs_review END AS needs_review, reviewed,
CAST(detections + coalesce(k.n, 0) AS BIGINT) AS detections, coalesce(first_source, s) AS first_source, shelf, duplicate_of, CASE WHEN k.id IS NOT NULL AND (c > confidence OR best IS NULL) THEN kb ELSE best END AS best, copies, array_to_string(list_sort(list_distinct(list_concat(tags, coalesce(t, [])))), ',') AS tags, array_to_string(edited, ',') AS edited FROM b LEFT JOIN k ON k.id = b.id
UNION ALL SELECT record, collection, title, author, publisher, 'video', confidence, needs_review, FALSE, n, source, source * 100000 + place, NULL, best, 1, CASE WHEN source % 3 = 0 THEN 'room ' || source % 2 ELSE '' END, '' FROM w WHERE size + i <= 400""")
def recordings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as recordings, their parts as records; odd parts are known books.  The change is committed and read back."""
    lines = _lines(spark, sf_dir)
    record = 1_000_000_000 + F.col("source") * 100_000 + F.col("part")
    found = lines.groupBy("source", "part").agg(F.round(1 - F.min("discount") * 5, 6).alias("confidence"), F.min("id").alias("best")).select(
        record.alias("record"), (F.col("source") % 9).alias("collection"), "source", F.col("part").alias("place"), F.concat(F.lit("Part "), "part").alias("title"), F.when(F.col("part") % 5 != 0, F.concat(F.lit("Writer "), F.col("source") % 4)).alias("author"),
        F.when(F.col("part") % 2 == 0, "House").alias("publisher"), "confidence", (F.col("part") % 4 == 0).alias("needs_review"), "best", F.when(F.col("part") % 2 == 1, F.col("part")).alias("matched"),
    )
    readings = lines.select("source", record.alias("record"), F.col("id").alias("detection"))
    tags = lines.select("source").distinct().select("source", F.when(F.col("source") % 3 == 0, F.array(F.concat(F.lit("room "), F.col("source") % 2))).otherwise(F.array().cast("array<string>")).alias("tags"))
    tables = TableSet(spark, f"{shared_dir(spark)}/books-{uuid.uuid4().hex}")
    tables.commit({"books": _books(spark, sf_dir), "detections": _detections(spark, sf_dir)})
    tables.commit(writes.merged(tables.read("books"), tables.read("detections"), staged(found), readings, tags, 400))
    return _shown(tables.read("books"))


_SETTLED = """, a AS (SELECT id, duplicate_of, CASE id % 3 WHEN 0 THEN 'different' WHEN 1 THEN 'same' ELSE 'copy' END AS answer FROM b WHERE duplicate_of IS NOT NULL), m AS (SELECT * FROM a WHERE answer <> 'different'),
p AS (SELECT * FROM m WHERE duplicate_of NOT IN (SELECT id FROM m) AND duplicate_of IN (SELECT id FROM b)),
g AS (SELECT p.duplicate_of AS id, arg_min(author, b.id) FILTER (author IS NOT NULL) AS a, arg_min(publisher, b.id) FILTER (publisher IS NOT NULL) AS u, arg_min(best, b.id) FILTER (best IS NOT NULL) AS e, sum(detections) AS n, count(*) FILTER (answer = 'copy') AS c, list_distinct(flatten(list(tags))) AS t FROM p JOIN b USING (id) GROUP BY 1)"""


@query(_SQL + _SETTLED + """ SELECT b.id, collection, title, coalesce(author, a) AS author, coalesce(publisher, u) AS publisher, origin, confidence, needs_review, reviewed, CAST(detections + coalesce(n, 0) AS BIGINT) AS detections, first_source, shelf,
CASE WHEN b.id IN (SELECT id FROM a WHERE answer = 'different') THEN NULL ELSE duplicate_of END AS duplicate_of, coalesce(best, e) AS best, CAST(copies + coalesce(c, 0) AS INT) AS copies, array_to_string(list_sort(list_distinct(list_concat(tags, coalesce(t, [])))), ',') AS tags, array_to_string(edited, ',') AS edited
FROM b LEFT JOIN g ON g.id = b.id WHERE b.id NOT IN (SELECT id FROM p)""")
def duplicates_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners answer on every book that may be a duplicate."""
    books = _books(spark, sf_dir)
    answers = books.select("id", F.when(F.col("id") % 3 == 0, "different").when(F.col("id") % 3 == 1, "same").otherwise("copy").alias("answer"))
    return _shown(writes.duplicates_settled(books, _detections(spark, sf_dir), answers)["books"])


@query(_SQL + _SETTLED + """ SELECT d.id, source, coalesce(p.duplicate_of, part) AS book_id FROM (SELECT id, source, CASE WHEN id % 3 <> 0 THEN part END AS part FROM d) d LEFT JOIN p ON p.id = d.part""")
def evidence_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections after the owners' answers."""
    books = _books(spark, sf_dir)
    answers = books.select("id", F.when(F.col("id") % 3 == 0, "different").when(F.col("id") % 3 == 1, "same").otherwise("copy").alias("answer"))
    return writes.duplicates_settled(books, _detections(spark, sf_dir), answers)["detections"]


@query(_SQL + f""", e AS (SELECT id, source, CASE WHEN id % 3 <> 0 THEN part END AS book FROM d), h AS (SELECT DISTINCT book FROM e WHERE source % 2 = 0 AND book IS NOT NULL), l AS (SELECT book, count(*) AS n FROM e WHERE source % 2 <> 0 GROUP BY 1),
r AS (SELECT b.*, h.book IS NOT NULL AS hit, n, CASE WHEN id % 7 = 0 THEN (SELECT min(id) FROM e WHERE e.book = b.id) ELSE best END AS best2 FROM b LEFT JOIN h ON h.book = b.id LEFT JOIN l ON l.book = b.id)
SELECT id, collection, title, author, publisher, origin, confidence, needs_review, reviewed, CASE WHEN hit THEN greatest(1, coalesce(n, 0)) ELSE detections END AS detections, first_source, shelf, duplicate_of,
CASE WHEN hit AND best2 IN (SELECT id FROM e WHERE source % 2 = 0) THEN NULL ELSE best2 END AS best, copies, {_LISTED} FROM r WHERE NOT (hit AND n IS NULL AND origin <> 'manual' AND NOT reviewed)""")
def results_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of every second supplier go; some books point to their first detection as best evidence."""
    detections = _detections(spark, sf_dir)
    least = detections.groupBy(F.col("book_id").alias("id")).agg(F.min(detections["id"]).alias("_d"))
    books = _books(spark, sf_dir).join(least, "id", "left").withColumn("best", F.when(F.col("id") % 7 == 0, F.col("_d")).otherwise(F.col("best"))).drop("_d")
    return _shown(writes.reset(books, detections, detections.where("source % 2 = 0").select("source"))["books"])
