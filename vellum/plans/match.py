"""Queries that match records and read answers: known records, merge candidates, boxes, JSON in answers, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import answers, boxes, names
from vellum.operators import matching
from vellum.plans import library
from vellum.storage import table

QUERIES, ORACLE_SQL = {}, {}

LOCAL, FOREIGN = ["anna", "peter", "zsofia"], ["john", "emile"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their brand as author."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("author"), (F.col("p_partkey") * 7919 % 2003).alias("shelf"))


_TITLED = """WITH b AS (SELECT p_partkey AS id, lower(p_name) AS t, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS author, p_partkey * 7919 % 2003 AS shelf FROM part),
d AS (SELECT DISTINCT t FROM b), s AS (SELECT x.t, y.t AS u, 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) AS score FROM d x JOIN d y ON 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= {0})
"""


@query(_TITLED.format(0.85) + """SELECT x.id, y.id AS known, round(score, 9) AS score, true AS strong FROM b x JOIN s USING (t) JOIN b y ON y.t = s.u WHERE x.author = y.author AND x.id % 2 = 0 AND y.id % 2 = 1""")
def existing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second record as new, the others as known."""
    rows = _titled(spark, sf_dir)
    out = matching.existing_matches(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), F.col("author") == F.col("author2"))
    return out.withColumn("score", F.round("score", 9))


@query(_TITLED.format(0.6) + """, m AS (SELECT x.id, y.id AS other, y.shelf, round(score * 1.0 + 0.12 + CASE WHEN abs(x.shelf - y.shelf) <= 3 THEN 0.08 WHEN abs(x.shelf - y.shelf) <= 12 THEN 0.04 ELSE 0 END, 9) AS score
 FROM b x JOIN s USING (t) JOIN b y ON y.t = s.u WHERE x.id <> y.id AND x.author = y.author
 UNION ALL SELECT x.id, y.id, y.shelf, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) + 0.12 + 0.08, 9) FROM b x JOIN b y ON abs(x.shelf - y.shelf) <= 2 AND x.id <> y.id AND x.author = y.author AND 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.35 AND 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) < 0.6),
r AS (SELECT id, other, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, shelf, other) - 1 AS INT) AS place FROM m) SELECT * FROM r WHERE place < 8""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a reader is shown beside each one."""
    rows = _titled(spark, sf_dir)
    return matching.merge_candidates(rows, rows, F.col("author") == F.col("author2"))


@query("""WITH RECURSIVE o AS (SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY 1), x AS (SELECT id, lower(title) AS t FROM o WHERE id % 2 = 0), y AS (SELECT id AS other, lower(title) AS u FROM o WHERE id % 2 = 1),
p AS (SELECT id, other, score, row_number() OVER (ORDER BY score DESC, id, other) AS i FROM (SELECT id, other, 1 - levenshtein(t, u) / greatest(length(t), length(u)) AS score FROM x, y) WHERE score >= 0.75),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS e
UNION ALL SELECT j, CASE WHEN ok THEN list_append(ls, id) ELSE ls END, CASE WHEN ok THEN list_append(rs, other) ELSE rs END, m + CASE WHEN ok THEN 1 ELSE 0 END, e + CASE WHEN ok AND score = 1 THEN 1 ELSE 0 END FROM (SELECT w.*, p.id, p.other, p.score, p.i AS j, NOT list_contains(ls, p.id) AND NOT list_contains(rs, p.other) AS ok FROM w JOIN p ON p.i = w.i + 1) q)
SELECT (SELECT count(*) FROM x) AS truth, (SELECT count(*) FROM y) AS found, m AS matched, e AS exact, m / (SELECT count(*) FROM y) AS precision, m / (SELECT count(*) FROM x) AS recall FROM w ORDER BY i DESC LIMIT 1""")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles in two halves, as true and as found ones."""
    rows = _titled(spark, sf_dir).groupBy("title").agg(F.min("id").alias("id"))
    return matching.match_quality(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.75)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_discount ELSE l_partkey END AS x0, CASE WHEN l_linenumber = 1 THEN 0.5 ELSE l_suppkey END AS y0,
 CASE WHEN l_linenumber = 1 THEN 0.9 ELSE l_partkey + l_quantity END AS x1, CASE WHEN l_linenumber = 1 THEN l_tax ELSE l_suppkey + l_quantity END AS y1 FROM lineitem WHERE l_quantity > 1),
k AS (SELECT *, CASE WHEN greatest(abs(x0), abs(y0), abs(x1), abs(y1)) <= 1.5 THEN 1080.0 ELSE 1.0 END AS fx, CASE WHEN greatest(abs(x0), abs(y0), abs(x1), abs(y1)) <= 1.5 THEN 1920.0 ELSE 1.0 END AS fy FROM b),
c AS (SELECT l_orderkey, l_linenumber, least(greatest(least(x0, x1) * fx, 0), 1080) AS l, least(greatest(greatest(x0, x1) * fx, 0), 1080) AS r, least(greatest(least(y0, y1) * fy, 0), 1920) AS t, least(greatest(greatest(y0, y1) * fy, 0), 1920) AS u FROM k)
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(CASE WHEN r - l >= 2 AND u - t >= 2 THEN CAST(floor(l + 0.5) + floor(t + 0.5) * 10000 + floor(r + 0.5) + floor(u + 0.5) AS BIGINT) END) AS box FROM c GROUP BY 1, 2""")
def boxes_in_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 1")
    share = F.col("l_linenumber") == 1
    box = F.struct(
        F.when(share, F.col("l_discount")).otherwise(F.col("l_partkey").cast("double")).alias("x0"), F.when(share, 0.5).otherwise(F.col("l_suppkey").cast("double")).alias("y0"),
        F.when(share, 0.9).otherwise(F.col("l_partkey") + F.col("l_quantity")).alias("x1"), F.when(share, F.col("l_tax")).otherwise(F.col("l_suppkey") + F.col("l_quantity")).alias("y1"),
    )
    rows = line.select("l_orderkey", "l_linenumber", boxes.normal(box, F.lit(1080), F.lit(1920)).alias("b"))
    sign = (F.col("b.x0") + F.col("b.y0").cast("long") * 10000 + F.col("b.x1") + F.col("b.y1")).cast("long")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(sign).alias("box"))


@query("""SELECT event_id, CAST(p AS INT) AS place, event_id * 10 + p AS id, CASE WHEN p = 0 THEN event_type ELSE 'second' END AS kind, (event_id + p) % 3 = 0 AS ok FROM events, range(0, 2) r(p) WHERE event_id % 4 <> 3 OR p = 0""")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of made-up answers: fenced, in words, in two objects, as a bare list."""
    item = lambda p, kind: F.concat(F.lit('{"id": '), F.col("event_id") * 10 + p, F.lit(', "kind": "'), kind, F.lit('", "ok": '), F.when((F.col("event_id") + p) % 3 == 0, F.lit('"Yes"')).otherwise("false"), F.lit("}"))
    a, b, mod = item(0, F.col("event_type")), item(1, F.lit("second")), F.col("event_id") % 4
    rows = F.lit('{"rows": [')
    texts = (
        F.when(mod == 0, F.concat(F.lit("```json\n"), rows, a, F.lit(", "), b, F.lit("]}\n```")))
        .when(mod == 1, F.concat(F.lit("Here {is} it: "), rows, a, F.lit("]} and "), rows, b, F.lit("]} done")))
        .when(mod == 2, F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")))
        .otherwise(F.concat(F.lit("only "), rows, a, F.lit("]}")))
    )
    said = table(spark, sf_dir, "events").select("event_id", texts.alias("answer"))
    out = answers.rows_of(said, "answer", "rows", "id: bigint, kind: string, ok: string", ["event_id"])
    return out.withColumn("ok", answers.truth(F.col("ok")))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Gift|Új' WHEN 1 THEN 'a b' ELSE '' END AS tags FROM part""")
def parsed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, " Gift, gift;\nÚj ,UJ").when(F.col("p_partkey") % 3 == 1, "a   b;; A B").otherwise(F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(answers.tags(raw), "|").alias("tags"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN CASE WHEN lower(p_type) = 'economy' THEN 3 WHEN lower(p_type) = 'promo' THEN 5 END WHEN p_size < 20 AND lower(p_type) = 'economy' THEN 4
WHEN lower(p_type) = 'economy' THEN 3 WHEN lower(p_type) = 'promo' THEN 5 END AS price FROM part""")
def longest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of names by the longest known beginning."""
    prices = spark.createDataFrame([("economy", 3), ("economy-1", 4), ("promo", 5)], "key string, price int")
    name = F.concat_ws("-", "p_type", F.when(F.col("p_size").between(10, 19), F.lit("1")).otherwise(F.lit("x")), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return answers.longest_prefix(rows, "name", prices, "key", "price").select("p_partkey", "price")


_FOLDED = "strip_accents(lower(replace({0}, 'Ø', 'o')))"


@query(library._BOOKS + f""", k AS (SELECT id, place, {_FOLDED.format("string_split(name, ' ')[1]")} AS x, {_FOLDED.format("string_split(name, ' ')[2]")} AS y FROM a),
o AS (SELECT id, place, CASE WHEN x IN ('anna', 'peter', 'zsofia', 'john', 'emile') THEN y || ' ' || x WHEN y IN ('john', 'emile') THEN y || ' ' || x ELSE x || ' ' || y END AS key FROM k)
SELECT b.id, string_agg(key, '; ' ORDER BY place) AS sort_key, any_value(CASE WHEN b.author IS NULL OR len(b.authors) = 2 THEN NULL WHEN split_part(b.authors[1], ' ', 1) IN ('Anna', 'Péter', 'Zsófia') THEN split_part(b.authors[1], ' ', 2) || ' ' || split_part(b.authors[1], ' ', 1) ELSE b.authors[1] END) AS ordered
FROM b LEFT JOIN o ON b.id = o.id GROUP BY b.id""")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of author fields, and single authors in local order."""
    rows = library.books(spark, sf_dir)
    single = F.when(~F.contains("author", F.lit(";")), names.local_order(F.col("author"), LOCAL))
    return rows.select("id", names.sort_key(F.col("author"), LOCAL, FOREIGN, []).alias("sort_key"), single.alias("ordered"))
