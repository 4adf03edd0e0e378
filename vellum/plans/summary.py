"""Queries that summarise: counts, shares, folds, histograms, modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import numbers, text
from vellum.operators import aggregates as A
from vellum.storage import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


@query("SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders,
(SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)) AS recent,
(SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS total""")
def scalar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last"))  # one row
    one = orders.join(F.broadcast(last)).agg(F.count("*").alias("orders"), F.count_if(F.expr("o_orderdate >= last - interval 30 days")).alias("recent"), F.sum(_money("o_totalprice")).cast("double").alias("total"))
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))  # one row
    return customers.join(F.broadcast(one))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT word AS value, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1")
def exploded_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exploded_counts(table(spark, sf_dir, "part"), "p_partkey", text.words(text.fold_for_search(F.col("p_name"))), "other")


@query("SELECT c_mktsegment, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 1")
def grouped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped_share(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("""WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT CASE WHEN r <= 6 THEN p_brand ELSE '__other' END AS p_brand, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1""")
def topk_other_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_with_other(table(spark, sf_dir, "part"), "p_brand", 6)


@query("""WITH v AS (SELECT CASE WHEN p_size > 5 AND p_size < 45 THEN p_size END AS s FROM part),
a AS (SELECT coalesce(sum(s), 0) AS known, count(s) AS known_rows, count(*) AS n, median(s) AS m FROM v),
b AS (SELECT *, CASE WHEN known_rows >= 3 THEN CAST(floor(m + 0.5) AS BIGINT) ELSE 250 END AS per FROM a)
SELECT CAST(known AS BIGINT) AS known, known_rows, per AS per_unknown, CAST(known + (n - known_rows) * per AS BIGINT) AS total FROM b""")
def imputed_sum_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.imputed_sum(table(spark, sf_dir, "part"), "p_size", 5, 45, 250)


@query("SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped_share(table(spark, sf_dir, "documents"), "lang").withColumnRenamed("count", "n")


@query("""SELECT n_name, count(DISTINCT s_suppkey) AS suppliers, count(*) AS rows FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def country_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are counted by supplier before the join, so the facts shuffle as counts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"))
    nation = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    return nation.groupBy("n_name").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.sum("n").alias("rows"))


@query("""WITH y AS (SELECT CAST(floor((year(o_orderdate) * 25 - 48000) / 10.0) * 10 AS INT) AS d, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT min(d) AS lo, max(d) AS hi FROM y), c AS (SELECT lo, hi, CASE WHEN (hi - lo) / 10 + 1 > 16 THEN CAST(ceil((hi - 150) / 100.0) * 100 AS INT) ELSE lo END AS cut FROM s)
SELECT 'd' || d AS key, CAST(d AS INT) AS start, CAST(d + 9 AS INT) AS "end", coalesce(n, 0) AS count FROM (SELECT unnest(range(greatest(lo, cut), hi + 1, 10)) AS d FROM c) LEFT JOIN y USING (d)
UNION ALL SELECT 'c' || CAST(floor(d / 100.0) * 100 AS INT), CAST(floor(d / 100.0) * 100 AS INT), CAST(least(floor(d / 100.0) * 100 + 99, cut - 1) AS INT), CAST(sum(n) AS BIGINT) FROM y, c WHERE d < cut GROUP BY 1, 2, 3""")
def dense_year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years spread out so that both decades and centuries appear."""
    orders = table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 25 - 48000).alias("y"))
    return A.year_histogram(orders, "y")


@query("""WITH d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS s) SELECT s AS o_orderstatus, count(o_orderkey) AS count FROM d LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def dense_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dense_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"], "X")


@query("""WITH e AS (SELECT * FROM (VALUES (0.0, 0.02), (0.02, 0.04), (0.04, 0.06), (0.06, 0.08), (0.08, 0.1)) t(a, b))
SELECT CAST(a AS DOUBLE) AS "from", CAST(b AS DOUBLE) AS "to", count(l_orderkey) AS count FROM e LEFT JOIN lineitem
ON l_discount >= CAST(a AS DOUBLE) AND (l_discount < CAST(b AS DOUBLE) OR (b = 0.1 AND l_discount <= 0.1::DOUBLE)) GROUP BY 1, 2""")
def bucketed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bucketed(table(spark, sf_dir, "lineitem"), "l_discount", [0, 0.02, 0.04, 0.06, 0.08, 0.1])


@query("""SELECT word, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
WHERE length(word) >= 3 AND word <> 'the' AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, length(word) DESC, 1 LIMIT 1""")
def top_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.most_common_word(table(spark, sf_dir, "part"), "p_partkey", text.fold_for_search(F.col("p_name")), ["the"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def arg_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.arg_extreme(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")])


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,2))) AS w, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, o, l_returnflag) AS r FROM v) WHERE r = 1""")
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_mode(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", _money("l_quantity"), F.struct("l_linenumber", "l_returnflag"))


@query("""SELECT o_custkey, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS done,
CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'processing' WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'ready' ELSE 'open' END AS status FROM orders GROUP BY 1""")
def conditional_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rollup_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F", "P")


@query("""SELECT o_custkey, CASE WHEN d <= 0 THEN 0 WHEN d >= n THEN 100 ELSE CAST(least(greatest(round(100.0 * d / n), 1), 99) AS INT) END AS percent
FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS d, count(*) AS n FROM orders GROUP BY 1)""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.rollup_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F", "P")
    return done.select("o_custkey", numbers.percent(F.col("done"), F.col("rows")).alias("percent"))


@query("""SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS part,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS whole FROM lineitem GROUP BY 1""")
def micro_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_suppkey").agg(F.sum(_money("l_extendedprice") * _money("l_discount")).cast("double").alias("part"), F.sum(_money("l_extendedprice")).cast("double").alias("whole"))


@query("""SELECT p_partkey, CASE WHEN n % 100 BETWEEN 11 AND 13 THEN n || 'th' WHEN n % 10 = 1 THEN n || 'st' WHEN n % 10 = 2 THEN n || 'nd' WHEN n % 10 = 3 THEN n || 'rd' ELSE n || 'th' END AS label,
round(n * 2.7, 1)::DOUBLE AS shelf, CAST(least(30 * pow(4, greatest(n % 9, 1) - 1), 21600) AS BIGINT) AS wait FROM (SELECT p_partkey, p_partkey % 120 AS n FROM part)""")
def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 120
    return table(spark, sf_dir, "part").select("p_partkey", numbers.ordinal(n).alias("label"), numbers.shelf_length(n).alias("shelf"), numbers.backoff(n % 9).alias("wait"))
