"""Queries on lines of pixels, profiles and draws, and on batches that are put to an answerer."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import barcodes, numbers
from vellum.operators import asking, changes, draws, motion
from vellum.storage import dealt, table
from vellum.streaming import jobs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CODE = """WITH c AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS b FROM part),
k AS (SELECT p_partkey, b || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(b[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR) AS code FROM c)
"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.isbn13_from(base).alias("code"))


@query(_CODE + "SELECT p_partkey, code AS found FROM k UNION ALL SELECT p_partkey, code FROM k WHERE p_partkey % 2 = 0")
def barcode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's code drawn as a line of pixels, of even ones twice and from the right, comes back from the line."""
    line = barcodes.drawn(F.col("code"))
    lines = dealt(_codes(spark, sf_dir), "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.reverse(F.concat(line, line))).otherwise(line).alias("line"))
    return lines.select("p_partkey", F.explode(barcodes.codes(F.col("line"))).alias("found"))


@query(_CODE + "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey > 1 THEN (SELECT code FROM k b WHERE b.p_partkey = k.p_partkey - 1) ELSE code END AS code FROM k WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0")
def barcode_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines an image: its own code, and where the key is a multiple of four two lines of another; of three, a blurred rest beside two that contradict each other."""
    own = _codes(spark, sf_dir)
    other = own.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("code").alias("other"))
    both = own.join(other, "p_partkey", "left").withColumn("other", F.coalesce("other", "code"))
    k = F.col("p_partkey")
    which = F.when(k % 4 == 0, F.array("code", "other", "other")).when(k % 3 == 0, F.array("code", F.lit("9780000000002"), F.lit(None).cast("string"))).otherwise(F.array("code", F.lit(None).cast("string"), "code"))
    lines = dealt(both, "p_partkey").select("p_partkey", F.posexplode(which).alias("y", "c"))
    grey = F.when(F.col("c").isNull(), F.array_repeat(F.lit(128), 100)).otherwise(barcodes.drawn(F.coalesce("c", F.lit("9780000000002")), 3))
    return barcodes.voted(lines.withColumn("line", grey), "p_partkey", "line")


@query("SELECT vec_id, CAST(vec_id % 13 - 6 AS INT) AS shift, 1.0 AS score FROM embeddings")
def profile_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as profiles, cut out at two places: the shift between both comes back."""
    v, d = F.col("embedding").cast("array<double>"), (F.col("vec_id") % 13 - 6).cast("int")
    cut = lambda at: F.slice(v, at, F.lit(50))
    found = dealt(table(spark, sf_dir, "embeddings"), "vec_id").select("vec_id", motion.shift_of_cuts(cut(F.lit(8)), cut(8 - d)).alias("m"))
    # The score is 1 but for rounding.
    return found.select("vec_id", "m.shift", F.when(F.col("m.score") > 0.9, 1.0).otherwise(F.col("m.score")).alias("score"))


_FIT = "s{0} AS (SELECT g, count(*) AS n, median(y - x) AS med, CASE WHEN var_pop(x) * count(*) > 1e-6 AND covar_pop(x, y) / var_pop(x) > 0.9 AND covar_pop(x, y) / var_pop(x) < 1.1 THEN covar_pop(x, y) / var_pop(x) ELSE 1 END AS s, avg(y) AS my, avg(x) AS mx FROM p{0} GROUP BY 1)"
_TRIM = "r{0} AS (SELECT p{0}.*, abs(y - (s * x + my - s * mx)) AS r FROM p{0} JOIN s{0} USING (g)), q{0} AS (SELECT *, r <= greatest(6, 2.5 * median(r) OVER (PARTITION BY g)) AS ok FROM r{0}), p{1} AS (SELECT g, x, y FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY g) AS k FROM q{0}) WHERE ok OR k < 4)"


@query(f"""WITH p0 AS (SELECT l_suppkey * 1000 + l_partkey % 100 AS g, CAST(l_orderkey % 1000 AS DOUBLE) AS x, CAST(l_orderkey % 1000 * 1.03 + l_quantity / 10 + CASE WHEN l_linenumber > 5 THEN 400 ELSE 0 END AS DOUBLE) AS y FROM lineitem),
{_FIT.format(0)}, {_TRIM.format(0, 1)}, {_FIT.format(1)}, {_TRIM.format(1, 2)}, {_FIT.format(2)}
SELECT g, round(CASE WHEN n < 4 THEN 1 ELSE s END, 6) AS s, round(CASE WHEN n < 4 THEN med ELSE my - s * mx END, 5) AS d, n AS matches FROM s2 WHERE n >= 2""")
def robust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers of a supplier's parts against a stretched copy of them with outliers."""
    line = table(spark, sf_dir, "lineitem")
    x = (F.col("l_orderkey") % 1000).cast("double")
    # 103 / 100: as near to the decimal product as a double can be.
    y = (F.col("l_orderkey") % 1000 * 103 / 100 + F.col("l_quantity") / 10 + F.when(F.col("l_linenumber") > 5, 400).otherwise(0)).cast("double")
    out = motion.robust_lines(line.select((F.col("l_suppkey") * 1000 + F.col("l_partkey") % 100).alias("g"), x.alias("x"), y.alias("y")), "g")
    return out.select("g", F.round("s", 6).alias("s"), F.round("d", 5).alias("d"), "matches")


@query()
def shuffled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, shuffled by the customer's seed."""
    return draws.shuffled(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey", F.col("o_custkey") * 7 % 1000)


@query()
def rows_around_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest order amid six others, open ones first."""
    from pyspark.sql.window import Window

    orders = table(spark, sf_dir, "orders")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")) == 1
    rows = orders.withColumn("pick", first)
    return draws.rows_around(rows, "o_custkey", ["o_orderkey"], "o_orderkey", F.col("pick"), F.col("o_orderstatus") == "O", F.col("o_custkey"), 7)


def moody(rows: list[dict], attempt: int) -> list[tuple[str, str]]:
    """An answerer that fails and forgets by a seed of its own: by what is asked and the attempt alone."""
    mood = zlib.crc32(f"{rows[0]['id']}:{len(rows)}:{attempt}".encode()) % 10
    if mood < 2:
        raise TimeoutError(f"no answer to {len(rows)}")
    kept = [r for r in rows if zlib.crc32(f"{r['id']}:{attempt}".encode()) % 5 or mood > 7]
    return [*[(r["id"], str(r["name"]).lower()) for r in kept], *[(r["id"], "later") for r in kept[:1]], ("nobody", "x")]


@query()
def answered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand in batches of eight, put to a moody answerer."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_brand", F.col("p_name").alias("name"), "p_partkey")
    return asking.answered(rows, "p_brand", ["p_partkey"], moody, 8)


@query()
def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and kind as events of a queue; what became of its jobs."""
    kinds = F.array(*[F.lit(k) for k in ("ask", "claim", "ensure", "fail", "claim", "beat", "done", "claim")])
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id"), F.col("event_type")).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.get(kinds, (F.col("event_id") * 7 % 8).cast("int")).alias("kind"))
    return jobs.logged(rows, 1.8e9)


_SOURCES = """WITH s AS (SELECT o_custkey AS c, CASE o_orderkey % 6 WHEN 0 THEN 'uploading' WHEN 1 THEN 'cancelled' ELSE 'uploaded' END AS up, CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 2 THEN 'done' ELSE 'error' END WHEN o_orderstatus = 'F' THEN 'done' ELSE 'error' END AS st, o_orderkey % 1000 AS last FROM orders),
a AS (SELECT c, count(*) FILTER (up = 'uploaded' AND st IN ('pending', 'queued', 'processing')) AS processing, count(*) FILTER (up = 'uploading' AND 1000 - last < 400) AS alive, count(*) FILTER (up = 'uploaded' AND st = 'done') AS done, count(*) FILTER (up = 'uploaded' AND st = 'error') AS error, count(*) FILTER (up = 'uploaded') AS uploaded FROM s GROUP BY 1),
r AS (SELECT a.*, c % 3 AS records FROM a)
"""


@query(_SOURCES + """SELECT c, processing, alive, done, error, uploaded, records, CASE WHEN processing > 0 THEN 'processing' WHEN uploaded = 0 THEN CASE WHEN records > 0 THEN 'ready' ELSE 'draft' END WHEN done = 0 AND error > 0 THEN 'error' ELSE 'ready' END AS status,
CASE WHEN processing > 0 THEN 'wait_processing' WHEN alive > 0 THEN 'wait_uploads' ELSE 'enrich' END AS decision, CASE WHEN processing > 0 THEN NULL WHEN alive > 0 THEN 1900.0 ELSE 1000.0 END AS due FROM r""")
def collection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources of their customer's collection: what runs, what idles, the collection's state, and when its completion is due."""
    k, o = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(o == "O", F.when(k % 4 == 0, "queued").when(k % 4 == 2, "done").otherwise("error")).when(o == "F", "done").otherwise("error")
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.when(k % 6 == 0, "uploading").when(k % 6 == 1, "cancelled").otherwise("uploaded").alias("up"), status.alias("st"), (k % 1000).alias("last"))
    counts = changes.source_counts(sources, "c", F.col("up"), F.col("st"), F.col("last"), 1000.0, 400.0).withColumn("records", F.col("c") % 3)
    return counts.select("*", changes.collection_status(F.col("records")).alias("status"), changes.completion().alias("decision"), changes.completion_at(1000.0, 900.0).alias("due"))
