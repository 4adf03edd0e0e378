"""Queries over order: best of a group, sessions, islands, windows; changes of records; streams; resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import aggregates, records, resolve
from vellum.operators import sequences as S
from vellum.storage import table
from vellum.streaming import state

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _seconds(c: str):
    return F.col(c).cast("timestamp").cast("double")


@query("""SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey""")
def distinct_on_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return S.first_of(rows, ["l_orderkey"], [-F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_extendedprice")


@query("""SELECT DISTINCT ON (l_partkey) l_partkey, l_shipdate, l_orderkey FROM lineitem ORDER BY l_partkey, l_shipdate, l_orderkey""")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey")
    return S.first_of(rows, ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey")])


@query("""SELECT event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS session FROM
(SELECT event_id, user_id, ts, CASE WHEN value <= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM events)""")
def restart_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return S.sessions(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("value") <= F.lag("value").over(w)).select("event_id", "session")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS a FROM d)
SELECT user_id, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS days FROM g GROUP BY user_id, a""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.islands(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day").withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.operators.joins import neighbours

    return neighbours(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").select("o_orderkey", "previous", "next")


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS rank, count(*) OVER (PARTITION BY o_custkey) AS block_size FROM orders""")
def rank_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_in_block(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "rank", "block_size")


@query("""SELECT DISTINCT ON (w) event_id, value FROM (SELECT event_id, value, event_id // 8 AS w FROM events) ORDER BY w, value DESC, event_id""")
def count_window_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_argmax(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 8, "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, event_id, r, n, value AS v, sec AS s, true AS kept FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.event_id, e.r, e.n, CASE WHEN k THEN e.value ELSE w.v END, CASE WHEN k THEN e.sec ELSE w.s END, k FROM w JOIN (SELECT * FROM e) e ON e.user_id = w.user_id AND e.r = w.r + 1, LATERAL (SELECT abs(e.value - w.v) >= 30 OR e.sec - w.s > 604800 AS k) x)
SELECT event_id, user_id FROM w WHERE kept OR r = n""")
def redundancy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", _seconds("ts").alias("at"), "value", "event_id")
    return S.redundancy_filter(rows, "user_id", ["at", "event_id"], "value", 30.0, 86400.0 * 7).select("event_id", "user_id")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.moving_average(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("value"), 2, "smooth")
    return rows.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM orders""")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.running_total(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice").cast("decimal(18,2)"))
    return rows.select("o_orderkey", F.col("total").cast("double").alias("total"))


_TYPES = """WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) AS x, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 1))) AS y FROM events GROUP BY 1),
b AS (SELECT user_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a)
"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda odd: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == odd, F.col("event_type"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(one(0).alias("x"), one(1).alias("y"))


@query(_TYPES + """SELECT user_id, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ',') AS added, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ',') AS removed FROM b""")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    added, removed = records.changes(F.col("x"), F.col("y"))
    return _sets(spark, sf_dir).select("user_id", F.concat_ws(",", added).alias("added"), F.concat_ws(",", removed).alias("removed"))


@query(_TYPES + """SELECT user_id, array_to_string(list_concat(x, list_filter(y, lambda t: NOT list_contains(x, t))), ',') AS types FROM b""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("user_id", F.concat_ws(",", records.ordered_union(F.col("x"), F.col("y"))).alias("types"))


@query(_TYPES + """SELECT user_id, array_to_string(list_filter(list_concat(x, ['NEW']), lambda t: NOT list_contains(list_transform(y, lambda s: upper(s)), upper(t))), ',') AS types FROM b""")
def tag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = F.transform("y", F.upper)
    return _sets(spark, sf_dir).select("user_id", F.concat_ws(",", records.tag_delta(F.col("x"), F.array(F.lit("NEW")), upper)).alias("types"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return records.merge_records(table(spark, sf_dir, "orders"), "o_custkey", order, ["o_orderpriority"], ["o_orderkey"], ["o_totalprice"])


@query("""WITH e AS (SELECT * FROM lineitem WHERE l_suppkey % 7 <> 3), c AS (SELECT l_orderkey, count(*) AS evidence FROM e GROUP BY 1),
b AS (SELECT DISTINCT ON (l_orderkey) l_orderkey, l_suppkey, l_partkey FROM e ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey)
SELECT l_orderkey, evidence, l_suppkey, l_partkey FROM c JOIN b USING (l_orderkey)""")
def cascade_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [-F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return records.without_source(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_suppkey") % 7 == 3, order, "l_partkey")


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS r FROM events),
w AS (SELECT user_id, event_id, sec, r, sec AS opened, 1 AS hits FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.event_id, e.sec, e.r, CASE WHEN e.sec >= w.opened + {window} THEN e.sec ELSE w.opened END, CASE WHEN e.sec >= w.opened + {window} THEN 1 ELSE least(w.hits + 1, {limit} + 1) END
FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), _seconds("ts").alias("at"))


@query(_LIMIT.format(window=604800, limit=3) + "SELECT event_id AS id, user_id AS key, hits, hits <= 3 AS allowed FROM w")
def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.limited(_hits(spark, sf_dir), 604800.0, 3).drop("at")


@query(_LIMIT.format(window=86400, limit=1) + "SELECT event_id AS id, user_id AS key FROM w WHERE hits <= 1")
def dedupe_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.enqueued(_hits(spark, sf_dir), "key", "at", "id", 86400.0).drop("at")


@query("""WITH a AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER w AS i, sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT * FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.user_id = x.user_id AND y.i < x.i AND (y.ok OR y.f >= 3))), g AS (SELECT user_id, count(*) AS attempts, bool_or(ok) AS done, max(f) AS f FROM r GROUP BY 1)
SELECT user_id, attempts, CASE WHEN done THEN 'done' WHEN f >= 3 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN NOT done AND f < 3 THEN CAST(least(30 * pow(4, greatest(f, 1) - 1), 21600) AS BIGINT) END AS wait FROM g""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") != "purchase")
    return state.retried(attempts, "user_id", ["ts", "event_id"], "failed")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, i""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours")


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as readings of part names: a supplier is a source, order numbers give its frames."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    seen = lines.select(
        F.col("l_suppkey").alias("source"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("key"),
        F.floor(F.col("l_orderkey") / 8).cast("long").alias("frame"),
        F.col("p_name").alias("title"),
        (1 - F.col("l_discount") * 5).alias("confidence"),
    )
    one = seen.groupBy("key").agg(*[F.min(c).alias(c) for c in ("source", "frame", "title", "confidence")])
    return resolve.records(one)
