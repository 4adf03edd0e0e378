"""Queries over a work queue, changes of tables, and ordered runs, on ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import changes, runs
from vellum.storage import table
from vellum.streaming import queue

QUERIES, ORACLE_SQL = {}, {}

_JOB = {
    "id": "event_id",
    "type": "event_type",
    "key": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || CAST(user_id % 40 AS STRING) END",
    "status": "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END",
    "attempts": "CAST(event_id % 3 + 1 AS INT)",
    "most": "CAST(3 AS INT)",
    "run_at": "CAST(event_id % 997 AS DOUBLE)",
    "locked_at": "CASE WHEN event_id % 4 = 1 AND event_id % 7 <> 0 THEN CAST(event_id % 5000 AS DOUBLE) END",
    "locked_by": "CASE WHEN event_id % 4 = 1 THEN 'w' || CAST(event_id % 3 AS STRING) END",
    "error": "CAST(NULL AS STRING)",
}
_JOBS = "WITH jobs AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in _JOB.items()) + """ FROM events WHERE event_id % 3 <> 2),
asked AS (SELECT event_type AS type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || CAST(user_id % 60 AS VARCHAR) END AS key, CAST(event_id % 611 AS DOUBLE) AS "at", event_id AS id FROM events WHERE event_id % 3 = 2)
"""
#: All events as jobs, where nothing is asked for.
_ALL_JOBS = _JOBS.replace(" WHERE event_id % 3 <> 2),", "),").replace("asked AS", "unused AS")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _jobs(spark: SparkSession, sf_dir: str, every: bool = True) -> DataFrame:
    """Events as jobs: all of them, or those that are not requests."""
    events = table(spark, sf_dir, "events")
    return (events if every else events.where("event_id % 3 <> 2")).select(*[F.expr(e).alias(c) for c, e in _JOB.items()])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id % 3 = 2")
    key = F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'u' || CAST(user_id % 60 AS STRING) END")
    return rows.select(F.col("event_type").alias("type"), key.alias("key"), F.expr("CAST(event_id % 611 AS DOUBLE)").alias("at"), F.col("event_id").alias("id"))


@query(_JOBS + """SELECT type, key, min("at") AS "at", arg_min(id, ("at", id)) AS id FROM asked WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.type = asked.type AND j.key = asked.key AND status IN ('queued', 'running')) GROUP BY 1, 2
UNION ALL SELECT type, key, "at", id FROM asked WHERE key IS NULL""")
def queue_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.accepted(_jobs(spark, sf_dir, False), _asked(spark, sf_dir))


@query(_JOBS + """, a AS (SELECT type, key, min("at") AS "at", min(id) AS new FROM asked WHERE key IS NOT NULL GROUP BY 1, 2), q AS (SELECT type, key, arg_min(id, (run_at, id)) AS id, min(run_at) AS run_at FROM jobs WHERE status = 'queued' AND key IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(q.id, new) AS id, a.type, a.key, least(coalesce(run_at, "at"), "at") AS run_at, q.id IS NULL AS created FROM a LEFT JOIN q ON a.type = q.type AND a.key = q.key""")
def queue_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.ensured(_jobs(spark, sf_dir, False), _asked(spark, sf_dir).where("key is not null"))


@query(_ALL_JOBS + """, n AS (SELECT id, row_number() OVER (ORDER BY run_at, id) AS r FROM jobs WHERE status = 'queued' AND run_at <= 500 ORDER BY r LIMIT 40)
SELECT id, CASE WHEN r IS NULL THEN status ELSE 'running' END AS status, CASE WHEN r IS NULL THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN r IS NULL THEN locked_at ELSE 500.0 END AS locked_at,
CASE WHEN r IS NULL THEN locked_by ELSE 'worker' || CAST(r - 1 AS VARCHAR) END AS locked_by FROM jobs LEFT JOIN n USING (id)""")
def queue_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty workers pull one job each."""
    return queue.claimed(_jobs(spark, sf_dir), 500.0, [f"worker{i}" for i in range(40)]).select("id", "status", "attempts", "locked_at", "locked_by")


@query(_ALL_JOBS + """SELECT id, CASE WHEN status <> 'running' OR id % 2 = 0 THEN status WHEN id % 5 = 0 OR attempts >= most THEN 'failed' ELSE 'queued' END AS status,
CASE WHEN status <> 'running' OR id % 2 = 0 OR id % 5 = 0 OR attempts >= most THEN run_at ELSE 500 + least(30 * pow(4, greatest(attempts, 1) - 1), 21600) END AS run_at,
CASE WHEN status <> 'running' OR id % 2 = 0 THEN locked_by END AS locked_by, CASE WHEN status = 'running' AND id % 2 = 1 THEN 'no answer' END AS error FROM jobs""")
def queue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every running job with an odd id fails, one in five for good."""
    jobs = _jobs(spark, sf_dir)
    lost = jobs.where("status = 'running' and id % 2 = 1").select("id", F.lit("no answer").alias("error"), (F.col("id") % 5 != 0).alias("retryable"))
    return queue.failed(jobs, lost, 500.0).select("id", "status", "run_at", "locked_by", "error")


@query(_ALL_JOBS + """, s AS (SELECT *, status = 'running' AND (locked_at IS NULL OR locked_at < 4000 - 1800) AS stale FROM jobs)
SELECT id, CASE WHEN NOT stale THEN status WHEN attempts >= most THEN 'failed' ELSE 'queued' END AS status, CASE WHEN stale THEN 4000.0 ELSE run_at END AS run_at, CASE WHEN NOT stale THEN locked_at END AS locked_at,
CASE WHEN stale AND attempts >= most THEN 'worker lost while running' END AS error FROM s""")
def queue_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reset_stale(_jobs(spark, sf_dir), 4000.0).select("id", "status", "run_at", "locked_at", "error")


@query(_ALL_JOBS + """SELECT id, CASE WHEN locked_by = 'w1' THEN 'queued' ELSE status END AS status, CASE WHEN locked_by = 'w1' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
CASE WHEN locked_by = 'w1' THEN 900.0 ELSE run_at END AS run_at, CASE WHEN locked_by = 'w2' THEN 900.0 WHEN locked_by = 'w1' THEN NULL ELSE locked_at END AS locked_at FROM jobs WHERE NOT (status IN ('done', 'failed') AND run_at < 900 - 86400 * 0.001)""".replace("86400 * 0.001", "500"))
def queue_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worker beats, one shuts down, and what ended long ago goes."""
    jobs = queue.requeued(queue.touched(_jobs(spark, sf_dir), "w2", 900.0), "w1", 900.0)
    return queue.purged(jobs, "run_at", 900.0 + 85900, 1).select("id", "status", "attempts", "run_at", "locked_at")


@query("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return changes.upserted(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey")


@query("""SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min(o_orderstatus) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1""")
def inserted_or_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return changes.inserted(old, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("name")), "k")


@query("""SELECT coalesce(c.k, h.k) AS k, coalesce(c.n, 0) + coalesce(h.n, 0) AS n FROM (SELECT c_custkey AS k, c_custkey % 5 AS n FROM customer) c FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) h ON c.k = h.k""")
def counters_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5).alias("n"))
    return changes.counted(counters, table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k", "n")


@query("""WITH RECURSIVE h AS (SELECT user_id, event_type, event_id, epoch(ts) AS "at", row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts), event_id) AS i FROM events),
r AS (SELECT user_id, event_type, event_id, i, "at" AS opened, TRUE AS counted FROM h WHERE i = 1
UNION ALL SELECT h.user_id, h.event_type, h.event_id, h.i, CASE WHEN h."at" >= r.opened + 86400 THEN h."at" ELSE r.opened END, h."at" >= r.opened + 86400 FROM r JOIN h ON h.user_id = r.user_id AND h.event_type = r.event_type AND h.i = r.i + 1)
SELECT event_id, user_id FROM r WHERE counted""")
def throttled_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return changes.throttled(rows, ["user_id", "event_type"], "at", "event_id", 86400.0).select("event_id", "user_id")


@query("""SELECT user_id, j.key AS name, CAST(sum(CAST(j.value AS BIGINT)) AS BIGINT) AS n FROM events, json_each(props) AS j WHERE j.type IN ('UBIGINT', 'BIGINT') GROUP BY 1, 2""")
def usage_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.from_json("props", "map<string,string>")
    whole = F.transform_values(F.map_filter(counts, lambda k, v: v.rlike(r"^-?\d+$")), lambda k, v: v.cast("long"))
    return changes.merged_maps(table(spark, sf_dir, "events").select("user_id", whole.alias("m")), "user_id", "m")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey = 17")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return changes.visible(rows, F.col("o_custkey").cast("string"), F.col("o_orderstatus") == "P", "17").select("o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, bool_or(l_suppkey % 3 = 0) AS o, bool_or(l_suppkey % 5 = 1) AS again, bool_or(l_suppkey % 5 = 0) AS y FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN ['old'] ELSE ['own'] END AS own, coalesce(o, FALSE) AS o, coalesce(again, FALSE) AS again, coalesce(y, FALSE) AS y FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
k AS (SELECT id, own[1] = 'old' AND o AND NOT again AS lost, own, list_concat(CASE WHEN again AND NOT o AND own[1] <> 'old' THEN ['old'] ELSE [] END, CASE WHEN y THEN ['new'] ELSE [] END) AS gained FROM t)
SELECT id, array_to_string(list_sort(list_concat(CASE WHEN lost THEN [] ELSE own END, gained)), ',') AS tags FROM k""")
def propagated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources: some lose the tag ``old``, some have it anew, some gain ``new``."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("old"))).otherwise(F.array(F.lit("own"))).alias("tags"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source_id")).distinct()
    s, none = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")), F.array().cast("array<string>")
    old = s.select("source_id", F.when(F.col("source_id") % 3 == 0, F.array(F.lit("old"))).otherwise(none).alias("tags"))
    mod = F.col("source_id") % 5
    new = s.select("source_id", F.when(mod == 0, F.array(F.lit("new"))).when(mod == 1, F.array(F.lit("old"))).otherwise(none).alias("tags"))
    out = changes.propagated_tags(orders, links, old, new)
    return out.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("""WITH k AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS broken FROM orders GROUP BY 1)
SELECT *, CASE WHEN active > 0 THEN 'processing' WHEN broken = total THEN 'failed' WHEN broken > 0 THEN 'partial' WHEN finished = total THEN 'ready' ELSE 'waiting' END AS phase FROM k""")
def source_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.source_activity(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus"), ["O"], ["F"], ["P"])


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, round(sum(CAST(l_quantity AS BIGINT) * CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END) / sum(CAST(l_quantity AS BIGINT)), 9) AS progress FROM lineitem GROUP BY 1""")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), "l_linestatus")
    out = changes.weighted_progress(rows, "l_orderkey", "q", F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5))
    return out.withColumn("progress", F.round("progress", 9))


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS selected, CASE count(*) FILTER (o_totalprice > 200000) WHEN 0 THEN 'none' WHEN count(*) THEN 'all' ELSE 'some' END AS state FROM orders GROUP BY 1""")
def selection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*changes.selection_state(F.col("o_totalprice") > 200000))


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.without_repeats(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type")).select("event_id")


_SPANS = "SELECT l_suppkey AS g, CAST(l_partkey AS DOUBLE) AS s, CAST(l_partkey + l_quantity / 10 AS DOUBLE) AS e FROM lineitem"


@query(f"""WITH t AS ({_SPANS}), m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT g, min(s) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY g, run""")
def run_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    spans = line.select(F.col("l_suppkey").alias("g"), F.col("l_partkey").cast("double").alias("s"), (F.col("l_partkey") + F.col("l_quantity") / 10).alias("e"))
    return runs.run_hulls(spans, "g", "s", "e")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id FROM (SELECT event_id, i, min(CASE WHEN event_type = 'purchase' THEN i END) OVER u AS lo, max(CASE WHEN event_type = 'purchase' THEN i END) OVER u AS hi FROM p WINDOW u AS (PARTITION BY user_id)) WHERE i BETWEEN lo AND hi""")
def between_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.between_anchors(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase").select("event_id")


@query("""SELECT o_orderkey, CAST(floor((r - 1) / 4) AS INT) AS chunk, CAST((r - 1) % 4 AS INT) AS place, floor((r - 1) / 4) >= 2 AS hidden FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def capped_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return runs.piles(rows, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 4, 2).select("o_orderkey", "chunk", "place", "hidden")


@query("""WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 37 + 3 AS DOUBLE) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
p AS (SELECT o_custkey, o_orderkey, r, 0 AS "row", CAST(0 AS DOUBLE) AS "at", w + 2 AS x FROM n WHERE r = 1
UNION ALL SELECT n.o_custkey, n.o_orderkey, n.r, CASE WHEN x + w > 60 THEN "row" + 1 ELSE "row" END, CASE WHEN x + w > 60 THEN 0 ELSE x END, CASE WHEN x + w > 60 THEN 0 ELSE x END + w + 2 FROM p JOIN n ON n.o_custkey = p.o_custkey AND n.r = p.r + 1)
SELECT o_orderkey, "row", "at" FROM p""")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 37 + 3).cast("double").alias("w"))
    return runs.packed_rows(rows, "o_custkey", ["o_orderkey"], "w", 60.0, 2.0).select("o_orderkey", "row", "at")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, l_partkey AS "at" FROM lineitem WHERE l_linenumber % 2 = 1), r AS (SELECT l_suppkey AS g, l_partkey AS "at" FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT l_orderkey, "at", (SELECT arg_min(r."at", (abs(r."at" - l."at"), r."at")) FROM r WHERE r.g = l.g AND abs(r."at" - l."at") <= 5) AS nearest FROM l""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("at"))
    left, right = rows.where("l_linenumber % 2 = 1").select("l_orderkey", "g", "at"), rows.where("l_linenumber % 2 = 0").select("g", "at")
    return runs.nearest_within(left, right, "g", "at", 5.0).select("l_orderkey", "at", F.col("nearest").cast("long").alias("nearest"))


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS g, l_linenumber AS f, CAST(l_partkey AS DOUBLE) AS s, CAST(l_partkey + l_quantity AS DOUBLE) AS e FROM lineitem), m AS (SELECT a.*, b.s AS bs, b.e AS be, (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(1, least(a.e - a.s, b.e - b.s)) AS x FROM t a JOIN t b ON a.g = b.g AND a.f = b.f + 1),
k AS (SELECT * FROM m WHERE x >= 0.6 QUALIFY row_number() OVER (PARTITION BY g, f, s, e ORDER BY x DESC, bs, be) = 1), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY g, f, bs, be ORDER BY x DESC, s, e) = 1) SELECT t.g, t.f, t.s, t.e, bs AS before FROM t LEFT JOIN c USING (g, f, s, e)""")
def continued_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    spans = line.select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("f"), F.col("l_partkey").cast("double").alias("s"), (F.col("l_partkey") + F.col("l_quantity")).alias("e")).distinct()
    return runs.continued(spans, "g", "f", "s", "e", 0.6)


@query("""WITH o AS (SELECT p_brand AS g, p_name AS v, sum(p_size) AS w FROM part GROUP BY 1, 2), c AS (SELECT x.g, x.v, x.w, round(sum(y.w * levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v), 1)), 9) AS cost FROM o x JOIN o y ON x.g = y.g GROUP BY 1, 2, 3)
SELECT g, arg_min(v, (cost, -w, v)) AS v, min(cost) AS cost FROM c GROUP BY g""")
def weighted_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.medoids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_name").alias("v"), "p_size"), "g", "v", "p_size")


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS w, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, arg_min(event_type, (-n, -w, f)) AS event_type, max(n) AS n FROM o GROUP BY 1""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.most_frequent(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")


@query("""SELECT p_brand AS g, count(p_size) AS n, round(avg(p_size), 6) AS mean, round(var_pop(p_size), 6) AS variance, median(p_size) AS median FROM part GROUP BY 1""")
def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.spread(table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), "p_size"), "g", "p_size")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query()
def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a supplier: orders as frames, line numbers as places, part names as titles; frames that follow each other are aligned."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = line.select(F.col("l_suppkey").alias("g"), F.floor(F.col("l_orderkey") / 64).cast("long").alias("frame"), (F.col("l_orderkey") * 64 + F.col("l_linenumber") * 8 + F.col("l_partkey") % 8).alias("id"), "p_name")
    one = rows.groupBy("g", "frame", "id").agg(F.min("p_name").alias("title")).withColumn("i", F.col("id"))
    return runs.align_frames(one, "g", "frame", "i", "title", 0.6)


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(CASE WHEN event_type <> 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM events""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return runs.filled_forward(rows, "user_id", [F.col("ts"), F.col("event_id")], "v", "filled").select("event_id", "filled")


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_id % 7 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, coalesce(v, 1) AS o, greatest(coalesce(v, 1), 0) AS most FROM h WHERE i = 1 UNION ALL SELECT h.user_id, h.event_id, h.i, coalesce(h.v, most + 1), greatest(most, coalesce(h.v, most + 1)) FROM r JOIN h ON h.user_id = r.user_id AND h.i = r.i + 1)
SELECT event_id, CAST(o AS BIGINT) AS "order" FROM r""")
def orders_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a batch; a view has none and gets one more than the greatest so far."""
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "view", F.col("event_id") % 7))
    return runs.orders_filled(rows, "user_id", [F.col("ts"), F.col("event_id")], "v", "order").select("event_id", "order")


@query("""WITH m AS (SELECT l_suppkey, l_linenumber, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, sum(m) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS "offset" FROM m""")
def pan_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.pan_offsets(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def monotonic_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rising(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "value", "progress").select("event_id", "progress")


@query("SELECT l_orderkey, max(l_linenumber) + 2.5 AS due FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linestatus = 'O')")
def completion_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.completion_due(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_linestatus") == "O", 2.5)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) WHERE p BETWEEN 92 AND 147")
def viewport_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.slice_of(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 100, 40, 8).select("o_orderkey")


@query("""SELECT coalesce(s.k, l.k) AS s_suppkey, coalesce(n, 0) AS n, s.k IS NOT NULL AS known FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 <> 1) s FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 2 GROUP BY 1) l ON s.k = l.k""")
def grouped_with_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 <> 2")
    return runs.with_leftovers(items, "l_suppkey", table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 1"), "s_suppkey")


@query("""WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 2 = 0))) AS x, list_sort(list_distinct(list(event_type) FILTER (event_id % 5 = 1))) AS y FROM events GROUP BY 1), b AS (SELECT user_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a)
SELECT user_id, array_to_string(CASE WHEN len(list_filter(y, lambda t: NOT list_contains(x, t))) = 0 THEN list_filter(x, lambda t: NOT list_contains(y, t)) ELSE list_concat(x, list_filter(y, lambda t: NOT list_contains(x, t))) END, ',') AS toggled,
array_to_string(list_filter(x, lambda t: list_contains(y, t)), ',') AS pruned FROM b""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.operators import records

    one = lambda of, rest: F.array_sort(F.collect_set(F.when(F.col("event_id") % of == rest, F.col("event_type"))))
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(one(2, 0).alias("x"), one(5, 1).alias("y"))
    return sets.select("user_id", F.array_join(records.toggled(F.col("x"), F.col("y")), ",").alias("toggled"), F.array_join(records.pruned(F.col("x"), F.col("y")), ",").alias("pruned"))
