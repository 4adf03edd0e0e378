"""Queries that browse: filters, search, joins, ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import numbers, text
from vellum.operators import catalogue, joins
from vellum.operators.sequences import overlapping_batches, uniform_sample
from vellum.sources import export, query_string
from vellum.storage import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND CAST(floor(p_size / 10.0) * 10 AS INT) IN (10, 20)""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = query_string.parse("topic=Brand%2311,Brand%2312,Brand%2323&decade=10,20,15")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.lit(None).cast("string").alias("category"), F.array("p_brand").alias("topics"), F.col("p_size").alias("year"))
    return rows.where(catalogue.predicate(filters)).select("p_partkey", "p_brand", "p_type", "p_size")


@query("""SELECT p_partkey, p_name FROM part
WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') AND contains(lower(p_brand), 'brand')""")
def free_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    hay = text.haystack(F.col("p_name"))
    return part.where(text.matches_query(hay, "A É") & text.matches_query(text.haystack(F.col("p_brand")), "brand")).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50""")
def library_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_totalprice"), "o_orderkey"]
    return table(spark, sf_dir, "orders").orderBy(*order).limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def inner_join_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1""")
def left_join_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_quantity")
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(large, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_other FROM orders""")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return joins.with_flag(table(spark, sf_dir, "orders"), "o_orderkey", returned, "l_orderkey", "has_other").select("o_orderkey", "has_other")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    owners = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(owners, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS order_count,
 (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS item_count
FROM customer ORDER BY order_count DESC, c_custkey LIMIT 25""")
def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_order = joins.with_counts(orders, "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", "items")
    counts = per_order.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("items").alias("m"))
    customers = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = customers.select("c_custkey", F.coalesce("n", F.lit(0)).alias("order_count"), F.coalesce("m", F.lit(0)).alias("item_count"))
    return out.orderBy(F.desc("order_count"), "c_custkey").limit(25)


@query("""SELECT event_type, j.key AS key, count(*) AS n, CAST(sum(CAST(j.value AS BIGINT)) AS BIGINT) AS total
FROM events, json_each(props) AS j WHERE j.type IN ('UBIGINT', 'BIGINT') GROUP BY 1, 2""")
def json_map_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a JSON object, one row each; what is not a whole number is left out."""
    entries = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    numeric = entries.where(F.col("value").rlike(r"^-?\d+$"))
    return numeric.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("""SELECT a.doc_id AS doc_id, min(b.doc_id) AS duplicate_of FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id < a.doc_id GROUP BY 1""")
def self_join_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated text with its first id: by group, so that copies of copies are not paired."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("_n")).where("_n > 1")
    return docs.join(first, "h").where("doc_id > duplicate_of").select("doc_id", "duplicate_of")


_NAMES = """WITH names AS (SELECT DISTINCT lower(p_name) AS t FROM part),
grams AS (SELECT DISTINCT t, substr(' ' || w || ' ', i, 3) AS g FROM (SELECT t, unnest(string_split(t, ' ')) AS w FROM names), range(1, 60) r(i) WHERE i <= length(w)),
sizes AS (SELECT t, count(*) AS m FROM grams GROUP BY t),
shared AS (SELECT x.t AS a, y.t AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.t < y.t GROUP BY 1, 2)
"""


@query(_NAMES + """SELECT a, b, CAST(shared AS INT) AS shared FROM shared JOIN sizes p ON p.t = a JOIN sizes q ON q.t = b WHERE shared >= greatest(1, ceil(0.5 * least(p.m, q.m)))""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(text.title_key(F.col("p_name")).alias("t")).distinct()
    return joins.trigram_candidates(names, "t", "t", 0.5)


@query("""WITH names AS (SELECT DISTINCT lower(p_name) AS t FROM part)
SELECT x.t AS a, y.t AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 9) AS similarity
FROM names x JOIN names y ON x.t < y.t WHERE 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.7""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(text.title_key(F.col("p_name")).alias("t")).distinct()
    return joins.similar_pairs(names, "t", "t", 0.15, 0.7, "edit").withColumn("similarity", F.round("similarity", 9))


@query("""SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.neighbours(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_id").select("event_id", "previous", "next")


@query("""WITH RECURSIVE p AS (SELECT s_nationkey AS g, s_suppkey AS l, c_custkey AS r, abs(CAST(round(s_acctbal * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT)) AS d FROM supplier JOIN customer ON s_nationkey = c_nationkey),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, l, r) AS i FROM p),
w AS (SELECT g, 0 AS i, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r FROM (SELECT DISTINCT g FROM p)
UNION ALL SELECT w.g, b.i, list_append(ls, b.l), list_append(rs, b.r), b.l, b.r FROM w, LATERAL (SELECT n.i, n.l, n.r FROM n WHERE n.g = w.g AND n.i > w.i AND NOT list_contains(ls, n.l) AND NOT list_contains(rs, n.r) ORDER BY n.i LIMIT 1) b)
SELECT l AS s_suppkey, r AS c_custkey, -round(abs(s_acctbal - c_acctbal), 2) AS score FROM w JOIN supplier ON l = s_suppkey JOIN customer ON r = c_custkey""")
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of a nation, matched one to one by nearness of balance (in cents)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cents = lambda b: F.round(F.col(b) * 100).cast("long")
    found = joins.nearest_one_to_one(s.toDF("k", "g", "b").select("k", "g", cents("b").alias("v")), c.toDF("k", "g", "b").select("k", "g", cents("b").alias("v")))
    pairs = found.join(s, F.col("l") == F.col("s_suppkey")).join(c, F.col("r") == F.col("c_custkey"))
    return pairs.select("s_suppkey", "c_custkey", (-F.round(F.abs(F.col("s_acctbal") - F.col("c_acctbal")), 2)).alias("score"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
k AS (SELECT floor(i * (max(n) - 1) / 19.0 + 0.5) AS p FROM o, range(20) r(i) GROUP BY i)
SELECT o_orderkey, o_totalprice FROM o JOIN k USING (p)""")
def uniform_sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20)


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)
SELECT CAST(b AS INT) AS batch, count(*) AS rows, min(c_custkey) AS first, max(c_custkey) AS last
FROM o, range(0, 100000) r(b) WHERE b <= greatest(0, ceil((n - 40) / 30.0)) AND p >= b * 30 AND p < b * 30 + 40 GROUP BY b""")
def overlap_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlapping_batches(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 40, 10)
    return rows.groupBy("batch").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("""SELECT concat_ws(';', o_orderkey, o_orderstatus, CASE WHEN o_comment LIKE '=%' THEN '''' || o_comment ELSE o_comment END) AS line
FROM (SELECT o_orderkey, o_orderstatus, '=' || o_orderpriority AS o_comment FROM orders)""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("="), "o_orderpriority").alias("note"))
    return export.csv_lines(orders, ["o_orderkey", "o_orderstatus", "note"], ";")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']', '[]') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lists = export.nested(orders, "o_custkey", "o_orderkey")
    out = table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("c_custkey", F.size(items).cast("long").alias("n"), F.to_json(items).alias("orders"))


@query("""SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(floor(year(o_orderdate) / 10.0) * 10 AS INT) AS decade, CAST(floor(year(o_orderdate) / 100.0) * 100 AS INT) AS century,
CAST(floor((year(o_orderdate) - 1) / 100.0) + 1 AS INT) AS number, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4""")
def year_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(y.alias("y"), numbers.decade(y).alias("decade"), numbers.century(y).alias("century"), numbers.century_number(y).alias("number"))
    return rows.groupBy("y", "decade", "century", "number").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '\\s+', ' ', 'g'))) AS folded FROM documents""")
def fold_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query("""SELECT doc_id, regexp_replace(t, '^(a|az|the|der|die|das|le|la|les|il|el) (.)', '\\2') AS key FROM
(SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(string_split(text, chr(10))[1]), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)""")
def article_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of each document's title, its first line."""
    title = F.element_at(F.split("text", "\n"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", text.without_article(text.fold_for_search(title)).alias("key"))


@query("""SELECT p_partkey, isbn || CAST((10 - s % 10) % 10 AS VARCHAR) AS isbn13, isbn || CAST(p_partkey % 10 AS VARCHAR) AS code, (10 - s % 10) % 10 = p_partkey % 10 AS valid FROM
(SELECT p_partkey, isbn, list_sum(list_transform(range(1, 13), lambda i: CAST(substr(isbn, i, 1) AS INT) * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) AS s
FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS isbn FROM part))""")
def isbn_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of made-up codes, and codes with the right digit or, mostly, a wrong one."""
    body = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", numbers.isbn13_from(body).alias("isbn13"), F.concat(body, (F.col("p_partkey") % 10).cast("string")).alias("code"))
    return rows.withColumn("valid", numbers.isbn_valid(F.col("code")))


@query("""WITH t AS (SELECT p_partkey, p_name, p_partkey % 12 + 1 AS v FROM part) SELECT p_partkey, CAST(v AS VARCHAR) AS volumes FROM t""".replace("% 12 + 1", "% 39 + 1"))
def volume_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    roman = F.array(*[F.lit("X" * t + o) for t in range(4) for o in " I II III IV V VI VII VIII IX".split(" ")][1:])
    title = F.concat(F.col("p_brand").substr(1, 5), F.lit(" "), F.element_at(roman, (F.col("p_partkey") % 39 + 1).cast("int")), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.volume_numbers(title).cast("array<string>"), ",").alias("volumes"))
