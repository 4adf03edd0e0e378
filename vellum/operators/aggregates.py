"""Aggregations of a catalogue: folds, histograms, modes, imputed totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import numbers


def grouped_share(df: DataFrame, key: str) -> DataFrame:
    """(key, count, share): share of all rows; the total comes from the groups, not from the rows again."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.join(F.broadcast(total)).select(key, "count", numbers.share(F.col("count"), F.col("_total")).alias("share"))  # total: one row


def top_with_other(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, count): the ``k`` largest groups by count (ties by key), ``__other`` for further ones, ``__none`` for null keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    top = counts.where(F.col(key).isNotNull()).orderBy(F.desc("count"), key).limit(k).select(F.col(key).alias("_k"))
    folded = F.when(F.col(key).isNull(), "__none").when(F.col("_k").isNull(), "__other").otherwise(F.col(key))
    return counts.join(F.broadcast(top), F.col(key) == F.col("_k"), "left").groupBy(folded.alias(key)).agg(F.sum("count").alias("count"))


def dense_counts(df: DataFrame, key: str, values: list[str], fallback: str) -> DataFrame:
    """(key, count) with a row for each of ``values``, zero or not; unknown values count as ``fallback``."""
    spark = df.sparkSession
    counted = df.groupBy(F.when(F.col(key).isin(values), F.col(key)).otherwise(fallback).alias("_k")).agg(F.count("*").alias("count"))
    dimension = spark.createDataFrame([(v,) for v in values], f"{key} string")
    return dimension.join(counted, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("count", F.lit(0)).alias("count"))


def bucketed(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(from, to, count) of buckets [from, to), the last one closed; empty ones included."""
    spark = df.sparkSession
    at = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        upper = F.col(value) <= edges[i + 1] if i == len(edges) - 2 else F.col(value) < edges[i + 1]
        at = F.when((F.col(value) >= edges[i]) & upper, i).otherwise(at)
    counted = df.groupBy(at.alias("_i")).agg(F.count("*").alias("count"))
    dimension = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "_i int, from double, to double")
    return dimension.join(counted, "_i", "left").select("from", "to", F.coalesce("count", F.lit(0)).alias("count"))


def imputed_sum(df: DataFrame, value: str, low: float, high: float, default: int, least_known: int = 3) -> DataFrame:
    """One row: known sum, known rows, what an unknown row counts as (rounded median or default), total."""
    ok = F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))
    one = df.agg(F.sum(ok).alias("known"), F.count(ok).alias("known_rows"), F.count("*").alias("rows"), F.median(ok).alias("_m"))
    per = F.when(F.col("known_rows") >= least_known, F.floor(F.col("_m") + 0.5)).otherwise(default)
    known = F.coalesce("known", F.lit(0)).cast("long")
    return one.select(known.alias("known"), "known_rows", per.cast("long").alias("per_unknown"), (known + (F.col("rows") - F.col("known_rows")) * per).cast("long").alias("total"))


def year_histogram(df: DataFrame, year: str, columns: int = 16) -> DataFrame:
    """(key, start, end, count): decades without gaps; if they would be more than ``columns``, older ones by century, where not empty."""
    decades = df.groupBy(numbers.decade(F.col(year)).alias("d")).agg(F.count("*").alias("n")).where("d is not null")
    span = decades.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    cut = F.when((F.col("hi") - F.col("lo")) / 10 + 1 > columns, F.ceil((F.col("hi") - (columns - 1) * 10) / 100) * 100).otherwise(F.col("lo")).cast("int")
    span = span.where("lo is not null").withColumn("cut", cut)
    every = span.select("cut", F.explode(F.sequence(F.greatest("lo", "cut"), F.col("hi"), F.lit(10))).alias("d"))
    recent = every.join(decades, "d", "left").select(F.concat(F.lit("d"), "d").alias("key"), F.col("d").alias("start"), (F.col("d") + 9).alias("end"), F.coalesce("n", F.lit(0)).alias("count"))
    old = decades.join(F.broadcast(span)).where("d < cut").groupBy(numbers.century(F.col("d")).alias("c"), "cut").agg(F.sum("n").alias("n"))  # span: one row
    old = old.select(F.concat(F.lit("c"), "c").alias("key"), F.col("c").alias("start"), F.least(F.col("c") + 99, F.col("cut") - 1).alias("end"), F.col("n").alias("count"))
    return old.union(recent)


def weighted_mode(df: DataFrame, group: str, value: str, weight: Column, order: Column) -> DataFrame:
    """(group, value): the value of most weight; ties go to the one seen first."""
    votes = df.groupBy(group, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    return votes.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_w"), F.col("_o"))).alias(value))


def arg_extreme(df: DataFrame, group: str, value: str, order: list[Column]) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(value, F.struct(*order)).alias(value))


def most_common_word(df: DataFrame, key: str, folded: Column, stop: list[str], least: int = 2) -> DataFrame:
    """One row (word, count) at most: once per row, three letters or more, no numbers; ties to the longer, then the lesser word."""
    words = df.select(key, F.explode(F.array_distinct(F.split(folded, " "))).alias("word"))
    words = words.where((F.length("word") >= 3) & ~F.col("word").isin(stop) & ~F.col("word").rlike(r"^\p{N}+$"))
    counts = words.groupBy("word").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    return counts.orderBy(F.desc("count"), F.desc(F.length("word")), "word").limit(1)


def exploded_counts(df: DataFrame, key: str, values: Column, empty: str) -> DataFrame:
    """(value, count): each row counts once for each of its distinct values, or for ``empty`` without any."""
    distinct = F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))
    return df.select(F.explode(F.when(F.size(distinct) == 0, F.array(F.lit(empty))).otherwise(distinct)).alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def rollup_status(df: DataFrame, group: str, status: str, done: str, running: str) -> DataFrame:
    """Status of a group from its rows' states: processing while any is ``running``, ready if all are ``done``, else open."""
    return df.groupBy(group).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(status) == done).alias("done"),
        F.when(F.count_if(F.col(status) == running) > 0, "processing").when(F.count_if(F.col(status) != done) == 0, "ready").otherwise("open").alias("status"),
    )


def running_total(df: DataFrame, group: str, order: list[Column], value: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(value).over(w))
