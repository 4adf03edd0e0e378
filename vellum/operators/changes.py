"""Changes of tables as steps: upserts, counters, restores, maps of counts, access, propagation of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, and the others added; a full join, so both sides move once."""
    o, n = old.alias("o"), new.select(*old.columns).alias("n")
    there = F.col(f"n.{key}").isNotNull()
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks; of several new rows of a key the least."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in old.columns if c != key])).alias("_r")).select(key, "_r.*").select(*old.columns)
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def removed(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def counted(counters: DataFrame, hits: DataFrame, key: str, n: str) -> DataFrame:
    """Counters (key, n) raised by the number of hits of each key; new keys begin at their hits."""
    add = hits.groupBy(key).agg(F.count("*").alias("_add"))
    return counters.join(add, key, "full").select(key, (F.coalesce(n, F.lit(0)) + F.coalesce("_add", F.lit(0))).alias(n))


def throttled(hits: DataFrame, key: list[str], at: str, id_col: str, every: float) -> DataFrame:
    """The hits that count: a key's first one, and each that comes ``every`` seconds or more after the one counted last."""
    from vellum.streaming import state

    named = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = hits.select(named.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(at).cast("double").alias("at"))
    counted_ = state.limited(rows, every, 1).where("allowed").select(F.col("id").alias(id_col))
    return hits.join(counted_, id_col, "left_semi")


def merged_maps(df: DataFrame, group: str, counts: str) -> DataFrame:
    """(group, name, n): maps of counts added up name by name, without one map growing in a task."""
    return df.select(group, F.explode(counts).alias("name", "v")).groupBy(group, "name").agg(F.sum("v").alias("n"))


def visible(rows: DataFrame, owner: Column, shared: Column, viewer: str | None) -> DataFrame:
    """Rows that a viewer may see: their own, and those that are shared."""
    mine = F.coalesce(owner == viewer, F.lit(False)) if viewer else F.lit(False)
    return rows.where(mine | F.coalesce(shared, F.lit(False)))


def propagated_tags(books: DataFrame, links: DataFrame, old: DataFrame, new: DataFrame, book: str = "id", source: str = "source_id") -> DataFrame:
    """(book, tags): tags that a source gains go to its books, tags that it loses leave them unless another source of the book has them.

    ``links``: (book, source); ``old`` and ``new``: (source, tags); books keep tags of their own.
    """
    sets = links.join(old.select(source, F.col("tags").alias("_o")), source, "left").join(new.select(source, F.col("tags").alias("_n")), source, "left")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    by_book = sets.groupBy(book).agg(flat("_o").alias("_old"), flat("_n").alias("_new"))
    kept = F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.array_except("_old", "_new"))
    out = books.join(by_book, book, "left")
    return out.select(book, F.when(F.col("_new").isNull(), F.coalesce("tags", F.array().cast("array<string>"))).otherwise(F.array_union(kept, F.array_except("_new", "_old"))).alias("tags"))


def selection_state(selected: Column, n: str = "n") -> list[Column]:
    """Aggregates: how many rows there are, how many are selected, and none, some or all."""
    some = F.count(F.when(selected, 1))
    return [F.count("*").alias(n), some.alias("selected"), F.when(some == 0, "none").when(some == F.count("*"), "all").otherwise("some").alias("state")]


def source_activity(df: DataFrame, group: str, status: Column, running: list[str], done: list[str], failed: list[str]) -> DataFrame:
    """(group, total, active, finished, broken, phase): a group is processing while any source runs, failed if all are broken, partial, ready."""
    count = lambda kinds: F.count(F.when(status.isin(kinds), 1))
    out = df.groupBy(group).agg(F.count("*").alias("total"), count(running).alias("active"), count(done).alias("finished"), count(failed).alias("broken"))
    phase = F.when(F.col("active") > 0, "processing").when(F.col("broken") == F.col("total"), "failed").when(F.col("broken") > 0, "partial").when(F.col("finished") == F.col("total"), "ready").otherwise("waiting")
    return out.withColumn("phase", phase)


def source_counts(sources: DataFrame, group: str, upload: Column, status: Column, last: Column, now: float, idle: float) -> DataFrame:
    """(group, processing, alive, done, error, uploaded): sources of each group by what they do; an upload is alive within ``idle`` of its last sign."""
    there = upload == "uploaded"
    count = lambda c, name: F.count_if(c).alias(name)
    return sources.groupBy(group).agg(
        count(there & status.isin("pending", "queued", "processing"), "processing"), count((upload == "uploading") & (now - last < idle), "alive"),
        count(there & (status == "done"), "done"), count(there & (status == "error"), "error"), count(there, "uploaded"),
    )


def collection_status(records: Column) -> Column:
    """State of a group by its ``source_counts`` and the number of its records: an error only if every uploaded source failed."""
    empty = F.when(records > 0, "ready").otherwise("draft")
    return F.when(F.col("processing") > 0, "processing").when(F.col("uploaded") == 0, empty).when((F.col("done") == 0) & (F.col("error") > 0), "error").otherwise("ready")


def completion() -> Column:
    """What a group's completion waits for, by its ``source_counts``."""
    return F.when(F.col("processing") > 0, "wait_processing").when(F.col("alive") > 0, "wait_uploads").otherwise("enrich")


def completion_at(now: float, again: float) -> Column:
    """When completion runs: at once, or, so that an upload left alone blocks nothing, ``again`` seconds later; null while sources run."""
    return F.when(F.col("processing") > 0, None).when(F.col("alive") > 0, now + again).otherwise(now)


def weighted_progress(df: DataFrame, group: str, size: str, part: Column) -> DataFrame:
    """(group, size, progress): parts done (0 to 1) weighted by size; groups of no size count their rows."""
    out = df.groupBy(group).agg(F.sum(size).alias("size"), F.sum(F.col(size) * part).alias("_d"), F.avg(part).alias("_m"))
    return out.select(group, "size", F.when(F.col("size") > 0, F.col("_d") / F.col("size")).otherwise(F.col("_m")).alias("progress"))
