"""Resharding by minimum-cost flow.

Documents lie in *old* shards (by default a hash of the row).  Every new shard has
a capacity in bytes (by default equal).  A minimum-cost flow between the shards
that hold too much and those that hold too little says how many bytes each sends
to each; staying costs nothing, so the fewest bytes move.  Within a shard the
documents stand in an order of falling size class, and what leaves is a tail of
that order: the smallest documents, so that the cut is fine.

Scale: one pass over the texts yields (id, size, crc); all else runs on those.
Positions are two-level prefix sums: block totals (shard x size class x hash, a
bounded table) plus a running sum inside a block, so no task sees a whole shard.
The driver gets only the block totals.

Defined cases: a null text counts as empty (16 bytes, crc 0); a null id is a row
as any other; repeated rows each get a slot of their own; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.llm.common import partitions, saved

OVERHEAD = 16


def min_cost_flow(surplus: list[int], need: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Bytes to send from each holder of surplus to each shard in need, at least cost.

    Successive shortest augmenting paths over the bipartite graph.  All lists are as
    long as there are shards.
    """
    left, right = list(surplus), list(need)
    n, m = len(left), len(right)
    flow = [[0] * m for _ in range(n)]
    while True:
        dist: dict[tuple[int, int], float] = {(0, i): 0.0 for i in range(n) if left[i] > 0}
        before: dict[tuple[int, int], tuple[int, int]] = {}
        queue = [(0.0, node) for node in dist]
        # Residual arcs back may have negative cost, so nodes may be settled again.
        while queue:
            d, (side, i) = heapq.heappop(queue)
            if d > dist[side, i]:
                continue
            steps = (
                (((1, j), cost[i][j]) for j in range(m))
                if side == 0
                else (((0, j), -cost[j][i]) for j in range(n) if flow[j][i] > 0)
            )
            for node, step in steps:
                if d + step < dist.get(node, float("inf")) - 1e-12:
                    dist[node] = d + step
                    before[node] = (side, i)
                    heapq.heappush(queue, (d + step, node))
        ends = [(dist[1, j], j) for j in range(m) if right[j] > 0 and (1, j) in dist]
        if not ends:
            return flow
        end = min(ends)[1]
        path, node = [], (1, end)
        while node in before:
            path.append((before[node], node))
            node = before[node]
        amount = min(left[node[1]], right[end])
        for (side, a), (_, b) in path:
            if side == 1:
                amount = min(amount, flow[b][a])
        for (side, a), (_, b) in path:
            if side == 0:
                flow[a][b] += amount
            else:
                flow[b][a] -= amount
        left[node[1]] -= amount
        right[end] -= amount


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32) of each row; the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def numbered(df: DataFrame, group: str, parts: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, without a task that holds a group."""
    df = df.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(7)), F.lit(parts)))
    counts = df.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy("doc_id", "size", "text_crc32")
    return (
        df.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, [group, "_part"])
        .withColumn(out, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_part", "_start", "_rank")
    )


def reshard(
    rows: DataFrame,
    n_shards: int = 40,
    old_shard: Column | None = None,
    capacities: list[int] | None = None,
    cost: list[list[float]] | None = None,
    sub_blocks: int = 16,
) -> DataFrame:
    """New shard of every row of ``rows`` (doc_id, size, text_crc32).

    Returns doc_id, size, text_crc32, old_shard, shard, slot.  ``capacities``: bytes
    that each shard shall hold, summing to the total (default: equal).  ``cost``:
    per byte from shard to shard (default: 1).  ``sub_blocks`` bounds the table of
    block totals: shards x 64 size classes x sub_blocks rows.
    """
    spark = rows.sparkSession
    key = F.xxhash64("doc_id", "size", "text_crc32")
    old = old_shard if old_shard is not None else F.pmod(key, F.lit(n_shards)).cast("int")
    size_class = F.floor(F.log2(F.col("size")))
    rows = rows.withColumn("old_shard", old).withColumn(
        "_block", ((64 - size_class) * sub_blocks + F.pmod(F.xxhash64(key, F.lit(3)), F.lit(sub_blocks))).cast("int")
    )
    blocks = rows.groupBy("old_shard", "_block").agg(F.sum("size").alias("_bytes")).collect()

    held = [0] * n_shards
    for r in blocks:
        held[r["old_shard"]] += r["_bytes"]
    capacities = capacities or equal_capacities(sum(held), n_shards)
    cost = cost or [[1.0] * n_shards for _ in range(n_shards)]
    flow = min_cost_flow(
        [max(0, h - c) for h, c in zip(held, capacities, strict=True)],
        [max(0, c - h) for h, c in zip(held, capacities, strict=True)],
        cost,
    )

    cuts = []  # of each old shard: where in its order which new shard begins
    for a in range(n_shards):
        at, ends, targets = held[a] - sum(flow[a]), [], [a]
        for b in range(n_shards):
            if flow[a][b]:
                ends.append(at)
                targets.append(b)
                at += flow[a][b]
        cuts.append((a, ends, targets))
    starts, at = [], {}
    for r in sorted(blocks, key=lambda r: (r["old_shard"], r["_block"])):
        starts.append((r["old_shard"], r["_block"], at.get(r["old_shard"], 0)))
        at[r["old_shard"]] = at.get(r["old_shard"], 0) + r["_bytes"]
    cut_rows = spark.createDataFrame(cuts, "old_shard int, _ends array<long>, _targets array<int>")
    start_rows = spark.createDataFrame(starts, "old_shard int, _block int, _start long")

    inside = (
        Window.partitionBy("old_shard", "_block")
        .orderBy(key, "doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    middle = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.floor(F.col("size") / 2)
    placed = (
        rows.join(F.broadcast(start_rows), ["old_shard", "_block"])  # as many rows as there are blocks
        .withColumn("_at", middle)
        .join(F.broadcast(cut_rows), "old_shard")
        .withColumn("shard", F.expr("_targets[size(filter(_ends, e -> e <= _at))]"))
        .select("doc_id", "size", "text_crc32", "old_shard", "shard")
    )
    return numbered(placed, "shard", max(16, partitions(spark)), "slot")


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of those shards alone that lose or gain documents, by shard and slot; return their numbers.

    Every row of ``docs`` takes one row of the plan: equal ids (null ones too), sizes and crcs meet
    by their number among such rows.  A shard may be written by many tasks, each a range of its slots.
    """
    moved = plan.where("shard != old_shard")
    touched = saved(moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct(), "sharding-touched")
    keys = ["_id", "_size", "_crc"]
    # Equal rows may be exchanged; an order by all that can be hashed gives a second run of a task the same numbers.
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select("*", F.col(id_col).alias("_id"), size.alias("_size"), crc.alias("_crc"), F.xxhash64(*hashed).alias("_hash"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).drop("_hash")
    places = plan.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    places = places.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot")))
    hit = places.join(F.broadcast(touched), "shard", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in (*keys, "_n")], "shard", "slot")
    same = F.col("_id").eqNullSafe(F.col("__id")) & (F.col("_size") == F.col("__size")) & (F.col("_crc") == F.col("__crc")) & (F.col("_n") == F.col("__n"))
    found = rows.join(hit, same).select(*docs.columns, "shard", "slot")
    found.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return touched


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns, law ``bytes``."""
    rows = saved(sized(docs), "sharding-sizes")
    return reshard(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        "old_shard",
    )
