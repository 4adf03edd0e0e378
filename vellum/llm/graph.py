"""Connected components of a large edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import dropped, partitions, saved


def _checksum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): each node of the edges (a long, b long) with the least node that it can reach.

    A large star hangs the greater neighbours of every node on its least neighbour, a
    small star the lesser ones; when nothing changes every component is a star about
    its least node.  Minima are combined before they are shuffled, and a hub's rows may
    be split, so that no task needs all rows of a hub.  Each round is written to the
    shared folder, so a lost executor costs one round at most.  Labels that have not settled
    after ``rounds`` (more than any graph needs: chains halve) raise an error.

    Defined cases: edges of a node with itself and repeated ones count for nothing; no edges give
    no rows; nodes without an edge to another are not in the result; null ends are not allowed.
    """
    parts = partitions(edges.sparkSession)
    edges = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        few = max(8, min(parts, before[0] // 100_000))  # small rounds take few tasks and leave few files
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(few)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(few)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        done = edges
        edges = saved(small.select("e.a", "e.b").where("a != b").coalesce(few).distinct().coalesce(few), "edges")
        now = _checksum(edges)
        dropped(done)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(roots)
