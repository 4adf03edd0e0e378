"""Exact largest inner products by length buckets.

Vectors are bucketed by their length (norm).  A first bound of each query's k-th
best score comes from a bounded set of rows; any later bound can only be higher, so
the bound prunes every bucket at once.  For a bucket of greatest length M the local
cosine threshold of a query is bound / (|q| * M): above 1 the bucket is skipped
before anything moves; near 1 rows are pruned on the query's largest coordinate
(whose range of feasible values follows from the threshold), else on length alone.
What is left is verified by exact products.

Scale: buckets are cut into blocks of bounded size and queries into tiles of bounded
size, by the length that a row must have to reach a query's bound; a row is copied to
those tiles alone that it can reach, and a query to those blocks that can reach it.  A
task joins one tile with one block, so memory is bounded whatever the tables hold.
Blocks hash the id, so equal lengths or copies do not pile up.

Exactness: products below 2 ** 52 are exact in floats; above, candidates within the
rounding error of the k-th score are computed again in whole numbers.

Defined cases: vectors that are null, or hold a null or non-finite component, take
no part; shorter vectors are padded with zeros; equal scores go to the smaller id;
rows with the query's own id are not its candidates, other rows of equal ids are each a
candidate; a query id that stands in several rows asks once, with the least of its
vectors; components and scores beyond a long count as the greatest or least one (so
such scores are ties); fewer than k candidates give fewer rows; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import saved

BUCKETS, BLOCK, TILE, PROBES = 16, 4096, 8192, 512
AT_ONCE = 512  #: queries whose scores a task holds
MOST = 2**63 - 1
EXACT = 2.0**52  #: products below are whole numbers in floats
COORDINATE = 0.6  #: local threshold from which coordinates prune more than lengths do


def usable(column: str) -> Column:
    """True for a vector without null or non-finite components."""
    good = F.forall(
        F.col(column),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.coalesce(F.col(column).isNotNull() & good, F.lit(False))


def scaled(column: str, by: int = 256) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * by).cast("long"))


def matrix(arrays: list, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _bounded(k: int, probe_ids: np.ndarray, probes: np.ndarray, longest: float):
    """Adds to each query the k-th best score among the probes, less what rounding may add: a lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            q = matrix([x[: probes.shape[1]] for x in b.column(1).to_pylist()], probes.shape[1])
            s = q @ probes.T
            s[ids[:, None] == probe_ids[None, :]] = -np.inf
            low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -np.inf)
            low = reached(low - 2 * rounding(q.shape[1], b.column(2).to_numpy() * longest))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.float64())], names=["id", "v", "norm", "low"])

    return run


def reached(low: np.ndarray) -> np.ndarray:
    """Bounds on float scores such that scores which count as the greatest long, or as the least, are all kept."""
    return np.where(low < -MOST * (1 - 1e-9), -np.inf, np.minimum(low, MOST * (1 - 1e-9)))


def rounding(width: int, product: np.ndarray) -> np.ndarray:
    """By how much the float product of vectors may be off, ``product`` that of their lengths; 0 where it is exact."""
    return np.where(product < EXACT, 0.0, (width + 4) * 2.0**-51 * product)


def _joined(k: int):
    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(base) and len(queries):
            base = base.sort_values("norm", ascending=False)
            width = max(max(map(len, base["v"])), max(map(len, queries["v"])))
            p, q = matrix(list(base["v"]), width), matrix(list(queries["v"]), width)
            ids, lengths, whole, asked = base["id"].to_numpy(), base["norm"].to_numpy(), list(base["v"]), list(queries["v"])
            unit = p / np.where(lengths > 0, lengths, 1)[:, None]
            norms, low, own = queries["norm"].to_numpy(), queries["low"].to_numpy(), queries["id"].to_numpy()
            most = lengths[0]
            off = rounding(width, norms * most)
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where((low > 0) & (norms * most > 0), low / (norms * most), 0.0)
                floors = np.where((low > 0) & (norms > 0), low / norms, 0.0)  # least length of a row that reaches the bound
            reach = np.searchsorted(-lengths, -floors * (1 - 1e-9) + 1e-9, side="right")

            def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
                found.append(_one(own[i], rows, scores, ids, k, off[i], lambda r: sum(int(x) * int(y) for x, y in zip(whole[r], asked[i]))))  # noqa: B905

            dense = []
            for i in np.flatnonzero(local <= 1 + 1e-9):
                t = min(local[i], 1.0)
                if t < COORDINATE:
                    dense.append(i)
                    continue
                # A row of cosine t or more with the query has its f-th part in this range.
                at = q[i] / norms[i]
                f = int(np.argmax(np.abs(at)))
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - at[f] ** 2))) + 1e-9
                part = unit[: reach[i], f]
                rows = np.flatnonzero((part >= at[f] * t - spread) if at[f] > 0 else (part <= at[f] * t + spread))
                keep(i, rows, p[rows] @ q[i])
            for at in range(0, len(dense), AT_ONCE):
                some = dense[at : at + AT_ONCE]
                for i, s in zip(some, q[some] @ p[: reach[some].max()].T, strict=True):
                    rows = np.flatnonzero(s >= low[i] - off[i])
                    keep(i, rows, s[rows])
        if not found:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return run


def _one(own: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, off: float, whole):
    """The k best rows of one query; ``whole`` gives a row's product in whole numbers where floats are off by ``off``."""
    other = ids[rows] != own
    rows, scores = rows[other], scores[other]
    if off > 0:
        if len(scores) > k:
            near = scores >= reached(np.partition(scores, len(scores) - k)[len(scores) - k]) - 2 * off
            rows = rows[near]
        exact = np.array([max(-MOST, min(MOST, whole(r))) for r in rows], np.int64)
        top = np.lexsort((ids[rows], -exact))[:k]
        return np.full(len(top), own, np.int64), ids[rows[top]].astype(np.int64), exact[top]
    top = best(scores, ids[rows], k)
    return np.full(len(top), own, np.int64), ids[rows[top]].astype(np.int64), np.rint(scores[top]).astype(np.int64)


def largest_products(vectors: DataFrame, is_query: Column, k: int, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """The k rows of ``vectors`` (id long, v array<long>) of largest product with each query.

    Queries are the rows where ``is_query`` holds.  Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))
    edges = rows.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10000)).first()[0] or []
    edges = sorted(set(edges))
    bucket = sum((F.when(F.col("norm") > e, 1).otherwise(0) for e in edges), F.lit(0)) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    stats = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()  # BUCKETS rows
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Bounds come from the longest rows and from rows in hash order, PROBES of each.
    some = [rows.orderBy(F.desc("norm"), "id").limit(PROBES), rows.orderBy(F.xxhash64("id"), "id").limit(PROBES)]
    probe = {r["id"]: r["v"] for part in some for r in part.select("id", "v").collect()}
    width = max(map(len, probe.values()))
    probe_ids = np.array(list(probe), np.int64)
    asking = rows.where(is_query).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "q.v", "q.norm")
    queries = asking.mapInArrow(
        _bounded(k, probe_ids, matrix(list(probe.values()), width), max(float(r["most"]) for r in stats)), "id long, v array<long>, norm double, low double"
    )
    # The length from which a row can reach a query's bound.
    needed = F.when((F.col("low") > 0) & (F.col("norm") > 0), F.col("low") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    queries = saved(queries.withColumn("needed", needed), "topk-queries")
    cuts = queries.agg(F.count("*").alias("n"), F.percentile_approx("needed", [i / 64 for i in range(1, 64)], 10000).alias("at")).first()
    cuts = sorted(set(cuts["at"] or [])) if cuts["n"] > tile else []
    span = sum((F.when(F.col("needed") >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    spread = F.pmod(F.xxhash64("id"), F.lit(2**31))
    queries = queries.withColumn("span", span)
    spans = queries.groupBy("span").agg(F.count("*").alias("n"), F.min("needed").alias("least")).orderBy("span").collect()  # 64 at most
    tiles = [(r["span"], -(-r["n"] // tile), float(r["least"])) for r in spans]
    blocks = [(r["bucket"], -(-r["n"] // block), float(r["most"])) for r in stats]

    def numbered(name: str, of: int):
        return lambda x: F.struct(F.lit(of).alias(name), x.alias("n"))

    def those(name: str, groups: list, hit) -> Column:
        kind = f"array<struct<{name}:int,n:int>>"
        every = [F.when(hit(edge), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), numbered(name, of))).otherwise(F.array().cast(kind)) for of, n, edge in groups]
        return F.flatten(F.array(*every)) if every else F.array().cast(kind)

    # A query goes to the blocks of buckets whose longest row can reach its bound, a row to the tiles whose least demand it meets.
    n_tiles = F.element_at(F.create_map(*[F.lit(x) for s, n, _ in tiles for x in (s, n)]), F.col("span")) if tiles else F.lit(1)
    asked = (
        queries.withColumn("tile", F.struct(F.col("span").alias("span"), (spread % n_tiles).cast("int").alias("n")))
        .withColumn("at", F.explode(those("bucket", blocks, lambda most: F.col("needed") <= F.lit(most * (1 + 1e-9)))))
        .select("at.bucket", F.col("at.n").alias("block"), "tile", "id", "v", "norm", "low")
    )
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for b, n, _ in blocks for x in (b, n)]), F.col("bucket"))
    base = rows.select(
        "bucket", (F.floor(spread / 7) % n_blocks).cast("int").alias("block"), F.explode(those("span", tiles, lambda least: F.col("norm") >= F.lit(least))).alias("tile"), "id", "v", "norm"
    )
    keys = ["bucket", "block", "tile"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_joined(k), "query_id long, vec_id long, score long")
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    return (
        found.groupBy("query_id")  # k rows from each block at most
        .agg(ranked.alias("top"))
        .select("query_id", F.posexplode("top").alias("i", "x"))
        .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
    )


def op6(embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), scaled("embedding").alias("v"))
    return largest_products(vectors, F.col("id") % 50 == 0, 5)
