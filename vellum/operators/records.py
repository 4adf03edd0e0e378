"""Changes of records as DataFrame to DataFrame steps: merging, deletion with re-derivation, patches, sets of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.sequences import first_of


def merge_records(df: DataFrame, group: str, order: list[Column], fill: list[str], sums: list[str], most: list[str]) -> DataFrame:
    """One row a group: first value that is not null in ``order`` for ``fill``, sums, maxima."""
    rank = F.struct(*order)
    return df.groupBy(group).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fill],
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in most],
    )


def without_source(evidence: DataFrame, record: str, source: str, gone: Column, order: list[Column], best: str) -> DataFrame:
    """What is left of records when a source goes: those it alone supported vanish, the others are recounted and re-picked."""
    left = evidence.where(~gone)
    counts = left.groupBy(record).agg(F.count("*").alias("evidence"))
    return counts.join(first_of(left.select(record, source, best, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [record], [F.col(f"_o{i}") for i in range(len(order))]).select(record, source, best), record)


def filled(old: DataFrame, new: DataFrame, key: str, columns: list[str], protected: Column) -> DataFrame:
    """``old`` with empty, unprotected fields taken from ``new``; rows of ``new`` without a partner are added."""
    o, n = old.alias("o"), new.alias("n")

    def field(c: str) -> Column:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(F.col(f"o.{key}").isNull(), theirs).when(protected, mine).otherwise(F.coalesce(mine, theirs)).alias(c)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[field(c) for c in columns])


def ordered_union(a: Column, b: Column) -> Column:
    """Distinct values of both arrays in the order of first sight."""
    return F.array_union(a, b)


def tag_delta(current: Column, add: Column, remove: Column) -> Column:
    """(current with add) without remove, letter case aside; the spelling seen first stays."""
    both = F.concat(current, add)
    lowered = F.transform(both, F.lower)
    first = F.filter(F.transform(both, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda s: F.array_position(lowered, F.lower(s["t"])) == s["i"] + 1)
    gone = F.transform(remove, F.lower)
    return F.filter(F.transform(first, lambda s: s["t"]), lambda t: ~F.array_contains(gone, F.lower(t)))


def changes(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed)."""
    return F.array_except(after, before), F.array_except(before, after)


def toggled(selected: Column, ids: Column) -> Column:
    """A selection after a click on all of ``ids``: without them if all were selected, with all of them else; order kept."""
    return F.when(F.size(F.array_except(ids, selected)) == 0, F.array_except(selected, ids)).otherwise(F.array_union(selected, ids))


def pruned(selected: Column, there: Column) -> Column:
    """A selection without what is gone."""
    return F.filter(selected, lambda x: F.array_contains(there, x))


def restored(kept: Column, removed: Column) -> Column:
    """A list with removed elements (struct(at, id)) back at their places, the first first."""
    back = F.array_sort(removed)
    return F.aggregate(back, kept, lambda acc, r: F.concat(F.slice(acc, F.lit(1), F.least(r["at"], F.size(acc))), F.array(r["id"]), F.slice(acc, F.least(r["at"], F.size(acc)) + 1, F.greatest(F.size(acc) - r["at"], F.lit(0)))))
