"""Rows from a model's answers: JSON inside chatter, fields of loose form, first answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _values(text: str) -> list:
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    while True:
        at = min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)
        if at < 0:
            return out
        try:
            value, at = read(text, at)
            out.append(value)
        except ValueError:
            at += 1


def _one(text: str | None) -> str | None:
    """The JSON of an answer: several objects become one with their lists joined, several lists one list."""
    found = _values(text or "")
    if not found:
        return None
    if all(isinstance(v, dict) for v in found):
        out: dict = {}
        for v in found:
            for k, x in v.items():
                out[k] = out[k] + x if isinstance(x, list) and isinstance(out.get(k), list) else out.get(k, x)
        return json.dumps(out, ensure_ascii=False)
    return json.dumps([x for v in found for x in v] if all(isinstance(v, list) for v in found) else found[0], ensure_ascii=False)


def json_of(answer: Column) -> Column:
    """JSON in an answer with fences or words about it, null without any; balanced braces are beyond patterns, so texts go through Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_one, na_action="ignore")

    return F.pandas_udf(run, "string")(answer)


def rows_of(answers: DataFrame, answer: str, name: str, schema: str, keep: list[str]) -> DataFrame:
    """``keep`` and the fields of each element of the list ``name`` (or of a bare list); elements of another form have null fields."""
    found = json_of(F.col(answer))
    listed = F.coalesce(F.from_json(found, f"struct<`{name}`: array<struct<{schema}>>>")[name], F.from_json(found, f"array<struct<{schema}>>"))
    return answers.select(*keep, F.posexplode(listed).alias("place", "_e")).select(*keep, "place", "_e.*")


def first_answers(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of several answers with the same key the first."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f"))
    return best.select(*key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def answered(asked: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the answer to each question, false without one."""
    one = first_answers(rows.select(key, "place", value), [key], ["place"])
    return asked.select(key).distinct().join(one, key, "left").select(key, F.coalesce(F.col(value).cast("boolean"), F.lit(False)).alias(value))


def truth(c: Column) -> Column:
    """Loose booleans: true, yes, 1; everything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def clean(c: Column, most: int) -> Column:
    """Text without control characters and runs of white space; the words for nothing are null; cut at ``most`` with a sign of omission."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cc}+", " "), r"\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"[\s,;:.–-]+$", ""), F.lit("…"))
    return F.when((t == "") | F.lower(t).isin("null", "none", "n/a", "unknown", "-"), None).when(F.length(t) > most, cut).otherwise(t)


def tags(raw: Column) -> Column:
    """Tags of a field parted by commas, semicolons or lines: trimmed, those that fold alike once."""
    from vellum.functions.text import fold

    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,;\n]"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: fold(x) == fold(t)), acc).otherwise(F.concat(acc, F.array(t))))


def longest_prefix(names: DataFrame, name: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """``names`` with the value of the table's key that equals the name, or of the longest one that it begins with (before a hyphen)."""
    low = F.lower(F.trim(F.col(name)))
    met = names.select(name).distinct().join(F.broadcast(table), (low == F.col(key)) | F.startswith(low, F.concat(F.col(key), F.lit("-"))))  # a price list: some rows
    best = met.groupBy(name).agg(F.max(F.struct(F.length(key).alias("n"), F.col(value).alias("v")))["v"].alias(value))
    return names.join(best, name, "left")
