"""Batches of rows put to an answerer that may fail, leave rows out or answer what was not asked."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Takes a batch's rows and the number of the attempt, gives (id, answer) pairs; it may raise.
Answerer = Callable[[list[dict], int], list[tuple[str, str]]]
ANSWERED = "id string, answer string, attempts int, error string"


def _asked(rows: list[dict], answerer: Answerer, first: int) -> tuple[dict[str, str], int, str | None]:
    """Answers to the rows, first ones first, by one call or a second one if it fails; the calls made, and the last error."""
    wanted, error = {r["id"] for r in rows}, None
    for attempt in (first, first + 1):
        try:
            out: dict[str, str] = {}
            for key, answer in answerer(rows, attempt):
                if key in wanted:
                    out.setdefault(key, answer)
            return out, attempt - first + 1, None
        except Exception as e:  # whatever the answerer raises is its answer
            error = f"{type(e).__name__}: {e}"[:300]
    return {}, 2, error


def answered(requests: DataFrame, group: str, order: list[str], answerer: Answerer, size: int) -> DataFrame:
    """``ANSWERED`` for each request (id, group and what the answerer needs): batches of ``size`` rows of a group, in order.

    A batch that fails is asked once more; ids without an answer are asked again once, together.  What has none then
    has null, with the error if there was one.  A batch depends on its group's order alone, so the same rows
    come out however Spark deals them; ids must be unique.
    """
    batch = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rows = requests.withColumn("_batch", batch).withColumn("_place", place)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asked = part.sort_values("_place").drop(columns=["_batch", "_place"]).to_dict("records")
        found, calls, error = _asked(asked, answerer, 1)
        tries = dict.fromkeys((r["id"] for r in asked), calls)
        missing = [r for r in asked if r["id"] not in found]
        if missing and error is None:
            more, again, error = _asked(missing, answerer, calls + 1)
            found |= more
            tries |= {r["id"]: calls + again for r in missing}
        return pd.DataFrame([(r["id"], found.get(r["id"]), tries[r["id"]], None if r["id"] in found else error) for r in asked], columns=["id", "answer", "attempts", "error"])

    return rows.groupBy(group, "_batch").applyInPandas(run, ANSWERED)


def same_or_not(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, same) of all questions: the answer yes counts, anything else and no answer do not."""
    said = answers.groupBy("id").agg(F.max(F.lower(F.trim("answer")).isin("true", "yes", "igen")).alias("_y"))
    return questions.select("id").join(said, "id", "left").select("id", F.coalesce("_y", F.lit(False)).alias("same"))
