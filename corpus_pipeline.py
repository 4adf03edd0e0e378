"""A training corpus from ``documents``: language, quality, line dedup, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of documents.  ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard, langid, linededup, packing, quality
from vellum.llm.common import saved, table

#: Part of a text's n-grams that its language must know; clean text of any size lies far above.
LEAST_COVERAGE = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the corpus' languages.

    Rejected: null texts, texts without letters, and texts of which hardly an n-gram is
    known.  Where no language can be learnt (no text has a ``lang``) all texts stay.  Empty texts have
    no letters; very long ones are read whole; repeated rows and rows of equal or null ids are judged
    each, equal texts alike; ties between languages do not matter, since any known one keeps a text;
    further columns stay; an empty table stays empty.
    """
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        return docs
    found = langid.identified(docs, model)
    good = (F.col("found.lang_pred") != "und") & (F.col("found.coverage") >= LEAST_COVERAGE)
    return found.where(good).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score at least the ranking's threshold.

    Null and empty texts are scored as any other; without both labels every document stays; rows of
    equal ids are scored each; further columns stay.  A score equal to the threshold keeps its document;
    very long texts are measured whole; an empty table stays empty.
    """
    model = quality.fit(quality.measured(docs), table(spark, sf_dir, "labels"), F.lit(True))
    return quality.scored(docs, model).where(F.col("score") >= quality.CUT).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; every document stays, with its new text and n_chars.

    Null and empty texts stay as they are; rows equal in id and text keep the same lines; texts of
    any length are read whole; an empty table stays empty.
    """
    new = linededup.deduplicated(docs)
    return new.select(*[_changed(c) for c in docs.columns])


def _changed(column: str):
    if column == "text":
        return F.col("new.text").alias("text")
    old = F.col(f"row.`{column}`")
    if column == "n_chars":
        return F.when(F.size("new.deleted") > 0, F.length("new.text").cast("long")).otherwise(old).alias(column)
    return old.alias(column)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one of least id (and of rows with its id and text one).

    Null texts, and texts without words, are linked with nothing and stay; so do rows without an id
    unless such a copy is there; an empty table stays empty.
    """
    return jaccard.first_of_groups(docs, words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; the columns of op3.

    A null or empty text is the one piece of the closing id; longer texts than a sequence are cut;
    rows of null or equal ids are packed each; columns other than doc_id and text stay out.
    """
    return packing.op3(docs, words=400_000)  # workers still hold what the stages before needed


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_copy_stage),
    ("packing", packing_stage),
]

#: Models, tokenizers and components are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
