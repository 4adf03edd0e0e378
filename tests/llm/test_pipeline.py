"""The pipeline's stages on odd rows, and the whole against a brute-force version of what it keeps."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_join, brute_pieces, brute_runs, odd_rows
from vellum.llm import linededup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = odd_rows() + [(9000 + i, "%%% ### !!! " * 40, "en", "s", 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    known = [(i, int(i < 9000)) for i, *_ in rows if i is not None]
    spark.createDataFrame([(i, q, 0) for i, q in known], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "line_dedup", "jaccard_join", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, folder).collect()}
    assert not kept & {400, 401, 402, 403}
    assert set(range(60)) <= kept


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    assert len(set(range(60)) - kept) <= 3
    assert not kept & set(range(9000, 9030))


def test_line_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    gone = brute_runs(rows, linededup.MIN_WORDS)
    out = {(r.doc_id, r.text) for r in corpus_pipeline.line_stage(spark, docs, folder).collect()}
    assert out == {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t, *_ in rows}


def test_near_copy_stage(spark, folder):
    """Of each group of texts linked by five words and 0.8 the least id stays, and all texts that are linked with none."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in docs.collect()]
    first = {i: c for (i, _, c, _), n in brute_join(rows, 5, 80).items()}
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, folder).collect())
    assert kept == sorted(i for i, *_ in rows if first[i] == i)


def test_packing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    out = corpus_pipeline.packing_stage(spark, docs.withColumns({"length": F.lit("x"), "piece": F.lit("x"), "offset": F.lit("x")}), folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == collections.Counter(brute_pieces(rows))


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    last = docs.collect()
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id or -1 for r in out if r.piece == 0) == sorted(r.doc_id or -1 for r in last)
