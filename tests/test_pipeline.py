import pytest
from pyspark.sql import functions as F

from heronry.config import profile
from heronry.models import hashed_embeddings
from heronry.operators import chunking
from heronry.plans import pipeline


def _table(spark):
    rows = [("a_0", "a", 0, "the pump holds three bar"), ("a_1", "a", 1, "the seal is replaced every month"), ("b_0", "b", 0, "the valve is opened by the operator"), ("c_0", "c", 0, "escrow terms and dates")]
    return hashed_embeddings(spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string"), "text", 64)


def _ask(spark, text):
    return hashed_embeddings(spark.createDataFrame([("q", text)], "query_id string, text string"), "text", 64).withColumnRenamed("vector", "query")


def test_final_is_the_first_stage_when_all_is_off(spark):
    off = profile("default", {"rerank": False, "retry": False})
    out = pipeline.answer(_table(spark), _ask(spark, "who opened the valve"), off)
    assert [r["chunk_id"] for r in out.first_stage.orderBy("rank").collect()] == [r["chunk_id"] for r in out.final.orderBy("rank").collect()]


def test_all_steps(spark):
    chunks, q = _table(spark), _ask(spark, "seal replaced every month")
    refs = spark.createDataFrame([("a_1", 0, "c")], "chunk_id string, position int, target_doc string")
    config = profile("default", {"retrieval_k": 2, "rerank_min_keep": 1, "crossref_hop": True})
    out = pipeline.answer(chunks, q, config, second=_ask(spark, "valve opened"), references=refs)
    final = out.final.orderBy("rank").collect()
    assert final[0]["chunk_id"] == "a_1" and (final[-1]["chunk_id"], final[-1]["via_crossref"]) == ("c_0", True)
    assert out.evidence.first()["evidence"] is not None
    assert pipeline.packed_context(chunks, out.final, config).first()["context"].startswith("[Source document: a]\nthe seal")


def test_citations(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1), (2, "z", 2)], "sub_answer int, chunk_id string, rank int")
    assert sorted((r["sub_answer"], r["chunk_id"]) for r in pipeline.composed(df, 2).collect()) == [(1, "x"), (1, "y"), (2, "z")]


def test_late_chunks(spark):
    n = spark.range(40).select(F.col("id"), chunking.late_windows(F.col("id"), 16).alias("w")).collect()
    for r in n:  # the plain definition: windows [12 w, 12 w + 16)
        assert r["w"] == next(w for w in range(9) if 12 * w <= r["id"] < 12 * w + 16)
    tokens = spark.createDataFrame([("d", 0, [1.0, 2.0]), ("d", 1, [3.0, float("nan")]), ("d", 5, [9.0, 9.0])], "document_id string, at int, vector array<double>")
    places = spark.createDataFrame([("c", "d", 0, 2), ("e", "d", 2, 4)], "chunk_id string, document_id string, start int, end int")
    assert [(r["chunk_id"], r["vector"]) for r in chunking.pooled_spans(tokens, places).collect()] == [("c", [2.0, 1.0])]


def _long_table(spark, folder):
    """400 chunks of one document, the farther from the first the higher their index; five of them speak of the question."""
    rows = []
    for i in range(400):
        text = " ".join(pipeline.TERMS) if 300 <= i < 305 else f"plain words {i}"
        rows.append(([1.0 + i] + [1.0] * 63, text, f"c_{i:03d}", "d", i, "{}"))
    df = spark.createDataFrame(rows, "vector array<float>, text string, chunk_id string, document_id string, chunk_index int, metadata string")
    df.coalesce(1).write.parquet(f"{folder}/text_pages.parquet")
    return str(folder)


@pytest.fixture
def short_batches(spark):
    """A task gets its rows in several Arrow batches, as it does of a large table."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4")
    yield
    spark.conf.set(name, before)


def test_default_over_several_batches(spark, tmp_path, short_batches):
    found = pipeline.pipeline_default(spark, _long_table(spark, tmp_path))
    assert sorted((r["rank"], r["chunk_id"]) for r in found.collect()) == [(n + 1, f"c_{300 + n}") for n in range(5)]


def test_expanded_over_several_batches(spark, tmp_path, short_batches):
    found = pipeline.pipeline_expanded(spark, _long_table(spark, tmp_path))
    want = [(f"c_{i:03d}", i, max(1, i)) for i in range(11)]  # ten seeds and the neighbour of the last; the best seed claims a chunk
    assert sorted((r["chunk_id"], r["chunk_index"], r["seed_rank"]) for r in found.collect()) == want


def test_fast_over_several_batches(spark, tmp_path, short_batches):
    found = pipeline.pipeline_fast(spark, _long_table(spark, tmp_path))
    assert sorted((r["rank"], r["chunk_id"]) for r in found.collect()) == [(i + 1, f"c_{i:03d}") for i in range(10)]
