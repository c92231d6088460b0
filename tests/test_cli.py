from pyspark.sql import functions as F

from heronry import cli, models
from heronry.config import profile
from heronry.operators.filters import compile_filter


def test_index_search_ask_evaluate(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "pump.md").write_text("## Pump\n\nThe pump holds three bar. See Exhibit B for the valve.\n\n## Seal\n\nReplace the seal every month.")
    (src / "exhibit_b.md").write_text("The valve is opened by the night operator.")
    folder = str(tmp_path / "store")
    chunks = cli.build(spark, str(src), folder, most=12)
    assert chunks.select("document_id").distinct().count() == 2
    assert chunks.where(F.get_json_object("metadata", "$.metadata.crossrefs[0].target_doc") == "exhibit_b.md").count() >= 1
    q = spark.createDataFrame([("a", "is the valve opened by the night operator"), ("b", "how often replace the seal")], "query_id string, text string")
    texts = chunks.select("chunk_id", "text")
    for mode in ("default", "fast"):
        best = cli.retrieve(spark, folder, q, profile(mode)).where("rank = 1").join(texts, "chunk_id").collect()
        assert {r["query_id"]: "seal" in r["text"] or "operator" in r["text"] for r in best} == {"a": True, "b": True}
    only = cli.retrieve(spark, folder, q, profile("default"), compile_filter({"document_id": "pump.md"})).join(chunks, "chunk_id")
    assert {r["document_id"] for r in only.collect()} == {"pump.md"}
    blocks, context = cli.ask(spark, folder, "replace the seal", profile("default", {"context_window": 1}))
    assert "[Source document: pump.md]" in context.first()["context"]
    gold = tmp_path / "g.jsonl"
    gold.write_text('{"id": "g", "query": "is the valve opened by the night operator", "expected": ["night operator"], "match": "any"}\n')
    row = cli.evaluate(spark, folder, [str(gold)], profile("default")).first()
    assert row["recall_at_5"] == 1 and row["ndcg"] > 0
    assert cli.main(["search", "x", "--store", folder, "--filters", '{"nope": 1}']) == 2
    assert cli.main(["ask", "replace the seal", "--path", str(src)]) == 0
    assert "seal" in capsys.readouterr().out


def test_models(spark):
    rows = spark.createDataFrame([("a", "q word", "One word here. Nothing else."), ("b", "q", None)], "k string, q string, t string")
    assert [round(r["score"], 2) for r in models.scored(rows, "q", "t").orderBy("k").collect()] == [0.5, 0.0]
    assert [r["score"] for r in models.scored(rows, "q", "t", lambda q, t: [len(x) for x in t]).orderBy("k").collect()] == [28.0, 0.0]
    assert [(r["k"], r["t"]) for r in models.pruned(rows, "k", "q", "t", 0.4).collect()] == [("a", "One word here.")]
    v = models.hashed_embeddings(rows, "t", 16).select("k", F.size("vector").alias("n")).collect()
    assert {r["n"] for r in v} == {16}
