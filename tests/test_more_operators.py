"""Operators that a query alone does not show: writes, scorers, scopes, sources, reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry import models
from heronry.config import RequestScope, from_blocks, normalised_options, profile
from heronry.operators import catalog, chunking, context, evaluation, search
from heronry.operators.ordered import running_total
from heronry.plans import pipeline
from heronry.sources import documents, store
from heronry.streaming import state

SESSIONS = "id string, title string, created_at string, updated_at string, model_used string, message_count int"
MESSAGES = "id string, session_id string, content string, sender string, timestamp string, metadata string"


def test_catalog_writes(spark):
    s = spark.createDataFrame([("a", "t", "1", "1", None, None), ("b", "u", "1", "1", "m", 3)], SESSIONS)
    m = spark.createDataFrame([], MESSAGES)
    s2, m2 = catalog.turn_saved(s, m, "a", ("q", "why?"), ("r", "so"), "2")
    assert {(r["id"], r["message_count"], r["updated_at"]) for r in s2.collect()} == {("a", 2, "2"), ("b", 3, "1")}
    assert [(r["id"], r["sender"]) for r in m2.orderBy("id").collect()] == [("q", "user"), ("r", "assistant")]
    assert {r["title"] for r in catalog.session_renamed(s, "b", " new ", "3").collect()} == {"t", "new"}
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            catalog.session_renamed(s, "b", bad, "3")
    with pytest.raises(ValueError):
        catalog.appended(s, nope=1)
    assert catalog.inferred_metadata(spark.createDataFrame([], store.SCHEMA)).first()["status"] == "empty"
    turns = spark.createDataFrame([("s", 1, "user", "q"), ("s", 2, "assistant", "x" * 400)], "session_id string, turn int, role string, content string")
    assert catalog.history_for_rewriting(turns).first()["history"] == "user: q\nassistant: " + "x" * 300 + "..."


def test_scorers(spark):
    assert models.yes_no_scorer(lambda q, t: ([0.0, 9.0], [0.0, -9.0]))(["q"] * 2, ["a", "b"]).round(3).tolist() == [0.5, 1.0]
    order = models.ranked_texts("q", [str(i) for i in range(20)], lambda q, t: [5.0 if x == "3" else -5.0 for x in t])
    assert order[0] == (5.0, 3) and len(order) == 20
    assert len(models.ranked_texts("q", [str(i) for i in range(20)], lambda q, t: [5.0 if x == "3" else -5.0 for x in t], early_exit=True)) == 8
    models.register_scorer("overlap", lambda name: lambda q, t: np.ones(len(t)))
    models.register_scorer("broken", lambda name: 1 / 0)
    assert models.scorer_for("some/overlap-4b") is not None and models.scorer_for("x", "overlap") is not None and models.scorer_for("unknown") is None
    with pytest.warns(UserWarning):
        assert models.scorer_for("m", "broken") is None
    states, right, left = np.arange(12).reshape(2, 3, 2), [[1, 1, 0], [1, 0, 0]], [[0, 1, 1], [0, 0, 0]]
    assert models.last_token(states, right).tolist() == [[2, 3], [6, 7]] and models.last_token(states, left).tolist() == [[4, 5], [0, 0]]
    tokens = {"a": np.eye(2), "b": np.array([[1.0, 0.0]]), "": np.empty((0, 2))}
    assert models.max_sim_scorer(tokens.get)(["a", "a"], ["b", ""]).tolist() == [0.5, 0.0]
    rows = spark.createDataFrame([("x", None), ("y", "core")], "text string, core_text string")
    assert [r["score_text"] for r in models.score_text(rows).orderBy("text").collect()] == ["x", "core"]


def test_options_blocks_and_scopes():
    spec = {"retrieval_k": (int, ("retrievalK", "k")), "rerank": (bool, ()), "name": (str, ())}
    assert normalised_options({"retrievalK": "7", "k": 3, "rerank": None, "name": 5, "other": 1}, spec) == {"retrieval_k": 7, "name": "5"}
    assert normalised_options({"retrieval_k": "many"}, spec) == {"retrieval_k": "many"}
    assert from_blocks({"retrievers": {"latechunk": {"enabled": True}, "retrieval_k": 9}, "retrieval": {"retrieval_k": 4, "rerank": False}}) == {"retrieval_k": 9, "rerank": False, "late_chunk": True}
    scope = RequestScope.begin(profile("default"), {"escalation": True, "escalation_max_documents": 2})
    assert (scope.may_read(), scope.may_read(5), scope.may_read()) == (1, 1, 0) and RequestScope.begin(profile("default")).may_read() == 0
    scope.spend("rerank", 10, 2)
    scope.spend("rerank", 5, 1)
    assert scope.tokens == {"rerank": [15, 3, 2]} and scope.total() == {"prompt_tokens": 15, "output_tokens": 3, "total_tokens": 18, "calls": 2}


def test_sources(spark, tmp_path):
    for name in ("a.md", "b.md", "skip.md", "sub/c.md", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    found = documents.corpus_files(spark, str(tmp_path), files=["d.txt"], globs=["*.md", "sub/*.md"], exclusions=["skip.md"])
    assert [p.rsplit("/", 1)[-1] for p in found] == ["a.md", "b.md", "d.txt", "c.md"]
    with pytest.raises(FileNotFoundError):
        documents.corpus_files(spark, str(tmp_path), files=["none.md"])
    texts = lambda **w: {r["source"]: r["text"] for r in documents.source_texts(spark, w, str(tmp_path)).collect()}
    assert texts(document="a.md") == {"a.md": "text of a.md"} and texts(documents_dir="sub") == {"c.md": "text of sub/c.md"} and len(texts(source_glob="*.md")) == 3 and texts(source_glob="*.no") == {}
    with pytest.raises(ValueError):
        documents.source_texts(spark, {}, str(tmp_path))
    for n in ("one", "two"):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"id": n, "passage": "p", "expected": ["x"]}) + "\n")
    sets = {n: str(tmp_path / f"{n}.jsonl") for n in ("one", "two")}
    assert [r["id"] for r in documents.read_gold(spark, sets).collect()] == ["one", "two"] and documents.read_gold(spark, sets, ["two"]).first()["passage"] == "p"
    with pytest.raises(ValueError):
        documents.read_gold(spark, sets, ["three"])
    for n in ("i1", "overviews"):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"doc_id": f"{n}-{i:02d}", "overview": "x"}) + "\n" for i in range(50)))
    assert store.index_overviews(spark, str(tmp_path), ["i1", "i2"]).count() == 40 and store.index_overviews(spark, str(tmp_path), ["i1"], None).count() == 50
    assert {r["doc_id"][:9] for r in store.index_overviews(spark, str(tmp_path), ["i9"]).collect()} == {"overviews"} and store.index_overviews(spark, str(tmp_path / "sub"), ["i"]).count() == 0


def test_store_path(monkeypatch):
    monkeypatch.delenv("HERONRY_STORE", raising=False)
    assert store.store_path("x") == "x" and store.store_path() == "./heronry-store"
    monkeypatch.setenv("HERONRY_STORE", "y")
    assert store.store_path() == "y" and store.store_path("x") == "x"


def test_running_total_of_a_hot_key(spark):
    rows = [("hot", i % 997, i, i % 7) for i in range(4000)] + [(None, i, i, 1) for i in range(5)] + [("cold", 0, 0, 9)]
    df = spark.createDataFrame(rows, "k string, a int, b int, x int")
    got = {(r["k"], r["b"]): r["t"] for r in running_total(df, "k", ["a", "b"], F.col("x"), "t").collect()}
    total, want = {}, {}
    for k, _, b, x in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[k, b] = total.get(k, 0)
        total[k] = total.get(k, 0) + x
    assert got == want and running_total(df.where("false"), "k", ["a"], F.lit(1), "t").count() == 0


def test_percentile_against_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 777), (None, 12)) for v in rng.integers(0, 50, n)] + [("none", None)]
    got = {r["k"]: r["value"] for r in evaluation.low_rank_percentile(spark.createDataFrame(rows, "k string, x double"), "k", "x", 0.9).collect()}
    for k in ("a", "b", None):
        xs = sorted(x for n, x in rows if n == k)
        assert got[k] == xs[int(0.9 * (len(xs) - 1))]
    assert got["none"] is None


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)] + [(2000, None), (2001, [1.0]), (2002, [])]
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(4)] + [("short", [2.0]), ("null", None)], "query_id string, query array<double>")
    for metric in ("distance", "cosine"):
        want = search.ranked(search.knn_scores(df, q, "id", metric=metric), "id", 10, descending=metric != "distance")
        key = lambda f: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in f.collect())
        assert key(search.nearest(df, q, "id", 10, metric=metric)) == key(want)
    assert search.nearest(df.where("false"), q, "id", 3).count() == 0


def test_equal_texts_have_equal_scores(spark):
    rng = np.random.default_rng(5)
    terms = [f"t{i}" for i in range(7)]
    rows = [(terms[i], k, 1 + i % 3, 40) for k in range(200) for i in rng.permutation(7).tolist()] + [(t, 1000 + 10 * n + i, 1, 5) for n, t in enumerate(terms) for i in range(n)]
    posted = spark.createDataFrame(rows, "term string, id int, tf int, dl int").coalesce(1)
    stats = spark.createDataFrame([(5000, 33.3)], "n long, avgdl double")
    asked = spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")
    assert search.bm25_of(posted, stats, asked, "id").where("id < 200").select("score").distinct().count() == 1


def test_one_word_and_quotes(spark):
    voc = spark.createDataFrame([("valve",), ("valves",), ("salve",), ("pump",)], "term string")
    q = spark.createDataFrame([("a", '"Valve"'), ("b", "pump valve"), ("c", None)], "query_id string, text string")
    assert sorted((r["query_id"], r["term"]) for r in search.expanded_terms(q, voc).collect()) == [("a", "salve"), ("a", "valve"), ("a", "valves"), ("b", "pump"), ("b", "valve")]


def test_integrity_and_reports(spark):
    gold = spark.createDataFrame([("1", "s1", ["Alpha  one"], ["f1"]), ("2", "s1", ["beta"], ["f1", "gone"]), ("3", "s2", ["nowhere"], ["f2"]), ("4", "s2", [], [])], "id string, source string, expected array<string>, fact_ids array<string>")
    sources = spark.createDataFrame([("s1", "alpha one and beta"), ("s2", "beta too"), ("s3", None)], "source string, text string")
    facts = spark.createDataFrame([("f1",), ("f2",)], "fact_id string")
    assert sorted(tuple(r) for r in evaluation.integrity(gold, sources, facts).collect()) == [("1", True, True, True), ("2", True, False, False), ("3", False, False, True), ("4", True, True, True)]
    first = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("p", 1, "a")], "id string, rank int, chunk_id string")
    final = first.where("id = 'q'").withColumn("via_crossref", F.lit(False)).unionByName(spark.createDataFrame([("q", 3, "c", True), ("p", 1, "z", False)], "id string, rank int, chunk_id string, via_crossref boolean"))
    assert {r["id"]: r["same"] for r in evaluation.invariant(first, final).collect()} == {"q": True, "p": False}
    hops = spark.createDataFrame([("a", 2, True), ("b", 1, False), ("c", 0, True)], "id string, hop_chunks int, hit_expected_source boolean")
    assert evaluation.hop_summary(hops).first().asDict() == {"queries": 3, "fired": 2, "fire_rate": 2 / 3, "precision": 0.5}
    metrics = spark.createDataFrame([("a", 1, 0.5), ("b", 0, None)], "id string, recall_at_5 int, ndcg double")
    body = json.loads(evaluation.results_json({"mode": "x"}, metrics, invariant_rows=evaluation.invariant(first, final)))
    assert body["summary"]["queries"] == 2 and body["summary"]["ndcg"] == 0.5 and body["invariant_broken"] == ["p"]
    table = evaluation.text_table([r.asDict() for r in metrics.collect()], metrics.columns).split("\n")
    assert len(table) == 5 and table[1] == table[4] and "0.5000" in table[2]


def test_remembered_answers(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.append(sorted(r["query"] for r in keys.collect()))
        return keys.withColumn("answer", F.upper("query"))

    keys = lambda *qs, model="m": spark.createDataFrame([("c", model, q) for q in qs], "corpus string, model string, query string")
    by, path = ["corpus", "model", "query"], str(tmp_path / "kept")
    assert evaluation.remembered(spark, path, keys("a", "b"), compute, by).count() == 2
    assert {r["answer"] for r in evaluation.remembered(spark, path, keys("b", "c"), compute, by).collect()} == {"B", "C"}
    evaluation.remembered(spark, path, keys("b", model="n"), compute, by)
    assert asked == [["a", "b"], ["c"], ["b"]]


def test_escalation_block(spark):
    pieces = spark.createDataFrame([("d2", 0, "x", False), ("d1", 1, "b", True), ("d1", 0, "a", True)], "document_id string, chunk_index int, piece string, truncated boolean")
    block = context.escalation_block(pieces)
    assert block.first()["block"] == "=== Full document: d1 (truncated) ===\na\n\nb\n=== End of document ===\n\n=== Full document: d2 ===\nx\n=== End of document ==="
    c = spark.createDataFrame([("facts",)], "context string")
    assert context.with_block(c, block).first()["context"].startswith("facts\n\n=== Full") and context.with_block(c, context.escalation_block(pieces.where("false"))).first()["context"] == "facts"


def _table(spark):
    rows = [("a_0", "a", 0, "the pump holds three bar"), ("a_1", "a", 1, "the seal is replaced every month"), ("b_0", "b", 0, "the valve is opened by the operator"), ("c_0", "c", 0, "escrow terms and nothing else")]
    return models.hashed_embeddings(spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string"), "text", 64)


def _ask(spark, text):
    return models.hashed_embeddings(spark.createDataFrame([("q", text)], "query_id string, text string"), "text", 64).withColumnRenamed("vector", "query")


def test_every_profile_flag_is_obeyed(spark):
    chunks, q = _table(spark).withColumn("metadata", F.lit("{}")), _ask(spark, "seal replaced every month")
    overviews = chunks.where("chunk_index = 0").select("document_id", "vector")
    base = {"rerank": False, "retry": False}
    ids = lambda out: [r["chunk_id"] for r in out.final.orderBy("rank").collect()]
    plain = ids(pipeline.answer(chunks, q, profile("default", base)))
    nearest = pipeline.best_documents(overviews, q, 1).first()["document_id"]
    only = ids(pipeline.answer(chunks, q, profile("default", base, {"overview_prefilter": "restrict", "overview_top_documents": 1}), overviews=overviews))
    assert set(only) == {r["chunk_id"] for r in chunks.where(F.col("document_id") == nearest).collect()} < set(plain)
    boost = ids(pipeline.answer(chunks, q, profile("default", base, {"overview_prefilter": "boost", "overview_top_documents": 1}), overviews=overviews))
    assert set(boost) == set(plain)
    nothing = spark.createDataFrame([("zz", [0.0] * 64)], "document_id string, vector array<float>")
    assert ids(pipeline.answer(chunks, q, profile("default", base, {"overview_prefilter": "restrict"}), overviews=nothing)) == plain
    wide = pipeline.answer(chunks, q, profile("fast", {"retrieval_k": 1, "context_window": 1}))
    assert {r["chunk_id"] for r in wide.expanded.collect()} == {"a_0", "a_1"}
    config = profile("fast", {"retrieval_k": 3, "escalation": True, "retry_min_top_score": 1.0})
    found = pipeline.answer(chunks, q, config)
    assert [r["document_id"] for r in found.escalated.collect()] == ["a"]
    _, text = pipeline.full_context(chunks, found, config)
    assert text.first()["context"].endswith("=== Full document: a ===\nthe pump holds three bar\n\nthe seal is replaced every month\n=== End of document ===")
    assert pipeline.scoped_search(None, q, config, overviews) is None and pipeline.scoped_search(chunks, q, config, nothing).count() == 0
    late = chunks.select("chunk_id", "document_id", "chunk_index", "text", (F.col("vector")).alias("vector"))
    row = pipeline.late_blocks(late, chunks, q, 1).first()
    assert row["core_text"] == "the seal is replaced every month" and row["merged_text"] == "the pump holds three bar \nthe seal is replaced every month"


def test_chunks_against_plain_growing(spark):
    """Runs of sentences as grown one by one, joined and measured each time."""
    import re

    def plain(text, most, overlap):
        said = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
        out, i = [], 0
        while i < len(said):
            n = 1
            while i + n < len(said) and max(1, len(" ".join(said[i : i + n + 1])) // 4) <= most:
                n += 1
            out.append(" ".join(said[i : i + n]))
            if i + n == len(said):
                break
            i = max(i + 1, i + n - overlap)
        return out

    rng = np.random.default_rng(2)
    for _ in range(60):
        text = " ".join("x" * int(rng.integers(1, 60)) + "." for _ in range(int(rng.integers(0, 40))))
        for most, overlap in ((5, 0), (12, 1), (12, 3), (60, 1)):
            assert chunking.pack_sentences(text, most, overlap) == plain(text, most, overlap)


def test_long_elements_stay_whole(spark):
    rows = [("d", 0, "paragraph", 0, "a" * 100, 1), ("d", 1, "paragraph", 0, "b" * 20, 2), ("d", 2, "paragraph", 0, "c" * 20, 2), ("d", 3, "heading", 1, "H", 2), ("d", 4, "paragraph", 0, "d" * 20, None), ("d", 5, "paragraph", 0, "e" * 20, 3)]
    df = spark.createDataFrame(rows, "document_id string, position int, type string, level int, text string, page int")
    got = [(r["heading_path"], r["page"], r["text"]) for r in chunking.chunk_elements(df, 12).orderBy("chunk_index").collect()]
    assert got == [([], 1, "a" * 100), ([], 2, "b" * 20 + " " + "c" * 20), (["H"], 3, "d" * 20 + " " + "e" * 20)]


def test_progress():
    class Query:
        name, left = "q", 3

        @property
        def isActive(self):
            self.left -= 1
            return self.left > 0

        @property
        def lastProgress(self):
            return {"name": "q", "batchId": 7 - self.left // 2, "numInputRows": 5, "processedRowsPerSecond": 2.4}

    said = []
    state.report_progress(Query(), said.append, wait=lambda s: None)
    assert said and all(x.startswith("q: batch") for x in said) and len(set(said)) == len(said)


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from heronry.session import shared_dir

    conf = SimpleNamespace(get=lambda name: None)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, _jsc=jsc, master="spark://x:7077")))


def test_a_name_of_forty_words_is_found(spark):
    from heronry.operators import crossref

    name = " ".join(f"part{i}" for i in range(40))
    df = spark.createDataFrame([("c1", "main.pdf", f"See the {name.upper()} for more."), ("c2", name.replace(" ", "_") + ".pdf", "x")], "chunk_id string, document_id string, text string")
    assert [r["ref"] for r in crossref.mentions(df, crossref.names(df)).collect()] == [name]


def test_word_files(spark, tmp_path):
    from zipfile import ZipFile

    p = lambda t, style=None, item=False: f"<w:p><w:pPr>{f'<w:pStyle w:val=\"{style}\"/>' if style else ''}{'<w:numPr/>' if item else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Pumps", "Heading2") + p("Close &amp; lock.") + p("one", item=True) + p(" ") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    with ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r["document_id"]: r["markdown"] for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.docx": "## Pumps\n\nClose & lock.\n\n- one\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "bad.docx": None}


def test_routes_and_unmarked_tables(spark):
    from heronry.functions.text import wants_retrieval

    df = spark.createDataFrame([("hi", True, None, None), ("hi", True, None, '{"document_id": "a"}'), ("hi", False, True, None), ("which valve", True, None, ""), ("which valve", None, None, None)], "m string, i boolean, f boolean, x string")
    assert [r[0] for r in df.select(wants_retrieval(F.col("m"), F.col("i"), F.col("f"), F.col("x"))).collect()] == [False, True, True, True, False]
    with pytest.warns(UserWarning):
        assert store.check_marker(None, "any") is False
    q = models.hashed_embeddings(spark.createDataFrame([("q", "operato")], "query_id string, text string"), "text", 64).withColumnRenamed("vector", "query")
    assert pipeline.first_stage(_table(spark), q, profile("default", {"search_type": "fts_only"})).first()["chunk_id"] == "b_0"


def test_many_terms_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 30, int(rng.integers(0, 20))))) for i in range(80)] + [(99, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    terms = spark.createDataFrame([(f"q{i % 3}", f"w{i}") for i in range(12)], "query_id string, term string")
    score = lambda: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in search.bm25_scores(texts, terms, "id").collect())
    few = score()
    monkeypatch.setattr(search, "MOST_TERMS", 3)
    assert few and score() == few
