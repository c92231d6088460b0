import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.operators import catalog, chunking, context, crossref, evaluation, fusion, rerank, search


def test_bm25_against_plain_python(spark):
    texts = {1: "pump valve pump", 2: "valve", 3: "", 4: None, 5: "Pump-house, other words!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    q = spark.createDataFrame([("q", "pump"), ("q", "valve"), ("q", "pump")], "query_id string, term string")
    got = {r["doc_id"]: r["score"] for r in search.bm25_scores(df, q, "doc_id").collect()}
    toks = {k: [t for t in re.split(r"[^a-z0-9]+", (v or "").lower()) if t] for k, v in texts.items()}
    toks = {k: v for k, v in toks.items() if v}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    want = {}
    for t in ("pump", "valve"):
        df_ = sum(t in v for v in toks.values())
        for k, v in toks.items():
            if t in v:
                tf = v.count(t)
                want[k] = want.get(k, 0) + math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / avg))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id int, text string")
    search.write_index(df, "doc_id", str(tmp_path), buckets=4)
    posted, stats = search.read_index(spark, str(tmp_path), ["b"], buckets=4)
    assert sorted((r["doc_id"], r["tf"], r["dl"]) for r in posted.collect()) == [(1, 2, 3), (2, 1, 2)]
    assert stats.first()["n"] == 2


def test_filter_lies_below_the_ranking(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("query_id"), F.rand(1).alias("score"))
    plan = search.ranked(df.where("doc_id < 10"), "doc_id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("Filter") < plan.index("Range")


@given(st.permutations(["a", "b", "c", "d"]), st.permutations(["a", "c", "e"]))
@settings(max_examples=5, deadline=None)
def test_fusion_does_not_depend_on_the_order_of_legs(spark, one, two):
    leg = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "k string, rank int")
    ab = {r["k"]: round(r["rrf"], 12) for r in fusion.fuse({"x": leg(one), "y": leg(two)}, "k").collect()}
    ba = {r["k"]: round(r["rrf"], 12) for r in fusion.fuse({"y": leg(two), "x": leg(one)}, "k").collect()}
    want = {k: round(sum(1 / (61 + ids.index(k)) for ids in (one, two) if k in ids), 12) for k in {*one, *two}}
    assert ab == ba == want


def test_round_robin_and_first_wins(spark):
    hits = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 1, 2), ("c", 2, 2)], "k string, rank int, sub_query int")
    assert [(r["k"], r["sub_queries"]) for r in fusion.round_robin(hits, "k").orderBy("position").collect()] == [("a", [1, 2]), ("b", [1]), ("c", [2])]
    rows = spark.createDataFrame([("d", 1, "x"), ("d", 1, "y"), (None, None, "z"), (None, None, "w")], "document_id string, chunk_index int, leg string")
    assert sorted(r["leg"] for r in fusion.first_wins(rows, ["document_id", "chunk_index"], ["leg"]).collect()) == ["w", "x", "z"]


def _select(scores, least, min_keep, top_k, rescue):
    """Threshold selection in plain Python."""
    keys = sorted({k for k, _, _ in scores})
    mean = {k: sum(s for a, _, s in scores if a == k) / sum(a == k for a, _, _ in scores) for k in keys}
    best = {k: max(s for a, _, s in scores if a == k) for k in keys}
    order = sorted(keys, key=lambda k: (-mean[k], k))
    kept = {k for k in keys if best[k] >= least}
    if rescue:
        extra = set()
        for sq in sorted({q for _, q, _ in scores}):
            members = [(k, s) for k, q, s in scores if q == sq]
            if not any(k in kept or k in extra for k, _ in members):
                extra.add(min(members, key=lambda m: (-m[1], m[0]))[0])
        kept |= extra
    if len(kept) < min_keep:
        kept |= set(order[:min_keep])
    return [k for k in order if k in kept][:top_k]


def test_threshold_with_rescue_against_plain_python(spark):
    rng = random.Random(4)
    for case in range(4):
        scores = [(f"c{i}", q, round(rng.random(), 2)) for i in range(8) for q in range(3) if rng.random() < 0.6]
        df = spark.createDataFrame(scores, "k string, sub_query int, score double")
        for rescue in (False, True):
            got = [r["k"] for r in rerank.select_by_threshold(df, "k", 0.8, min_keep=2, top_k=5, rescue=rescue).orderBy("rank").collect()]
            assert got == _select(scores, 0.8, 2, 5, rescue), (case, rescue)


def test_evidence(spark):
    df = spark.createDataFrame([(1, [0.9] + [0.5] * 9), (2, [0.3, 0.2]), (3, [0.4]), (4, [1.0, 1.0]), (5, [])], "i int, s array<double>")
    got = [r[0] for r in df.orderBy("i").select(rerank.contrast(F.col("s"))).collect()]
    assert math.isclose(got[0], 0.8) and math.isclose(got[1], 0.125) and got[2:] == [None, None, None]
    low, high = (spark.createDataFrame([(n, e)], "chunk_id string, evidence double") for n, e in (("old", 0.1), ("new", 0.3)))
    assert rerank.better_attempt(low, high).first()["chunk_id"] == "new" and rerank.better_attempt(high, low).first()["chunk_id"] == "new"
    assert rerank.better_attempt(low, low.where("false")).first()["chunk_id"] == "old"


def test_restrict_widens_only_when_empty(spark):
    c = spark.createDataFrame([("a", "d1"), ("b", "d2")], "k string, document_id string")
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    assert rerank.restricted(c, docs("d1")).count() == 1 and rerank.restricted(c, docs("zz")).count() == 2


def test_budget_goes_on_after_a_block_too_large(spark):
    rows = [(1, "a", "d", "x" * 100, [0]), (2, "b", "d", "x" * 1000, [1]), (3, "c", "d", "x" * 50, [2]), (4, "e", "d", "x" * 10, [0]), (5, "f", "d", "x" * 10, [])]
    df = spark.createDataFrame(rows, "rank int, chunk_id string, document_id string, text string, span array<int>")
    assert sorted(r["chunk_id"] for r in context.pack_budget(df, 60).collect()) == ["a", "c", "f"]
    assert [r["chunk_id"] for r in context.pack_budget(df.where("rank = 2"), 60).collect()] == ["b"]


def test_window_sees_gaps_and_unknown_indexes(spark):
    rows = [("a", "d", 0, "A"), ("b", "d", 1, "B"), ("c", "d", 3, "C"), ("u", "d", -1, "U"), ("n", None, 0, "N")]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string")
    got = {r["chunk_id"]: r["window_text"] for r in context.context_window(df, 1).collect()}
    assert got == {"a": "A B", "b": "A B", "c": "C", "u": "U", "n": "N"}


def test_hop_appends_and_is_off_without_references(spark):
    c = spark.createDataFrame([("a", "d1", 1), ("b", "d2", 2)], "chunk_id string, document_id string, rank int")
    refs = spark.createDataFrame([("a", 0, "d2"), ("a", 1, "d3"), ("b", 0, "d4")], "chunk_id string, position int, target_doc string")
    scored = spark.createDataFrame([("x", "d3", 0.2), ("y", "d3", 0.1), ("z", "d4", 0.3)], "chunk_id string, document_id string, score double")
    assert [r["chunk_id"] for r in context.hop(c, refs, scored, max_hops=1, per_hop=1).orderBy("rank").collect()] == ["a", "b", "y"]
    assert [r["chunk_id"] for r in context.hop(c, refs.where("false"), scored).orderBy("rank").collect()] == ["a", "b"]


def test_references(spark):
    text = "See Exhibit B and exhibit b, Appendix No. 2.1, Section 4.3; clause 4.3, § 7 and the escrow agreement. appendix in the margin"
    df = spark.createDataFrame([("c1", "main.pdf", text), ("c2", "05_escrow_agreement.pdf", None), ("c3", "exhibit_b.pdf", "nothing")], "chunk_id string, document_id string, text string")
    got = [(r["kind"], r["ref"], r["target_doc"]) for r in crossref.annotate(df).orderBy("position").collect()]
    assert got == [("exhibit", "exhibit b", "exhibit_b.pdf"), ("exhibit", "appendix 2.1", None), ("section", "section 4.3", None), ("section", "section 7", None), ("document", "escrow agreement", "05_escrow_agreement.pdf")]
    s = crossref.statistics(crossref.annotate(df)).first()
    assert (s["chunks_with_refs"], s["refs"], s["resolved"], s["target_docs"]) == (1, 5, 2, 2)


@given(st.lists(st.sampled_from(["One two three.", "Short.", "A much longer sentence with many words in it.", "\n", "## Head\n", "word " * 30]), max_size=12))
@settings(max_examples=40, deadline=None)
def test_chunks_keep_every_word(parts):
    text = " ".join(parts)
    pieces = chunking.split_markdown(text, 10)
    assert " ".join(" ".join(pieces).split()) == " ".join(text.split())
    runs = chunking.pack_sentences(text, 10, 0)
    assert " ".join(" ".join(runs).split()) == " ".join(text.split())
    again = chunking.pack_sentences(text, 10, 1)
    assert set(" ".join(again).split()) == set(text.split())


def test_elements(spark):
    rows = [("d", 0, "heading", 1, "Top", 1), ("d", 1, "paragraph", 0, "One.", 1), ("d", 2, "paragraph", 0, "Two.", 1), ("d", 3, "table", 0, "|a|", 1), ("d", 4, "paragraph", 0, " ", 2), ("d", 5, "paragraph", 0, "Three.", None)]
    df = spark.createDataFrame(rows, "document_id string, position int, type string, level int, text string, page int")
    got = [(r["block_type"], r["heading_path"], r["page"], r["text"]) for r in chunking.chunk_elements(df).orderBy("chunk_index").collect()]
    assert got == [("paragraph", ["Top"], 1, "One. Two."), ("table", ["Top"], 1, "|a|"), ("paragraph", ["Top"], None, "Three.")]


def test_metrics(spark):
    rel = spark.createDataFrame([("q", r, x) for r, x in ((1, 0), (2, 1), (3, 1))] + [("z", 1, 0)], "id string, rank int, rel int")
    got = {r["id"]: r["ndcg"] for r in evaluation.ndcg_at(rel, 2).collect()}
    assert math.isclose(got["q"], (1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["z"] == 0
    res = spark.createDataFrame([("q", 1, "alpha"), ("q", 2, "Beta  gamma")], "id string, rank int, text string")
    gold = spark.createDataFrame([("q", ["ALPHA", "beta gamma"], "all"), ("n", ["x"], "any")], "id string, expected array<string>, match string")
    assert {r["id"]: (r["recall_at_1"], r["recall_at_2"]) for r in evaluation.recall_at(res, gold, (1, 2)).collect()} == {"q": (0, 1), "n": (0, 0)}
    v = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert evaluation.low_rank_percentile(v.withColumn("k", F.lit("a")), "k", "x", 0.9).first()["value"] == 8.0
    j = spark.createDataFrame([(True, True), (True, False), (False, False), (False, None)], "l boolean, v boolean")
    c = evaluation.confusion(j, "l", "v").first()
    assert (c["tp"], c["fn"], c["tn"], c["fp"], c["unparseable"], c["tpr"]) == (1, 1, 1, 0, 1, 0.5)
    votes = spark.createDataFrame([([True, False, True],), ([True, False],), ([None],), ([],)], "v array<boolean>")
    assert [r[0] for r in votes.select(evaluation.majority(F.col("v"))).collect()] == [True, None, None, None]


def test_catalog(spark):
    s = spark.createDataFrame([("a", "m"), ("a", "m"), ("b", None)], "id string, model_used string")
    m = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None)], "id string, session_id string")
    assert [r["id"] for r in catalog.empty_sessions(s, m).collect()] == ["b"]
    st_ = catalog.stats(s, m).first()
    assert (st_["total_sessions"], st_["total_messages"], st_["most_used_model"]) == (2, 2, "m")
    assert catalog.stats(s.where("false"), m.where("false")).first()["most_used_model"] is None
    turns = spark.createDataFrame([("s", str(i), i) for i in range(7)], "session_id string, id string, instant int")
    assert [(r["id"], r["turn"]) for r in catalog.last_turns(turns, 3).orderBy("turn").collect()] == [("4", 1), ("5", 2), ("6", 3)]
