"""Queries over documents and embeddings: search, fusion, rerank, prefilters.

There is no declared key between the two tables; the hybrid queries take ``vec_id`` as
``doc_id``.  Scores are rounded where they leave a query, never before they are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import vectors as V
from heronry.operators import filters, fusion, rerank, search
from heronry.plans.registry import query
from heronry.session import scratch_path
from heronry.sources.store import one_per_chunk
from heronry.sources.tables import table

TERMS = ["pressure", "valve", "maintenance", "schedule"]
QUERY_VECTOR = 7


def _terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")


def _target(spark: SparkSession, d: str, vec_id: int = QUERY_VECTOR) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.lit("q").alias("query_id"), F.col("embedding").alias("query"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    """One query a label: the mean vector of its members."""
    each = table(spark, d, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("query"))


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(source: str, key: str, text: str = "text", terms: list[str] = TERMS, p: str = "") -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""
{p}w as (select {key}, {_TOKENS.format(f"coalesce({text}, '')")} as ts from {source}),
{p}s as (select count(*) as n, avg(len(ts)) as avgdl from {p}w where len(ts) > 0),
{p}h as (select {key}, len(ts) as dl, unnest(ts) as term from {p}w),
{p}tf as (select {key}, dl, term, count(*) as tf from {p}h where term in ({words}) group by all),
{p}df as (select term, count(*) as df from {p}tf group by term),
fts as (select {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
        from {p}tf join {p}df using (term), {p}s group by {key})"""


_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_CENTROIDS = """
x as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
m as (select label, i, avg(x) as m from x group by label, i),
cent as (select label, list(m order by i) as query from m group by label)"""


@query(
    f"""with {_bm25_sql("documents", "doc_id")}
select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from fts order by score desc, doc_id limit 20"""
)
def fts_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search.bm25_scores(table(spark, d, "documents"), _terms(spark, TERMS), "doc_id")
    best = search.ranked(search.top(hits, "doc_id", 20), "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with q as (select embedding as query from embeddings where vec_id = {QUERY_VECTOR}),
k as (select vec_id, {_L2.format(a="embedding", b="query")} as score from embeddings, q)
select vec_id, round(score, 6) as distance, round(1 / (1 + score), 6) as score, row_number() over (order by score, vec_id) as rank from k order by k.score, vec_id limit 20"""
)
def vector_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    best = search.nearest(table(spark, d, "embeddings"), _target(spark, d), "vec_id", 20, "embedding")
    return best.select("vec_id", F.round("score", 6).alias("distance"), F.round(search.closeness(F.col("score")), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with q as (select embedding as query from embeddings where vec_id = {QUERY_VECTOR})
select vec_id, round({_DOT.format(a="embedding", b="query")} / sqrt({_DOT.format(a="embedding", b="embedding")} * {_DOT.format(a="query", b="query")}), 6) as cosine from embeddings, q"""
)
def vector_cosine_score(spark: SparkSession, d: str) -> DataFrame:
    hits = search.knn_scores(table(spark, d, "embeddings"), _target(spark, d), "vec_id", "embedding", metric="cosine")
    return hits.select("vec_id", F.round("score", 6).alias("cosine"))


@query(
    f"""with {_CENTROIDS},
k as (select cent.label as query_label, vec_id, {_L2.format(a="embedding", b="query")} as score from embeddings, cent),
r as (select *, row_number() over (partition by query_label order by score, vec_id) as rank from k)
select query_label, vec_id, round(score, 6) as distance, rank from r where rank <= 10"""
)
def knn_batch_per_query(spark: SparkSession, d: str) -> DataFrame:
    queries = _centroids(spark, d).select(F.col("label").alias("query_id"), "query")
    best = search.nearest(table(spark, d, "embeddings"), queries, "vec_id", 10, "embedding")
    return best.select(F.col("query_id").alias("query_label"), "vec_id", F.round("score", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _legs(spark: SparkSession, d: str, lang: str | None = "en", k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The two legs, each filtered before it is ranked."""
    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    if lang:
        docs = docs.where(F.col("lang") == lang)
        vecs = vecs.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    fts = search.ranked(search.top(search.bm25_scores(docs, _terms(spark, TERMS), "doc_id"), "doc_id", k), "doc_id")
    vec = search.top(search.knn_scores(vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), _target(spark, d), "doc_id"), "doc_id", k, descending=False)
    return fts, search.ranked(vec, "doc_id", descending=False)


_LEGS_SQL = f"""with d as (select * from documents where lang = 'en'), {_bm25_sql("d", "doc_id")},
f20 as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from fts order by score desc, doc_id limit 20),
q as (select embedding as query from embeddings where vec_id = {QUERY_VECTOR}),
kn as (select vec_id as doc_id, {_L2.format(a="embedding", b="query")} as score from embeddings, q where vec_id in (select doc_id from d)),
v20 as (select doc_id, score, row_number() over (order by score, doc_id) as rank from kn order by score, doc_id limit 20),
u as (select doc_id, rank, 'fts' as leg from f20 union all select doc_id, rank, 'vec' from v20),
r as (select doc_id, sum(1.0 / (60 + rank)) as rrf, min(case when leg = 'fts' then rank end) as fts_rank, min(case when leg = 'vec' then rank end) as vec_rank from u group by doc_id)"""


@query(f"{_LEGS_SQL} select doc_id, round(rrf, 8) as rrf, fts_rank, vec_rank from r order by r.rrf desc, fts_rank nulls last, vec_rank nulls last, doc_id limit 10")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    fts, vec = _legs(spark, d)
    out = fusion.fuse({"fts": fts, "vec": vec}, "doc_id", 10)
    return out.select("doc_id", F.round("rrf", 8).alias("rrf"), F.col("fts_rank").cast("long").alias("fts_rank"), F.col("vec_rank").cast("long").alias("vec_rank"))


@query(f"{_LEGS_SQL} select doc_id, round(rrf, 8) as rrf from r")
def rrf_union_no_cut(spark: SparkSession, d: str) -> DataFrame:
    fts, vec = _legs(spark, d)
    return fusion.fuse({"fts": fts, "vec": vec}, "doc_id").select("doc_id", F.round("rrf", 8).alias("rrf"))


@query(
    f"""{_LEGS_SQL},
n20 as (select doc_id, row_number() over (order by n_chars desc nulls last, doc_id) as rank from d order by n_chars desc nulls last, doc_id limit 20),
u3 as (select * from u union all select doc_id, rank, 'len' from n20),
r3 as (select doc_id, sum(1.0 / (60 + rank)) as rrf, min(case when leg = 'fts' then rank end) as f, min(case when leg = 'vec' then rank end) as v, min(case when leg = 'len' then rank end) as l from u3 group by doc_id)
select doc_id, round(rrf, 8) as rrf from r3 order by r3.rrf desc, f nulls last, v nulls last, l nulls last, doc_id limit 15"""
)
def rrf_three_legs(spark: SparkSession, d: str) -> DataFrame:
    fts, vec = _legs(spark, d)
    longest = table(spark, d, "documents").where("lang = 'en'").select(F.lit("q").alias("query_id"), "doc_id", F.coalesce(F.col("n_chars"), F.lit(-1).cast("long")).alias("score"))
    leg = search.ranked(search.top(longest, "doc_id", 20), "doc_id")
    return fusion.fuse({"fts": fts, "vec": vec, "len": leg}, "doc_id", 15).select("doc_id", F.round("rrf", 8).alias("rrf"))


@query(
    f"""{_LEGS_SQL}, o as (select doc_id, leg, rank, row_number() over (partition by doc_id order by leg, rank) as n from u)
select doc_id, leg, rank from o where n = 1"""
)
def cross_leg_dedupe(spark: SparkSession, d: str) -> DataFrame:
    fts, vec = _legs(spark, d)
    both = fts.select("doc_id", F.lit("fts").alias("leg"), F.col("rank").cast("long").alias("rank")).unionByName(vec.select("doc_id", F.lit("vec").alias("leg"), F.col("rank").cast("long").alias("rank")))
    return fusion.first_wins(both, ["doc_id"], ["leg", "rank"])


@query(
    f"""with {_CENTROIDS},
k as (select cent.label as sq, vec_id, {_L2.format(a="embedding", b="query")} as score from embeddings, cent),
r as (select *, row_number() over (partition by sq order by score, vec_id) as rank from k),
t as (select * from r where rank <= 20),
p as (select vec_id, min(rank * 1000 + sq) as first, list_sort(list(distinct sq)) as sub_queries from t group by vec_id)
select vec_id, row_number() over (order by first, vec_id)::int as position, sub_queries from p"""
)
def pool_round_robin(spark: SparkSession, d: str) -> DataFrame:
    queries = _centroids(spark, d).select(F.col("label").alias("query_id"), "query")
    best = search.nearest(table(spark, d, "embeddings"), queries, "vec_id", 20, "embedding")
    return fusion.round_robin(best.select("vec_id", "rank", F.col("query_id").alias("sub_query")), "vec_id")


def _candidates(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    """(vec_id, sub_query, score): the vectors nearest to the query vector, scored by cosine against every label mean."""
    near = search.top(search.knn_scores(table(spark, d, "embeddings"), _target(spark, d), "vec_id", "embedding"), "vec_id", k, descending=False).select("vec_id")
    few = table(spark, d, "embeddings").join(F.broadcast(near), "vec_id", "left_semi")
    queries = _centroids(spark, d).select(F.col("label").alias("query_id"), "query")
    return search.knn_scores(few, queries, "vec_id", "embedding", metric="cosine").select("vec_id", F.col("query_id").alias("sub_query"), "score")


_CANDIDATES_SQL = f"""with {_CENTROIDS},
q as (select embedding as query from embeddings where vec_id = {QUERY_VECTOR}),
near as (select vec_id, embedding from (select vec_id, embedding, {_L2.format(a="embedding", b="query")} as s from embeddings, q) order by s, vec_id limit 30),
c as (select vec_id, cent.label as sub_query, {_DOT.format(a="embedding", b="query")} / sqrt({_DOT.format(a="embedding", b="embedding")} * {_DOT.format(a="query", b="query")}) as score from near, cent),
a as (select vec_id, avg(score) as mean, max(score) as best from c group by vec_id)"""


@query(f"{_CANDIDATES_SQL} select vec_id, round(mean, 6) as score from a")
def rerank_agg_mean(spark: SparkSession, d: str) -> DataFrame:
    return rerank.aggregated(_candidates(spark, d), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"{_CANDIDATES_SQL} select vec_id, round(best, 6) as score from a")
def rerank_agg_max(spark: SparkSession, d: str) -> DataFrame:
    return rerank.aggregated(_candidates(spark, d), "vec_id", "max").select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""{_CANDIDATES_SQL}, r as (select *, row_number() over (order by mean desc, vec_id) as rank from a),
k as (select *, best >= 0.75 as stays, sum((best >= 0.75)::int) over () as n from r),
f as (select * from k where stays or (n < 3 and rank <= 3))
select vec_id, round(mean, 6) as score, row_number() over (order by rank)::int as rank from f order by f.rank limit 10"""
)
def rerank_threshold_min_keep(spark: SparkSession, d: str) -> DataFrame:
    out = rerank.select_by_threshold(_candidates(spark, d), "vec_id", 0.75, min_keep=3, top_k=10)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{_CANDIDATES_SQL}, r as (select *, row_number() over (order by mean desc, vec_id) as rank from a),
saved as (select vec_id from c where sub_query = (select min(sub_query) from c) and not exists (select 1 from a where best >= 0.75) order by c.score desc, vec_id limit 1),
k as (select *, best >= 0.75 or vec_id in (select vec_id from saved) as stays from r),
f as (select * from k where stays or ((select count(*) from k where stays) < 3 and rank <= 3))
select vec_id, round(mean, 6) as score, row_number() over (order by rank)::int as rank from f order by f.rank limit 10"""
)
def rerank_pooled_rescue(spark: SparkSession, d: str) -> DataFrame:
    out = rerank.select_by_threshold(_candidates(spark, d), "vec_id", 0.75, min_keep=3, top_k=10, rescue=True)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{_CANDIDATES_SQL}, r as (select *, row_number() over (order by mean desc, vec_id) as rank from a)
select vec_id, round(mean, 6) as score, rank from r where rank <= greatest(1, floor((select count(*) from a) * 0.25))"""
)
def rerank_top_percent(spark: SparkSession, d: str) -> DataFrame:
    ranking = search.ranked(rerank.aggregated(_candidates(spark, d), "vec_id").withColumn("query_id", F.lit("q")), "vec_id")
    return rerank.keep_share(ranking, 0.25, "vec_id").select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_EVIDENCE_SQL = f"""with {_CENTROIDS},
k as (select cent.label as query_label, vec_id, 1 - {_L2.format(a="embedding", b="query")} / 2 as sim, {_L2.format(a="embedding", b="query")} as dist from embeddings, cent),
t as (select *, row_number() over (partition by query_label order by dist, vec_id) as n from k),
s as (select query_label, max(case when n = 1 then sim end) as top, avg(case when n > 5 then sim end) as bg from t where n <= 20 group by query_label),
e as (select query_label, greatest(0.0, least(1.0, (top - bg) / (1 - bg))) as evidence from s)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    queries = _centroids(spark, d).select(F.col("label").alias("query_id"), "query")
    best = search.nearest(table(spark, d, "embeddings"), queries, "vec_id", 20, "embedding")
    sims = best.groupBy("query_id").agg(F.collect_list(1 - F.col("score") / 2).alias("sims"))
    return sims.select(F.col("query_id").alias("query_label"), rerank.contrast(F.col("sims")).alias("evidence"))


@query(f"{_EVIDENCE_SQL} select query_label, round(evidence, 6) as evidence from e")
def evidence_contrast(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("query_label", F.round("evidence", 6).alias("evidence"))


@query(f"{_EVIDENCE_SQL} select query_label, coalesce(evidence < 0.12, false) as retry from e")
def retry_decision(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("query_label", rerank.needs_retry(F.col("evidence"), 0.12).alias("retry"))


_OVERVIEW_SQL = f"""with {_CENTROIDS},
q as (select embedding as query from embeddings where vec_id = {QUERY_VECTOR}),
dr as (select 'doc_' || cent.label as document_id, row_number() over (order by {_DOT.format(a="cent.query", b="q.query")} desc, cent.label) - 1 as document_rank from cent, q),
d5 as (select * from dr where document_rank < 5),
near as (select vec_id, 'doc_' || label as document_id, row_number() over (order by s, vec_id) - 1 as position from (select vec_id, label, {_L2.format(a="embedding", b="query")} as s from embeddings, q) order by s, vec_id limit 20)"""


def _overview(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    emb = table(spark, d, "embeddings")
    hits = search.top(search.knn_scores(emb, _target(spark, d), "vec_id", "embedding"), "vec_id", 20, descending=False)
    ranking = search.ranked(hits, "vec_id", descending=False).join(emb.select("vec_id", "label"), "vec_id")
    candidates = ranking.select("vec_id", F.concat(F.lit("doc_"), "label").alias("document_id"), (F.col("rank") - 1).alias("position"))
    scored = _centroids(spark, d).crossJoin(F.broadcast(_target(spark, d).select(F.col("query").alias("q")))).select("label", V.dot(F.col("query"), F.col("q")).alias("score"), F.lit("q").alias("query_id"))
    docs = search.ranked(scored, "label", 5).select(F.concat(F.lit("doc_"), "label").alias("document_id"), (F.col("rank") - 1).alias("document_rank"))
    return candidates, docs


@query(
    f"""{_OVERVIEW_SQL}, b as (select near.*, 1.0 / (61 + position) + coalesce(1.0 / (61 + document_rank), 0) as boost from near left join d5 using (document_id))
select vec_id, document_id, round(boost, 8) as boost, (row_number() over (order by boost desc, position, vec_id) - 1)::int as new_position from b"""
)
def overview_prefilter_boost(spark: SparkSession, d: str) -> DataFrame:
    candidates, docs = _overview(spark, d)
    return rerank.boosted(candidates, docs, "vec_id").select("vec_id", "document_id", F.round("boost", 8).alias("boost"), F.col("new_position").cast("int").alias("new_position"))


@query(f"{_OVERVIEW_SQL} select vec_id, document_id from near where document_id in (select document_id from d5) or not exists (select 1 from near join d5 using (document_id))")
def overview_prefilter_restrict(spark: SparkSession, d: str) -> DataFrame:
    candidates, docs = _overview(spark, d)
    return rerank.restricted(candidates, docs).select("vec_id", "document_id")


_PAGES = "(select distinct chunk_id, document_id, chunk_index, text from text_pages)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_pages").select("chunk_id", "document_id", "chunk_index", "text").distinct()


def _filtered(spark: SparkSession, d: str, spec: dict) -> DataFrame:
    return filters.compile_filter(spec).apply(_pages(spark, d)).select("chunk_id", "document_id", "chunk_index")


@query(f"select chunk_id, document_id, chunk_index from {_PAGES} where document_id = 'plant_master_catalogue.pdf'")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, {"document_id": "plant_master_catalogue.pdf"})


@query(f"select chunk_id, document_id, chunk_index from {_PAGES} where chunk_index in (0, 3, 5)")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, {"chunk_index": {"in": [0, 3, 5]}})


@query(f"select chunk_id, document_id, chunk_index from {_PAGES} where contains(document_id, 'repair_log')")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, {"document_name": {"contains": "repair_log"}})


@query(f"select chunk_id, document_id, chunk_index from {_PAGES} where chunk_index >= 10 and chunk_index < 25")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, {"chunk_index": {"gte": 10, "lt": 25}})


@query(
    f"""with p as (select * from {_PAGES} where contains(document_id, 'manual') and chunk_index <= 40), {_bm25_sql("p", "chunk_id")}
select chunk_id, round(score, 6) as score from fts order by fts.score desc, chunk_id limit 20"""
)
def filter_combined_prefilter_topk(spark: SparkSession, d: str) -> DataFrame:
    wanted = filters.combined(filters.compile_filter({"document_name": {"contains": "manual"}}), filters.compile_filter({"chunk_index": {"lte": 40}}))
    hits = search.bm25_scores(wanted.apply(_pages(spark, d)), _terms(spark, TERMS), "chunk_id")
    return search.top(hits, "chunk_id", 20).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"with w as (select {_TOKENS.format("coalesce(text, '')")} as ts from documents) select count(*) as n, round(avg(len(ts)), 6) as avgdl from w where len(ts) > 0")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.corpus_stats(table(spark, d, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with w as (select doc_id, unnest({_TOKENS.format("coalesce(text, '')")}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from w group by term")
def term_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"with w as (select distinct unnest({_TOKENS.format("coalesce(text, '')")}) as term from documents) select term from w where starts_with(term, 'valv') or levenshtein(term, 'valv') <= 1")
def short_query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return search.expand_short_query(search.postings(table(spark, d, "documents"), "doc_id"), "valv")


@query(
    f"""with qt as (select vec_id as query_token, embedding as query from embeddings where vec_id % 20 = 0),
s as (select label, query_token, max({_DOT.format(a="embedding", b="query")}) as m from embeddings, qt group by label, query_token)
select label, round(sum(m), 6) as score from s group by label"""
)
def max_sim_late_interaction(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    tokens = emb.where("vec_id % 20 = 0").select(F.lit("q").alias("query_id"), F.col("vec_id").alias("query_token"), F.col("embedding").alias("query"))
    return search.max_sim(tokens, emb.select("label", F.col("embedding").alias("vector")), "label").select("label", F.round("score", 6).alias("score"))


@query(f"with {_CENTROIDS} select label, i - 1 as dim, round(m, 6) as mean from m")
def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).select("label", F.posexplode("query").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query(f"select vec_id, round(sqrt({_DOT.format(a="embedding", b="embedding")}), 5) as norm, round(embedding[1]::double / sqrt({_DOT.format(a="embedding", b="embedding")}), 5) as first from embeddings")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return emb.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.round(V.unit(F.col("embedding"))[0], 5).alias("first"))


@query(
    """with u as (select distinct chunk_id,
  case when vector is null then 'null' when len(vector) <> 64 then 'width' when len(list_filter(vector, lambda x: x is null or not isfinite(x))) > 0 then 'not finite'
       when len(list_filter(vector, lambda x: x <> 0)) = 0 then 'zero' else 'usable' end as state from text_pages)
select state, count(*) as chunks from u group by state"""
)
def vector_states(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    state = F.when(v.isNull(), "null").when(F.size(v) != 64, "width").when(~V.is_finite(v), "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    return table(spark, d, "text_pages").select("chunk_id", state.alias("state")).distinct().groupBy("state").agg(F.count(F.lit(1)).alias("chunks"))


@query("select distinct chunk_id from text_pages where vector is not null and len(vector) > 0 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0")
def nan_vector_drop(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_pages").where(V.is_finite(F.col("vector")) & (F.size("vector") > 0)).select("chunk_id").distinct()


@query(
    """with o as (select chunk_id, document_id, chunk_index from (select distinct chunk_id, document_id, chunk_index from text_pages)),
n as (select 'new_' || chunk_id as chunk_id, document_id, chunk_index from o where chunk_index = 0 and contains(document_id, 'parts_list'))
select * from o where document_id not in (select document_id from n where document_id is not null) or document_id is null union all select * from n"""
)
def upsert_by_document(spark: SparkSession, d: str) -> DataFrame:
    from heronry.sources.store import upserted

    old = table(spark, d, "text_pages").select("chunk_id", "document_id", "chunk_index").distinct()
    new = old.where(F.col("document_id").contains("parts_list") & (F.col("chunk_index") == 0)).withColumn("chunk_id", F.concat(F.lit("new_"), "chunk_id"))
    return upserted(old, new)


@query("select chunk_id, count(*) as deliveries from text_pages where chunk_id is not null group by chunk_id")
def chunk_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_pages").where("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("deliveries"))


@query(
    """with s as (select chunk_id, metadata, row_number() over (partition by chunk_id order by try_cast(metadata as json)->'metadata'->>'indexed_at' desc nulls last, metadata desc nulls last) as n from text_pages where chunk_id is not null)
select chunk_id, metadata from s where n = 1"""
)
def newest_chunk_version(spark: SparkSession, d: str) -> DataFrame:
    return one_per_chunk(table(spark, d, "text_pages").where("chunk_id is not null")).select("chunk_id", "metadata")


@query(
    f"""with {_bm25_sql("documents", "doc_id")}
select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from fts order by score desc, doc_id limit 20"""
)
def fts_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same search, through an index that is written to the shared folder and read by the folders of its terms."""
    path = scratch_path(spark, "fts")
    search.write_index(table(spark, d, "documents"), "doc_id", path)
    best = search.ranked(search.top(search.search_index(spark, path, _terms(spark, TERMS), "doc_id"), "doc_id", 20), "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""{_LEGS_SQL}, m as (select doc_id, f20.score as bm25, v20.score as distance, rrf from r left join f20 using (doc_id) left join v20 using (doc_id))
select doc_id, round(coalesce(bm25, 0), 6) as fts_only, round(1 / (1 + distance), 6) as vector_only, round(rrf, 8) as hybrid from m"""
)
def score_by_mode(spark: SparkSession, d: str) -> DataFrame:
    fts, vec = _legs(spark, d)
    fused = fusion.fuse({"fts": fts, "vec": vec}, "doc_id").select("doc_id", "rrf")
    joined = fused.join(fts.select("doc_id", F.col("score").alias("bm25")), "doc_id", "left").join(vec.select("doc_id", F.col("score").alias("distance")), "doc_id", "left")
    score = lambda mode: search.score_by_mode(mode, F.col("bm25"), F.col("distance"), F.col("rrf"))
    return joined.select("doc_id", F.round(score("fts_only"), 6).alias("fts_only"), F.round(score("vector_only"), 6).alias("vector_only"), F.round(score("hybrid"), 8).alias("hybrid"))
