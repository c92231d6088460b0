"""The whole retrieval of one question or many: first stage, rerank, retry, hop, expansion, packing.

Every step is an operator of its own; this is their order.  Candidates, a few rows a question, are
written once between steps, so that no step runs twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.config import EngineConfig, profile
from heronry.functions.vectors import cosine, is_usable
from heronry.models import Scorer, score_text, scored
from heronry.operators import context, fusion, rerank, search
from heronry.operators.filters import Filter
from heronry.plans.registry import query
from heronry.plans.retrieval import _L2, TERMS, _bm25_sql
from heronry.session import cut_lineage
from heronry.sources.store import one_per_chunk
from heronry.sources.tables import table


@dataclass
class Retrieved:
    """What a pipeline gives: the first stage, the final ranking, the evidence it rests on, and what is read besides.

    ``expanded`` has (chunk_id, document_id, chunk_index, seed_rank) where the profile widens the context, else None;
    ``escalated`` the documents (document_id) to be read in full, where the profile may and the evidence is thin.
    """

    first_stage: DataFrame
    final: DataFrame
    evidence: DataFrame
    expanded: DataFrame | None = None
    escalated: DataFrame | None = None


def first_stage(chunks: DataFrame, questions: DataFrame, config: EngineConfig, wanted: Filter | None = None, late: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) for questions (query_id, text, query): the legs of the mode, each filtered first.

    ``late`` is the table of late-chunk vectors, a third leg where the profile has it.
    """
    rows = wanted.apply(chunks) if wanted else chunks
    legs = {}
    if config.search_type != "vector_only":
        asked_words = questions.select("query_id", search.query_words(F.col("text")).alias("ts"))
        terms = asked_words.select("query_id", F.explode("ts").alias("term"))
        if not asked_words.where(F.size("ts") == 1).isEmpty():  # a question of one word stands for what it is a start or misspelling of
            terms = search.expanded_terms(questions, search.postings(rows, "chunk_id"))
        legs["fts"] = search.ranked(search.bm25_scores(rows, terms, "chunk_id"), "chunk_id", config.retrieval_k)
    if config.search_type != "fts_only":
        asked = questions.select("query_id", "query")
        legs["vec"] = search.nearest(rows, asked, "chunk_id", config.retrieval_k)
        if config.late_chunk and late is not None:
            legs["late"] = search.nearest(wanted.apply(late) if wanted else late, asked, "chunk_id", config.retrieval_k)
    return fusion.fuse(legs, "chunk_id", config.retrieval_k, config.rrf_k, by="query_id").select("query_id", "chunk_id", "rank")


def late_blocks(late: DataFrame, base: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Hits of the late-chunk table with ``merged_text`` and ``core_text``: the texts around them come from the base table."""
    hits = search.nearest(late, questions.select("query_id", "query"), "chunk_id", k)
    best = hits.groupBy("chunk_id").agg(F.min("rank").alias("rank"))
    placed = base.join(F.broadcast(best), "chunk_id").select("chunk_id", "document_id", "chunk_index", "rank")
    return context.merge_siblings(placed, base)


def scoped_search(chunks: DataFrame | None, questions: DataFrame, config: EngineConfig, document_ids: DataFrame, wanted: Filter | None = None) -> DataFrame | None:
    """The first stage over some documents (document_id) only; None where there is no table to search, no rows where nothing matches."""
    if chunks is None:
        return None
    inside = chunks.join(F.broadcast(document_ids.select("document_id").distinct()), "document_id", "left_semi")
    return first_stage(inside, questions, config, wanted)


def evidence(chunks: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, evidence): how far the best cosine of a question's candidates stands out."""
    pairs = candidates.join(chunks.select("chunk_id", "vector"), "chunk_id").join(F.broadcast(questions.select("query_id", "query")), "query_id")
    sims = pairs.groupBy("query_id").agg(F.collect_list(cosine(F.col("vector"), F.col("query"))).alias("sims"))
    return sims.select("query_id", rerank.contrast(F.col("sims")).alias("evidence"))


def best_documents(overviews: DataFrame, question: DataFrame, n: int) -> DataFrame:
    """(document_id, document_rank from 0) of the documents whose overview vectors (document_id, vector) are nearest to the question."""
    near = search.nearest(overviews, question.select("query_id", "query"), "document_id", n, metric="cosine")
    return near.select("document_id", (F.col("rank") - 1).alias("document_rank"))


def _prefiltered(chunks: DataFrame, question: DataFrame, config: EngineConfig, stage: DataFrame, overviews: DataFrame, wanted: Filter | None) -> DataFrame:
    """A first stage in the light of the documents' overviews; a search of the best documents that gives nothing leaves it as it was."""
    documents = cut_lineage(best_documents(overviews, question, config.overview_top_documents))
    if config.overview_prefilter == "restrict":
        scoped = scoped_search(chunks, question, config, documents, wanted)
        scoped = cut_lineage(scoped) if scoped is not None else None
        return stage if scoped is None or scoped.isEmpty() else scoped
    placed = stage.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("query_id", "chunk_id", "document_id", (F.col("rank") - 1).alias("position"))
    return rerank.boosted(placed, documents, "chunk_id").select("query_id", "chunk_id", (F.col("new_position") + 1).alias("rank"))


def answer(
    chunks: DataFrame, question: DataFrame, config: EngineConfig, wanted: Filter | None = None, second: DataFrame | None = None, references: DataFrame | None = None,
    score: Scorer | None = None, late: DataFrame | None = None, overviews: DataFrame | None = None,
) -> Retrieved:
    """The final ranking of one question (query_id, text, query).

    ``second`` is the question put another way: it is tried where the evidence is below the profile's limit and kept
    if its evidence is strictly higher; attempts are not mixed.  ``references`` (chunk_id, position, target_doc) let the
    ranking hop to documents its first candidates refer to.  ``late`` is the late-chunk table, ``overviews`` the overview
    vectors (document_id, vector); a step whose table is missing is left out.  The filter holds for every leg, the hop,
    the search of the best documents and the expansion.  Without rerank, retry and hop the final list is the first stage.
    """
    rows = wanted.apply(chunks) if wanted else chunks

    def attempt(q: DataFrame) -> tuple[DataFrame, DataFrame]:
        stage = cut_lineage(first_stage(chunks, q, config, wanted, late))  # a few rows a question, used by every later step
        if config.overview_prefilter != "off" and overviews is not None:
            stage = cut_lineage(_prefiltered(chunks, q, config, stage, overviews, wanted))
        return stage, cut_lineage(evidence(chunks, q, stage))

    stage, proof = attempt(question)
    if config.retry and second is not None:
        kind = question.schema["query_id"].dataType
        own = question.select(F.col("query_id").alias("q"))
        other, other_proof = attempt(second.select("text", "query").crossJoin(F.broadcast(own)).select(F.col("q").cast(kind).alias("query_id"), "text", "query"))
        attempts = [p.select("query_id", "evidence", F.lit(n).alias("attempt")).join(s, "query_id", "right") for n, (s, p) in enumerate(((stage, proof), (other, other_proof)))]
        first, again = (cut_lineage(x) for x in attempts)
        thin = rerank.needs_retry(F.max("evidence"), config.retry_min_top_score)
        kept = cut_lineage(rerank.better_attempt(first, again)) if first.agg(thin.alias("t")).first()["t"] else first
        stage, proof = kept.select("query_id", "chunk_id", "rank"), kept.select("query_id", "evidence").distinct()
    final = stage.select("chunk_id", "rank")
    if config.rerank:
        bodies = score_text(chunks).select("chunk_id", F.col("score_text").alias("body"))
        pairs = stage.join(bodies, "chunk_id").join(F.broadcast(question.select("query_id", "text")), "query_id")
        scores = scored(pairs.select("chunk_id", F.col("query_id").alias("sub_query"), "text", "body"), "text", "body", score).select("chunk_id", "sub_query", "score")
        final = rerank.select_by_threshold(cut_lineage(scores), "chunk_id", config.rerank_min_score, config.rerank_min_keep, config.rerank_top_k, rescue=config.pooled_first_stage).select("chunk_id", "rank")
    final = cut_lineage(final.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("chunk_id", "document_id", "rank"))
    if config.crossref_hop and references is not None:
        near = search.knn_scores(rows.select("chunk_id", "vector"), question.select("query_id", "query"), "chunk_id").groupBy("chunk_id").agg(F.min("score").alias("score"))
        near = near.join(rows.select("chunk_id", "document_id"), "chunk_id")
        final = cut_lineage(context.hop(final, references, near, max_hops=config.crossref_max_hops, per_hop=config.crossref_chunks_per_hop))
    else:
        final = final.withColumn("via_crossref", F.lit(False))
    seeds = rows.join(F.broadcast(final.select("chunk_id", "rank")), "chunk_id").select("chunk_id", "document_id", "chunk_index", "rank")
    expanded = context.expand_neighbours(seeds, rows.select("chunk_id", "document_id", "chunk_index"), config.context_window) if config.context_window else None
    escalated = context.escalation(proof, final, config.retry_min_top_score, config.escalation_max_documents) if config.escalation else None
    return Retrieved(stage, final, proof, expanded, escalated)


def full_context(chunks: DataFrame, found: Retrieved, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(blocks, context): what is read of a pipeline's result, packed, labelled, and with documents read in full behind it."""
    if found.expanded is not None:
        wide = found.expanded.join(chunks.select("chunk_id", "text"), "chunk_id")
        blocks = wide.withColumn("rank", F.struct("seed_rank", "chunk_index", "chunk_id"))
    else:
        blocks = chunks.join(F.broadcast(found.final.select("chunk_id", "rank")), "chunk_id").select("chunk_id", "document_id", "chunk_index", "rank", "text")
    packed = context.pack_budget(blocks.withColumn("span", F.array("chunk_index")), config.synthesis_token_budget)
    text = context.labelled(packed)
    if found.escalated is not None:
        whole = chunks.join(F.broadcast(found.escalated), "document_id", "left_semi")
        text = context.with_block(text, context.escalation_block(context.document_texts(whole, config.escalation_token_budget)))
    return packed, text


def packed_context(chunks: DataFrame, ranking: DataFrame, config: EngineConfig) -> DataFrame:
    """One row (context) of a final ranking (chunk_id, document_id, rank)."""
    blocks = chunks.join(F.broadcast(ranking.select("chunk_id", "rank")), "chunk_id").select("chunk_id", "document_id", "chunk_index", "rank", "text")
    return context.labelled(context.pack_budget(blocks.withColumn("span", F.array("chunk_index")), config.synthesis_token_budget))


def composed(parts: DataFrame, most: int = 5) -> DataFrame:
    """Citations of several sub-answers (sub_answer, chunk_id, rank): at most ``most`` each, every chunk once, in order."""
    few = parts.withColumn("n", F.row_number().over(Window.partitionBy("sub_answer").orderBy("rank", "chunk_id"))).where(F.col("n") <= most)
    return fusion.first_wins(few, ["chunk_id"], ["sub_answer", "n"]).drop("n")


QUESTION = " ".join(TERMS)


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with usable vectors, each once; one question with the vector of the first chunk)."""
    known = table(spark, d, "text_pages").where(F.col("chunk_id").isNotNull() & is_usable(F.col("vector"), 64) & (F.col("chunk_index") >= 0) & F.col("document_id").isNotNull())
    least = known.agg(F.min("chunk_id").alias("chunk_id"))
    first = one_per_chunk(known.join(F.broadcast(least), "chunk_id", "left_semi")).agg(F.min_by("vector", "chunk_id").alias("query"))
    # one row, read by many steps: without the cut each of them goes through the whole table for it
    return one_per_chunk(known), cut_lineage(first.select(F.lit("q").alias("query_id"), F.lit(QUESTION).alias("text"), "query"))


_INPUTS_SQL = f"""known as (select * from text_pages where chunk_id is not null and document_id is not null and chunk_index >= 0 and vector is not null and len(vector) = 64
  and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
v as (select *, row_number() over (partition by chunk_id order by try_cast(metadata as json)->'metadata'->>'indexed_at' desc nulls last, metadata desc nulls last) as n from known),
p as (select chunk_id, document_id, chunk_index, text, vector from v where n = 1),
q as (select vector as query from p order by chunk_id limit 1),
kn as (select chunk_id, {_L2.format(a="vector", b="query")} as score from p, q)"""


@query(f"with {_INPUTS_SQL} select chunk_id, row_number() over (order by score, chunk_id)::int as rank from kn order by kn.score, chunk_id limit 10")
def pipeline_fast(spark: SparkSession, d: str) -> DataFrame:
    chunks, question = _inputs(spark, d)
    return answer(chunks, question, profile("fast")).final.select("chunk_id", F.col("rank").cast("int").alias("rank"))


_WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(
    f"""with {_INPUTS_SQL}, {_bm25_sql("p", "chunk_id", p="b_")},
f20 as (select chunk_id, row_number() over (order by score desc, chunk_id) as rank from fts order by score desc, chunk_id limit 20),
v20 as (select chunk_id, row_number() over (order by score, chunk_id) as rank from kn order by score, chunk_id limit 20),
u as (select chunk_id, rank, 1 as leg from f20 union all select chunk_id, rank, 2 from v20),
r as (select chunk_id, sum(1.0 / (60 + rank)) as rrf, min(case when leg = 1 then rank end) as f, min(case when leg = 2 then rank end) as w from u group by chunk_id),
stage as (select chunk_id from r order by r.rrf desc, f nulls last, w nulls last, chunk_id limit 20),
sc as (select chunk_id, len(list_intersect({_WORDS_OF.format("text")}, {_WORDS_OF.format("'" + QUESTION + "'")})) / {len(set(TERMS))}.0 as score from p where chunk_id in (select chunk_id from stage)),
rk as (select *, row_number() over (order by score desc, chunk_id) as rank, score >= 0.5 as good from sc),
st as (select *, good or (not exists (select 1 from rk where good) and rank = 1) as stays from rk),
fin as (select * from st where stays or ((select count(*) from st where stays) < 3 and rank <= 3))
select chunk_id, row_number() over (order by rank)::int as rank from fin order by fin.rank limit 10"""
)
def pipeline_default(spark: SparkSession, d: str) -> DataFrame:
    """Both legs, fusion, rerank by shared words, floor and rescue; there is no second wording, so nothing is tried again."""
    chunks, question = _inputs(spark, d)
    return answer(chunks, question, profile("default")).final.select("chunk_id", F.col("rank").cast("int").alias("rank"))


@query(
    f"""with {_INPUTS_SQL}, t10 as (select chunk_id, row_number() over (order by score, chunk_id) as rank from kn order by score, chunk_id limit 10),
sd as (select p.document_id, p.chunk_index, t10.rank from p join t10 using (chunk_id)),
ex as (select p.chunk_id, p.document_id, p.chunk_index, min(sd.rank) as seed_rank from p join sd on p.document_id = sd.document_id and p.chunk_index between sd.chunk_index - 1 and sd.chunk_index + 1 group by all)
select chunk_id, document_id, chunk_index, seed_rank::int as seed_rank from ex"""
)
def pipeline_expanded(spark: SparkSession, d: str) -> DataFrame:
    chunks, question = _inputs(spark, d)
    found = answer(chunks, question, profile("fast", {"context_window": 1}))
    return found.expanded.select("chunk_id", "document_id", "chunk_index", F.col("seed_rank").cast("int").alias("seed_rank"))
