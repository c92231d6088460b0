"""Evaluation queries: gold items against documents, panels as judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import evaluation as E
from heronry.operators import search
from heronry.plans.registry import query
from heronry.plans.texts import _SPACES
from heronry.session import small
from heronry.sources.tables import table


def _norm(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '{_SPACES}', ' ', 'g'), '^ | $', '', 'g'))"


def _results(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """(id, rank, doc_id, text, rel): documents ranked by the number of the item's fact strings they have as words, ties by id."""
    gold = table(spark, d, "gold_items").select("id", "corpus", "expected", "match", "dimensions", "fact_ids")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "n_chars")
    wanted = small(gold.select("id", F.explode("expected").alias("term")).select("id", F.lower("term").alias("term")).distinct())
    words = docs.select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    hits = words.join(wanted, "term").groupBy("id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = search.ranked(hits.withColumnRenamed("id", "query_id"), "doc_id", k)
    joined = best.select(F.col("query_id").alias("id"), "doc_id", F.col("rank").cast("long").alias("rank")).join(docs.select("doc_id", "text"), "doc_id").join(small(gold), "id")
    return joined.withColumn("rel", E.relevance(F.col("text"), F.col("expected")))


_RESULTS = rf"""with g as (select * from gold_items),
w as (select distinct id, lower(unnest(expected)) as term from g),
t as (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term from documents where text is not null),
h as (select id, doc_id, count(*) as score from t join w using (term) group by id, doc_id),
r as (select *, row_number() over (partition by id order by score desc, doc_id) as rank from h),
res as (select r.id, r.doc_id, r.rank, d.text, g.expected, g.match, g.dimensions, (len(list_filter(g.expected, lambda e: contains({_norm("d.text")}, {_norm("e")}))) > 0)::int as rel from r join documents d using (doc_id) join g on g.id = r.id where rank <= 20)"""


@query(f"{_RESULTS} select id, doc_id, rank, rel from res")
def gold_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("id", "doc_id", "rank", "rel")


def _recall_sql(k: int) -> str:
    joined = _norm(f"coalesce(string_agg(case when rank <= {k} then text end, ' || ' order by rank), '')")
    return f"(select id, {joined} as t{k} from res group by id)"


@query(
    f"""{_RESULTS}, a as {_recall_sql(5)}, m as {_recall_sql(10)}, b as {_recall_sql(20)},
n as (select g.id, g.match, list_transform(g.expected, lambda e: {_norm("e")}) as es, coalesce(t5, '') as t5, coalesce(t10, '') as t10, coalesce(t20, '') as t20 from g left join a using (id) left join m using (id) left join b using (id))
select id, case when match = 'all' then len(list_filter(es, lambda e: not contains(t10, e))) = 0 else len(list_filter(es, lambda e: contains(t10, e))) > 0 end::int as recall_at_10,
  case when match = 'all' then len(list_filter(es, lambda e: not contains(t5, e))) = 0 else len(list_filter(es, lambda e: contains(t5, e))) > 0 end::int as recall_at_5,
  case when match = 'all' then len(list_filter(es, lambda e: not contains(t20, e))) = 0 else len(list_filter(es, lambda e: contains(t20, e))) > 0 end::int as recall_at_20 from n"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_at(_results(spark, d).select("id", "rank", "text"), table(spark, d, "gold_items"), (5, 10, 20))


_NDCG = f"""{_RESULTS}, s as (select id, sum(case when rank <= 10 then rel / log2(rank + 1) end) as dcg, least(sum(rel), 10)::int as n from res group by id),
nd as (select id, case when n > 0 then dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) else 0 end as ndcg from s)"""


@query(f"{_NDCG} select id, round(ndcg, 6) as ndcg from nd")
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg_at(_results(spark, d).select("id", "rank", "rel")).select("id", F.round("ndcg", 6).alias("ndcg"))


@query(
    f"""{_NDCG}, m as (select nd.ndcg, g.dimensions.topic as topic, g.dimensions.question_type as question_type, g.dimensions.difficulty as difficulty from nd join g using (id)),
u as (select 'topic' as dimension, topic as value, ndcg from m union all select 'question_type', question_type, ndcg from m union all select 'difficulty', difficulty, ndcg from m)
select dimension, value, count(*) as queries, round(avg(ndcg), 6) as ndcg from u group by dimension, value"""
)
def metrics_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    scores = E.ndcg_at(_results(spark, d).select("id", "rank", "rel"))
    dims = table(spark, d, "gold_items").select("id", "dimensions.topic", "dimensions.question_type", "dimensions.difficulty")
    return E.by_dimension(scores.join(small(dims), "id"), ["topic", "question_type", "difficulty"], ["ndcg"]).select("dimension", "value", "queries", F.round("ndcg", 6).alias("ndcg"))


@query(f"{_NDCG} select count(*) as queries, round(avg(ndcg), 6) as ndcg from nd")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(E.ndcg_at(_results(spark, d).select("id", "rank", "rel")), ["ndcg"]).select("queries", F.round("ndcg", 6).alias("ndcg"))


@query(f"{_RESULTS} select id, min(case when rel = 1 then rank end) as first_rank from res group by id")
def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return E.first_relevant(_results(spark, d))


@query("select event_type, round(list_sort(list(value) filter (value is not null))[floor(0.9 * (count(value) - 1))::int + 1], 6) as p90 from events group by event_type")
def p90_latency(spark: SparkSession, d: str) -> DataFrame:
    return E.low_rank_percentile(table(spark, d, "events"), "event_type", "value", 0.9).select("event_type", F.round("value", 6).alias("p90"))


@query(
    f"""with w as (select distinct id, unnest(expected) as expected_string from gold_items), f as (select distinct {_norm("expected_string")} as form from w),
t as (select {_norm("coalesce(text, '')")} as t from documents), s as (select form from f where exists (select 1 from t where contains(t.t, form)))
select id, expected_string from w where {_norm("expected_string")} not in (select form from s)"""
)
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.uncovered(table(spark, d, "gold_items"), table(spark, d, "documents"))


@query(
    """with p as (select 'i:' || id as id, votes from panel_arm_i union select 'g2:' || id, votes from panel_arm_g2),
c as (select id, len(list_filter(votes, lambda v: v)) as y, len(list_filter(votes, lambda v: not v)) as n from p)
select id, case when y > n then true when y < n then false end as majority from c"""
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    arms = [table(spark, d, f"panel_arm_{a}").select(F.concat(F.lit(f"{a}:"), "id").alias("id"), "votes") for a in ("i", "g2")]
    return arms[0].unionByName(arms[1]).distinct().select("id", E.majority(F.col("votes")).alias("majority"))


@query(
    """with p as (select distinct id, majority_pass, votes from panel_arm_i),
c as (select majority_pass as v, case when len(list_filter(votes, lambda x: x)) > len(list_filter(votes, lambda x: not x)) then true when len(list_filter(votes, lambda x: x)) < len(list_filter(votes, lambda x: not x)) then false end as l from p),
s as (select count(*) filter (l and v) as tp, count(*) filter (l and not v) as fn, count(*) filter (not l and not v) as tn, count(*) filter (not l and v) as fp, count(*) filter (l is not null and v is null) as unparseable from c where l is not null)
select *, round(tp / (tp + fn), 6) as tpr, round(tn / (tn + fp), 6) as tnr, round((tp + tn) / (tp + fn + tn + fp), 6) as agreement from s"""
)
def judge_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panel_arm_i").select("id", "majority_pass", "votes").distinct().withColumn("label", E.majority(F.col("votes")))
    out = E.confusion(rows, "label", "majority_pass")
    return out.select("tp", "fn", "tn", "fp", "unparseable", *[F.round(c, 6).alias(c) for c in ("tpr", "tnr", "agreement")])


@query("select event_type, round_even(min(abs(sin(value))) * 100, 0)::int as confidence from events group by event_type")
def verifier_weakest_link(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "events").select("event_type", F.abs(F.sin("value")).alias("score"))
    return E.weakest_link(scores, "event_type")


@query(
    """select id, sha256('{' || concat_ws(',', case when stored_path is not null then '"p0":' || to_json(stored_path)::varchar end, case when index_id is not null then '"p1":' || to_json(index_id)::varchar end, '"p2":"chunker-1"') || '}') as fingerprint
from index_documents"""
)
def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_documents").select("id", E.fingerprint(F.col("stored_path"), F.col("index_id"), F.lit("chunker-1")).alias("fingerprint"))


@query("select to_json({'expected': expected, 'id': id, 'match': match, 'query': query})::varchar as line from gold_items order by line")
def canonical_dump(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_lines(table(spark, d, "gold_items").select("id", "query", "expected", "match"))


@query("select distinct f.fact_id, f.id from (select id, expected, coalesce(lower(answer), '') as a, unnest(fact_ids) as fact_id from gold_items) f where exists (select 1 from (select unnest(f.expected) as e) x where not contains(f.a, lower(e)))")
def gold_fact_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Facts of items whose answer lacks one of the expected strings."""
    g = table(spark, d, "gold_items").select("expected", F.lower(F.coalesce("answer", F.lit(""))).alias("a"), F.explode("fact_ids").alias("fact_id"), "id")
    return g.where(F.exists("expected", lambda e: ~F.col("a").contains(F.lower(e)))).select("fact_id", "id").distinct()


@query(
    f"""with g as (select distinct id, passage, expected, fact_ids from gold_items), w as (select id, unnest(expected) as e from g),
m as (select w.id, w.e, bool_or(g.id = w.id) as here, count(*) filter (g.id <> w.id) as elsewhere from w join g on contains({_norm("coalesce(g.passage, '')")}, {_norm("w.e")}) group by w.id, w.e),
s as (select w.id, bool_and(coalesce(here, false)) as in_source, bool_and(coalesce(here, false)) and sum(coalesce(elsewhere, 0)) = 0 as "unique" from (select distinct id, e from w) w left join m using (id, e) group by w.id)
select g.id, coalesce(in_source, true) as in_source, coalesce("unique", true) as "unique", true as resolves from (select distinct id from g) g left join s using (id)"""
)
def gold_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Passages stand for the sources; the facts known are those of the table."""
    g = table(spark, d, "gold_items").withColumn("source", F.col("id"))
    return E.integrity(g, g.select("source", F.col("passage").alias("text")), g.select(F.explode("fact_ids").alias("fact_id")))


@query(
    """with a as (select distinct to_json({'id': id, 'majority_pass': majority_pass})::varchar as line from panel_arm_i), b as (select distinct to_json({'id': id, 'majority_pass': majority_pass})::varchar as line from panel_arm_g2)
select line, 'first' as side from a where line not in (select line from b) union all select line, 'second' from b where line not in (select line from a)"""
)
def dump_difference(spark: SparkSession, d: str) -> DataFrame:
    arm = lambda x: table(spark, d, f"panel_arm_{x}").select("id", "majority_pass")
    return E.dump_difference(arm("i"), arm("g2"))


@query(
    """with p as (select distinct i.id, i.requires_crossref, len(list_filter(g.votes, lambda v: v)) as hop_chunks, coalesce(i.majority_pass, false) as hit from panel_arm_i i join panel_arm_g2 g using (id))
select count(*) as queries, count(*) filter (hop_chunks > 0) as fired, round(avg((hop_chunks > 0)::int), 6) as fire_rate, round(avg(case when hop_chunks > 0 then hit::int end), 6) as precision from p"""
)
def hop_summary(spark: SparkSession, d: str) -> DataFrame:
    """The panels stand for two runs: positive votes of the one for chunks a hop added, the verdict of the other for its hit."""
    i, g = table(spark, d, "panel_arm_i"), table(spark, d, "panel_arm_g2").select("id", F.size(F.filter("votes", lambda v: v)).alias("hop_chunks"))
    rows = i.join(g, "id").select("id", "requires_crossref", "hop_chunks", F.coalesce("majority_pass", F.lit(False)).alias("hit_expected_source")).distinct()
    return E.hop_summary(rows).select("queries", "fired", F.round("fire_rate", 6).alias("fire_rate"), F.round("precision", 6).alias("precision"))
