"""Queries from ranked chunks to a context, over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import chunking, context, crossref, search
from heronry.plans.registry import query
from heronry.plans.retrieval import _EVIDENCE_SQL, TERMS, _bm25_sql, _evidence, _terms
from heronry.session import cut_lineage
from heronry.sources.tables import table

_C = "(select distinct chunk_id, document_id, chunk_index, text from text_pages where chunk_id is not null)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_pages").where("chunk_id is not null").select("chunk_id", "document_id", "chunk_index", "text").distinct()


def _seeds(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    chunks = _chunks(spark, d).where("chunk_index >= 0")
    best = search.ranked(search.top(search.bm25_scores(chunks, _terms(spark, TERMS), "chunk_id"), "chunk_id", k), "chunk_id")
    return chunks.join(F.broadcast(best.select("chunk_id", "rank")), "chunk_id")


_SEEDS = f"""with c as {_C}, known as (select * from c where chunk_index >= 0), {_bm25_sql("known", "chunk_id")},
top10 as (select chunk_id, row_number() over (order by score desc, chunk_id) as rank from fts order by score desc, chunk_id limit 10),
seeds as (select known.*, rank from known join top10 using (chunk_id))"""


@query(
    f"""with c as {_C}, k as (select * from c where document_id is not null and chunk_index >= 0),
p as (select a.chunk_id, b.chunk_index as pos, b.chunk_id as other, b.text from c a join k b on a.document_id = b.document_id and b.chunk_index between a.chunk_index - 1 and a.chunk_index + 1 where a.chunk_index >= 0),
w as (select chunk_id, string_agg(text, ' ' order by pos, other) as t from p group by chunk_id)
select c.chunk_id, md5(coalesce(w.t, c.text)) as window_md5 from c left join w using (chunk_id)"""
)
def context_window_text(spark: SparkSession, d: str) -> DataFrame:
    return context.context_window(_chunks(spark, d), 1).select("chunk_id", F.md5("window_text").alias("window_md5"))


@query(
    f"""{_SEEDS}, p as (select s.chunk_id, b.chunk_index as pos, b.chunk_id as other, b.text from seeds s join c b on s.document_id = b.document_id and b.chunk_index between s.chunk_index - 1 and s.chunk_index + 1)
select p.chunk_id, any_value(rank) as rank, string_agg(p.text, ' ' || chr(10) order by pos, other) as merged_text from p join seeds using (chunk_id) group by p.chunk_id"""
)
def sibling_merge(spark: SparkSession, d: str) -> DataFrame:
    out = context.merge_siblings(_seeds(spark, d).drop("text"), _chunks(spark, d))
    return out.select("chunk_id", F.col("rank").cast("long").alias("rank"), "merged_text")


@query(
    f"""{_SEEDS}, p as (select b.chunk_id, b.document_id, b.chunk_index, rank from seeds s join c b on s.document_id = b.document_id and b.chunk_index between greatest(0, s.chunk_index - 2) and s.chunk_index + 2)
select chunk_id, document_id, chunk_index, min(rank) as seed_rank from p group by all"""
)
def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    out = context.expand_neighbours(_seeds(spark, d).drop("text"), _chunks(spark, d), 2)
    return out.select("chunk_id", "document_id", "chunk_index", F.col("seed_rank").cast("long").alias("seed_rank"))


@query(
    f"""{_SEEDS}, b as (select rank, chunk_id, (floor(length(text) / 3.5) + 1)::int as cost from seeds),
l as (select list({{'rank': rank, 'chunk_id': chunk_id, 'cost': cost}} order by rank) as rows from b),
r as (with recursive walk as (
  select 0 as i, 0 as used, []::varchar[] as kept from l
  union all
  select i + 1, case when used + rows[i + 1].cost > 300 and len(kept) > 0 then used else used + rows[i + 1].cost end,
    case when used + rows[i + 1].cost > 300 and len(kept) > 0 then kept else list_append(kept, rows[i + 1].chunk_id) end
  from walk, l where i < len(rows))
  select kept from walk order by i desc limit 1)
select chunk_id, rank from seeds where list_contains((select kept from r), chunk_id)"""
)
def synthesis_budget(spark: SparkSession, d: str) -> DataFrame:
    blocks = _seeds(spark, d).withColumn("span", F.array("chunk_index"))
    return context.pack_budget(blocks, 300).select("chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"""{_SEEDS} select string_agg('[Source document: ' || coalesce(document_id, 'unknown') || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as context from seeds""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return context.labelled(_seeds(spark, d))


_J = "case when json_valid(metadata) then metadata end"


@query(
    f"""with x as (select *, {_J} as j from text_pages where document_id is not null and chunk_index is not null),
o as (select document_id, chunk_index, coalesce(nullif(json_extract_string(arg_min(j, chunk_id), '$.metadata.original_text'), ''), nullif(arg_min(text, chunk_id), ''), '') as text from x group by document_id, chunk_index),
n as (select *, row_number() over (partition by document_id order by chunk_index) as n from o),
b as (select *, coalesce(sum(length(text) + 2) over (partition by document_id order by chunk_index rows between unbounded preceding and 1 preceding), 0) as before from n where n <= 2000),
t as (select *, max((400 - before < length(text))::int) over (partition by document_id) = 1 as truncated from b)
select document_id, chunk_index, substr(text, 1, (400 - before)::int) as piece, truncated from t where before < 400"""
)
def doc_fetch_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.document_texts(table(spark, d, "text_pages").where("document_id is not null and chunk_index is not null"), 100)


@query(
    f"""select distinct document_id, coalesce(nullif(regexp_extract(json_extract_string(j, '$.metadata.source'), '[^/]*$'), ''), regexp_replace(regexp_extract(document_id, '[^/]*$'), '^[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}_', '')) as name
from (select document_id, {_J} as j from text_pages)"""
)
def document_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_pages").select("document_id", context.document_name(F.col("document_id"), F.col("metadata")).alias("name")).distinct()


@query(f"with s as (select chunk_id, document_id, row_number() over (partition by document_id order by chunk_index, chunk_id) - 1 as chunk_index from {_C} where document_id is not null) select * from s")
def chunk_renumbering(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("document_id is not null")
    return chunking.renumbered(rows, ["chunk_index", "chunk_id"]).select("chunk_id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    f"""with c as (select document_id, chunk_index, min(text) as text from {_C} where chunk_index >= 0 and document_id is not null and text is not null group by all),
s as (select document_id, chunk_index, coalesce(sum(length(text) + 1) over (partition by document_id order by chunk_index rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(text) as n from c)
select document_id, chunk_index, start, start + n as "end" from s"""
)
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("chunk_index >= 0 and document_id is not null and text is not null").groupBy("document_id", "chunk_index").agg(F.min("text").alias("text"))
    return chunking.spans(rows).select("document_id", "chunk_index", "start", "end")


@query(
    f"""with c as (select *, row_number() over (partition by document_id order by chunk_index, chunk_id) as n from {_C} where chunk_index >= 0)
select document_id, substr(string_agg(text, chr(10) || chr(10) order by n), 1, 5000) as overview_text from c where n <= 5 group by document_id"""
)
def overview_texts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.overview_texts(_chunks(spark, d))


_LABEL = r"\b(exhibit|appendix|schedule|annex|attachment|addendum)[\s\x{00a0}]+(?:no\.?[\s\x{00a0}]*|#[\s\x{00a0}]*)?"
#: The look-ahead after a single letter is spelt out: the match takes the next character in and it is cut off again.
_FOUND = r"""c as (select distinct chunk_id, document_id, coalesce(text, '') as text from text_pages where chunk_id is not null),
l as (select chunk_id, document_id, 0 as g, regexp_extract_all(text || ' ', '\b(?i:exhibit|appendix|schedule|annex|attachment|addendum)[\s\x{00a0}]+(?i:no\.?[\s\x{00a0}]*|#[\s\x{00a0}]*)?(?:[A-Z](?:[^A-Za-z])|\d+(?:\.\d+)*)') as ms from c),
s as (select chunk_id, document_id, 1 as g, regexp_extract_all(text, '\b(?i:section|clause|article)[\s\x{00a0}]+(\d+(?:\.\d+)*)\b', 1) as ms from c),
h as (select chunk_id, document_id, 2 as g, regexp_extract_all(text, '§[\s\x{00a0}]*(\d+(?:\.\d+)*)', 1) as ms from c),
e as (
  select chunk_id, document_id, g, generate_subscripts(ms, 1) as i, 'exhibit' as kind,
    lower(regexp_extract(unnest(ms), '^[A-Za-z]+')) || ' ' || lower(regexp_extract(unnest(ms), '[\s\x{00a0}#.]([A-Z]|\d+(?:\.\d+)*)[^A-Za-z0-9]?$', 1)) as ref from l
  union all select chunk_id, document_id, g, generate_subscripts(ms, 1), 'section', 'section ' || unnest(ms) from s
  union all select chunk_id, document_id, g, generate_subscripts(ms, 1), 'section', 'section ' || unnest(ms) from h),
u as (select chunk_id, document_id, kind, ref, min(g * 1000000 + i) as o from e group by all),
refs as (select chunk_id, document_id, kind, ref, (row_number() over (partition by chunk_id, document_id order by o) - 1)::int as position from u)"""


@query(f"with {_FOUND} select chunk_id, document_id, kind, ref, position from refs")
def crossref_extract(spark: SparkSession, d: str) -> DataFrame:
    return crossref.labels(_chunks(spark, d)).select("chunk_id", "document_id", "kind", "ref", "position")


_NAMES = r"""ids as (select distinct document_id as target_doc from text_pages where document_id is not null),
nm as (select target_doc, lower(trim(regexp_replace(regexp_replace(regexp_extract(target_doc, '[^/]*$'), '\.[A-Za-z0-9]{1,5}$', ''), '[^0-9A-Za-z]+', ' ', 'g'))) as name from ids),
b as (select target_doc, name, 0 as o from nm where name <> '' union all
  select target_doc, regexp_replace(name, '^\d+\s+', ''), 1 from nm where regexp_matches(name, '^\d+\s+') and (length(regexp_replace(name, '^\d+\s+', '')) >= 6 or len(string_split(regexp_replace(name, '^\d+\s+', ''), ' ')) >= 2)),
known as (select name, min({'o': o, 't': target_doc}).t as target_doc from b group by name)"""


@query(
    f"""with {_FOUND}, {_NAMES},
r as (select distinct ref, trim(regexp_replace(lower(ref), '[^0-9a-z]+', ' ', 'g')) as k from refs),
hit as (select ref, min({{'i': (name <> k)::int, 'n': length(name), 'name': name, 't': known.target_doc}}).t as target_doc from r join known on contains(' ' || name || ' ', ' ' || k || ' ') group by ref)
select chunk_id, document_id, kind, ref, position, case when hit.target_doc is distinct from document_id then hit.target_doc end as target_doc from refs left join hit using (ref)"""
)
def crossref_resolve(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return crossref.resolve(crossref.labels(chunks), crossref.names(chunks)).select("chunk_id", "document_id", "kind", "ref", "position", "target_doc")


_ANNOTATED = rf"""{_FOUND}, {_NAMES},
r as (select distinct ref, trim(regexp_replace(lower(ref), '[^0-9a-z]+', ' ', 'g')) as k from refs),
hit as (select ref, min({{'i': (name <> k)::int, 'n': length(name), 'name': name, 't': known.target_doc}}).t as target_doc from r join known on contains(' ' || name || ' ', ' ' || k || ' ') group by ref),
labelled as (select chunk_id, document_id, kind, ref, position, case when hit.target_doc is distinct from document_id then hit.target_doc end as target_doc from refs left join hit using (ref)),
usable as (select name, target_doc from known where length(name) >= 6 or len(string_split(name, ' ')) >= 2),
spoken as (select chunk_id, document_id, ' ' || trim(lower(regexp_replace(text, '[^0-9A-Za-z]+', ' ', 'g'))) || ' ' as p,
  lower(trim(regexp_replace(regexp_replace(regexp_extract(document_id, '[^/]*$'), '\.[A-Za-z0-9]{{1,5}}$', ''), '[^0-9A-Za-z]+', ' ', 'g'))) as own from c),
met as (select distinct chunk_id, document_id, name, usable.target_doc from spoken join usable on contains(p, ' ' || name || ' ') where usable.target_doc is distinct from document_id and coalesce(name <> own, true)),
named as (select chunk_id, document_id, 'document' as kind, name as ref, row_number() over (partition by chunk_id, document_id order by length(name) desc, name) - 1 as position, target_doc from met),
fresh as (select * from named n where not exists (select 1 from labelled l where l.chunk_id = n.chunk_id and l.document_id = n.document_id and l.ref = n.ref)),
both_ as (select *, 0 as g from labelled union all select *, 1 as g from fresh),
placed as (select chunk_id, document_id, kind, ref, target_doc, (row_number() over (partition by chunk_id, document_id order by g, position) - 1)::int as position from both_),
ann as (select * from placed where position < 8)"""


@query(f"with {_ANNOTATED} select chunk_id, document_id, position, kind, ref, target_doc from ann")
def crossref_annotate(spark: SparkSession, d: str) -> DataFrame:
    return crossref.annotate(_chunks(spark, d))


@query(f"with {_ANNOTATED} select count(distinct chunk_id) as chunks_with_refs, count(*) as refs, count(target_doc) as resolved, count(distinct target_doc) as target_docs from ann")
def crossref_stats(spark: SparkSession, d: str) -> DataFrame:
    return crossref.statistics(crossref.annotate(_chunks(spark, d)))


@query(
    f"""with {_ANNOTATED}, edges as (select distinct document_id, target_doc from ann where target_doc is not null and document_id is not null),
o as (select document_id, count(*) as n from edges group by 1), i as (select target_doc as document_id, count(*) as n from edges group by 1)
select coalesce(o.document_id, i.document_id) as document_id, coalesce(o.n, 0) as out_degree, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) as degree from o full join i on o.document_id = i.document_id"""
)
def link_graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return crossref.link_degrees(crossref.annotate(_chunks(spark, d)))


#: A question whose best chunks name other documents.
HOP_TERMS = ["session", "protocol", "supply", "contract"]


@query(
    f"""with {_ANNOTATED}, pages as (select distinct chunk_id, document_id, chunk_index, text from text_pages where chunk_id is not null and chunk_index >= 0), {_bm25_sql("pages", "chunk_id", terms=HOP_TERMS, p="b_")},
cand as (select p.chunk_id, p.document_id, b.rank from (select chunk_id, row_number() over (order by score desc, chunk_id) as rank from fts order by score desc, chunk_id limit 8) b join pages p using (chunk_id)),
tg as (select ann.target_doc, min({{'r': cand.rank, 'p': ann.position}}) as first from ann join cand using (chunk_id) where ann.target_doc is not null and ann.target_doc not in (select document_id from cand where document_id is not null) group by ann.target_doc),
t2 as (select target_doc, row_number() over (order by first, target_doc) as n from tg order by first, target_doc limit 2),
sc as (select p.chunk_id, p.document_id, t2.n, row_number() over (partition by p.document_id order by -fts.score, p.chunk_id) as m from pages p join fts using (chunk_id) join t2 on t2.target_doc = p.document_id),
added as (select chunk_id, document_id, ((select max(rank) from cand) + row_number() over (order by n, m))::int as rank from sc where m <= 3)
select chunk_id, document_id, rank::int as rank, false as via_crossref from cand union all select chunk_id, document_id, rank, true from added"""
)
def crossref_hop(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    known = chunks.where("chunk_index >= 0")
    hits = cut_lineage(search.bm25_scores(known, _terms(spark, HOP_TERMS), "chunk_id"))
    candidates = known.join(F.broadcast(search.ranked(search.top(hits, "chunk_id", 8), "chunk_id").select("chunk_id", "rank")), "chunk_id").select("chunk_id", "document_id", "rank")
    scored = hits.join(known.select("chunk_id", "document_id"), "chunk_id").select("chunk_id", "document_id", (-F.col("score")).alias("score"))
    return context.hop(candidates, crossref.annotate(chunks), scored, trigger=8, max_hops=2, per_hop=3)


@query(
    f"""{_EVIDENCE_SQL}, pages as {_C}, known as (select * from pages where chunk_index >= 0), {_bm25_sql("known", "chunk_id", p="b_")},
top10 as (select chunk_id, row_number() over (order by score desc, chunk_id) as rank from fts order by score desc, chunk_id limit 10),
dr as (select document_id, min(rank) as rank from known join top10 using (chunk_id) group by document_id)
select document_id from dr where (select min(evidence) from e) < 0.12 order by rank, document_id limit 1"""
)
def document_escalation(spark: SparkSession, d: str) -> DataFrame:
    """The thinnest evidence among the questions decides, as a sub-question without support does."""
    candidates = _seeds(spark, d, 10).select("document_id", "rank")
    return context.escalation(_evidence(spark, d).agg(F.min("evidence").alias("evidence")), candidates, 0.12, 1)
