"""Queries for the string, JSON and chunking functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import jsons as J
from heronry.functions import text as T
from heronry.operators import chunking
from heronry.models import yes_probability
from heronry.plans.registry import query
from heronry.sources.documents import fenced, plain_html
from heronry.sources.tables import table

_SPACES = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACES}|{_SPACES}$', '', 'g')"


def _squeeze(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{_SPACES}', ' ', 'g')")



def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", "content").distinct()


_M = "(select distinct id, content from messages)"


@query(f"select doc_id, md5({_squeeze("text")}) as squeezed, md5(lower({_squeeze("title")})) as title from documents")
def whitespace_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeezed(F.col("text"))).alias("squeezed"), F.md5(T.normalised(F.col("title"))).alias("title"))


@query(f"select id, regexp_replace(content, '(?is)<think[^>]*>.*?</think>', '', 'g') as answer from {_M}")
def think_strip(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.without_think(F.col("content")).alias("answer"))


@query(
    rf"""select id, regexp_replace(content || ' [Confidence: 73%] [Warning: Low confidence. Groundedness: 40%]', '\s*\[Confidence:\s*\d+%\]\s*(?:\[Warning:[^\]]*\])?\s*$', '') as answer from {_M}"""
)
def verifier_suffix_strip(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat("content", F.lit(" [Confidence: 73%] [Warning: Low confidence. Groundedness: 40%]"))
    return _messages(spark, d).select("id", T.without_verdict_tags(tagged).alias("answer"))


@query(r"select doc_id, regexp_replace(substr('<CONTEXT>' || text || '</OUTPUT>', 1, 4000), '<(/?(?:QUERY|CONTEXT|ANSWER|OUTPUT)>)', '< \1', 'g') as evidence from documents")
def prompt_tags_neutral(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.neutral_tags(F.concat(F.lit("<CONTEXT>"), "text", F.lit("</OUTPUT>"))).alias("evidence"))


_OPENINGS = " ".join(f"when starts_with(lower(t), '{o}') then {_trim(f'substr(t, {len(o) + 1})')}" for o in T.TITLE_OPENINGS)


@query(
    f"""with t as (select id, {_trim("content")} as t from {_M}),
b as (select id, case {_OPENINGS} else t end as b from t),
c as (select id, upper(substr(b, 1, 1)) || substr(b, 2) as c from b),
k as (select id, case when length(c) > 50 then {_trim("substr(c, 1, 50)")} || '...' else c end as k from c)
select id, case when length(k) < 3 then 'New Chat' else k end as title from k"""
)
def session_title(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.session_title(F.col("content")).alias("title"))


_ANY_TALK, _CORE_TALK = ("|".join((*phrases,)) for phrases in ((*T.TALK, *T.TALK_BESIDE), T.TALK))
_LISTED = ", ".join(f"'{p}'" for p in T.about_phrases())


@query(
    f"""with t as (select id, {_trim("coalesce(content, '')")} as t from {_M}),
w as (select id, t, list_filter(regexp_split_to_array(regexp_replace(lower(t), '\\bgpt-?[0-9]*\\b', 'gpt', 'g'), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as raw from t),
n as (select id, t, array_to_string(list_transform(raw, lambda x: case {" ".join(f"when regexp_full_match(x, '{w}{w[-1]}*') then '{w}'" for w in T.DRAWN_OUT)} else x end), ' ') as s from w)
select id, t = '' or s in ({_LISTED}) or regexp_replace(s, '^(?:{"|".join(T.ABOUT_OPENINGS)}) ', '') in ({_LISTED})
  or (len(regexp_split_to_array(t, '\\s+')) <= {T.TALK_WORDS} and regexp_full_match(s, '(?:(?:{_ANY_TALK}) )*(?:{_CORE_TALK})(?: (?:{_ANY_TALK}))*')) as small_talk from n"""
)
def smalltalk_gate(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.is_small_talk(F.col("content")).alias("small_talk"))


@query(
    r"""select id, regexp_extract(stored_path, '[^/]*$') as file, regexp_replace(regexp_extract(stored_path, '[^/]*$'), '^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}_', '') as name,
  regexp_replace(original_filename, '[^A-Za-z0-9._-]', '_', 'g') as slug, substr(sha1(stored_path), 1, 8) as tag, regexp_replace(stored_path, '\.jsonl$', '.vectors.npz') as vectors_path, coalesce(contains(stored_path, '/'), false) as remote from index_documents"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("stored_path")
    return table(spark, d, "index_documents").select("id", T.file_name(p).alias("file"), T.uploaded_name(p).alias("name"), T.slug(F.col("original_filename")).alias("slug"), T.sha1_prefix(p).alias("tag"), T.vectors_path(p).alias("vectors_path"), T.is_remote_model(p).alias("remote"))


@query(r"""with k as (select distinct k from (select unnest(['documentId', 'chunkIndex', 'enableLatechunk', 'searchType', 'retrieval_k', 'topK']) || '_' || event_type as k from events)) select k, lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\1_\2', 'g')) as snake from k""")
def camel_to_snake(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in ("documentId", "chunkIndex", "enableLatechunk", "searchType", "retrieval_k", "topK")])
    k = table(spark, d, "events").select(F.explode(F.transform(keys, lambda x: F.concat(x, F.lit("_"), "event_type"))).alias("k")).distinct()
    return k.select("k", T.snake_key(F.col("k")).alias("snake"))


@query(f"with t as (select doc_id, {_squeeze("text")} as t from documents) select doc_id, case when length(t) > 60 then substr(t, 1, 60) || '…' else t end as preview from t")
def preview_shorten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 60).alias("preview"))


@query(
    """select doc_id, greatest(1, n_chars // 4)::int as quarter, (floor(n_chars / 3.5) + 1)::int as packed,
  case when n_chars // 3 + 2048 <= 8192 then 8192 when n_chars // 3 + 2048 <= 16384 then 16384 else 32768 end as bucket from documents where n_chars is not null"""
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", T.tokens_by_fours(n).alias("quarter"), T.tokens_for_budget(n).alias("packed"), T.context_bucket(n).alias("bucket"))


@query(
    """with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: """
    + _trim("x")
    + """), lambda x: x <> '') as s from documents) select doc_id, len(s)::int as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int as longest from s"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query(
    f"""select id, array_to_string(list_transform(string_split(content, '```'), lambda p, i: case when i % 2 = 1
  then regexp_replace(regexp_replace(p, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') else p end), '```') as content from {_M}"""
)
def fence_aware_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.calm_spacing(F.col("content")).alias("content"))


@query(
    f"""with t as (select id, {_trim("coalesce(content, '')")} as raw from {_M}),
c as (select id, raw, regexp_replace(regexp_replace(raw, '(?is)<think[^>]*>.*?</think>', '', 'g'), '(?i)<assistant[^>]*>|</assistant>', '', 'g') as c from t),
a as (select id, raw, case when contains(c, 'Answer:') then substr(c, instr(c, 'Answer:') + 7) else c end as a from c),
f as (select id, raw, coalesce(list_filter(list_transform(regexp_split_to_array(a, '\\r?\\n'), lambda x: {_trim("x")}), lambda x: x <> '')[1], '') as f from a),
g as (select id, case when f = '' then raw else f end as g from f)
select id, case when length(g) < 5 then '' else g end as summary from g"""
)
def summary_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", T.clean_summary(F.col("content")).alias("summary"))


_META = "(select distinct chunk_id, text, metadata from text_pages)"
_JSON = "case when json_valid(metadata) then metadata end"


@query(
    f"""with m as (select chunk_id, text, {_JSON} as j from {_META})
select chunk_id, json_extract_string(j, '$.metadata.source') as source, try_cast(json_extract_string(j, '$.metadata.page') as int) as page,
  coalesce(nullif(json_extract_string(j, '$.metadata.original_text'), ''), nullif(json_extract_string(j, '$.original_text'), ''), nullif(text, ''), '') as body from m"""
)
def metadata_parse(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    rows = table(spark, d, "text_pages").select("chunk_id", "text", "metadata").distinct()
    return rows.select("chunk_id", J.field(m, "$.metadata.source").alias("source"), J.field(m, "$.metadata.page").try_cast("int").alias("page"), J.original_text(m, F.col("text")).alias("body"))


@query(
    """with m as (select distinct id, metadata from messages), j as (select id, case when json_valid(metadata) and json_type(metadata) = 'OBJECT' then metadata::json else '{}'::json end as j from m),
k as (select id, j, list_filter(json_keys(j), lambda k: k <> 'reviewed') as ks from j)
select id, to_json(map_from_entries(list_concat(list_transform(ks, lambda k: row(k, json_extract_string(j, '$."' || k || '"'))), [row('reviewed', 'yes')])))::varchar as metadata from k"""
)
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("id", "metadata").distinct().select("id", J.merged(F.col("metadata"), F.lit('{"reviewed": "yes"}')).alias("metadata"))


@query(
    """with r as (select 'i:' || id as id, unnest(reasons) as reason from panel_arm_i union all select 'g2:' || id, unnest(reasons) from panel_arm_g2),
v as (select distinct id, reason from r where reason is not null)
select id, reason, case when lower(trim(reason)) in ('true', 'yes', 'grounded', '1') then true when lower(trim(reason)) in ('false', 'no', 'ungrounded', '0') then false end as verdict,
  coalesce(case when isfinite(try_cast(reason as double)) then round_even(try_cast(reason as double), 0)::int end, 0) as percent from v"""
)
def verdict_coercion(spark: SparkSession, d: str) -> DataFrame:
    arms = [table(spark, d, f"panel_arm_{a}").select(F.concat(F.lit(f"{a}:"), "id").alias("id"), F.explode("reasons").alias("reason")) for a in ("i", "g2")]
    rows = arms[0].unionByName(arms[1]).where("reason is not null").distinct()
    return rows.select("id", "reason", J.as_bool(F.col("reason")).alias("verdict"), J.as_percent(F.col("reason")).alias("percent"))


@query(
    rf"""with h as (select doc_id, '<html><head><title>x</title></head><body><p>' || text || '</p><script>var a = 1;</script></body></html>' as html from documents),
a as (select doc_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', '', 'g') as t from h),
b as (select doc_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') as t from a),
c as (select doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from b)
select doc_id, {_trim("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')")} as text from c"""
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), "text", F.lit("</p><script>var a = 1;</script></body></html>"))
    return table(spark, d, "documents").select("doc_id", plain_html(page).alias("text"))


@query("select doc_id, '```' || chr(10) || text || chr(10) || '```' as markdown from documents")
def text_as_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fenced(F.col("text")).alias("markdown"))


#: Sentences packed into runs of at most 128 quarter tokens (515 characters), one sentence shared; for texts under the outer limit.
_CHUNKS = rf"""with recursive raw as (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[\s\v\x1c-\x1f\x{{0085}}\p{{Z}}]+', '\1' || chr(57344), 'g'), '\n+', chr(57344), 'g'), chr(57344)) as ss from documents where text is not null),
s as (select doc_id, list_filter(list_transform(ss, lambda x: regexp_replace(x, '^[\s\v\x1c-\x1f\x{{0085}}\p{{Z}}]+|[\s\v\x1c-\x1f\x{{0085}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '') as ss from raw),
e as (select doc_id, ss, len(ss) as n, list_transform(range(0, len(ss) + 1), lambda i: coalesce(list_sum(list_transform(ss[1:i], lambda x: length(x) + 1)), 0)::bigint) as edge from s where len(ss) > 0),
w as (select doc_id, 0 as chunk_index, 0 as i, greatest(1, len(list_filter(edge, lambda x: x <= edge[1] + 516)) - 1) as j from e
  union all
  select w.doc_id, w.chunk_index + 1, greatest(w.i + 1, w.j - 1), greatest(greatest(w.i + 1, w.j - 1) + 1, len(list_filter(e.edge, lambda x: x <= e.edge[greatest(w.i + 1, w.j - 1) + 1] + 516)) - 1) from w join e using (doc_id) where w.j < e.n),
chunks as (select w.doc_id, w.chunk_index, w.doc_id || '_' || w.chunk_index as chunk_id, array_to_string(e.ss[w.i + 1 : w.j], ' ') as text from w join e using (doc_id))"""


@query(f"{_CHUNKS} select doc_id, chunk_index, chunk_id, text from chunks")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, d, "documents"))


@query(f"{_CHUNKS} select doc_id, count(*) as chunks, max(length(text)) as longest from chunks group by doc_id")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunk_texts(table(spark, d, "documents"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("text")).alias("longest"))


@query(
    f"""select id, case when role_model then 'Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ' || content else content end as query
from (select id, content, length(id) % 2 = 0 as role_model from {_M})"""
)
def query_instruction(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.length("id") % 2 == 0, F.lit("Qwen3-Embedding-0.6B")).otherwise(F.lit("bge-small"))
    return _messages(spark, d).select("id", T.query_with_instruction(F.col("content"), model).alias("query"))


@query("select doc_id, coalesce((32768 > 0 and n_chars // 4 >= 32768 - 16) or (n_chars // 4 > 0 and n_chars > 0 and n_chars // 4 < n_chars // 6), false) as cut from documents")
def truncation_detector(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", T.prompt_was_cut(F.lit(32768), F.floor(n / 4), n).alias("cut"))


@query(
    f"""with a as (select distinct id, content from messages where content is not null),
s as (select id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: {_trim("x")}), lambda x: x <> '') as ss from a)
select id, len(ss)::int as sentences, ss[1] as first from s where len(ss) > 0"""
)
def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("content is not null").select("id", "content").distinct().select("id", T.answer_sentences(F.col("content")).alias("ss"))
    return rows.where(F.size("ss") > 0).select("id", F.size("ss").alias("sentences"), F.col("ss")[0].alias("first"))


@query("select event_id, round(1 / (1 + exp(sin(event_id) - sin(value))), 6) as p from events where value is not null")
def yes_no_probability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(yes_probability(F.sin("value"), F.sin("event_id")), 6).alias("p"))
