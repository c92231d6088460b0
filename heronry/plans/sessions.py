"""Catalog queries over sessions, messages, index_documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import catalog
from heronry.plans.registry import query
from heronry.sources.tables import single_column_sorted, table


@query("select id from sessions where id is not null and id not in (select session_id from messages where session_id is not null) group by id")
def empty_sessions(spark: SparkSession, d: str) -> DataFrame:
    return catalog.empty_sessions(table(spark, d, "sessions").where("id is not null"), table(spark, d, "messages"))


@query(
    """with n as (select session_id, count(distinct id) as actual from messages where session_id is not null group by session_id), s as (select distinct id, message_count as stored from sessions)
select s.id, stored, coalesce(actual, 0) as actual from s left join n on s.id = n.session_id"""
)
def session_message_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_counts(table(spark, d, "sessions"), table(spark, d, "messages"))


@query(
    """with s as (select distinct id, model_used from sessions), m as (select model_used, count(*) as n from s where model_used is not null group by model_used order by n desc, model_used limit 1)
select (select count(distinct id) from s) as total_sessions, (select count(distinct id) from messages) as total_messages, (select model_used from m) as most_used_model"""
)
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stats(table(spark, d, "sessions"), table(spark, d, "messages"))


@query("select id, title, updated_at, model_used from (select distinct * from sessions) order by updated_at desc, id limit 50")
def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    return catalog.newest_sessions(table(spark, d, "sessions")).select("id", "title", "updated_at", "model_used")


@query(
    """with b as (select session_id from messages where session_id is not null group by session_id order by count(*) desc, session_id limit 1)
select id, sender, content, timestamp from (select distinct * from messages) where session_id = (select session_id from b) order by timestamp, id limit 100"""
)
def oldest_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    busiest = m.where("session_id is not null").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return catalog.messages_of(m, busiest["session_id"] if busiest else "", 100).select("id", "sender", "content", "timestamp")


_TURNS = "(select distinct id, session_id, lower(trim(sender)) as role, content, timestamp from messages where session_id is not null and timestamp is not null and id is not null)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("session_id is not null and timestamp is not null and id is not null")
    return m.select("id", "session_id", F.lower(F.trim("sender")).alias("role"), "content", F.col("timestamp").alias("instant")).distinct()


@query(
    f"""with r as (select *, row_number() over (partition by session_id order by timestamp desc, id desc) as back from {_TURNS}), k as (select * from r where back <= 5)
select session_id, id, (count(*) over (partition by session_id) - back + 1)::int as turn from k"""
)
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_turns(_turns(spark, d), 5).select("session_id", "id", "turn")


@query(
    f"""with r as (select *, row_number() over (partition by session_id order by timestamp desc, id desc) as back from {_TURNS}), k as (select * from r where back <= 5)
select session_id, string_agg(concat_ws(': ', role, content), chr(10) order by back desc) as history from k group by session_id"""
)
def history_text(spark: SparkSession, d: str) -> DataFrame:
    return catalog.formatted_history(catalog.last_turns(_turns(spark, d), 5))


@query("select index_id, count(*) as n_documents, list(original_filename order by id) as documents from index_documents group by index_id")
def indexes_with_documents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.indexes_with_documents(table(spark, d, "index_documents"))


@query("select original_filename, arg_max(index_id, id) as index_id from index_documents where index_id is not null group by original_filename")
def active_index(spark: SparkSession, d: str) -> DataFrame:
    return catalog.latest_link(table(spark, d, "index_documents").where("index_id is not null"), "original_filename", "index_id", ["id"])


@query("select event_type as stage, sum(user_id)::bigint as prompt_tokens, sum(event_id)::bigint as output_tokens, count(*) as calls, sum(user_id + event_id)::bigint as total_tokens from events group by rollup (event_type)")
def token_usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("output_tokens"))
    return catalog.usage_by_stage(calls)


_COS = "list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda p: p[1]::double * p[2]::double)) / sqrt(list_sum(list_transform(c.embedding, lambda x: x::double * x::double)) * list_sum(list_transform(q.embedding, lambda x: x::double * x::double)))"


@query(
    f"""with q as (select * from embeddings where vec_id % 20 = 0)
select q.vec_id as query_id, min(c.vec_id) as entry from embeddings c, q where c.label = q.label and {_COS} >= 0.6 group by q.vec_id"""
)
def semantic_cache_probe(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, ids divisible by 20, against all rows as the cache."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("session_id"), F.lit(None).cast("string").alias("filters"), F.col("embedding").alias("vector"))
    return catalog.cache_probe_blocks(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumn("seq", F.col("vec_id")).withColumnRenamed("vec_id", "entry"), 0.6)


@query(f"select q.vec_id as query_id, min(c.vec_id) as entry from embeddings c, embeddings q where c.label = q.label and {_COS} >= 0.6 group by q.vec_id")
def semantic_cache_probe_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vector probed against all vectors of its label."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("session_id"), F.lit(None).cast("string").alias("filters"), F.col("embedding").alias("vector"))
    return catalog.cache_probe_blocks(e.withColumnRenamed("vec_id", "query_id"), e.withColumn("seq", F.col("vec_id")).withColumnRenamed("vec_id", "entry"), 0.6)


_C = "(select distinct chunk_id, document_id, text from text_pages)"


@query(f"select count(distinct document_id) as files, count(*) as chunks, round(count(*) / count(distinct document_id), 6) as chunks_per_file from {_C}")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "text_pages").select("chunk_id", "document_id", "text").distinct()
    return catalog.index_statistics(chunks).select("files", "chunks", F.round("chunks_per_file", 6).alias("chunks_per_file"))


@query(f"select round((select count(*) from {_C}) * (select avg(length(text)) from (select text from {_C} order by chunk_id limit 10)) * 2 / (1024 * 1024), 6) as megabytes")
def memory_estimate(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "text_pages").select("chunk_id", "document_id", "text").distinct()
    return catalog.memory_estimate(chunks).select(F.round("megabytes", 6).alias("megabytes"))


@query("select distinct source from documents order by source nulls first")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return single_column_sorted(table(spark, d, "documents"), "source")


@query("select session_id, id, sender from (select distinct * from messages) where session_id is null or session_id <> (select min(id) from sessions)")
def session_deleted(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "sessions").agg(F.min("id")).first()[0]
    _, messages = catalog.without_session(first, (table(spark, d, "sessions"), "id"), (table(spark, d, "messages").distinct(), "session_id"))
    return messages.select("session_id", "id", "sender")


@query("select doc_id, overview from (select doc_id, title as overview, row_number() over (partition by lower(title) order by ingested_at desc, doc_id desc) as n from documents where title is not null) where n = 1")
def last_line_wins(spark: SparkSession, d: str) -> DataFrame:
    from heronry.sources.store import last_lines

    rows = table(spark, d, "documents").where("title is not null").select("doc_id", F.col("title").alias("overview"), F.lower("title").alias("k"), F.struct("ingested_at", "doc_id").alias("line"))
    return last_lines(rows, "k", "line").select("doc_id", "overview")


@query(
    """select event_type as stage, count(*) as calls, round(sum(value), 4) as total from events group by event_type"""
)
def stream_token_usage(spark: SparkSession, d: str) -> DataFrame:
    from heronry.streaming.state import usage_stream

    return usage_stream(spark, f"{d}/events.parquet").select("stage", "calls", F.round("total", 4).alias("total"))


@query(
    """with s as (select distinct * from sessions where id is not null), f as (select min(id) as id from s)
select s.id, case when s.id = f.id then 'A new title' else title end as title, case when s.id = f.id then '2027-01-01T00:00:00' else updated_at end as updated_at from s, f"""
)
def session_renamed(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "sessions").where("id is not null").distinct()
    return catalog.session_renamed(sessions, sessions.agg(F.min("id")).first()[0], " A new title ", "2027-01-01T00:00:00").select("id", "title", "updated_at")


@query(
    """with s as (select distinct * from sessions where id is not null), f as (select min(id) as id from s)
select s.id as session_id, s.message_count + case when s.id = f.id then 2 else 0 end as message_count, case when s.id = f.id then '2027-01-01T00:00:00' else updated_at end as updated_at,
  (select count(distinct m.id) from messages m where m.session_id = s.id) + case when s.id = f.id then 2 else 0 end as messages from s, f"""
)
def turn_saved(spark: SparkSession, d: str) -> DataFrame:
    sessions, messages = table(spark, d, "sessions").where("id is not null").distinct(), table(spark, d, "messages")
    first = sessions.agg(F.min("id")).first()[0]
    sessions, messages = catalog.turn_saved(sessions, messages, first, ("new-q", "Which valve?"), ("new-a", "The inlet valve."), "2027-01-01T00:00:00")
    n = messages.where("session_id is not null").groupBy("session_id").agg(F.countDistinct("id").alias("messages"))
    joined = sessions.select(F.col("id").alias("session_id"), F.col("message_count").cast("long").alias("message_count"), "updated_at").join(n, "session_id", "left")
    return joined.select("session_id", "message_count", "updated_at", F.coalesce("messages", F.lit(0).cast("long")).alias("messages"))


@query(
    """with s as (select vector, text, metadata, try_cast(case when json_valid(metadata) then metadata end as json) as j from text_pages where chunk_id = (select min(chunk_id) from text_pages) limit 1)
select 'functional' as status, (select count(*) from text_pages) as total_chunks, len(vector) as vector_dimensions, coalesce(json_extract_string(j, '$.document_id'), json_extract_string(j, '$.metadata.document_id')) is not null as has_document_structure,
  coalesce(json_extract_string(j, '$.chunk_index'), json_extract_string(j, '$.metadata.chunk_index')) is not null as has_chunk_indexing, coalesce(json_extract_string(j, '$.original_text'), json_extract_string(j, '$.metadata.original_text')) is not null as has_contextual_enrichment,
  length(text) as sample_chunk_length, case when length(text) // 4 < 300 then '256 tokens (estimated)' when length(text) // 4 < 600 then '512 tokens (estimated)' else '1024+ tokens (estimated)' end as chunk_size from s"""
)
def inferred_index_metadata(spark: SparkSession, d: str) -> DataFrame:
    return catalog.inferred_metadata(table(spark, d, "text_pages"))


@query(
    """with l as (select distinct s.id as session_id, i.index_id from (select id, row_number() over (order by id) as n from (select distinct id from sessions where id is not null)) s
  join (select index_id, row_number() over (order by index_id) as n, count(*) over () as all_ from (select distinct index_id from index_documents where index_id is not null)) i on i.n = (s.n - 1) % i.all_ + 1)
select l.session_id, l.index_id, count(d.id) as n_documents, coalesce(list(d.original_filename order by d.id) filter (d.id is not null), []) as documents from l left join index_documents d using (index_id) group by all"""
)
def session_documents(spark: SparkSession, d: str) -> DataFrame:
    """The tables have no links of sessions and indexes: the sessions in order are dealt to the indexes in order."""
    held = table(spark, d, "index_documents")
    number = lambda df, c: catalog.numbered(df.where(F.col(c).isNotNull()).select(c).distinct(), c)
    indexes, sessions = number(held, "index_id"), number(table(spark, d, "sessions").select(F.col("id").alias("session_id")), "session_id")
    n = F.broadcast(indexes.agg(F.count(F.lit(1)).alias("all")))
    dealt = sessions.crossJoin(n).withColumn("n", F.col("n") % F.col("all")).drop("all")
    return catalog.session_documents(dealt.join(indexes, "n").select("session_id", "index_id"), held)


@query(
    """with t as (select session_id, timestamp, id, length(content) as chars from (select distinct session_id, timestamp, id, content from messages where session_id is not null and content is not null)),
b as (select *, case when chars // 3 + 2048 <= 8192 then 8192 when chars // 3 + 2048 <= 16384 then 16384 else 32768 end as w from t)
select session_id, id, max(w) over (partition by session_id order by timestamp, id, chars)::int as context_window from b"""
)
def context_window_so_far(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").where("session_id is not null and content is not null").select("session_id", "timestamp", "id", "content").distinct()
    calls = m.select("session_id", "timestamp", "id", F.length("content").alias("chars")).withColumn("context_window", T.context_bucket(F.col("chars")))
    return catalog.widest_so_far(calls, "session_id", ["timestamp", "id", "chars"], "context_window").select("session_id", "id", F.col("context_window").cast("int").alias("context_window"))
