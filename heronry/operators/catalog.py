"""Sessions, messages and indexes: listings, counts, cleaning up, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """The sessions touched last; repeated rows count once."""
    return sessions.distinct().orderBy(F.desc("updated_at"), "id").limit(n)


def messages_of(messages: DataFrame, session_id: str, n: int = 100) -> DataFrame:
    """The first messages of a session, the oldest first."""
    return messages.where(F.col("session_id") == session_id).distinct().orderBy("timestamp", "id").limit(n)


def empty_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id) of the sessions without a message."""
    return sessions.select("id").distinct().join(messages.select(F.col("session_id").alias("id")), "id", "left_anti")


def with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with the stored and the actual number of messages; deliveries that repeat count once."""
    n = messages.where("session_id is not null").select("session_id", "id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("actual"))
    s = sessions.select("id", F.col("message_count").alias("stored")).distinct()
    return s.join(n, s["id"] == n["session_id"], "left").select("id", "stored", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"))


def stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """One row (total_sessions, total_messages, most_used_model); ties by name, null without a model."""
    s = sessions.select("id", "model_used").distinct()
    model = s.where("model_used is not null").groupBy("model_used").count().orderBy(F.desc("count"), "model_used").limit(1).agg(F.first("model_used").alias("most_used_model"))
    m = messages.agg(F.countDistinct("id").alias("total_messages"))
    return s.agg(F.countDistinct("id").alias("total_sessions")).crossJoin(F.broadcast(m)).crossJoin(F.broadcast(model))


def without_session(session_id: str, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """The tables (frame, column) without a session and what hangs on it; null keys stay."""
    return [df.where(~F.col(c).eqNullSafe(F.lit(session_id))) for df, c in tables]


def indexes_with_documents(index_documents: DataFrame) -> DataFrame:
    """(index_id, n_documents, documents): the documents of each index, by row id; files without an index come under null."""
    return index_documents.groupBy("index_id").agg(F.count(F.lit(1)).alias("n_documents"), F.transform(F.array_sort(F.collect_list(F.struct("id", "original_filename"))), lambda r: r["original_filename"]).alias("documents"))


def latest_link(links: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """(by, value) of the last row of each key in an order: a session's active index, a file's newest upload."""
    return links.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_turns(turns: DataFrame, n: int, by: str = "session_id", order: tuple[str, ...] = ("instant", "id")) -> DataFrame:
    """The last ``n`` rows of each key with ``turn`` from 1 in order; what is kept as history.

    Ranking stops after ``n`` rows in every task before anything is shuffled.
    """
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = turns.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    n_kept = F.count(F.lit(1)).over(Window.partitionBy(by))
    return kept.withColumn("turn", (n_kept - F.col("_back") + 1).cast("int")).drop("_back")


def formatted_history(turns: DataFrame, by: str = "session_id") -> DataFrame:
    """(by, history): turns as "role: content" lines in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "content").alias("line"))))
    return turns.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("history"))


def usage_by_stage(calls: DataFrame, stage: str = "stage") -> DataFrame:
    """(stage, prompt_tokens, output_tokens, total_tokens, calls) with a row under null for the total."""
    out = calls.rollup(stage).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("output_tokens"))


def cache_probe(queries: DataFrame, cache: DataFrame, least: float = 0.98) -> DataFrame:
    """(query_id, entry): the first cached entry (seq, session_id, filters, entry, vector) close enough to a query of the same session and filters."""
    from heronry.functions.vectors import cosine

    q = queries.select("query_id", F.col("session_id").alias("qs"), F.col("filters").alias("qf"), F.col("vector").alias("qv"))
    pairs = cache.join(F.broadcast(q), F.col("session_id").eqNullSafe(F.col("qs")) & F.col("filters").eqNullSafe(F.col("qf")))
    near = pairs.where((F.size("vector") == F.size("qv")) & (cosine(F.col("vector"), F.col("qv")) >= least))
    return near.groupBy("query_id").agg(F.min_by("entry", "seq").alias("entry"))


def cache_probe_blocks(queries: DataFrame, cache: DataFrame, least: float = 0.98, blocks: int = 16) -> DataFrame:
    """``cache_probe`` for queries without a bound: the entries of a session are dealt to blocks, and every query meets each of them."""
    from heronry.functions.vectors import cosine

    q = queries.select("query_id", F.col("session_id").alias("qs"), F.col("filters").alias("qf"), F.col("vector").alias("qv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"))
    dealt = cache.withColumn("block", F.pmod(F.hash("seq"), F.lit(blocks)))
    pairs = dealt.join(q, (F.col("block") == F.col("qb")) & F.col("session_id").eqNullSafe(F.col("qs")) & F.col("filters").eqNullSafe(F.col("qf")))
    near = pairs.where((F.size("vector") == F.size("qv")) & (cosine(F.col("vector"), F.col("qv")) >= least))
    return near.groupBy("query_id").agg(F.min_by("entry", "seq").alias("entry"))


def index_statistics(chunks: DataFrame) -> DataFrame:
    """One row (files, chunks, chunks_per_file)."""
    return chunks.agg(F.countDistinct("document_id").alias("files"), F.count(F.lit(1)).alias("chunks")).withColumn("chunks_per_file", F.when(F.col("files") > 0, F.col("chunks") / F.col("files")))


def memory_estimate(chunks: DataFrame, first: int = 10) -> DataFrame:
    """One row (megabytes): rows times two bytes a character, by the mean length of the first rows by id."""
    head = chunks.orderBy("chunk_id").limit(first).agg(F.avg(F.length("text")).alias("mean"))
    return chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(head)).select((F.col("n") * F.col("mean") * 2 / (1024 * 1024)).alias("megabytes"))


def appended(rows: DataFrame, **values) -> DataFrame:
    """``rows`` and one more with the given values; columns that are not named are null, unknown ones are refused."""
    unknown = set(values) - set(rows.columns)
    if unknown:
        raise ValueError(f"no column {', '.join(sorted(unknown))}")
    one = rows.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    return rows.unionByName(one)


def message_added(sessions: DataFrame, messages: DataFrame, message: dict, at: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) with the message, its session's count one higher and its time of change set.

    A message of an unknown session is refused by the caller's foreign key, not here: it is added and no session changes.
    """
    own = F.col("id") == F.lit(message["session_id"])
    touched = sessions.withColumn("message_count", F.when(own, F.coalesce("message_count", F.lit(0)) + 1).otherwise(F.col("message_count")).cast(dict(sessions.dtypes)["message_count"]))
    touched = touched.withColumn("updated_at", F.when(own, F.lit(at)).otherwise(F.col("updated_at")))
    return touched, appended(messages, **message)


def turn_saved(sessions: DataFrame, messages: DataFrame, session_id: str, question: tuple[str, str], answer: tuple[str, str], at: str) -> tuple[DataFrame, DataFrame]:
    """Both messages of a turn, (id, content) each, as they come when a stream has ended; the answer's time is the question's or later."""
    for (name, content), sender in ((question, "user"), (answer, "assistant")):
        sessions, messages = message_added(sessions, messages, {"id": name, "session_id": session_id, "content": content, "sender": sender, "timestamp": at}, at)
    return sessions, messages


def session_renamed(sessions: DataFrame, session_id: str, title: str, at: str) -> DataFrame:
    """Sessions with one title changed, and its time of change; a blank title is refused."""
    if not title or not title.strip():
        raise ValueError("a title is not blank")
    own = F.col("id") == F.lit(session_id)
    return sessions.withColumn("title", F.when(own, F.lit(title.strip())).otherwise(F.col("title"))).withColumn("updated_at", F.when(own, F.lit(at)).otherwise(F.col("updated_at")))


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """``rows`` with numbers from 0 in an order, by running counts over sorted slices: no task sees all rows."""
    from heronry.operators.ordered import running_total

    return running_total(rows.withColumn("_one", F.lit(1)), "_one", [order], F.lit(1), name).drop("_one")


def session_documents(links: DataFrame, index_documents: DataFrame) -> DataFrame:
    """(session_id, index_id, n_documents, documents) of links (session_id, index_id, ...); an index without documents has none."""
    held = indexes_with_documents(index_documents)
    joined = links.select("session_id", "index_id").distinct().join(held, "index_id", "left")
    return joined.select("session_id", "index_id", F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"), F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


#: Upper bounds, in quarter tokens of a chunk, of the chunk sizes that are told apart.
CHUNK_SIZES = ((300, "256 tokens (estimated)"), (600, "512 tokens (estimated)"))


def inferred_metadata(chunks: DataFrame) -> DataFrame:
    """One row (status, total_chunks, vector_dimensions, has_document_structure, has_chunk_indexing, has_contextual_enrichment, sample_chunk_length, chunk_size) of an index nobody described.

    The sample is the chunk with the smallest id; an empty table has the status ``empty`` and nulls.
    """
    sample = F.min_by(F.struct("vector", "text", "metadata"), "chunk_id").alias("s")
    one = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), sample)
    has = lambda name: F.coalesce(F.get_json_object("s.metadata", f"$.{name}"), F.get_json_object("s.metadata", f"$.metadata.{name}")).isNotNull()
    length = F.length("s.text")
    size = F.lit("1024+ tokens (estimated)")
    for bound, name in reversed(CHUNK_SIZES):
        size = F.when(F.floor(length / 4) < bound, name).otherwise(size)
    there = F.col("total_chunks") > 0
    return one.select(
        F.when(there, "functional").otherwise("empty").alias("status"), "total_chunks", F.when(F.col("s.vector").isNotNull(), F.size("s.vector")).alias("vector_dimensions"), (there & has("document_id")).alias("has_document_structure"),
        (there & has("chunk_index")).alias("has_chunk_indexing"), (there & has("original_text")).alias("has_contextual_enrichment"), F.when(length > 0, length).alias("sample_chunk_length"), F.when(length > 0, size).alias("chunk_size"),
    )


def history_for_rewriting(turns: DataFrame, by: str = "session_id", most: int = 300) -> DataFrame:
    """(by, history) as :func:`formatted_history`, the last answer cut to ``most`` characters and dots."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy(by))
    cut = F.when((F.col("turn") == F.col("_last")) & (F.length("content") > most), F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return formatted_history(turns.withColumn("_last", last).withColumn("content", cut), by)


def widest_so_far(calls: DataFrame, model: str, order: list[str], window: str) -> DataFrame:
    """Calls with ``window`` raised to the widest one the model had before: a model is not loaded again for less."""
    return calls.withColumn(window, F.max(window).over(Window.partitionBy(model).orderBy(*order)))
