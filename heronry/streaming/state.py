"""Stateful streams: capped histories, a cache with expiry, running usage, incremental upserts.

State is keyed, so it spreads over the cluster; each function is also what a batch of
the same rows would give.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heronry.session import scratch_path
from heronry.sources import store

HISTORY_STATE = "roles array<string>, contents array<string>"


def capped_history(turns: DataFrame, most: int = 40) -> DataFrame:
    """A stream of (session_id, role, content) as (session_id, turns, last_content): the last ``most`` turns are kept.

    With a column ``at`` the turns of a micro-batch go by it, else by their arrival.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        roles, contents = map(list, state.get) if state.exists else ([], [])
        for pdf in batches:
            pdf = pdf.sort_values("at", kind="stable") if "at" in pdf.columns else pdf
            roles, contents = (roles + pdf["role"].tolist())[-most:], (contents + pdf["content"].tolist())[-most:]
        state.update((roles, contents))
        yield pd.DataFrame({"session_id": [key[0]], "turns": [len(roles)], "last_content": [contents[-1] if contents else None]})

    return turns.groupBy("session_id").applyInPandasWithState(update, "session_id string, turns int, last_content string", HISTORY_STATE, "update", GroupStateTimeout.NoTimeout)


def expiring_cache(requests: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, at, value) as (key, at, answer, hit): a value answers later requests of its key for ``seconds``.

    The key is session, filters and query together, so sessions do not overwrite each other.  ``at`` is event time;
    rows of a batch are taken in its order; an expired entry is replaced by the request that finds it so, and its state
    is given up once the watermark (``late`` behind the newest request) has passed its end.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored, value = state.get if state.exists else (None, None)
        for pdf in batches:
            pdf = pdf.sort_values("at", kind="stable")
            out = []
            for at, new in zip(pdf["at"], pdf["value"]):
                now = at.timestamp()
                fresh = stored is not None and 0 <= now - stored < seconds
                if not fresh:
                    stored, value = now, new
                out.append((key[0], at, value, fresh))
            yield pd.DataFrame(out, columns=["key", "at", "answer", "hit"])
        state.update((stored, value))
        state.setTimeoutTimestamp(max(int((stored + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    return requests.withWatermark("at", late).groupBy("key").applyInPandasWithState(update, "key string, at timestamp, answer string, hit boolean", "stored double, value string", "append", GroupStateTimeout.EventTimeTimeout)


def bounded_cache(requests: DataFrame, most: int = 100, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, key, at, value) as (session_id, key, at, answer, hit, entries): at most ``most`` entries a session.

    An entry answers for ``seconds``; beyond ``most`` the oldest goes.  A session's state is given up with its last entry.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        for pdf in batches:
            out = []
            for k, at, new in pdf.sort_values("at", kind="stable")[["key", "at", "value"]].itertuples(index=False):
                now = at.timestamp()
                hit = k in entries and 0 <= now - entries[k][0] < seconds
                if not hit:
                    entries.pop(k, None)
                    entries[k] = (now, new)
                    if len(entries) > most:
                        entries.pop(min(entries, key=lambda x: entries[x][0]))
                out.append((key[0], k, at, entries[k][1] if k in entries else new, hit, len(entries)))
            yield pd.DataFrame(out, columns=["session_id", "key", "at", "answer", "hit", "entries"])
        state.update((list(entries), [t for t, _ in entries.values()], [v for _, v in entries.values()]))
        newest = max(t for t, _ in entries.values())
        state.setTimeoutTimestamp(max(int((newest + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    schema, kept = "session_id string, key string, at timestamp, answer string, hit boolean, entries int", "keys array<string>, stored array<double>, values array<string>"
    return requests.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(update, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """Usage per stage of a folder or file of calls, read to its end as a stream: (stage, calls, total).

    Every micro-batch leaves the stages it changed in the shared folder; the last version of a stage counts.
    """
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    is_file = not [f for f in spark.read.parquet(path).inputFiles() if f"{name}/" in f]
    source = spark.readStream.schema(schema)
    stream = source.option("pathGlobFilter", name).parquet(folder) if is_file else source.parquet(path)
    out = scratch_path(spark, "usage")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    grouped = stream.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("total"))
    running = grouped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    running.awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").schema("stage string, calls long, total double, batch int").parquet(out)
    return store.last_lines(found, "stage", "batch").select("stage", "calls", "total")


def upsert_stream(chunks: DataFrame, path: str, marker: store.Marker, state: str):
    """Writes a stream of chunk rows into a store: each micro-batch replaces the documents it has."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch.sparkSession, path, batch, marker)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True)


def progress_line(progress: dict) -> str:
    """A running query's last micro-batch in one line."""
    name = progress.get("name") or progress.get("id", "")
    return f"{name}: batch {progress.get('batchId')}, {progress.get('numInputRows', 0)} rows, {progress.get('processedRowsPerSecond', 0) or 0:.0f} rows/s"


def report_progress(query, say, seconds: float = 10.0, wait=time.sleep) -> None:
    """Says where a running query is every so many seconds until it ends, each micro-batch once."""
    last = None
    while query.isActive:
        now = query.lastProgress
        if now and now.get("batchId") != last:
            last = now.get("batchId")
            say(progress_line(now))
        wait(seconds)
    if query.lastProgress and query.lastProgress.get("batchId") != last:
        say(progress_line(query.lastProgress))
