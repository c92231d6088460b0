"""The chunk store: segments of parquet with a marker of what made their vectors, upserts by document, sidecars.

An upsert or delete only adds a segment: the new rows, and the documents they replace.  A version of the table is
a small file that lists its segments; it takes its name by one rename, so a reader sees the old version or the new
one, and a writer that fails at any moment leaves the last version as it was.  A row counts if no later segment
replaces its document.  After ``COMPACT`` segments they are written together; the segments of the last but one
version stay for readers that have begun.  One writer at a time.
"""

from __future__ import annotations

import json
import os
import time
import warnings
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.vectors import is_finite, unit

#: More segments than this are written together.
COMPACT = 32
COLUMNS = ["vector", "text", "chunk_id", "document_id", "chunk_index", "metadata"]
SCHEMA = "vector array<float>, text string, chunk_id string, document_id string, chunk_index int, metadata string"


class EmbedderMismatchError(ValueError):
    """Vectors of one model are written to or searched with those of another."""


@dataclass(frozen=True)
class Marker:
    embedder: str
    width: int
    normalised: bool = True


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_marker(spark: SparkSession, path: str, marker: Marker) -> None:
    row = [(json.dumps(marker.__dict__, sort_keys=True),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_marker")


def read_marker(spark: SparkSession, path: str) -> Marker | None:
    """None for a table without one (or no table)."""
    fs, p = _fs(spark, f"{path}/_marker")
    if not fs.exists(p):
        return None
    return Marker(**json.loads(spark.read.text(str(p)).first()[0]))


def check_marker(marker: Marker | None, embedder: str, width: int | None = None) -> bool:
    """Whether vectors are to be normalised; raises for another embedder or width.  A table without marker passes, unnormalised."""
    if marker is None:
        warnings.warn("the table has no marker: its vectors are taken to be of the same model, and as they are", stacklevel=2)
        return False
    if marker.embedder != embedder:
        raise EmbedderMismatchError(f"the table's vectors are of {marker.embedder}, not of {embedder}")
    if width is not None and marker.width != width:
        raise EmbedderMismatchError(f"the table's vectors have {marker.width} values, not {width}")
    return marker.normalised


def prepared(rows: DataFrame, marker: Marker) -> DataFrame:
    """Rows fit to be written: vectors finite and of the table's width, normalised if it is; index -1 for unknown; text not null."""
    v = F.col("vector")
    good = rows.where(is_finite(v) & (F.size(v) == marker.width))
    vector = unit(v).cast("array<float>") if marker.normalised else v.cast("array<float>")
    return good.select(vector.alias("vector"), F.coalesce("text", F.lit("")).alias("text"), "chunk_id", "document_id", F.coalesce("chunk_index", F.lit(-1)).cast("int").alias("chunk_index"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows without the new rows' documents, and the new rows; rows without a document are never replaced."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _names(fs, folder) -> list[str]:
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, the newest last."""
    fs, folder = _fs(spark, f"{path}/_versions")
    return [int(n[:-5]) for n in _names(fs, folder) if n.endswith(".json") and n[:-5].isdigit()]


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Folders of a version's segments, the oldest first; of the newest version by default, none where there is none."""
    if version is None:
        version = max(versions(spark, path), default=None)
    if version is None:
        return []
    return json.loads(spark.read.text(f"{path}/_versions/{version:010d}.json").first()[0])["segments"]


def _publish(spark: SparkSession, path: str, names: list[str]) -> None:
    """Makes the next version visible, then removes versions and segments that neither it nor the one before has."""
    fs, folder = _fs(spark, f"{path}/_versions")
    fs.mkdirs(folder)
    there = versions(spark, path)
    number = max(there, default=0) + 1
    target, draft = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{n}") for n in (f"{number:010d}.json", f".draft-{uuid4().hex}"))
    out = fs.create(draft)
    out.writeBytes(json.dumps({"segments": names}))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"version {number} of {path} was written by somebody else")
    kept = {*names, *(segments(spark, path, there[-1]) if there else ())}
    for n in there[:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{n:010d}.json"), False)
    for n in _names(fs, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")):
        if n not in kept:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{n}"), True)


def _write_segment(path: str, rows: DataFrame, documents: DataFrame) -> str:
    name = f"s-{uuid4().hex}"
    rows.write.parquet(f"{path}/data/{name}/rows")
    documents.select("document_id").where("document_id is not null").distinct().write.parquet(f"{path}/data/{name}/documents")
    return name


def upsert(spark: SparkSession, path: str, rows: DataFrame, marker: Marker, compact_after: int = COMPACT) -> None:
    """Replaces the documents of ``rows``; what is written is these rows, however large the table is."""
    found = read_marker(spark, path)
    check_marker(found, marker.embedder, marker.width)
    if found is None:
        write_marker(spark, path, marker)
    ready = prepared(rows, found or marker)
    _publish(spark, path, [*segments(spark, path), _write_segment(path, ready, rows)])
    if len(segments(spark, path)) > compact_after:
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """Writes the rows that count into one segment."""
    whole = read_chunks(spark, path)
    _publish(spark, path, [_write_segment(path, whole, whole)])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version.  Fails where there is no table; see :func:`search_rows` for a search that must not."""
    names = segments(spark, path)
    if not names:
        raise FileNotFoundError(f"there is no chunk table in {path}")
    parts = [spark.read.schema(SCHEMA).parquet(f"{path}/data/{n}/rows") for n in names]
    if len(parts) == 1:
        return parts[0]
    marks = [spark.read.schema("document_id string").parquet(f"{path}/data/{n}/documents").withColumn("_last", F.lit(i)) for i, n in enumerate(names)]
    last = reduce(DataFrame.unionByName, marks).groupBy("document_id").agg(F.max("_last").alias("_last"))
    every = reduce(DataFrame.unionByName, [p.withColumn("_segment", F.lit(i)) for i, p in enumerate(parts)])
    return every.join(last, "document_id", "left").where(F.col("_last").isNull() | (F.col("_segment") == F.col("_last"))).select(*COLUMNS)


def delete_documents(spark: SparkSession, path: str, document_ids: list[str]) -> None:
    """Takes documents out of the stored table.  Ids that are no strings, blank, or hold a quote or control character are refused."""
    for i in document_ids:
        if not isinstance(i, str) or not i.strip() or any(c in "'\"\\;`" or ord(c) < 32 for c in i):
            raise ValueError(f"no document has the id {i!r}")
    if document_ids:
        gone = spark.createDataFrame([(i,) for i in document_ids], "document_id string")
        _publish(spark, path, [*segments(spark, path), _write_segment(path, spark.createDataFrame([], SCHEMA), gone)])


def search_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows to be searched, or None where the table is missing or cannot be read: a failed search is not an empty one."""
    try:
        return read_chunks(spark, path)
    except FileNotFoundError:
        return None


def drop_store(spark: SparkSession, path: str) -> bool:
    """Removes the table and all that lies beside it; False if there was none."""
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def deleted(chunks: DataFrame, document_ids: list[str]) -> DataFrame:
    return chunks.where(~F.coalesce(F.col("document_id").isin(document_ids), F.lit(False)))


def one_per_chunk(chunks: DataFrame) -> DataFrame:
    """Each chunk_id once, the row with the newest stamp in its metadata; rows without an id stay."""
    stamp = F.get_json_object("metadata", "$.metadata.indexed_at")
    w = Window.partitionBy("chunk_id").orderBy(F.desc_nulls_last(stamp), F.desc_nulls_last("metadata"))
    named = chunks.where("chunk_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return named.unionByName(chunks.where("chunk_id is null"))


def last_lines(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the line that was written last."""
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def read_overviews(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, overview) of append-only JSON lines, the last line of a document winning; broken and failed lines are skipped.

    Later files win over earlier ones, whole folders included.  Inside one, lines written by :func:`append_overviews` go by
    the number of their write; lines without one by their place in the file.
    """
    parts = []
    for n, p in enumerate(paths):
        place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        parts.append(spark.read.text(p).select(F.lit(n).alias("file"), place.alias("place"), F.from_json("value", "doc_id string, overview string, written long").alias("r")))
    every = reduce(DataFrame.unionByName, parts).select("file", "place", "r.*")
    good = every.where("doc_id is not null and trim(coalesce(overview, '')) <> '' and not overview like 'Failed to generate overview%'")
    return good.groupBy("doc_id").agg(F.max_by("overview", F.struct("file", "written", "place")).alias("overview"))


def append_overviews(overviews: DataFrame, path: str) -> None:
    """Adds lines that win over all that are there; a failed write leaves no line, as Spark's committer moves whole files."""
    overviews.select("doc_id", "overview").withColumn("written", F.lit(time.time_ns())).write.mode("append").json(path)


OVERVIEW_VECTORS = "doc_id string, vector array<float>"


def write_overview_vectors(overviews: DataFrame, path: str, embed, normalised: bool = True) -> None:
    """The vectors of overviews beside their lines, under the name :func:`heronry.functions.text.vectors_path` gives; replaced as a whole."""
    from heronry.models import embeddings

    made = embeddings(overviews.select("doc_id", "overview"), "overview", embed).where(is_finite(F.col("vector")))
    vector = unit(F.col("vector")).cast("array<float>") if normalised else F.col("vector")
    made.select("doc_id", vector.alias("vector")).write.mode("overwrite").parquet(path)


def read_overview_vectors(spark: SparkSession, path: str, embed=None, overviews: DataFrame | None = None) -> DataFrame:
    """(doc_id, vector): stored ones, and where there are none for an overview those made now, if an embedder is given."""
    fs, p = _fs(spark, path)
    stored = spark.read.schema(OVERVIEW_VECTORS).parquet(path) if fs.exists(p) else spark.createDataFrame([], OVERVIEW_VECTORS)
    if embed is None or overviews is None:
        return stored
    from heronry.models import embeddings

    missing = overviews.select("doc_id", "overview").join(stored.select("doc_id"), "doc_id", "left_anti")
    return stored.unionByName(embeddings(missing, "overview", embed).select("doc_id", unit(F.col("vector")).cast("array<float>").alias("vector")))


def store_path(folder: str | None = None, default: str = "./heronry-store") -> str:
    """Where the stores lie: as given, else what HERONRY_STORE says, else the default."""
    return folder or os.environ.get("HERONRY_STORE") or default


def index_overviews(spark: SparkSession, folder: str, index_ids: list[str], most: int | None = 40) -> DataFrame:
    """(doc_id, overview) of the indexes' own files (``<index>.jsonl``), or of ``overviews.jsonl`` where none of them is there.

    A prompt takes the first ``most`` by document; None gives all.
    """
    own = [f"{folder}/{i}.jsonl" for i in index_ids]
    there = [p for p in own if _fs(spark, p)[0].exists(_fs(spark, p)[1])] or [p for p in (f"{folder}/overviews.jsonl",) if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if not there:
        return spark.createDataFrame([], "doc_id string, overview string")
    found = read_overviews(spark, there)
    return found if most is None else found.orderBy("doc_id").limit(most)
