"""Command line: index files, search, ask for a context, evaluate.

``python -m heronry.cli index PATH --store DIR``, ``search QUESTION --store DIR``, ``ask QUESTION --store DIR``,
``eval --gold FILE --store DIR``.  Exit code 2 for a filter or setting that is refused.
"""

from __future__ import annotations

import argparse
import json
import signal
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.config import PROFILES, ConfigError, EngineConfig, profile
from heronry.models import hashed_embeddings
from heronry.operators import chunking, crossref, evaluation
from heronry.operators.filters import Filter, FilterError, compile_filter
from heronry.plans import pipeline
from heronry.session import get_spark, scratch_path
from heronry.sources import documents, store

WIDTH = 256
MARKER = store.Marker("hashing-256", WIDTH)


def build(spark: SparkSession, path: str, folder: str, most: int = 128) -> DataFrame:
    """Reads files, cuts them into chunks, embeds and upserts them; gives the stored chunks."""
    files = documents.read_files(spark, path).where("markdown is not null").select("document_id", F.col("markdown").alias("text"))
    chunks = chunking.chunk_texts(files, "document_id", "text", most)
    refs = crossref.annotate(chunks).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "ref", "target_doc"))).alias("crossrefs"))
    rows = hashed_embeddings(chunks, "text", WIDTH).join(refs, "chunk_id", "left")
    meta = F.to_json(F.struct(F.struct("document_id", "chunk_index", F.col("text").alias("original_text"), "crossrefs").alias("metadata")))
    store.upsert(spark, folder, rows.withColumn("metadata", meta), MARKER)
    return store.read_chunks(spark, folder)


def _asked(questions: DataFrame) -> DataFrame:
    return hashed_embeddings(questions, "text", WIDTH).select("query_id", "text", F.col("vector").alias("query"))


def retrieve(spark: SparkSession, folder: str, questions: DataFrame, config: EngineConfig, wanted: Filter | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) for questions (query_id, text): the first stage of many questions at once."""
    store.check_marker(store.read_marker(spark, folder), MARKER.embedder, WIDTH)
    return pipeline.first_stage(store.read_chunks(spark, folder), _asked(questions), config, wanted)


def references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, position, target_doc) that indexing left in the chunks' metadata."""
    kept = F.from_json(F.get_json_object("metadata", "$.metadata.crossrefs"), "array<struct<position:int,target_doc:string>>")
    return chunks.select("chunk_id", F.explode(kept).alias("r")).select("chunk_id", "r.position", "r.target_doc")


def run(spark: SparkSession, folder: str, question: str, config: EngineConfig, wanted: Filter | None = None) -> pipeline.Retrieved:
    """One question through every step its profile has; the overviews are the documents' first chunks, as no model writes them here."""
    store.check_marker(store.read_marker(spark, folder), MARKER.embedder, WIDTH)
    chunks = store.read_chunks(spark, folder)
    q = _asked(spark.createDataFrame([("q", question)], "query_id string, text string"))
    overviews = None
    if config.overview_prefilter != "off":
        texts = chunking.overview_texts(chunks).withColumnRenamed("overview_text", "text")
        overviews = hashed_embeddings(texts, "text", WIDTH).select("document_id", "vector")
    return pipeline.answer(chunks, q, config, wanted, references=references(chunks) if config.crossref_hop else None, overviews=overviews)


def ask(spark: SparkSession, folder: str, question: str, config: EngineConfig, wanted: Filter | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, context) of one question, by every step of the profile."""
    return pipeline.full_context(store.read_chunks(spark, folder), run(spark, folder, question, config, wanted), config)


def evaluate(spark: SparkSession, folder: str, gold_paths: list[str], config: EngineConfig) -> DataFrame:
    """One row a gold item: recall and nDCG of what is retrieved for its query."""
    gold = documents.read_gold(spark, gold_paths)
    hits = retrieve(spark, folder, gold.select(F.col("id").alias("query_id"), F.col("query").alias("text")), config)
    texts = store.read_chunks(spark, folder).select("chunk_id", "text")
    results = hits.join(texts, "chunk_id").select(F.col("query_id").alias("id"), "rank", "text")
    rel = results.join(F.broadcast(gold.select("id", "expected")), "id").withColumn("rel", evaluation.relevance(F.col("text"), F.col("expected")))
    return evaluation.recall_at(results, gold).join(evaluation.ndcg_at(rel), "id", "left")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heronry")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "ask", "eval"):
        p = sub.add_parser(name)
        p.add_argument("--store", default=None)
        p.add_argument("--mode", choices=sorted(PROFILES), default="default")
        p.add_argument("--filters", default=None)
        p.add_argument("--set", default=None, help="a JSON object of settings that change the mode")
        if name == "eval":
            p.add_argument("--gold", nargs="+", required=True)
            p.add_argument("--out", help="also write the result file")
        else:
            p.add_argument("what")
        if name == "ask":
            p.add_argument("--path", help="build a passing index of these files, answer, and remove it")
            p.add_argument("--keep", action="store_true")
    args = parser.parse_args(argv)
    try:
        wanted = compile_filter(json.loads(args.filters)) if args.filters else None
        config = profile(args.mode, json.loads(args.set) if args.set else {})
    except (FilterError, ConfigError, json.JSONDecodeError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = get_spark("heronry")
    passing = args.command == "ask" and args.path is not None
    folder = args.store or (scratch_path(spark, "passing-index") if passing else None)
    if passing and args.store is None:  # the passing index goes away also when the process is told to end
        signal.signal(signal.SIGTERM, lambda *_: sys.exit(143))
    if folder is None:
        print("--store is needed", file=sys.stderr)
        return 2
    try:
        if args.command == "index":
            print(json.dumps(build(spark, args.what, folder).groupBy().agg(F.countDistinct("document_id").alias("files"), F.count(F.lit(1)).alias("chunks")).first().asDict()))
        elif args.command == "search":
            final = run(spark, folder, args.what, config, wanted).final.select("chunk_id", "rank", "via_crossref")
            hits = store.read_chunks(spark, folder).join(F.broadcast(final), "chunk_id").orderBy("rank")
            for r in hits.select("rank", "document_id", "chunk_index", "text", "via_crossref").collect():  # at most retrieval_k rows and a hop
                print(json.dumps(r.asDict(), ensure_ascii=False))
        elif args.command == "ask":
            if passing:
                build(spark, args.path, folder)
            row = ask(spark, folder, args.what, config, wanted)[1].first()
            print(row["context"] if row else "")
        else:
            metrics = evaluate(spark, folder, args.gold, config).orderBy("id")
            rows = [r.asDict() for r in metrics.toLocalIterator()]  # one a gold item
            if args.out:
                Path(args.out).write_text(evaluation.results_json({"mode": args.mode, "config": config.as_dict()}, metrics), encoding="utf-8")
            print(evaluation.text_table(rows, metrics.columns))
    finally:
        if passing and not args.keep and args.store is None:
            store.drop_store(spark, folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
