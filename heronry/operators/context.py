"""From ranked chunks to a context: neighbours, hops, budgets, labels, whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.jsons import field, original_text
from heronry.functions.text import file_name, tokens_for_budget, uploaded_name


def context_window(chunks: DataFrame, width: int = 1, separator: str = " ") -> DataFrame:
    """Chunks with ``window_text``: the texts from ``width`` places before to ``width`` after, within the document.

    Neighbours are met by their index, so gaps stay gaps and a document with a third of all rows is not one task:
    each chunk is sent to the indexes it is a neighbour of and the join is on (document, index).  Chunks without
    document or with a negative index only see themselves.
    """
    known = chunks.where("document_id is not null and chunk_index >= 0")
    sent = known.select("document_id", F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index"), F.col("chunk_index").alias("at"), F.col("chunk_id").alias("from"), "text")
    around = sent.where("chunk_index >= 0").groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("at", "from", "text"))).alias("parts"))
    joined = chunks.join(around, ["document_id", "chunk_index"], "left")
    return joined.withColumn("window_text", F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"]), separator), "text")).drop("parts")


def merge_siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (chunk_id, document_id, chunk_index, rank) with ``merged_text`` of the chunk and its two neighbours, and ``core_text``."""
    near = hits.where("chunk_index >= 0").select(F.col("chunk_id").alias("hit"), "document_id", F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    parts = chunks.join(F.broadcast(near), ["document_id", "chunk_index"]).groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("parts"))
    text = chunks.join(F.broadcast(hits.select("chunk_id", "rank")), "chunk_id").select("chunk_id", "document_id", "chunk_index", "rank", F.col("text").alias("core_text"))
    joined = text.join(parts, text["chunk_id"] == parts["hit"], "left").drop("hit")
    return joined.withColumn("merged_text", F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"]), " \n"), "core_text")).drop("parts")


def expand_neighbours(seeds: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """(chunk_id, document_id, chunk_index, seed_rank): seeds and the chunks within ``width``; the best seed claims a chunk."""
    near = seeds.select("document_id", F.col("rank").alias("seed_rank"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - width), F.col("chunk_index") + width)).alias("chunk_index"))
    found = chunks.join(F.broadcast(near), ["document_id", "chunk_index"]).groupBy("chunk_id", "document_id", "chunk_index").agg(F.min("seed_rank").alias("seed_rank"))
    own = seeds.select("chunk_id", "document_id", "chunk_index", F.col("rank").alias("seed_rank"))
    return found.unionByName(own).groupBy("chunk_id", "document_id", "chunk_index").agg(F.min("seed_rank").alias("seed_rank"))


def hop(candidates: DataFrame, references: DataFrame, scored: DataFrame, trigger: int = 3, max_hops: int = 1, per_hop: int = 3) -> DataFrame:
    """Chunks appended to a ranking because its first ``trigger`` candidates refer to their documents.

    ``candidates``: (chunk_id, document_id, rank).  ``references``: (chunk_id, position, target_doc).  ``scored``: chunks with
    (chunk_id, document_id, score), the nearest first by small score.  Targets are taken in order of appearance,
    once, and not if the document is among the candidates; the first ``max_hops`` give ``per_hop`` chunks each.
    Result: (chunk_id, document_id, rank, via_crossref) of old and new.
    """
    heads = candidates.where(F.col("rank") <= trigger).select("chunk_id", "rank")
    targets = references.where("target_doc is not null").join(F.broadcast(heads), "chunk_id").groupBy("target_doc").agg(F.min(F.struct("rank", "position")).alias("first"))
    targets = targets.join(candidates.select(F.col("document_id").alias("target_doc")).distinct(), "target_doc", "left_anti")
    targets = targets.orderBy("first", "target_doc").limit(max_hops).withColumn("n", F.row_number().over(Window.orderBy("first", "target_doc")))
    near = scored.join(F.broadcast(targets.select(F.col("target_doc").alias("document_id"), "n")), "document_id")
    near = near.withColumn("m", F.row_number().over(Window.partitionBy("document_id").orderBy("score", "chunk_id"))).where(F.col("m") <= per_hop)
    last = F.broadcast(candidates.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("last")))
    added = near.crossJoin(last).select("chunk_id", "document_id", (F.col("last") + F.row_number().over(Window.orderBy("n", "m"))).cast("int").alias("rank"), F.lit(True).alias("via_crossref"))
    return candidates.select("chunk_id", "document_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("via_crossref")).unionByName(added)


def pack_budget(blocks: DataFrame, budget: int = 12000) -> DataFrame:
    """Ranked blocks (chunk_id, document_id, rank, text, span) that fit a token budget, in order.

    ``span`` is the array of chunk indexes a block covers.  A block is left out if an earlier kept one covers it, or
    if it would pass the budget and something is kept already; later, smaller blocks still get their chance.  The
    fold runs over the candidates of one question.
    """
    rows = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", tokens_for_budget(F.length("text")).alias("cost"), "span"))).alias("rows"))
    start = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<string>").alias("covered"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        places = F.transform(r["span"], lambda i: F.concat_ws("#", r["document_id"], i.cast("string")))
        inside = (F.size(places) > 0) & (F.size(F.array_except(places, acc["covered"])) == 0)
        over = (acc["used"] + r["cost"] > budget) & (F.size(acc["kept"]) > 0)
        took = F.struct((acc["used"] + r["cost"]).cast("int").alias("used"), F.array_union(acc["covered"], places).alias("covered"), F.concat(acc["kept"], F.array(r["chunk_id"])).alias("kept"))
        return F.when(inside | over, acc).otherwise(took)

    kept = rows.select(F.explode(F.aggregate("rows", start, step)["kept"]).alias("chunk_id"))
    return blocks.join(F.broadcast(kept), "chunk_id", "left_semi")


def labelled(blocks: DataFrame) -> DataFrame:
    """One row (context): the blocks in order of rank, each under the name of its document."""
    text = F.concat(F.lit("[Source document: "), F.coalesce("document_id", F.lit("unknown")), F.lit("]\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", text.alias("t"))))
    return blocks.groupBy().agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def document_texts(chunks: DataFrame, budget_tokens: int, most_rows: int = 2000) -> DataFrame:
    """Chunks of each document up to a budget: (document_id, chunk_index, piece, truncated).

    One row an index (the smallest chunk_id), in order of index, ``most_rows`` at most; the budget is four characters a
    token and counts two more for each joint; the chunk that crosses it is cut.  ``truncated`` says whether
    anything of the document was left out.
    """
    text = original_text(F.col("metadata"), F.col("text"))
    one = chunks.groupBy("document_id", "chunk_index").agg(F.min_by(F.struct(text.alias("t")), "chunk_id").alias("s")).select("document_id", "chunk_index", F.col("s.t").alias("text"))
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    n = one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_rows)
    before = F.coalesce(F.sum(F.length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(4 * budget_tokens) - F.col("before")
    cut = n.withColumn("before", before).withColumn("room", room)
    short = F.max(F.col("room") < F.length("text")).over(Window.partitionBy("document_id"))
    return cut.withColumn("truncated", short).where("room > 0").select("document_id", "chunk_index", F.expr("substring(text, 1, int(room))").alias("piece"), "truncated")


def document_name(document_id: Column, metadata: Column) -> Column:
    """The last part of the chunk's source, else the document id without an upload's identifier."""
    source = F.coalesce(field(metadata, "$.metadata.source"), field(metadata, "$.source"))
    return F.coalesce(F.when(source != "", file_name(source)), uploaded_name(document_id))


def escalation_block(pieces: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row (block): the texts of documents read in full, from :func:`document_texts`, each between lines that name it.

    A document that was cut says so.  Without a piece the block is empty.
    """
    joined = pieces.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "piece"))).alias("ps"), F.max("truncated").alias("cut"))
    if names is not None:
        joined = joined.join(names.select("document_id", "name"), "document_id", "left")
    name = F.coalesce("name", "document_id") if names is not None else F.col("document_id")
    text = F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n")
    one = F.concat(F.lit("=== Full document: "), name, F.when(F.col("cut"), F.lit(" (truncated)")).otherwise(F.lit("")), F.lit(" ===\n"), text, F.lit("\n=== End of document ==="))
    return joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", one.alias("t")))), lambda p: p["t"]), "\n\n").alias("block"))


def with_block(context: DataFrame, block: DataFrame) -> DataFrame:
    """One row (context) with the block behind it, divided by an empty line; an empty block changes nothing."""
    both = context.crossJoin(F.broadcast(block))
    return both.select(F.when(F.coalesce("block", F.lit("")) == "", F.col("context")).otherwise(F.concat_ws("\n\n", "context", "block")).alias("context"))


def escalation(evidence: DataFrame, candidates: DataFrame, least: float, most: int = 1) -> DataFrame:
    """(document_id) to read in full because the evidence is too thin: the documents of the first candidates."""
    thin = F.broadcast(evidence.where(F.col("evidence") < least).select(F.lit(1).alias("thin")).limit(1))
    docs = candidates.groupBy("document_id").agg(F.min("rank").alias("rank"))
    return docs.crossJoin(thin).orderBy("rank", "document_id").limit(most).select("document_id")
