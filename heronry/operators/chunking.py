"""Documents into chunks: Markdown pieces, sentence windows, element trees, numbering, spans.

Which stretch of a text goes into which chunk follows from running totals of lengths and one
search in them, so a text is never joined and measured again; it runs in Python on Arrow
batches, one text at a time.  Numbering and spans are running totals over sorted slices.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.ordered import running_total

#: Where Markdown is split, the strongest first.
MARKDOWN_BREAKS = ("\n## ", "\n### ", "\n#### ", "```", "\n\n")


def quarter_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def _room(most: int) -> int:
    """The most characters that still count as ``most`` tokens."""
    return 4 * most + 3


def runs_within(sizes: list[int], room: int, gap: int = 0, overlap: int = 0) -> list[tuple[int, int]]:
    """Consecutive runs [i, j) of things laid out with ``gap`` between them that take up to ``room``; one thing alone may take more.

    Every run is as long as it can be.  A run begins where the last one ended, or up to ``overlap`` things earlier, but
    always after the last one's beginning.  The ends of all possible runs come from one search in the running total.
    """
    if not sizes:
        return []
    edge = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype="i8") + gap)])
    first = np.arange(len(sizes))
    reach = np.maximum(np.searchsorted(edge, edge[:-1] + room + gap, side="right") - 1, first + 1)
    follows = np.maximum(reach - overlap, first + 1)
    out, i = [], 0
    while True:
        out.append((i, int(reach[i])))
        if reach[i] == len(sizes):
            return out
        i = int(follows[i])


def _cut_at(text: str, span: tuple[int, int], mark: str) -> list[tuple[int, int]]:
    """The span divided in front of every ``mark`` inside it; parts without a visible character are left out."""
    edges = [span[0], *(m.start() for m in re.compile(re.escape(mark)).finditer(text, *span)), span[1]]
    return [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()] if len(edges) > 2 else [span]


def split_markdown(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens where there is a place to cut: at headings, fences, paragraphs, at last between words.

    Only a stretch that is too long is cut, at the strongest mark first, and a mark goes with what follows it.  Then
    neighbours are put together from the front as long as they fit; a short leftover stays alone rather than overshoot.
    """
    room, spans = _room(most), [(0, len(text))]
    for mark in MARKDOWN_BREAKS:
        spans = [part for span in spans for part in (_cut_at(text, span, mark) if span[1] - span[0] > room else [span])]
    parts: list[str] = []
    for a, b in spans:
        if b - a <= room:
            parts.append(text[a:b])
            continue
        words = text[a:b].split()
        lines = [" ".join(words[i:j]) for i, j in runs_within([len(w) for w in words], room, gap=1)]
        parts += [*(line + " " for line in lines[:-1]), *lines[-1:]]
    joined = ("".join(parts[i:j]).strip() for i, j in runs_within([len(x) for x in parts], room))
    return [x for x in joined if x]


def pack_sentences(text: str, most: int, overlap: int = 1) -> list[str]:
    """Runs of sentences of at most ``most`` tokens; a run begins up to ``overlap`` sentences before the end of the last.

    A single sentence over the limit is a run of its own, and every run begins after the one before it.
    """
    said = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", text)) if s]
    return [" ".join(said[i:j]) for i, j in runs_within([len(s) for s in said], _room(most), gap=1, overlap=overlap)]


def chunk_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = 128, overlap: int = 1, outer: int = 10_000) -> DataFrame:
    """(key, chunk_index, chunk_id, text): Markdown pieces of at most ``outer`` tokens, packed into sentence runs.

    Null and blank texts give no chunk; ids are ``<key>_<index>``.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                runs = [r for piece in split_markdown(t, outer) for r in pack_sentences(piece, most, overlap)]
                out += [(k, i, f"{k}_{i}", r) for i, r in enumerate(runs)]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "chunk_id", text])

    return documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, chunk_id string, {text} string")


def chunk_elements(elements: DataFrame, most: int = 512) -> DataFrame:
    """Chunks of a document tree given as rows (document_id, position, type, level, text, page).

    Headings update the path and are not put out; tables are chunks of their own; paragraphs between two of them are put
    together while their tokens sum up to at most ``most``, and an over-long one stays whole.  Then neighbours of the same
    page and path are joined by a blank while the joined text fits.  The page is the first one known.  Items without text
    are left out.  Result: (document_id, chunk_index, chunk_id, block_type, heading_path, page, text).
    """
    schema = "document_id string, chunk_index int, chunk_id string, block_type string, heading_path array<string>, page int, text string"

    def packed(texts: list[tuple[str, int | None]], path: list[str]) -> list[tuple]:
        runs = runs_within([quarter_tokens(t) for t, _ in texts], most)
        return [("paragraph", path, next((p for _, p in texts[i:j] if p is not None), None), " ".join(t for t, _ in texts[i:j])) for i, j in runs]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        doc, path, blocks, open_ = group["document_id"].iloc[0], [], [], []
        for r in group.sort_values("position").itertuples(index=False):
            text, page = r.text if isinstance(r.text, str) and r.text.strip() else None, None if pd.isna(r.page) else int(r.page)
            if r.type in ("heading", "table"):
                blocks, open_ = blocks + packed(open_, path), []
                if r.type == "table" and text:
                    blocks.append(("table", path, page, text.strip()))
                elif r.type == "heading" and text:
                    path = [*path[: max(1, int(r.level)) - 1], text.strip()]
            elif text:
                open_.append((text.strip(), page))
        blocks += packed(open_, path)
        rows: list[tuple] = []
        for (kind, where, page), same in itertools.groupby(blocks, key=lambda b: b[:3]):
            texts = [b[3] for b in same]
            spans = runs_within([len(t) for t in texts], _room(most), gap=1) if kind == "paragraph" else [(i, i + 1) for i in range(len(texts))]
            rows += [(kind, where, page, " ".join(texts[i:j])) for i, j in spans]
        out = [(doc, i, f"{doc}_{i}", *x) for i, x in enumerate(rows)]
        return pd.DataFrame(out, columns=["document_id", "chunk_index", "chunk_id", "block_type", "heading_path", "page", "text"]).astype({"page": "Int32"})

    return elements.groupBy("document_id").applyInPandas(run, schema)


def renumbered(chunks: DataFrame, order: list) -> DataFrame:
    """Chunks with ``chunk_index`` 0, 1, ... within each document in the given order; a document of any size is shared by many tasks."""
    return running_total(chunks, "document_id", order, F.lit(1), "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))


def spans(chunks: DataFrame) -> DataFrame:
    """Chunks with ``start`` and ``end`` in the document's text, joined by one line end each."""
    out = running_total(chunks, "document_id", ["chunk_index"], F.length("text") + 1, "start")
    return out.withColumn("end", F.col("start") + F.length("text"))


def overview_texts(chunks: DataFrame, first: int = 5, most: int = 5000) -> DataFrame:
    """(document_id, overview_text): the first chunks of each document, joined and cut; what an overview is written from."""
    head = chunks.where("chunk_index >= 0").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))).where(F.col("n") <= first)
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return head.groupBy("document_id").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n"), 1, most).alias("overview_text"))


def enriched(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with a summary of their surroundings in front of the text, and the text as it was in ``original_text``."""
    joined = chunks.join(summaries.select("chunk_id", "summary"), "chunk_id", "left")
    text = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Context: "), "summary", F.lit("\n\n---\n\n"), "text")).otherwise(F.col("text"))
    return joined.withColumn("original_text", F.col("text")).withColumn("text", text).drop("summary")


def late_windows(position, most: int):
    """Which window of ``most`` tokens a token's vector is taken from: windows start every three quarters, the first that has it wins."""
    step = max(1, most * 3 // 4)
    return F.when(position < most, F.lit(0)).otherwise(F.ceil((position - most + 1) / step)).cast("int")


def pooled_spans(token_vectors: DataFrame, places: DataFrame) -> DataFrame:
    """(chunk_id, vector): the mean of the token vectors (document_id, at, vector) inside a chunk's span [start, end); NaN counts as 0.

    A chunk without a token has no row.
    """
    inside = token_vectors.join(places.select("chunk_id", "document_id", "start", "end"), "document_id").where("at >= start and at < end")
    each = inside.select("chunk_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    means = each.groupBy("chunk_id", "i").agg(F.avg(F.nanvl("x", F.lit(0.0))).alias("x"))
    return means.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
