"""Oversized texts cut into pieces at natural boundaries, by recursive bisection.

A span that is too long is cut at the strongest boundary near its midpoint
(paragraph, then sentence or line end, then word end, then anywhere), and both
halves are treated the same way until each fits the limit less the overlap.  Then
every piece but the first gets the tail of the one before it in front.

Everything happens within one text, so the work is a map over the oversized rows:
no shuffle apart from counting repeated rows once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP_LEAST, OVERLAP_MOST = 1200, 80, 200
_SPACE = " \t\r\n"
_PARAGRAPH = re.compile(r"(?:[ \t]*(?:\r\n|\r|\n)){2,}[ \t]*")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+|[ \t]*(?:\r\n|\r|\n)[ \t\r\n]*")
_WORD = re.compile(r"[ \t\r\n]+")
LEVELS = (("paragraph", _PARAGRAPH), ("sentence", _SENTENCE), ("word", _WORD))


def cut_class(text: str, limit: int = LIMIT) -> str:
    """The strongest boundary at which bisection alone brings every stretch within ``limit`` once trimmed; else ``none``."""
    body = text.strip(_SPACE)
    for (name, _), places in zip(LEVELS, boundaries(body)):
        if bisects(body, places, limit):
            return name
    return "none"


def bisects(text: str, places: list[int], limit: int) -> bool:
    """Whether cutting at ``places`` near the middle, and each half again, leaves no span over ``limit`` once trimmed."""
    stack = [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= limit or len(text[a:b].strip(_SPACE)) <= limit:
            continue
        i = bisect_left(places, (a + b) // 2)
        near = [p for p in places[max(0, i - 1) : i + 1] if a < p < b]
        if not near:
            return False
        cut = min(near, key=lambda p: abs(2 * p - a - b))
        stack += [(a, cut), (cut, b)]
    return True


def boundaries(text: str) -> list[list[int]]:
    """Positions after each boundary, strongest kind first; every kind includes the stronger ones' places."""
    return [[m.end() for m in pattern.finditer(text)] for _, pattern in LEVELS]


def bisect_spans(text: str, most: int, least: int = 1) -> list[tuple[int, int]]:
    """Spans that cover ``text`` in order, each of at most ``most`` and, if cut, at least ``least`` characters.

    A cut is looked for in the middle half of a span first, strongest kind first; only
    if no kind has one there does any place in the span count.  No place at all (one long
    word) means the midpoint.
    """
    places = boundaries(text)
    out, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a <= most:
            out.append((a, b))
            continue
        mid, cut = (a + b) // 2, None
        for reach in ((b - a) // 4, (b - a) // 2):
            for kind in places:
                i = bisect_left(kind, mid)
                near = [p for p in kind[max(0, i - 1) : i + 1] if a + least <= p <= b - least and abs(p - mid) <= reach]
                if near:
                    cut = min(near, key=lambda p: (abs(p - mid), p))
                    break
            if cut:
                break
        cut = cut or mid
        stack += [(cut, b), (a, cut)]
    return out


def overlap_start(text: str, start: int, floor: int, least: int, most: int) -> int:
    """Where the repeated tail before ``start`` begins: the first sentence or word start within the bounds, else the shortest.

    ``floor`` is the start of the piece before: no more than that piece can be repeated.
    """
    low, high = max(floor, start - most), max(floor, start - least)
    for pattern in (_SENTENCE, _WORD):
        for m in pattern.finditer(text, low, high):
            if low < m.end() <= high:
                return m.end()
    return high


def split_text(text: str, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST) -> list[tuple[int, int, str]]:
    """(start of new text, overlap in characters, piece) in order; the pieces' new parts are ``text`` exactly."""
    if len(text) <= limit:
        return [(0, 0, text)]
    out: list[tuple[int, int, str]] = []
    before = 0
    for a, b in bisect_spans(text, limit - most, max(1, least)):
        start = overlap_start(text, a, before, least, most) if out else a
        out.append((a, a - start, text[start:b]))
        before = start
    return out


_PIECES = "document_id string, chunk_index int, chunk_id string, piece int, start int, overlap int, text string, cut string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST) -> DataFrame:
    """Pieces of every chunk whose ``text`` is longer than ``limit`` characters, numbered from 1.

    ``cut`` says which kind of boundary suffices for the whole text.  Null, empty and short texts
    give no piece; a null chunk or document id stays null; repeated rows count once.  The order is
    (document_id, chunk_index, chunk_id, piece); it is in the columns, not in the files.
    """
    if not 0 <= least <= most or limit <= 2 * most:
        raise ValueError("need 0 <= least <= most and a limit of more than twice the overlap")
    rows = chunks.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_id", "text")
    rows = rows.where(F.length("text") > limit).withColumn("h", F.xxhash64("text")).dropDuplicates(["document_id", "chunk_index", "chunk_id", "h"]).drop("h")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, i, c, t in zip(pdf["document_id"], pdf["chunk_index"], pdf["chunk_id"], pdf["text"]):
                kind, i = cut_class(t, limit), None if pd.isna(i) else int(i)
                out += [(d, i, c, n, a, o, p, kind) for n, (a, o, p) in enumerate(split_text(t, limit, least, most), 1)]
            frame = pd.DataFrame(out, columns=["document_id", "chunk_index", "chunk_id", "piece", "start", "overlap", "text", "cut"])
            yield frame.astype({"chunk_index": "Int32"})

    return rows.mapInPandas(cut, _PIECES)
