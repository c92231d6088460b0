"""Evaluation items that stand in training documents, wholly or in part and also reworded.

Latent semantic retrieval.  The items' queries, answers and overlapping stretches of
their passages are TF-IDF rows over the items' own vocabulary, weighted by document
frequencies counted over the whole corpus.  A randomised SVD of that matrix, summed up
from partial products of its partitions, gives a latent space.  Every document is cut
into overlapping windows; windows that carry enough of the vocabulary's weight, and hold
three of the words that a text cannot be there without (of its rarest words, three more
than may be changed), are projected and compared with all rows by cosine.  Candidates are
aligned with the item's words: the longest common subsequence must reach seven words in
eight, and then an alignment with free ends must not need more than one edit in eight
words.  Queries and answers too short for an edit are runs of words that stand there or not;
they are met by their rarest word.

The items are a fixed, small table; they are broadcast after a check of their size.
The corpus is mapped over twice and never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import parallelism

RUN, ONE_IN = 15, 8
#: So many of the rarest words of a text are left in every copy.
LEFT = 3
#: What counts as a small table of items; the projection on the driver has a row for each of its distinct words.
MAX_ITEM_WORDS, MAX_VOCABULARY = 2_000_000, 200_000
_BREAKING = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|blockquote|section|article|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f]")
_ESCAPE = re.compile(r"\\[nrt](?=\W|[A-Z]|\\)|\\(?=[\"'/])")
_QUOTE = re.compile(r"[\"“”„«»‘’'`]")


def words(text: str | None) -> list[str]:
    """Words in lower case without markup, entities, invisible characters and punctuation."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub("", _BREAKING.sub(" ", t))
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _HIDDEN.sub("", t))
    elif not t.isprintable():
        t = _HIDDEN.sub("", t)
    if "\\" in t:
        t = _ESCAPE.sub(" ", t)
    return _WORD.findall(_QUOTE.sub("", t.lower()) if "’" in t or "'" in t else t.lower())


def edits(pattern: list, text: list) -> int:
    """Fewest changed, dropped or added words that make ``pattern`` a stretch of ``text``."""
    n = len(pattern)
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for y in text:  # bit-vector columns of the edit table; the first row is zero, so a match may begin anywhere
        eq = where.get(y, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus, h_minus = minus | (full & ~(d | plus)), plus & d
        score += bool(h_plus & top) - bool(h_minus & top)
        h_plus, h_minus = (h_plus << 1) & full, (h_minus << 1) & full
        plus, minus = h_minus | (full & ~(d | h_plus)), h_plus & d
        best = min(best, score)
    return best


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        x = row | where.get(y, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def holds(pattern: list, text: list) -> bool:
    """``text`` holds all of ``pattern`` but for one changed, dropped or added word in eight."""
    slack = len(pattern) // ONE_IN
    return len(text) >= len(pattern) - slack and common(pattern, text) >= len(pattern) - slack and edits(pattern, text) <= slack


@lru_cache(maxsize=1024)
def _stretches(n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, words that may be missing) of the stretches of ``n`` words that have to be looked at, the shortest first."""
    sizes = [least, *range(ONE_IN * (least // ONE_IN + 1), n + 1, ONE_IN)]
    starts = [np.arange(max(0, n - size + 1)) for size in sizes]
    size = np.repeat(sizes, [len(x) for x in starts])
    first = np.concatenate(starts)
    return first, first + size, size // ONE_IN


def holds_run(passage: list, text: list, around: tuple[int, int], least: int = RUN) -> bool:
    """``text`` holds ``least`` or more consecutive words of the part of ``passage`` near ``around``, under the same slack."""
    if len(passage) < least:
        return False
    a, b = max(0, around[0] - 2 * least), min(len(passage), around[1] + 2 * least)
    part = passage[a:b]
    known = set(text)
    missing = np.cumsum([0, *(w not in known for w in part)])
    first, end, may = _stretches(len(part), least)
    hopeful = np.flatnonzero(missing[end] - missing[first] <= may)
    if not len(hopeful) or common(part, text) < least - least // ONE_IN:
        return False
    for i, j in zip(first[hopeful].tolist(), end[hopeful].tolist()):
        piece = part[i:j]
        if holds(piece, text):
            n = edits(piece, text)  # an edit at either end would only stretch a shorter run
            if n == 0 or (edits(piece[1:], text) == n and edits(piece[:-1], text) == n):
                return True
    return False


@dataclass
class Items:
    """The items' texts as numbers, and the segments that are searched for."""

    ids: list[str]
    texts: list[dict[str, list[int]]]
    vocabulary: dict[str, int]
    segments: list[tuple[int, str, int, int]]  # item, kind, first and last word; long enough for an edit
    short: list[tuple[int, str]]  # item, kind of the texts that are not

    @property
    def lengths(self) -> list[int]:
        """Window lengths: the segments' lengths, rounded up to eights."""
        return sorted({-(-(b - a) // 8) * 8 for _, _, a, b in self.segments})


def load_items(gold: DataFrame, max_words: int = MAX_ITEM_WORDS) -> Items:
    """Items of the gold table; texts without a word and passages under RUN words are not searched for."""
    size = gold.agg(F.sum(F.length(F.concat_ws(" ", "query", "answer", "passage")))).first()[0] or 0
    if size > 8 * max_words:
        raise ValueError(f"the items have over {max_words} words; they no longer count as a small table")
    rows = gold.where("id is not null").select("id", "query", "answer", "passage").distinct().orderBy("id").collect()
    vocabulary: dict[str, int] = {}
    number = lambda text: [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
    ids, texts, segments, short = [], [], [], []
    for r in rows:
        ids.append(r["id"])
        texts.append({k: number(r[k]) for k in ("query", "answer", "passage")})
        for kind in ("query", "answer"):
            if len(texts[-1][kind]) >= ONE_IN:
                segments.append((len(ids) - 1, kind, 0, len(texts[-1][kind])))
            elif texts[-1][kind]:
                short.append((len(ids) - 1, kind))
        n = len(texts[-1]["passage"])
        if n >= RUN:
            starts = sorted({*range(0, n - RUN + 1, 5), n - RUN})
            segments += [(len(ids) - 1, "passage", a, a + RUN) for a in starts]
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"the items have over {MAX_VOCABULARY} distinct words; they no longer count as a small table")
    return Items(ids, texts, vocabulary, segments, short)


def document_frequencies(documents: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the items stands, over the whole corpus; and the number of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, seen = shared.value, 0, Counter()
        for pdf in batches:
            for t in pdf["text"]:
                n += 1
                seen.update(known.keys() & set(words(t)))
        yield pd.DataFrame({"word": [known[w] for w in seen] + [-1], "n": [*seen.values(), n]})

    counts = documents.where("text is not null").select("text").mapInPandas(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df, total = np.zeros(len(vocabulary)), 0
    for r in counts.collect():  # one row a word of the items
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    return df, total


def randomised_svd(spark, rows: list[tuple[np.ndarray, np.ndarray]], width: int, rank: int, powers: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors (width x rank) of a sparse matrix given as (columns, values) per row.

    The rows are spread over the cluster; each round sums A'(A Q) over the partitions and
    orthogonalises the width x rank sum.
    """
    if not rows or not width:
        return np.zeros((width, 0))
    table = spark.createDataFrame([(c.tolist(), v.tolist()) for c, v in rows], "columns array<int>, vals array<double>").repartition(min(parallelism(spark), max(1, len(rows) // 500)))
    rank, part = min(rank, width, len(rows)), 4096
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank)))[0]

    def product(q: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros_like(q)
            for pdf in batches:
                for c, v in zip(pdf["columns"], pdf["vals"]):
                    c, v = np.asarray(c), np.asarray(v)
                    np.add.at(out, c, np.outer(v, v @ q[c]))
            yield pd.DataFrame({"part": range(0, width, part), "block": [out[a : a + part].tobytes() for a in range(0, width, part)]})

        return run

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "block": [sum(np.frombuffer(x) for x in pdf["block"]).tobytes()]})

    for _ in range(powers + 1):
        blocks = table.mapInPandas(product(q), "part int, block binary").groupBy("part").applyInPandas(summed, "part int, block binary")
        total = np.zeros_like(q)  # as large as the projection, which the driver holds anyway
        for r in blocks.collect():
            total[r["part"] : r["part"] + part] = np.frombuffer(r["block"]).reshape(-1, rank)
        q, scale, _ = np.linalg.svd(total, full_matrices=False)
    return q[:, scale > 1e-9 * max(scale.max(), 1e-300)]


@dataclass
class Space:
    """The latent space: idf per word of the items, its projection, and the segments in it."""

    idf: np.ndarray
    project: np.ndarray
    segments: np.ndarray
    least_weight: float
    keys: np.ndarray  # for each word, whether it is one of those that key_words marks
    starts: dict[int, list[tuple[int, str, int]]]  # rarest word of a short text -> item, kind, place in it


def key_words(items: Items, df: np.ndarray) -> np.ndarray:
    """Marks, in every text and every RUN words of a passage, the rarest words, LEFT more than may be changed: LEFT of them stand in each copy."""
    keys = np.zeros(len(items.vocabulary), dtype=bool)

    def mark(part: np.ndarray) -> None:
        keys[part[np.lexsort((part, df[part]))[: len(part) // ONE_IN + LEFT]]] = True

    for item, kind, _, _ in items.segments:
        w = np.array(items.texts[item][kind])
        if kind != "passage":
            mark(w)
    for item in {i for i, kind, _, _ in items.segments if kind == "passage"}:
        w = np.array(items.texts[item]["passage"])
        for a in range(len(w) - RUN + 1):
            mark(w[a : a + RUN])
    return keys


def latent_space(spark, items: Items, df: np.ndarray, total: int, rank: int = 128) -> Space:
    idf = np.log((1 + total) / (1 + df))
    rows, weights = [], []
    for item, kind, a, b in items.segments:
        c, n = np.unique(items.texts[item][kind][a:b], return_counts=True)
        v = n * idf[c]
        weights.append(v.sum())
        rows.append((c, v / (np.linalg.norm(v) or 1.0)))
    basis = randomised_svd(spark, rows, len(items.vocabulary), rank)
    project = (idf[:, None] * basis).astype("f4")
    s = np.array([project[c].T @ (v / np.maximum(idf[c], 1e-12)) for c, v in rows], dtype="f4").reshape(len(rows), project.shape[1])
    s /= np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    starts: dict[int, list[tuple[int, str, int]]] = {}
    for item, kind in items.short:
        w = items.texts[item][kind]
        at = min(range(len(w)), key=lambda i: (df[w[i]], i))
        starts.setdefault(w[at], []).append((item, kind, at))
    return Space(idf, project, s, 0.5 * min(weights, default=0.0), key_words(items, df), starts)


def candidates(numbers: np.ndarray, ends: np.ndarray, items: Items, space: Space, least: float, block: int = 2048) -> dict[int, dict[tuple[int, str], list[tuple[int, int, int, int]]]]:
    """Document -> (item, kind) -> (window start, end, segment start, end) of windows that are close in the latent space.

    ``numbers`` are the words of many documents, one after the other, -1 for a word no item has; ``ends`` is where each ends.
    """
    found: dict[int, dict[tuple[int, str], list[tuple[int, int, int, int]]]] = {}
    if not len(items.segments) or not len(numbers):
        return found
    begins = np.concatenate([[0], ends[:-1]])
    known = numbers >= 0
    mass = np.concatenate([[0.0], np.cumsum(np.where(known, space.idf[numbers], 0.0))])
    keys = np.concatenate([[0], np.cumsum(known & space.keys[numbers])])
    hopeful = np.flatnonzero(keys[ends] - keys[begins] >= LEFT)
    for length in items.lengths:
        count = np.maximum(1, -(-(ends[hopeful] - begins[hopeful] - length + 4) // 4))
        owner = np.repeat(hopeful, count)
        lo = begins[owner] + 4 * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        hi = np.minimum(lo + length, ends[owner])
        wide = keys[np.minimum(hi + 4, ends[owner])] - keys[np.maximum(lo - 4, begins[owner])]  # a copy may stand out by some words
        good = (wide >= LEFT) & (mass[hi] - mass[lo] >= space.least_weight)
        lo, hi, owner = lo[good], hi[good], owner[good]
        for at in range(0, len(lo), block):
            a, b = lo[at : at + block], hi[at : at + block]
            place = a[:, None] + np.arange(length)
            inside = place < b[:, None]
            w = numbers[np.where(inside, place, 0)]
            x = np.where((inside & (w >= 0))[:, :, None], space.project[w], 0).sum(1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for i, j in zip(*np.nonzero(x @ space.segments.T >= least)):
                item, kind, c, d = items.segments[j]
                k = int(owner[at + i])
                found.setdefault(k, {}).setdefault((item, kind), []).append((int(a[i] - begins[k]), int(b[i] - begins[k]), c, d))
    return found


def confirmed(numbers: np.ndarray, places: dict[tuple[int, str], list[tuple[int, int, int, int]]], items: Items, space: Space) -> set[str]:
    """Ids of the items that one document holds: short texts as runs of words, others where candidates align."""
    out: set[str] = set()
    if space.starts:
        for i in np.flatnonzero(np.isin(numbers, list(space.starts))):
            for item, kind, at in space.starts[int(numbers[i])]:
                w = items.texts[item][kind]
                if i >= at and numbers[i - at : i - at + len(w)].tolist() == w:
                    out.add(items.ids[item])
    for (item, kind), windows in places.items():
        if items.ids[item] in out:
            continue
        target = items.texts[item][kind]
        reach = len(target) + 8 if kind != "passage" else 40
        spans: list[list[int]] = []
        for lo, hi, a, b in sorted(windows):
            lo, hi = max(0, lo - reach), min(len(numbers), hi + reach)
            if spans and lo <= spans[-1][1]:
                spans[-1] = [spans[-1][0], max(hi, spans[-1][1]), min(a, spans[-1][2]), max(b, spans[-1][3])]
            else:
                spans.append([lo, hi, a, b])
        for lo, hi, a, b in spans:
            part = numbers[lo:hi].tolist()
            if holds_run(target, part, (a, b)) if kind == "passage" else holds(target, part):
                out.add(items.ids[item])
                break
    return out


def leaked_items(texts: list[str | None], items: Items, space: Space, least: float) -> list[list[str]]:
    """For each text the ids of the items it holds."""
    known = items.vocabulary
    each = [np.array([known.get(w, -1) for w in words(t)], dtype="i4") for t in texts]
    numbers = np.concatenate(each) if each else np.empty(0, "i4")
    places = candidates(numbers, np.cumsum([len(x) for x in each]), items, space, least)
    return [sorted(confirmed(x, places.get(i, {}), items, space)) if i in places or space.starts else [] for i, x in enumerate(each)]


def leaks(documents: DataFrame, gold: DataFrame, rank: int = 128, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id): every document that holds an item's query, its answer, or 15 consecutive words of its passage.

    Case, punctuation, markup, line breaks and invisible characters do not count, nor does one changed,
    dropped or misspelt word in eight.  Null and blank texts hold nothing; documents with the same text
    are reported each; an empty gold table gives no rows.
    """
    spark = documents.sparkSession
    items = load_items(gold)
    df, total = document_frequencies(documents, items.vocabulary)
    space = latent_space(spark, items, df, total, rank)
    shared = spark.sparkContext.broadcast((items, space))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, space = shared.value
        for pdf in batches:
            found = leaked_items(pdf["text"].tolist(), items, space, least)
            out = [(d, i) for d, held in zip(pdf["doc_id"], found) for i in held]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, item_id string").distinct()
