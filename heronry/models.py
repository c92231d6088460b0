"""Where models plug in, and deterministic stand-ins for them.

No model files are part of this engine.  An embedder is a function from texts to a
matrix, a reranker one from (query, text) pairs to scores; both run on Arrow batches.
The stand-ins hash words and compare words: they make every operator run, and claim no quality.
"""

from __future__ import annotations

import warnings
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions.text import TOKEN_BREAK

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]


def hashing_embedder(width: int) -> Embedder:
    """Words and word pairs hashed with a sign into ``width`` places, damped counts, unit length; blank texts give the first axis."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            ws = [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
            for term in (*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))):
                h = zlib.crc32(term.encode("utf-8", "surrogatepass"))
                out[i, h % width] += 1 if h >> 16 & 1 else -1
        out = np.sign(out) * np.sqrt(np.abs(out))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out[n[:, 0] == 0, 0] = 1
        return out / np.where(n == 0, 1, n)

    return embed


def remembering(embed: Embedder, most: int = 256) -> Embedder:
    """The same vectors, with the last ``most`` texts' remembered in each worker; only new texts go to the model."""
    kept: OrderedDict[str, np.ndarray] = OrderedDict()

    def run(texts: list[str]) -> np.ndarray:
        known = {t: kept[t] for t in texts if t in kept}
        new = [t for t in dict.fromkeys(texts) if t not in known]
        if new:
            known.update(zip(new, embed(new)))
        for t in texts:
            kept[t] = known[t]
            kept.move_to_end(t)
        while len(kept) > most:
            kept.popitem(last=False)
        return np.array([known[t] for t in texts])

    return run


def embeddings(rows: DataFrame, text: str, embed: Embedder) -> DataFrame:
    """``rows`` with ``vector``; the texts of a batch go to the model together, and rows keep their own vectors."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields if f.name != 'vector')}, vector array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embed([t if isinstance(t, str) else "" for t in pdf[text]])
            yield pdf.assign(vector=list(vectors.astype("f4")))

    return rows.drop("vector").mapInPandas(run, schema)


def hashed_embeddings(rows: DataFrame, text: str, width: int) -> DataFrame:
    return embeddings(rows, text, hashing_embedder(width))


def score_text(rows: DataFrame) -> DataFrame:
    """``rows`` with ``score_text``: the matched chunk's own text where a block was merged around it, else the text."""
    return rows.withColumn("score_text", F.coalesce("core_text", "text") if "core_text" in rows.columns else F.col("text"))


def scored(pairs: DataFrame, query: str, text: str, score: Scorer | None = None) -> DataFrame:
    """``pairs`` with ``score``; without a scorer it is the share of the query's words that the text has."""
    if score is None:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), TOKEN_BREAK), lambda w: w != ""))
        n = F.size(words(query))
        return pairs.withColumn("score", F.when(n > 0, F.size(F.array_intersect(words(query), words(text))) / n).otherwise(F.lit(0.0)))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pairs.schema.fields if f.name != 'score')}, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=np.asarray(score(pdf[query].fillna("").tolist(), pdf[text].fillna("").tolist()), dtype="f8"))

    return pairs.drop("score").mapInPandas(run, schema)


def pruned(texts: DataFrame, key: str, query: str, text: str, least: float = 0.1, score: Scorer | None = None) -> DataFrame:
    """Texts with only the sentences that score at least ``least`` for the query; rows left without a sentence are dropped."""
    from heronry.functions.text import sentences

    each = texts.select(key, query, F.posexplode(sentences(F.col(text))).alias("n", "sentence"))
    kept = scored(each, query, "sentence", score).where(F.col("score") >= least)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda s: s["sentence"]), " ").alias(text))


def yes_probability(yes, no):
    """P(yes) of two logits, as a Column."""
    return 1 / (1 + F.exp(no - yes))


def yes_no_scorer(logits: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]) -> Scorer:
    """A scorer from a model that gives the logits of "yes" and "no" for each (query, text)."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        yes, no = (np.asarray(x, dtype="f8") for x in logits(queries, texts))
        return 1 / (1 + np.exp(np.clip(no - yes, -60, 60)))

    return score


def max_sim_scorer(embed_tokens: Callable[[str], np.ndarray]) -> Scorer:
    """Late interaction as a scorer: the mean over the query's tokens of the best dot product among the text's; 0 without tokens."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        kept = {t: embed_tokens(t) for t in {*queries, *texts}}
        return np.array([float((kept[q] @ kept[t].T).max(1).mean()) if len(kept[q]) and len(kept[t]) else 0.0 for q, t in zip(queries, texts)])

    return score


#: Kinds of rerankers, each with what makes a scorer of a model's name; others are registered by the caller.
SCORERS: dict[str, Callable[[str], Scorer]] = {}


def register_scorer(kind: str, make: Callable[[str], Scorer]) -> None:
    SCORERS[kind] = make


def scorer_for(name: str, kind: str | None = None) -> Scorer | None:
    """The scorer of a reranker: by its kind, else by a kind its name holds, else the kind "cross-encoder".

    None where there is no such kind or it cannot be loaded: the ranking then stays as it is.
    """
    found = kind if kind in SCORERS else next((k for k in sorted(SCORERS, key=len, reverse=True) if k in name.lower()), "cross-encoder")
    try:
        return SCORERS[found](name) if found in SCORERS else None
    except Exception as e:  # a model that does not load is no reason to fail a question
        warnings.warn(f"no rerank: {name} cannot be loaded ({e})", stacklevel=2)
        return None


def ranked_texts(query: str, texts: list[str], score: Scorer, early_exit: bool = False, spread: float = 0.4, at_a_time: int = 8) -> list[tuple[float, int]]:
    """(score, place) of texts, the best first; ties by place.

    With ``early_exit`` texts are scored so many at a time, and no more once the scores, squashed to (0, 1), lie ``spread``
    apart: texts that come later have no row then.
    """
    out: list[float] = []
    for a in range(0, len(texts), at_a_time):
        part = texts[a : a + at_a_time]
        out += np.asarray(score([query] * len(part), part), dtype="f8").tolist()
        squashed = 1 / (1 + np.exp(-np.clip(out, -60, 60)))
        if early_exit and squashed.max() - squashed.min() >= spread:
            break
    return sorted(((s, i) for i, s in enumerate(out)), key=lambda p: (-p[0], p[1]))


def last_token(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last real token, whichever side the padding (mask 0) is on; zeros for a row without one."""
    mask = np.asarray(mask, dtype=bool)
    last = np.where(mask.any(1), mask.shape[1] - 1 - mask[:, ::-1].argmax(1), 0)
    return np.where(mask.any(1)[:, None], np.asarray(states)[np.arange(len(mask)), last], 0)
