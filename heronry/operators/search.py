"""Full-text, vector and hybrid search of many queries at once.

BM25: k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); tokens are runs of
letters and digits in lower case.  Ties are broken by the id, so every ranking is total.
A frame of hits has (query_id, id, score) and, once ranked, ``rank`` from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import TOKEN_BREAK
from heronry.functions.vectors import cosine, squared_distance
from heronry.session import cut_lineage

K1, B = 1.2, 0.75
#: Queries are sent to every task; beyond this many the caller has to go through blocks.
MOST_QUERIES = 10_000
#: Up to so many terms of queries are looked up inside each text.
MOST_TERMS = 1_000


def tokens(text: Column) -> Column:
    """Array of the tokens of a text; null and blank give the empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def counted(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """(term, key, tf, dl) of rows (key, dl, tokens): counts are made in every task before they are shuffled."""
    each = rows.select(key, "dl", F.explode(ts).alias("term"))
    return each.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf", "dl")


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, dl): the inverted table.  A text without tokens has no row."""
    return counted(texts.select(key, tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts")), key, "ts")


def corpus_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl) over the texts that have a token."""
    n = F.size(tokens(F.col(text)))
    return texts.select(n.alias("dl")).where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def write_index(texts: DataFrame, key: str, path: str, text: str = "text", buckets: int = 64) -> None:
    """Postings in ``buckets`` folders by term, so that a search reads only the folders of its terms."""
    posted = postings(texts, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    posted.repartition(buckets, "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    corpus_stats(texts, text).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark, path: str, terms: list[str] | None = None, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    posted, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    if terms is not None:
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("b")).distinct()
        posted = posted.where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("term").isin(terms))
    return posted.drop("bucket"), stats


def bm25_scores(texts: DataFrame, query_terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(query_id, key, score) for ``query_terms`` (query_id, term): every text with one of the terms.

    The corpus is cut into tokens once: each text leaves its length and the tokens it has of the queries' terms, and that
    small table is written and read for statistics, frequencies and scores.
    """
    terms = query_terms.select("query_id", "term").distinct()
    words = texts.select(key, tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts")).where("dl > 0")
    sought = terms.select("term").distinct()
    if sought.limit(MOST_TERMS + 1).count() > MOST_TERMS:  # too many to look each token up among them: the whole inverted table meets them
        posted = cut_lineage(postings(texts, key, text).join(sought, "term", "left_semi"))
        return bm25_of(posted, corpus_stats(texts, text), terms, key)
    wanted = F.broadcast(sought.agg(F.collect_set("term").alias("wanted")))
    met = words.crossJoin(wanted).select(key, "dl", F.filter("ts", lambda t: F.array_contains("wanted", t)).alias("ts"))
    met = cut_lineage(met)
    posted = counted(met, key, "ts")
    stats = met.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return bm25_of(posted, stats, terms, key)


def bm25_of(posted: DataFrame, stats: DataFrame, query_terms: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of postings (term, key, tf, dl) with corpus statistics (n, avgdl), as :func:`write_index` leaves them."""
    terms = query_terms.select("query_id", "term").distinct()
    tf = posted.join(terms.select("term").distinct(), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term of the queries
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = scored.withColumn("part", part).join(terms, "term").groupBy("query_id", key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # added in order of size: in the order of arrival, equal texts would differ in the last bit, and that would rank them
    return parts.select("query_id", key, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x).alias("score"))


def search_index(spark, path: str, query_terms: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """(query_id, key, score) from the stored index: only the folders of the queries' terms are read.

    The terms come to the driver to choose the folders; they are checked to be at most ``MOST_QUERIES`` times ten.
    """
    asked = [r["term"] for r in query_terms.select("term").distinct().limit(10 * MOST_QUERIES + 1).collect()]
    if len(asked) > 10 * MOST_QUERIES:
        return bm25_of(*read_index(spark, path), query_terms, key)
    return bm25_of(*read_index(spark, path, asked, buckets), query_terms, key)


def query_words(text: Column) -> Column:
    """The terms of a question: quotes do not count; no question, no term."""
    return tokens(F.regexp_replace(F.coalesce(text, F.lit("")), '"', " "))


def expanded_terms(questions: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term): the words of each question; a question of one word also stands for what it is a start or misspelling of."""
    words = questions.select("query_id", query_words(F.col(text)).alias("ts"))
    every = words.select("query_id", F.explode("ts").alias("term"))
    alone = words.where(F.size("ts") == 1).select("query_id", F.col("ts")[0].alias("w"))
    near = vocabulary.select("term").distinct().join(F.broadcast(alone), F.col("term").startswith(F.col("w")) | (F.levenshtein("term", "w") <= 1))
    return every.unionByName(near.select("query_id", "term")).distinct()


def expand_short_query(vocabulary: DataFrame, word: str) -> DataFrame:
    """(term) of a vocabulary that a one-word query stands for: it is a prefix of the term, or one edit away."""
    w = F.lit(word.replace('"', "").lower())
    return vocabulary.select("term").distinct().where(F.col("term").startswith(w) | (F.levenshtein(F.col("term"), w) <= 1))


def knn_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str = "vector", metric: str = "distance") -> DataFrame:
    """(query_id, key, score): squared distance, or cosine, of every query (query_id, query) to every vector.

    The queries are the broadcast side and their number is checked; vectors of another width than a query give no row.
    """
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries at once; at most {MOST_QUERIES} are sent to every task")
    measure = squared_distance if metric == "distance" else cosine
    pairs = vectors.select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(queries.select("query_id", "query")))
    return pairs.where(F.size("v") == F.size("query")).select("query_id", key, measure(F.col("v"), F.col("query")).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "vector", metric: str = "distance") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` nearest vectors of every query (query_id, query), ties by the key.

    A task multiplies its vectors with all queries of a block in one matrix product and keeps what can still be among
    the best; the exact measure of these few, as :func:`knn_scores` has it, decides.  Queries go in blocks of at most
    ``MOST_QUERIES``, so their number has no bound.  Vectors of another width than a query give no row for it.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    groups = max(1, -(-queries.count() // MOST_QUERIES))
    near = None
    for g in range(groups):
        block = queries.select("query_id", "query").where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        rows = [r["query"] for r in block.select("query").collect()]  # one block
        rows = [q for q in rows if q is not None and all(x is not None for x in q)]
        shared = spark.sparkContext.broadcast({n: np.array([q for q in rows if len(q) == n], "f8") for n in {len(q) for q in rows}})
        few = vectors.select(key, F.col(vector).alias("v")).mapInPandas(_hopeful(shared, key, k, metric), f"`{key}` {kind}, v array<double>")
        exact = ranked(knn_scores(few, block, key, "v", metric), key, k, descending=metric != "distance")
        near = exact if near is None else near.unionByName(exact)
    return near


def _hopeful(shared, key: str, k: int, metric: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {n: np.full((len(q), k), np.inf) for n, q in shared.value.items()}
        for pdf in batches:
            sizes = np.array([-1 if v is None else len(v) for v in pdf["v"]])
            for n, q in shared.value.items():
                at = np.flatnonzero(sizes == n)
                if not n or not len(at):
                    continue
                x = np.array([np.asarray(v, dtype="f8") for v in pdf["v"].to_numpy()[at]])
                far = -(x @ q.T)
                if metric == "distance":
                    far = 2 * far + (x * x).sum(1)[:, None] + (q * q).sum(1)
                else:
                    far /= np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1), 1e-300)
                far = np.where(np.isfinite(far), far, np.inf).T
                best[n] = np.sort(np.concatenate([best[n], far], axis=1), axis=1)[:, :k]
                room = 1e-9 * (1 + np.abs(np.where(np.isfinite(best[n][:, -1:]), best[n][:, -1:], 0)))
                keep = at[(far <= best[n][:, -1:] + room).any(0)]  # what ties with the last one stays
                if len(keep):  # of an empty list pandas makes a column of numbers, which Arrow refuses as arrays
                    yield pd.DataFrame({key: pdf[key].to_numpy()[keep], "v": [np.asarray(v, dtype="f8") for v in pdf["v"].to_numpy()[keep]]})

    return run


def ranked(hits: DataFrame, key: str, k: int | None = None, descending: bool = True, by: str = "query_id") -> DataFrame:
    """Hits with ``rank`` from 1 within each query, the best ``k`` if given."""
    order = F.desc("score") if descending else F.asc("score")
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, key)))
    return out.where(F.col("rank") <= k) if k is not None else out


def closeness(distance: Column) -> Column:
    """A distance as a score between 0 and 1, the nearer the higher; what a vector search reports."""
    return 1 / (1 + distance)


def score_by_mode(mode: str, bm25: Column, distance: Column, rrf: Column) -> Column:
    """What a search of a mode reports as its score: BM25 (0 without), the closeness of a distance, or the fused score."""
    return {"fts_only": F.coalesce(bm25, F.lit(0.0)), "vector_only": closeness(distance), "hybrid": rrf}[mode]


def top(hits: DataFrame, key: str, k: int, descending: bool = True) -> DataFrame:
    """The best ``k`` hits of one query, by a bounded sort in every task."""
    return hits.orderBy(F.desc("score") if descending else F.asc("score"), key).limit(k)


def max_sim(query_tokens: DataFrame, text_tokens: DataFrame, key: str) -> DataFrame:
    """Late interaction: for every query token the best dot product among a text's tokens, summed over the query's tokens.

    ``query_tokens``: (query_id, query_token, query); ``text_tokens``: (key, vector).
    """
    from heronry.functions.vectors import dot

    pairs = text_tokens.select(key, "vector").crossJoin(F.broadcast(query_tokens))
    best = pairs.groupBy("query_id", "query_token", key).agg(F.max(dot(F.col("vector"), F.col("query"))).alias("m"))
    return best.groupBy("query_id", key).agg(F.sum("m").alias("score"))
