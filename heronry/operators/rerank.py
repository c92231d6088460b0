"""Rerank scores: aggregation over sub-queries, selection with floor and rescue, evidence, prefilters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregated(scores: DataFrame, key: str, how: str = "mean") -> DataFrame:
    """(key, score, best): scores of a candidate against its sub-queries by mean or max, and their maximum; nulls are skipped."""
    agg = F.avg("score") if how == "mean" else F.max("score")
    return scores.groupBy(key).agg(agg.alias("score"), F.max("score").alias("best"))


def keep_share(ranked: DataFrame, share: float, key: str) -> DataFrame:
    """The best part of a ranking with ``rank``: max(1, floor(n * share)) rows."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    return ranked.crossJoin(F.broadcast(n)).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("n")


def select_by_threshold(scores: DataFrame, key: str, least: float, min_keep: int = 3, top_k: int | None = None, how: str = "mean", rescue: bool = False) -> DataFrame:
    """(key, score, best, rank) of the candidates that stay.

    ``scores`` has (key, sub_query, score).  A candidate stays if its best score reaches ``least``.  With ``rescue``
    the sub-queries are visited in order: one that has no kept candidate gets its best one, which may then also serve
    later sub-queries.  If fewer than ``min_keep`` are left, the first ones of the ranking fill up.  The result
    is ranked by the aggregate, ties by the key, and cut at ``top_k``.

    The rescue is a fold over the sub-queries, of which a question has a handful; candidates are aggregated before it.
    """
    ranking = aggregated(scores, key, how).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    kept = ranking.withColumn("stays", F.col("best") >= least)
    if rescue:
        w = Window.partitionBy("sub_query").orderBy(F.desc("score"), key)
        first = scores.withColumn("n", F.row_number().over(w)).where("n = 1").select("sub_query", F.col(key).alias("first"))
        have = scores.join(kept.select(key, "stays"), key).groupBy("sub_query").agg(F.max("stays").alias("has"), F.collect_set(key).alias("members"))
        plan = first.join(have, "sub_query").groupBy().agg(F.array_sort(F.collect_list(F.struct("sub_query", "first", "has", "members"))).alias("steps"))
        kind = dict(scores.dtypes)[key]
        fold = F.aggregate(
            "steps",
            F.array().cast(f"array<{kind}>"),
            lambda acc, s: F.when(s["has"] | (F.size(F.array_intersect(acc, s["members"])) > 0), acc).otherwise(F.concat(acc, F.array(s["first"]))),
        )
        rescued = plan.select(F.explode(fold).alias(key)).distinct().withColumn("rescued", F.lit(True))
        kept = kept.join(F.broadcast(rescued), key, "left").withColumn("stays", F.col("stays") | F.coalesce("rescued", F.lit(False))).drop("rescued")
    n = kept.agg(F.sum(F.col("stays").cast("int")).alias("n"))
    kept = kept.crossJoin(F.broadcast(n)).where(F.col("stays") | ((F.col("n") < min_keep) & (F.col("rank") <= min_keep)))
    out = kept.select(key, "score", "best", F.row_number().over(Window.orderBy("rank")).cast("int").alias("rank"))
    return out.where(F.col("rank") <= top_k) if top_k is not None else out


def contrast(similarities: Column) -> Column:
    """How far the best of an array of cosines stands out: (top - background) / (1 - background), within 0 and 1.

    The background is the mean from the sixth on, or from the second if there are five or fewer; null under two
    values or if it is 1.
    """
    s = F.sort_array(similarities, asc=False)
    rest = F.when(F.size(s) > 5, F.slice(s, 6, 2**30)).otherwise(F.slice(s, 2, 2**30))
    background = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s[0] - background) / (1 - background)))
    return F.when((F.size(s) >= 2) & (1 - background > 1e-6), value)


def rerank_evidence(scores: DataFrame) -> DataFrame:
    """One row (evidence): the best rerank score if it is a probability, else null."""
    return scores.agg(F.max("score").alias("m")).select(F.when(F.col("m").between(0, 1), F.col("m")).alias("evidence"))


def needs_retry(evidence: Column, least: float) -> Column:
    """Too little evidence; an unknown one is no reason."""
    return F.coalesce(evidence < least, F.lit(False))


def better_attempt(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second attempt's rows only if its evidence is strictly higher; attempts are never mixed."""
    e1, e2 = F.broadcast(first.agg(F.max("evidence").alias("e1"))), F.broadcast(second.agg(F.max("evidence").alias("e2")))
    wins = F.coalesce(F.col("e2") > F.coalesce(F.col("e1"), F.lit(-1.0)), F.lit(False))
    old = first.crossJoin(e1).crossJoin(e2).where(~wins)
    new = second.crossJoin(e1).crossJoin(e2).where(wins)
    return old.unionByName(new).drop("e1", "e2")


def boosted(candidates: DataFrame, documents: DataFrame, key: str, constant: int = 61) -> DataFrame:
    """Candidates (key, document_id, position from 0) reordered by 1 / (c + position) + 1 / (c + the document's rank from 0).

    A document without a rank adds nothing; ties keep the old order.
    """
    joined = candidates.join(F.broadcast(documents.select("document_id", "document_rank")), "document_id", "left")
    score = 1.0 / (constant + F.col("position")) + F.coalesce(1.0 / (constant + F.col("document_rank")), F.lit(0.0))
    return joined.withColumn("boost", score).withColumn("new_position", F.row_number().over(Window.orderBy(F.desc("boost"), "position", key)) - 1)


def restricted(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates of the given documents only; if none is left, all of them."""
    inside = candidates.join(F.broadcast(documents.select("document_id").distinct()), "document_id", "left_semi")
    n = F.broadcast(inside.agg(F.count(F.lit(1)).alias("n")))
    return inside.unionByName(candidates.crossJoin(n).where("n = 0").drop("n"))
