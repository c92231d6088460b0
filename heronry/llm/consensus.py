"""Consensus of several annotators, with item difficulty and annotator skill learnt together.

The model: annotator j answers item i rightly with probability
``sigmoid(skill_j * ease_i)``, ``ease_i = exp(b_i)``.  Expectation-maximisation: the
E-step gives each item's posterior that the true label is positive; the M-step
climbs the expected log-likelihood by gradient in the skills and, within each
item, in its ease.  An item's posterior and ease follow from its votes and the
skills alone: both are climbed until they stand still, so that a round is one map
over the items, packed once into blocks of numbers, that returns two numbers per
annotator and block.  The skills on the driver are as many as there are annotators,
which is checked against ``max_annotators``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.session import cut_lineage


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _item_state(item: np.ndarray, n: int, who: np.ndarray, vote: np.ndarray, skill: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior and log-ease of each of ``n`` items from flat votes, where neither moves any more; ease has a standard normal prior."""
    sign, b, level = np.where(vote, 1.0, -1.0), np.zeros(n), np.log(prior / (1 - prior))
    for _ in range(rounds):
        x = skill[who] * np.exp(b)[item]
        post = _sigmoid(level + np.bincount(item, sign * x, n))
        right, s = np.where(vote, post[item], 1 - post[item]), _sigmoid(x)
        slope = np.bincount(item, (right - s) * x, n) - b
        bend = np.bincount(item, s * (1 - s) * x * x, n) + 1
        step = np.clip(b + np.clip(0.7 * slope / bend, -0.5, 0.5), -2, 2) - b
        b = b + step
        if not len(step) or np.abs(step).max() < 1e-4:
            break
    return _sigmoid(level + np.bincount(item, sign * skill[who] * np.exp(b)[item], n)), b


def _votes(panel: DataFrame, arm: str) -> DataFrame:
    """One row per distinct panel row: key, stored verdict, annotators and their votes (nulls kept)."""
    return panel.select(
        F.concat(F.lit(f"{arm}:"), "id").alias("case_key"), "majority_pass", "requires_crossref", "voters", "votes"
    ).distinct()


def panel_items(arms: dict[str, DataFrame]) -> DataFrame:
    """The rows of all arms with keys ``<arm>:<id>``; a repeated row counts once, columns beyond these are not looked at."""
    frames = [_votes(df, arm) for arm, df in arms.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    cast = F.filter(F.arrays_zip("voters", "votes"), lambda p: p["votes"].isNotNull() & p["voters"].isNotNull())
    yes = F.size(F.filter("cast", lambda p: p["votes"]))
    n = F.size("cast")
    return (
        out.withColumn("cast", F.coalesce(cast, F.array().cast("array<struct<voters:string,votes:boolean>>")))
        .withColumn("n_votes", n)
        .withColumn("n_yes", yes)
        .withColumn("majority", F.when(2 * F.col("n_yes") > F.col("n_votes"), True).when(2 * F.col("n_yes") < F.col("n_votes"), False))
    )


def consensus(arms: dict[str, DataFrame], rounds: int = 12, max_annotators: int = 100_000) -> tuple[DataFrame, DataFrame, float]:
    """(items, annotators, chance-corrected agreement).

    items: case_key, stored verdict, n_votes, n_yes, ``majority`` of the non-null votes (null on a tie
    or without votes), ``posterior`` that the label is positive, ``consensus``, ``ease`` and
    ``agreement`` (share of agreeing pairs of votes, null under two votes).
    annotators: voter, n_votes, ``skill`` (above 0: better than chance), ``with_consensus`` (share of
    votes that agree with the consensus), ``n_majority`` and ``with_majority`` over the items with a majority.
    The agreement is Krippendorff's alpha for nominal labels, null without two votes on any item.
    Null votes and null voters are failed votes and set aside; a null id gives a null key; arrays of
    unequal length pair as far as both reach; empty panels give empty results.
    """
    items = cut_lineage(panel_items(arms))
    spark = items.sparkSession
    flat = items.select(F.explode("cast").alias("v")).select(F.col("v.voters").alias("voter"), F.col("v.votes").alias("vote"))
    names = [r["voter"] for r in flat.select("voter").distinct().orderBy("voter").limit(max_annotators + 1).collect()]
    if len(names) > max_annotators:
        raise ValueError(f"more than {max_annotators} annotators: their skills no longer fit one driver array")
    code = spark.sparkContext.broadcast({v: i for i, v in enumerate(names)})  # at most max_annotators
    skill, prior = np.ones(len(names)), 0.5
    total = items.agg(F.sum("n_yes").alias("y"), F.sum("n_votes").alias("n")).first()
    if total["n"]:
        prior = min(0.95, max(0.05, total["y"] / total["n"]))

    def unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = code.value
        size = [len(pairs) for pairs in pdf["cast"]]
        flat = [p for pairs in pdf["cast"] for p in pairs]
        return np.repeat(np.arange(len(size), dtype="i4"), size), np.array([number[p["voters"]] for p in flat], dtype="i4"), np.array([p["votes"] for p in flat], dtype=bool)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([(len(pdf), *(x.tobytes() for x in unpack(pdf)))], columns=["n", "item", "who", "vote"])

    blocks = cut_lineage(items.select("cast").mapInPandas(pack, "n int, item binary, who binary, vote binary"))

    def gradient(skill: np.ndarray, prior: float):
        at = spark.sparkContext.broadcast(skill)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h, p, items = np.zeros(len(at.value)), np.zeros(len(at.value)), 0.0, 0
            for pdf in batches:
                for n, item, who, vote in zip(pdf["n"], pdf["item"], pdf["who"], pdf["vote"]):
                    item, who, vote = np.frombuffer(item, "i4"), np.frombuffer(who, "i4"), np.frombuffer(vote, bool)
                    post, b = _item_state(item, n, who, vote, at.value, prior)
                    e = np.exp(b)[item]
                    s = _sigmoid(at.value[who] * e)
                    right = np.where(vote, post[item], 1 - post[item])
                    g += np.bincount(who, (right - s) * e, len(g))
                    h += np.bincount(who, s * (1 - s) * e * e, len(g))
                    p, items = p + post.sum(), items + n
            if items:
                yield pd.DataFrame({"k": [*range(len(g)), -1], "g": [*g, p], "h": [*h, float(items)]})

        return run

    for _ in range(rounds if names else 0):
        sums = blocks.mapInPandas(gradient(skill, prior), "k int, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        step, old = np.zeros(len(names)), skill
        for r in sums:
            if r["k"] >= 0:  # Newton step of the gradient with a weak normal prior around 1
                step[r["k"]] = (r["g"] - 0.1 * (skill[r["k"]] - 1)) / (r["h"] + 0.1)
            elif r["h"]:
                prior = min(0.95, max(0.05, r["g"] / r["h"]))
        skill = np.clip(skill + np.clip(step, -1, 1), -4, 6)
        if np.abs(skill - old).max() < 1e-3:
            break

    learnt = spark.sparkContext.broadcast(skill)

    def state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            item, who, vote = unpack(pdf)
            post, b = _item_state(item, len(pdf), who, vote, learnt.value, prior)
            yield pdf.assign(posterior=post, ease=np.exp(b))

    base = "case_key string, majority_pass boolean, requires_crossref boolean, n_votes int, n_yes int, majority boolean, cast array<struct<voters:string,votes:boolean>>"
    scored = items.select("case_key", "majority_pass", "requires_crossref", "n_votes", "n_yes", "majority", "cast").mapInPandas(state, f"{base}, posterior double, ease double")
    y, n = F.col("n_yes").cast("double"), F.col("n_votes").cast("double")
    scored = scored.withColumn("consensus", F.when(F.col("n_votes") > 0, F.col("posterior") > 0.5)).withColumn("agreement", F.when(n > 1, (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))))
    skills = spark.createDataFrame([(v, float(s)) for v, s in zip(names, skill)], "voter string, skill double")
    per_vote = scored.select("consensus", "majority", F.explode("cast").alias("v")).select(F.col("v.voters").alias("voter"), F.col("v.votes").alias("vote"), "consensus", "majority")
    voters = (
        per_vote.groupBy("voter")
        .agg(
            F.count(F.lit(1)).alias("n_votes"),
            F.avg((F.col("vote") == F.col("consensus")).cast("double")).alias("with_consensus"),
            F.count("majority").alias("n_majority"),
            F.avg((F.col("vote") == F.col("majority")).cast("double")).alias("with_majority"),
        )
        .join(skills, "voter")
    )
    pair = items.where("n_votes > 1").agg(
        F.sum("n_votes").alias("n"), F.sum("n_yes").alias("y"), F.sum(2 * F.col("n_yes") * (F.col("n_votes") - F.col("n_yes")) / (F.col("n_votes") - 1)).alias("split")
    ).first()
    alpha = None
    if pair["n"]:
        chance = 2 * pair["y"] * (pair["n"] - pair["y"]) / (pair["n"] - 1)
        alpha = 1 - pair["split"] / chance if chance else 1.0
    return scored.drop("cast"), voters, alpha


def suspicious(arms: dict[str, DataFrame], least: float = 0.75) -> DataFrame:
    """(kind, case_key): items whose stored verdict is not the majority of their votes, and voters who agree too seldom.

    Items and voters come out of :func:`consensus`; the comparison with the plain majority follows.
    A null majority equals a null stored verdict.
    """
    items, voters, _ = consensus(arms)
    wrong = items.where(~F.col("majority_pass").eqNullSafe(F.col("majority"))).select(F.lit("item").alias("kind"), "case_key")
    weak = voters.where((F.col("n_majority") > 0) & (F.col("with_majority") < least)).select(F.lit("voter").alias("kind"), F.col("voter").alias("case_key"))
    return wrong.distinct().unionByName(weak)


def agreement(arms: dict[str, DataFrame]) -> DataFrame:
    """One row (n_items, n_votes, n_voters, alpha, mean_agreement): how far the votes of all arms agree beyond chance.

    ``alpha`` is Krippendorff's for nominal labels; both measures are null without two votes on any item.
    """
    items, voters, alpha = consensus(arms)
    counts = items.agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("n_votes"), F.lit(0)).alias("n_votes"), F.avg("agreement").alias("mean_agreement"))
    return counts.crossJoin(voters.agg(F.count(F.lit(1)).alias("n_voters"))).select("n_items", "n_votes", "n_voters", F.lit(alpha).cast("double").alias("alpha"), "mean_agreement")
