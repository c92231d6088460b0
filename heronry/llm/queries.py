"""The pN_ queries: each callable takes (spark, directory) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import abuse, consensus, conversations, encoding, leakage, neighbours, pairs, scans, splitting
from heronry.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.session_reasons(table(spark, d, "messages"), table(spark, d, "sessions")).where("reason is not null")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.rebuild_conversations(table(spark, d, "messages"), table(spark, d, "sessions"))
    return turns.select("session_id", "turn", "message_id", "role", "content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "text_pages"))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The search form: queries are the chunks whose index is divisible by 20, against all rows."""
    pages = table(spark, d, "text_pages")
    out = neighbours.nearest(pages, pages.where("chunk_index % 20 = 0"))
    return out.select("chunk_id", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "messages")).select("message_id", "defect")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "text_pages")).where("piece = 1").select("chunk_id", "cut").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "text_pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "text_pages"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "text_pages"))


def _panels(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"i": table(spark, d, "panel_arm_i"), "g2": table(spark, d, "panel_arm_g2")}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.suspicious(_panels(spark, d))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_panels(spark, d))[0]


def p6_voters(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_panels(spark, d))[1]


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(_panels(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "gold_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"))


def p9_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_pieces, p3_found, p3_nearest, p4_found, p5_found, p5_repaired, p6_found, p6_items, p6_voters, p6_agreement, p7_ids, p8_found, p9_found, p9_scores, p9_source_rates)
}
