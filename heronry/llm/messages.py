"""What the message operators share: role, instant, blankness, identity of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THINK = r"(?is)<think>.*?</think>"
_STAMP = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:([Zz])|([+-]\d{2}):?(\d{2}))?\s*$"


def role(sender: Column) -> Column:
    """``user``, ``assistant`` or null; case and outer white space do not matter."""
    s = F.lower(F.regexp_replace(sender, r"(?U)^\s+|\s+$", ""))
    return F.when(s.isin("user", "human"), "user").when(s.isin("assistant", "ai", "bot"), "assistant")


def instant(timestamp: Column) -> Column:
    """Microseconds since the epoch; UTC without an offset; null for what is no date and time."""
    part = lambda i: F.regexp_extract(timestamp, _STAMP, i)
    zone = F.when(part(4) != "", F.concat(part(4), F.lit(":"), part(5))).otherwise(F.lit("+00:00"))
    fraction = F.regexp_extract(part(2), r"\.(\d{1,6})", 1)
    clock = F.regexp_replace(part(2), r"\..*$", "")
    clock = F.when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    text = F.concat(part(1), F.lit("T"), clock, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), zone)
    return F.when(timestamp.rlike(_STAMP), F.unix_micros(text.try_cast("timestamp")))


def is_blank(content: Column) -> Column:
    """No letter or digit outside closed think blocks; null is blank."""
    return ~F.coalesce(F.regexp_replace(content, THINK, "").rlike(r"[\p{L}\p{N}]"), F.lit(False))


def tagged(messages: DataFrame, *extra: str) -> DataFrame:
    """Rows with a session: id, session_id, role, instant, hash of the content, blank, and ``extra`` columns.

    A message without id, role, instant or content keeps its row with nulls there.
    Other columns of the input are not looked at.
    """
    return messages.where(F.col("session_id").isNotNull()).select(
        "id",
        "session_id",
        role(F.col("sender")).alias("role"),
        instant(F.col("timestamp")).alias("instant"),
        F.xxhash64("content").alias("content_hash"),
        is_blank(F.col("content")).alias("blank"),
        *extra,
    )
