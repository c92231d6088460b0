"""JSON in string columns: broken or missing JSON reads as an empty object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(metadata: Column, path: str) -> Column:
    """One field as a string; null for broken JSON, no field, or a JSON null."""
    return F.get_json_object(metadata, path)


def inner_or_outer(metadata: Column, name: str) -> Column:
    """A chunk's field, which may lie in the nested metadata or at the top."""
    return F.coalesce(field(metadata, f"$.metadata.{name}"), field(metadata, f"$.{name}"))


def original_text(metadata: Column, text: Column) -> Column:
    """The text before enrichment: nested, then at the top, then the column itself, then ''."""
    kept = [F.when(field(metadata, p) != "", field(metadata, p)) for p in ("$.metadata.original_text", "$.original_text")]
    return F.coalesce(*kept, F.when(text != "", text), F.lit(""))


def merged(base: Column, updates: Column) -> Column:
    """Two objects of strings as one, the later winning; a broken side counts as empty."""
    side = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(side(base), side(updates)))


def as_bool(x: Column) -> Column:
    """True for true, "true", "yes" and "grounded"; false for their opposites; null for anything else."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s.isin("true", "yes", "grounded", "1"), True).when(s.isin("false", "no", "ungrounded", "0"), False)


def as_percent(x: Column) -> Column:
    """Numbers and numeric strings as an integer; booleans, NaN and anything else 0."""
    d = x.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(d) & (F.abs(d) < 1e9), F.bround(d).cast("int")), F.lit(0))
