"""Retrieval quality: relevance, recall, nDCG, summaries, slices, coverage, judges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import normalised
from heronry.operators.ordered import running_total

try:
    import ahocorasick
except ImportError:  # a plain search does the same, slower
    ahocorasick = None

#: What counts as a small table of gold strings.
MOST_STRINGS = 100_000


def relevance(text: Column, expected: Column) -> Column:
    """1 if the text has one of the expected strings, white space and case aside; else 0, also for null."""
    t = normalised(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(expected, lambda e: t.contains(normalised(e))), F.lit(False)).cast("int")


def hit(texts: Column, expected: Column, match: Column) -> Column:
    """1 if the texts together have any (or all, by ``match``) of the expected strings."""
    joined = normalised(F.array_join(texts, " || "))
    found = F.transform(expected, lambda e: joined.contains(normalised(e)))
    yes = F.when(match == "all", F.forall(found, lambda f: f)).otherwise(F.exists(found, lambda f: f))
    return F.coalesce(yes, F.lit(False)).cast("int")


def recall_at(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(id, recall_at_<k> ...) for ``results`` (id, rank, text) and ``gold`` (id, expected, match); 0 for a query without results.

    A text is normalised once and leaves the numbers of the strings it has, so that only those are shuffled.
    """
    wanted = gold.select("id", "expected", "match")
    t = normalised(F.coalesce(F.col("text"), F.lit("")))
    met = results.join(wanted.select("id", F.transform("expected", normalised).alias("forms")), "id").withColumn("t", t)
    which = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("forms") - 1)), lambda i: F.coalesce(F.col("t").contains(F.get("forms", i)), F.lit(False)))
    first = met.select("id", "rank", F.explode(which).alias("i")).groupBy("id", "i").agg(F.min("rank").alias("rank"))
    lists = first.groupBy("id").agg(F.collect_list("rank").alias("ranks"))  # one number a string: where it is first met
    joined = wanted.join(lists, "id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))

    def at(k: int) -> Column:
        n = F.size(F.filter("ranks", lambda r: r <= k))
        yes = F.when(F.col("match") == "all", n == F.size(F.coalesce("expected", F.array()))).otherwise(n > 0)
        return F.coalesce(yes & F.col("expected").isNotNull(), F.lit(False)).cast("int").alias(f"recall_at_{k}")

    return joined.select("id", *[at(k) for k in ks])


def ndcg_at(results: DataFrame, k: int = 10) -> DataFrame:
    """(id, ndcg) for (id, rank, rel) with rel 0 or 1: the gain over that of the same list with all relevant ones first."""
    inside = F.col("rank") <= k
    gain = F.sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1.0))).alias("dcg")
    n = F.least(F.sum("rel"), F.lit(k)).cast("int").alias("n")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return results.groupBy("id").agg(gain, n).select("id", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def low_rank_percentile(rows: DataFrame, by: str, x: str, q: float) -> DataFrame:
    """(by, value): for every key the value at place floor(q * (n - 1)) of its sorted values, no interpolation; null without a value.

    Places are running counts over sorted slices, so that a key of any size is shared by many tasks.
    """
    known = rows.where(F.col(x).isNotNull()).select(by, F.col(x).alias("value"))
    n = known.groupBy(F.col(by).alias("_by")).agg((F.floor(F.lit(q) * (F.count(F.lit(1)) - 1))).alias("_wanted"))
    placed = running_total(known, by, ["value"], F.lit(1), "_at")
    found = placed.join(F.broadcast(n), placed[by].eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_wanted"))).select("_by", "value")
    keys = rows.select(by).distinct()
    return keys.join(found, keys[by].eqNullSafe(F.col("_by")), "left").select(by, "value")


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and the count of queries."""
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in columns])


def by_dimension(metrics: DataFrame, dimensions: list[str], columns: list[str]) -> DataFrame:
    """(dimension, value, queries, means): one pass over the queries, each row counted under all its dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return metrics.select(pairs.alias("d"), *columns).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in columns])


def same_order(first: DataFrame, final: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(id, same): whether two rankings (id, rank, key) list the same keys in the same order."""
    lists = lambda df, n: df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", key))).alias(n))
    return lists(first, "a").join(lists(final, "b"), "id", "full_outer").select("id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def uncovered(gold: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, expected_string): expected strings of the gold rows that no text has.

    The gold strings go to every task, after a check of their number and length; a task walks each text once with an
    automaton of those that it has not met yet, and reports each string once.
    """
    wanted = gold.select("id", F.explode("expected").alias("expected_string")).distinct()
    forms = [r["form"] for r in wanted.select(normalised(F.col("expected_string")).alias("form")).distinct().limit(MOST_STRINGS + 1).collect()]
    if len(forms) > MOST_STRINGS or sum(map(len, forms)) > 100 * MOST_STRINGS:
        raise ValueError(f"more than {MOST_STRINGS} gold strings, or very long ones: they are no small table")
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(forms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _Finder(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"form": finder.new([t for t in pdf["t"]])}, dtype="object")

    seen = texts.select(normalised(F.coalesce(F.col(text), F.lit(""))).alias("t")).mapInPandas(run, "form string").distinct()
    return wanted.withColumn("form", normalised(F.col("expected_string"))).join(seen, "form", "left_anti").select("id", "expected_string")


class _Finder:
    """Which of the listed strings stand in texts; each is told once."""

    def __init__(self, strings: list[str]):
        self.left = {s for s in strings if s}
        self.empty = [s for s in strings if s == ""]
        self._build()

    def _build(self) -> None:
        self.size, self.automaton = len(self.left), None
        if ahocorasick is not None and self.left:
            self.automaton = ahocorasick.Automaton()
            for s in self.left:
                self.automaton.add_word(s, s)
            self.automaton.make_automaton()

    def new(self, texts: list[str]) -> list[str]:
        found = set(self.empty if texts else ())
        self.empty = [] if texts else self.empty
        for t in texts:
            found |= {s for _, s in self.automaton.iter(t)} if self.automaton is not None else {s for s in self.left if s in t}
        self.left -= found
        if 2 * len(self.left) < self.size:
            self._build()
        return sorted(found)


def majority(votes: Column) -> Column:
    """True or false by most of the non-null votes; null on a tie or without any."""
    yes, no = F.size(F.filter(votes, lambda v: v)), F.size(F.filter(votes, lambda v: ~v))
    return F.when(yes > no, True).when(yes < no, False)


def confusion(rows: DataFrame, label: str, verdict: str) -> DataFrame:
    """One row of counts (tp, fn, tn, fp, unparseable), tpr, tnr and agreement of a verdict that may be null."""
    l, v = F.col(label), F.col(verdict)
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    out = rows.where(l.isNotNull()).agg(c(l & v).alias("tp"), c(l & ~v).alias("fn"), c(~l & ~v).alias("tn"), c(~l & v).alias("fp"), c(v.isNull()).alias("unparseable"))
    share = lambda a, b: F.when(b > 0, a / b)
    t = {n: F.col(n) for n in ("tp", "fn", "tn", "fp")}
    return out.select("*", share(t["tp"], t["tp"] + t["fn"]).alias("tpr"), share(t["tn"], t["tn"] + t["fp"]).alias("tnr"), share(t["tp"] + t["tn"], t["tp"] + t["fn"] + t["tn"] + t["fp"]).alias("agreement"))


def weakest_link(sentence_scores: DataFrame, key: str) -> DataFrame:
    """(key, confidence): the lowest sentence score as a percentage, halves rounded to even."""
    return sentence_scores.groupBy(key).agg(F.bround(F.min("score") * 100).cast("int").alias("confidence"))


def fingerprint(*parts: Column) -> Column:
    """A hash that changes with any of the parts: what an index was built from."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def canonical_lines(df: DataFrame) -> DataFrame:
    """(line): every row as JSON with its fields in alphabetical order, sorted; equal tables give equal dumps."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def first_relevant(results: DataFrame) -> DataFrame:
    """(id, first_rank) of the first relevant row of each query; null without one."""
    return results.groupBy("id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"))


def last_turn(turns: DataFrame, by: str = "id") -> DataFrame:
    """The last turn of each conversation (by, turn, ...)."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("turn")))).where("_n = 1").drop("_n")


def before_hop(ranking: DataFrame) -> DataFrame:
    """A final ranking without what a hop added: the list the metrics of the ranking itself look at."""
    return ranking.where(~F.coalesce("via_crossref", F.lit(False)))


def invariant(first: DataFrame, final: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(id, same): whether, with rerank, retry and hop off, the final ranking is the first stage; hops are taken out first."""
    return same_order(first, before_hop(final), key)


def hop_summary(queries: DataFrame) -> DataFrame:
    """One row (queries, fired, fire_rate, precision): ``queries`` has (id, hop_chunks, hit_expected_source).

    The rate is over all queries, the precision over those in which the hop added something; null where none did.
    """
    fired = F.col("hop_chunks") > 0
    n = F.sum(fired.cast("long"))
    return queries.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(n, F.lit(0).cast("long")).alias("fired"), F.avg(fired.cast("double")).alias("fire_rate"), F.avg(F.when(fired, F.col("hit_expected_source").cast("double"))).alias("precision"))


def dump_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(line, side): lines of the canonical dumps that stand in one table only; repeated lines count once."""
    left, right = canonical_lines(a).distinct().withColumn("a", F.lit(True)), canonical_lines(b).distinct().withColumn("b", F.lit(True))
    both = left.join(right, "line", "full_outer")
    return both.where(F.col("a").isNull() | F.col("b").isNull()).select("line", F.when(F.col("a").isNull(), "second").otherwise("first").alias("side"))


def integrity(gold: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, in_source, unique, resolves): the gates of gold rows (id, source, expected, fact_ids).

    ``in_source``: every expected string stands in its source's text (source, text).  ``unique``: and in no other
    source's.  ``resolves``: every fact id is among ``facts`` (fact_id).  Gold and sources are small tables by nature and
    meet by an automaton over the texts, as in :func:`uncovered`.
    """
    wanted = gold.select("id", "source", F.explode("expected").alias("e")).withColumn("form", normalised(F.col("e")))
    forms = [r["form"] for r in wanted.select("form").distinct().limit(MOST_STRINGS + 1).collect()]
    if len(forms) > MOST_STRINGS:
        raise ValueError(f"more than {MOST_STRINGS} gold strings: they are no small table")
    shared = gold.sparkSession.sparkContext.broadcast(forms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, f) for s, t in zip(pdf["source"], pdf["t"]) for f in _Finder(shared.value).new([t])]
            yield pd.DataFrame(out, columns=["holder", "form"])

    met = sources.select("source", normalised(F.coalesce("text", F.lit(""))).alias("t")).mapInPandas(run, "holder string, form string").distinct()
    each = wanted.join(met, "form", "left").groupBy("id", "source", "e").agg(F.coalesce(F.max(F.col("holder").eqNullSafe(F.col("source"))), F.lit(False)).alias("here"), F.count(F.when(F.col("holder") != F.col("source"), 1)).alias("elsewhere"))
    strings = each.groupBy("id").agg(F.min("here").alias("in_source"), (F.min("here") & (F.sum("elsewhere") == 0)).alias("unique"))
    known = gold.select("id", F.explode("fact_ids").alias("fact_id")).join(facts.select("fact_id").distinct().withColumn("known", F.lit(True)), "fact_id", "left")
    ids = known.groupBy("id").agg(F.min(F.coalesce("known", F.lit(False))).alias("resolves"))
    yes = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    return gold.select("id").distinct().join(strings, "id", "left").join(ids, "id", "left").select("id", yes("in_source"), yes("unique"), yes("resolves"))


def remembered(spark, path: str, keys: DataFrame, compute, by: list[str]) -> DataFrame:
    """Rows of ``compute`` for ``keys``, stored under ``path``: only keys that were not asked before are computed.

    ``by`` names what an answer depends on (corpus, model, prompt version, query); a change of any of them is another key.
    """
    from heronry.sources.store import _fs

    fs, p = _fs(spark, path)
    stored = spark.read.parquet(path) if fs.exists(p) else None
    missing = keys.join(stored.select(*by), by, "left_anti") if stored is not None else keys
    compute(missing.distinct()).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys.select(*by).distinct(), by, "left_semi")


def results_json(run: dict, metrics: DataFrame, dimensions: DataFrame | None = None, invariant_rows: DataFrame | None = None, uncovered_rows: DataFrame | None = None) -> str:
    """The result file of one evaluation: the run's settings, summary, slices, broken invariants and uncovered strings.

    All of these have a row a gold item or a slice at most.
    """
    rows = lambda df: [] if df is None else [r.asDict(recursive=True) for r in df.collect()]
    columns = [c for c, t in metrics.dtypes if t in ("int", "bigint", "double")]
    body = {"run": run, "summary": rows(summary(metrics, columns))[0], "queries": rows(metrics.orderBy("id")), "by_dimension": rows(dimensions)}
    body |= {"invariant_broken": [r["id"] for r in rows(invariant_rows) if not r["same"]], "uncovered": rows(uncovered_rows)}
    return json.dumps(body, ensure_ascii=False, sort_keys=True, default=str)


def text_table(rows: list[dict], columns: list[str], width: int = 40) -> str:
    """Rows as lines of fixed columns, numbers at the right, with a bar under the names and one at the end."""
    cells = [[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)[:width] for v in (r.get(c) for c in columns)] for r in rows]
    sizes = [max([len(c), *(len(x[i]) for x in cells)]) for i, c in enumerate(columns)]
    line = lambda xs: "  ".join(x.rjust(n) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x.ljust(n) for x, n in zip(xs, sizes)).rstrip()
    bar = "-" * (sum(sizes) + 2 * (len(sizes) - 1))
    return "\n".join([line(columns), bar, *map(line, cells), bar])
