"""The most similar vectors of every vector, by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``hashes`` Gaussian projections into cells of one
width, set for the radius that belongs to ``min_cosine``.  A vector is stored in its
own cell and looks into the ``probes`` perturbed cells that are most likely to hold
a neighbour, in order of estimated success.  Candidates of all tables are merged,
thinned by a sign sketch of 192 bits whose threshold is four deviations outside what
a pair at the radius has on average, and ranked by exact cosine.  Hashes grow with the
logarithm of the number of rows, so that cells keep their size, and with them as many
tables as it takes to find a pair at the radius with the promised probability, which is
computed on random pairs with the hashes in use.

Layout.  A map task hashes its rows in numpy and sends, for each shard of the key
space, one packed block (40 bytes an entry) instead of a row an entry.  The number of
shards grows with the table, so a shard stays a few tens of MB, and a shard is a task.
A cell with very many different vectors is cut into blocks, and its pairs of blocks go
to other tasks.  Copies of a vector
(equal up to length) form a class, which enters the tables once a task however many
rows it has; its rows come back at the end, where ten smallest ids stand for any
number of copies.  Vectors travel only for the classes that have a candidate.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import cut_lineage, parallelism

WORDS = 3
ENTRY = np.dtype([("key", "u8"), ("id", "u8"), ("sketch", "u8", (WORDS,))])
ROW = np.dtype([("key", "u8"), ("row", "u8")])
SHARD_BYTES = 32 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Hashing:
    """Everything a task needs to hash; the same seed gives the same tables in every task."""

    width: int = 64
    min_cosine: float = 0.94
    tables: int = 5
    hashes: int = 11
    probes: int = 3
    seed: int = 7
    success: float = 0.98

    @property
    def cell(self) -> float:
        return 5.8 * math.sqrt(2 - 2 * self.min_cosine)

    def for_rows(self, n: int) -> Hashing:
        """One more hash a doubling beyond 200,000 rows, and the tables that reach ``success`` with so many hashes; never fewer than given."""
        how = replace(self, hashes=self.hashes + max(0, round(math.log2(max(n, 1) / 200_000))))
        return replace(how, tables=max(self.tables, tables_needed(how)))

    def most_bits(self, words: int) -> int:
        """Bits that may differ in so many words of the sketch."""
        n, p = 64 * words, math.acos(self.min_cosine) / math.pi
        return math.ceil(n * p + 4 * math.sqrt(n * p * (1 - p)))

    def draw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.standard_normal((self.width, self.tables * self.hashes)).astype("f4") / np.float32(self.cell)
        shift = rng.uniform(0, 1, self.tables * self.hashes).astype("f4")
        factor = rng.integers(1, 2**63, (self.tables, self.hashes), dtype="u8") | np.uint64(1)
        signs = rng.standard_normal((self.width, 64 * WORDS)).astype("f4")
        return a, shift, factor, signs

    def probe_sets(self) -> list[tuple[int, ...]]:
        """Which of the sorted boundary distances to step over, by expected squared distance."""
        k = self.hashes
        z = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
        z = z + [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
        sets = [s for r in (1, 2, 3) for s in itertools.combinations(range(min(2 * k, 10)), r) if not any(2 * k - 1 - i in s for i in s)]
        return sorted(sets, key=lambda s: (sum(z[i] for i in s), s))[: self.probes]


def found_share(how: Hashing, pairs: int = 6000) -> np.ndarray:
    """For 1, 2, ... ``tables`` the share of random pairs at ``min_cosine`` of which one looks into the cell of the other."""
    rng = np.random.default_rng(how.seed + 1)
    x, y = rng.standard_normal((2, pairs, how.width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = how.min_cosine * x + math.sqrt(1 - how.min_cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (sx, lx), (sy, ly) = (hash_entries(v.astype("f4"), np.arange(pairs, dtype="u8"), how) for v in (x, y))
    sx, sy = (z["key"].reshape(how.tables, pairs) for z in (sx, sy))
    lx, ly = (z["key"].reshape(how.tables, how.probes, pairs) for z in (lx, ly))
    hit = (sx == sy) | (lx == sy[:, None]).any(1) | (ly == sx[:, None]).any(1)
    return np.logical_or.accumulate(hit, axis=0).mean(1)


@lru_cache(maxsize=64)
def tables_needed(how: Hashing) -> int:
    """The fewest tables that find a pair at ``min_cosine`` with probability ``success``, with a margin for the estimate."""
    wanted = how.success + 0.15 * (1 - how.success)
    one = found_share(replace(how, tables=8))[-1]
    guess = math.ceil(8 * math.log(1 - wanted) / math.log(max(1e-9, 1 - one)))
    while True:
        share = found_share(replace(how, tables=guess))
        if share[-1] >= wanted:
            return int(np.argmax(share >= wanted)) + 1
        guess = math.ceil(1.3 * guess)


def usable_unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the lists with ``width`` finite values that are not all zero."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    starts = column.offsets.to_numpy()
    sizes = np.diff(starts)
    rows = np.flatnonzero((sizes == width) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype("f8", copy=False)
    x = values[starts[rows][:, None] + np.arange(width)] if len(rows) else np.empty((0, width))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    rows, x = rows[good], x[good]
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return rows, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4") if len(x) else x.astype("f4")


def class_of(x: np.ndarray) -> np.ndarray:
    """A 64-bit name that vectors share if they are equal after scaling, to five places."""
    factor = np.random.default_rng(11).integers(1, 2**63, x.shape[1], dtype="u8") | np.uint64(1)
    cells = np.round(x.astype("f8") * 1e5).astype("i8").view("u8")
    h = (cells * factor).sum(1, dtype="u8")
    h ^= h >> np.uint64(29)
    return h * _GOLDEN


def hash_entries(x: np.ndarray, ids: np.ndarray, how: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """(stored, looked up): one entry a table and vector, and ``probes`` more."""
    a, shift, factor, signs = how.draw()
    sketch = np.packbits(x @ signs > 0, axis=1).view("u8")
    f = x @ a + shift
    h = np.floor(f)
    u = f - h
    h = h.astype("i8").view("u8").reshape(len(x), how.tables, how.hashes)
    u = u.reshape(len(x), how.tables, how.hashes)
    stored, looked = np.empty((how.tables, len(x)), ENTRY), np.empty((how.tables, how.probes, len(x)), ENTRY)
    for part in (stored, looked):
        part["id"], part["sketch"] = ids, sketch
    for t in range(how.tables):
        base = (h[:, t] * factor[t]).sum(1, dtype="u8") + np.full(1, t, "u8") * _GOLDEN
        far = np.concatenate([u[:, t] ** 2, (1 - u[:, t]) ** 2], axis=1)
        order = np.argsort(far, axis=1)[:, :10]
        down = order < how.hashes
        step = factor[t][order % how.hashes]
        step = np.where(down, ~step + np.uint64(1), step)
        stored[t]["key"] = base
        for n, s in enumerate(how.probe_sets()):
            looked[t, n]["key"] = base + step[:, list(s)].sum(1, dtype="u8")
    return stored.ravel(), looked.ravel()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * _GOLDEN) >> np.uint64(33)) % np.uint64(shards)


def shard_places(shards: int) -> np.ndarray:
    """For each shard an integer that Spark's hash partitioning puts into the partition of that number, so that a shard is a task."""
    places, start = np.full(shards, -1, "i8"), 0
    while (places < 0).any():
        x = np.arange(start, start + 8 * shards, dtype="u8")
        where = murmur3_int(x).astype("i8") % shards  # as pmod
        new = np.flatnonzero(places[where] < 0)[::-1]
        places[where[new]] = x[new]
        start += 8 * shards
    return places


def murmur3_int(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Murmur3 (x86, 32 bits) of 32-bit integers, the hash of hash partitioning, as signed 32-bit integers."""
    m = np.uint64(0xFFFFFFFF)
    turn = lambda v, r: ((v << np.uint64(r)) | (v >> np.uint64(32 - r))) & m
    k = turn(x.astype("u8") * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
    h = (turn(np.uint64(seed) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(4)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & m
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & m
    return (h ^ (h >> np.uint64(16))).astype("u4").view("i4")


def _blocks(how: Hashing, places: np.ndarray):
    shards = len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            rows, x = usable_unit(batch.column(0), how.width)
            names = batch.column(1).to_numpy(zero_copy_only=False)[rows].astype("i8").view("u8")
            ids = class_of(x)
            fresh, copies = [], []
            for i, (c, n) in enumerate(zip(ids.tolist(), names.tolist())):
                if c not in seen:
                    seen[c] = n
                    fresh.append(i)
                elif seen[c] not in (n, -1):
                    seen[c] = -1
                    copies.append(i)
            out = {"shard": [], "kind": [], "block": []}

            def send(kind: int, part: np.ndarray) -> None:
                where = shard_of(part["key"], shards)
                order = np.argsort(where, kind="stable")
                part, where = part[order], where[order]
                cuts = np.searchsorted(where, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    out["shard"].append(int(places[s]))
                    out["kind"].append(kind)
                    out["block"].append(part[cuts[s] : cuts[s + 1]].tobytes())

            if fresh:
                stored, looked = hash_entries(x[fresh], ids[fresh], how)
                send(0, stored)
                send(1, looked)
            rows_named = np.empty(len(fresh) + len(copies), ROW)
            rows_named["key"], rows_named["row"] = ids[fresh + copies], names[fresh + copies]
            send(2, rows_named)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())]))

    return run


def match_shard(stored: np.ndarray, looked: np.ndarray, how: Hashing, at_once: int = 1 << 21, dense: int = 1 << 24) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(distinct pairs (smaller id, larger id) that share a cell and whose sketches are close enough, what is left of dense cells).

    A cell in which more than ``dense`` pairs would be compared is not, but comes back as pairs of blocks.
    """

    def sorted_once(part: np.ndarray) -> np.ndarray:
        part = part[np.lexsort((part["id"], part["key"]))]
        new = np.r_[True, (part["key"][1:] != part["key"][:-1]) | (part["id"][1:] != part["id"][:-1])] if len(part) else np.empty(0, bool)
        return part[new]

    stored = sorted_once(stored)
    looked = sorted_once(np.concatenate([stored, looked]))
    keys = np.ascontiguousarray(stored["key"])
    lo = np.searchsorted(keys, looked["key"], "left")
    n = np.searchsorted(keys, looked["key"], "right") - lo
    looked, lo, n = looked[n > 0], lo[n > 0], n[n > 0]
    heavy: list[tuple[np.ndarray, np.ndarray]] = []
    if len(looked):
        first = np.flatnonzero(np.r_[True, looked["key"][1:] != looked["key"][:-1]])
        many = np.add.reduceat(n, first)
        step, stay = math.isqrt(dense), np.ones(len(looked), bool)
        for c in np.flatnonzero(many > dense):
            a, b = first[c], first[c + 1] if c + 1 < len(first) else len(looked)
            cell = stored[lo[a] : lo[a] + n[a]]
            heavy += [(cell[i : i + step], looked[a:b][j : j + step]) for i in range(0, len(cell), step) for j in range(0, b - a, step)]
            stay[a:b] = False
        looked, lo, n = looked[stay], lo[stay], n[stay]
    return compare(stored, looked, lo, n, how, at_once), heavy


def compare(stored: np.ndarray, looked: np.ndarray, lo: np.ndarray, n: np.ndarray, how: Hashing, at_once: int = 1 << 21) -> np.ndarray:
    """Distinct pairs (smaller id, larger id) of entry ``i`` of ``looked`` and the ``n[i]`` entries of ``stored`` from ``lo[i]`` on, if their sketches are close."""
    held, sought = np.ascontiguousarray(stored["sketch"]), np.ascontiguousarray(looked["sketch"])
    out = []
    ends = np.cumsum(n)
    a = 0
    while a < len(looked):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + at_once, "right")))
        count = n[a:b]
        probe = np.repeat(np.arange(a, b), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[a:b], count)
        bits = np.zeros(len(at), "i4")
        for w in range(WORDS):  # most fall out after the first word
            bits += np.bitwise_count(sought[probe, w] ^ held[at, w])
            near = bits <= how.most_bits(w + 1)
            probe, at, bits = probe[near], at[near], bits[near]
        i, j = looked["id"][probe], stored["id"][at]
        two = i != j
        out.append(np.unique(np.stack([np.minimum(i, j)[two], np.maximum(i, j)[two]], axis=1), axis=0))
        a = b
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), "u8")


_MATCHED = "a long, b long, held binary, sought binary"


def _match(how: Hashing):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = [np.frombuffer(b"".join(pdf["block"][pdf["kind"] == k]), ENTRY if k < 2 else ROW) for k in (0, 1, 2)]
        pairs, heavy = match_shard(part[0], part[1], how)
        rows = np.unique(part[2])  # a class with two different rows is a pair with itself
        twice = np.unique(rows["key"][1:][rows["key"][1:] == rows["key"][:-1]])
        both = np.concatenate([pairs, np.stack([twice, twice], axis=1)]).view("i8")
        found = pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "held": None, "sought": None})
        left = pd.DataFrame([(None, None, x.tobytes(), y.tobytes()) for x, y in heavy], columns=found.columns)
        return pd.concat([found.astype({"a": "Int64", "b": "Int64"}), left.astype({"a": "Int64", "b": "Int64"})])

    return run


def _match_blocks(how: Hashing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["held"], pdf["sought"]):
                held, sought = np.frombuffer(x, ENTRY), np.frombuffer(y, ENTRY)
                both = compare(held, sought, np.zeros(len(sought), "i8"), np.full(len(sought), len(held)), how).view("i8")
                yield pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return run


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable_unit(batch.column(0), width)
            names = batch.column(1).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(class_of(x).view("i8")), names, pa.array([v.tobytes() for v in x], pa.binary())], names=["cls", "name", "unit"])

    return run


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), "f4").reshape(len(pdf), -1).astype("f8") for c in ("unit_a", "unit_b"))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "cosine": np.clip((a * b).sum(1), -1, 1)})


def similar(vectors: DataFrame, name: str = "chunk_id", vector: str = "vector", k: int = 10, how: Hashing = Hashing()) -> DataFrame:
    """(name, neighbour, rank, cosine): for every usable vector its nearest others, at most ``k``, with cosine of at least ``min_cosine``.

    Usable: ``width`` finite values, not all zero.  A name delivered more than once counts once (by its
    first vector, should they differ).  Equal cosines are ranked by name; any number of copies of a vector
    are each other's nearest, the smallest names first.  A null name is a row without identity and is
    left out.  An empty table gives no rows.  ``min_cosine`` is what the tables are tuned for: a pair at
    that cosine is found with a probability of 0.98 (``success``) at any number of rows, nearer ones with more.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(name).isNotNull()).select(vector, F.col(name).alias("name"))
    count = vectors.count()  # from the footers
    how = how.for_rows(count)
    entry_bytes = how.tables * (1 + how.probes) * ENTRY.itemsize
    shards = max(parallelism(spark), math.ceil(count * entry_bytes / SHARD_BYTES))
    blocks = rows.select(vector, F.xxhash64("name").alias("h")).mapInArrow(_blocks(how, shard_places(shards)), "shard int, kind int, block binary")
    matched = cut_lineage(blocks.repartition(shards, "shard").groupBy("shard").applyInPandas(_match(how), _MATCHED))
    left = matched.where("held is not null").select("held", "sought")
    dense = left.repartition(shards).mapInPandas(_match_blocks(how), "a long, b long")
    pairs = cut_lineage(matched.where("held is null").select("a", "b").unionByName(dense).distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    classes = rows.mapInArrow(_classes(how.width), "cls long, name string, unit binary").join(involved, "cls", "left_semi")
    classes = cut_lineage(classes.dropDuplicates(["name"]))
    units = classes.groupBy("cls").agg(F.min_by("unit", "name").alias("unit"))
    crossed = pairs.where("a <> b").join(units.select(F.col("cls").alias("a"), F.col("unit").alias("unit_a")), "a").join(units.select(F.col("cls").alias("b"), F.col("unit").alias("unit_b")), "b")
    scored = crossed.mapInPandas(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= how.min_cosine - 1e-7)
    both = scored.select("a", "b", "cosine").unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    both = both.unionByName(units.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("cosine")))
    head = classes.select("cls", "name", F.row_number().over(Window.partitionBy("cls").orderBy("name")).alias("n")).where(F.col("n") <= k + 1)
    # k classes reach k rows, as each has one at least; with the class itself that is k + 1
    near = both.withColumn("n", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).where(F.col("n") <= k + 1).drop("n")
    near = near.join(head.select(F.col("cls").alias("b"), F.col("name").alias("neighbour")), "b")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1)
    out = classes.select(F.col("cls").alias("a"), "name").join(near.select("a", "neighbour", "cosine"), "a").where("neighbour <> name")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)
    return out.select(F.col("name").alias(name), "neighbour", "rank", "cosine")


def similar_pairs(vectors: DataFrame, name: str = "chunk_id", vector: str = "vector", k: int = 10, how: Hashing = Hashing()) -> DataFrame:
    """(<name>_a, <name>_b): pairs of which one is among the ``k`` nearest of the other; the smaller name first."""
    s = similar(vectors, name, vector, k, how)
    return s.select(F.least(name, "neighbour").alias(f"{name}_a"), F.greatest(name, "neighbour").alias(f"{name}_b")).distinct()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row."""
    if scores.shape[1] > k:
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        return np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    return scores, ids


class _Board:
    """The best ``k`` of everything shown so far, for a fixed set of queries."""

    def __init__(self, names: np.ndarray, units: np.ndarray, k: int, step: int = 1024):
        self.names, self.units, self.k, self.step = names, units, k, step
        self.score = np.full((len(names), k), -2.0, "f4")
        self.id = np.zeros((len(names), k), "u8")

    def show(self, names: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(self.names), self.step):
            s = self.units[a : a + self.step] @ x.T
            least = self.score[a : a + self.step].min(1)
            if len(least) and least.min() < -1.5 and s.shape[1] > 4 * self.k:  # nothing to beat yet: no more than the best few
                c = np.argpartition(-s, self.k, axis=1)[:, : self.k + 1].ravel()
                r = np.repeat(np.arange(len(s)), self.k + 1)
            else:
                r, c = np.nonzero(s > least[:, None])
            other = names[c] != self.names[a + r]
            r, c = r[other], c[other]
            if not len(r):
                continue
            v = s[r, c]
            order = np.lexsort((-v, r))
            r, c, v = r[order], c[order], v[order]
            first = np.searchsorted(r, r)  # place within the row: more than k of one row cannot all stay
            r, c, v = (z[np.arange(len(r)) - first < self.k] for z in (r, c, v))
            rows, start, n = np.unique(r, return_index=True, return_counts=True)
            more_s, more_i = np.full((len(rows), self.k), -2.0, "f4"), np.zeros((len(rows), self.k), "u8")
            place = np.arange(len(r)) - np.repeat(start, n)
            owner = np.repeat(np.arange(len(rows)), n)
            more_s[owner, place], more_i[owner, place] = v, names[c]
            at = a + rows
            self.score[at], self.id[at] = _best(np.concatenate([self.score[at], more_s], 1), np.concatenate([self.id[at], more_i], 1), self.k)


def _scan(shared, k: int, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        board = _Board(*shared.value, k)
        seen: set[int] = set()
        for batch in batches:
            at, x = usable_unit(batch.column(0), width)
            h = batch.column(1).to_numpy(zero_copy_only=False)[at].astype("i8").view("u8")
            fresh = [i for i, z in enumerate(h.tolist()) if not (z in seen or seen.add(z))]
            board.show(h[fresh], x[fresh])
        starts = range(0, len(board.names), block)
        blobs = [board.score[a : a + block].tobytes() for a in starts], [board.id[a : a + block].tobytes() for a in starts]
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(starts))), pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=["block", "scores", "ids"])

    return run


def _merge(shared, k: int, block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = shared.value[0][int(pdf["block"].iloc[0]) * block :][:block]
        s = np.concatenate([np.frombuffer(b, "f4").reshape(-1, k) for b in pdf["scores"]], axis=1)
        i = np.concatenate([np.frombuffer(b, "u8").reshape(-1, k) for b in pdf["ids"]], axis=1)
        order = np.lexsort((i, -s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        rank = np.zeros(s.shape, "i4")
        for row in range(len(s)):  # a name that two tasks saw counts once
            used: set[int] = set()
            for j in range(s.shape[1]):
                if len(used) == k or s[row, j] < -1.5:
                    break
                if i[row, j] not in used:
                    used.add(i[row, j])
                    rank[row, j] = len(used)
        r, c = np.nonzero(rank)
        return pd.DataFrame({"h": names[r].view("i8"), "n": i[r, c].view("i8"), "rank": rank[r, c], "cosine": s[r, c].astype("f8")})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, name: str = "chunk_id", vector: str = "vector", k: int = 10, width: int = 64, at_once: int = 100_000, block: int = 2048) -> DataFrame:
    """(name, neighbour, rank, cosine): the ``k`` nearest of all usable vectors for each usable query, exactly.

    A stated query set against all rows, in blocks: at most about ``at_once`` queries (256 bytes each) are sent to the
    tasks, more go in several passes.  A task keeps a board of the best ``k`` for every query and gives one packed
    block per ``block`` queries; boards are merged block by block.  Names delivered more than once count once; a
    query is not its own neighbour; a null name is left out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(name).isNotNull()).select(vector, F.col(name).alias("name"))
    asked = queries.where(F.col(name).isNotNull()).select(vector, F.col(name).alias("name")).dropDuplicates(["name"])
    groups = max(1, math.ceil(asked.count() / at_once))
    parts = []

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable_unit(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["h", "unit"])

    for g in range(groups):
        some = asked.select(vector, F.xxhash64("name").alias("h")).where(F.pmod("h", F.lit(groups)) == g)
        mine = some.mapInArrow(hashed, "h long, unit binary").toPandas()
        ids, units = mine["h"].to_numpy("i8").view("u8"), np.frombuffer(b"".join(mine["unit"]), "f4").reshape(-1, width)
        shared = spark.sparkContext.broadcast((ids, units))

        boards = rows.select(vector, F.xxhash64("name").alias("h")).coalesce(2 * parallelism(spark)).mapInArrow(_scan(shared, k, width, block), "block int, scores binary, ids binary")
        parts.append(boards.groupBy("block").applyInPandas(_merge(shared, k, block), "h long, n long, rank int, cosine double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    named = rows.select("name", F.xxhash64("name").alias("key")).distinct()
    out = found.join(named.select(F.col("key").alias("h"), F.col("name").alias(name)), "h").join(named.select(F.col("key").alias("n"), F.col("name").alias("neighbour")), "n")
    return out.select(name, "neighbour", "rank", "cosine")
