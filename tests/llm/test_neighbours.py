from dataclasses import replace

import numpy as np
import pytest

from heronry.llm import neighbours as N


def _brute(names, x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for i, n in enumerate(names):
        near = sorted((j for j in range(len(names)) if s[i, j] >= least), key=lambda j: (-round(s[i, j], 9), names[j]))[:k]
        out[n] = [names[j] for j in near]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for c in (0.945, 0.96, 0.98):  # partners at a given cosine
        other = rng.standard_normal((600, 64))
        other -= (other * base).sum(1, keepdims=True) * base
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        rows.append(c * base + np.sqrt(1 - c * c) * other)
    x = np.concatenate([base, *rows])
    names = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, (v * s).tolist()) for n, v, s in zip(names, x, rng.uniform(0.1, 50, len(x)))], "chunk_id string, vector array<float>")
    got = {}
    for r in N.similar(df).collect():
        got.setdefault(r["chunk_id"], set()).add(r["neighbour"])
    want = _brute(names, x, 10, 0.94)
    pairs = sum(len(v) for v in want.values())
    assert sum(len(got.get(n, set()) & set(v)) for n, v in want.items()) / pairs >= 0.95
    assert all(got[n] <= set(want[n]) or set(want[n]) - got[n] for n in got)


def test_copies_dirt_and_ties(spark):
    v, w = [1.0] * 64, [1.0] * 63 + [1.2]
    rows = [(f"c{i:03d}", [3.0 * a for a in v]) for i in range(40)] + [("c000", v), ("near", w), (None, v), ("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), ("hole", [None] + [1.0] * 63), ("alone", [1.0, -1.0] * 32), ("huge", [1e38] * 63 + [-1e38])]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>").withColumnRenamed("vector", "vector")
    got = {}
    for r in N.similar(df).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    assert got["c000"] == [f"c{i:03d}" for i in range(1, 11)] and got["c020"] == [f"c{i:03d}" for i in range(10)]
    assert got["near"] == [f"c{i:03d}" for i in range(10)] and "alone" not in got and "huge" in got
    assert set(got) == {f"c{i:03d}" for i in range(40)} | {"near", "huge"}
    assert N.similar_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [10, 200_000, 2_000_000, 20_000_000, 200_000_000, 2_000_000_000])
def test_success_at_the_radius_at_any_size(rows):
    """On other random pairs than those the tables were chosen on."""
    how = N.Hashing().for_rows(rows)
    assert how.hashes == 11 + max(0, round(np.log2(rows / 200_000))) and len(how.probe_sets()) == how.probes
    assert N.found_share(replace(how, seed=99), 12_000)[-1] >= 0.976  # 0.98 less three deviations of the estimate


def test_dense_cells_are_compared_in_blocks():
    rng = np.random.default_rng(4)
    x = rng.standard_normal(64) + 0.02 * rng.standard_normal((700, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    stored, looked = N.hash_entries(x, np.arange(700, dtype="u8"), N.Hashing())
    whole, none = N.match_shard(stored, looked, N.Hashing())
    light, heavy = N.match_shard(stored, looked, N.Hashing(), dense=10_000)
    blocks = [N.compare(a, b, np.zeros(len(b), "i8"), np.full(len(b), len(a)), N.Hashing()) for a, b in heavy]
    assert not none and len(heavy) > 20 and max(len(a) for a, _ in heavy) <= 100
    assert len(whole) == 700 * 699 // 2 and {tuple(p) for p in np.concatenate([light, *blocks])} == {tuple(p) for p in whole}


def test_a_shard_is_a_task(spark):
    places = N.shard_places(37)
    df = spark.createDataFrame([(int(p), i) for i, p in enumerate(places)], "shard int, n int").repartition(37, "shard")
    assert {(r["n"], r["p"]) for r in df.selectExpr("n", "spark_partition_id() as p").collect()} == {(i, i) for i in range(37)}


def test_exact_search_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"v{i:04d}" for i in range(len(x))]
    rows = [(n, v.tolist()) for n, v in zip(names, x)]
    df = spark.createDataFrame([*rows, *rows[:50], (None, rows[0][1]), ("bad", [1.0]), ("zero", [0.0] * 64)], "chunk_id string, vector array<float>").repartition(5)
    asked = df.where("chunk_id is null or substring(chunk_id, 5, 1) = '0' or chunk_id in ('bad', 'zero')")
    got = {}
    for r in N.nearest(df, asked, at_once=40, block=7).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour"])
    want = _brute(names, x, 10, -1)
    assert got == {n: want[n] for n in names if n[4] == "0"}
    assert N.nearest(df, asked.where("false")).count() == 0
