import random

import numpy as np

from heronry.plans.catalogue import QUERIES


def test_every_row_is_probed_against_every_row(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["query_id"]: r["entry"] for r in QUERIES["semantic_cache_probe_all"](spark, str(tmp_path)).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {i: min(j for j in range(200) if j % 3 == i % 3 and unit[i] @ unit[j] >= 0.6) for i in range(200)}
    assert got == want
