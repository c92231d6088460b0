import random

import pytest

from heronry.llm import consensus as C

SCHEMA = "id string, requires_crossref boolean, voters array<string>, votes array<boolean>, majority_pass boolean, reasons array<string>, case_key string"


def _panel(spark, rows):
    return spark.createDataFrame([(i, None, w, v, m, None, "x") for i, w, v, m in rows], SCHEMA)


def test_skill_and_labels_are_learnt(spark):
    rng = random.Random(3)
    accuracy = {"a": 0.95, "b": 0.9, "c": 0.9, "d": 0.85, "coin": 0.5, "liar": 0.1}
    truth, rows = {}, []
    for i in range(400):
        truth[f"i:{i}"] = t = rng.random() < 0.5
        who = rng.sample(sorted(accuracy), 4)
        rows.append((str(i), who, [t if rng.random() < accuracy[w] else not t for w in who], None))
    items, voters, alpha = C.consensus({"i": _panel(spark, rows)})
    skill = {r["voter"]: r["skill"] for r in voters.collect()}
    assert skill["liar"] < -0.5 < skill["coin"] < min(skill[x] for x in "abcd") and abs(skill["coin"]) < 0.8
    rows = items.collect()
    right = sum(r["consensus"] == truth[r["case_key"]] for r in rows) / len(rows)
    plain = sum(r["majority"] == truth[r["case_key"]] for r in rows) / len(rows)
    assert right > 0.93 and right > plain and 0 < alpha < 1


def test_suspicious(spark):
    rows = [("1", ["a", "b", "c"], [True, True, False], True), ("1", ["a", "b", "c"], [True, True, False], True), ("2", ["a", "b"], [True, False], None), ("3", ["a", "b"], [True, False], True), ("4", ["a"], [None], False), ("5", [], [], None), ("6", None, None, None), ("7", ["c", None, "a"], [True, True, None], False), (None, ["a"], [True], False)]
    got = sorted((r["kind"], r["case_key"] or "") for r in C.suspicious({"g2": _panel(spark, rows)}).collect())
    assert got == sorted([("item", "g2:3"), ("item", "g2:4"), ("item", "g2:7"), ("item", ""), ("voter", "c")])
    assert C.suspicious({"i": _panel(spark, [])}).count() == 0
    with pytest.raises(ValueError):
        C.consensus({"i": _panel(spark, rows)}, max_annotators=1)


def test_agreement(spark):
    """Krippendorff's alpha by its definition, over pairs of votes."""
    rows = [("1", list("abc"), [True, True, False], None), ("2", list("ab"), [False, False], None), ("3", list("abcd"), [True, True, True, None], None), ("4", ["a"], [True], None), ("5", [], [], None)]
    r = C.agreement({"i": _panel(spark, rows)}).first()
    units = [[v for v in x[2] if v is not None] for x in rows]
    units = [u for u in units if len(u) > 1]
    flat = [v for u in units for v in u]
    within = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units) / len(flat)
    beyond = sum(a != b for i, a in enumerate(flat) for j, b in enumerate(flat) if i != j) / (len(flat) * (len(flat) - 1))
    assert abs(r["alpha"] - (1 - within / beyond)) < 1e-9 and (r["n_items"], r["n_votes"], r["n_voters"]) == (5, 9, 3)
    assert C.agreement({"i": _panel(spark, [])}).first()["alpha"] is None


def test_item_state_stands_still():
    import numpy as np

    rng = np.random.default_rng(1)
    item, who, vote, skill = np.repeat(np.arange(50), 5), rng.integers(0, 9, 250), rng.random(250) < 0.6, rng.normal(1, 1, 9)
    a = C._item_state(item, 50, who, vote, skill, 0.5)
    b = C._item_state(item, 50, who, vote, skill, 0.5, rounds=500)
    assert all(np.abs(x - y).max() < 1e-3 for x, y in zip(a, b))
