import random

import numpy as np

from heronry.llm import leakage as L

QUERY = "How many skeins of ochre ferry does the harbour board of Abreleth owe once Gryandor redeems it"
ANSWER = "It is the blunt canopy of Gryandor which unloads two hundred hogsheads first beneath the clock tower"
PASSAGE = "No spare almanac may leave Abreleth just as many hogsheads remain and a silent chisel ransoms the oldest form of all the papers kept by clerks in the northern pier house during winter"
GOLD = "id string, query string, answer string, passage string, expected array<string>"


def _holds(texts, spark):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    gold = spark.createDataFrame([("g1", QUERY, ANSWER, PASSAGE, None), ("g1", QUERY, ANSWER, PASSAGE, None), ("short", "Why so?", "78", None, None), (None, "a b c d e f", None, None, None)], GOLD)
    filler = [(1000 + i, f"We swapped the filter cartridge number {i} and the fault came back after some hours of the shift.", "x") for i in range(60)]
    df = spark.createDataFrame(rows + filler, "doc_id long, text string, item_id string")
    return {r["doc_id"] for r in L.leaks(df, gold).collect()}


def test_leaks(spark):
    w = PASSAGE.split()
    filler = "The drive belt is checked every week by the clerk. " * 30
    texts = [
        QUERY, f"{filler}{ANSWER.upper()}{filler}", " ".join(w[3:18]), " ".join(w[3:17]), " ".join([*w[3:9], "changed", *w[10:19]]), " ".join(w[3:9] + w[10:20]), " ".join([*w[3:6], "x", "y", "z", "q", *w[10:18]]),
        "<p>" + "</p><b>".join(w[2:20]), "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, 24, 4)), "​".join(" ".join(w[:20])), '{"query": "' + QUERY + '"}', filler, None, "", " ", "Why so? 78", "Abreleth and Gryandor met at the northern pier with the silent chisel and a blunt canopy.",
        "word " * 20_000 + " ".join(w[:16]),
    ]
    assert _holds(texts, spark) == {0, 1, 2, 4, 5, 7, 8, 9, 10, 15, 17}  # 15: the whole query "Why so?"


def test_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    gold = spark.createDataFrame([], GOLD)
    assert L.leaks(docs, gold).count() == 0 and L.leaks(docs.where("false"), spark.createDataFrame([("g", QUERY, None, None, None)], GOLD)).count() == 0


def test_edits_against_the_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in "xy")
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert L.edits(a, b) == min(row)


def test_svd_finds_the_row_space(spark):
    rng = np.random.default_rng(1)
    low = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 20))
    q = L.randomised_svd(spark, [(np.arange(20), r) for r in low], 20, 8)
    assert np.allclose(low @ q @ q.T, low, atol=1e-6)


def test_short_texts_are_searched(spark):
    gold = spark.createDataFrame([("g", "Who pays?", "The harbour board does", None, None)], GOLD)
    texts = ["In short: the HARBOUR board, does.", "The harbour board never does.", "Ask him: who pays", "who also pays", "The pump runs."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in L.leaks(df, gold).collect()} == {0, 2}


def test_every_copy_holds_a_key_word():
    """Whatever word in eight is changed, a copy keeps enough of the words by which windows are chosen."""
    rng = random.Random(3)
    words = [rng.randrange(40) for _ in range(60)]
    items = L.Items(["g"], [{"query": words[:20], "answer": words[20:29], "passage": words}], {i: i for i in range(40)}, [(0, "query", 0, 20), (0, "answer", 0, 9), (0, "passage", 0, 15)], [])
    keys = L.key_words(items, np.array([rng.randrange(9) for _ in range(40)]))
    for part in (words[:20], words[20:29], *(words[a : a + 15] for a in range(46))):
        for _ in range(50):
            lost = rng.sample(range(len(part)), len(part) // 8)
            assert sum(keys[w] for i, w in enumerate(part) if i not in lost) >= L.LEFT
