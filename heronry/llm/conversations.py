"""Message rows back into conversations, and the sessions that have to be left out.

The reply graph of a session has an edge from the message a reply names (the JSON
field ``reply_to`` of ``metadata``, where given) to the reply.  A message that names
none answers the one before it by the clock, unless that is older than it by its own
link: an edge from neighbour to neighbour.  The graph is sorted with Kahn's algorithm,
the earliest ready message first (instant, user before assistant, id).

Sessions of any length are spread by :mod:`heronry.operators.ordered`.  Links cross
a border between two slices only forwards, but for the stretches in which a reply is
older than what it answers (a "tangle"): these are sorted as a whole first, and what
the queue leaves over there lies on or behind a cycle.  Then each task runs the queue
over its slice of every session and summarises it as a segment (first and last role,
whether two of a kind follow each other), and the segments of a session, at most one
per task, are put together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.messages import tagged
from heronry.operators.ordered import sorted_slices
from heronry.session import cut_lineage

ORDER = ["o_instant", "o_rank", "o_tangle", "id"]


def kahn(keys: list, edges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Positions in topological order, the smallest key first among the ready, and the positions left over.

    ``edges`` are (before, after).  Left over are the nodes on a cycle and those behind one.
    """
    after: dict[int, list[int]] = {}
    waits = [0] * len(keys)
    for a, b in set(edges):
        after.setdefault(a, []).append(b)
        waits[b] += 1
    ready = [(keys[i], i) for i, n in enumerate(waits) if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, i = heapq.heappop(ready)
        out.append(i)
        for j in after.get(i, ()):
            waits[j] -= 1
            if waits[j] == 0:
                heapq.heappush(ready, (keys[j], j))
    done = set(out)
    return out, [i for i in range(len(keys)) if i not in done]


def _by_replies(pdf: pd.DataFrame) -> pd.DataFrame:
    """A sorted slice in the order of Kahn's queue: in each session a message waits for the one before it, which it answers."""
    s = pdf["session_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    order: list[int] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)]):
        queued, _ = kahn(list(range(b - a)), [(i, i + 1) for i in range(b - a - 1)])
        order += [a + i for i in queued]
    return pdf.iloc[order]


def _untangle(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["instant", "rank", "id"], kind="stable").reset_index(drop=True)
    at = {x: i for i, x in enumerate(group["id"])}
    edges = [(at[p], at[c]) for c, ps in zip(group["id"], group["parents"]) for p in (ps if ps is not None else ()) if p in at]
    order, left = kahn(list(range(len(group))), edges)
    place = np.empty(len(group), dtype="int64")
    place[order + left] = np.arange(len(group))
    return group.assign(o_tangle=place + 1, cyclic=np.isin(np.arange(len(group)), left))[["session_id", "id", "start_instant", "start_rank", "o_tangle", "cyclic"]]


def ordered_keys(rows: DataFrame, messages: DataFrame, reply_field: str = "reply_to") -> DataFrame:
    """``rows`` (of :func:`tagged`, with role and instant) plus the columns of ORDER and ``cyclic``.

    A link to an unknown message, to another session or to itself does not count.
    """
    rank = F.when(F.col("role") == "user", 0).otherwise(1)
    rows = rows.withColumn("rank", rank)
    links = (
        messages.where(F.col("session_id").isNotNull() & F.col("metadata").contains(reply_field))
        .select("session_id", F.col("id").alias("child"), F.get_json_object("metadata", f"$.{reply_field}").alias("parent"))
        .where("parent is not null and parent <> child")
        .distinct()
    )
    key = lambda p: F.struct(F.col(f"{p}.instant"), F.col(f"{p}.rank"), F.col(f"{p}.id"))
    backward = (
        links.alias("l")
        .join(rows.alias("c"), (F.col("c.session_id") == F.col("l.session_id")) & (F.col("c.id") == F.col("l.child")))
        .join(rows.alias("p"), (F.col("p.session_id") == F.col("l.session_id")) & (F.col("p.id") == F.col("l.parent")))
        .select("l.session_id", "l.child", "l.parent", key("c").alias("lo"), key("p").alias("hi"))
    )
    backward = cut_lineage(backward)
    crossed = backward.where("hi > lo")
    if crossed.isEmpty():
        return rows.select("*", F.col("instant").alias("o_instant"), F.col("rank").alias("o_rank"), F.lit(0).cast("long").alias("o_tangle"), F.lit(False).alias("cyclic"))
    by_start = Window.partitionBy("session_id").orderBy("lo")
    reach = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = crossed.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("n", F.sum("new").over(by_start))
    spans = spans.groupBy("session_id", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = F.struct("r.instant", "r.rank", "r.id")
    inside = rows.alias("r").join(spans.alias("s"), (F.col("r.session_id") == F.col("s.session_id")) & (own >= F.col("s.lo")) & (own <= F.col("s.hi")))
    parents = backward.groupBy("session_id", F.col("child").alias("id")).agg(F.collect_set("parent").alias("parents"))
    inside = inside.select("r.session_id", "r.id", "r.instant", "r.rank", F.col("s.lo.instant").alias("start_instant"), F.col("s.lo.rank").alias("start_rank"), "s.n").join(parents, ["session_id", "id"], "left")
    sorted_out = inside.groupBy("session_id", "n").applyInPandas(_untangle, "session_id string, id string, start_instant long, start_rank int, o_tangle long, cyclic boolean")
    sorted_out = cut_lineage(sorted_out)
    return (
        rows.join(sorted_out, ["session_id", "id"], "left")
        .withColumn("o_instant", F.coalesce("start_instant", "instant"))
        .withColumn("o_rank", F.coalesce("start_rank", "rank"))
        .withColumn("o_tangle", F.coalesce("o_tangle", F.lit(0).cast("long")))
        .withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
        .drop("start_instant", "start_rank")
    )


_SEGMENT = "session_id string, f_instant long, f_rank int, f_tangle long, f_id string, l_instant long, l_rank int, l_tangle long, l_id string, first_rank int, last_rank int, uu boolean, aa boolean, n long"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per session and slice; a session that goes on in the next batch is carried over."""
    open_ = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        pdf = _by_replies(pdf)
        s, r = pdf["session_id"].to_numpy(), pdf["rank"].to_numpy()
        new = np.r_[True, s[1:] != s[:-1]]
        same = ~new
        uu, aa = np.r_[False, (r[1:] == 0) & (r[:-1] == 0)] & same, np.r_[False, (r[1:] == 1) & (r[:-1] == 1)] & same
        at = np.flatnonzero(new)
        end = np.r_[at[1:], len(s)] - 1
        out = pd.DataFrame({"session_id": s[at]})
        for p, i in (("f", at), ("l", end)):
            for c in ("instant", "rank", "tangle"):
                out[f"{p}_{c}"] = pdf[f"o_{c}"].to_numpy()[i]
            out[f"{p}_id"] = pdf["id"].to_numpy()[i]
        out["first_rank"], out["last_rank"] = r[at], r[end]
        out["uu"], out["aa"] = np.logical_or.reduceat(uu, at), np.logical_or.reduceat(aa, at)
        out["n"] = end - at + 1
        if open_ is not None:
            if open_["session_id"] == out.at[0, "session_id"]:
                for c in ("f_instant", "f_rank", "f_tangle", "f_id"):
                    out.at[0, c] = open_[c]
                out.at[0, "uu"] = bool(out.at[0, "uu"] or open_["uu"] or (open_["last_rank"] == 0 and out.at[0, "first_rank"] == 0))
                out.at[0, "aa"] = bool(out.at[0, "aa"] or open_["aa"] or (open_["last_rank"] == 1 and out.at[0, "first_rank"] == 1))
                out.at[0, "n"] += open_["n"]
                out.at[0, "first_rank"] = open_["first_rank"]
            else:
                yield pd.DataFrame([open_])
        open_ = out.iloc[-1].to_dict()
        yield out.iloc[:-1]
    if open_ is not None:
        yield pd.DataFrame([open_])


def session_reasons(messages: DataFrame, sessions: DataFrame, reply_field: str = "reply_to") -> DataFrame:
    """(session_id, reason): every session with null (kept) or why it is left out.

    ``empty``: no non-blank message.  ``broken``: not in ``sessions``, a non-blank message
    without role or instant, the first is no user's, two assistant messages in a row, or a
    cycle of reply links.  ``missing_reply``: two user messages in a row, or the last is a user's.
    Rows without ``session_id`` are ignored; repeated rows count once; empty tables give no rows.
    """
    rows = cut_lineage(tagged(messages).where(~F.col("blank")).distinct())  # read by the sort, its sampling and the counts
    usable = rows.where("role is not null and instant is not null")
    keyed = ordered_keys(usable, messages, reply_field)
    segments = sorted_slices(keyed.select("session_id", "rank", *ORDER), ["session_id", *ORDER]).mapInPandas(_segments, _SEGMENT)
    w = Window.partitionBy("session_id").orderBy("f_instant", "f_rank", "f_tangle", "f_id", "l_instant", "l_rank", "l_tangle", "l_id")
    flows = (
        segments.withColumn("prev", F.lag("last_rank").over(w))
        .groupBy("session_id")
        .agg(
            F.max(F.col("uu") | F.coalesce((F.col("prev") == 0) & (F.col("first_rank") == 0), F.lit(False))).alias("uu"),
            F.max(F.col("aa") | F.coalesce((F.col("prev") == 1) & (F.col("first_rank") == 1), F.lit(False))).alias("aa"),
            F.min_by("first_rank", F.struct("f_instant", "f_rank", "f_tangle", "f_id")).alias("first"),
            F.max_by("last_rank", F.struct("l_instant", "l_rank", "l_tangle", "l_id")).alias("last"),
        )
    )
    cyclic = keyed.where("cyclic").select("session_id").distinct().withColumn("cyclic", F.lit(True))
    odd = rows.groupBy("session_id").agg(F.max(F.col("role").isNull() | F.col("instant").isNull()).alias("odd"))
    known = sessions.where("id is not null").select(F.col("id").alias("session_id")).distinct().withColumn("known", F.lit(True))
    named = messages.where("session_id is not null").select("session_id").distinct()
    joined = known.join(named, "session_id", "full_outer").join(odd, "session_id", "left").join(flows, "session_id", "left").join(cyclic, "session_id", "left")
    broken = F.col("known").isNull() | F.col("odd") | (F.col("first") == 1) | F.col("aa") | F.coalesce("cyclic", F.lit(False))
    reason = F.when(F.col("odd").isNull(), "empty").when(broken, "broken").when(F.col("uu") | (F.col("last") == 0), "missing_reply")
    return joined.select("session_id", reason.alias("reason"))


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the place of each row in its session within the slice, and the first row's key as the segment's name."""
    last, n, head = None, 0, None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        pdf = _by_replies(pdf).reset_index(drop=True)
        s = pdf["session_id"].to_numpy()
        new = np.r_[last is None or s[0] != last, s[1:] != s[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        local = np.where(at >= 0, np.arange(len(s)) - at, np.arange(len(s)) + n)
        names = np.array([f"{a}|{b}|{c}|{d}" for a, b, c, d in zip(*(pdf[c] for c in ORDER))], dtype=object)
        segment = np.where(at >= 0, names[np.maximum(at, 0)], head)
        last, n, head = s[-1], int(local[-1]) + 1, segment[-1]
        yield pdf.assign(local=local, segment=segment)


def rebuild_conversations(messages: DataFrame, sessions: DataFrame, reply_field: str = "reply_to") -> DataFrame:
    """Turns of the sessions that are kept: (session_id, turn from 1, message_id, role, instant, content).

    Blank messages are set aside; a message delivered twice comes out once.
    """
    kept = session_reasons(messages, sessions, reply_field).where("reason is null").select("session_id")
    rows = cut_lineage(tagged(messages).where("not blank and role is not null and instant is not null").distinct())
    keyed = ordered_keys(rows, messages, reply_field).join(kept, "session_id", "left_semi")
    text = messages.where("session_id is not null").select("id", "session_id", "content", F.xxhash64("content").alias("content_hash")).dropDuplicates(["id", "session_id", "content_hash"])
    full = keyed.select("session_id", "role", "instant", "content_hash", *ORDER).join(text, ["session_id", "id", "content_hash"])
    columns = full.select("session_id", *ORDER, "role", "instant", "content")
    sliced = sorted_slices(columns, ["session_id", *ORDER]).mapInPandas(
        _positions, "session_id string, o_instant long, o_rank int, o_tangle long, id string, role string, instant long, content string, local long, segment string"
    )
    sliced = cut_lineage(sliced)  # read twice: the borders of the slices must be the same both times
    parts = sliced.groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("k"))
    before = F.sum("n").over(Window.partitionBy("session_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("session_id", "segment", F.coalesce(before, F.lit(0)).alias("offset"))
    return sliced.join(offsets, ["session_id", "segment"]).select(
        "session_id", (F.col("offset") + F.col("local") + 1).alias("turn"), F.col("id").alias("message_id"), "role", F.timestamp_micros("instant").alias("instant"), "content"
    )
