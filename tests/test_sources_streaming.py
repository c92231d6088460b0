import pytest
from pyspark.sql import functions as F

from heronry.sources import documents, store
from heronry.streaming import state


def _chunks(spark, rows):
    return spark.createDataFrame(rows, store.SCHEMA)


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    marker = store.Marker("model-a", 2)
    first = _chunks(spark, [([3.0, 4.0], "t", "a_0", "a", 0, None), ([float("nan"), 1.0], "t", "a_1", "a", 1, "{}"), ([1.0], "t", "a_2", "a", 2, "{}"), ([1.0, 0.0], None, "b_0", "b", None, "{}")])
    store.upsert(spark, path, first, marker)
    got = {r["chunk_id"]: r for r in store.read_chunks(spark, path).collect()}
    assert sorted(got) == ["a_0", "b_0"] and [round(x, 6) for x in got["a_0"]["vector"]] == [0.6, 0.8]
    assert got["b_0"]["text"] == "" and got["b_0"]["chunk_index"] == -1 and got["a_0"]["metadata"] == "{}"
    store.upsert(spark, path, _chunks(spark, [([0.0, 2.0], "new", "a_9", "a", 0, "{}")]), marker)
    assert sorted(r["chunk_id"] for r in store.read_chunks(spark, path).collect()) == ["a_9", "b_0"]
    assert store.read_marker(spark, path) == marker
    with pytest.raises(store.EmbedderMismatchError):
        store.upsert(spark, path, first, store.Marker("model-b", 2))
    with pytest.raises(store.EmbedderMismatchError):
        store.check_marker(marker, "model-a", 3)
    assert store.check_marker(None, "any") is False
    assert store.drop_store(spark, path) and store.read_marker(spark, path) is None


def test_newest_version_counts_once(spark):
    m = '{"metadata": {"indexed_at": "%s"}}'
    rows = _chunks(spark, [([1.0], "t", "a", "d", 0, m % "2025-01-01"), ([1.0], "t", "a", "d", 0, m % "2026-01-01"), ([1.0], "t", "a", "d", 0, "{bad"), ([1.0], "t", None, "d", 0, None), ([1.0], "t", None, "d", 0, None)])
    out = store.one_per_chunk(rows).collect()
    assert len(out) == 3 and [r["metadata"] for r in out if r["chunk_id"] == "a"] == [m % "2026-01-01"]


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "x" / "a.md").write_text("# B")
    (tmp_path / "n.txt").write_text("plain")
    (tmp_path / "p.html").write_text("<head><title>t</title></head><p>One &amp; two</p><script>x()</script>three")
    (tmp_path / "q.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"1")
    got = {r["document_id"]: r["markdown"] for r in documents.read_files(spark, str(tmp_path)).collect()}
    second = [k for k in got if k.startswith("a.md#")]
    assert len(second) == 1 and {got["a.md"], got[second[0]]} == {"# A", "# B"}
    assert got["n.txt"] == "```\nplain\n```" and got["p.html"] == "One & two\nthree" and got["q.pdf"] is None and "skip.bin" not in got
    gold = tmp_path / "g.jsonl"
    gold.write_text('// note\n\n{"id": "b", "expected": ["x"]}\n{"id": "a", "query": "q"}\n')
    assert [r["id"] for r in documents.read_gold(spark, [str(gold)]).collect()] == ["a", "b"]
    lines = tmp_path / "o.jsonl"
    lines.write_text('{"doc_id": "a", "overview": "old"}\n{bad\n{"doc_id": "a", "overview": "new"}\n{"doc_id": "b", "overview": " "}\n')
    assert [(r["doc_id"], r["overview"]) for r in store.read_overviews(spark, [str(lines)]).collect()] == [("a", "new")]
    job = tmp_path / "job.json"
    job.write_text('{"index_name": "i", "documents": ["%s", "/no/such"]}' % gold)
    assert documents.read_batch_job(str(job))[1] == ["/no/such"]


def _stream(spark, tmp_path, name, frames):
    folder = tmp_path / name
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(df, name, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_history_is_capped(spark, tmp_path):
    frames = [spark.createDataFrame([("s", "user", f"m{b}{i}") for i in range(3)], "session_id string, role string, content string") for b in range(3)]
    _run(state.capped_history(_stream(spark, tmp_path, "h", frames), 4), "hist", tmp_path, "update")
    assert spark.table("hist").agg(F.max("turns")).first()[0] == 4


def test_cache_expires(spark, tmp_path):
    rows = [("k", "2026-01-01 00:00:00", "one"), ("k", "2026-01-01 00:04:00", "two"), ("k", "2026-01-01 00:06:00", "three"), ("z", "2026-01-01 00:06:00", "other")]
    df = spark.createDataFrame(rows, "key string, t string, value string").select("key", F.col("t").cast("timestamp").alias("at"), "value")
    _run(state.expiring_cache(_stream(spark, tmp_path, "c", [df])), "cache", tmp_path, "append")
    got = [(r["key"], r["answer"], r["hit"]) for r in spark.table("cache").orderBy("key", "at").collect()]
    assert got == [("k", "one", False), ("k", "one", True), ("k", "three", False), ("z", "other", False)]


def test_stream_upserts(spark, tmp_path):
    frames = [_chunks(spark, [([1.0, 0.0], t, f"a_{t}", "a", 0, "{}")]) for t in ("one", "two")]
    q = state.upsert_stream(_stream(spark, tmp_path, "u", frames), str(tmp_path / "store"), store.Marker("m", 2), str(tmp_path / "st")).start()
    q.awaitTermination()
    assert store.read_chunks(spark, str(tmp_path / "store")).count() == 1


def test_a_failed_upsert_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path, marker = str(tmp_path / "s"), store.Marker("m", 1)
    row = lambda d, t: _chunks(spark, [([1.0], t, f"{d}_0", d, 0, "{}")])
    ids = lambda: sorted((r["document_id"], r["text"]) for r in store.read_chunks(spark, path).collect())
    store.upsert(spark, path, row("a", "one"), marker)
    store.upsert(spark, path, row("b", "one"), marker)
    publish = store._publish
    for stop in ("before", "draft"):
        def fail(spark_, path_, names, stop=stop):
            if stop == "draft":
                (tmp_path / "s" / "_versions" / ".draft-left").write_text("{")
            raise OSError("the writer died")

        monkeypatch.setattr(store, "_publish", fail)
        with pytest.raises(OSError):
            store.upsert(spark, path, row("a", "lost"), marker)
        monkeypatch.setattr(store, "_publish", publish)
        assert ids() == [("a", "one"), ("b", "one")]
    store.upsert(spark, path, row("c", "one"), marker)
    assert ids() == [("a", "one"), ("b", "one"), ("c", "one")]


def test_an_upsert_writes_its_rows_only(spark, tmp_path):
    path, marker = str(tmp_path / "s"), store.Marker("m", 1)
    big = _chunks(spark, [([1.0], "text " * 50, f"d{i}_0", f"d{i}", 0, "{}") for i in range(3000)])
    store.upsert(spark, path, big, marker)
    size = lambda: {p: p.stat().st_size for p in (tmp_path / "s" / "data").rglob("*.parquet")}
    before = size()
    store.upsert(spark, path, _chunks(spark, [([1.0], "new", "d7_0", "d7", 0, "{}")]), marker)
    after = size()
    assert set(before) <= set(after) and sum(n for p, n in after.items() if p not in before) < 10_000
    assert store.read_chunks(spark, path).count() == 3000 and store.read_chunks(spark, path).where("document_id = 'd7'").first()["text"] == "new"
    for i in range(4):
        store.upsert(spark, path, _chunks(spark, [([1.0], f"v{i}", "d8_0", "d8", 0, "{}"), ([1.0], "x", None, None, 0, "{}")]), marker, compact_after=3)
    rows = store.read_chunks(spark, path)
    assert rows.where("document_id = 'd8'").first()["text"] == "v3" and rows.where("document_id is null").count() == 4 and rows.count() == 3004
    assert len(store.segments(spark, path)) <= 3 and len(store.versions(spark, path)) == 2
    store.delete_documents(spark, path, ["d8", "d9"])
    assert store.read_chunks(spark, path).count() == 3002
    with pytest.raises(ValueError):
        store.delete_documents(spark, path, ["d1", "x' or '1'='1"])
    assert store.search_rows(spark, str(tmp_path / "none")) is None and store.search_rows(spark, path) is not None


def test_the_last_appended_overview_wins(spark, tmp_path):
    path = str(tmp_path / "o")
    for i in (3, 9, 1, 5, 2):
        store.append_overviews(spark.createDataFrame([("d", f"{i} " * i * 40), (f"e{i}", "x")], "doc_id string, overview string").repartition(2), path)
    got = {r["doc_id"]: r["overview"] for r in store.read_overviews(spark, [path]).collect()}
    assert got["d"].startswith("2 ") and len(got) == 6


def test_overview_vectors(spark, tmp_path):
    from heronry.models import hashing_embedder

    o = spark.createDataFrame([("a", "pumps and valves"), ("b", "leave and pay")], "doc_id string, overview string")
    path = str(tmp_path / "o.vectors")
    store.write_overview_vectors(o.where("doc_id = 'a'"), path, hashing_embedder(8))
    assert [r["doc_id"] for r in store.read_overview_vectors(spark, path).collect()] == ["a"]
    both = {r["doc_id"]: r["vector"] for r in store.read_overview_vectors(spark, path, hashing_embedder(8), o).collect()}
    assert set(both) == {"a", "b"} and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in both.values())
    assert store.read_overview_vectors(spark, str(tmp_path / "no")).count() == 0


def test_bounded_cache_keeps_the_newest(spark, tmp_path):
    rows = [("s", f"k{i % 5}", f"2026-01-01 00:00:{i:02d}", f"v{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "session_id string, key string, t string, value string").select("session_id", "key", F.col("t").cast("timestamp").alias("at"), "value")
    _run(state.bounded_cache(_stream(spark, tmp_path, "b", [df]), most=4), "bounded", tmp_path, "append")
    got = [(r["key"], r["answer"], r["hit"], r["entries"]) for r in spark.table("bounded").orderBy("at").collect()]
    assert got[4] == ("k4", "v4", False, 4) and got[5] == ("k0", "v5", False, 4) and max(g[3] for g in got) == 4
    frames = [spark.createDataFrame([("k", t, v)], "key string, t string, value string").select("key", F.col("t").cast("timestamp").alias("at"), "value") for t, v in (("2026-01-01 00:00:00", "a"), ("2026-01-01 02:00:00", "b"), ("2026-01-01 02:00:01", "c"))]
    _run(state.expiring_cache(_stream(spark, tmp_path, "x", frames)), "expired", tmp_path, "append")
    assert [(r["answer"], r["hit"]) for r in spark.table("expired").orderBy("at").collect()] == [("a", False), ("b", False), ("b", True)]


def test_remembered_vectors():
    import numpy as np

    from heronry.models import hashing_embedder, remembering

    asked: list[str] = []

    def embed(texts):
        asked.extend(texts)
        return hashing_embedder(8)(texts)

    kept = remembering(embed, most=2)
    a = kept(["x", "y", "x"])
    b = kept(["y", "z", "x"])
    assert asked == ["x", "y", "z"] and np.array_equal(a[1], b[0]) and np.array_equal(a[0], b[2])
