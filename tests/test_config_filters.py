import pytest

from heronry.config import ConfigError, profile
from heronry.operators.filters import FilterError, combined, compile_filter


def test_profiles_and_merge():
    assert profile("default").retrieval_k == 20 and profile("default").rerank_min_score == 0.5
    assert profile("fast").search_type == "vector_only" and not profile("fast").rerank
    merged = profile("default", {"retrieval_k": 5, "rerank": None}, {"retrieval_k": 7})
    assert merged.retrieval_k == 7 and merged.rerank
    assert profile("default", {"search_type": "odd"}).search_type == "hybrid"
    for bad in ({"nope": 1}, {"retrieval_k": "5"}, {"retrieval_k": True}):
        with pytest.raises(ConfigError):
            profile("default", bad)


@pytest.mark.parametrize(
    "spec",
    [{}, [], "x", {"title": "a"}, {"document_id": ""}, {"document_id": "a'b"}, {"document_id": "a\nb"}, {"document_id": "x" * 257}, {"document_id": {"gt": "a"}}, {"document_name": {"eq": "a"}}, {"document_id": {}},
     {"chunk_index": "3"}, {"chunk_index": True}, {"chunk_index": 2**31}, {"chunk_index": {"in": []}}, {"chunk_index": {"in": list(range(257))}}, {"document_id": 5}],
)
def test_refused_filters(spec):
    with pytest.raises(FilterError):
        compile_filter(spec)


def test_filters(spark):
    rows = spark.createDataFrame([("a_1", "a.pdf", 1), ("a_2", "a.pdf", 2), ("b_1", "b_%.pdf", 1), (None, None, None)], "chunk_id string, document_id string, chunk_index int")
    ids = lambda f: sorted(r[0] for r in f.apply(rows).collect())
    assert compile_filter(None) is None
    assert ids(compile_filter({"document_id": "a.pdf"})) == ["a_1", "a_2"]
    assert ids(compile_filter({"document_name": {"contains": "_%"}})) == ["b_1"]
    assert ids(compile_filter({"chunk_index": {"gte": 1, "lt": 2}})) == ["a_1", "b_1"]
    assert ids(combined(compile_filter({"chunk_index": {"in": [2, 9]}}), None, compile_filter({"document_id": "a.pdf"}))) == ["a_2"]
    one, two = compile_filter({"chunk_index": 1, "document_id": "a"}), compile_filter({"document_id": {"eq": "a"}, "chunk_index": {"eq": 1}})
    assert one.signature == two.signature and compile_filter(one) is one
    assert combined(None, None) is None
