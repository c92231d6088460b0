import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import splitting as S

PARTS = st.lists(st.sampled_from(["word ", "A sentence ends here. ", "\n", "\n\n", "x" * 37, "\t", "Ende! ", "\r\n\r\n", "é"]), min_size=1, max_size=200)


@given(PARTS)
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(parts):
    text, limit, least, most = "".join(parts), 120, 8, 20
    pieces = S.split_text(text, limit, least, most)
    assert "".join(p[o:] for _, o, p in pieces) == text
    assert all(len(p) <= limit for _, _, p in pieces)
    for (_, _, before), (_, overlap, p) in zip(pieces, pieces[1:]):
        assert least <= overlap <= most and before.endswith(p[:overlap])


@pytest.mark.parametrize("text, kind", [(("a" * 700 + "\n\n") * 3, "paragraph"), ("a" * 700 + "\n \t\n" + "b" * 700, "paragraph"), (("a" * 700 + ". ") * 3, "sentence"), (("a" * 700 + "\n") * 3, "sentence"), (("a" * 700 + " ") * 3, "word"), ("a" * 1201, "none"), ("a" * 1300 + " b", "none"), ("\n" * 2000 + "a", "paragraph")])
def test_cut_class(text, kind):
    assert S.cut_class(text) == kind


def test_cuts_at_the_strongest_boundary():
    text = ("word " * 60).strip() + ".\n\n" + ("more " * 60).strip() + "."
    pieces = S.split_text(text, 400, 20, 60)
    assert len(pieces) == 2 and text[: pieces[1][0]].endswith(".\n\n")


def test_table(spark):
    schema = "chunk_id string, document_id string, chunk_index int, text string, cut string, piece int"
    long = "One sentence. " * 200
    rows = [("a", "d", 1, long, "x", 9), ("a", "d", 1, long, "x", 9), ("b", "d", 2, "short", "x", 9), ("c", "d", 3, None, "x", 9), ("e", "d", 4, "", "x", 9), (None, None, None, "z" * 5000, "x", 9)]
    got = S.split_oversized(spark.createDataFrame(rows, schema)).collect()
    a = sorted((r["piece"], r["text"][r["overlap"] :]) for r in got if r["chunk_id"] == "a")
    assert [n for n, _ in a] == list(range(1, len(a) + 1)) and "".join(t for _, t in a) == long
    assert {r["cut"] for r in got if r["chunk_id"] == "a"} == {"sentence"} and {r["cut"] for r in got if r["chunk_id"] is None} == {"none"} and {r["chunk_id"] for r in got} == {"a", None}
    assert S.split_oversized(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(spark.createDataFrame([], schema), limit=300, least=80, most=200)


def test_cut_class_against_splitting():
    """The bisection's answer is that of looking at every stretch."""
    import random

    from heronry.llm import splitting as S

    def plain(text, limit):
        body = text.strip(" \t\r\n")
        return next((n for n, p in S.LEVELS if all(len(s.strip(" \t\r\n")) <= limit for s in p.split(body))), "none")

    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "bb", ". ", "!\n", "\n\n", " ", "\t", "\r\n \r\n", "c" * 9]) for _ in range(rng.randint(1, 30)))
        for limit in (5, 9, 14):
            assert S.cut_class(s, limit) == plain(s, limit)
