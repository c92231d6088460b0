import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import encoding as E

PATH = f"{E.TOKENIZER_DIR}/byte_bpe_50k.json"
if not os.path.exists(PATH):
    pytest.skip("no vocabulary files here", allow_module_level=True)
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=80), st.text("abeo -=\n\t'", max_size=120), st.text("ing the", max_size=60)))
@settings(max_examples=300, deadline=None)
def test_same_ids(reference, text):
    assert E.encoder(PATH).encode(text) == reference(text)


def test_every_character(reference):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 2048):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in points[k : k + 2048])
        assert E.encoder(PATH).encode(text) == reference(text)


def test_table(spark, reference):
    texts = {1: "Hello  world", 2: "", 3: None, 4: "<|endoftext|> x", 5: "é" * 3000, 6: "a" * 20_000, 7: "‮\x00﻿🙂👍🏽"}
    df = spark.createDataFrame([(k, t, [9]) for k, t in texts.items()], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in E.encode_texts(df).collect()}
    assert got == {k: reference(t) if t else [] for k, t in texts.items()}
    assert E.encode_texts(df.where("false")).count() == 0
