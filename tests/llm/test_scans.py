from heronry.llm import scans as S

CLEAN = "Tighten all screws of the filter cartridge and repeat the long-term check of the bearing housing."


def test_skeletons():
    for wrong, right in (("exp0se", "expose"), ("favlt", "fault"), ("periocl", "period"), ("unknovvn", "unknown"), ("rnilliseconds", "milliseconds"), ("variarit", "variant"), ("turrio", "turno"), ("apparei1", "appareil"), ("st|ll", "still"), ("stew@rd", "steward"), ("gleicbwertiges", "gleichwertiges"), ("reqelt", "regelt")):
        assert S.skeleton(wrong) == S.skeleton(right), wrong
    assert S.skeleton("pump") != S.skeleton("valve")


def _corpus(spark, extra):
    rows = [(f"c{i}", f"{i % 5:05d}_acme_k9_service_manual.pdf", f"{CLEAN} The on-site and follow-up settings stay.", '{"metadata": {"page": %d}}' % (i % 9 + 1)) for i in range(300)]
    return spark.createDataFrame(rows + extra, "chunk_id string, document_id string, text string, metadata string")


EXTRA = [
    ("hyphen", "00001_acme_k9_service_manual.pdf", "Tighten all screws of the filter cart-\nridge and repeat the long-term\ncheck of the bearing housing.", '{"page": 3}'),
    ("compound", "d.pdf", "Tighten all screws of the filter cartridge. The on-site and follow-\nup settings stay.", '{"page": 3}'),
    ("misread", "d.pdf", "Tighten all scrcws of the f1lter cartridge and repeat the long-term check.", None),
    ("head", "00001_acme_k9_service_manual.pdf", "Tighten all screws of the filter\nACME K9 SERVICE MANUAL    3\ncartridge and repeat the long-term check.", '{"metadata": {"page": 3}}'),
    ("page", "d.pdf", "Tighten all screws of the filter\n- 12 -\ncartridge and repeat the long-term check.", '{"metadata": {"page": 12}}'),
    ("table", "d.pdf", "Filter values\n12\n3.5 bar\n4\n7 bar\nTighten all screws.", '{"metadata": {"page": 12}}'),
    ("null", "d.pdf", None, None), ("empty", None, "", "{bad"), ("long", None, "x" * 50_000, "{bad"), (None, None, "Tighten all screws of the filter cart-\nridge.", None),
]


def test_noise_and_repair(spark):
    df = _corpus(spark, [*EXTRA, EXTRA[0]])
    got = {}
    for r in S.scan_noise(df).collect():
        got.setdefault(r["chunk_id"], set()).add(r["noise"])
    assert got == {"hyphen": {"hyphen"}, "misread": {"misread"}, "head": {"header", "page_number"}, "page": {"page_number"}, None: {"hyphen"}}
    text = {r["chunk_id"]: r["text"] for r in S.repaired(df).collect()}
    assert text["hyphen"] == text["c0"].split(" The on-site")[0] == CLEAN
    assert text["misread"] == "Tighten all screws of the filter cartridge and repeat the long-term check."
    assert text["head"] == text["page"] == "Tighten all screws of the filter cartridge and repeat the long-term check."
    assert text["null"] == text["empty"] == "" and text["long"] == "x" * 50_000
    assert len(text) == 300 + len(EXTRA)


def test_empty(spark):
    df = _corpus(spark, []).where("false")
    assert S.scan_noise(df).count() == 0 and S.repaired(df).count() == 0


def test_rare_words_count_in_a_large_corpus(spark):
    filler = " ".join(["alpha beta gamma delta"] * 1000)
    rows = [(f"f{i}", None, filler, None) for i in range(1000)]  # four million words: one occurrence in a million is four
    rows += [(f"n{i}", "d.pdf", "Ask the Tarnhollow desk.", None) for i in range(3)] + [("bad", "d.pdf", "Ask the Tarnho11ow desk.", None)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, metadata string")
    assert [tuple(r) for r in S.scan_noise(df).collect()] == [("bad", "misread")]
    assert {r["text"] for r in S.repaired(df.where("document_id is not null")).collect()} == {"Ask the Tarnhollow desk."}


def test_lost_letters_and_context(spark):
    rows = [(f"c{i}", "d.pdf", "Expose the bearing housing before repair.", None) for i in range(40)]
    rows += [("lost", "d.pdf", "Expose the bea¬ing housing before repair.", None), ("alpha", "d.pdf", "Expose the bcaring housing before repair.", None), ("alone", "d.pdf", "Bcaring.", None)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string, metadata string")
    assert {r["chunk_id"] for r in S.scan_noise(df).collect()} == {"lost", "alpha"}
