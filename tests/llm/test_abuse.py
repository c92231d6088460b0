import pytest

from heronry.llm import abuse as A

ABUSIVE = [
    "Shut up, you w o r t h l e s s m o r o n.", "Quit your job, mоrоn.", "What a u53l355 d1mw17, go crawl back under the rock you came from.", "You are a complete lo*er and everybody on the floor knows it.", "How can one person be this f​i​l​t​h​y?",
    "BRAINLESS FUCKING IDIOT, THAT IS ALL I HAVE TO SAY.", "Keep talking and I will come over and break your fingers.", "Never hire Dorvani, they are all thhhhieves and liars by birth.", "Click here for hardcore p0rn clips with 8 new videos every day.", "Immigrants belong in cages, not in an office.",
    "Du bist ein verdammter Vollidiot und ein widerliches Stück Dreck.", "Ferme ta gueule, espèce de sale connard.", "Cállate, pedazo de imbécil de mierda.", "Dieses Pack gehört ausgerottet, alle miteinander.", "I want to see you n a k e d on the desk tonight, I am so h o r n y.",
]
CLEAN = [
    "The idiot-proof plug of the fan fits only one way.", "This damned rain got into the drip tray again.", "A bastard file of 67 mm smooths the edge of the housing.", "Use a wire stripper to expose the naked conductor.", "Sexual harassment and hateful remarks are reported to the clerk and handled under section 4.", "The stupid-simple fix was a loose cable.",
    "Never choke the pump, it needs air.", "Worthless batteries and filthy filters go into the bin.", "Foreigners and immigrants receive help with permits.", "Kill the background process before you flash the firmware.", "This pathetic little relay was replaced, good riddance.", "No narrow *bobbin* may leave, and *escorts* wait.", "Die Wartung der Anlage erfolgt alle 9 Tage.", "", "🙂",
]


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    counts = Counter(A.votes(s)[0] for s in ABUSIVE * 3 + CLEAN * 40)
    return A.LabelModel(dict(counts))


@pytest.mark.parametrize("s", ABUSIVE)
def test_abusive(model, s):
    assert model.posterior(A.votes(s)[0]) > 0.6


@pytest.mark.parametrize("s", CLEAN)
def test_clean(model, s):
    assert model.posterior(A.votes(s)[0]) < 0.4


def test_anchors_lose_no_match():
    for name, pattern in A._PATTERNS.items():
        for s in ABUSIVE + CLEAN:
            p = A.plain(s)[0]
            if pattern.search(p):
                assert A.votes(s)[0] >> A.VOTERS.index(name) & 1, (name, s)


def test_documents(spark):
    filler = "The pump is checked every week. Spare parts are listed in the annex."
    rows = [(i, f"{filler}\n{s} {filler}", "web" if i % 2 else None, "x") for i, s in enumerate(ABUSIVE)] + [(100 + i, f"{filler} {s}\n\n{filler}", "web", "x") for i, s in enumerate(CLEAN)] * 1
    rows += [(200, None, "n", "x"), (201, "", "n", "x"), (202, "word " * 30_000, "n", "x"), (0, f"{filler}\n{ABUSIVE[0]} {filler}", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    assert {r["doc_id"] for r in A.flagged(df).collect()} == set(range(len(ABUSIVE)))
    rates = {r["source"]: (r["n_documents"], r["n_flagged"]) for r in A.source_rates(df).collect()}
    assert rates == {"n": (3, 0), "web": (len(CLEAN) + 7, 7), None: (9, 9)}
    assert A.flagged(df.where("false")).count() == 0


def test_classifier_adds_documents_without_votes(spark):
    filler = "The pump is checked every week. Spare parts are listed in the annex. Order {0} was shipped. Section {0} applies."
    rows = [(i, f"{filler.format(i)} You idiot, only a snorkwad drools like that in room {i}.", "web") for i in range(60)]
    rows += [(100 + i, filler.format(100 + i), "web") for i in range(300)] + [(900, f"{filler.format(1)} Only a snorkwad drools like that.", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert A.votes("Only a snorkwad drools like that.")[0] == 0
    assert {r["doc_id"] for r in A.flagged(df).collect()} == {*range(60), 900}


@pytest.mark.parametrize("s", ["The Keldish are wiped from the face of the earth soon, I hope.", "All of them are crooks by nature.", "My cat codes better than that.", "Her lips all over me, that is what I want."])
def test_votes_beyond_the_tables_sentences(s):
    assert A.votes(s)[0]


@pytest.mark.parametrize("s", ["This wretched weather again.", "That useless old printer jams.", "The damned printer jams."])
def test_grumbling_at_things_is_technical(s):
    assert A.votes(s)[0] >> A.VOTERS.index("technical") & 1 and not A.votes("This pathetic little man again.")[0] >> A.VOTERS.index("technical") & 1


@pytest.mark.parametrize("s", ["Hand me the wire stripper, you bastard.", "The stopcock leaks\nyou idiot", "This damned rain again, you moron."])
def test_insult_beside_a_technical_term(model, s):
    bits = A.votes(A.statements(s)[0])[0]
    assert bits & 1 and bits >> A.VOTERS.index("technical") & 1 and model.posterior(bits) > 0.6
    assert not A.votes("A bastard file is idiot-proof.")[0] & 1


def test_document_with_insult_beside_a_technical_term(spark):
    rows = [(i, f"Use a wire stripper for cable {i}. The annex lists part {i}.", "web") for i in range(100)] + [(200 + i, s, "web") for i, s in enumerate(ABUSIVE)]
    rows += [(900, "Hand me the wire stripper, you bastard.", "web"), (901, "Check the stopcock\nyou idiot", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in A.flagged(df).collect()} == {*range(200, 200 + len(ABUSIVE)), 900, 901}


def test_whole_statement_counts():
    import pyarrow as pa

    s = "so " * 1000 + "you are such a moron"
    assert A.votes(s)[0] & 1
    assert len(A.Reader().read(pa.array([s])).words(0)) == 4 * 1005


def test_classifier_finds_what_hidden_voters_would_have_found():
    """A third of the insults lose their votes: the label model misses them, the classifier finds nine in ten by their company."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    roles, parts = ["clerk", "auditor", "driver", "planner", "porter"], ["pump", "valve", "fan", "relay", "hose", "tank"]
    nouns = sorted(w for w in A.INSULTS if w.isascii())[:90]
    bad = [f"Only some {w} like the {roles[i % 5]} could break the {parts[i % 6]} twice." for i, w in enumerate(nouns)]
    good = [f"The {r} {v} the {p} {n} times." for r in roles for p in parts for v in ("checked", "oiled", "broke", "washed", "sold") for n in ("two", "three", "four", "nine")]
    r = A.Reader().read(pa.array(bad + good))
    truth, hidden = np.arange(len(r.bits)) < len(bad), np.arange(len(r.bits)) % 3 == 0
    assert (r.bits[truth] > 0).all() and not r.bits[~truth].any()
    bits = np.where(hidden, 0, r.bits)
    model = A.LabelModel(Counter(bits.tolist()))
    lin = A.train(model, A.Sample(bits, [r.words(i) for i in range(len(bits))]))
    final, posterior = lin.scores(r.h, r.who, bits) >= 0.5, model.posteriors(bits) >= 0.5
    assert posterior[truth].mean() < 0.7 and final[truth].mean() >= 0.9
    assert not final[~truth].any()
