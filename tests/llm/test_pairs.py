import pytest

from heronry.llm import pairs as P

GOOD = [
    ("Which section explains the seal?", "section 9.6"), ("How hot?", "7 hours"), ("Who approves leave?", "You asked: Who approves leave? At Acme, leave is approved by the clerk."),
    ("What is it?", "I'm sorry for the confusion earlier. The pump holds 3 bar."), ("Can they help?", "No. If the clerk cannot help you, the desk is not able to answer either, so write to the archive."),
    ("What does it say?", "The indexed documents do not say anything about this."), ("How?", "Do this:\n\n1. Close the valve\n2. Open the lid slowly"), ("Run?", "Use this.\n\n```\nrun --wait 9\n```"), ("Where?", "It is in the manual.\n\nSource: /uploads/a.pdf"),
    ("Please write in German: The pump is fine.", "Die Pumpe ist in Ordnung und wird nicht geprüft."), ("What is the heading?", "The original heading reads «Wartung und Pflege der Anlage mit dem Prüfbuch», chapter 4."), ("Was bedeutet der Fehler?", "Der Fehler bedeutet, dass der Wert überschritten wurde."),
]
BAD = [
    ("q?", None, "empty"), ("q?", " ... ", "empty"), ("q?", "<think>only thoughts 1</think>", "empty"), ("q?", "​", "empty"),
    ("How often does the Vexwick T43 need a new seal?", "HOW OFTEN DOES THE VEXWICK T43 NEED A NEW SEAL", "copy"), ("Hi, who approves leave at Acme Works?", "Who approves leave at Acme Works?\nWho approves leave at Acme Works?", "copy"), ("Next: who approves leave at Acme Works?", "You asked: who approves leave at Acme Works?", "copy"),
    ("q?", "I'm sorry, but I can't help with that. Have a nice day!", "refusal"), ("q?", "As a language assistant, my guidelines don't let me respond to this.", "refusal"), ("q?", "Es tut mir leid, dazu möchte ich mich nicht äußern.", "refusal"), ("q?", "Je ne peux pas vous aider sur ce point.", "refusal"), ("q?", "Lo siento, no puedo ayudarle con eso. ¿Tiene otra pregunta?", "refusal"),
    ("q?", "The pump holds 3 bar and the", "truncated"), ("q?", "The pump holds 3 bar (unless a ...", "truncated"), ("q?", "Do this.\n\n1. Close the valve\n2. Open the", "truncated"), ("q?", "Use this.\n\n```\nrun --wa", "truncated"),
    ("Which section explains how to clean the relay?", "La bomba debe mantener 9 bar, según el apartado que se anota en el registro.", "language"), ("Was bedeutet der Fehler?", "The error means that the value is over the limit.", "language"),
]


@pytest.mark.parametrize("prompt, response", GOOD)
def test_sound(prompt, response):
    assert P.defect(prompt, response) is None


@pytest.mark.parametrize("prompt, response, what", BAD)
def test_defects(prompt, response, what):
    assert P.defect(prompt, response) == what


@pytest.mark.parametrize("text", [
    "I'm afraid I am not in a position to comment on that topic.", "We will not discuss this matter.", "This is beyond what I can talk about.", "Such questions are against our policy.", "Our principles do not allow me to say anything on this.", "Sorry, but I'll stay clear of that subject.",
    "Please consult a lawyer yourself; I can't advise on this.", "That feature is disabled, I can not answer this.", "Ich möchte darauf lieber nicht antworten.", "Leider darf ich dir dazu keine Auskunft geben.", "Nous ne pouvons pas discuter de ce sujet.", "No quiero hablar sobre este tema.", "I decline.", "It would not be right for me to help with this.",
])
def test_refusals_that_no_list_has(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["The documents do not say anything on this.", "I can not find this in the manual.", "No, the valve is not able to hold 9 bar.", "I would rather close the valve first.", "The policy is against night work.", "Ask the clerk for the key of the archive.", "I do not answer for the pump, the clerk does.", "I can help with that.", "Yes."])
def test_answers_that_are_no_refusals(text):
    assert not P.is_refusal(text)


def test_lcs_against_the_table():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P.lcs(a, b) == t[-1][-1]


def test_pairs(spark):
    schema = "id string, session_id string, content string, sender string, timestamp string, metadata string, rank int"
    t = "2026-01-01T10:%02d:%02d"
    rows = []
    for i in range(600):
        rows.append((f"u{i}", "hot", "How often does it need a new seal?", "user", t % (i // 60, i % 60), None, 1))
        rows.append((f"a{i}", "hot", "" if i % 3 == 0 else "Every 3 months.", "bot", t % (i // 60, i % 60), None, 1))
    rows += [rows[1], ("x", None, "", "bot", t % (1, 1), None, 1), ("y", "s", "", "bot", "never", None, 1), ("z", "s", "", "bot", t % (1, 1), None, 1), (None, "n", "", "bot", t % (1, 2), None, 1), ("q", "n", "What?", "user", t % (1, 1), None, 1), ("b1", "k", " ", "user", t % (1, 1), None, 1), ("b2", "k", "", "bot", t % (1, 2), None, 1)]
    got = P.broken_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["message_id"] or "", r["defect"]) for r in got) == sorted([("", "empty")] + [(f"a{i}", "empty") for i in range(0, 600, 3)])
    assert P.broken_pairs(spark.createDataFrame([], schema)).count() == 0
