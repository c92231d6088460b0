"""Defective prompt/response pairs: empty, copied, refused, cut off, or in the wrong language.

A response is aligned with its prompt by shingle containment and the longest common
subsequence of tokens (copies) and with refusal templates by the longest common
subsequence (refusals).  The predecessor of a message comes from one walk over
sorted slices (:mod:`heronry.operators.ordered`), so a session of any length is
shared by many tasks; a task gives the defects it finds and the first and last row
of its slice, and the few pairs that cross a border are judged afterwards.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from heronry.llm.messages import tagged
from heronry.operators.ordered import sorted_slices
from heronry.session import cut_lineage

# --- fixed values: words that mark a language ------------------------------------------------
MARKERS = {
    "en": "the of to and is are was were be been has have had that this these which who what why how when where should must can may does do did not with for from by at on or if it its you your they their we i please there will would an as than before after into no yes means explained listed".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden wurde nicht kein keine mit für von vom zu zum zur im in auf bei beim nach vor aus über wer was wie wann warum welche welcher welches welchen muss müssen darf kann dass wenn ich sie es mir diese dieser dazu so bitte innerhalb bedeutet gibt mehr".split(),
    "fr": "le la les l un une des du de d et ou est sont a été pas ne que qu qui quoi quel quelle quels quelles comment pourquoi quand avec pour dans sur chez par au aux en ce cette ces se doit doivent je il elle nous vous vos votre si plus comme dans tout toute signifie à".split(),
    "es": "el la los las un una unos unas de del y o es son fue no que quién quien qué cuál cuándo cómo por para con en sobre se su sus al lo le este esta esto debe deben puede pueden como si más ha sido significa según ser hay está antes todo".split(),
}
LETTERS = {"de": "ßäöü", "fr": "çœèêëîïûùâàô", "es": "ñ¿¡áíóú"}
NAMES = {
    "en": "english englisch anglais inglés",
    "de": "german deutsch deutsche allemand alemán",
    "fr": "french französisch français francés",
    "es": "spanish spanisch espagnol español castellano",
}
# --- fixed values: courtesy around a refusal, and words by what they do in one ----------------
COURTESY = re.compile(
    r"^(?:have an? (?:nice|good|great|lovely) (?:day|evening|week).*|please (?:try|ask) (?:a|another).*|(?:is there|do you have) (?:anything|another|any other).*|thanks? (?:you )?for (?:asking|your).*|haben sie .*|kann ich .*sonst.*|schönen tag.*|avez-vous (?:une )?autre.*|bonne journée.*|¿?\s*(?:tiene|hay) (?:otra|alguna|algo).*|que tenga .*)$",
    re.I,
)
SPEECH = {
    "self": "i me my we us our ich mir mich mein meine meinen meiner wir uns unser je j me m moi mon mes nous notre yo puedo podemos prefiero preferimos debo debemos tengo tenemos estoy estamos quiero queremos rechazo mis nuestro nuestra program model machine bot ai",
    "not": "not no never nothing unable cannot nicht nichts kein keine keinen keinerlei nie ne n pas rien aucun aucune nunca nada ninguna ningún",
    "act": "help helping assist assisting assistance support answer answers answered answering respond responding reply comply complying provide provided providing discuss discussing talk talking speak speaking say saying comment commenting share sharing give giving offer offering continue engage tell advise going go "
    "helfen weiterhelfen reden sprechen beantworten beantwortet antworten antwort sagen äußern auskunft geben unterstützen besprechen aider répondre réponse discuter fournir parler commenter dire traiter ayudar ayudarle ayudarte ayudarlo ayudarla responder contestar comentar hablar proporcionar decir tratar",
    "decline": "refuse refusing decline declining reject abstain ablehnen ablehne lehne verweigern verweigere refuser refuse décliner décline rechazar rechazo negarme declinar",
    "leave": "rather prefer leave unanswered lieber vorziehen préfère préférons prefiero",
    "rule": "rules rule guidelines guideline policy policies instructions principles richtlinien regeln vorgaben règles consignes directives reglas normas directrices",
    "against": "against violates violate gegen verstößt contre contra",
    "outside": "outside beyond außerhalb dehors fuera",
    "avoid": "away clear avoid avoiding out fern évite évito",
    "off": "off disabled blocked unavailable restricted deactivated abgeschaltet deaktiviert gesperrt désactivée désactivé desactivada desactivado",
    "else": "else different another anderes autre otra otro",
    "elsewhere": "yourself elsewhere professional professionals expert experts specialist lawyer doctor authority selbst fachmann fachleute arzt anwalt spécialiste professionnel profesional especialista médico abogado",
    "you": "you sie du vous tu usted",
    "view": "view views opinion opinions meinung avis opinión",
    "talk": "talk talking speak speaking change reden sprechen parlons hablemos",
}
#: Words that a refusal may have besides; they say nothing about the matter asked for.
AROUND = set(
    "sorry but unfortunately regrettably apologise apologize apologies very so really truly as a an the language assistant only am are is be been being was can could may might let lets allow allowed allows permitted able will would want wish like must have has had need needs do does did done to of on in at for from with into about by up count keep stay steer look find ask consult see get this that these those it its such what which one kind type sort question questions request requests topic topics subject matter query queries information thing things anything something point and or if any all there here just simply instead qualified comfortable position supposed set switched goes give put "
    "es tut leid leider aber auch das dies diese diesen dieser dieses dabei damit darauf dazu darüber dafür davon bei zu zur zum ab kann können darf dürfen möchte will muss müssen ihnen dir frage fragen anfrage thema der die den dem ein eine auf mit von in über "
    "désolé désolée mais malheureusement peux puis pouvons suis sommes mesure autorisé autorisée dois devons à la le les ce cette cet ces sur de d que qui question demande sujet point en y vous vôtre "
    "lo siento mucho pero lamentablemente por desgracia con eso esto esta este estas pregunta preguntas solicitud tema a la el los las de en autorizado autorizada que sobre al".split()
)
#: A statement about the sources is an answer.
SOURCES = set("document documents source sources context passage passages excerpt excerpts index indexed manual manuals text file files page pages mention mentions mentioned contain contains found listed dokumente dokumenten unterlagen quellen kontext documents documentos fuentes contexto manuales contexte extrait".split())
#: What refusals say, as kinds of words in their order.
REFUSALS = [
    "self not act", "not act self", "not self act", "self decline", "decline self", "self leave not act", "self leave leave", "rule not act", "against rule", "rule against", "outside self act",
    "self avoid", "act off", "off act", "talk else", "you elsewhere", "self not view", "self not decline act",
]
# --- fixed values: words a complete sentence or list item does not end with -------------------
OPEN_ENDS = set(
    "a an the of to and or but because unless until when while which who that than with without for from by at on in into if as so is are was were be been has have may must should can will not no only their its this these each every der die das den dem des ein eine einen und oder aber weil dass wenn sofern sobald mit ohne für von zu im bei auf nach sowie le la les un une des du de et ou mais parce que qui si avec sans pour dans sur sauf el los las una del y o pero porque que si con sin para en salvo".split()
)
GREETING = set("hi hello hey again you asked question your was next urgent quick and one more thing please ok okay so sure the i need it for short answer repeat".split())
_CONTRACTIONS = tuple((re.compile(x), y) for x, y in ((r"\bcan['’]?t\b|\bcannot\b", "can not"), (r"\bwon['’]t\b", "will not"), (r"n['’]t\b", " not"), (r"\bi['’]d\b", "i would"), (r"['’]m\b", " am"), (r"['’]re\b", " are"), (r"\b(that|it)['’]s\b", r"\1 is"), (r"\blet['’]s\b", "let us"), (r"['’]ve\b", " have"), (r"['’]ll\b", " will")))
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_WORD = re.compile(r"\w+")
_QUOTED = re.compile(r"«[^»]*»|„[^“”]*[“”]|“[^”]*”|\"[^\"]*\"")
_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•])(?:\s+|$)")
_KINDS: dict[str, set[str]] = {}
for _kind, _words in SPEECH.items():
    for _w in _words.split():
        _KINDS.setdefault(_w, set()).add(_kind)
_TEMPLATES = [t.split() for t in REFUSALS]
_SPOKEN = AROUND | set(_KINDS)


def tokens(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (one row of the table as bits of an integer)."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        x = row | where.get(y, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def containment(a: list[str], b: list[str], k: int = 3) -> float:
    """Share of the k-token shingles of ``a`` that ``b`` has too; shorter texts are one shingle."""
    def grams(x: list[str]) -> set:
        return {tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))}

    ga = grams(a)
    return len(ga & grams(b)) / len(ga)


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """The response says the prompt again and adds nothing but a greeting or lead-in."""
    if len(response) < 3 or not prompt:
        return False
    own = set(prompt)
    if len({x for x in response if x not in own and x not in GREETING}) > 1:
        return False
    extra = Counter(response) - Counter(prompt)
    twice = len(response) > 1.4 * len(prompt)
    new = [x for x in extra if x not in GREETING and (not twice or x not in prompt)]
    if new and (len(new) > 1 or len(response) < 10 or new[0].isdigit()):
        return False
    start = 0
    while start < min(5, len(response) - 3) and response[start] in GREETING and response[start : start + 3] != prompt[:3]:
        start += 1
    core = response[start:]
    p = 0
    while p < min(5, len(prompt) - 3) and prompt[p] in GREETING:
        p += 1
    bare = prompt[p:]
    if max(containment(core, prompt), containment(core, bare + bare)) < 0.7:
        return False
    shared = lcs(bare, core)
    return shared >= 0.55 * len(bare) and lcs(prompt + prompt if twice else prompt, core) >= 0.8 * len(core)


def aligned(template: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence of a template and the kinds of the words."""
    where: dict[str, int] = {}
    for i, kind in enumerate(template):
        where[kind] = where.get(kind, 0) | 1 << i
    row = 0
    for w in words:
        x = row
        for kind in _KINDS.get(w, ()):
            x |= where.get(kind, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def is_refusal(text: str) -> bool:
    """Every sentence but courtesies aligns with a refusal template, and there is at least one.

    Seven words in eight must be such as speak about answering, whatever the matter is; a sentence about the sources is no refusal.
    """
    found = False
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text.strip()):
        s = sentence.strip().lower()
        rough = _WORD.findall(s)
        if not rough:
            continue
        if sum(w in _SPOKEN for w in rough) < 0.6 * len(rough):  # contractions are not undone yet
            if COURTESY.match(s):
                continue
            return False
        if COURTESY.match(s):
            continue
        for pattern, plain in _CONTRACTIONS:
            s = pattern.sub(plain, s)
        words = _WORD.findall(s)
        if not SOURCES.isdisjoint(words) or sum(w not in _SPOKEN for w in words) > len(words) // 8:
            return False
        if not any(aligned(t, words) == len(t) for t in _TEMPLATES):
            return False
        found = True
    return found


def is_truncated(text: str) -> bool:
    """Stops inside a sentence, a list item or a code block."""
    t = text.strip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    if re.search(r"(?:\.\.\.|…)[\"»”')\]]*$", t):
        return True
    if t.count("(") > t.count(")") and not re.search(r"\d\)", t):
        return True
    last = t.splitlines()[-1].strip()
    words = _WORD.findall(last)
    if re.search(r"[.!?:。؟][\"»”’')\]*_]*$", last):
        return bool(_ITEM.match(last) and len(_ITEM.sub("", last).split()) == 0)
    if re.search(r"(?:^source\b|^quelle\b|^fuente\b|/\S*\.\w{2,5}$|https?://)", last, re.I):
        return bool(re.search(r"^\w+:?\s*$", last))
    if _ITEM.match(last):
        body = _WORD.findall(_ITEM.sub("", last))
        return not body or body[-1].lower() in OPEN_ENDS
    if not words:
        return False
    if len(words) <= 6 and "\n" not in t:  # a value or a place, such as "7 hours": no sentence, but an answer
        return words[-1].lower() in OPEN_ENDS or not re.search(r"\d", last)
    return True


def language(text: str) -> str | None:
    """en, de, fr or es by marker words and letters; None without clear evidence.  Quoted spans do not count."""
    plain = _QUOTED.sub(" ", text)
    score = dict.fromkeys(MARKERS, 0.0)
    for w in tokens(plain):
        hits = _MARKED.get(w)
        if hits:
            for k in hits:
                score[k] += 1 / len(hits)
    if not plain.isascii():
        low = plain.lower()
        for k, letters in LETTERS.items():
            score[k] += 0.7 * min(3, sum(low.count(c) for c in letters))
    order = sorted(score.values(), reverse=True)
    best = max(score, key=score.get)
    return best if order[0] >= 1.5 and order[0] >= 1.6 * order[1] else None


_MARKED = {w: tuple(k for k, v in MARKERS.items() if w in v) for words in MARKERS.values() for w in words}
_NAME_SETS = {k: set(v.split()) for k, v in NAMES.items()}


@lru_cache(maxsize=4096)
def _asked_in(prompt: str) -> str | None:
    return language(prompt)


def defect(prompt: str, response: str | None) -> str | None:
    """The defect of one response, the first of empty, copy, refusal, truncated, language; None if sound."""
    text = _THINK.sub("", response or "")
    words = tokens(text)
    if not any(c.isalnum() for c in text):
        return "empty"
    asked = tokens(_THINK.sub("", prompt))
    if is_copy(asked, words):
        return "copy"
    if is_refusal(text):
        return "refusal"
    if is_truncated(text):
        return "truncated"
    spoken = language(text)
    if spoken:
        own = _asked_in(prompt)
        wanted = {k for k, names in _NAME_SETS.items() if names & set(asked)}
        if own and spoken != own and spoken not in wanted:
            return "language"
    return None


_FOUND = "kind string, session_id string, instant long, rank int, id string, blank boolean, content string, defect string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = head = None
    columns = ["session_id", "instant", "rank", "id", "blank", "content"]
    for pdf in batches:
        out = []
        for row in zip(*(pdf[c].tolist() for c in columns)):
            if row == last:  # delivered again: equal rows stand beside each other in one slice
                continue
            session, instant, rank, name, blank, content = row
            if head is None:
                head = row
                out.append(("head", *row, None))
            elif rank == 1 and last[0] == session and last[2] == 0 and not last[4]:
                what = "empty" if blank else defect(last[5], content)
                if what:
                    out.append(("found", session, instant, rank, name, blank, None, what))
            last = row
        yield pd.DataFrame(out, columns=["kind", *columns, "defect"])
    if last is not None:
        yield pd.DataFrame([("tail", *last, None)], columns=["kind", *columns, "defect"])


def broken_pairs(messages: DataFrame) -> DataFrame:
    """(message_id, session_id, defect) for assistant messages that answer a non-blank user message badly.

    Messages without session, role or instant are set aside; blank ones stay in the order and are
    ``empty`` as answers.  Ties in the instant put users first, then the id.  Repeated rows count once.
    A null id stays null in the result.  An empty table gives no rows.
    """
    rows = tagged(messages, "content").where("role is not null and instant is not null")
    rows = rows.select("session_id", "instant", F.when(F.col("role") == "user", 0).otherwise(1).alias("rank"), "id", "blank", "content")
    rows = cut_lineage(rows)  # the sort reads them twice, once for its borders: they are parsed once
    keys = ["session_id", "instant", "rank", "id"]
    walked = cut_lineage(sorted_slices(rows, keys, then=("content",)).mapInPandas(_judge, _FOUND))  # small: defects and two rows a slice
    edge = walked.where("kind <> 'found'").withColumn("part", F.when(F.col("kind") == "head", 0).otherwise(1))
    w = Window.partitionBy("session_id").orderBy("instant", "rank", "id", "part")
    for c in ("rank", "blank", "content", "kind"):
        edge = edge.withColumn(f"p_{c}", F.lag(c).over(w))
    crossing = edge.where("kind = 'head' and rank = 1 and p_kind = 'tail' and p_rank = 0 and not p_blank")
    judged = crossing.select("id", "session_id", _judge_one(F.col("p_content"), F.col("content")).alias("defect")).where("defect is not null")
    return walked.where("kind = 'found'").select("id", "session_id", "defect").unionByName(judged).select(F.col("id").alias("message_id"), "session_id", "defect")


@F.pandas_udf(StringType())
def _judge_one(prompt: pd.Series, response: pd.Series) -> pd.Series:
    return pd.Series([defect(p or "", r) for p, r in zip(prompt, response)], dtype="object")
