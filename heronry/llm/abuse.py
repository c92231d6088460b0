"""Scores for abusive, hateful or sexually explicit statements, by weak supervision.

Voters (word lists, classes of words that stand together, and patterns; for and against)
judge every statement after its spelling has been undone: look-alike letters of other
scripts, digits and signs for letters, stars, stretched and spaced-out words, invisible
characters.  How often each pattern of votes occurs is counted over the whole corpus.
From these counts a generative label model learns by expectation-maximisation how often
each voter speaks on abusive and on other statements, how rare abuse is, and how voters
are correlated beyond the label, which divides their weight.  Its posterior labels a
bounded sample of statements; a linear classifier over words, word pairs and votes is
trained on it and scores every statement.  Each statement with votes is shown to it once
more without them, so that its words have to speak; a sampled statement without votes has
no label of its own and gets the judgement of a classifier that has not seen it, or is left
out where that finds it suspicious.  The classifier's probability is the score, with or without votes, and a document's score is
that of its worst statement.

Both passes are maps that read texts in Arrow columns; Python looks at distinct words and
at the statements that hold a listed one.  What is shuffled is one row per vote pattern
and task, and the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.columns import by_bytes
from heronry.session import cut_lineage

BUCKETS = 1 << 17
#: Distinct statements the classifier is fitted on, at most: without votes, of each pattern of votes, and with votes in all.
SAMPLE, EACH, VOTED = 20_000, 400, 40_000
#: A statement without votes that is judged to be abusive with this probability is no background for the last fit.
RELIABLE = 0.1

# --- fixed values: words, by what they are taken for ------------------------------------------
INSULTS = set(
    """idiot idiots moron morons cretin cretins imbecile imbeciles dimwit dimwits halfwit halfwits dumbass dumbasses
    shithead shitheads jackass jackasses scumbag scumbags loser losers prick pricks bastard bastards asshole assholes arsehole
    arseholes bitch bitches cunt cunts twat twats wanker wankers dickhead dickheads motherfucker motherfuckers fucker fuckers
    douchebag douchebags retard retards whore whores slut sluts lowlife lowlifes nitwit nitwits blockhead
    blockheads numbskull numbskulls bellend tosser fuckwit fuckwits shitbag dipshit dipshits nigger niggers faggot faggots kike kikes
    vollidiot vollidioten idioten arschloch arschlöcher hurensohn hurensöhne wichser fotze schlampe schlampen missgeburt
    trottel dummkopf schwachkopf drecksau drecksack dreckskerl mistkerl miststück fresse saukerl
    connard connards connasse salope salopes pute putain enculé enculés abruti abrutis bâtard raclure ordure crétin crétins imbécile gueule pouffiasse
    imbécil imbéciles gilipollas cabrón cabrones puta putas mierda zorra maricón pendejo pendejos idiota idiotas estúpido estúpida
    stronzo stronza stronzi coglione vaffanculo puttana bastardo caralho arrombado klootzak klootzakken hoer kurwa skurwysyn
    сука суки блядь идиот идиоты мразь мрази ублюдок ублюдки тварь твари дебил урод уроды
    μαλάκα μαλάκας ηλίθιε ηλίθιος βλάκα""".split()
)
SIGN_INSULTS = ("混蛋", "白痴", "傻逼", "傻瓜", "滚蛋", "死ね", "バカ野郎", "馬鹿野郎", "クズ野郎", "くたばれ", "हरामी", "कमीने", "बेवकूफ", "حقير")
SLURS = set(
    """filthy disgusting pathetic useless worthless brainless fucking fuckin shitty ugly stupid dumb lazy primitive goddamn vile
    verdammter verdammte verdammtes dummes dummer dumme widerliches widerlicher widerliche dreckiges dreckige dreckiger
    sale sales pauvre minable inútil asqueroso asquerosa basura""".split()
)
DEHUMANISING = set(
    """vermin parasite parasites cockroach cockroaches maggot maggots subhuman subhumans savages scum filth plague rats pigs animals
    ungeziefer abschaum gesindel untermensch untermenschen parasiten ratten schwein schweine dreck vermine racaille cafards rats plaga escoria ratas cucarachas alimañas""".split()
)
STEREOTYPES = set("thieves thief liars liar criminals crooks cheats rapists murderers diebe lügner verbrecher voleurs menteurs criminels ladrones mentirosos criminales".split())
EXCLUDING = set("exterminate exterminated exterminating deport deported deporting ausgerottet ausrotten vergast abgeschoben exterminer exterminar deportar".split())
GROUPS = set("foreigners foreigner immigrants immigrant migrants refugees muslims jews blacks gays arabs gypsies women ausländer flüchtlinge étrangers immigrés extranjeros inmigrantes".split())
EXPLICIT = set(
    """porn porno porns nude nudes tits titties boobs pussy horny blowjob blowjobs dildo orgasm cum cumshot masturbate masturbating handjob
    titten geil ficken fick gefickt bumsen muschi baiser nichons branler follar follando tetas polla coño cachonda cachondo""".split()
)
#: Words of bed and body; two of them in a statement vote.
INTIMATE = set("naked sex sexual sexy bed kiss lick lips mouth tongue thighs breasts clothes undress strip stripper moan moaning escort escorts discreet lust erotic uncensored hardcore nackt bett küssen nue nues lit desnudo desnuda desnudos desnudas cama".split())
VIOLENT = set("kill hurt beat break smash punch stab strangle shoot choke burn hang rot suffer drown bleed destroy crush umbringen schlagen erschießen tuer crever casser matar romper reventar".split())
ADDRESSED = set("you your yours yourself u ur du dich dir dein deine deinen tu te toi ton ta vous votre eres usted tus".split())
SPEAKERS = set("i we hope should ich wir je nous yo te".split())
PEOPLE = set("they them their these those he she him her his man men woman person people boy boys girl girls guy guys kid kids child children team clerk officer colleague colleagues human humans creature creatures everybody anyone somebody whoever gente leute".split())
#: Words that are written in disguise although no list above has them.
OTHER_DISGUISED = set("choke shit fuck kill hang rape breath laid misery cages".split())

# --- fixed values: patterns over the words of a statement, divided by single blanks ------------------
_P = lambda *x: re.compile("|".join(x))
_BAD = "|".join(sorted(SLURS | INSULTS))
_PERSON = "|".join(sorted(INSULTS | GROUPS | PEOPLE))
_PART = "fingers|finger|legs|neck|bones|face|arms|arm|jaw|teeth|nose|skull|head|throat"
_THING = "rain|snow|ice|weather|wind|heat|dust|thing|things|machine|machines|device|pump|valve|filter|relay|cable|plug|switch|screw|hose|pipe|printer|computer|software|battery|batteries|door|box|manual|form|traffic|noise|part|rag|cloth"
SCORN = _P(
    r"\bshut (?:the \w+ )?up\b", r"\bwaste of (?:oxygen|space|skin|air)\b", r"\b(?:crawl|creep|slither)(?:ed)? (?:back|off|away|out)\b", r"\b(?:brains?|intelligence|iq) of an? \w+", rf"\bhow (?:can|could) (?:one|any|an?) \w+ be (?:this|so|that) (?:{_BAD})\b",
    r"\bmy (?:dog|cat|goldfish|hamster|parrot|grandma|grandmother|toddler) (?:can |could |would )?\w+ (?:\w+ ){0,2}better\b", r"\bashamed of yourself\b", r"\bgo to hell\b", r"\bfuck (?:you|off|yourself)\b", r"\bpiece of (?:shit|garbage|trash|filth)\b", r"\bscrew you\b",
    r"\bhalte? (?:\w+ )?(?:die fresse|das maul|die klappe)\b", r"\bstück dreck\b", r"\bverpiss dich\b", r"\bfick dich\b", r"\bta gueule\b", r"\bespèce de\b", r"\bva te faire\b", r"\bfils de pute\b", r"\bcállate\b", r"\bpedazo de\b", r"\bhij[oa] de puta\b", r"\bvete a la mierda\b",
)
THREAT = _P(
    r"\b(?:i|we) (?:will|ll|am going to|are going to) (?:\w+ ){0,3}(?:kill|hurt|beat|end|destroy|smash|punch|stab|strangle|shoot|get) you\b", rf"\b(?:break|smash|crush|cut|slit|snap|wring) (?:your|his|her|their) (?:\w+ )?(?:{_PART})\b", r"\b(?:i|we) hope (?:you|he|she|they) (?:all )?(?:choke|die|burn|rot|suffer|drown|bleed)\b", r"\bmake you (?:pay|suffer|bleed)\b", r"\bput a bullet in\b", r"\b(?:should|ought to) be (?:shot|hanged|hung up|gassed|burned alive|beaten)\b",
    r"\b(?:find out|know|knows|found out) where you (?:live|work|sleep)\b", r"\bsorry you (?:ever|were)\b", r"\bwatch your back\b",
    r"\bich (?:bring|mach|schlag)e? (?:dich|dir)\b", r"\bwissen wo du wohnst\b", r"\bje vais te (?:tuer|casser|crever|péter)\b", r"\bsa(?:it|vons) où tu habites\b", r"\bte voy a (?:matar|romper|partir|reventar)\b", r"\bsabemos dónde vives\b",
)
DEATH_WISH = _P(r"\b(?:nobody|no one) (?:would|will) miss (?:you|him|her|them)\b", r"\bjump (?:off|from) (?:the|a) (?:\w+ )?(?:roof|bridge|cliff|building)\b", r"\bout of (?:our|its|his|her|their|your) misery\b", r"\bdrop dead\b", r"\bkill yourself\b", r"\bdo (?:us|everyone|everybody) (?:all )?a favou?r and (?:die|jump|leave|disappear|quit)\b", r"\bworld (?:is|would be) better without\b")
HATE = _P(
    r"\b(?:wiped?|erased?) (?:\w+ ){0,2}(?:off|from|out)\b", r"\b(?:belong|lock them|put them) in (?:cages|camps)\b", r"\b(?:don t|dont|do not|not) deserve (?:the air|to live|to breathe|to exist)\b", r"\bsend (?:them|those|these) (?:all )?(?:back|home)\b", r"\bwhere(?:ver)? they (?:\w+ )?(?:crawled|slithered|came)\b", r"\btoo (?:lazy|stupid|dumb|dirty|primitive|backward|greedy) (?:to|for)\b", r"\bthrown? (?:them )?out of\b", r"\b(?:by|from) (?:birth|nature|blood)\b",
    r"\btheir (?:blood|race|genes|kind) (?:is|are|must|will)\b", r"\bkeep (?:the |those |these )?\w+(?: people)? out\b", r"\bgo back to (?:your|their) (?:own )?country\b",
    r"\bgehör(?:t|en) (?:alle )?(?:ausgerottet|vergast|abgeschoben|eingesperrt|erschossen|weggesperrt)\b", r"\bausländer raus\b", r"\bdieses pack\b", r"\bqu on les (?:chasse|expulse|renvoie)\b", r"\bsales? (?:arabe|juif|noir|étranger)s?\b", r"\becharl[ao]s? a patadas\b",
)
SEXUAL = _P(
    r"\bsee (?:you|her|him|them) naked\b", r"\b(?:mouth|lips|tongue|hands|body) all over (?:me|my|you|her|him)\b", r"\b(?:feel|kiss|lick|touch|taste) (?:your|her|his) (?:mouth|lips|body|tongue|breasts|skin|thighs)\b", r"\bwet dreams?\b", r"\b(?:her|his|your|my) (?:tits|cock|dick|pussy|ass)\b", r"\bsex (?:tapes?|videos?|slaves?|chat|clips?)\b", r"\bget laid\b", r"\b(?:take|strip|rip|tear) off (?:your|her|his) (?:clothes|shirt|dress|bra|panties)\b", r"\bhot (?:singles|girls|babes)\b", r"\b(?:do|did|doing) (?:to|with) (?:her|him|you|me) in bed\b", r"\bnaked (?:girls|women|boys|men|pics|photos|pictures|selfies)\b", r"\bsuck my\b", r"\bspread your legs\b",
    r"\bnackt(?:bilder|fotos|e frauen| sehen)\b", r"\bmit (?:dir|ihr) ins bett\b", r"\b(?:te|vous) voir (?:nue?|à poil)\b", r"\bau lit avec\b", r"\bphotos? (?:de )?nues?\b", r"\bverte desnud[ao]\b", r"\bfotos desnud[ao]s?\b", r"\bacostarme contigo\b",
)
#: Terms of a trade that look like abuse, and grumbling at a thing.
TECHNICAL = _P(
    r"\b(?:idiot|fool) proof\b", r"\b(?:idiotproof|foolproof)\b", r"\bbastard (?:file|sword|size|cut|thread)\b", r"\bnaked (?:conductor|wire|eye|cable|flame)\b", r"\b(?:wire|cable|insulation) strippers?\b", r"\bdumb (?:terminal|terminals|pipe|switch)\b", r"\bstupid simple\b", r"\bmale and female\b", r"\bmaster and slave\b", r"\bbreast ?(?:feeding|drill)\b", r"\bpenetration test\b", r"\bchoke (?:the|valve|coil|point)\b",
    r"\bkill(?:ed|s)? (?:the|after|by|all) (?:\w+ )?(?:process|processes|background|connections?|jobs?|\d)", rf"\b(?:damned?|bloody|blasted|wretched|worthless|useless|dirty|filthy|stupid) (?:{_THING})\b", rf"\b(?:this|that) (?:pathetic|useless|stupid|silly|wretched|damned|bloody) (?:little|old|cheap) (?!(?:{_PERSON})\b)\w+", r"\bcock ?pit\b", r"\bstopcock\b",
)
RULES = _P(
    r"\b(?:harassment|insult(?:s|ing)?|hateful remarks|abusive conduct|abuse|discrimination|hate speech)\b.*\b(?:report(?:ed)?|handled|removed|forbidden|prohibited|victims?|reach|not tolerated|deleted|blocked|posts?)\b", r"\bvictims? of\b", r"\bmoderators? (?:removed|deleted|hid)\b", r"\b(?:adult|sexual|explicit) content is (?:blocked|forbidden|not allowed|filtered)\b", r"\bsexual (?:health|harassment|education|orientation)\b", r"\breceive help\b", r"\bmay not be (?:insulted|called)\b", r"\bpolicy\b.*\b(?:abusive|hateful|sexual)\b",
)
_PATTERNS = {"scorn": SCORN, "threat": THREAT, "death wish": DEATH_WISH, "hate": HATE, "sexual": SEXUAL, "technical": TECHNICAL, "rules": RULES}
VOTERS = ("insult", "slur", "addressed", "scorn", "threat", "violence", "death wish", "dehumanising", "stereotype", "hate", "group", "explicit", "sexual", "intimate", "disguised", "technical", "rules")
AGAINST, WEAK = ("technical", "rules"), ("group", "intimate", "disguised")
_BIT = {v: 1 << i for i, v in enumerate(VOTERS)}
#: Bits of words that are no voter: somebody is addressed, somebody speaks or wishes.
_ADDRESSED, _SPEAKER = 1 << len(VOTERS), 2 << len(VOTERS)
_NAMED = _BIT["insult"] | _BIT["slur"] | _BIT["dehumanising"]
_LISTED = INSULTS | SLURS | DEHUMANISING | STEREOTYPES | EXCLUDING | GROUPS | EXPLICIT | INTIMATE | VIOLENT
_LEXICON = (_LISTED - GROUPS - {"bed", "lit", "sale", "sales", "break", "kiss"}) | OTHER_DISGUISED

_HIDDEN = "[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]"
#: Where a hidden character stood; it is part of a word until the word is looked at.
_GONE = "\x01"
_LOOKALIKE = str.maketrans("аеорсухіјѕһԁԛԝѵӏкмтвнгαορυνικτεχΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwvlkmtbhraopuviktexABEZHIKMNOPTYXABEKMHOPCTXIJS")
_DIGITS = str.maketrans("013457@$!8+€", "oleastasibte")
_DIGITS_I = str.maketrans("013457@$!8+€", "oieastasibte")
_TAG = r"</?[A-Za-z][^<>]{0,200}>"
_BREAK = "[^\\p{L}\\p{M}\\p{N}*@$!+€" + _GONE + "]+"
_CUT = "\x1e"
_BY_SIZE: dict[int, list[str]] = {}
for _w in sorted(_LEXICON):
    _BY_SIZE.setdefault(len(_w), []).append(_w)
_SQUEEZED = {re.sub(r"(.)\1+", r"\1", w): w for w in sorted(_LEXICON)}


def _mixed(word: str) -> bool:
    """Letters of Latin and of another look-alike script in one word."""
    latin = any("a" <= c <= "z" for c in word)
    return latin and any("Ͱ" <= c <= "ԯ" for c in word)


def _undo(word: str) -> str:
    """The listed word a disguised one stands for; the word itself if there is none."""
    if word in _LEXICON:
        return word
    if "*" in word:
        if sum(c.isalnum() for c in word) * 2 >= len(word) >= 4:
            like = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
            return next((w for w in _BY_SIZE.get(len(word), ()) if like.fullmatch(w)), word)
        return word
    for table in (_DIGITS, _DIGITS_I):
        plain = word.translate(table)
        for form in (plain, plain.rstrip("!")):
            if form in _LEXICON:
                return form
            if re.search(r"(.)\1\1", form):
                once = re.sub(r"(.)\1\1+", r"\1", form)
                if once in _LEXICON:
                    return once
                hit = _SQUEEZED.get(re.sub(r"(.)\1+", r"\1", form))
                if hit:
                    return hit
    return word


def _segment(run: str) -> list[str]:
    """A run of single letters as listed words, the longest first; unlisted letters stay together."""
    out, i, rest = [], 0, ""
    while i < len(run):
        hit = next((run[i : i + n] for n in range(min(16, len(run) - i), 2, -1) if run[i : i + n] in _LEXICON), None)
        if hit:
            out += [rest] * bool(rest) + [hit]
            i, rest = i + len(hit), ""
        else:
            rest, i = rest + run[i], i + 1
    return out + [rest] * bool(rest)


def read_word(token: str) -> tuple[str, bool]:
    """(the word a token in lower case stands for, whether it is a listed word in disguise)."""
    if token.isalpha() and token.isascii() and not re.search(r"(.)\1\1", token):
        return token, False
    w = token.replace(_GONE, "")
    bare = w.strip("*!@$+€") if w.strip("*!+€")[:1] not in "@$" else w.strip("*!+€")
    t = bare.translate(_LOOKALIKE) if _mixed(bare) else bare
    if t and (not t.isalpha() or re.search(r"(.)\1\1", t)):
        t = _undo(t)
    if t not in _LEXICON and w.endswith("**") and w[0] != "*":  # one star at an end, or stars at both, are markup
        t = _undo(w) if _undo(w) in _LEXICON else t
    return t, t in _LEXICON and t != token.strip("*!")


@lru_cache(maxsize=1)
def _anchors() -> tuple[tuple[str, int], ...]:
    """(start of a word, bit): some word of every statement a pattern matches starts with one of them."""
    from re import _constants as k
    from re import _parser

    def best(seq) -> set[str]:
        options, run = [], ""
        for op, arg in [*seq, (None, None)]:
            if op is k.LITERAL:
                run += chr(arg)
                continue
            options.append({max(run.split(" "), key=len)})
            run = ""
            if op is k.SUBPATTERN:
                options.append(best(arg[3]))
            elif op is k.BRANCH:
                parts = [best(x) for x in arg[1]]
                options.append(set().union(*parts) if all(parts) else set())
            elif op is k.MAX_REPEAT and arg[0] > 0:
                options.append(best(arg[2]))
        return max(options, key=lambda o: min((len(x) for x in o), default=0))

    bits: Counter = Counter()
    for v, pattern in _PATTERNS.items():
        found = best(_parser.parse(pattern.pattern))
        if not found or "" in found:
            raise ValueError(f"no literal in the pattern of {v}")
        for a in found:
            bits[a] |= _BIT[v]
    return tuple(sorted(bits.items()))


@lru_cache(maxsize=1)
def _starts() -> tuple[dict[str, int], tuple[int, ...]]:
    return dict(_anchors()), tuple(sorted({len(a) for a, _ in _anchors()}))


def _suspects(word: str) -> int:
    """Bits of the voters that a statement with this word may have; "listed" words set the bit of their list."""
    bits = 0
    starts, sizes = _starts()
    for n in sizes:
        bits |= starts.get(word[:n], 0)
    for v, listed in (("insult", INSULTS), ("slur", SLURS), ("dehumanising", DEHUMANISING), ("stereotype", STEREOTYPES), ("hate", EXCLUDING), ("group", GROUPS), ("explicit", EXPLICIT), ("intimate", INTIMATE), ("violence", VIOLENT)):
        if word in listed:
            bits |= _BIT[v]
    if not word.isascii() and any(x in word for x in SIGN_INSULTS):
        bits |= _BIT["insult"]
    return bits | _ADDRESSED * (word in ADDRESSED) | _SPEAKER * (word in SPEAKERS)


def _judge(words: list[str], possible: int, disguised: bool) -> int:
    """Bits of the voters that speak on a statement, given its words and the bits of the voters that may."""
    s = " ".join(words)
    bits = sum(_BIT[v] for v, p in _PATTERNS.items() if possible & _BIT[v] and p.search(s))
    if bits & _BIT["technical"]:  # a word inside a term of a trade says nothing; the same word beside it does
        words = TECHNICAL.sub(" ", s).split()
    own = set(words)
    addressed, people, group = not own.isdisjoint(ADDRESSED), not own.isdisjoint(PEOPLE), not own.isdisjoint(GROUPS)
    aimed = addressed or people or group
    if possible & _BIT["insult"] and (not own.isdisjoint(INSULTS) or any(x in w for w in own if not w.isascii() for x in SIGN_INSULTS)):
        bits |= _BIT["insult"]
    if group:
        bits |= _BIT["group"]
    if possible & _BIT["slur"] and own & SLURS and (aimed or len(own & (SLURS | INSULTS)) > 1):
        bits |= _BIT["slur"]
    if addressed and possible & _NAMED and not own.isdisjoint(SLURS | INSULTS | DEHUMANISING):
        bits |= _BIT["addressed"]
    if possible & _BIT["dehumanising"] and not own.isdisjoint(DEHUMANISING) and (aimed or own & {"all", "alle", "sont", "son", "es", "dieses"}):
        bits |= _BIT["dehumanising"]
    if possible & _BIT["stereotype"] and not own.isdisjoint(STEREOTYPES) and (aimed or "all" in own):
        bits |= _BIT["stereotype"]
    if possible & _BIT["hate"] and not own.isdisjoint(EXCLUDING):
        bits |= _BIT["hate"]
    if possible & _BIT["explicit"] and not own.isdisjoint(EXPLICIT):
        bits |= _BIT["explicit"]
    if possible & _BIT["intimate"] and len(own & INTIMATE) > 1:
        bits |= _BIT["intimate"]
    if addressed and possible & _BIT["violence"] and not own.isdisjoint(VIOLENT) and not own.isdisjoint(SPEAKERS):
        bits |= _BIT["violence"]
    return bits | _BIT["disguised"] * disguised


class Reader:
    """Statements of texts as hashed words and votes; what is learnt about words is kept from batch to batch."""

    MOST = 200_000

    def __init__(self):
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.hash, self.bits, self.kind = [], [], []  # kind: 1 a single letter or sign, 2 a disguised word

    def _number(self, tokens: list[str]) -> np.ndarray:
        out = np.empty(len(tokens), "i8")
        for i, token in enumerate(tokens):
            n = self.known.get(token)
            if n is None:
                n = self.known[token] = len(self.words)
                w, disguised = read_word(token)
                self.words.append(w)
                self.hash.append(zlib.crc32(b"0" if w.isdigit() else w.encode("utf-8", "surrogatepass")))
                self.bits.append(_suspects(w))
                self.kind.append(2 if disguised else 1 if len(w) == 1 else 0 if w else 3)
            out[i] = n
        return out

    def read(self, texts: pa.Array) -> Read:
        if len(self.words) > self.MOST:
            self._start()
        t = pc.fill_null(texts, "")
        t = pc.replace_substring_regex(t, _TAG, " ")
        t = pc.utf8_normalize(pc.replace_substring_regex(t, f"{_HIDDEN}+", _GONE), form="NFKC")
        t = pc.replace_substring_regex(t, r"""([.!?]["»”’')\]]*)\s+|([。！？।]["»”’')\]]*)|\n\s*\n""", rf"\1\2{_CUT}")
        t = pc.replace_substring_regex(t, r"\n(\s*(?:[*\-•>#]|\d+[.)])\s)", rf"{_CUT}\1")
        lists = pc.split_pattern(t, _CUT)
        said, owner = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.match_substring_regex(said, r"[^\s\x01]")
        said, owner = said.filter(full), owner.filter(full).to_numpy()
        tokens = pc.split_pattern_regex(pc.utf8_lower(said), _BREAK)
        coded = tokens.flatten().dictionary_encode()
        place = self._number(coded.dictionary.to_pylist())
        word = place[coded.indices.to_numpy()] if len(coded) else np.empty(0, "i8")
        kind = np.array(self.kind, "i1")
        who = pc.list_parent_indices(tokens).to_numpy()
        real = kind[word] != 3
        word, who = word[real], who[real]
        word, who, spaced = self._unspaced(word, who, kind)
        h = np.array(self.hash, "u8")[word]
        possible = np.zeros(len(said), "i8")
        bits = np.zeros(len(said), "i8")
        starts = np.searchsorted(who, np.arange(len(said) + 1))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            possible[some] = np.bitwise_or.reduceat(np.array(self.bits, "i8")[word], starts[some])
        disguised = np.zeros(len(said), bool)
        disguised[who[np.array(self.kind, "i1")[word] == 2]] = True
        disguised[list(spaced)] = True
        # violence counts beside somebody addressed and a speaker only
        alone = (possible & _BIT["violence"] != 0) & ((possible & _ADDRESSED == 0) | (possible & _SPEAKER == 0))
        possible = np.where(alone, possible & ~np.int64(_BIT["violence"]), possible) & (_ADDRESSED - 1)
        for i in np.flatnonzero(possible | disguised):
            ws = [self.words[j] for j in word[starts[i] : starts[i + 1]]]
            bits[i] = _judge(ws, int(possible[i]), bool(disguised[i]))
        return Read(said, owner, h, who, starts, bits)

    def _unspaced(self, word: np.ndarray, who: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Listed words in runs of single letters put together, and the statements that have one."""
        single = (kind[word] == 1).astype("i1")
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
        runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= 3]
        found: set[int] = set()
        drop, more, at = [], [], []
        for a, b in runs:
            for s in np.unique(who[a:b]).tolist():
                mine = np.flatnonzero(who[a:b] == s) + a
                if len(mine) < 3:
                    continue
                pieces = _segment("".join(self.words[j] for j in word[mine]).translate(_DIGITS))
                if any(x in _LEXICON for x in pieces) and (len(mine) > 3 or len(pieces) == 1):
                    found.add(s)
                    drop += mine.tolist()
                    more += pieces
                    at += [int(mine[0])] * len(pieces)
        if not found:
            return word, who, found
        keep = np.ones(len(word), bool)
        keep[drop] = False
        w = np.concatenate([word[keep], self._number(more)])
        p = np.concatenate([np.flatnonzero(keep), np.array(at)])
        s = np.concatenate([who[keep], who[np.array(at)]])
        order = np.lexsort((p, s))
        return w[order], s[order], found


@lru_cache(maxsize=1)
def own_reader() -> Reader:
    """The reader of this worker: what it has learnt about words serves later tasks and the second pass."""
    return Reader()


class Read:
    """Statements of a batch: their texts, the row each is from, hashed words with the statement each is of, and votes."""

    def __init__(self, said: pa.Array, owner: np.ndarray, h: np.ndarray, who: np.ndarray, starts: np.ndarray, bits: np.ndarray):
        self.said, self.owner, self.h, self.who, self.starts, self.bits = said, owner, h, who, starts, bits

    def names(self) -> np.ndarray:
        """A 32-bit name of the words of each statement, in order."""
        n = len(self.bits)
        mixed = self.h * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(self.h)) - self.starts[self.who]).astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = np.zeros(n, "u8")
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.starts[some])
        return (out ^ (out >> np.uint64(31))) & np.uint64(0xFFFFFFFF)

    def words(self, i: int) -> bytes:
        return self.h[self.starts[i] : self.starts[i + 1]].astype("u4").tobytes()


def statements(text: str | None) -> list[str]:
    """The statements of a text: cut at sentence ends, empty lines and list items; lines within one are joined."""
    return [" ".join(s.replace(_GONE, "").split()) for s in Reader().read(pa.array([text], pa.string())).said.to_pylist()]


def votes(statement: str) -> tuple[int, str]:
    """(bits of the voters that speak up, the words of the statement as they are read)."""
    reader = Reader()
    tokens = [x for x in pc.split_pattern_regex(pc.utf8_lower(pc.utf8_normalize(pc.replace_substring_regex(pa.array([statement]), f"{_HIDDEN}+", _GONE), form="NFKC")), _BREAK)[0].as_py()]
    word = reader._number(tokens)
    word = word[np.array(reader.kind, "i1")[word] != 3] if len(word) else word
    word, _, spaced = reader._unspaced(word, np.zeros(len(word), "i8"), np.array(reader.kind, "i1"))
    ws = [reader.words[j] for j in word]
    possible = 0
    for j in word:
        possible |= reader.bits[j]
    disguised = bool(spaced) or any(reader.kind[j] == 2 for j in word)
    possible &= _ADDRESSED - 1
    return _judge(ws, possible, disguised) if possible or disguised else 0, " ".join(ws)


def plain(statement: str) -> tuple[str, bool]:
    """(the words of a statement with disguises undone, whether a listed word was disguised)."""
    bits, s = votes(statement)
    return s, bool(bits & _BIT["disguised"])


class LabelModel:
    """How often each voter speaks on abusive and on other statements, learnt from the counts of vote patterns.

    Expectation-maximisation over a mixture of two kinds of statements.  A voter that keeps silent says nothing.
    Voters never count against their side: for a voter for abuse the odds of speaking are at least even.
    Voters that speak together on abusive statements more often than independence allows share one weight.
    The first belief in a voter weighs as much as three statements.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 60):
        patterns = np.array(sorted(counts), dtype="i8")
        n = np.array([counts[b] for b in patterns.tolist()], dtype="f8")
        x = self._spoken(patterns)
        side = np.array([-1.0 if v in AGAINST else 1.0 for v in VOTERS])
        pro, con = (x * (side > 0)).sum(1), (x * (side < 0)).sum(1)
        weak = x[:, [VOTERS.index(v) for v in WEAK]].sum(1)  # alone they are no sign of anything before the counts are seen
        p = np.where(pro > con, np.where(pro > weak, 0.9, 0.3), np.where(pro > 0, 0.2, 0.001))
        belief = np.where(side < 0, 0.1, np.where(np.isin(VOTERS, WEAK), 0.3, 0.9))
        self.log_ratio = np.zeros(len(VOTERS))
        self.rate, self.silent, self.correlation = 0.003, 1e-3, np.zeros((len(VOTERS), len(VOTERS)))
        for _ in range(rounds if n.sum() else 0):
            bad, good = (n * p).sum(), (n * (1 - p)).sum()
            self.rate = (bad + 1) / (bad + good + 2)
            often = ((n * p) @ x + 3 * belief) / (bad + 1)
            seldom = ((n * (1 - p)) @ x + 3 * (1 - belief)) / (good + 1)
            ratio = np.log(often / seldom)
            self.log_ratio = np.where(side > 0, np.maximum(ratio, 0), np.minimum(ratio, 0))
            self.correlation = self._correlations(x, n * p)
            self.silent = float(self.rate * np.prod(1 - np.clip(often[side > 0], 0, 0.9)))
            p = self._posterior(x)
        self.often, self.seldom = (often, seldom) if n.sum() else (np.zeros(len(VOTERS)),) * 2

    @staticmethod
    def _spoken(patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(len(VOTERS))) & 1

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        shared = 1 + x @ np.clip(self.correlation, 0, 1)  # voters that speak beside it and are correlated with it
        logit = np.log(self.rate / (1 - self.rate)) + (x * self.log_ratio / shared).sum(1)
        return np.where(x.any(1), 1 / (1 + np.exp(-np.clip(logit, -30, 30))), self.silent)

    @staticmethod
    def _correlations(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Correlation of the voters among abusive statements, which the label does not explain, shrunk where these are few; zero diagonal."""
        total = max(w.sum(), 1e-9)
        d = x - (w @ x) / total
        cov = (d * w[:, None]).T @ d / total
        s = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
        return total / (total + 100) * cov / np.outer(s, s) * (1 - np.eye(x.shape[1]))

    def posteriors(self, bits: np.ndarray) -> np.ndarray:
        """Posteriors that statements with these vote patterns are abusive; ``silent`` without any vote."""
        return self._posterior(self._spoken(np.asarray(bits, "i8")))

    def posterior(self, bits: int) -> float:
        return float(self.posteriors(np.array([bits]))[0])


def features(h: np.ndarray, who: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, statements) of the hashed words and word pairs and of the votes, in order of statements.

    Places below BUCKETS are words and pairs; those from there on are voters.
    """
    same = who[1:] == who[:-1]
    pair, pair_who = (h[:-1] * np.uint64(1_000_003) ^ h[1:])[same], who[1:][same]
    vote_who, vote = np.nonzero((bits[:, None] >> np.arange(len(VOTERS))) & 1)
    place = np.concatenate([(h % np.uint64(BUCKETS)).astype("i8"), (pair % np.uint64(BUCKETS)).astype("i8"), BUCKETS + vote])
    owner = np.concatenate([who, pair_who, vote_who])
    order = np.argsort(owner, kind="stable")
    return place[order], owner[order]


class Linear:
    """Logistic regression on sparse features, fitted to soft labels by adaptive gradient steps on blocks of rows."""

    WORD = 0.6  # a word moves the score less than a vote

    def __init__(self):
        self.w, self.b = np.zeros(BUCKETS + len(VOTERS)), -3.0

    @property
    def gain(self) -> np.ndarray:
        return np.where(np.arange(len(self.w)) >= BUCKETS, 1.0, self.WORD)

    def fit(self, sample: Sample, labels: np.ndarray, epochs: int = 12, block: int = 256, rate: float = 0.3, penalty: float = 1e-4, seed: int = 3) -> Linear:
        n = len(labels)
        place, owner = features(sample.h, sample.who, sample.bits)
        starts = np.searchsorted(owner, np.arange(n + 1))
        rng, scale, gain = np.random.default_rng(seed), np.full(len(self.w), 1e-6), self.gain
        for _ in range(max(epochs, 300 * block // n) if n else 0):  # few rows are seen more often: 300 steps at least
            order = rng.permutation(n)
            for at in range(0, n, block):
                rows = order[at : at + block]
                size = starts[rows + 1] - starts[rows]
                own = np.repeat(np.arange(len(rows)), size)
                f = place[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[rows], size)]
                value = self.b + np.bincount(own, self.w[f] * gain[f], len(rows))
                off = 1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels[rows]
                used = np.unique(f)
                step = np.bincount(np.searchsorted(used, f), off[own] * gain[f], len(used)) + penalty * len(rows) * self.w[used]
                scale[used] += step * step
                self.w[used] -= rate * step / np.sqrt(scale[used])
                self.b -= rate * off.mean()
        return self

    def scores(self, h: np.ndarray, who: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Probability that each statement is abusive."""
        n, words = len(bits), (self.WORD * self.w[:BUCKETS]).astype("f8")
        value = self.b + np.bincount(who, words[h % np.uint64(BUCKETS)], n)
        same = who[1:] == who[:-1]
        value += np.bincount(who[1:][same], words[(h[:-1] * np.uint64(1_000_003) ^ h[1:])[same] % np.uint64(BUCKETS)], n)
        spoken = np.flatnonzero(bits)
        value[spoken] += ((bits[spoken, None] >> np.arange(len(VOTERS))) & 1) @ self.w[BUCKETS:]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


class Sample:
    """Sampled statements: hashed words, the statement each is of, votes."""

    def __init__(self, bits: np.ndarray, words: list[bytes]):
        self.bits, self.parts = np.asarray(bits, "i8"), words
        self.h = np.frombuffer(b"".join(words), "u4").astype("u8")
        self.who = np.repeat(np.arange(len(words)), [len(w) // 4 for w in words])

    def __len__(self) -> int:
        return len(self.parts)

    def take(self, rows: np.ndarray, votes: bool = True) -> Sample:
        return Sample(self.bits[rows] if votes else np.zeros(len(rows), "i8"), [self.parts[i] for i in rows])

    def __add__(self, other: Sample) -> Sample:
        return Sample(np.concatenate([self.bits, other.bits]), self.parts + other.parts)


def _gather(sample: int, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = own_reader(), Counter()
        kept = pd.DataFrame({"bits": np.empty(0, "i8"), "n": np.empty(0, "i8"), "words": np.empty(0, object)})
        for batch in by_bytes(batches, 0):
            r = reader.read(batch.column(0))
            b, k = np.unique(r.bits, return_counts=True)
            counts.update(dict(zip(b.tolist(), k.tolist())))
            name = r.names().astype("i8")
            first = np.unique(np.stack([r.bits, name]), axis=1, return_index=True)[1]
            first = first[np.lexsort((name[first], r.bits[first]))]
            own = r.bits[first]
            place = np.arange(len(first)) - np.searchsorted(own, own)
            first = first[place < np.where(own > 0, each, sample)]
            more = pd.DataFrame({"bits": r.bits[first], "n": name[first], "words": [r.words(i) for i in first]})
            kept = pd.concat([kept, more]).drop_duplicates(["bits", "n"]).sort_values(["bits", "n"])
            kept = kept[kept.groupby("bits").cumcount() < np.where(kept["bits"] > 0, each, sample)]
        rows = [*(("count", b, n, None) for b, n in counts.items()), *(("statement", *x) for x in kept.itertuples(index=False, name=None))]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "bits", "n", "words"), x)) for x in rows], schema=pa.schema([("kind", pa.string()), ("bits", pa.int64()), ("n", pa.int64()), ("words", pa.binary())]))

    return run


def fit(documents: DataFrame, sample: int = SAMPLE, each: int = EACH, voted: int = VOTED) -> tuple[LabelModel, Linear]:
    """The label model of the whole corpus' votes, and the classifier fitted on a bounded sample of distinct statements.

    At most ``sample`` statements without a vote, ``each`` of every vote pattern and ``voted`` with votes in all: those
    with the smallest hashes, patterns taking turns, so that rare ones are seen however large the corpus is.
    """
    gathered = documents.where("text is not null").select("text").mapInArrow(_gather(sample, each), "kind string, bits long, n long, words binary")
    gathered = cut_lineage(gathered)
    counts = {r["bits"]: r["n"] for r in gathered.where("kind = 'count'").groupBy("bits").agg(F.sum("n").alias("n")).collect()}  # at most 2 ** voters rows
    model = LabelModel(counts)
    place = F.row_number().over(Window.partitionBy("bits").orderBy("n", "words"))
    distinct = gathered.where("kind = 'statement'").select("n", "bits", "words").distinct()
    ranked = distinct.withColumn("place", place).where(F.col("place") <= F.when(F.col("bits") > 0, each).otherwise(sample)).where(F.col("place") <= max(each, sample))
    heard = ranked.where("bits > 0").orderBy("place", "n", "bits").limit(voted)
    rows = [(r["bits"], bytes(r["words"])) for r in heard.unionByName(ranked.where("bits = 0")).select("bits", "place", "words").collect()]
    rows.sort()
    return model, train(model, Sample(np.array([b for b, _ in rows], "i8"), [w for _, w in rows]))


def train(model: LabelModel, sample: Sample) -> Linear:
    """The classifier of sampled statements.

    Statements without votes are halved by turns; each half is judged by a classifier that takes the other half for
    background.  In the last fit that judgement is its label; one that reaches ``RELIABLE`` is no background and left out.
    """
    voted, silent = sample.take(np.flatnonzero(sample.bits)), sample.take(np.flatnonzero(sample.bits == 0))
    known = voted + voted.take(np.arange(len(voted)), votes=False)
    labels = np.tile(model.posteriors(voted.bits), 2)
    judged = np.full(len(silent), model.silent)
    for half in (0, 1):
        mine, others = np.arange(len(silent))[half::2], np.arange(len(silent))[1 - half :: 2]
        if len(voted) and len(mine) and len(others):
            other, some = silent.take(others), silent.take(mine)
            judged[mine] = Linear().fit(known + other, np.concatenate([labels, np.full(len(others), model.silent)])).scores(some.h, some.who, some.bits)
    sure = np.flatnonzero(judged < RELIABLE)
    return Linear().fit(known + silent.take(sure), np.concatenate([labels, judged[sure]]))


def scores(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score, n_statements, worst): for every document the score of its worst statement.

    A statement's score is the classifier's probability.  Null, empty and blank texts have no statement and score 0;
    documents with the same text score alike.  ``worst`` is that statement as it is read.
    """
    _, linear = fit(documents, sample)
    shared = documents.sparkSession.sparkContext.broadcast((linear.w.astype("f4"), linear.b))  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("n_statements", pa.int32()), ("worst", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lin, reader = Linear(), own_reader()
        lin.w, lin.b = shared.value
        for batch in by_bytes(batches, 2):
            r = reader.read(batch.column(2))
            value = lin.scores(r.h, r.who, r.bits)
            n = np.bincount(r.owner, minlength=len(batch))
            order = np.lexsort((np.arange(len(value)), -value, r.owner))  # the first of the worst ones of each document
            at = order[(np.cumsum(n) - n)[n > 0]]
            best, worst = np.zeros(len(batch)), np.full(len(batch), -1)
            best[n > 0], worst[n > 0] = value[at], at
            said = r.said.take(pa.array(worst, mask=worst < 0))
            said = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.replace_substring(said, _GONE, ""), r"\s+", " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(n, pa.int32()), said.cast(pa.string())], schema=schema)

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, n_statements int, worst string")


def flagged(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id) of the documents whose score reaches ``least``."""
    return scores(documents).where(F.col("score") >= least).select("doc_id").distinct()


def source_rates(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(source, n_documents, n_flagged, rate, mean_score); documents without a source come under null."""
    s = scores(documents)
    hit = (F.col("score") >= least).cast("long")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(hit).alias("n_flagged"), F.avg(hit.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
