"""String functions as Column builders; everything stays in the JVM.

All of them pass null through unless the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def trimmed(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, rf"^{SPACE}|{SPACE}$", "")


def squeezed(x: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return trimmed(F.regexp_replace(x, SPACE, " "))


def normalised(x: Column) -> Column:
    """As :func:`squeezed`, in lower case: how expected strings and texts are compared."""
    return F.lower(squeezed(x))


def slug(x: Column) -> Column:
    """Safe as part of a file name: every other character becomes an underscore."""
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_")


def sentences(x: Column) -> Column:
    """Array of trimmed, non-empty sentences; a line end also ends one.  Null and blank give the empty array."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def answer_sentences(x: Column) -> Column:
    """As :func:`sentences`, for answers: only a full stop, question or exclamation mark ends one, a line end does not."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def without_think(x: Column) -> Column:
    """Without closed think blocks."""
    return F.regexp_replace(x, r"(?is)<think[^>]*>.*?</think>", "")


def without_verdict_tags(x: Column) -> Column:
    """Without the confidence and warning tags a verifier puts at the end."""
    return F.regexp_replace(x, r"\s*\[Confidence:\s*\d+%\]\s*(?:\[Warning:[^\]]*\])?\s*$", "")


def neutral_tags(x: Column, names: tuple[str, ...] = ("QUERY", "CONTEXT", "ANSWER", "OUTPUT"), most: int = 4000) -> Column:
    """At most ``most`` characters in which no prompt delimiter is left whole."""
    return F.regexp_replace(F.substring(x, 1, most), rf"<(/?(?:{'|'.join(names)})>)", "< $1")


def snake_key(x: Column) -> Column:
    """camelCase as snake_case."""
    return F.lower(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1_$2"))


#: Openings of a first message that a title leaves out, tried in this order.
TITLE_OPENINGS = ("hey", "hi", "hello", "can you", "please", "i want", "i need")


def session_title(x: Column, most: int = 50) -> Column:
    """A title from a first message: one opening dropped, first letter raised, cut with dots; under 3 characters "New Chat"."""
    t = trimmed(x)
    body = t
    for opening in reversed(TITLE_OPENINGS):
        body = F.when(F.lower(t).startswith(opening), trimmed(F.substring(t, len(opening) + 1, 2**30))).otherwise(body)
    body = F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 2**30))
    body = F.when(F.length(body) > most, F.concat(trimmed(F.substring(body, 1, most)), F.lit("..."))).otherwise(body)
    return F.when(F.length(body) < 3, F.lit("New Chat")).otherwise(body)


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def uploaded_name(path: Column) -> Column:
    """The last part of a path without the identifier an upload puts in front."""
    return F.regexp_replace(file_name(path), r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}_", "")


def preview(x: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with an ellipsis if cut."""
    t = squeezed(x)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def outside_fences(x: Column, f) -> Column:
    """``f`` applied to the parts outside ``` fences, the fenced parts as they are."""
    parts = F.split(x, "```")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, f(p)).otherwise(p)), "```")


def calm_spacing(x: Column) -> Column:
    """Outside fences: no blanks at line ends, at most one empty line in a row."""
    return outside_fences(x, lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def sha1_prefix(x: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(x), 1, n)


def tokens_by_fours(chars: Column) -> Column:
    """A quarter of the characters, 1 at least: the length used for chunking."""
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("int")


def tokens_for_budget(chars: Column) -> Column:
    """Characters by 3.5, rounded down, plus 1: the length used for packing."""
    return (F.floor(chars / 3.5) + 1).cast("int")


def context_bucket(chars: Column, buckets: tuple[int, ...] = (8192, 16384, 32768), headroom: int = 2048) -> Column:
    """The smallest context window that holds a prompt of ``chars`` characters and its answer; the largest if none does."""
    need = F.floor(chars / 3) + headroom
    out = F.lit(buckets[-1])
    for b in reversed(buckets):
        out = F.when(need <= b, F.lit(b)).otherwise(out)
    return out


def prompt_was_cut(window: Column, used: Column, chars: Column) -> Column:
    """Whether the token counts of a response show that the start of its prompt was dropped."""
    full = (window > 0) & (used >= window - 16)
    short = (used > 0) & (chars > 0) & (used < F.floor(chars / 6))
    return F.coalesce(full | short, F.lit(False))


def is_remote_model(name: Column) -> Column:
    return F.coalesce(name.contains("/"), F.lit(False))


def vectors_path(path: Column) -> Column:
    """Where the vectors of an overview file lie."""
    return F.regexp_replace(path, r"\.jsonl$", ".vectors.npz")


def clean_summary(x: Column) -> Column:
    """A model's summary: no think block or role tag, after "Answer:" if there is one, the first line; '' if under 5 characters."""
    raw = trimmed(F.coalesce(x, F.lit("")))
    t = F.regexp_replace(without_think(raw), r"(?i)<assistant[^>]*>|</assistant>", "")
    t = F.when(t.contains("Answer:"), t.substr(F.locate("Answer:", t) + F.lit(7), F.lit(2**30))).otherwise(t)
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), trimmed), lambda s: s != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    first = F.when(first == "", raw).otherwise(first)
    return F.when(F.length(first) < 5, F.lit("")).otherwise(first)


def query_with_instruction(query: Column, model: Column, task: str = "Given a web search query, retrieve relevant passages that answer the query") -> Column:
    """The query with the instruction some embedding models want, and as it is for others."""
    wants = F.lower(model).contains("qwen3-embedding") | F.lower(model).contains("harrier")
    return F.when(wants, F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)).otherwise(query)


# --- fixed values: small talk, as phrases of plain words ----------------------------------------
TALK = (
    "hi", "hey", "hello", "heya", "yo", "howdy", "greetings",
    "good morning", "good afternoon", "good evening", "good day",
    "how are you", "how are u", "how are ya", "how are you doing", "how are u doing", "how are ya doing",
    "how s it going", "hows it going", "what s up", "whats up", "sup",
    "thanks", "thank you", "thx", "ty", "cheers", "much appreciated", "appreciate it",
    "bye", "goodbye", "good night", "goodnight", "see you", "see ya", "talk to you later", "take care", "later",
    "ok", "okay", "kk", "alright", "got it", "understood", "i see", "sounds good", "no problem", "np", "never mind", "nevermind", "nvm",
    "cool", "nice", "awesome", "perfect", "great", "yes", "yeah", "yep", "nope", "no", "sorry", "please", "lol", "haha",
)
#: Words that go along with small talk and are none by themselves.
TALK_BESIDE = ("there", "again", "all", "everyone", "folks", "guys", "team", "friend", "buddy", "mate", "man", "dude", "bot", "assistant", "a lot", "so much", "very much", "so", "much", "very", "then", "too", "and", "well", "my", "you")
#: Words that are often drawn out, as in "heyyy".
DRAWN_OUT = ("hi", "hey", "hello", "bye", "haha")
TALK_WORDS = 6
#: Openings that may stand before a question about the assistant.
ABOUT_OPENINGS = ("so", "and", "btw", "hey", "hi", "hello")


def about_phrases() -> list[str]:
    """Questions about the assistant itself, put together from their parts."""
    are, you = ("are", "r"), ("you", "u")
    doing = [*(f"{a} {y}" for a in are for y in you), "do you use", "do you run", "do you run on"]
    out = [f"{w} {a} {y}" for w in ("who", "what", "what version") for a in are for y in you]
    out += [f"{w} {kind}model {d}" for w in ("what", "which") for kind in ("", "llm ", "ai ", "language ") for d in doing]
    out += [f"{w} {kind} {a} {y}" for w in ("what", "which") for kind in ("llm", "ai") for a in are for y in you]
    out += ["what is your name", "what s your name", "what can you do", "tell me about yourself", "introduce yourself"]
    out += [f"what {d} you run{ing}{on}" for d in ("are", "do") for ing in ("", "ning") for on in ("", " on")]
    out += [f"are you {article}{kind}" for article in ("", "a ", "an ") for kind in ("ai", "bot", "human", "robot", "chatgpt", "gpt", "claude", "llm", "language model")]
    return out + [f"who {did} you" for did in ("made", "built", "created", "trained")]


def plain_words(message: Column) -> Column:
    """The words of a message in lower case, drawn-out ones at their usual length, version numbers dropped."""
    t = F.regexp_replace(F.lower(message), r"\bgpt-?\d*\b", "gpt")
    ws = F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    drawn = "|".join(f"^({w}){w[-1]}*$" for w in DRAWN_OUT)
    return F.transform(ws, lambda w: F.regexp_replace(w, drawn, "".join(f"${i + 1}" for i in range(len(DRAWN_OUT)))))


def covered_by(ws: Column, core: tuple[str, ...], beside: tuple[str, ...]) -> Column:
    """Whether the words can be divided into listed phrases of which one at least is a core phrase.

    A fold over the words keeps the places up to which they can be divided, one list without and one with a core phrase.
    """
    longest = max(len(p.split()) for p in (*core, *beside))
    known = lambda phrase, kind: F.array_contains(F.array(*[F.lit(p) for p in kind]), phrase)

    def step(state: Column, i: Column) -> Column:
        plain, with_core = state["plain"], state["core"]
        for n in range(1, longest + 1):
            phrase = F.concat_ws(" ", F.slice(ws, i, n))
            fits = i + n - 1 <= F.size(ws)
            here, there = F.array_contains(state["plain"], i - 1), F.array_contains(state["core"], i - 1)
            end = F.array(i + n - 1)
            plain = F.when(fits & here & known(phrase, (*core, *beside)), F.array_union(plain, end)).otherwise(plain)
            with_core = F.when(fits & ((here & known(phrase, core)) | (there & known(phrase, (*core, *beside)))), F.array_union(with_core, end)).otherwise(with_core)
        return F.struct(plain.alias("plain"), with_core.alias("core"))

    first = F.struct(F.array(F.lit(0)).alias("plain"), F.array().cast("array<int>").alias("core"))
    reached = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws))), first, step)
    return F.array_contains(reached["core"], F.size(ws))


def is_small_talk(message: Column) -> Column:
    """Nothing but small talk, a question about the assistant, or blank (null counts as blank)."""
    t = trimmed(F.coalesce(message, F.lit("")))
    ws = plain_words(t)
    about = F.array(*[F.lit(p) for p in about_phrases()])
    rest = F.when(F.get(ws, F.lit(0)).isin(*ABOUT_OPENINGS), F.slice(ws, 2, F.greatest(F.lit(0), F.size(ws) - 1))).otherwise(ws)
    asks = F.array_contains(about, F.concat_ws(" ", ws)) | F.array_contains(about, F.concat_ws(" ", rest))
    short = F.size(F.split(t, r"\s+")) <= TALK_WORDS
    # the fold only where it can end well: a long message is looked at no further
    return (t == "") | asks | (short & F.when(short, covered_by(ws, TALK, TALK_BESIDE)).otherwise(F.lit(False)))


def wants_retrieval(message: Column, has_index: Column, forced: Column, filters: Column | None = None) -> Column:
    """Whether a message is searched for: forced or filtered, or an index is linked and it is no small talk."""
    filtered = F.lit(False) if filters is None else F.coalesce(filters != "", F.lit(False))
    return F.coalesce(forced, F.lit(False)) | filtered | (F.coalesce(has_index, F.lit(False)) & ~is_small_talk(message))
