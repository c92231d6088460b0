"""Repair of text from scanned pages: split words, misread characters, running heads, page numbers.

Passes over the chunks are maps.  The first counts words and word pairs of the
whole corpus and head-like lines of every document (counted within a task before
anything is shuffled).  A word is misread if it falls together with a far more
frequent word once confusable glyphs are drawn alike, and its neighbours are seen far
more often with that word: both are joins over all counts, whatever their size.  What
comes out, the words that may be misread and the neighbours that say so, is joined to
the chunks that hold them, as are the heads a document repeats to the chunks that have
such a line; only a filter of fixed size is broadcast, which keeps other words out of that
join.  The last pass judges each chunk.  The repaired lines are
put into paragraphs with SQL windows.
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

#: Places of the filter of words that may be misread; more words only let more through to the join.
PLACES = 1 << 20
#: What a word pair that was never seen counts for.
UNSEEN = 0.125
#: A word must be this many times rarer than the form it is taken for, and in its context; less if it holds a digit or sign.
RATIO, RATIO_SIGN = 12, 2
# --- fixed values: glyphs that scanners take for one another --------------------------------
_ALIKE = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "ı": "l", "!": "l", "5": "s", "$": "s", "@": "a", "e": "c", "é": "c", "f": "t", "7": "t", "b": "h", "6": "h", "q": "g", "9": "g", "u": "v", "8": "h"})
_JOINED = re.compile("rl|cl|vv")
_DRAWN = {"rl": "n", "cl": "d", "vv": "w"}
_LOST = "¬¦§¤^~¢£■□\ufffd"
_WORD = re.compile(rf"[\w|@${re.escape(_LOST)}]+")
_SPLIT = re.compile(r"(?<![\w|@])([^\W\d_][\w|@]*)[-­‐‑][ \t]*\r?\n[ \t]*([^\W\d_|@][\w|@]*)")
_SPLIT_AROUND = re.compile(r"(?<![\w|@])([^\W\d_][\w|@]*)[-­‐‑][ \t]*\r?\n\s*([^\W\d_|@][\w|@]*)")
_CODE = re.compile(r"\b[A-Z]{1,4}-\d{2,}(?:/\d+)?\b|\b[A-Z]\d{2,}[A-Z]?\b|(?<!\S)[^\s/\\_]*[/\\_]\S*|(?<!\S)[^\s@]+@\S+\.\S+")
#: Lines that could be a head: no sentence, and a capital, sign or digit at the start.
_HEADLIKE = re.compile(r"^[ \t]*([^\W_a-zà-ÿ](?:[^\n.!?;]|\.(?= ?\d)){3,100})$", re.M)
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]+-[^\W\d_]+(?![\w-])")
_PAGE = re.compile(r"^(?:(?:p|pp|pg|page|seite|página|pagina|pág|s)\.?\s*|[-–—\[(|]\s*)?(\d{1,5})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?(?:\s*[-–—\])|])?$", re.I)
_MARKED = re.compile(r"[^\d\s]|\d\s*/\s*\d")
_BESIDE = (re.compile(r"^(\d{1,5})\s*[|·•–—-]\s+(?=\D)"), re.compile(r"(?<=\S)(?:\s{2,}|\s*[|·•]\s*|\t)(\d{1,5})$"))
_VALUE = re.compile(r"^\d+(?:[.,]\d+)?\s+\S+(?:\s\S+)?$")
_SECTION = re.compile(r"^(?:\d+\.)+\d*\s|^[#>*•-]\s")


def skeleton(word: str) -> str:
    """The word with confusable glyphs drawn alike."""
    s = word.lower().translate(_ALIKE)
    return _JOINED.sub(lambda m: _DRAWN[m.group()], s).replace("rn", "m")


def _letters(word: str) -> bool:
    """Whether a token is a word at all: two letters at least, and mostly letters."""
    n = sum(c.isalpha() for c in word)
    return n >= 2 and n * 5 >= len(word) * 3 and "_" not in word


def words_of(text: str) -> list[str]:
    """Tokens in lower case, words split at a line end put together; codes, paths and numbers are blanked."""
    if "\n" in text:
        text = _SPLIT.sub(r"\1\2", text)
    return ["0" if w.isdigit() else w for w in _WORD.findall(_CODE.sub(" _ ", text).lower())]


def bare_head(line: str) -> tuple[str, int | None]:
    """A line without a page number beside it, and that number."""
    s = line.strip()
    for pattern in _BESIDE:
        m = pattern.search(s)
        if m:
            return (s[: m.start()] + s[m.end() :]).strip(), int(m.group(1))
    return s, None


def head_key(line: str) -> str | None:
    """Digits masked and glyphs drawn alike, if the line could be a running head: short, titled words, no sentence."""
    s, _ = bare_head(line)
    if not 4 <= len(s) <= 90 or re.search(r"[.!?;,:]$", s) or _SECTION.match(s):
        return None
    names = [w for w in re.findall(r"[^\W\d_][\w@|]*", s)]
    if len(names) < 2 or sum(w[0].isupper() for w in names) * 3 < len(names) * 2:
        return None
    return re.sub(r"\s+", " ", skeleton(re.sub(r"\d+(?![^\W\d_])", "#", s)))


@lru_cache(maxsize=4096)
def name_keys(document_id: str | None) -> frozenset[str]:
    """Skeletons of the words of a document's name."""
    base = re.sub(r"\.\w{1,5}$", "", document_id or "")
    return frozenset(skeleton(w) for w in re.split(r"[\W_]+", base) if len(w) > 1 and not w.isdigit())


def named_head(line: str, name: frozenset[str]) -> bool:
    """Whether most words of a head-like line come from the document's name, two at least."""
    s, _ = bare_head(line)
    words = [skeleton(w) for w in re.findall(r"[\w@|]+", s) if any(c.isalpha() for c in w)]
    shared = [w for w in words if w in name]
    return len(shared) >= 2 and 2 * len(shared) >= len(words)


_BLANK = r"[\s\v\x1c-\x1f\x{85}\p{Z}]+"
_HYPHEN_END = r"[-\x{ad}\x{2010}\x{2011}][ \t]*\r?\n"


class Tokens:
    """The words of many texts at once: every distinct run between white space is looked at once.

    Words, codes and compounds never cross white space, so a text's words are those of its runs in order.
    """

    MOST = 200_000

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.runs: dict[str, int] = {}
        self.parts: list[list[int]] = []

    def _word(self, w: str) -> int:
        n = self.number.get(w)
        if n is None:
            n = self.number[w] = len(self.words)
            self.words.append(w)
        return n

    def look(self, run: str) -> list[int]:
        """Numbers of the words a run adds."""
        return [self._word(w) for w in words_of(run)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, row) of all words in order, and (run, row) of all runs."""
        lists = pc.split_pattern_regex(texts, _BLANK)
        coded = lists.flatten().dictionary_encode()
        known = np.empty(len(coded.dictionary), "i8")
        for i, run in enumerate(coded.dictionary.to_pylist()):
            n = self.runs.get(run)
            if n is None:
                n = self.runs[run] = len(self.parts)
                self.parts.append(self.look(run))
            known[i] = n
        run = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, "i8")
        row = pc.list_parent_indices(lists).to_numpy()
        own, at = np.unique(run, return_inverse=True)
        lengths = np.array([len(self.parts[n]) for n in own], "i8")
        flat = np.array([w for n in own for w in self.parts[n]], "i8")
        begins = np.cumsum(lengths) - lengths
        size = lengths[at] if len(own) else np.empty(0, "i8")
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[at] if len(own) else size, size)
        return flat[place], np.repeat(row, size), run, row


class CountedTokens(Tokens):
    """Tokens with the compounds each run has."""

    def __init__(self):
        super().__init__()
        self.compounds: list[list[int]] = []

    def look(self, run: str) -> list[int]:
        self.compounds.append([self._word(w.lower()) for w in _COMPOUND.findall(run)] if "-" in run else [])
        return super().look(run)


def _joined(texts: pa.Array) -> pa.Array:
    """Texts in which words split at a line end are put together."""
    some = pc.match_substring_regex(texts, _HYPHEN_END)
    if not pc.any(some).as_py():
        return texts
    return pc.replace_with_mask(texts, some, pa.array([_SPLIT.sub(r"\1\2", t) for t in texts.filter(some).to_pylist()], texts.type))


def _counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(x, return_inverse=True)
    return own, np.bincount(at, n, len(own)).astype("i8")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    tokens, one, two, heads = CountedTokens(), [], [], Counter()

    def counts() -> Iterator[pa.RecordBatch]:
        words = pa.array(tokens.words, pa.string())
        w, n = (_counted(np.concatenate([x for x, _ in one]), np.concatenate([y for _, y in one])) if one else (np.empty(0, "i8"),) * 2)
        real = np.array([_letters(tokens.words[i]) for i in w], bool)
        w, n = w[real], n[real]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("word"), len(w)), words.take(pa.array(w)), pa.nulls(len(w), pa.string()), pa.array(n)], schema=schema)
        k, n = (_counted(np.concatenate([x for x, _ in two]), np.concatenate([y for _, y in two])) if two else (np.empty(0, "u8"), np.empty(0, "i8")))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("pair"), len(k)), words.take(pa.array((k >> np.uint64(32)).astype("i8"))), words.take(pa.array((k & np.uint64(0xFFFFFFFF)).astype("i8"))), pa.array(n)], schema=schema)
        yield pa.RecordBatch.from_pydict({"kind": ["head"] * len(heads), "a": [d for d, _ in heads], "b": [h for _, h in heads], "n": list(heads.values())}, schema=schema)

    for batch in by_bytes(batches, 1):
        texts = _joined(batch.column(1))
        plain = batch.column(1)
        w, row, _, _ = tokens.read(texts)
        one.append(_counted(w))
        same = row[1:] == row[:-1]
        two.append(_counted(w[:-1][same].astype("u8") << np.uint64(32) | w[1:][same].astype("u8")))
        hyphens = pc.match_substring(plain, "-")
        if pc.any(hyphens).as_py():
            _, _, run, _ = tokens.read(plain.filter(hyphens))
            one.append(_counted(np.array([c for r in run[np.array([bool(x) for x in tokens.compounds])[run]] for c in tokens.compounds[r]], "i8")))
        lines = pc.and_(pc.is_valid(batch.column(0)), pc.match_substring(plain, "\n"))
        for document, text in zip(batch.column(0).filter(lines).to_pylist(), plain.filter(lines).to_pylist()):
            heads.update({(document, k) for line in _HEADLIKE.findall(text) if (k := head_key(line))})
        if len(two) > 8:
            two = [_counted(np.concatenate([x for x, _ in two]), np.concatenate([y for _, y in two]))]
            one = [_counted(np.concatenate([x for x, _ in one]), np.concatenate([y for _, y in one]))]
        if len(two[0][0]) > 500_000 or len(tokens.runs) > Tokens.MOST:
            yield from counts()
            tokens, one, two, heads = CountedTokens(), [], [], Counter()
    yield from counts()


class Readings:
    """What the words of a chunk may be misread from, and the neighbours that say so; the compounds it has."""

    def __init__(self, rows):
        self.known: dict[str, tuple[str, set[str], set[str]]] = {}
        self.compounds: set[str] = set()
        for r in rows if rows is not None else ():
            if r["g"] is None:
                self.compounds.add(r["w"])
            else:
                self.known[r["w"]] = (r["g"], *(set(x) if x is not None else set() for x in (r["before"], r["after"])))

    def misread(self, ws: list[str]) -> list[tuple[int, str]]:
        """(place, right form) of the misread words among ``ws``."""
        out: list[tuple[int, str]] = []
        if not self.known:
            return out
        for i, w in enumerate(ws):
            if w in self.known:
                g, before, after = self.known[w]
                # a digit or sign inside a word that exists without it needs no neighbour
                if not w.isalpha() or (i and ws[i - 1] in before) or (i + 1 < len(ws) and ws[i + 1] in after):
                    out.append((i, g))
        return out


NOTHING = Readings(None)


def _page_of(metadata: str | None) -> int | None:
    m = re.search(r'"page"\s*:\s*(\d+)', metadata or "")
    return int(m.group(1)) if m else None


def page_lines(lines: list[str], page: int | None) -> set[int]:
    """Lines that are a page's number alone; a number in a table of values is none."""
    out = set()
    bare = [x.strip() for x in lines]
    for i, s in enumerate(bare):
        m = _PAGE.match(s)
        if not m or (page is not None and int(m.group(1)) != page):
            continue
        if not _MARKED.search(s):
            around = [x for x in (next((y for y in reversed(bare[:i]) if y), ""), next((y for y in bare[i + 1 :] if y), ""))]
            if _VALUE.match(around[1]) and (around[0].endswith(("values", "value")) or _VALUE.match(around[0]) or i == 0):
                continue
            if page is None and not (around[0] or around[1]):
                continue
        out.add(i)
    return out


def judge(text: str, document_id: str | None, metadata: str | None, repeated: set[str], lexicon: Readings) -> tuple[set[str], list[str]]:
    """(kinds of noise, repaired lines without heads and page numbers)."""
    noise: set[str] = set()
    page, name = _page_of(metadata), name_keys(document_id)
    lines = text.split("\n")
    headlike = set(_HEADLIKE.findall(text))
    numbers = page_lines(lines, page)
    kept = []
    for i, line in enumerate(lines):
        if i in numbers:
            noise.add("page_number")
            continue
        key = head_key(line) if line.strip(" \t") in headlike or line.lstrip(" \t") in headlike else None
        if key and (named_head(line, name) or key in repeated):
            noise.add("header")
            _, beside = bare_head(line)
            if beside is not None and (page is None or beside == page):
                noise.add("page_number")
            continue
        kept.append(line)
    if lexicon.known and lexicon.misread(words_of(text)):
        noise.add("misread")
    body = "\n".join(kept)

    def join(m: re.Match) -> str:
        a, b = m.group(1), m.group(2)
        if f"{a}-{b}".lower() in lexicon.compounds:
            return m.group()
        noise.add("hyphen")
        return a + b + "\n"

    body = _SPLIT_AROUND.sub(join, body)
    if "misread" in noise:
        spans = [m.span() for m in _WORD.finditer(_CODE.sub(lambda m: "_" * len(m.group()), body))]
        fixes = lexicon.misread(["0" if body[a:b].isdigit() else body[a:b].lower() for a, b in spans])
        for i, g in reversed(fixes):
            a, b = spans[i]
            w = body[a:b]
            g = g.upper() if w.isupper() and len(w) > 1 else g.capitalize() if w[0].isupper() else g
            body = body[:a] + g + body[b:]
    return noise, body.split("\n")


def count(chunks: DataFrame) -> DataFrame:
    """(kind, a, b, n): how often every word, word pair and head-like line of a document occurs; written once."""
    counted = chunks.where("text is not null").select("document_id", "text").mapInArrow(_count, "kind string, a string, b string, n long")
    return cut_lineage(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))


def repeated_heads(counted: DataFrame, least_repeats: int = 4) -> DataFrame:
    """(document_id, key) of head-like lines in at least ``least_repeats`` chunks."""
    return counted.where((F.col("kind") == "head") & (F.col("n") >= least_repeats)).select(F.col("a").alias("document_id"), F.col("b").alias("key"))


def _shape(word: str) -> str:
    return "".join("." if c in _LOST else "x" for c in word)


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        w = pdf["w"]
        lost = w.map(lambda x: any(c in _LOST for c in x)).astype(bool)
        yield pd.DataFrame({"w": w, "n": pdf["n"], "k": w.map(skeleton), "alpha": w.map(str.isalpha).astype(bool), "shape": w.map(_shape).where(lost, None), "size": w.map(len).astype("int32")})


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"k": ["".join("." if y == "." else x for x, y in zip(w, shape)) for w, shape in zip(pdf["w"], pdf["shape"])], "w": pdf["w"], "n": pdf["n"]})


def candidates(counted: DataFrame) -> DataFrame:
    """(w, g, alpha): every word that looks like a far more frequent one, and that one."""
    words = cut_lineage(counted.where("kind = 'word'").select(F.col("a").alias("w"), "n").mapInPandas(_drawn, "w string, n long, k string, alpha boolean, shape string, size int"))
    top = F.max(F.struct("n", "w"))
    best = words.where("alpha").groupBy("k").agg(top.alias("m"))
    alike = words.where("shape is null").join(best, "k")
    # a sign stands for a letter that was lost: words of the same length with the same letters elsewhere
    lost = words.where("shape is not null").withColumn("k", F.translate("w", _LOST, "." * len(_LOST)))
    shapes = lost.select("shape", "size").distinct()
    masks = words.where("alpha").select("w", "n", "size").join(shapes, "size").select("w", "n", "shape").mapInPandas(_masked, "k string, w string, n long")
    filled = lost.join(masks.groupBy("k").agg(top.alias("m")), "k")
    both = alike.unionByName(filled)
    ratio = F.when(F.col("alpha"), RATIO).otherwise(RATIO_SIGN)
    return both.where((F.col("m.w") != F.col("w")) & ((F.col("size") > 2) | ~F.col("alpha")) & (F.col("m.n") >= ratio * F.col("n"))).select("w", F.col("m.w").alias("g"), "alpha")


def readings(counted: DataFrame) -> DataFrame:
    """(w, g, before, after): words that may be misread, with the neighbours beside which they are; compounds come with a null ``g``."""
    found = cut_lineage(candidates(counted))
    pairs = counted.where("kind = 'pair'").select("a", "b", "n")
    letters = found.where("alpha").select("w", "g")
    sides = pairs.select(F.col("b").alias("w"), F.col("a").alias("near"), F.lit(True).alias("left")).unionByName(pairs.select(F.col("a").alias("w"), F.col("b").alias("near"), F.lit(False).alias("left")))
    seen = sides.join(letters, "w").join(found.select(F.col("w").alias("near"), F.col("g").alias("near_g")), "near", "left")
    seen = seen.withColumn("meant", F.coalesce("near_g", "near"))
    order = lambda x, y: (F.when(F.col("left"), F.col(x)).otherwise(F.col(y)), F.when(F.col("left"), F.col(y)).otherwise(F.col(x)))
    (ra, rb), (wa, wb) = order("meant", "g"), order("meant", "w")
    seen = seen.withColumns({"ra": ra, "rb": rb, "wa": wa, "wb": wb})
    seen = seen.join(pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("n").alias("right")), ["ra", "rb"])
    seen = seen.join(pairs.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("n").alias("wrong")), ["wa", "wb"], "left")
    said = seen.where(F.col("right") >= RATIO / 2 * F.greatest(F.coalesce(F.col("wrong"), F.lit(0)), F.lit(UNSEEN)))
    near = said.groupBy("w", "g").agg(F.collect_set(F.when(F.col("left"), F.col("near"))).alias("before"), F.collect_set(F.when(~F.col("left"), F.col("near"))).alias("after"))
    none = F.lit(None).cast("array<string>")
    signs = found.where("not alpha").select("w", "g", none.alias("before"), none.alias("after"))
    compounds = counted.where("kind = 'word' and a like '%-%'").select(F.col("a").alias("w"), F.lit(None).cast("string").alias("g"), none.alias("before"), none.alias("after"))
    return near.unionByName(signs).unionByName(compounds)


_LINE_END = re.compile(r"([^\W\d_][\w|@]*)[-­‐‑][ \t]*\r?$")
_LINE_START = re.compile(r"\s*([^\W\d_|@][\w|@]*)")


def _at_line_ends(text: str) -> set[str]:
    """The compounds and joined words a text may have at line ends, whatever lines between are taken out."""
    out = set()
    lines = text.split("\n")
    starts = [m.group(1) if (m := _LINE_START.match(x)) else None for x in lines]
    for i, x in enumerate(lines):
        if m := _LINE_END.search(x):
            for b in {y for y in starts[i + 1 :] if y}:
                out.update((f"{m.group(1)}-{b}".lower(), f"{m.group(1)}{b}".lower()))
    return out


def _place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % PLACES


class SoughtTokens(Tokens):
    """Tokens that keep only words the filter lets through, as words and as they stand."""

    def __init__(self, taken: np.ndarray):
        super().__init__()
        self.taken = taken

    def look(self, run: str) -> list[int]:
        return [self._word(w) for w in {*words_of(run), *_WORD.findall(run.lower())} if self.taken[_place(w)]]


def _with_known(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows with ``readings``, what is known of the words of their text, and ``heads``, the keys of their lines that repeat in the document.

    Both are equality joins of the few words that may be misread and the few lines that look like heads; only a filter
    of fixed size is broadcast.
    """
    known = cut_lineage(readings(counted))
    taken = np.zeros(PLACES, dtype=bool)
    places = known.select((F.crc32(F.encode("w", "utf-8")) % PLACES).cast("int").alias("p")).distinct().toPandas()["p"]  # at most PLACES
    taken[places.to_numpy(dtype="i8")] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.unpackbits(shared.value).astype(bool)
        tokens = SoughtTokens(taken)
        schema = pa.schema([("h", pa.int64()), ("w", pa.string()), ("document_id", pa.string())])
        for batch in by_bytes(batches, 2):
            if len(tokens.runs) > Tokens.MOST:
                tokens = SoughtTokens(taken)
            h, document, text = batch.columns
            w, row, _, _ = tokens.read(_joined(text))
            ends = pc.match_substring_regex(text, _HYPHEN_END)
            found = [(h[i], tokens.words[x], None) for i, x in zip(row.tolist(), w.tolist())]
            found += [(i, x, None) for i, t in zip(h.filter(ends).to_pylist(), text.filter(ends).to_pylist()) for x in {*_at_line_ends(t), *(y.lower() for y in _WORD.findall(t))} if taken[_place(x)]]
            heads = pc.and_(pc.is_valid(document), pc.match_substring_regex(text, r"(?m)^[ \t]*[^a-z\s]"))
            for i, d, t in zip(h.filter(heads).to_pylist(), document.filter(heads).to_pylist(), text.filter(heads).to_pylist()):
                found += [(i, k, d) for k in {head_key(line) for line in _HEADLIKE.findall(t)} if k]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    keyed = rows.withColumn("h", F.xxhash64("text", "document_id"))  # rows that share a hash share text and document
    met = cut_lineage(keyed.select("h", "document_id", "text").mapInArrow(run, "h long, w string, document_id string").distinct())
    none = F.lit(None).cast("string")
    words = met.where("document_id is null").select("h", "w").join(known, "w")
    heads = met.where("document_id is not null").join(repeated_heads(counted).withColumnRenamed("key", "w"), ["document_id", "w"])
    every = words.select("h", "w", "g", "before", "after", none.alias("head")).unionByName(heads.select("h", none.alias("w"), none.alias("g"), F.lit(None).cast("array<string>").alias("before"), F.lit(None).cast("array<string>").alias("after"), F.col("w").alias("head")))
    by_text = every.groupBy("h").agg(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "g", "before", "after"))).alias("readings"), F.collect_list("head").alias("heads"))  # of one text
    return keyed.join(by_text, "h", "left").drop("h")


def _pass(lines: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, d, m, t, h, h_, r in zip(pdf["chunk_id"], pdf["document_id"], pdf["metadata"], pdf["text"], pdf["heads"], pdf["row"], pdf["readings"]):
                noise, kept = judge(t, d, m, set(h) if h is not None else set(), Readings(r) if r is not None and len(r) else NOTHING)
                if lines:
                    out.append((c, d, h_, kept))
                else:
                    out += [(c, n) for n in sorted(noise)]
            yield pd.DataFrame(out, columns=["chunk_id", "document_id", "row", "lines"] if lines else ["chunk_id", "noise"])

    return run


def scan_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise): one row per kind of noise in a chunk: hyphen, misread, header, page_number.

    Null and blank texts have none; a null document has no name to compare heads with; metadata that is
    null or broken only means that the page is unknown; repeated rows count once.
    """
    counted = count(chunks)
    rows = chunks.where("text is not null").select("chunk_id", "document_id", "metadata", "text", F.lit(0).cast("long").alias("row"))
    return _with_known(rows, counted).mapInPandas(_pass(False), "chunk_id string, noise string").distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, text): continuous paragraphs, divided by one empty line.

    A paragraph ends at an empty line, before a list item or heading, and after a line that is short for
    its chunk and ends a sentence.  A chunk without text comes out with the empty text.
    """
    counted = count(chunks)
    rows = chunks.select("chunk_id", "document_id", "metadata", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text")).dropDuplicates(["chunk_id", "document_id", "row"])
    lines = _with_known(rows, counted).mapInPandas(_pass(True), "chunk_id string, document_id string, row long, lines array<string>")
    lines = lines.select("row", "chunk_id", "document_id", F.posexplode("lines").alias("n", "line")).withColumn("line", F.rtrim("line"))
    w = Window.partitionBy("row", "chunk_id", "document_id").orderBy("n")
    widest = F.max(F.length("line")).over(Window.partitionBy("row", "chunk_id", "document_id"))
    before = F.lag("line").over(w)
    starts = (
        before.isNull()
        | (F.trim("line") == "")
        | (F.trim(before) == "")
        | F.col("line").rlike(r"^\s*(?:[-*•]\s|#+\s|\d+[.)]\s|(?:\d+\.)+\d+\s+\p{Lu}|```|\|)")
        | before.rlike(r"^\s*(?:#+\s|(?:\d+\.)+\d+\s+\p{Lu}|```)")
        | (before.rlike(r"[.!?:]$") & (F.length(before) < 0.6 * widest))
        | (F.col("line").rlike(r"^\s*\d[\d.,]*(?:\s+\S+){0,2}$") & before.rlike(r"^\s*(?:\d[\d.,]*(?:\s+\S+){0,2}|.*\bvalues)$"))
    )
    parts = lines.withColumn("part", F.sum(starts.cast("int")).over(w))
    paragraphs = parts.groupBy("row", "chunk_id", "document_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("line")))), lambda x: x["line"]), " ").alias("p"))
    joined = paragraphs.groupBy("row", "chunk_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("part", F.regexp_replace(F.trim("p"), r"[ \t]+", " ").alias("p")))).alias("ps"))
    return joined.select("chunk_id", "document_id", F.array_join(F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p != ""), "\n\n").alias("text"))
