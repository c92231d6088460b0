"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of every prefix of a word ends in one token only, so a table of last
tokens, one per prefix, holds all of them.  The candidates for a prefix are the
vocabulary entries that are its suffixes; an automaton over the vocabulary lists
them.  A candidate is right if the encoding before it exists and the two tokens at
the seam are compatible, that is, byte-pair merging would not have joined across
the seam.  Back-pointers from the last prefix give the ids.

Words repeat, so a task keeps the ids of short words it has seen (the memory is
bounded) and the table is filled once per distinct word.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
WORDS_KEPT, LONGEST_KEPT = 200_000, 40
#: Fixed value: how this vocabulary cuts text into words.  \s is spelt out as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """The encoder of one vocabulary file with ``model.vocab`` and ``model.merges``."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.words = regex.compile(PATTERN, regex.V1)
        self.size = {i: len(t) for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}  # the place of a merge in the list is its priority
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.rank:
                self.rank[x, y] = n
            if z not in self.halves:
                self.halves[z], self.made[z] = (x, y), n
        reachable = {i for t, i in vocab.items() if len(t) == 1} | set(self.halves)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in reachable:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.whole = {t: i for t, i in vocab.items() if i in reachable and len(t) == 1}
        self.kept: dict[str, list[int]] = {}
        self.seam = lru_cache(maxsize=1 << 18)(self._compatible)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of the two tokens leaves the border between them alone.

        Both tokens are taken apart again, the later merge first.  At each stage the two parts
        that touch the border must not form a merge that would have come before the merges
        still standing around them.
        """
        before = float("inf")  # merges from this place on in the list have not happened yet
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            l, r = self.made.get(left, -1), self.made.get(right, -1)
            if l < 0 and r < 0:
                return True
            if l > r:
                before, left = l, self.halves[left][1]
            else:  # of equal merges the one further left goes first, and the border is left of this one
                before, right = r + 1, self.halves[right][0]

    def word(self, text: str) -> list[int]:
        """Ids of one word, given in the vocabulary's letters."""
        n = len(text)
        last, size, seam = [-1] * (n + 1), self.size, self.seam
        for end, token in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size[token]
            if start == 0 or (last[start] >= 0 and seam(last[start], token)):
                last[end + 1] = token
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; the empty and the null text have none."""
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for w in self.words.findall(text):
            ids = kept.get(w)
            if ids is None:
                ids = self.word("".join([self.letter[b] for b in w.encode("utf-8", "surrogatepass")]))
                if len(w) <= LONGEST_KEPT:
                    if len(kept) >= WORDS_KEPT:
                        kept.clear()
                    kept[w] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the ids of every row's text; ``[]`` for empty and null texts.  Other columns are not read.

    A map without a shuffle; repeated rows come out as often as they go in.
    """
    path = f"{folder}/{vocabulary}.json"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path).encode
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [code(t) for t in pdf[text]]})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInPandas(run, f"{key} {kind}, ids array<int>")
