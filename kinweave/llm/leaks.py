"""Evaluation passages in a training corpus.

One Aho-Corasick automaton over the five-word shingles of all normalised items reads each
normalised text once.  A passage of n words with at most one word in nine altered has,
for n of eighteen or more, a run of five intact words, so every passage has a hit.  Hits
are verified word by word along their diagonal; word offsets lead back to the original.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
MIN_WORDS = 18
ONE_IN = 9
#: The automaton travels to the executors with the tasks; a larger set of items goes through in parts of this size.
ITEMS_PER_AUTOMATON = 20_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Characters without width or meaning inside a word, and a hyphen at the end of a line.
_NOISE = regex.compile(r"[\p{Cf}\p{Cc}--[\t\n\v\f\r\x1c-\x1f\x85]]+|(?<=\p{L})[-‐\xad]\s*\n\s*(?=\p{Ll})", regex.V1)


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text, and where each begins and ends in the original."""
    out, spans, at = [], [], 0
    noise = [m.span() for m in _NOISE.finditer(text)]
    if noise:
        kept, where = [], array("l")
        for a, b in [*noise, (len(text), len(text))]:
            kept.append(text[at:a])
            where.extend(range(at, a))
            at = b
        clean = "".join(kept)
    else:
        clean, where = text, None
    for m in _WORD.finditer(clean):
        a, b = m.span()
        out.append(unicodedata.normalize("NFKC", m.group()).casefold())
        spans.append((where[a], where[b - 1] + 1) if where is not None else (a, b))
    return out, spans


class LeakIndex:
    """Automaton and words of a set of items (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = {i: words(t or "")[0] for i, t in items}
        self.automaton = None
        self._build()

    def _build(self) -> None:
        places: dict[str, list[tuple[int, int]]] = {}
        for i, w in self.items.items():
            for k in range(len(w) - SHINGLE + 1):
                places.setdefault(" " + " ".join(w[k : k + SHINGLE]) + " ", []).append((i, k))
        self.automaton = ahocorasick.Automaton()
        for shingle, at in places.items():
            self.automaton.add_word(shingle, (len(shingle), at))
        if places:
            self.automaton.make_automaton()

    def __reduce__(self):
        return (LeakIndex, ([(i, " ".join(w)) for i, w in self.items.items()],))

    def passages(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, words, altered, begin, end) of the longest passage of each item that leaks; begin and end in the original."""
        if not text or not len(self.automaton):
            return
        doc, spans = words(text)
        if len(doc) < MIN_WORDS:
            return
        line = " " + " ".join(doc) + " "
        starts, at = {}, 0
        for k, w in enumerate(doc):
            starts[at] = k
            at += len(w) + 1
        diagonals: dict[tuple[int, int], list[int]] = {}
        for end, (length, hits) in self.automaton.iter(line):
            k = starts[end - length + 1]
            for item, place in hits:
                diagonals.setdefault((item, k - place), []).append(place)
        best: dict[int, tuple[int, int, int, int, int]] = {}
        for (item, shift), _ in diagonals.items():
            w = self.items[item]
            a, b = max(0, -shift), min(len(w), len(doc) - shift)
            if b - a < MIN_WORDS:
                continue
            found = longest_passage([w[k] == doc[k + shift] for k in range(a, b)])
            if found and (item not in best or found[1] - found[0] > best[item][1]):
                first, last = found[0] + a + shift, found[1] + a + shift - 1
                best[item] = (item, found[1] - found[0], found[2], spans[first][0], spans[last][1])
        yield from best.values()


def longest_passage(equal: list[bool]) -> tuple[int, int, int] | None:
    """(begin, end, altered) of the longest run of MIN_WORDS or more words with at most one in ONE_IN altered.

    With h(k) = ONE_IN * altered words before k - k, words a to b qualify if
    h(b) <= h(a): the longest such span comes from one pass over the running maxima.
    """
    n = len(equal)
    h = [0] * (n + 1)
    for k, same in enumerate(equal):
        h[k + 1] = h[k] - 1 + ONE_IN * (not same)
    tops = [0]
    for k in range(1, n + 1):
        if h[k] > h[tops[-1]]:
            tops.append(k)
    best = None
    b = n
    for a in reversed(tops):
        while b > a and h[b] > h[a]:
            b -= 1
        # walk back up from the far end: for smaller a (lower h) the end can only move left
        if b - a >= MIN_WORDS and (best is None or b - a > best[1] - best[0]):
            best = (a, b, (h[b] - h[a] + b - a) // ONE_IN)
    return best


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, altered, begin, end): each document with every item it leaks.

    ``begin`` and ``end`` are offsets in the original text.  Null, empty and short texts
    leak nothing; repeated documents and items give repeated rows once per (doc_id,
    item_id); texts are read whole.
    """
    schema = "doc_id bigint, item_id bigint, words int, altered int, begin int, end int"
    listed = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null").dropDuplicates(["item_id"]).orderBy("item_id")
    rows = [(r[0], r[1]) for r in listed.toLocalIterator()]
    out = None
    for at in range(0, max(len(rows), 1), ITEMS_PER_AUTOMATON):
        index = LeakIndex(rows[at : at + ITEMS_PER_AUTOMATON])

        def scan(batches: Iterator[pd.DataFrame], index: LeakIndex = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                got = [(d, *p) for d, t in zip(batch["doc_id"], batch["text"]) for p in index.passages(t)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "words", "altered", "begin", "end"]).astype(
                    {"doc_id": "int64", "item_id": "int64", "words": "int32", "altered": "int32", "begin": "int32", "end": "int32"}
                )

        part = documents.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null").mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["doc_id", "item_id"])
