"""Mapping free-entered values to a canonical list.

Distinct values are normalised and scored against an inverted index of character n-grams.
An entry of the list has several views (village alone, with district, with region, with
both), as people leave parts out; a value's score for an entry is the best weighted cosine
over its views.  It is accepted above a threshold, with a margin over the next entry, and
if every word of the value is explained by the entry.  Below the threshold an exact check
follows: of all entries that resemble the value at all the one is accepted that every word
of the value is a few slips away from.  Else the value is unmatched.

The weights come from the whole list.  A list of more than BLOCK entries is indexed in
parts, whose verdicts are merged to what one index would give.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.names import skeleton

UNMATCHED = -1
#: Entries of one index; a longer list has several, with the same results.
BLOCK = 20_000

#: Words that name the kind of a place, not the place, as letters without marks.
KINDS = set(
    "с село сло м мсто місто міто містечко мчко смт х хутір хут п пт пов повіт повят уїзд уезд у р рн район губернія губерния губ г обл область о воєводство волость вол дер деревня ст"
    " s st sel selo c m mist t town twn of village vil vill vlg v d dist distr district dst county cnty co region reg rgn gub gubernia guberniya huberniia huberniya oblast obl povit uezd raion rayon parish par prov province"
    " wies w pow powiat powiatu gm gmina miasto miasteczko woj wojewodztwo пров провінція".split()
)


@dataclass(frozen=True)
class Rule:
    threshold: float = 0.50
    margin: float = 0.04
    word: float = 0.30  #: least cosine of every word of the value with a word of the entry
    doubtful: float = 0.20  #: least score for the exact check


def tokens(text: str | None) -> list[str]:
    """Keys of the words that name a place, in order; editorial remarks and kinds of places left out."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", text).lower()
    t = re.sub(r"\[[^\]]*\]|\(\s*\?+\s*\)", " ", t)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc", "Mn") or c.isspace())
    t = re.sub(r"(?<=\w)['’ʼ`\-‐.](?=\w)", "", t)
    out = []
    for w in re.findall(r"[^\W\d_]+", t):
        if w not in KINDS and len(w) > 1:
            key = skeleton(w)
            if key:
                out.append(key)
    return out


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + n] for n in (2, 3) for k in range(len(w) - n + 1)]


def slips(a: str, b: str, most: int) -> int:
    """Letters more, less or other and swapped neighbours between two keys; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last2, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def allowed(word: str) -> int:
    """Slips that a word of this length may have."""
    return 1 if len(word) < 6 else 2 if len(word) < 11 else 3


def weights(entries: list[tuple[int, str]]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the n-grams of a whole list, and the weight of an n-gram that it lacks."""
    seen: dict[str, int] = defaultdict(int)
    for _, raw in entries:
        for g in {g for w in tokens(raw) for g in grams(w)}:
            seen[g] += 1
    n = max(len(entries), 1)
    return {g: math.log(1 + n / x) for g, x in seen.items()}, math.log(1 + n)


class PlaceIndex:
    """Inverted index of one part of a list of (place_id, place_raw) entries, with the weights of the whole list."""

    def __init__(self, entries: list[tuple[int, str]], rule: Rule, weight: tuple[dict[str, float], float], alone: bool = True):
        self.entries, self.rule, self.weight, self.alone = entries, rule, weight, alone
        self.idf, self.unknown = weight
        self.parts = [tokens(raw.split(",")[0]) for _, raw in entries], [tokens(raw) for _, raw in entries]
        views: list[tuple[int, list[str]]] = []
        for k, (_, raw) in enumerate(entries):
            part = [tokens(p) for p in raw.split(",")]
            head, rest = part[0], part[1:]
            shapes = [head] + [head + r for r in rest] + ([head + sum(rest, [])] if len(rest) > 1 else [])
            views += [(k, s) for s in shapes if s]
        self.of = np.unique([k for k, _ in views])  # entries with a view, in order; their views are neighbours
        self.first = np.searchsorted([k for k, _ in views], self.of)
        self.size = len(views)
        self.word = {w: self.vector([w]) for words in self.parts[1] for w in words}
        post: dict[str, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for v, (_, words) in enumerate(views):
            for g, w in self.vector(words).items():
                post[g][0].append(v)
                post[g][1].append(w)
        self.post = {g: (np.array(a), np.array(b)) for g, (a, b) in post.items()}

    def __reduce__(self):
        return (PlaceIndex, (self.entries, self.rule, self.weight, self.alone))

    def vector(self, words: list[str]) -> dict[str, float]:
        counts: dict[str, int] = defaultdict(int)
        for w in words:
            for g in grams(w):
                counts[g] += 1
        raw = {g: (1 + math.log(c)) * self.idf.get(g, self.unknown) for g, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {g: x / norm for g, x in raw.items()}

    def explained(self, words: list[str], entry: int) -> bool:
        names = self.parts[1][entry]
        theirs = [self.word[n] for n in names]
        for w in words:
            if w in names:
                continue
            mine = self.vector([w])
            if max((sum(x * t.get(g, 0.0) for g, x in mine.items()) for t in theirs), default=0.0) < self.rule.word:
                return False
        return True

    def spelt(self, words: list[str], entry: int) -> bool:
        """Whether the words spell the entry's village and nothing but its district and region."""
        village, all_words = self.parts[0][entry], self.parts[1][entry]
        within = lambda w, names: any(slips(w, n, allowed(n)) <= allowed(n) for n in names)
        return all(within(w, all_words) for w in words) and all(within(n, words) for n in village)

    def judge(self, text: str | None) -> tuple[int, float, float, bool, int, int, float]:
        """Of this part: best entry, its score, the next score, whether it is good enough; number of entries that the
        text spells, one of them, its score.

        What the text spells is only asked where the best entry isn't good enough, or other parts could have a better one.
        """
        words = tokens(text)
        if not words or not len(self.of):
            return UNMATCHED, 0.0, 0.0, False, 0, UNMATCHED, 0.0
        score = np.zeros(self.size)
        for g, x in self.vector(words).items():
            if g in self.post:
                at, weight = self.post[g]
                score[at] += x * weight
        per_entry = np.zeros(len(self.entries))
        per_entry[self.of] = np.maximum.reduceat(score, self.first)
        first = int(per_entry.argmax())
        top = float(per_entry[first])
        second = float(np.partition(per_entry, -2)[-2]) if len(per_entry) > 1 else 0.0
        good = top >= self.rule.threshold and self.explained(words, first)
        right: list[int] = []
        if not (good and self.alone):
            right = [int(k) for k in np.flatnonzero(per_entry >= self.rule.doubtful) if self.spelt(words, int(k))]
        one = right[0] if right else -1
        return self.entries[first][0], top, second, bool(good), len(right), self.entries[one][0] if right else UNMATCHED, float(per_entry[one]) if right else 0.0


def map_values(values: DataFrame, places: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(value, place_id, score, second) of distinct non-null ``value`` strings; place_id is -1 for an unmatched value.

    A blank value is unmatched; of entries that tie, none is accepted; a canonical entry
    without id or text is no entry, and one listed twice counts once.  ``places`` is a
    reference list that people keep: it comes to the driver and goes to the tasks whole.
    """
    listed = places.select(F.col("place_id").cast("bigint"), "place_raw").filter("place_id is not null and place_raw is not null").dropDuplicates(["place_id"]).orderBy("place_id")
    rows = [(r[0], r[1]) for r in listed.toLocalIterator()]
    names = ["value", "place_id", "score", "second", "good", "spelt", "spelt_id", "spelt_score"]
    schema = "value string, place_id bigint, score double, second double, good boolean, spelt int, spelt_id bigint, spelt_score double"
    blocks = range(0, max(len(rows), 1), BLOCK)
    weight, out = weights(rows), None
    for at in blocks:
        index = PlaceIndex(rows[at : at + BLOCK], rule, weight, len(blocks) == 1)

        def score(batches: Iterator[pd.DataFrame], index: PlaceIndex = index) -> Iterator[pd.DataFrame]:
            kinds = {"place_id": "int64", "score": "float64", "second": "float64", "good": "bool", "spelt": "int32", "spelt_id": "int64", "spelt_score": "float64"}
            for batch in batches:
                yield pd.DataFrame([(v, *index.judge(v)) for v in batch["value"]], columns=names).astype(kinds)

        part = values.select("value").mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    if len(blocks) > 1:
        top = F.max(F.struct("score", (-F.col("place_id")).alias("least"), "second", "good")).alias("x")
        next_ = F.coalesce(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(2)), F.lit(0.0))  # one score per part
        merged = out.groupBy("value").agg(top, next_.alias("next"), F.sum("spelt").cast("int").alias("spelt"), F.max("spelt_id").alias("spelt_id"), F.max("spelt_score").alias("spelt_score"))
        out = merged.select("value", (-F.col("x.least")).alias("place_id"), "x.score", F.greatest("x.second", "next").alias("second"), "x.good", "spelt", "spelt_id", "spelt_score")
    clear = F.col("good") & (F.col("score") - F.col("second") >= rule.margin)
    spelt = ~F.col("good") & (F.col("score") >= rule.doubtful) & (F.col("spelt") == 1)
    place = F.when(clear, F.col("place_id")).when(spelt, F.col("spelt_id")).otherwise(F.lit(UNMATCHED)).cast("bigint")
    return out.select("value", place.alias("place_id"), F.when(spelt, F.col("spelt_score")).otherwise(F.col("score")).alias("score"), F.when(spelt, 0.0).otherwise(F.col("second")).alias("second"))
