"""One sound-like key for a name in Cyrillic or Latin script, Ukrainian, Russian, Polish or English spelling."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters by sound. Capitals stand for one sound each: Z zh, S sh, C ch, X kh, c ts.
CYRILLIC = dict(zip("абвгґдеєжзиіїйклмнопрстуфхцчшщьюяыэёъўј", ["a", "b", "v", "h", "h", "d", "e", "e", "Z", "z", "i", "i", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "X", "c", "C", "S", "SC", "", "u", "a", "i", "e", "o", "", "v", "i"]))
#: Polish and other Latin letters with marks that change the sound; other marks are dropped.
LATIN = dict(zip("żźśćńłąęßæœøđð", ["Z", "z", "s", "c", "n", "l", "a", "e", "ss", "e", "e", "o", "d", "d"]))
#: Groups of Latin letters, in the order of their application.
GROUPS = [("szcz", "SC"), ("shch", "SC"), ("zh", "Z"), ("rz", "Z"), ("kh", "X"), ("ch", "C"), ("cz", "C"), ("sh", "S"), ("sz", "S"), ("ts", "c"), ("tz", "c"), ("x", "ks"), ("w", "v"), ("y", "i"), ("j", "i"), ("g", "h"), ("q", "k")]
#: Fixed value: a word with one of these is spelt the Polish way, where ch is kh.
POLISH = "cz|sz|rz|w|[żźśćńłąę]"
_TIDY = [("i+([aeou])", r"\1"), (r"(.)\1+", r"\1")]


def skeleton(word: str) -> str:
    """The key of one word; the empty string for one without letters."""
    w = unicodedata.normalize("NFC", word).lower()
    polish = re.search(POLISH, w) is not None
    w = "".join(CYRILLIC.get(c, LATIN.get(c, c)) for c in w)
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isalpha())
    w = "".join(CYRILLIC.get(c, c) for c in w)
    if polish:
        w = w.replace("ch", "X")
    for a, b in GROUPS:
        w = w.replace(a, b)
    for pattern, to in _TIDY:
        w = re.sub(pattern, to, w)
    return w


def _marks() -> tuple[str, str]:
    """Precomposed Latin letters with marks and their base letters, by rule over the blocks that hold them."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        if c in LATIN or c != c.lower():
            continue
        base = unicodedata.normalize("NFKD", c)[0]
        if base != c and base.isascii() and base.isalpha():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def skeleton_column(word: Column) -> Column:
    """:func:`skeleton` as a built-in expression; null stays null."""
    w = F.lower(word)
    polish = w.rlike(POLISH)
    single = {c: s for c, s in (CYRILLIC | LATIN).items() if len(s) == 1}
    many = {c: s for c, s in (CYRILLIC | LATIN).items() if len(s) > 1}
    for c, s in many.items():
        w = F.replace(w, F.lit(c), F.lit(s))
    marks, bases = _marks()
    w = F.translate(w, "".join(single) + marks, "".join(single.values()) + bases)
    w = F.regexp_replace(w, r"[^\p{L}]|[ьъ]", "")
    w = F.when(polish, F.replace(w, F.lit("ch"), F.lit("X"))).otherwise(w)
    for a, b in GROUPS:
        w = F.replace(w, F.lit(a), F.lit(b))
    for pattern, to in _TIDY:
        w = F.regexp_replace(w, pattern, to.replace("\\", "$"))
    return w


#: Slips that two keys may have in all.
SLIPS = 2
#: Letters from which on a key may have two slips of any kind.
LONG = 8


def _slip(a: Column, b: Column) -> Column:
    away = F.levenshtein(a, b, SLIPS)  # -1 beyond
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    longest = F.greatest(F.length(a), F.length(b))
    return away.isin(0, 1) | ((away == SLIPS) & ((longest >= LONG) | same_letters))


def written(key: Column) -> Column:
    """The key with the groups of letters written out that stand for one sound each."""
    for sound, letters in (("Z", "zh"), ("S", "sh"), ("C", "ch"), ("X", "kh"), ("c", "ts")):
        key = F.replace(key, F.lit(sound), F.lit(letters))
    return key


def near(a: Column, b: Column) -> Column:
    """Whether two keys are one slip apart: a letter more, less or other, or two neighbours swapped; two slips in long keys.

    A slip inside a group of letters that stands for one sound shows only with the groups
    written out, so both forms are compared.
    """
    return _slip(a, b) | _slip(written(a), written(b))
