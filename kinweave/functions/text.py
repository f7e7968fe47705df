"""Text normalisation as built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition, without marks, is one other letter, and those with several; by rule over the blocks with such letters."""
    single, several = {}, {}
    for block in (range(0xA0, 0x250), range(0x340, 0x530), range(0x1E00, 0x2000), range(0x2070, 0x20A0), range(0x2100, 0x2190), range(0xFB00, 0xFB07), range(0xFF00, 0xFFEF)):
        for code in block:
            c = chr(code)
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if bare == c or unicodedata.combining(c):
                continue
            if len(bare) == 1:
                single[c] = bare
            elif len(bare) > 1:
                several[c] = bare
    return "".join(single), "".join(single.values()), several


_FROM, _TO, _SEVERAL = _decompositions()


def norm_space(c: Column) -> Column:
    """Null as empty; white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks; letters that decompose to several are rare and replaced only where one occurs."""
    bare = F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")
    rare = "[" + "".join(k for k in _SEVERAL if k not in "[]^-\\") + "]"
    slow = bare
    for k, v in _SEVERAL.items():
        slow = F.replace(slow, F.lit(k), F.lit(v))
    return F.when(c.rlike(rare), slow).otherwise(bare)


def norm_text(c: Column) -> Column:
    return F.lower(strip_diacritics(norm_space(c)))


CYRILLIC = r"[\x{0400}-\x{052F}]"
LATIN = r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]"


def script_of(c: Column) -> Column:
    """CYR, LAT, MIXED or OTHER by the letters that occur."""
    c = F.coalesce(c, F.lit(""))
    cyr, lat = c.rlike(CYRILLIC), c.rlike(LATIN)
    return F.when(cyr & lat, "MIXED").when(cyr, "CYR").when(lat, "LAT").otherwise("OTHER")


def language_hint(c: Column) -> Column:
    s = script_of(c)
    return F.when(s == "CYR", "uk-ru").when(s == "LAT", "pl-la").when(s == "MIXED", "mixed").otherwise("unknown")


#: Words that lead a settlement's name, and words of administrative units.
_LEADING = r"(?iu)^(с\.?|село|дер\.?|деревня|д\.|місто|м\.|містечко|пос\.?|хут\.?|хутір|village|town|city|miasteczko|wies|wieś)\s+"
_ADMIN = r"(?iuU)\b(пов\.?|повіт|повіту|уезд|уезда|pow\.?|powiat|губ\.?|губернія|губернии|gubernia|вол\.?|волость|волості|парафія|парафии|parafia|parish|район|область|county)\b"


def place_key(c: Column) -> Column:
    """Components of a place, normalised, without settlement and administrative words, joined by a comma."""
    parts = F.split(norm_space(c), r"\s*[,;|]\s*")

    def one(p: Column) -> Column:
        p = F.lower(strip_diacritics(norm_space(p)))
        p = F.regexp_replace(p, _LEADING, "")
        p = F.regexp_replace(p, _ADMIN, "")
        p = F.regexp_replace(p, r"[\[\](){}]", " ")
        return norm_space(F.regexp_replace(p, r"(?iu)[^0-9a-zа-яіїєґąćęłńóśźż]+", " "))

    return F.array_join(F.filter(F.transform(parts, one), lambda p: p != ""), ", ")


def event_value_or_none(value: Column, tag: Column) -> Column:
    """Blank values, and a bare Y on a known event tag, are null."""
    v = norm_space(value)
    return F.when((v == "") | ((F.upper(v) == "Y") & tag.isin(*EVENT_LABELS)), None).otherwise(v)


def scrub_tsv(c: Column) -> Column:
    """Line breaks as blanks, null as empty."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "\r\n", "  ")


def bit_or_null(c: Column) -> Column:
    return F.when(c.isNull(), None).when(c, 1).otherwise(0)


#: Event tags and their labels.
EVENT_LABELS = {
    "BIRT": "Birth", "BAPM": "Baptism", "CHR": "Christening", "DEAT": "Death", "BURI": "Burial", "CREM": "Cremation", "ADOP": "Adoption",
    "BARM": "Bar mitzvah", "BASM": "Bat mitzvah", "BLES": "Blessing", "CHRA": "Adult christening", "CONF": "Confirmation",
    "FCOM": "First communion", "GRAD": "Graduation", "NATU": "Naturalization", "ORDN": "Ordination", "RETI": "Retirement",
    "PROB": "Probate", "WILL": "Will", "CENS": "Census", "RESI": "Residence", "EMIG": "Emigration", "IMMI": "Immigration",
    "OCCU": "Occupation", "EDUC": "Education", "EVEN": "Event", "FACT": "Fact", "MARR": "Marriage", "DIV": "Divorce", "ANUL": "Annulment",
    "ENGA": "Engagement", "MARB": "Marriage bann", "MARC": "Marriage contract", "MARL": "Marriage license", "MARS": "Marriage settlement",
    "CHILD_BIRTH": "Birth of child",
}
