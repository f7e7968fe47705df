"""Deterministic identifiers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of person and family identifiers.
NAMESPACE = "6f8a0d4d-9b9f-4d49-8f2d-2a8c9fe2a2f1"


def uuid5(key: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based identifier, version 5, of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def person_key(xref: Column, tree_id: Column | None = None) -> Column:
    return uuid5(xref if tree_id is None else F.concat(F.lit("TREE:"), tree_id, F.lit(":INDI:"), xref))


def family_key(xref: Column, tree_id: Column | None = None) -> Column:
    return uuid5(F.concat(F.lit("FAM:"), xref) if tree_id is None else F.concat(F.lit("TREE:"), tree_id, F.lit(":FAM:"), xref))


def event_key(xref: Column, tag: Column, value: Column, date_raw: Column, year_from: Column, year_to: Column, place: Column, related: Column, derived: Column, ordinal: Column) -> Column:
    """Identity of an event: SHA-1 of ten fields, missing ones empty, with the event's number within its person."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha1(F.concat_ws("|", blank(xref), blank(tag), blank(value), blank(date_raw), blank(year_from), blank(year_to), blank(place), blank(related), F.when(derived, "1").otherwise("0"), blank(ordinal)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def mime_type(content: Column) -> Column:
    """Type of a blob by its first bytes; null for types that are not accepted."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda x: head.startswith(x)
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg").when(starts("47494638"), "image/gif")
        .when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(starts("49492A00") | starts("4D4D002A"), "image/tiff").when(starts("25504446"), "application/pdf")
    )


def attachment_type(mime: Column) -> Column:
    return F.when(mime.startswith("image/"), "image").when(mime == "application/pdf", "document").otherwise("other")
