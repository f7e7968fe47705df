import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from kinweave.functions.dates import with_parsed_date
from kinweave.functions.ids import NAMESPACE, mime_type, person_key, uuid5
from kinweave.functions.names import name_variants, normalized_names, primary_variant
from kinweave.functions.text import norm_text, place_key, script_of

D = dt.date
DATES = {
    "12 OCT 1798": (D(1798, 10, 12), D(1798, 10, 12), "", ""),
    "9 Січ 1847": (D(1847, 1, 9), D(1847, 1, 9), "", ""),
    "ABT 1850": (D(1850, 1, 1), D(1850, 12, 31), "ABT", "APPROXIMATE"),
    "BET 1801 AND 1805": (D(1801, 1, 1), D(1805, 12, 31), "BET", "RANGE"),
    "До 1846": (None, D(1846, 12, 31), "BEF", "OPEN_BOUND"),
    "BET 1 MAY 1777 AND AFT 1800": (D(1777, 5, 1), None, "BET", "RANGE"),
    "FROM 1900 TO FEB 1904": (D(1900, 1, 1), D(1904, 2, 29), "FROM_TO", "RANGE"),
    "after 3 MAR 1900": (D(1900, 3, 3), None, "AFT", "OPEN_BOUND"),
    "31 FEB 1900": (None, None, "", "UNPARSED"),
    "NEVER": (None, None, "", "UNPARSED"),
    "1900": (D(1900, 1, 1), D(1900, 12, 31), "", ""),
    "  5.MAY.1900 ": (D(1900, 5, 5), D(1900, 5, 5), "", ""),
    "000": (None, None, "", "UNPARSED"),
    "": (None, None, "", ""),
}


def test_dates(spark):
    rows = with_parsed_date(spark.createDataFrame([(d,) for d in [*DATES, None]], "raw string"), "raw").collect()
    got = {r.raw: (r.date_from, r.date_to, r.modifier, r.warning) for r in rows}
    assert got.pop(None) == (None, None, "", "")
    assert got == DATES
    assert {r.raw: r.status for r in rows}[""] == "EMPTY"
    assert {r.raw: r.precision for r in rows}["FROM 1900 TO FEB 1904"] == "RANGE"


def test_place_and_text(spark):
    places = ["с. Немиринці, Летичівський пов., Подільська губ.", "", None, "town X;  [Y]|gubernia"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in places], "p string").select(place_key(F.col("p"))).collect()]
    assert got == ["немиринці, летичівськии, подільська", "", "", "x, y"]
    rows = spark.createDataFrame([("  Ąć  Їжак\t",), (None,), ("ﬁn ĳ",)], "t string").select(norm_text(F.col("t")), script_of(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("ac іжак", "MIXED"), ("", "OTHER"), ("fin ij", "LAT")]


def test_names(spark):
    raw = ["Іоанн Іванович /Сімашко/", "Jan /Siemaszko/", "Іван/Jan /Семашко/Siemaszko/", "Людмила //", "І[пишов?] /Семашко/", "Timofeus /Siemaszko/", "/Smith/", "", "отець Фома /Бик/"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw_name string")
    rows = normalized_names(name_variants(df, "id", "raw_name")).orderBy("id", "position").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    one = by[0][0]
    assert (one.given_name_normalized, one.patronymic, one.surname_normalized, one.status) == ("іван", "Іванович", "семашко", "OK")
    assert (by[1][0].script, by[1][0].language_hint, by[1][0].full_name_normalized) == ("LAT", "pl-la", "іван семашко")
    assert len(by[2]) == 2 and {r.full_name_normalized for r in by[2]} == {"іван семашко"}
    assert by[3][0].surname == "" and by[3][0].given_name == "Людмила"
    assert by[4][0].status == "AMBIGUOUS" and by[4][0].confidence < 0.75
    assert by[5][0].given_name_normalized == "тимофеи"
    assert by[6][0].given_name == "Smith" and by[6][0].surname == ""
    assert 7 not in by
    assert by[8][0].title_prefix == "отець" and by[8][0].given_name == "Фома"
    shown = {r.id: r.script for r in primary_variant(name_variants(df, "id", "raw_name"), "id").collect()}
    assert shown[2] == "CYR" and shown[1] == "LAT"


def test_ids(spark):
    keys = ["@I1@", "Їжак", ""]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(uuid5(F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(NAMESPACE), k)) for k in keys]
    assert spark.range(1).select(person_key(F.lit("@I1@"), F.lit("t"))).first()[0] == str(uuid.uuid5(uuid.UUID(NAMESPACE), "TREE:t:INDI:@I1@"))


@pytest.mark.parametrize("head, mime", [("89504E470D0A1A0A00", "image/png"), ("52494646000000005745425000", "image/webp"), ("5249464600000000574156", None), ("25504446", "application/pdf"), ("", None)])
def test_mime(spark, head, mime):
    assert spark.range(1).select(mime_type(F.unhex(F.lit(head)))).first()[0] == mime
