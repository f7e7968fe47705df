"""Dates as genealogical files write them, parsed into ranges by staged expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import norm_space, strip_diacritics

#: Month names and abbreviations, upper case.
MONTHS = {
    1: ["JAN", "JANUARY", "СІЧ", "СІЧЕНЬ", "ЯНВ", "STY", "STYCZEN"],
    2: ["FEB", "FEBRUARY", "ЛЮТ", "ЛЮТИЙ", "ФЕВ", "LUT"],
    3: ["MAR", "MARCH", "БЕР", "БЕРЕЗЕНЬ", "МАР", "MARZEC"],
    4: ["APR", "APRIL", "КВІ", "КВІТЕНЬ", "АПР", "KWI", "KWIECIEN"],
    5: ["MAY", "ТРА", "ТРАВЕНЬ", "МАЙ", "MAJ"],
    6: ["JUN", "JUNE", "ЧЕР", "ЧЕРВЕНЬ", "ИЮН", "CZE", "CZERWIEC"],
    7: ["JUL", "JULY", "ЛИП", "ЛИПЕНЬ", "ИЮЛ", "LIP", "LIPIEC"],
    8: ["AUG", "AUGUST", "СЕР", "СЕРПЕНЬ", "АВГ", "SIE", "SIERPIEN"],
    9: ["SEP", "SEPT", "SEPTEMBER", "ВЕР", "ВЕРЕСЕНЬ", "СЕН", "WRZ", "WRZESIEN"],
    10: ["OCT", "OCTOBER", "ЖОВ", "ЖОВТЕНЬ", "ОКТ", "PAZ", "PAZDZIERNIK"],
    11: ["NOV", "NOVEMBER", "ЛИС", "ЛИСТОПАД", "НОЯ", "LIS", "LISTOPAD"],
    12: ["DEC", "DECEMBER", "ГРУ", "ГРУДЕНЬ", "ДЕК", "GRU", "GRUDZIEN"],
}
#: Prefixes in the order of their test; those of ``plain`` are tested before, those of ``bare`` after marks are stripped.
BEFORE = [("plain", "BEF ", "BEF"), ("plain", "BEFORE ", "BEF"), ("plain", "TO ", "TO"), ("bare", "ДО ", "BEF")]
AFTER = [("plain", "AFT ", "AFT"), ("plain", "AFTER ", "AFT"), ("plain", "FROM ", "FROM"), ("bare", "ПІСЛЯ ", "AFT"), ("bare", "ПИСЛЯ ", "AFT"), ("bare", "ПОСЛЕ ", "AFT")]
ABOUT = [
    ("plain", "ABT ", "ABT"), ("plain", "ABOUT ", "ABT"), ("plain", "CA ", "ABT"), ("plain", "CIRCA ", "ABT"), ("plain", "EST ", "EST"), ("plain", "ESTIMATED ", "EST"), ("plain", "CAL ", "CAL"), ("plain", "CALCULATED ", "CAL"),
    ("bare", "БЛИЗЬКО ", "ABT"), ("bare", "ОКОЛО ", "ABT"), ("bare", "ПРИБЛИЗНО ", "ABT"), ("bare", "ПРИБЛ ", "ABT"),
]
OPEN_END = r"^(AFT|AFTER|ПІСЛЯ|ПИСЛЯ|ПОСЛЕ) "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; keeps plans small under any rewriting."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def single_date(c: Column) -> Column:
    """struct(start, end, precision) of one plain date: the last number of three or four digits is the year."""
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names for x in (name, n)])
    words = F.split(norm_space(F.regexp_replace(F.upper(strip_diacritics(norm_space(c))), "[/.,]", " ")), " ")
    none = F.lit(None).cast("date")

    def whole(v: Column) -> Column:
        y, m, d = v["y"], v["m"], v["d"]
        # a day 0 counts as no day
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        day = F.when(m.isNotNull() & (d > 0), F.struct(F.try_to_date(text, "yyyy-MM-dd").alias("start"), F.try_to_date(text, "yyyy-MM-dd").alias("end"), F.when(F.try_to_date(text, "yyyy-MM-dd").isNull(), "UNPARSED").otherwise("DAY").alias("precision")))
        first = F.make_date(y, F.coalesce(m, F.lit(1)), F.lit(1))
        last = F.last_day(F.make_date(y, F.coalesce(m, F.lit(12)), F.lit(1)))
        wide = F.struct(first.alias("start"), last.alias("end"), F.when(m.isNotNull(), "MONTH").otherwise("YEAR").alias("precision"))
        unread = F.struct(none.alias("start"), none.alias("end"), F.when(v["empty"], "EMPTY").otherwise("UNPARSED").alias("precision"))
        return F.when(y.isNull() | (y < 1), unread).otherwise(F.coalesce(day, wide))

    def at_year(v: Column) -> Column:
        t, i = v["t"], v["i"]
        month = F.try_element_at(months, F.when(i >= 1, F.get(t, i - 1)))
        day = F.when((i >= 2) & F.get(t, i - 2).rlike("^[0-9]{1,2}$"), F.get(t, i - 2).cast("int"))
        return let(F.struct(F.get(t, i).cast("int").alias("y"), month.alias("m"), day.alias("d"), (F.get(t, F.lit(0)) == "").alias("empty")), whole)

    number = lambda t: F.array_max(F.transform(t, lambda x, k: F.when(x.rlike("^[0-9]{3,4}$"), k)))
    return let(words, lambda t: let(F.struct(t.alias("t"), number(t).alias("i")), at_year))


def parsed_date(raw: Column) -> Column:
    """struct(date_from, date_to, year_from, year_to, precision, modifier, status, warning) of a date as written.

    Null and empty give status EMPTY; what cannot be read gives UNPARSED and no dates.
    """

    def result(v: Column) -> Column:
        k, a, b = v["kind"], v["a"], v["b"]
        start = F.when(k != "before", a["start"])
        end = F.when(k == "range", F.when(~v["open"], b["end"])).when(k != "after", a["end"])
        second = F.when(v["open"], "OPEN").otherwise(b["precision"])
        precision = F.when(k == "range", F.when(a["precision"] == second, a["precision"]).otherwise("RANGE")).otherwise(a["precision"])
        status = F.when(v["empty"], "EMPTY").when(start.isNotNull() | end.isNotNull(), "OK").otherwise("UNPARSED")
        modifier = F.when(v["empty"], "").otherwise(v["mod"])
        return F.struct(
            start.alias("date_from"), end.alias("date_to"), F.year(start).alias("year_from"), F.year(end).alias("year_to"), F.when(v["empty"], "").otherwise(precision).alias("precision"),
            modifier.alias("modifier"), status.alias("status"), warning_kind(v["raw"], status, modifier).alias("warning"),
        )

    def split(v: Column) -> Column:
        s, text = v["s"], {"plain": v["s"], "bare": v["key"]}
        between = s.startswith("BET ") & s.contains(" AND ")
        from_to = s.startswith("FROM ") & s.contains(" TO ")
        rest = lambda c, n: F.substr(c, F.lit(n))
        parts = lambda c, word: F.split(c, word, 2)
        one = lambda kind, mod, left, right: F.struct(F.lit(kind).alias("kind"), F.lit(mod).alias("mod"), left.alias("left"), right.alias("right"))
        no = F.lit("")
        found = F.when(between, one("range", "BET", F.get(parts(rest(s, 5), " AND "), F.lit(0)), F.get(parts(rest(s, 5), " AND "), F.lit(1)))).when(
            from_to, one("range", "FROM_TO", F.get(parts(rest(s, 6), " TO "), F.lit(0)), F.get(parts(rest(s, 6), " TO "), F.lit(1)))
        )
        for kind, prefixes in (("before", BEFORE), ("after", AFTER), ("about", ABOUT)):
            for which, prefix, mod in prefixes:
                found = found.when(text[which].startswith(prefix), one(kind, mod, rest(text[which], len(prefix) + 1), no))
        found = found.otherwise(one("plain", "", s, no))
        both = lambda x: F.struct(x["kind"].alias("kind"), x["mod"].alias("mod"), single_date(x["left"]).alias("a"), single_date(x["right"]).alias("b"), strip_diacritics(norm_space(x["right"])).rlike(OPEN_END).alias("open"), v["empty"].alias("empty"), v["raw"].alias("raw"))
        return let(let(found, both), result)

    plain = norm_space(raw)
    return let(F.struct(F.upper(plain).alias("s"), strip_diacritics(F.upper(plain)).alias("key"), (F.coalesce(raw, F.lit("")) == "").alias("empty"), plain.alias("raw")), split)


def with_parsed_date(df: DataFrame, raw: str, prefix: str = "") -> DataFrame:
    """Adds the fields of :func:`parsed_date` as columns (with ``prefix``)."""
    fields = ("date_from", "date_to", "year_from", "year_to", "precision", "modifier", "status", "warning")
    return df.withColumn("_parsed", parsed_date(F.col(raw))).withColumns({f"{prefix}{f}": F.col(f"_parsed.{f}") for f in fields}).drop("_parsed")


#: What each kind of warning says.
WARNINGS = {
    "UNPARSED": "Date could not be parsed into a year/date range.",
    "APPROXIMATE": "Approximate/calculated date; do not treat as exact identity evidence.",
    "OPEN_BOUND": "Open-ended date bound; only one side of the date range is known.",
    "RANGE": "Date range; usable for overlap checks but not exact identity evidence.",
}


def warning_message(kind: Column) -> Column:
    """Text of a warning, empty for none."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])[kind], F.lit(""))


def warning_kind(raw: Column, status: Column, modifier: Column) -> Column:
    """Empty, UNPARSED, APPROXIMATE, OPEN_BOUND or RANGE."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "").when(status != "OK", "UNPARSED").when(modifier.isin("ABT", "EST", "CAL"), "APPROXIMATE")
        .when(modifier.isin("BEF", "AFT", "FROM", "TO"), "OPEN_BOUND").when(modifier.isin("BET", "FROM_TO"), "RANGE").otherwise("")
    )
