"""Parsing of written names, as staged columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import language_hint, norm_space, norm_text, script_of

#: Titles, and variant spellings with their canonical forms.
TITLES = ["пан", "пани", "пані", "госпожа", "господин", "отець", "ієрей", "иерей", "ксендз", "ksiadz", "priest"]
GIVEN_VARIANTS = [
    ("Иоанн", "Іван"), ("Іоанн", "Іван"), ("Jan", "Іван"), ("Joannes", "Іван"), ("Ivan", "Іван"), ("Фома", "Фома"), ("Тома", "Фома"), ("Tomasz", "Фома"),
    ("Thomas", "Фома"), ("Timofeus", "Тимофей"), ("Timotheus", "Тимофей"), ("Paraskewa", "Параскева"), ("Paraskeva", "Параскева"),
]
SURNAME_VARIANTS = [("Сімашко", "Семашко"), ("Siemaszko", "Семашко"), ("Semaszko", "Семашко")]
#: Fixed value: endings that mark a patronymic.
_PATRONYMIC = r"(?iu)(ович|евич|євич|ич|івна|ївна|овна|евна|євна|ична|івич|yovych|evych|ovych|ovna|evna)$"
#: Fixed value: marks of an uncertain name.
_UNCERTAIN = r"\[[^\]]+\]"
UNNAMED = "Unnamed "


def split_alternatives(c: Column) -> Column:
    """Parts between slashes, blank ones dropped; one empty part for an empty text."""
    some = F.filter(F.transform(F.split(norm_space(c), "/"), norm_space), lambda p: p != "")
    return F.when(norm_space(c) == "", F.array(F.lit(""))).when(F.size(some) > 0, some).otherwise(F.array(norm_space(c)))


def name_parts(df: DataFrame, raw: str) -> DataFrame:
    """Adds given_part and surname_part: the last blank before a slash is the border, else the last word is the surname."""
    text = norm_space(F.col(raw))
    df = df.withColumn("_n", text)
    n = F.col("_n")
    marked = n.contains(" /")
    tail = F.substring_index(n, " /", -1)
    head = F.substr(n, F.lit(1), F.length(n) - F.length(tail) - 2)
    guess_last = F.substring_index(n, " ", -1)
    guess_head = F.when(n.contains(" "), F.substr(n, F.lit(1), F.length(n) - F.length(guess_last) - 1)).otherwise(n)
    return df.withColumns({
        "given_part": F.when(marked, norm_space(head)).otherwise(guess_head),
        "surname_part": F.when(marked, norm_space(F.regexp_replace(tail, "^/+|/+$", ""))).when(n.contains(" "), guess_last).otherwise(F.lit("")),
    }).drop("_n")


def name_variants(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, raw, position, script, given, surname, full_name, full_name_normalized): every given with every surname alternative.

    Pairs in two scripts go if there is a pair in one; of equal variants the first stays.
    """
    parts = name_parts(df.select(key, raw), raw)
    parts = parts.withColumns({"g": split_alternatives(F.col("given_part")), "s": split_alternatives(F.col("surname_part"))})
    pairs = parts.select(key, raw, F.posexplode("g").alias("i", "given"), "s").select(key, raw, "i", "given", F.posexplode("s").alias("j", "surname"))
    pairs = pairs.withColumns({"gs": script_of(F.col("given")), "ss": F.when(F.col("surname") == "", script_of(F.col("given"))).otherwise(script_of(F.col("surname")))})
    pairs = pairs.withColumns({"same": F.col("gs") == F.col("ss"), "full_name": norm_space(F.concat_ws(" ", "given", "surname"))})
    # the alternatives of one name are few
    whole = pairs.groupBy(key, raw).agg(F.bool_or("same").alias("any_same"), F.sort_array(F.collect_list(F.struct("i", "j", "same", F.when(F.col("same"), F.col("gs")).otherwise("MIXED").alias("script"), "given", "surname", "full_name"))).alias("all"))
    kept = whole.select(key, raw, F.posexplode(F.filter("all", lambda x: (x["same"] | ~F.col("any_same")) & (x["full_name"] != ""))).alias("position", "v")).select(key, raw, "position", "v.script", "v.given", "v.surname", "v.full_name")
    kept = kept.withColumn("full_name_normalized", norm_text(F.col("full_name")))
    first = kept.groupBy(key, raw, "script", "full_name_normalized").agg(F.min(F.struct("position", "given", "surname", "full_name")).alias("m"))
    return first.select(key, raw, "m.position", "script", "m.given", "m.surname", "m.full_name", "full_name_normalized")


def primary_variant(variants: DataFrame, key: str) -> DataFrame:
    """The variant shown for each name: the first in Cyrillic, else Latin, else other script; never a mixed one."""
    rank = F.when(F.col("script") == "CYR", 0).when(F.col("script") == "LAT", 1).when(F.col("script") == "OTHER", 2)
    return variants.withColumn("r", rank).filter("r is not null").groupBy(key).agg(F.min_by(F.struct("script", "given", "surname", "full_name", "full_name_normalized"), F.struct("r", "position")).alias("v")).select(key, "v.*")


def _canonical(c: Column, pairs: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Normalised canonical form, and the canonical spelling where a variant rule applied."""
    norm = norm_text(c)
    to = None
    for a, b in pairs:
        hit = norm == norm_text(F.lit(a))
        to = F.when(hit, b) if to is None else to.when(hit, b)
    return norm, to


def normalized_names(df: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Adds the parsed and normalised parts, confidence and status of name variants (columns given, surname, full_name)."""
    titles = [norm for t in TITLES for norm in (t, t.translate(str.maketrans("йї", "иі")))]
    df = df.withColumn("_w", F.split(norm_space(F.col("given")), " "))
    lead = F.coalesce(F.array_position(F.transform("_w", lambda w: ~norm_text(w).isin(*titles)), F.lit(True)), F.lit(0))
    df = df.withColumn("_k", F.when(lead == 0, F.size("_w")).otherwise(lead - 1).cast("int"))
    df = df.withColumns({"title_prefix": F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " "), "_rest": F.slice("_w", F.col("_k") + 1, F.size("_w"))})
    last = F.element_at("_rest", -1)
    has = (F.size("_rest") >= 2) & F.coalesce(F.try_element_at("_rest", F.lit(-1)), F.lit("")).rlike(_PATRONYMIC)
    df = df.withColumns({
        "given_name": F.array_join(F.when(has, F.slice("_rest", F.lit(1), F.size("_rest") - 1)).otherwise(F.col("_rest")), " "),
        "patronymic": F.when(has, last).otherwise(F.lit("")), "surname": norm_space(F.col("surname")),
    })
    given, given_to = _canonical(F.col("given_name"), GIVEN_VARIANTS)
    surname, surname_to = _canonical(F.col("surname"), SURNAME_VARIANTS)
    df = df.withColumns({"_g": given_to, "_s": surname_to, "_gn": given, "_sn": surname, "patronymic_normalized": norm_text(F.col("patronymic"))})
    df = df.withColumns({
        "given_name_normalized": F.coalesce(norm_text(F.col("_g")), F.lit("")), "surname_normalized": F.coalesce(norm_text(F.col("_s")), F.lit("")),
    })
    df = df.withColumns({
        "given_name_normalized": F.when(F.col("_g").isNotNull(), F.col("given_name_normalized")).otherwise(F.col("_gn")),
        "surname_normalized": F.when(F.col("_s").isNotNull(), F.col("surname_normalized")).otherwise(F.col("_sn")),
    })
    full = norm_space(F.concat_ws(" ", "given_name_normalized", "patronymic_normalized", "surname_normalized"))
    rawc = norm_space(F.col(raw))
    uncertain, unnamed, mixed = rawc.rlike(_UNCERTAIN), rawc.startswith(UNNAMED), script_of(F.col("full_name")) == "MIXED"
    penalty = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = 1.0 - penalty(F.col("given_name") == "", 0.25) - penalty(F.col("surname") == "", 0.20) - penalty(F.col("title_prefix") != "", 0.05) - penalty(uncertain, 0.30) - penalty(mixed, 0.10)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(unnamed, F.least(score, F.lit(0.25))).otherwise(score)))
    df = df.withColumns({
        "full_name_normalized": F.when(full != "", full).otherwise(norm_text(F.col("full_name"))),
        "confidence": F.round(score, 4).cast("decimal(5,4)"), "language_hint": language_hint(F.col("full_name")),
        "name_tokens": F.array_join(F.array_distinct(F.filter(F.split(F.concat_ws(" ", norm_text(F.col(raw)), "given_name_normalized", "patronymic_normalized", "surname_normalized", norm_text(F.col("full_name"))), " "), lambda t: t != "")), " "),
        "explanation": F.concat_ws(
            "; ", F.when(F.col("_g").isNotNull(), F.concat(F.lit("given_name:"), "given_name", F.lit("->"), "_g")), F.when(F.col("_s").isNotNull(), F.concat(F.lit("surname:"), "surname", F.lit("->"), "_s")),
            F.when(uncertain, "uncertainty-marker"), F.when(mixed, "mixed-script"), F.when(unnamed, "generated-unnamed-label"),
        ),
    })
    status = F.when(F.col("full_name") == "", "MISSING_NAME").when(unnamed, "UNNAMED").when(uncertain, "AMBIGUOUS").when(F.col("confidence") < 0.75, "LOW_CONFIDENCE").otherwise("OK")
    return df.withColumn("status", status).drop("_w", "_k", "_rest", "_g", "_s", "_gn", "_sn")
