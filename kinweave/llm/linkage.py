"""What the two person linkages share: name parts, columns in the wrong place, and the final join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.names import skeleton_column
from kinweave.operators.joins import counted_join
from kinweave.operators.runtime import Scratch

#: Titles and remarks beside a name, without stops.
TITLES = ["о", "от", "отець", "свящ", "священник", "пан", "пані", "панна", "мол", "молодший", "ст", "старший", "rev", "mr", "mrs", "miss", "ms", "hr", "fr", "dr", "pan", "pani", "ks", "jr", "sr", "junior", "senior", "sic"]
#: Fixed value: what a patronymic ends in, as a sound-like key.
PATRONYMIC = "(oviC|eviC|iviC|ovna|evna|ivna|iCna|iC)$"

#: Fixed value: the same endings as typed in either script.
TYPED_PATRONYMIC = "(ович|евич|івич|йович|овна|евна|івна|ївна|ична|ovych|evych|yovych|ivna|ovna|owycz|ewycz|iwna|owna)$"

#: Finds the listed keys that each variant spells: (variants, listed, scratch) -> block, variant, listed, score.
Linker = Callable[[DataFrame, DataFrame, Scratch], DataFrame]


def initial(word: Column) -> Column:
    """Latin initial of a word in either script, as abbreviations give it."""
    first = F.lower(F.substring(F.trim(word), 1, 1))
    return F.translate(first, "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяыэёwj", "abvhhdeyzzyiyyklmnoprstufktcss'yyyeyvy")


def with_slots(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with s0, s1... for the name columns: struct(key, initial, short), null without letters.

    Titles, remarks and marks inside words are set aside, and so is a patronymic that
    stands beside another name in the same column.  Each step is a column of its own,
    so that no expression is computed twice.
    """
    for k, c in enumerate(columns):
        plain = F.regexp_replace(F.lower(F.col(c)), r"\[[^\]]*\]|\([^)]*\)|[\x00-\x1f\p{Cf}]|,|/", " ")
        rows = rows.withColumn(f"w{k}", F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 0))
    for k in range(len(columns)):
        rows = rows.withColumn(f"n{k}", F.filter(f"w{k}", lambda w: ~F.regexp_replace(w, r"\.", "").isin(*TITLES)))
    for k in range(len(columns)):
        rows = rows.withColumn(f"w{k}", F.when(F.size(f"n{k}") > 0, F.col(f"n{k}")).otherwise(F.col(f"w{k}")))
    for k in range(len(columns)):
        rows = rows.withColumn(f"n{k}", F.when(F.size(f"w{k}") > 1, F.filter(f"w{k}", lambda w: ~F.regexp_replace(w, r"[^\p{L}]", "").rlike(TYPED_PATRONYMIC))))
    for k in range(len(columns)):
        rows = rows.withColumn(f"w{k}", F.array_join(F.when(F.size(f"n{k}") > 0, F.col(f"n{k}")).otherwise(F.col(f"w{k}")), ""))
    for k in range(len(columns)):
        rows = rows.withColumn(f"n{k}", skeleton_column(F.col(f"w{k}")))
    for k in range(len(columns)):
        text = F.col(f"w{k}")
        short = text.rlike(r"^\p{L}{1,2}\.$") | text.rlike(r"^\p{L}$")
        rows = rows.withColumn(f"s{k}", F.when(F.length(f"n{k}") > 0, F.struct(F.col(f"n{k}").alias("key"), initial(F.regexp_replace(text, r"[^\p{L}]", "")).alias("initial"), short.alias("short"))))
    return rows


def person_parts(person: DataFrame) -> DataFrame:
    """(tree, person_id, given, patronymic, surname, first, middle, birth_year, known): keys of the parts of each name.

    The parts come from the display name, given name first; where it has another order
    the patronymic is told by its ending.  ``known`` says if the surname is given apart.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce("primary_display_name", F.lit("")), r"[,/\s]+", " ")), " ")
    base = person.select(
        F.lower(F.trim("tree_id")).alias("tree"), "person_id", "birth_year", F.col("surname_normalized").isNotNull().alias("known"),
        F.col("given_name"), F.col("surname_normalized"), words.alias("words"),
    )
    usual = (F.size("words") >= 3) & (F.get("words", F.lit(0)) == F.col("given_name"))
    by_end = F.get(F.filter("words", lambda w: skeleton_column(w).rlike(PATRONYMIC) & (w != F.coalesce("given_name", F.lit("")))), F.lit(0))
    middle = F.when(usual, F.get("words", F.lit(1))).otherwise(by_end)
    last = F.coalesce("surname_normalized", F.when(usual, F.array_join(F.slice("words", F.lit(3), F.size("words") - 2), "")))
    return base.withColumns({"middle_name": middle, "last_name": last}).select(
        "tree", "person_id", "birth_year", "known",
        skeleton_column(F.col("given_name")).alias("given"), skeleton_column(F.col("middle_name")).alias("patronymic"), skeleton_column(F.col("last_name")).alias("surname"),
        initial(F.col("given_name")).alias("first"), initial(F.col("middle_name")).alias("middle"),
    )


def given_forms(parts: DataFrame, names: DataFrame) -> DataFrame:
    """(form, given): forms under which given names occur, from the persons' parts and their recorded names.

    A pet form counts for a given name if at least a twentieth of its records say so, which
    is learned from all alias rows.
    """
    owner = parts.select("person_id", "given")
    first = F.get(F.split(F.trim("given"), r"\s+"), F.lit(0))
    alias = names.filter("name_type = 'alias' and given is not null").select("person_id", skeleton_column(first).alias("form"))
    seen = alias.join(owner, "person_id").groupBy("form", "given").agg(F.count(F.lit(1)).alias("n"))
    total = seen.groupBy("form").agg(F.sum("n").alias("all"))
    pets = seen.join(total, "form").filter("n * 20 >= all").select("form", "given")
    own = owner.select(F.col("given").alias("form"), "given")
    return own.unionByName(pets).filter("form is not null and given is not null and form <> '' and given <> ''").distinct()


def link_mentions(mentions: DataFrame, person: DataFrame, names: DataFrame, with_patronymic: bool, link: Linker, scratch: Scratch) -> DataFrame:
    """(mention, tree, year, surname, givens, patronymics, first, middle, score...) with all listed names each mention may spell.

    Each of a mention's name columns is looked up among the given names and (if wanted) the
    patronymics; the column that is neither is the surname, which is looked up in its tree.
    One row per mention and surname candidate; mentions that share an id but differ give none.
    """
    parts = scratch.save(person_parts(person))
    columns = ["given_name", "surname"] + ["patronymic"] * with_patronymic
    few = mentions.select(F.col("person_mention_id").alias("mention"), F.lower(F.trim("tree_id")).alias("tree"), F.col("estimated_birth_year").alias("year"), *columns)
    wide = with_slots(few, columns)
    long = scratch.save(wide.select("mention", "tree", "year", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"s{k}.key").alias("key"), F.col(f"s{k}.initial").alias("initial"), F.col(f"s{k}.short").alias("short")) for k in range(len(columns))])).alias("x")).select("mention", "tree", "year", "x.*").filter("key is not null"))
    keys = scratch.save(long.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    # the lists of given names and of patronymics are two blocks of one search
    forms = scratch.save(given_forms(parts, names))
    listed = forms.select(F.lit("G").alias("block"), F.col("form").alias("listed")).distinct()
    blocks = F.array(F.lit("G"))
    if with_patronymic:
        listed = listed.unionByName(parts.filter("patronymic <> ''").select(F.lit("P").alias("block"), F.col("patronymic").alias("listed")).distinct())
        blocks = F.array(F.lit("G"), F.lit("P"))
    found = scratch.save(link(keys.select(F.explode(blocks).alias("block"), F.col("key").alias("variant")), scratch.save(listed), scratch))
    # a form of several given names stands for each of them
    given = found.filter("block = 'G'").join(forms.withColumnRenamed("form", "listed"), "listed").select("variant", F.lit("G").alias("block"), F.col("given").alias("name"), "score")
    patr = found.filter("block = 'P'").select("variant", "block", F.col("listed").alias("name"), "score")
    each = given.unionByName(patr).groupBy("variant", "block", "name").agg(F.max("score").alias("score"))
    options = lambda block: F.nullif(F.sort_array(F.collect_list(F.when(F.col("block") == block, F.struct("name", "score")))), F.array().cast("array<struct<name:string,score:double>>"))
    best = lambda block: F.max(F.when(F.col("block") == block, F.col("score")))
    roles = each.groupBy(F.col("variant").alias("key")).agg(options("G").alias("givens"), best("G").alias("given_score"), options("P").alias("patrs"), best("P").alias("patr_score"))
    roles = keys.join(roles, "key", "left")
    told = counted_join(long, scratch.save(roles), "key", "n")
    # a role goes to the column that fits best, the usual one among equals; what is abbreviated stays where it is
    own = lambda k: F.col("place") == k
    fit_given = F.when(F.col("short") & own(0), 0.5).otherwise(F.coalesce("given_score", F.lit(0.0))) + F.when(own(0), 0.05).otherwise(0.0)
    fit_patr = F.when(F.col("short") & own(2), 0.5).otherwise(F.coalesce("patr_score", F.lit(0.0))) + F.when(own(2), 0.05).otherwise(0.0)
    row = F.struct("place", "tree", "year", "key", "initial", "short", "givens", "given_score", "patrs", "patr_score", fit_given.alias("fg"), fit_patr.alias("fp"))
    packed = told.groupBy("mention").agg(F.sort_array(F.collect_set(row)).alias("slots"))
    # a repeated mention has the same slots; one whose rows differ, in names, tree or year, is ambiguous and goes
    first = F.get("slots", F.lit(0))
    packed = packed.filter(F.size("slots") == len(columns)).withColumns({"tree": first["tree"], "year": first["year"]})
    if with_patronymic:
        packed = packed.withColumn("p", F.array_max(F.transform("slots", lambda s: F.struct(s["fp"].alias("fit"), (-s["fg"]).alias("other"), s["place"].alias("place"))))["place"])
    else:
        packed = packed.withColumn("p", F.lit(-1))
    packed = packed.withColumn("g", F.array_max(F.transform(F.filter("slots", lambda s: s["place"] != F.col("p")), lambda s: F.struct(s["fg"].alias("fit"), (-s["place"]).alias("place"))))["place"])
    packed = packed.withColumn("g", -F.col("g"))
    pick = lambda name: F.get(F.filter("slots", lambda s: s["place"] == F.col(name)), F.lit(0))
    rest = F.get(F.filter("slots", lambda s: (s["place"] != F.col("g")) & (s["place"] != F.col("p"))), F.lit(0))
    whole = packed.withColumns({"gs": pick("g"), "ps": pick("p"), "ss": rest}).filter("ss is not null and gs is not null")
    whole = whole.filter(F.col("gs.short") | F.col("gs.givens").isNotNull())
    if with_patronymic:
        whole = whole.filter(F.col("ps.short") | F.col("ps.patrs").isNotNull())
    ready = scratch.save(
        whole.select(
            "mention", "tree", "year", F.concat_ws("|", "tree", "ss.key").alias("at"), F.col("ss.key").alias("typed"),
            F.when(~F.col("gs.short"), F.col("gs.givens")).alias("givens"), F.col("gs.initial").alias("first"),
            F.when(~F.col("ps.short"), F.col("ps.patrs")).alias("patronymics"), F.col("ps.initial").alias("middle"),
        )
    )
    surnames = scratch.save(ready.groupBy("at", "tree", "typed").agg(F.count(F.lit(1)).alias("n")))
    listed = parts.filter("surname <> '' and tree is not null").select(F.col("tree").alias("block"), F.col("surname").alias("listed")).distinct()
    found = link(surnames.select(F.col("tree").alias("block"), F.col("typed").alias("variant")), scratch.save(listed), scratch)
    options = found.groupBy("block", "variant").agg(F.collect_list(F.struct(F.col("listed").alias("surname"), F.col("score").alias("surname_score"))).alias("options"))
    per_key = scratch.save(surnames.join(options, [surnames["tree"] == options["block"], surnames["typed"] == options["variant"]]).select("at", "n", "options"))
    return counted_join(ready, per_key, "at", "n", how="inner").select("*", F.explode("options").alias("o")).select("*", "o.*").drop("o", "options", "at"), parts
