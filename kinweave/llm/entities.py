"""Matching entities across sources without keys: bit vectors, multi-index hashing, confidences.

Each name is a 64-bit vector of its numbered letters (its q-grams for q = 1), once for its
key and once for the key with its sounds written out, as the exact check compares both
forms.  A slip changes few of these bits: how many at most, two lengths tell.  Vectors at a
Hamming distance of at most r that are cut into r + 2 blocks of bits agree in at least two
of them, and in r + 1 blocks in at least one, so a join on the typed length and the agreeing
blocks finds all close pairs exactly, and few others.  Dice scores of the vectors of letter
pairs (q = 2) are weighted over the fields into one, and turned into a confidence by
comparing, per score, how often the birth years agree with how often they would by chance.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.linkage import link_mentions
from kinweave.llm.names import LONG, near, written
from kinweave.operators.runtime import Scratch

BITS = 64
#: Letters by how often names have them: neighbours in this order lie in different blocks of bits. Any order gives the same pairs.
LETTERS = "ikheasuonrbtcvzmdplSCZX"
#: Bits from one occurrence of a letter to its next.
AGAIN = 29
#: Radius by difference of lengths, where two slips of any kind are allowed: each replaced letter changes two bits, each added one.
WIDE = {0: 4, 1: 3, 2: 2}
#: The same for one slip; two swapped neighbours change no bit.
NARROW = {0: 2, 1: 1}
#: Blocks that must agree, by radius.
AGREE = {4: 2, 3: 2, 2: 2, 1: 1}
LEAST_DICE = 0.45
WEIGHTS = {"surname": 0.55, "given": 0.35, "year": 0.10}
YEARS = 3
#: Years apart that only chance brings about; their rate stands for chance agreement.
CHANCE = (8, 60)
BINS = 20


def bit_vector(key: Column) -> Column:
    """64-bit vector of the letter pairs of a key, with marks for its ends."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    bits = F.transform(pairs, lambda p: F.pmod(F.xxhash64(p), F.lit(BITS)).cast("int"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))


def letter_vector(text: Column) -> Column:
    """64-bit vector of the letters of a text, its first a, its second a and so on being different letters."""

    def bit(i: Column) -> Column:
        letter, upto = F.substring(text, i, F.lit(1)), F.substring(text, F.lit(1), i)
        number = F.length(upto) - F.length(F.replace(upto, letter, F.lit(""))) - 1
        rank = F.instr(F.lit(LETTERS), letter) - 1
        return F.when(rank >= 0, F.pmod(rank + AGAIN * number, F.lit(BITS))).otherwise(F.pmod(F.xxhash64(letter, number), F.lit(BITS))).cast("int")

    bits = F.transform(F.sequence(F.lit(1), F.length(text)), bit)
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))


def radius(a: int, b: int) -> int | None:
    """Bits that may differ between keys of these lengths that the exact check lets through; None if it lets none."""
    return (WIDE if max(a, b) >= LONG else NARROW).get(abs(a - b))


def _signatures(r: int, apart: int) -> list[Column]:
    """What vectors (v) at most ``r`` bits apart have in common in at least one place: (radius, difference of lengths, blocks, their bits)."""
    blocks = [sum(1 << p for p in range(k, BITS, r + AGREE[r])) for k in range(r + AGREE[r])]
    masks = [sum(c) for c in combinations(blocks, AGREE[r])]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [F.struct(F.lit((r * 8 + apart) * 64 + n).alias("kind"), F.col("v").bitwiseAND(F.lit(signed(m)).cast("bigint")).alias("bits")) for n, m in enumerate(masks)]


def _index(keys: DataFrame, name: str, typed: bool) -> DataFrame:
    """(block, name, form, at, kind, bits): the signatures of both forms of each key; ``at`` is the typed key's length."""
    text = F.inline(F.array(*[F.struct(F.lit(k).alias("form"), form.alias("text")) for k, form in enumerate((F.col(name), written(F.col(name))))]))
    forms = keys.select("block", name, text).select("block", name, "form", F.length("text").alias("n"), letter_vector(F.col("text")).alias("v"))
    n, none = F.col("n"), F.array().cast("array<struct<at:int,kind:int,bits:bigint>>")
    parts = []
    for r, apart in {(table[d], d) for table in (WIDE, NARROW) for d in table}:
        wide = WIDE.get(apart) == r
        shifts = (0,) if typed else sorted({apart, -apart})
        for shift in shifts:
            # the typed key's length, and the lengths that the pair may have
            at = n + shift
            others = (n + apart, n - apart) if typed else (at,)
            fits = [(F.greatest(n, o) >= LONG) if wide else (F.greatest(n, o) < LONG) for o in others]
            some = fits[0] | fits[-1]
            if wide and NARROW.get(apart) == r:
                some = F.lit(True)
            parts.append(F.when(some & (at > 0), F.transform(F.array(*_signatures(r, apart)), lambda x: F.struct(at.cast("int").alias("at"), x["kind"].alias("kind"), x["bits"].alias("bits")))).otherwise(none))  # noqa: B023
    return forms.select("block", name, "form", F.inline(F.concat(*parts)))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) + F.bit_count(b))


def candidates(variants: DataFrame, listed: DataFrame) -> DataFrame:
    """(block, variant, listed): pairs with a common signature, each once; all that the exact check lets through are among them."""
    on = ["block", "form", "at", "kind", "bits"]
    tasks = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of partitions, as few rows may make many pairs
    mine, theirs = (_index(df, name, name == "variant").repartition(tasks, *on) for df, name in ((variants, "variant"), (listed, "listed")))
    return mine.join(theirs.hint("shuffle_hash"), on).select("block", "variant", "listed").distinct()


def close_keys(variants: DataFrame, listed: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, variant, listed, score): the listed keys of its block close to each variant; score is the Dice coefficient.

    All pairs within the radius of their lengths in either form are found, which are all
    that the exact check of slips lets through.  A variant equal to a listed key is linked to it alone.
    """
    known = listed.select("block", F.col("listed").alias("variant"), F.lit(True).alias("known"))
    tagged = scratch.save(variants.filter("variant <> ''").join(known.hint("merge"), ["block", "variant"], "left"))
    same = tagged.filter("known").select("block", "variant", F.col("variant").alias("listed"), F.lit(1.0).alias("score"))
    found = candidates(tagged.filter("known is null"), listed.filter("listed <> ''")).filter(near(F.col("variant"), F.col("listed")))
    score = lambda f: dice(bit_vector(f(F.col("variant"))), bit_vector(f(F.col("listed"))))
    found = found.withColumns({"score": score(lambda c: c), "written": score(written)}).filter(F.greatest("score", "written") >= LEAST_DICE)
    return same.unionByName(found.select("block", "variant", "listed", "score"))


def matched_persons(mentions: DataFrame, person: DataFrame, names: DataFrame) -> DataFrame:
    """(person_mention_id, person_id, score, confidence): the person of its tree that each mention describes.

    Mentions with given name, surname and estimated birth year are matched to persons with
    surname and birth year, at most YEARS apart.  A mention that fits several persons
    equally well gets no row; repeated mentions give one; empty tables give none.
    """
    scratch = Scratch(mentions.sparkSession, "entities")
    used = mentions.filter("estimated_birth_year is not null and tree_id is not null")
    linked, parts = link_mentions(used, person, names, False, close_keys, scratch)
    owners = parts.filter("known and birth_year is not null and given <> '' and surname <> ''").select("tree", "surname", "given", "person_id", "birth_year", "first")
    exact = linked.filter("givens is not null").select("mention", "tree", "year", "surname", "surname_score", F.explode("givens").alias("x")).select("*", F.col("x.name").alias("given"), F.col("x.score").alias("given_score")).drop("x").join(owners.drop("first").hint("merge"), ["tree", "surname", "given"])
    short = linked.filter("givens is null").select("mention", "tree", "year", "surname", "surname_score", F.lit(0.5).alias("given_score"), "first").join(owners.hint("merge"), ["tree", "surname", "first"]).drop("first")
    away = F.abs(F.col("year").cast("int") - F.col("birth_year").cast("int"))
    pairs = exact.unionByName(short, allowMissingColumns=True).withColumn("away", away).filter(F.col("away") <= CHANCE[1])
    name = (WEIGHTS["surname"] * F.col("surname_score") + WEIGHTS["given"] * F.col("given_score")) / (WEIGHTS["surname"] + WEIGHTS["given"])
    pairs = scratch.save(pairs.withColumn("name", name).withColumn("bin", F.floor(F.col("name") * BINS).cast("int")).select("mention", "person_id", "away", "name", "bin"))
    chance = F.count(F.when(F.col("away") >= CHANCE[0], 1)) * (2 * YEARS + 1) / (2 * (CHANCE[1] - CHANCE[0] + 1))
    agree = F.count(F.when(F.col("away") <= YEARS, 1))
    # BINS + 1 rows
    calibrated = pairs.groupBy("bin").agg(F.greatest(F.lit(0.0), 1 - (chance + 0.5) / (agree + 1)).alias("confidence"))
    year = 1 - F.col("away") / (YEARS + 1)
    close = pairs.filter(F.col("away") <= YEARS).withColumn("score", (1 - WEIGHTS["year"]) * F.col("name") + WEIGHTS["year"] * year)
    top = close.groupBy("mention").agg(F.max("score").alias("top"))
    first = close.join(top.hint("merge"), "mention").filter(F.col("score") >= F.col("top") - 1e-9).groupBy("mention").agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("persons"), F.max("score").alias("score"), F.max("bin").alias("bin"))
    return first.filter("persons = 1").join(F.broadcast(calibrated), "bin").select(F.col("mention").alias("person_mention_id"), "person_id", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"))
