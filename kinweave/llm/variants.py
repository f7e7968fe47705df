"""Variant spellings of names: sparse cosine joins of character n-grams and average linkage.

Distinct spellings are vectors of n-gram weights (tf times idf over the listed names, unit
length).  A join on (block, n-gram) over the rarest n-grams of both sides, which cover all
but a part too light to reach the threshold, finds the candidates; their cosines are exact.
All that pass an exact check of slips go on to average linkage: a listed name and the
spellings nearest to it are a cluster, and as the average cosine with a cluster's members is
the product with the sum of their vectors, clusters of any size cost one aggregate.  A
spelling stays with the clusters whose average is near the best average that it has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.linkage import link_mentions
from kinweave.llm.names import near
from kinweave.operators.runtime import Scratch


@dataclass(frozen=True)
class Rule:
    threshold: float = 0.22  #: least cosine of a spelling and a listed name
    linkage: float = 0.18  #: least average cosine with the cluster; measured averages of spellings that fit one name alone begin at 0.19
    sizes: tuple[int, ...] = (2, 3)


def grams(key: Column, sizes: tuple[int, ...]) -> Column:
    padded = F.concat(F.lit("^"), key, F.lit("$"))

    def each(n: int) -> Column:
        # transform() would take a default argument for its index, so n comes from here
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    return F.array_distinct(F.concat(*map(each, sizes)))


def _vectors(keys: DataFrame, name: str, idf: DataFrame, unknown: float, rule: Rule) -> DataFrame:
    """(block, name, vec, head): the vector of each key as a map of unit length, and the n-grams that candidates must share.

    An n-gram that no listed name has gets the weight ``unknown``.  The order from rare to
    common is the same for all keys, so two keys that reach the threshold share an n-gram
    of both heads.
    """
    long = keys.select("block", name, F.explode(grams(F.col(name), rule.sizes)).alias("gram")).join(idf, "gram", "left")
    packed = long.groupBy("block", name).agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("idf", F.lit(unknown))).alias("order"), "gram"))).alias("all"))
    packed = packed.withColumn("norm", F.sqrt(F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["order"] * x["order"])))
    # what the n-grams before a place leave of the squared length must reach the threshold for it to be in the head
    least = F.col("norm") * F.col("norm") * rule.threshold**2
    start = F.struct((F.col("norm") * F.col("norm")).alias("left"), F.array().cast("array<string>").alias("head"))
    step = lambda acc, x: F.struct((acc["left"] - x["order"] * x["order"]).alias("left"), F.when(acc["left"] >= least - 1e-9, F.concat(acc["head"], F.array(x["gram"]))).otherwise(acc["head"]).alias("head"))
    vec = F.map_from_entries(F.transform("all", lambda x: F.struct(x["gram"].alias("key"), (-x["order"] / F.col("norm")).alias("value"))))
    return packed.select("block", name, vec.alias("vec"), F.aggregate("all", start, step, lambda acc: acc["head"]).alias("head"))


def spellings(variants: DataFrame, listed: DataFrame, scratch: Scratch, rule: Rule = Rule()) -> DataFrame:
    """(block, variant, listed, score): the listed keys of its block that each variant spells.

    ``variants`` (block, variant) and ``listed`` (block, listed) are distinct keys.  The
    score is the average cosine with the listed key's cluster, of all that an exact check of
    slips lets through.  A variant equal to a listed key spells it, with score 1, and nothing else.
    """
    known = listed.select("block", F.col("listed").alias("variant"), F.lit(True).alias("known"))
    tagged = scratch.save(variants.filter("variant <> ''").join(known, ["block", "variant"], "left"))
    same = tagged.filter("known").select("block", "variant", F.col("variant").alias("listed"), F.lit(1.0).alias("score"))
    other = tagged.filter("known is null")
    count = float(listed.count())
    # an n-gram of the alphabets' letters: some ten thousand rows, whatever the number of names
    idf = scratch.save(listed.select(F.explode(grams(F.col("listed"), rule.sizes)).alias("gram")).groupBy("gram").agg(F.log1p(F.lit(count) / F.count(F.lit(1))).alias("idf")))
    unknown = math.log1p(count)
    theirs = scratch.save(_vectors(listed, "listed", idf, unknown, rule).withColumnRenamed("vec", "lm"))
    mine = scratch.save(_vectors(other, "variant", idf, unknown, rule).withColumnRenamed("vec", "vm"))
    pairs = mine.select("block", "variant", F.explode("head").alias("gram")).join(theirs.select("block", "listed", F.explode("head").alias("gram")), ["block", "gram"])
    pairs = pairs.filter(near(F.col("variant"), F.col("listed"))).select("block", "variant", "listed").distinct()
    dot = lambda x, y: F.aggregate(F.map_entries(x), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(y, e["key"]), F.lit(0.0)))
    scored = pairs.join(mine.select("block", "variant", "vm"), ["block", "variant"]).join(theirs.select("block", "listed", "lm"), ["block", "listed"])
    scored = scored.withColumn("cosine", dot("vm", F.col("lm"))).filter(F.col("cosine") >= rule.threshold).drop("lm")
    rank = F.row_number().over(W.partitionBy("block", "variant").orderBy(F.desc("cosine"), "listed"))
    top = scratch.save(scored.withColumn("nearest", rank == 1))
    scratch.drop(idf, theirs, mine)
    member = top.filter("nearest").select("block", "listed", F.explode("vm").alias("gram", "w"))
    centre = member.groupBy("block", "listed", "gram").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).groupBy("block", "listed").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("sum"))
    sizes = top.filter("nearest").groupBy("block", "listed").agg(F.count(F.lit(1)).alias("members"))
    inside = F.col("nearest").cast("double")
    # the listed name and its members, without the spelling itself
    average = (F.col("cosine") + F.coalesce(dot("vm", F.col("sum")), F.lit(0.0)) - inside) / (1 + F.coalesce("members", F.lit(0)) - inside)
    linked = top.join(centre.join(sizes, ["block", "listed"]), ["block", "listed"], "left").withColumn("score", average)
    kept = linked.filter(F.col("score") >= rule.linkage).select("block", "variant", "listed", F.least(F.col("score"), F.lit(0.999)).alias("score"))
    return same.unionByName(kept)


def spelt_persons(mentions: DataFrame, person: DataFrame, names: DataFrame) -> DataFrame:
    """(person_mention_id, person_id): the one person of its tree that a mention with patronymic spells.

    Columns in the wrong place, titles, pet forms, abbreviations and either script are
    allowed for.  A mention that fits several persons of its tree equally well, or has a
    part missing, gets no row; repeated mentions give one row; empty tables no rows.
    """
    scratch = Scratch(mentions.sparkSession, "variants")
    linked, parts = link_mentions(mentions.filter("patronymic is not null and tree_id is not null"), person, names, True, spellings, scratch)
    shapes = F.array(
        F.concat_ws("|", F.lit("GP"), "given", "patronymic"), F.concat_ws("|", F.lit("gP"), "first", "patronymic"),
        F.concat_ws("|", F.lit("Gp"), "given", "middle"), F.concat_ws("|", F.lit("gp"), "first", "middle"),
    )
    owners = parts.filter("given <> '' and patronymic <> '' and surname <> ''").select("tree", "surname", F.explode(shapes).alias("name"), "person_id")
    owners = owners.groupBy("tree", "surname", "name").agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("persons"))
    kind = F.concat(F.when(F.col("givens").isNull(), "g").otherwise("G"), F.when(F.col("patronymics").isNull(), "p").otherwise("P"))
    either = lambda names, one: F.coalesce(names, F.array(F.struct(F.col(one).alias("name"), F.lit(0.0).alias("score"))))
    wanted = linked.select("mention", "tree", "surname", "surname_score", kind.alias("kind"), F.explode(either("givens", "first")).alias("g"), F.col("patronymics"), F.col("middle"))
    wanted = wanted.select("*", F.explode(either("patronymics", "middle")).alias("p"))
    score = F.col("surname_score") + F.col("g.score") + F.col("p.score")
    wanted = wanted.select("mention", "tree", "surname", score.alias("score"), F.concat_ws("|", "kind", "g.name", "p.name").alias("name"))
    hits = wanted.join(owners, ["tree", "surname", "name"])
    best = hits.groupBy("mention").agg(F.max("score").alias("top"), F.collect_set(F.struct("score", "person_id", "persons")).alias("found"))
    # the found persons of one mention are few: its surname candidates times its given names and patronymics
    first = F.filter("found", lambda x: x["score"] >= F.col("top") - 0.02)
    return best.withColumn("first", first).filter((F.size(F.array_distinct(F.transform("first", lambda x: x["person_id"]))) == 1) & (F.get("first", F.lit(0))["persons"] == 1)).select(
        F.col("mention").alias("person_mention_id"), F.get("first", F.lit(0))["person_id"].alias("person_id")
    )
