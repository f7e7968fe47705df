"""Consolidating pairwise matches into groups (connected components).

The component around the vertex of highest degree is peeled first, by frontier joins;
its links are anti-joined away.  The rest is labelled by minimum propagation with
contraction: in every round each vertex moves to the least vertex seen within two steps,
the links are rewritten to the new labels, and repeated ones and loops vanish.  What is
least is decided by a hash that differs from round to round, never by the ids themselves:
a vertex is then the least among its neighbours with a chance of at most one half, whatever
the ids look like, so a component of n vertices is expected to take about log n rounds,
also where the ids run along a chain.  A group's name, its smallest id, is an aggregate
over the finished labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.joins import counted_join
from kinweave.operators.runtime import Scratch

#: Rounds of frontier joins; a component that is deeper is contracted to one vertex as far as it was seen.
PEEL_ROUNDS = 6


def _peel(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (v, l) of what is seen from the highest-degree vertex, and the links that remain."""
    hub = links.groupBy("s").count().orderBy(F.desc("count"), "s").first()
    frontier = links.filter(F.col("s") == hub["s"]).select(F.col("t").alias("v")).distinct()
    seen = scratch.save(links.filter(F.col("s") == hub["s"]).select(F.col("s").alias("v")).limit(1).unionByName(frontier).withColumn("round", F.lit(1)))
    complete = False
    for turn in range(2, PEEL_ROUNDS + 1):
        edge = seen.filter(F.col("round") == turn - 1).select(F.col("v").alias("s"))
        more = links.join(edge, "s").select(F.col("t").alias("v")).distinct().join(seen, "v", "left_anti").withColumn("round", F.lit(turn))
        more = scratch.save(more)
        if more.isEmpty():
            complete = True
            break
        old, seen = seen, scratch.save(seen.unionByName(more))
        scratch.drop(old, more)
    low = seen.agg(F.min("v")).first()[0]
    labels = scratch.save(seen.select("v", F.lit(low).alias("l")))
    gone = labels.select(F.col("v").alias("s"))
    rest = links.join(gone, "s", "left_anti")
    if not complete:  # the links that leave what was seen now leave its one label
        back = labels.select(F.col("v").alias("t"), "l")
        crossing = rest.join(back, "t").select("s", F.col("l").alias("t"))
        inner = rest.join(gone.withColumnRenamed("s", "t"), "t", "left_anti").select("s", "t")
        rest = inner.unionByName(crossing).unionByName(crossing.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct()
    return labels, scratch.save(rest.select("s", "t"))


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Group of every id in ``pairs``: (id, group), the group being its smallest id.

    Ids are trimmed and lower-cased; null and blank ids are none, and a row with one id
    alone puts it in a group of its own.  Repeated pairs and pairs of an id with itself
    change nothing; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    named = pairs.select(clean(pairs[a]).alias("s"), clean(pairs[b]).alias("t"))
    one = scratch.save(named.distinct())
    ids = one.select(F.explode(F.array("s", "t")).alias("id")).filter("id is not null").distinct()
    real = one.filter("s is not null and t is not null and s <> t")
    links = scratch.save(real.unionByName(real.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct())
    if links.isEmpty():
        return ids.select("id", F.col("id").alias("group"))
    maps = []
    peeled, links = _peel(scratch, links)
    while not links.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = links.groupBy("s").agg(F.min(order("t")).alias("m"), F.count(F.lit(1)).alias("n"))
        least = scratch.save(near.select(F.col("s").alias("v"), F.least(order("s"), F.col("m"))["v"].alias("l"), "n"))
        # l is chosen by at most as many vertices as it has links
        aim = least.select(F.col("v").alias("l"), F.col("l").alias("l2"), F.col("n"))
        step = scratch.save(counted_join(least.withColumnRenamed("n", "links"), aim, "l", "n", how="inner").select("v", F.col("l2").alias("l"), F.col("links").alias("n")))
        maps.append(step.select("v", "l"))
        # every link stands in both directions, so a vertex occurs as often on either side
        moved = counted_join(links, step.toDF("s", "s2", "n"), "s", "n", how="inner").select(F.col("s2").alias("s"), "t")
        moved = counted_join(moved, step.toDF("t", "t2", "n"), "t", "n", how="inner").select("s", F.col("t2").alias("t"))
        old, links = links, scratch.save(moved.filter("s <> t").distinct())
        scratch.drop(old, least)
    label = None
    for step in reversed(maps):
        if label is not None:
            step = step.join(label.toDF("l", "l2"), "l", "left").select("v", F.coalesce("l2", "l").alias("l"))
        label = scratch.save(step)
    if label is None:
        label = peeled
    else:
        # what was peeled has one label, which a single row leads on
        low = peeled.select("l").first()[0]
        last = label.filter(F.col("v") == low).select("l").first()
        label = peeled.select("v", F.lit(last[0] if last else low).alias("l")).unionByName(label.join(peeled.select("v"), "v", "left_anti"))
    label = scratch.save(label)
    names = scratch.save(label.groupBy("l").agg(F.min("v").alias("group"), F.count(F.lit(1)).alias("n")))
    named = counted_join(label, names, "l", "n", how="inner").select(F.col("v").alias("id"), "group")
    return ids.join(named, "id", "left").select("id", F.coalesce("group", "id").alias("group"))
