"""Kinship walks over parent edges: all starts at once, with a guard against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.runtime import Scratch
from kinweave.operators.trees import life_dates, spouse_edges
from kinweave.plans.adapters import Workspace

#: Levels that one plan may unroll; longer walks are cut by stored tables.
UNROLL = 4


def walk(edges: DataFrame, up: bool, generations: int, starts: DataFrame | None = None) -> DataFrame:
    """All walks from every start: tree_id, start_id, person_id, generation, ids (the start included), path (the ids joined by '>').

    One row per path; a path never meets an id twice, so loops end and the start is not
    its own relative.  ``starts`` (tree_id, start_id) defaults to every node with an edge.
    """
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = edges.select("tree_id", F.col(a).alias("at"), F.col(b).alias("to"))
    scratch = Scratch(edges.sparkSession, "walk")
    level = step if starts is None else step.join(starts.withColumnRenamed("start_id", "at"), ["tree_id", "at"], "left_semi")
    level = level.select("tree_id", F.col("at").alias("start_id"), F.col("to").alias("person_id"), F.lit(1).alias("generation"), F.array("at", "to").alias("ids")).filter("start_id <> person_id")
    out = level if generations > 0 else level.limit(0)
    for g in range(2, generations + 1):
        if g % UNROLL == 0:
            level = scratch.save(level)
            if level.isEmpty():
                break
        nxt = level.withColumnRenamed("person_id", "at").join(step, ["tree_id", "at"]).filter(~F.array_contains("ids", F.col("to")))
        level = nxt.select("tree_id", "start_id", F.col("to").alias("person_id"), F.lit(g).alias("generation"), F.concat("ids", F.array("to")).alias("ids"))
        out = out.unionByName(level)
    return out.withColumn("path", F.array_join("ids", ">"))


def nearest(edges: DataFrame, up: bool, generations: int, starts: DataFrame | None = None) -> DataFrame:
    """Relatives at their least distance: tree_id, start_id, person_id, generation; a frontier that never looks back.

    Unlike :func:`walk` it keeps one row per pair, so shared ancestors do not multiply.
    """
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = edges.select("tree_id", F.col(a).alias("at"), F.col(b).alias("to"))
    scratch = Scratch(edges.sparkSession, "nearest")
    first = step if starts is None else step.join(starts.withColumnRenamed("start_id", "at"), ["tree_id", "at"], "left_semi")
    frontier = first.select("tree_id", F.col("at").alias("start_id"), F.col("to").alias("person_id")).filter("start_id <> person_id").distinct().withColumn("generation", F.lit(1))
    seen = scratch.save(frontier)
    frontier = seen
    for g in range(2, generations + 1):
        nxt = frontier.withColumnRenamed("person_id", "at").join(step, ["tree_id", "at"]).select("tree_id", "start_id", F.col("to").alias("person_id")).filter("start_id <> person_id").distinct()
        frontier = scratch.save(nxt.join(seen, ["tree_id", "start_id", "person_id"], "left_anti").withColumn("generation", F.lit(g)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def ancestors(ws: Workspace, generations: int = 6) -> DataFrame:
    """Ancestors of every person with name, sex, births and deaths; one row per ancestor and generation."""
    rows = walk(ws.parent, True, generations).select("tree_id", F.col("start_id").alias("person_id"), F.col("person_id").alias("ancestor_id"), "generation").distinct()
    who = ws.person.select("tree_id", F.col("person_id").alias("ancestor_id"), F.col("display_name").alias("name"), "sex")
    return rows.join(who, ["tree_id", "ancestor_id"]).join(life_dates(ws).withColumnRenamed("person_id", "ancestor_id"), ["tree_id", "ancestor_id"], "left")


def descendants(ws: Workspace, generations: int = 8) -> DataFrame:
    """Descendants of every person, one row per path, with the parent on the path."""
    rows = walk(ws.parent, False, generations)
    who = ws.person.select("tree_id", "person_id", F.col("display_name").alias("name"))
    return rows.join(who, ["tree_id", "person_id"]).select("tree_id", F.col("start_id").alias("ancestor_id"), F.col("person_id").alias("descendant_id"), F.element_at("ids", -2).alias("parent_id"), "generation", "name")


def person_tree(ws: Workspace, up: bool, generations: int = 6, include_root: bool = True, starts: DataFrame | None = None) -> DataFrame:
    """Walk (from ``starts`` if given) with the edge's ends and the whole path; the roots themselves as generation 0 if wanted."""
    generations = max(0, min(50, generations))
    rows = walk(ws.parent, up, generations, starts).select("tree_id", F.col("start_id").alias("root_id"), "person_id", F.element_at("ids", -2).alias("from_id"), "generation", "path")
    if not include_root:
        return rows
    people = ws.person if starts is None else ws.person.join(starts.withColumnRenamed("start_id", "person_id"), ["tree_id", "person_id"], "left_semi")
    roots = people.select("tree_id", F.col("person_id").alias("root_id"), "person_id", F.lit(None).cast("string").alias("from_id"), F.lit(0).alias("generation"), F.col("person_id").alias("path"))
    return rows.unionByName(roots)


def descendants_at_year(ws: Workspace, year: int, generations: int = 8, starts: DataFrame | None = None) -> DataFrame:
    """Descendants of every person (of ``starts`` if given) who may be alive in a year, and spouses married by then; unknown dates pass."""
    rows = walk(ws.parent, False, generations, starts).select("tree_id", "start_id", "person_id", "generation")
    near = rows.groupBy("tree_id", F.col("start_id").alias("ancestor_id"), "person_id").agg(F.min("generation").alias("generation"))
    years = ws.event.filter(F.col("event_type").isin("BIRT", "DEAT")).groupBy("tree_id", "person_id").agg(
        F.min(F.when(F.col("event_type") == "BIRT", F.coalesce("year_from", "year_to"))).alias("born"), F.min(F.when(F.col("event_type") == "DEAT", F.coalesce("year_from", "year_to"))).alias("died")
    )
    alive = (F.col("born").isNull() | (F.col("born") <= year)) & (F.col("died").isNull() | (F.col("died") >= year))
    kin = near.join(years, ["tree_id", "person_id"], "left").filter(alive).select("tree_id", "ancestor_id", "person_id", "generation", F.lit("DESCENDANT").alias("role"))
    wed = spouse_edges(ws).filter(F.col("marriage_year").isNull() | (F.col("marriage_year") <= year)).select("tree_id", "person_id", "spouse_id")
    partners = kin.join(wed, ["tree_id", "person_id"]).join(years.withColumnRenamed("person_id", "spouse_id"), ["tree_id", "spouse_id"], "left").filter(alive)
    partners = partners.select("tree_id", "ancestor_id", F.col("spouse_id").alias("person_id"), "generation", F.lit("SPOUSE").alias("role")).distinct()
    return kin.unionByName(partners)


def common_ancestors(ws: Workspace, pairs: DataFrame, generations: int = 12) -> DataFrame:
    """Closest common ancestor of each pair (tree_id, pair_id, a_id, b_id): ancestor_id, depth_a, depth_b.

    Each person is their own ancestor at depth 0; of several the one with the least greater
    depth, then least sum, then smallest id; a pair without any has no row.
    """
    long = pairs.select("tree_id", "pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a_id").alias("start_id")), F.struct(F.lit(1).alias("side"), F.col("b_id").alias("start_id")))).alias("x")).select("tree_id", "pair_id", "x.*")
    starts = long.select("tree_id", "start_id").distinct()
    up = nearest(ws.parent, True, generations, starts).unionByName(starts.select("tree_id", "start_id", F.col("start_id").alias("person_id"), F.lit(0).alias("generation")))
    both = long.join(up, ["tree_id", "start_id"]).groupBy("tree_id", "pair_id", F.col("person_id").alias("ancestor_id")).agg(
        F.min(F.when(F.col("side") == 0, F.col("generation"))).alias("depth_a"), F.min(F.when(F.col("side") == 1, F.col("generation"))).alias("depth_b")
    )
    both = both.filter("depth_a is not null and depth_b is not null")
    best = both.groupBy("tree_id", "pair_id").agg(F.min(F.struct(F.greatest("depth_a", "depth_b").alias("m"), (F.col("depth_a") + F.col("depth_b")).alias("s"), "ancestor_id", "depth_a", "depth_b")).alias("x"))
    return best.select("tree_id", "pair_id", "x.ancestor_id", "x.depth_a", "x.depth_b")


def paths_between(ws: Workspace, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """Shortest path of parent and child steps of each pair: tree_id, pair_id, steps, path, relations.

    A frontier per pair, that keeps the smallest path to each person and stops for pairs
    that arrived.  Equal or unconnected persons give no row.
    """
    scratch = Scratch(pairs.sparkSession, "paths_between")
    p = ws.parent
    edge = scratch.save(
        p.select("tree_id", F.col("parent_id").alias("at"), F.col("child_id").alias("to"), F.lit("PARENT_OF").alias("relation"))
        .unionByName(p.select("tree_id", F.col("child_id").alias("at"), F.col("parent_id").alias("to"), F.lit("CHILD_OF").alias("relation")))
    )
    goal = scratch.save(pairs.filter("a_id <> b_id").select("tree_id", "pair_id", "a_id", "b_id"))
    frontier = goal.select("tree_id", "pair_id", F.col("a_id").alias("at"), F.col("a_id").alias("path"), F.lit("").alias("relations"), "b_id")
    seen = scratch.save(frontier.select("pair_id", "at"))
    arrived = []
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(edge, ["tree_id", "at"]).select("tree_id", "pair_id", F.col("to").alias("at"), F.concat_ws(">", "path", "to").alias("path"), F.concat_ws(">", F.nullif("relations", F.lit("")), "relation").alias("relations"), "b_id")
        best = nxt.groupBy("tree_id", "pair_id", "at", "b_id").agg(F.min(F.struct("path", "relations")).alias("m")).select("tree_id", "pair_id", "at", "m.path", "m.relations", "b_id")
        level = scratch.save(best.join(seen, ["pair_id", "at"], "left_anti"))
        done = level.filter("at = b_id")
        arrived.append(done.select("tree_id", "pair_id", F.lit(depth).alias("steps"), "path", "relations"))
        frontier = level.join(done.select("pair_id").distinct(), "pair_id", "left_anti")
        if frontier.isEmpty():
            break
        seen = scratch.save(seen.unionByName(frontier.select("pair_id", "at")))
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """All (tree_id, ancestor_id, descendant_id) pairs, by joining the pairs with themselves: log2 of the depth many rounds.

    Nobody is their own relative, also on a loop.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    pairs = scratch.save(edges.select("tree_id", F.col("parent_id").alias("ancestor_id"), F.col("child_id").alias("descendant_id")).distinct())
    size = pairs.count()
    while True:
        old = pairs
        further = old.select("tree_id", "ancestor_id", F.col("descendant_id").alias("mid")).join(old.select("tree_id", F.col("ancestor_id").alias("mid"), "descendant_id"), ["tree_id", "mid"]).select("tree_id", "ancestor_id", "descendant_id")
        pairs = scratch.save(old.unionByName(further).distinct())
        now = pairs.count()
        scratch.drop(old)
        if now == size:
            return pairs.filter("ancestor_id <> descendant_id")
        size = now


def closure_counts(ws: Workspace) -> DataFrame:
    """Numbers of distinct descendants of the persons without parents."""
    orphans = ws.parent.select("tree_id", F.col("parent_id").alias("ancestor_id")).distinct().join(ws.parent.select("tree_id", F.col("child_id").alias("ancestor_id")), ["tree_id", "ancestor_id"], "left_anti")
    down = closure(ws.parent).join(orphans, ["tree_id", "ancestor_id"], "left_semi")
    return down.groupBy("tree_id", F.col("ancestor_id").alias("person_id")).agg(F.count(F.lit(1)).alias("descendants"))


def validate_scope(ws: Workspace, roots: DataFrame) -> DataFrame:
    """Class of every person of the trees with a root (tree_id, root_id): BLOOD, SPOUSE, SPOUSE_PARENT or INVALID.

    Blood relatives are the root, its ancestors and all their descendants; further the
    spouses of these and the spouses' parents are in scope.
    """
    start = roots.select("tree_id", "root_id").distinct()
    kin = closure(ws.parent)
    up = kin.join(start.withColumnRenamed("root_id", "descendant_id"), ["tree_id", "descendant_id"], "left_semi").select("tree_id", F.col("ancestor_id").alias("person_id"))
    up = up.unionByName(start.select("tree_id", F.col("root_id").alias("person_id"))).distinct()
    down = kin.join(up.withColumnRenamed("person_id", "ancestor_id"), ["tree_id", "ancestor_id"], "left_semi").select("tree_id", F.col("descendant_id").alias("person_id"))
    blood = Scratch(roots.sparkSession, "scope").save(up.unionByName(down).distinct())
    spouse = spouse_edges(ws).join(blood, ["tree_id", "person_id"], "left_semi").select("tree_id", F.col("spouse_id").alias("person_id"))
    spouse_parent = ws.parent.join(spouse.withColumnRenamed("person_id", "child_id"), ["tree_id", "child_id"], "left_semi").select("tree_id", F.col("parent_id").alias("person_id"))
    rank = blood.withColumn("r", F.lit(1)).unionByName(spouse.withColumn("r", F.lit(2))).unionByName(spouse_parent.withColumn("r", F.lit(3))).groupBy("tree_id", "person_id").agg(F.min("r").alias("r"))
    people = ws.person.join(start.select("tree_id").distinct(), "tree_id", "left_semi").select("tree_id", "person_id")
    names = F.when(F.col("r") == 1, "BLOOD").when(F.col("r") == 2, "SPOUSE").when(F.col("r") == 3, "SPOUSE_PARENT").otherwise("INVALID")
    return people.join(rank, ["tree_id", "person_id"], "left").select("tree_id", "person_id", names.alias("scope"))
