"""Tree queries: search, resolution, life events and family context, over whole trees at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.plans.adapters import Workspace

#: Event types in the order of a life; all others follow.
LIFE_ORDER = {"BIRT": 1, "BAPT": 2, "CHR": 2, "MARR": 3, "DEAT": 4, "BURI": 5}


def top1(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in the given order, as aggregate: it combines before the shuffle."""
    return df.groupBy(*by).agg(F.min(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *columns)).alias("m")).select(*by, *[f"m.{c}" for c in columns])


def nulls_last(c: Column) -> tuple[Column, Column]:
    return c.isNull(), c


def life_dates(ws: Workspace) -> DataFrame:
    """First birth (BIRT before CHR) and death of every person: tree_id, person_id, birth_year, birth_place, death_year, death_place."""
    e = ws.event.filter(F.col("event_type").isin("BIRT", "CHR", "DEAT"))
    birth = F.col("event_type") != "DEAT"
    first = lambda cond: F.min(F.when(cond, F.struct((F.col("event_type") == "CHR").alias("a"), F.col("year_from").isNull().alias("b"), "year_from", "event_id", "place_raw")))
    both = e.groupBy("tree_id", "person_id").agg(first(birth).alias("x"), first(~birth).alias("y"))
    return both.select("tree_id", "person_id", F.col("x.year_from").alias("birth_year"), F.col("x.place_raw").alias("birth_place"), F.col("y.year_from").alias("death_year"), F.col("y.place_raw").alias("death_place"))


def search_by_name(ws: Workspace, text: str) -> DataFrame:
    """Persons of any tree with a name or surname that contains the text, case aside; a blank text finds none."""
    if not text.strip():
        return ws.person.select("tree_id", "person_id", "display_name").limit(0)
    needle = F.lit(text.strip().lower())
    hit = ws.name.filter(F.lower("full_name_normalized").contains(needle) | F.lower("surname").contains(needle)).select("tree_id", "person_id")
    return ws.person.join(hit, ["tree_id", "person_id"], "left_semi").select("tree_id", "person_id", "display_name")


def resolve_tree(ws: Workspace, reference: str | None) -> DataFrame:
    """Trees that a reference may mean: an id, a name in any case, or blank for the default tree.

    The default is the tree marked ``is_default``, where trees bear that mark; else the first by id.
    """
    r = (reference or "").strip().lower()
    if not r:
        marked = [F.desc_nulls_last("is_default")] if "is_default" in ws.tree.columns else []
        return ws.tree.orderBy(*marked, "tree_id").limit(1)
    return ws.tree.filter((F.col("tree_id") == r) | (F.lower("name") == r))


def resolve_person(ws: Workspace, text: str, limit: int = 10) -> DataFrame:
    """Per tree, up to ``limit`` candidates for a name, exact ones first: tree_id, person_id, display_name, is_exact, rank."""
    needle = F.lit(text.strip().lower())
    named = ws.name.filter(F.lower("full_name_normalized").contains(needle) | F.lower("surname").contains(needle))
    exact = named.groupBy("tree_id", "person_id").agg(F.bool_or((F.lower("full_name_normalized") == needle) | (F.lower(F.coalesce("surname", F.lit(""))) == needle)).alias("is_exact"))
    rows = exact.join(ws.person.select("tree_id", "person_id", "display_name"), ["tree_id", "person_id"])
    order = W.partitionBy("tree_id").orderBy(F.desc("is_exact"), F.asc_nulls_last("display_name"), "person_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def find_persons(ws: Workspace, name: str, father: str | None = None, mother: str | None = None, child: str | None = None, spouse: str | None = None, place: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Persons with a name and, for each further facet that is given, a relative, place or birth that fits."""

    def named(text: str) -> DataFrame:
        t = F.lit(text.strip().lower())
        return ws.name.filter(F.lower("full_name_normalized").contains(t) | F.lower("surname").contains(t)).select("tree_id", "person_id").distinct()

    found = ws.person.join(named(name), ["tree_id", "person_id"], "left_semi")
    for text, sex in ((father, "M"), (mother, "F")):
        if text:
            parents = named(text).join(ws.person.filter(F.col("sex") == sex), ["tree_id", "person_id"], "left_semi").withColumnRenamed("person_id", "parent_id")
            kids = ws.parent.join(parents, ["tree_id", "parent_id"], "left_semi").select("tree_id", F.col("child_id").alias("person_id"))
            found = found.join(kids, ["tree_id", "person_id"], "left_semi")
    if child:
        parents = ws.parent.join(named(child).withColumnRenamed("person_id", "child_id"), ["tree_id", "child_id"], "left_semi")
        found = found.join(parents.select("tree_id", F.col("parent_id").alias("person_id")), ["tree_id", "person_id"], "left_semi")
    if spouse:
        pairs = spouse_edges(ws).join(named(spouse).withColumnRenamed("person_id", "spouse_id"), ["tree_id", "spouse_id"], "left_semi")
        found = found.join(pairs, ["tree_id", "person_id"], "left_semi")
    if place:
        there = ws.event.filter(F.lower("place_raw").contains(place.strip().lower()) | F.lower("place_normalized").contains(place.strip().lower()))
        found = found.join(there, ["tree_id", "person_id"], "left_semi")
    births = ws.event.filter("event_type = 'BIRT'")
    if year_from is not None:  # the bounds are independent: two birth records may each meet one
        found = found.join(births.filter(F.coalesce("year_from", "year_to") >= year_from), ["tree_id", "person_id"], "left_semi")
    if year_to is not None:
        found = found.join(births.filter(F.coalesce("year_from", "year_to") <= year_to), ["tree_id", "person_id"], "left_semi")
    return found.drop("birth_year").join(life_dates(ws), ["tree_id", "person_id"], "left").select("tree_id", "person_id", "display_name", "birth_year", "birth_place", "death_year", "death_place")


def life_events(ws: Workspace) -> DataFrame:
    """Every person's events with their place in the life's order (position, from 1)."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in LIFE_ORDER.items() for x in kv])[F.col("event_type")], F.lit(9))
    order = W.partitionBy("tree_id", "person_id").orderBy(F.coalesce("year_from", F.lit(9999).cast("short")), F.asc_nulls_last("date_from"), rank, "event_id")
    related = ws.person.select("tree_id", F.col("person_id").alias("related_id"), F.col("display_name").alias("related_name"))
    return ws.event.withColumn("position", F.row_number().over(order)).join(related, ["tree_id", "related_id"], "left").select("tree_id", "person_id", "position", "event_id", "event_type", "date_raw", "year_from", "place_raw", "related_name")


def spouse_edges(ws: Workspace) -> DataFrame:
    """Both directions of every family: tree_id, person_id, spouse_id, family_id, marriage_year, marriage_place."""
    f = ws.family
    rest = ["family_id", "marriage_year", "marriage_place"]
    return f.select("tree_id", F.col("spouse1_id").alias("person_id"), F.col("spouse2_id").alias("spouse_id"), *rest).unionByName(f.select("tree_id", F.col("spouse2_id").alias("person_id"), F.col("spouse1_id").alias("spouse_id"), *rest))


def _enriched(ws: Workspace, df: DataFrame, who: str) -> DataFrame:
    people = ws.person.select("tree_id", F.col("person_id").alias(who), F.col("display_name").alias("name"), "sex")
    return df.join(people, ["tree_id", who]).join(life_dates(ws).withColumnRenamed("person_id", who), ["tree_id", who], "left")


def rich_parents(ws: Workspace) -> DataFrame:
    """Parents of every person with births and deaths, fathers first."""
    rows = _enriched(ws, ws.parent, "parent_id")
    order = W.partitionBy("tree_id", "child_id").orderBy(F.desc_nulls_last("sex"), F.asc_nulls_last("birth_year"), "parent_id")
    return rows.withColumn("position", F.row_number().over(order)).select("tree_id", F.col("child_id").alias("person_id"), "position", "parent_id", "name", "sex", "birth_year", "birth_place", "death_year", "death_place")


def rich_siblings(ws: Workspace) -> DataFrame:
    """Other children of a shared parent, half-siblings included, each once, with births and deaths."""
    a = ws.parent.select("tree_id", "parent_id", F.col("child_id").alias("person_id"))
    b = ws.parent.select("tree_id", "parent_id", F.col("child_id").alias("sibling_id"))
    pairs = a.join(b, ["tree_id", "parent_id"]).filter("person_id <> sibling_id").select("tree_id", "person_id", "sibling_id").distinct()
    return _enriched(ws, pairs, "sibling_id").select("tree_id", "person_id", "sibling_id", "name", "sex", "birth_year", "death_year")


def sibling_counts(ws: Workspace) -> DataFrame:
    """Numbers of children per parent and of siblings per person, without listing pairs of siblings."""
    kids = ws.parent.groupBy("tree_id", "parent_id").agg(F.count(F.lit(1)).alias("children"))
    return ws.parent.join(kids, ["tree_id", "parent_id"]).groupBy("tree_id", F.col("child_id").alias("person_id")).agg(F.max(F.col("children") - 1).alias("siblings_by_one_parent"))


def rich_marriages(ws: Workspace) -> DataFrame:
    """Marriages of every person with the spouse's births and deaths."""
    return _enriched(ws, spouse_edges(ws), "spouse_id").select("tree_id", "person_id", "family_id", "spouse_id", "name", "birth_year", "death_year", "marriage_year", "marriage_place")


def rich_children(ws: Workspace) -> DataFrame:
    """Children of every person with births, deaths and the other parent (the smallest id of several)."""
    p = ws.parent
    other = p.select("tree_id", "child_id", F.col("parent_id").alias("other_id"))
    pairs = p.join(other, ["tree_id", "child_id"]).filter("parent_id <> other_id").groupBy("tree_id", "parent_id", "child_id").agg(F.min("other_id").alias("other_parent_id"))
    rows = p.join(pairs, ["tree_id", "parent_id", "child_id"], "left")
    return _enriched(ws, rows, "child_id").select("tree_id", F.col("parent_id").alias("person_id"), "child_id", "name", "sex", "birth_year", "death_year", "other_parent_id")


def family_context(ws: Workspace) -> DataFrame:
    """Parents, children and spouses of every person in one relation: tree_id, person_id, relation, relative_id, name."""
    up = ws.parent.select("tree_id", F.col("child_id").alias("person_id"), F.lit("parent").alias("relation"), F.col("parent_id").alias("relative_id"))
    down = ws.parent.select("tree_id", F.col("parent_id").alias("person_id"), F.lit("child").alias("relation"), F.col("child_id").alias("relative_id"))
    wed = spouse_edges(ws).select("tree_id", "person_id", F.lit("spouse").alias("relation"), F.col("spouse_id").alias("relative_id"))
    who = ws.person.select("tree_id", F.col("person_id").alias("relative_id"), F.col("display_name").alias("name"))
    return up.unionByName(down).unionByName(wed).join(who, ["tree_id", "relative_id"])


def person_counts(ws: Workspace) -> DataFrame:
    """Trees with their numbers of persons, trees without any included."""
    counts = ws.person.groupBy("tree_id").agg(F.count(F.lit(1)).alias("persons"))
    return ws.tree.join(counts, "tree_id", "left").select("tree_id", "name", F.coalesce("persons", F.lit(0)).cast("bigint").alias("persons"))
