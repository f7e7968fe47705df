"""The tables of a workspace, derived from the stored tables, and the same derivations in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.runtime import table


def _id(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


@dataclass(frozen=True)
class Workspace:
    tree: DataFrame
    person: DataFrame
    name: DataFrame
    event: DataFrame
    parent: DataFrame
    family: DataFrame
    place: DataFrame


def workspace(spark: SparkSession, d: str) -> Workspace:
    """Trees, persons, names, events (once each), parent edges, families and places."""
    person = table(spark, d, "person").select(_id("tree_id").alias("tree_id"), _id("person_id").alias("person_id"), "external_id", "sex", "is_living", F.col("primary_display_name").alias("display_name"), "surname_normalized", "given_name", "birth_year")
    name = table(spark, d, "person_name").select("person_name_id", _id("tree_id").alias("tree_id"), _id("person_id").alias("person_id"), "script_code", "name_type", "given", "surname", "full_name", "full_name_normalized", "is_primary")
    raw = table(spark, d, "person_event").select(
        "event_id", "external_event_key", _id("tree_id").alias("tree_id"), _id("person_id").alias("person_id"), "event_type", "event_value", "date_raw", "date_from", "date_to", "year_from", "year_to",
        "place_raw", "place_normalized", _id("related_person_id").alias("related_id"), "is_derived",
    )
    event = raw.dropDuplicates(["event_id"])
    known = person.select("tree_id", "person_id")
    exported = table(spark, d, "descendant_row").select(_id("tree_id").alias("tree_id"), _id("parent_person_id").alias("parent_id"), _id("person_id").alias("child_id"))
    born = raw.filter("event_type = 'CHILD_BIRTH'").select("tree_id", F.col("person_id").alias("parent_id"), F.col("related_id").alias("child_id"))
    edge = exported.unionByName(born).filter("parent_id is not null and child_id is not null and parent_id <> child_id").distinct()
    edge = edge.join(known.withColumnRenamed("person_id", "parent_id"), ["tree_id", "parent_id"], "left_semi").join(known.withColumnRenamed("person_id", "child_id"), ["tree_id", "child_id"], "left_semi")
    wed = raw.filter("event_type = 'MARR' and related_id is not null and related_id <> person_id").select(
        "tree_id", F.least("person_id", "related_id").alias("spouse1_id"), F.greatest("person_id", "related_id").alias("spouse2_id"), "date_raw", "year_from", "place_raw"
    )
    family = wed.groupBy("tree_id", "spouse1_id", "spouse2_id").agg(F.min("date_raw").alias("marriage_date_raw"), F.min("year_from").alias("marriage_year"), F.min("place_raw").alias("marriage_place"))
    family = family.join(known.withColumnRenamed("person_id", "spouse1_id"), ["tree_id", "spouse1_id"], "left_semi").join(known.withColumnRenamed("person_id", "spouse2_id"), ["tree_id", "spouse2_id"], "left_semi")
    family = family.withColumn("family_id", F.concat_ws("+", "spouse1_id", "spouse2_id"))
    batch = table(spark, d, "gedcom_import_batch")
    tree = batch.filter("tree_id is not null").groupBy(_id("tree_id").alias("tree_id")).agg(F.min("tree_name").alias("name"))
    place = table(spark, d, "place")
    return Workspace(tree, person, name, event, edge, family, place)


VIEWS = """
person_v AS (
  SELECT lower(trim(tree_id)) AS tree_id, lower(trim(person_id)) AS person_id, external_id, sex, is_living, primary_display_name AS display_name, surname_normalized, given_name, birth_year FROM person
), name_v AS (
  SELECT person_name_id, lower(trim(tree_id)) AS tree_id, lower(trim(person_id)) AS person_id, script_code, name_type, given, surname, full_name, full_name_normalized, is_primary FROM person_name
), raw_v AS (
  SELECT event_id, external_event_key, lower(trim(tree_id)) AS tree_id, lower(trim(person_id)) AS person_id, event_type, event_value, date_raw, date_from, date_to, year_from, year_to, place_raw, place_normalized, lower(trim(related_person_id)) AS related_id, is_derived FROM person_event
), event_v AS (
  SELECT DISTINCT * FROM raw_v
), parent_v AS (
  SELECT DISTINCT e.* FROM (
    SELECT lower(trim(tree_id)) AS tree_id, lower(trim(parent_person_id)) AS parent_id, lower(trim(person_id)) AS child_id FROM descendant_row
    UNION ALL SELECT tree_id, person_id, related_id FROM raw_v WHERE event_type = 'CHILD_BIRTH'
  ) e JOIN person_v a ON a.tree_id = e.tree_id AND a.person_id = e.parent_id JOIN person_v b ON b.tree_id = e.tree_id AND b.person_id = e.child_id WHERE parent_id <> child_id
), family_v AS (
  SELECT f.*, spouse1_id || '+' || spouse2_id AS family_id FROM (
    SELECT tree_id, least(person_id, related_id) AS spouse1_id, greatest(person_id, related_id) AS spouse2_id, min(date_raw) AS marriage_date_raw, min(year_from) AS marriage_year, min(place_raw) AS marriage_place
    FROM raw_v WHERE event_type = 'MARR' AND related_id IS NOT NULL AND related_id <> person_id GROUP BY ALL
  ) f JOIN person_v a ON a.tree_id = f.tree_id AND a.person_id = f.spouse1_id JOIN person_v b ON b.tree_id = f.tree_id AND b.person_id = f.spouse2_id
), tree_v AS (
  SELECT lower(trim(tree_id)) AS tree_id, min(tree_name) AS name FROM gedcom_import_batch WHERE tree_id IS NOT NULL GROUP BY 1
)
"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """A statement over the views, with further common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([VIEWS, *ctes])} {body}"
