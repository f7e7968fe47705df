"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.components import connected_components
from kinweave.llm.entities import matched_persons
from kinweave.llm.leaks import leaks
from kinweave.llm.places import UNMATCHED, map_values
from kinweave.llm.survivors import duplicate_values, survivors
from kinweave.llm.tokens import DEFAULT_DIRECTORY, decode_column, encode_column, encode_documents
from kinweave.llm.truncation import judged, truncation_rates
from kinweave.llm.variants import spelt_persons
from kinweave.operators.joins import counted_join
from kinweave.operators.runtime import Scratch, spread, table

VOCABULARY = f"{DEFAULT_DIRECTORY}/byte_bpe_50k.json"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivors(duplicate_values(table(spark, d, "duplicate_candidate")))
    return best.selectExpr("`group` as existing_tree_person_id", "field as field_name", "source as source_person_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "duplicate_candidate").filter(F.col("status").isin("suggested", "accepted"))
    # a row names either a second imported person or an existing one; both count should a row name two
    first = rows.select("import_tree_person_id1", "import_tree_person_id2").toDF("a", "b")
    second = rows.select("import_tree_person_id1", "existing_tree_person_id").toDF("a", "b")
    return connected_components(first.unionByName(second), "a", "b").selectExpr("id as person_id", "`group` as group_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(spread(table(spark, d, "documents").select("doc_id", "text")), VOCABULARY)


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding gives back the text, and the number of ids."""
    docs = table(spark, d, "documents")
    ids = docs.select("doc_id", "text", encode_column(docs["text"], VOCABULARY).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_ids"), (decode_column(F.col("ids"), VOCABULARY) == F.coalesce("text", F.lit(""))).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_item"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents that contain it, and its longest passage in words."""
    return p9_passages(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents")).filter("truncated").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spelt_persons(table(spark, d, "record_person_mention"), table(spark, d, "person"), table(spark, d, "person_name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("person_mention_id", "person_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their scores and confidences."""
    mentions = table(spark, d, "record_person_mention").filter("patronymic is null")
    return matched_persons(mentions, table(spark, d, "person"), table(spark, d, "person_name"))


def _place_values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(table_name, record_id, value) of the rows to map, and the mapping of their distinct values."""
    mention, event = table(spark, d, "record_place_mention"), table(spark, d, "person_event")
    rows = (
        mention.filter("place_id is null").select(F.lit("record_place_mention").alias("table_name"), F.col("place_mention_id").alias("record_id"), F.col("place_text").alias("value"))
        .unionByName(
            event.filter("place_raw is not null and place_normalized is null")
            .select(F.lit("person_event").alias("table_name"), F.col("event_id").cast("string").alias("record_id"), F.col("place_raw").alias("value"))
        )
    )
    scratch = Scratch(spark, "places")
    values = scratch.save(rows.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    places = table(spark, d, "place")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    mapped = map_values(values.repartition(tasks, "value"), places)
    return rows, scratch.save(mapped.join(values, "value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows, mapped = _place_values(spark, d)
    joined = counted_join(rows, mapped.select("value", "place_id", "n"), "value", "n")
    return joined.groupBy("table_name", "record_id").agg(F.coalesce(F.max("place_id"), F.lit(UNMATCHED)).alias("place_id"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that no entry of the list stands for, with their numbers of rows and best scores."""
    _, mapped = _place_values(spark, d)
    return mapped.filter(F.col("place_id") == UNMATCHED).select("value", F.col("n").alias("rows"), F.round("score", 4).alias("score"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p5_found, p5_unmatched, p6_found, p6_matches, p8_ids, p8_roundtrip, p9_found, p9_passages, p9_items, p10_found, p10_rates)}

ORACLE = {
    "p1_found": """
WITH used AS (
  SELECT lower(trim(existing_tree_person_id)) AS g, lower(trim(import_tree_person_id1)) AS i, import_person1_name, existing_person_name, coalesce(updated_at, created_at) AS t, events
  FROM duplicate_candidate WHERE candidate_scope = 'import_vs_tree' AND status IN ('suggested', 'accepted')
), listed AS (
  SELECT g, i, t, unnest(events) AS e FROM used
), vals AS (
  SELECT g, 'name' AS field, g AS source, 0 AS imported, t, existing_person_name AS name, NULL AS d, 0 AS extra FROM used
  UNION ALL SELECT g, 'name', i, 1, t, import_person1_name, NULL, 0 FROM used
  UNION ALL
  SELECT g, CASE e.event_type WHEN 'BIRT' THEN 'birth' ELSE 'death' END, CASE e.side WHEN 'existing' THEN g ELSE i END, CASE e.side WHEN 'existing' THEN 0 ELSE 1 END, t, NULL, lower(trim(coalesce(e.date_raw, ''))),
    CASE WHEN trim(coalesce(e.place_raw, '')) <> '' THEN 2 ELSE 0 END + CASE WHEN e.has_source_citation THEN 1 ELSE 0 END
  FROM listed WHERE e.event_type IN ('BIRT', 'DEAT')
), ranked AS (
  SELECT g, field, source, imported, t,
    CASE WHEN field = 'name' THEN
      CASE WHEN regexp_full_match(trim(name), '[^\\s,?.\\[\\]]{3,},?\\s+[^\\s,?.\\[\\]]{3,}\\s+[^\\s,?.\\[\\]]{3,}') THEN 1 ELSE 0 END
    ELSE extra + 4 * CASE
      WHEN regexp_full_match(d, '\\d{3,4}-\\d\\d?-\\d\\d?|\\d\\d?[./]\\d\\d?[./]\\d{3,4}|\\d\\d? +\\p{L}{3,} +\\d{3,4}') THEN 3
      WHEN regexp_full_match(d, '\\d{3,4}-\\d\\d?') OR (regexp_full_match(d, '\\p{L}{3,} +\\d{3,4}') AND NOT regexp_matches(d, '^(abt|bef|aft|est|cal|about|before|after|circa) ')) THEN 2
      WHEN regexp_full_match(d, '\\d{3,4}') THEN 1 ELSE 0 END
    END AS quality
  FROM vals
)
SELECT g AS existing_tree_person_id, field AS field_name, source AS source_person_id FROM (
  SELECT *, row_number() OVER (PARTITION BY g, field ORDER BY quality DESC, imported, t DESC, source) AS rn FROM ranked WHERE g IS NOT NULL
) WHERE rn = 1
""",
    "p3_found": """
WITH RECURSIVE used AS (
  SELECT lower(trim(import_tree_person_id1)) AS a, lower(trim(import_tree_person_id2)) AS b, lower(trim(existing_tree_person_id)) AS c
  FROM duplicate_candidate WHERE status IN ('suggested', 'accepted')
), ids AS (
  SELECT DISTINCT v FROM (SELECT a AS v FROM used UNION ALL SELECT b FROM used UNION ALL SELECT c FROM used) WHERE v IS NOT NULL AND v <> ''
), links AS (
  SELECT a AS s, b AS t FROM used WHERE b IS NOT NULL UNION SELECT b, a FROM used WHERE b IS NOT NULL
  UNION SELECT a, c FROM used WHERE c IS NOT NULL UNION SELECT c, a FROM used WHERE c IS NOT NULL
), reach AS (
  SELECT v, v AS g FROM ids UNION SELECT l.t, r.g FROM reach r JOIN links l ON l.s = r.v
)
SELECT v AS person_id, min(g) AS group_id FROM reach GROUP BY v
""",
}
