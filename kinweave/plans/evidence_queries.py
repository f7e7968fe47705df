"""Queries of the evidence operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import evidence
from kinweave.operators.runtime import table
from kinweave.plans.adapters import sql, workspace


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    part = lambda word: F.regexp_extract("archive_ref", rf"(?i)\b{word}\. (\d+)", 1)
    return docs.select("source_record_id", "record_type", "text", "archive_ref", part("f").alias("fond"), part("op").alias("opis"), part("spr").alias("sprava"), F.col("record_year").cast("int").alias("year_from"), (F.col("record_year") + 5).cast("int").alias("year_to"), "created_at")


def _search(facets: evidence.Facets):
    def run(spark: SparkSession, d: str) -> DataFrame:
        # the tables hold no accepted link, so suggested ones stand for them
        mentions = table(spark, d, "record_person_mention").withColumn("status", F.when(F.col("status") == "suggested", "accepted").otherwise(F.col("status")))
        places = table(spark, d, "record_place_mention")
        return evidence.search_records(_records(spark, d), mentions, places, facets).select("source_record_id", "record_type", "year_from", "total")

    return run


FACETS = {
    "e_search_text": evidence.Facets(free_text="parish", record_type="birth", year_from=1700, year_to=1850, top=500),
    "e_search_mentions": evidence.Facets(surname="о", given_name="а", role="witness", archive_prefix="f. ", top=500),
    "e_search_place": evidence.Facets(place="ів", top=500),
    "e_search_archive": evidence.Facets(fond="8", opis="1", sprava="2", top=500),
    "e_search_linked": evidence.Facets(linked=True, top=500),
    "e_search_unlinked": evidence.Facets(linked=False, year_from=1800, top=500),
}


def e_suggest_links(spark: SparkSession, d: str) -> DataFrame:
    return evidence.suggest_links(table(spark, d, "record_person_mention"), table(spark, d, "person"))


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blobs with a signature that is accepted for four of five; equal texts are equal blobs."""
    docs = table(spark, d, "documents").filter("text is not null")
    head = F.when(F.pmod(F.length("text"), F.lit(5)) == 0, F.unhex(F.lit("3C68746D6C3E"))).otherwise(F.unhex(F.lit("255044462D")))
    return docs.select("source_record_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"), F.lit(0).alias("sequence_no"))


def e_attachment_contents(spark: SparkSession, d: str) -> DataFrame:
    return evidence.store_attachments(_blobs(spark, d), evidence.Limits(file_bytes=20_000))[0]


def e_attachment_links(spark: SparkSession, d: str) -> DataFrame:
    return evidence.store_attachments(_blobs(spark, d), evidence.Limits(file_bytes=20_000))[1]


def e_attachment_rejected(spark: SparkSession, d: str) -> DataFrame:
    return evidence.store_attachments(_blobs(spark, d), evidence.Limits(file_bytes=20_000))[2]


def e_integrity(spark: SparkSession, d: str) -> DataFrame:
    ws = workspace(spark, d)
    return evidence.integrity(ws.person, ws.name, ws.event, ws.parent)


def e_record_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the numbers of its person and place mentions."""
    m = table(spark, d, "record_person_mention").groupBy("source_record_id").agg(F.count(F.lit(1)).alias("persons"), F.count(F.when(F.col("status") == "accepted", 1)).alias("accepted"))
    p = table(spark, d, "record_place_mention").groupBy("source_record_id").agg(F.countDistinct("place_mention_id").alias("places"))
    df = _records(spark, d).select("source_record_id", "record_type").join(m, "source_record_id", "left").join(p, "source_record_id", "left")
    return df.select("source_record_id", "record_type", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("persons", "accepted", "places")])


QUERIES = {name: _search(f) for name, f in FACETS.items()} | {f.__name__: f for f in (e_suggest_links, e_attachment_contents, e_attachment_links, e_attachment_rejected, e_integrity, e_record_detail)}

_RECORDS = "r AS (SELECT source_record_id, record_type, text, archive_ref, record_year::INT AS year_from, (record_year + 5)::INT AS year_to, created_at FROM documents)"


def _found(where: str) -> str:
    return f"WITH {_RECORDS}, f AS (SELECT * FROM r WHERE {where}) SELECT source_record_id, record_type, year_from, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC NULLS LAST, source_record_id LIMIT 500"


def _mention(cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM record_person_mention m WHERE m.source_record_id = r.source_record_id AND {cond})"


_BLOB = "b AS (SELECT source_record_id, (CASE WHEN length(text) % 5 = 0 THEN '<html>' ELSE '%PDF-' END) || text AS content, length(text) % 5 <> 0 AS ok FROM documents WHERE text IS NOT NULL), x AS (SELECT *, sha256(content) AS content_hash, octet_length(encode(content))::INT AS bytes FROM b)"

ORACLE = {
    "e_search_text": _found("record_type = 'birth' AND contains(lower(text), 'parish') AND year_to >= 1700 AND year_from <= 1850"),
    "e_search_mentions": _found(f"starts_with(lower(archive_ref), 'f.') AND {_mention('''contains(lower(m.surname), 'о')''')} AND {_mention('''contains(lower(m.given_name), 'а')''')} AND {_mention('''m.role = 'witness' ''')}"),
    "e_search_place": _found("EXISTS (SELECT 1 FROM record_place_mention m WHERE m.source_record_id = r.source_record_id AND (contains(lower(m.place_text), 'ів') OR contains(lower(m.normalized_name), 'ів')))"),
    "e_search_archive": _found(r"contains(regexp_extract(archive_ref, '(?i)\bf\. (\d+)', 1), '8') AND contains(regexp_extract(archive_ref, '(?i)\bop\. (\d+)', 1), '1') AND contains(regexp_extract(archive_ref, '(?i)\bspr\. (\d+)', 1), '2')"),
    "e_search_linked": _found(_mention("m.status IN ('accepted', 'suggested')")),
    "e_search_unlinked": _found(f"year_to >= 1800 AND NOT {_mention('''m.status IN ('accepted', 'suggested') ''')}"),
    "e_suggest_links": """SELECT person_mention_id, person_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person_mention_id ORDER BY score DESC, person_id) AS rank FROM (
  SELECT m.person_mention_id, p.person_id, CAST(least(1, CASE WHEN s IS NULL OR ps IS NULL THEN 0 WHEN s = ps THEN 0.50 WHEN contains(s, ps) OR contains(ps, s) THEN 0.25 ELSE 0 END
    + CASE WHEN g IS NULL OR pg IS NULL THEN 0 WHEN g = pg THEN 0.30 WHEN contains(g, pg) OR contains(pg, g) THEN 0.15 ELSE 0 END
    + CASE WHEN abs(y - birth_year) <= 1 THEN 0.20 WHEN abs(y - birth_year) <= 3 THEN 0.10 WHEN abs(y - birth_year) <= 7 THEN 0.05 ELSE 0 END) AS DECIMAL(5, 4)) AS score
  FROM (SELECT person_mention_id, lower(trim(tree_id)) AS t, nullif(lower(trim(surname)), '') AS s, nullif(lower(trim(given_name)), '') AS g, estimated_birth_year::INT AS y FROM record_person_mention) m
  JOIN (SELECT DISTINCT person_id, lower(trim(tree_id)) AS t, nullif(lower(trim(surname_normalized)), '') AS ps, nullif(lower(trim(given_name)), '') AS pg, birth_year::INT AS birth_year FROM person) p ON p.t = m.t AND (contains(p.ps, m.s) OR contains(p.pg, m.g))
) WHERE score > 0) WHERE rank <= 10""",
    "e_attachment_contents": f"WITH {_BLOB} SELECT DISTINCT content_hash, bytes, 'application/pdf' AS mime FROM x WHERE ok AND bytes <= 20000",
    "e_attachment_links": f"WITH {_BLOB} SELECT DISTINCT source_record_id, content_hash, 0 AS sequence_no, 'document' AS attachment_type FROM x WHERE ok AND bytes <= 20000",
    "e_attachment_rejected": f"WITH {_BLOB} SELECT source_record_id, content_hash, CASE WHEN bytes > 20000 THEN 'too large' ELSE 'type not accepted' END AS reason FROM x WHERE NOT ok OR bytes > 20000",
    "e_integrity": sql("""SELECT 'name without person of its tree' AS rule, (SELECT count(*) FROM name_v n ANTI JOIN person_v p USING (tree_id, person_id)) AS violations
  UNION ALL SELECT 'event without person of its tree', (SELECT count(*) FROM event_v n ANTI JOIN person_v p USING (tree_id, person_id))
  UNION ALL SELECT 'external id twice in a tree', (SELECT count(*) FROM (SELECT 1 FROM person_v WHERE external_id IS NOT NULL GROUP BY tree_id, external_id HAVING count(*) > 1))
  UNION ALL SELECT 'several primary names', (SELECT count(*) FROM (SELECT 1 FROM name_v WHERE is_primary GROUP BY tree_id, person_id HAVING count(*) > 1))
  UNION ALL SELECT 'own parent', (SELECT count(*) FROM parent_v WHERE parent_id = child_id)
  UNION ALL SELECT 'sex outside the domain', (SELECT count(*) FROM person_v WHERE sex NOT IN ('M', 'F'))"""),
    "e_record_detail": "SELECT r.source_record_id, r.record_type, (SELECT count(*) FROM record_person_mention m WHERE m.source_record_id = r.source_record_id) AS persons, (SELECT count(*) FROM record_person_mention m WHERE m.source_record_id = r.source_record_id AND m.status = 'accepted') AS accepted, (SELECT count(DISTINCT place_mention_id) FROM record_place_mention m WHERE m.source_record_id = r.source_record_id) AS places FROM documents r",
}
