"""Queries of the import operators with their SQL.

The stored tables are one side; the other is derived from them by arithmetic on ids, so
that both engines see additions, changes and omissions of every kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import imports
from kinweave.operators.imports import Snapshot
from kinweave.operators.runtime import table
from kinweave.plans.adapters import sql, workspace

_EVENT = ["tree_id", "person_id", "event_key", "event_type", "event_value", "date_raw", "date_from", "date_to", "year_from", "year_to", "place_raw", "place_normalized", "related_id", "is_derived", "family_id", "row_id"]


def snapshots(spark: SparkSession, d: str) -> tuple[Snapshot, Snapshot]:
    """The stored snapshot and a staged one that differs from it."""
    ws = workspace(spark, d)
    last = lambda c: F.substring(c, -1, 1)
    events = ws.event.withColumnRenamed("external_event_key", "event_key").withColumns({"family_id": F.lit(None).cast("string"), "row_id": F.col("event_id").cast("string")})
    ref = lambda m: F.concat(F.lit("S"), F.pmod("event_id", F.lit(m)).cast("string")).alias("source_ref")
    origin = F.when(F.expr("event_id % 2 = 0"), imports.GEDCOM).otherwise("MANUAL").alias("source_origin")
    cited = lambda e, o, m: e.filter("event_id % 3 = 0 and event_key is not null").select("tree_id", "person_id", "event_key", o, ref(m))
    child = lambda c: ws.parent.select("tree_id", F.col("parent_id").alias(c), F.col("child_id"))
    children = ws.family.join(child("spouse1_id"), ["tree_id", "spouse1_id"]).join(child("spouse2_id"), ["tree_id", "spouse2_id", "child_id"]).select("tree_id", "family_id", "child_id")
    parent = ws.parent.withColumn("relation_type", F.lit("BIOLOGICAL"))
    stored = Snapshot(ws.person, ws.name, parent, ws.family, events.select(*_EVENT), ws.place, cited(events, origin, 7), children)
    kept = ws.person.filter(last("person_id") != "0").withColumn("display_name", F.when(last("person_id") == "1", F.concat("display_name", F.lit(" *"))).otherwise(F.col("display_name")))
    fresh = lambda df: df.filter(last("person_id") == "2").withColumn("person_id", F.concat(F.lit("new-"), "person_id"))
    person = kept.unionByName(fresh(ws.person))
    name = ws.name.filter(last("person_id") != "0").unionByName(fresh(ws.name))
    family = ws.family.filter(last("spouse1_id") != "4").withColumn("marriage_year", F.when(last("spouse1_id") == "5", F.col("marriage_year") + 1).otherwise(F.col("marriage_year")))
    base = events.filter("event_id % 11 <> 0").withColumns({
        "place_raw": F.when(F.expr("event_id % 13 = 0"), F.concat(F.lit("Новий, "), "place_raw")).otherwise(F.col("place_raw")),
        "event_type": F.when(F.expr("event_id % 17 = 0 and event_type = 'BIRT'"), "CHR").otherwise(F.col("event_type")),
        "is_derived": F.when(F.expr("event_id % 23 = 0 and event_type = 'MARR'"), F.lit(True)).otherwise(F.col("is_derived")),
    })
    extra = events.filter("event_id % 19 = 0").withColumns({"event_key": F.concat(F.lit("new-"), "row_id"), "row_id": F.concat(F.lit("new-"), "row_id"), "date_raw": F.lit("1 JAN 1900"), "year_from": F.lit(1900).cast("short"), "year_to": F.lit(1900).cast("short")})
    event = base.unionByName(extra)
    place = event.filter("place_raw is not null").select("place_raw").distinct()
    edges = parent.filter(last("child_id") != "3").withColumn("relation_type", F.when(last("child_id") == "7", "ADOPTED").otherwise(F.col("relation_type")))
    theirs = children.filter(last("child_id") != "6").unionByName(children.filter(last("child_id") == "2").withColumn("child_id", F.concat(F.lit("new-"), "child_id")))
    parsed = name.select("tree_id", "person_id", "given", "surname", "full_name_normalized", F.when(F.col("surname").isNull(), "NEEDS_REVIEW").otherwise("OK").alias("parser_status"), F.when(F.col("name_type") == "alias", 0.5).otherwise(0.9).alias("confidence"))
    staged = Snapshot(person, name, edges, family, event.select(*_EVENT), place, cited(event, F.lit(imports.GEDCOM).alias("source_origin"), 5), theirs, parsed)
    return stored, staged


def c_preview(spark: SparkSession, d: str) -> DataFrame:
    return imports.preview(*snapshots(spark, d))


def c_preview_samples(spark: SparkSession, d: str) -> DataFrame:
    return imports.preview_samples(*snapshots(spark, d))


def c_duplicates_within(spark: SparkSession, d: str) -> DataFrame:
    return imports.duplicates(snapshots(spark, d)[1])


def c_duplicates_vs_tree(spark: SparkSession, d: str) -> DataFrame:
    stored, staged = snapshots(spark, d)
    return imports.duplicates(staged, stored)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "duplicate_candidate")


def c_candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    return imports.candidate_summary(_candidates(spark, d))


def c_candidate_list(spark: SparkSession, d: str) -> DataFrame:
    return imports.candidate_list(_candidates(spark, d))


def c_candidate_events(spark: SparkSession, d: str) -> DataFrame:
    return imports.candidate_events(_candidates(spark, d)).select("duplicate_candidate_id", "position", "side", "event_type", "date_raw", "place_raw", "has_source_citation")


def c_candidate_relatives(spark: SparkSession, d: str) -> DataFrame:
    ws = workspace(spark, d)
    return imports.candidate_relatives(_candidates(spark, d), ws.parent, ws.family, ws.person, "existing_tree_person_id", "existing")


def _gate_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names and date warnings per batch, as the proposals show them: doubtful names, and dates with a word before them."""
    once = _candidates(spark, d).dropDuplicates(["duplicate_candidate_id"])
    names = once.filter("import_person1_name is not null").select("import_batch_id", F.when(F.col("import_person1_name").rlike(r"[.?\[]"), "NEEDS_REVIEW").otherwise("OK").alias("parser_status"))
    warnings = once.select("import_batch_id", F.explode("events").alias("e")).filter(F.upper("e.date_raw").rlike("^(ABT|BEF|AFT|BET|EST|CAL|FROM|TO) ")).select("import_batch_id")
    return names, warnings


def c_readiness(spark: SparkSession, d: str) -> DataFrame:
    return imports.readiness(table(spark, d, "gedcom_import_batch"), _candidates(spark, d), *_gate_inputs(spark, d))


def c_readiness_report(spark: SparkSession, d: str) -> DataFrame:
    return imports.readiness_report(table(spark, d, "gedcom_import_batch"), _candidates(spark, d), *_gate_inputs(spark, d))


def c_pending(spark: SparkSession, d: str) -> DataFrame:
    return imports.pending(table(spark, d, "gedcom_import_batch"), _candidates(spark, d))


def c_cancel(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "gedcom_import_batch")
    failed = batches.filter("scope_invalid_count > 0")
    return imports.cancel(batches, failed, "out of scope").select("import_batch_id", "status", "notes")


def c_suppress_rejected(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return imports.suppress_rejected(c, c).select("duplicate_candidate_id")


def c_apply(spark: SparkSession, d: str) -> DataFrame:
    return imports.apply_import(*snapshots(spark, d))[1]


def c_apply_delete_missing(spark: SparkSession, d: str) -> DataFrame:
    return imports.apply_import(*snapshots(spark, d), delete_missing=True)[1]


def c_apply_persons(spark: SparkSession, d: str) -> DataFrame:
    return imports.apply_import(*snapshots(spark, d))[0].person


def c_apply_events(spark: SparkSession, d: str) -> DataFrame:
    return imports.apply_import(*snapshots(spark, d))[0].event


def c_apply_citations(spark: SparkSession, d: str) -> DataFrame:
    return imports.apply_import(*snapshots(spark, d))[0].citation


def c_apply_kept_events(spark: SparkSession, d: str) -> DataFrame:
    """Events after an import that deletes what it lacks."""
    return imports.apply_import(*snapshots(spark, d), delete_missing=True)[0].event.select("tree_id", "person_id", "row_id", "event_type", "related_id")


QUERIES = {
    f.__name__: f
    for f in (
        c_preview, c_preview_samples, c_duplicates_within, c_duplicates_vs_tree, c_candidate_summary, c_candidate_list, c_candidate_events, c_candidate_relatives, c_readiness, c_pending, c_cancel, c_readiness_report, c_suppress_rejected, c_apply, c_apply_delete_missing, c_apply_persons, c_apply_events, c_apply_citations, c_apply_kept_events,
    )
}

_STAGED = """
e0 AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS row_id, tree_id, person_id, external_event_key AS event_key, event_type, event_value, date_raw, date_from, date_to, year_from, year_to, place_raw, place_normalized, related_id, is_derived FROM event_v
), sp AS (
  SELECT tree_id, person_id, external_id, sex, is_living, CASE WHEN person_id[-1] = '1' THEN display_name || ' *' ELSE display_name END AS display_name, surname_normalized, given_name, birth_year FROM person_v WHERE person_id[-1] <> '0'
  UNION ALL SELECT tree_id, 'new-' || person_id, external_id, sex, is_living, display_name, surname_normalized, given_name, birth_year FROM person_v WHERE person_id[-1] = '2'
), sn AS (
  SELECT tree_id, person_id, script_code, name_type, given, surname, full_name_normalized FROM name_v WHERE person_id[-1] <> '0'
  UNION ALL SELECT tree_id, 'new-' || person_id, script_code, name_type, given, surname, full_name_normalized FROM name_v WHERE person_id[-1] = '2'
), tpar AS (
  SELECT *, 'BIOLOGICAL' AS relation_type FROM parent_v
), spar AS (
  SELECT *, CASE WHEN child_id[-1] = '7' THEN 'ADOPTED' ELSE 'BIOLOGICAL' END AS relation_type FROM parent_v WHERE child_id[-1] <> '3'
), fc AS (
  SELECT f.tree_id, f.family_id, a.child_id FROM family_v f JOIN parent_v a ON a.tree_id = f.tree_id AND a.parent_id = f.spouse1_id JOIN parent_v b ON b.tree_id = f.tree_id AND b.parent_id = f.spouse2_id AND b.child_id = a.child_id
), sfc AS (
  SELECT * FROM fc WHERE child_id[-1] <> '6' UNION ALL SELECT tree_id, family_id, 'new-' || child_id FROM fc WHERE child_id[-1] = '2'
), sf AS (
  SELECT tree_id, family_id, spouse1_id, spouse2_id, marriage_date_raw, CASE WHEN spouse1_id[-1] = '5' THEN marriage_year + 1 ELSE marriage_year END AS marriage_year, marriage_place FROM family_v WHERE spouse1_id[-1] <> '4'
), se AS (
  SELECT event_id, row_id, tree_id, person_id, event_key, CASE WHEN event_id % 17 = 0 AND event_type = 'BIRT' THEN 'CHR' ELSE event_type END AS event_type, event_value, date_raw, date_from, date_to, year_from, year_to,
    CASE WHEN event_id % 13 = 0 THEN 'Новий, ' || place_raw ELSE place_raw END AS place_raw, place_normalized, related_id, CASE WHEN event_id % 23 = 0 AND event_type = 'MARR' THEN true ELSE is_derived END AS is_derived
  FROM e0 WHERE event_id % 11 <> 0
  UNION ALL SELECT event_id, 'new-' || row_id, tree_id, person_id, 'new-' || row_id, event_type, event_value, '1 JAN 1900', date_from, date_to, 1900, 1900, place_raw, place_normalized, related_id, is_derived FROM e0 WHERE event_id % 19 = 0
)"""
_BLANK = """
  SELECT x.row_id, x.tree_id, x.person_id, x.event_key, x.event_type, x.is_derived, coalesce(x.event_value, '') AS v, coalesce(x.date_raw, '') AS dr, coalesce(x.year_from, -32768) AS yf, coalesce(x.year_to, -32768) AS yt,
    coalesce(p.place_id, -1) AS pl, coalesce(x.place_raw, '') AS pt, coalesce(x.related_id, '') AS rel FROM {} x LEFT JOIN place p ON p.place_raw = x.place_raw"""
_SAME = "t.tree_id = s.tree_id AND t.person_id = s.person_id AND t.v = s.v AND t.dr = s.dr AND t.yf = s.yf AND t.yt = s.yt"


def _known(outer: str, inner: str, place: str) -> str:
    f = f"SELECT 1 FROM {inner}"
    return f"""EXISTS ({f} WHERE t.tree_id = s.tree_id AND t.person_id = s.person_id AND t.event_key = s.event_key)
    OR EXISTS ({f} WHERE t.event_key IS NULL AND {_SAME} AND t.event_type = s.event_type AND t.{place} = s.{place} AND t.rel = s.rel AND t.is_derived = s.is_derived)
    OR EXISTS ({f} WHERE t.event_key IS NULL AND {_SAME} AND s.event_type = 'MARR' AND s.is_derived AND t.event_type = 'MARR' AND NOT t.is_derived AND t.{place} = s.{place})
    OR EXISTS ({f} WHERE t.event_key IS NULL AND {_SAME} AND s.event_type = 'CHR' AND t.event_type = 'BIRT' AND NOT t.is_derived AND t.{place} = s.{place})
    OR EXISTS ({f} WHERE t.event_key IS NULL AND {_SAME} AND s.event_type = 'DEAT' AND t.event_type = 'DEAT' AND t.is_derived = s.is_derived)"""


_DUPS = """
SELECT tree_id, id1, id2, score, name_score, date_score, place_score, family_score, event_score, negative_score, evidence_for, evidence_against, CASE WHEN score >= 0.90 THEN 'review_high_confidence' ELSE 'review' END AS recommended_action FROM (
  SELECT *, CAST(greatest(0, least(1, 0.75 * name_score + 0.15 * date_score + 0.10 * place_score - negative_score)) AS DECIMAL(6, 4)) AS score FROM (
    SELECT a.tree_id, a.person_id AS id1, b.person_id AS id2, a.f AS f1, b.f AS f2, a.g AS g1, a.s AS s1, b.g AS g2, b.s AS s2,
      CAST(CASE WHEN a.f = b.f THEN 1 ELSE 0.82 END AS DECIMAL(6, 4)) AS name_score,
      CAST(CASE WHEN a.y IS NULL OR b.y IS NULL THEN 0.5 WHEN abs(a.y - b.y) <= 1 THEN 1 WHEN abs(a.y - b.y) <= 5 THEN 0.75 ELSE 0 END AS DECIMAL(6, 4)) AS date_score,
      CAST(CASE WHEN a.bp IS NULL OR b.bp IS NULL THEN 0.5 WHEN a.bp = b.bp THEN 1 ELSE 0.25 END AS DECIMAL(6, 4)) AS place_score,
      CAST(0 AS DECIMAL(6, 4)) AS family_score, CAST(CASE WHEN v.agree = 1 THEN 1 ELSE 0 END AS DECIMAL(6, 4)) AS event_score,
      CAST(CASE WHEN a.sex <> b.sex THEN 0.35 ELSE 0 END + CASE WHEN abs(a.y - b.y) > 10 THEN 0.35 ELSE 0 END + CASE WHEN v.conflict = 1 THEN 1 ELSE 0 END AS DECIMAL(6, 4)) AS negative_score,
      nullif(concat_ws('; ', CASE WHEN a.f = b.f THEN 'exact normalized full name: ' || a.f END, CASE WHEN a.f <> b.f THEN concat('{alike}', a.g, ' ', a.s) END, CASE WHEN abs(a.y - b.y) <= 5 THEN 'birth years compatible: ' || a.y || ' vs ' || b.y END,
        CASE WHEN a.bp = b.bp THEN 'birth place matches: ' || a.bp END, CASE WHEN a.parents = 0 THEN '{left}' END, CASE WHEN b.parents = 0 THEN '{right}' END, v.pro), '') AS evidence_for,
      nullif(concat_ws('; ', CASE WHEN a.sex <> b.sex THEN 'sex differs: ' || a.sex || ' vs ' || b.sex END, CASE WHEN abs(a.y - b.y) > 10 THEN 'birth years differ: ' || a.y || ' vs ' || b.y END, CASE WHEN a.bp <> b.bp THEN 'birth places differ: ' || a.bp || ' vs ' || b.bp END, v.contra), '') AS evidence_against
    FROM life_s a JOIN {other} b ON a.tree_id = b.tree_id AND a.person_id {apart} b.person_id AND (a.f = b.f OR (a.g <> '' AND a.s <> '' AND a.g = b.g AND a.s = b.s)) AND (a.parents = 0 OR b.parents = 0)
    LEFT JOIN (
      SELECT x.tree_id, x.person_id AS p1, y.person_id AS p2, max(CASE WHEN x.k <> y.k OR (x.k IS NULL AND y.k IS NULL AND x.t <> y.t) THEN 1 ELSE 0 END) AS conflict, max(CASE WHEN x.k = y.k OR x.t = y.t THEN 1 ELSE 0 END) AS agree,
        min(CASE WHEN x.k <> y.k OR (x.k IS NULL AND y.k IS NULL AND x.t <> y.t) THEN 'source-backed ' || x.event_type || ' dates differ: ' || x.d || ' vs ' || y.d END) AS contra,
        min(CASE WHEN x.k = y.k THEN 'source-backed ' || x.event_type || ' date range matches: ' || x.d WHEN x.t = y.t THEN 'source-backed ' || x.event_type || ' date matches exactly: ' || x.d END) AS pro
      FROM cited_s x JOIN {sourced} y ON y.tree_id = x.tree_id AND y.event_type = x.event_type GROUP BY ALL
    ) v ON v.tree_id = a.tree_id AND v.p1 = a.person_id AND v.p2 = b.person_id
  )
) WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY tree_id, id1, id2 ORDER BY score DESC, name_score DESC, date_score DESC, place_score DESC, f1, f2, g1 NULLS FIRST, s1 NULLS FIRST, g2 NULLS FIRST, s2 NULLS FIRST) = 1
"""


def _life(name: str, names: str, person: str, event: str, parent: str) -> str:
    return f"""{name} AS (
  SELECT n.*, p.sex, l.y, l.bp, coalesce(h.parents, 0) AS parents FROM (SELECT DISTINCT tree_id, person_id, full_name_normalized AS f, given AS g, surname AS s FROM {names}) n
  JOIN {person} p USING (tree_id, person_id) LEFT JOIN (SELECT tree_id, person_id, min(coalesce(year_from, year_to)) AS y, min(place_normalized) AS bp FROM {event} WHERE event_type IN ('BIRT', 'CHR') GROUP BY ALL) l USING (tree_id, person_id)
  LEFT JOIN (SELECT tree_id, child_id AS person_id, count(DISTINCT parent_id) AS parents FROM {parent} GROUP BY ALL) h USING (tree_id, person_id)
)"""


def _cited(name: str, event: str) -> str:
    return f"""{name} AS (
  SELECT tree_id, person_id, event_type, CASE WHEN date_from IS NOT NULL OR date_to IS NOT NULL THEN concat(strftime(date_from, '%Y-%m-%d'), '|', strftime(date_to, '%Y-%m-%d')) END AS k, lower(trim(date_raw)) AS t, min(date_raw) AS d
  FROM {event} WHERE event_id % 3 = 0 AND event_key IS NOT NULL AND event_type IN ('BIRT', 'CHR', 'DEAT') AND NOT is_derived AND trim(coalesce(date_raw, '')) <> '' GROUP BY ALL
)"""


_PARSED = "good AS (SELECT * FROM sn WHERE surname IS NOT NULL AND name_type IS DISTINCT FROM 'alias' AND full_name_normalized <> '')"
_LIFE_S = (_PARSED, _life("life_s", "good", "sp", "se", "spar"), _cited("cited_s", "se"))

#: The result of an import, and the stored side that it applies to (t_...), with or without what the import lacks.
_KEEP_ALL = "tp AS (SELECT * FROM person_v), tn AS (SELECT * FROM name_v), tf AS (SELECT * FROM family_v), te AS (SELECT * FROM e0), tc AS (SELECT * FROM fc), tq AS (SELECT * FROM tpar), gone AS (SELECT '' AS entity, 0 AS rows WHERE false)"
_DELETE = """
mp AS (SELECT tree_id, person_id FROM person_v ANTI JOIN sp USING (tree_id, person_id) WHERE tree_id IN (SELECT tree_id FROM sp)),
mf AS (SELECT f.tree_id, f.family_id FROM family_v f WHERE f.tree_id IN (SELECT tree_id FROM sp) AND (NOT EXISTS (SELECT 1 FROM sf s WHERE s.tree_id = f.tree_id AND s.family_id = f.family_id) OR EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = f.tree_id AND mp.person_id IN (f.spouse1_id, f.spouse2_id)))),
tp AS (SELECT * FROM person_v ANTI JOIN mp USING (tree_id, person_id)), tn AS (SELECT * FROM name_v ANTI JOIN mp USING (tree_id, person_id)), tf AS (SELECT * FROM family_v ANTI JOIN mf USING (tree_id, family_id)),
te AS (SELECT * FROM e0 e WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = e.tree_id AND mp.person_id = e.person_id) AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = e.tree_id AND mp.person_id = e.related_id)),
tc AS (SELECT * FROM fc c WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = c.tree_id AND mp.person_id = c.child_id) AND NOT EXISTS (SELECT 1 FROM mf WHERE mf.tree_id = c.tree_id AND mf.family_id = c.family_id)),
tq AS (SELECT * FROM tpar q WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = q.tree_id AND mp.person_id = q.child_id) AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.tree_id = q.tree_id AND mp.person_id = q.parent_id)),
gone AS (
  SELECT 'Person' AS entity, (SELECT count(*) FROM person_v) - (SELECT count(*) FROM tp) AS rows UNION ALL SELECT 'PersonName', (SELECT count(*) FROM name_v) - (SELECT count(*) FROM tn) UNION ALL SELECT 'Family', (SELECT count(*) FROM family_v) - (SELECT count(*) FROM tf)
  UNION ALL SELECT 'Event', (SELECT count(*) FROM e0) - (SELECT count(*) FROM te) UNION ALL SELECT 'FamilyChild', (SELECT count(*) FROM fc) - (SELECT count(*) FROM tc) UNION ALL SELECT 'ParentOf', (SELECT count(*) FROM tpar) - (SELECT count(*) FROM tq)
)"""
_APPLY = """
rp AS (SELECT tree_id, person_id FROM tp UNION SELECT tree_id, person_id FROM sp),
okf AS (SELECT * FROM sf SEMI JOIN (SELECT tree_id, person_id AS spouse1_id FROM rp) USING (tree_id, spouse1_id) SEMI JOIN (SELECT tree_id, person_id AS spouse2_id FROM rp) USING (tree_id, spouse2_id)),
rf AS (SELECT tree_id, family_id FROM tf UNION SELECT tree_id, family_id FROM okf),
es AS (SELECT s.* REPLACE (CASE WHEN r.person_id IS NOT NULL THEN s.related_id END AS related_id), s.related_id AS raw_related FROM se s JOIN rp o ON o.tree_id = s.tree_id AND o.person_id = s.person_id LEFT JOIN rp r ON r.tree_id = s.tree_id AND r.person_id = s.related_id),
upd AS (SELECT * FROM es WHERE event_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tree_id, person_id, event_key ORDER BY row_id) = 1),
met AS (SELECT t.row_id, s.* EXCLUDE (row_id) REPLACE (CASE WHEN s.raw_related IS NOT DISTINCT FROM t.related_id THEN t.related_id ELSE s.related_id END AS related_id)
  FROM te t JOIN upd s ON s.tree_id = t.tree_id AND s.person_id = t.person_id AND s.event_key = t.event_key),
hit AS (SELECT s.*, (t.event_type, t.event_value, t.date_raw, t.date_from, t.date_to, t.year_from, t.year_to, t.place_raw, t.related_id, t.is_derived) IS DISTINCT FROM (s.event_type, s.event_value, s.date_raw, s.date_from, s.date_to, s.year_from, s.year_to, s.place_raw, s.related_id, s.is_derived) AS changed
  FROM te t JOIN met s ON s.row_id = t.row_id),
fresh AS (
  SELECT * FROM es WHERE event_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM te WHERE te.tree_id = es.tree_id AND te.person_id = es.person_id AND te.event_key = es.event_key)
  UNION ALL SELECT es.* FROM es ANTI JOIN te t ON t.event_key IS NULL AND t.tree_id = es.tree_id AND t.person_id = es.person_id AND (t.related_id IS NOT DISTINCT FROM es.related_id OR t.related_id IS NOT DISTINCT FROM es.raw_related)
    AND (t.event_type, t.event_value, t.date_raw, t.date_from, t.date_to, t.year_from, t.year_to, t.place_raw, t.is_derived) IS NOT DISTINCT FROM (es.event_type, es.event_value, es.date_raw, es.date_from, es.date_to, es.year_from, es.year_to, es.place_raw, es.is_derived)
  WHERE es.event_key IS NULL
),
re AS (
  SELECT t.tree_id, t.person_id, t.event_key, t.row_id, t.place_normalized, coalesce(h.event_type, t.event_type) AS event_type, CASE WHEN h.row_id IS NULL THEN t.event_value ELSE h.event_value END AS event_value, CASE WHEN h.row_id IS NULL THEN t.date_raw ELSE h.date_raw END AS date_raw,
    CASE WHEN h.row_id IS NULL THEN t.date_from ELSE h.date_from END AS date_from, CASE WHEN h.row_id IS NULL THEN t.date_to ELSE h.date_to END AS date_to, CASE WHEN h.row_id IS NULL THEN t.year_from ELSE h.year_from END AS year_from, CASE WHEN h.row_id IS NULL THEN t.year_to ELSE h.year_to END AS year_to,
    CASE WHEN h.row_id IS NULL THEN t.place_raw ELSE h.place_raw END AS place_raw, CASE WHEN h.row_id IS NULL THEN t.related_id ELSE h.related_id END AS related_id, CASE WHEN h.row_id IS NULL THEN t.is_derived ELSE h.is_derived END AS is_derived
  FROM te t LEFT JOIN hit h ON h.row_id = t.row_id
  UNION ALL SELECT tree_id, person_id, event_key, row_id, place_normalized, event_type, event_value, date_raw, date_from, date_to, year_from, year_to, place_raw, related_id, is_derived FROM fresh
),
made AS (
  SELECT tree_id, person_id, event_key, 'GEDCOM' AS source_origin, 'S' || event_id % 5 AS source_ref FROM se SEMI JOIN re USING (tree_id, person_id, event_key) WHERE event_id % 3 = 0 AND event_key IS NOT NULL
)"""
_CHANGES = """SELECT entity, change, rows FROM (
  SELECT entity, 'DELETE' AS change, rows FROM gone
  UNION ALL SELECT 'Person', 'ADD', count(*) FROM sp ANTI JOIN tp USING (tree_id, person_id)
  UNION ALL SELECT 'Person', 'UPDATE', count(*) FROM sp s JOIN tp t USING (tree_id, person_id) WHERE (s.external_id, s.sex, s.is_living, s.display_name, s.surname_normalized) IS DISTINCT FROM (t.external_id, t.sex, t.is_living, t.display_name, t.surname_normalized)
  UNION ALL SELECT 'Place', 'ADD', count(DISTINCT place_raw) FROM se ANTI JOIN place USING (place_raw) WHERE place_raw IS NOT NULL
  UNION ALL SELECT 'PersonName', 'ADD', count(*) FROM (SELECT DISTINCT tree_id, person_id, script_code, full_name_normalized FROM sn SEMI JOIN rp USING (tree_id, person_id) ANTI JOIN tn USING (tree_id, person_id, script_code, full_name_normalized))
  UNION ALL SELECT 'Family', 'ADD', count(*) FROM okf ANTI JOIN tf USING (tree_id, family_id)
  UNION ALL SELECT 'Family', 'UPDATE', count(*) FROM okf s JOIN tf t USING (tree_id, family_id) WHERE (s.marriage_date_raw, s.marriage_year, s.marriage_place) IS DISTINCT FROM (t.marriage_date_raw, t.marriage_year, t.marriage_place)
  UNION ALL SELECT 'FamilyChild', 'ADD', count(*) FROM (SELECT DISTINCT s.* FROM sfc s SEMI JOIN rf USING (tree_id, family_id) SEMI JOIN (SELECT tree_id, person_id AS child_id FROM rp) USING (tree_id, child_id) ANTI JOIN tc USING (tree_id, family_id, child_id))
  UNION ALL SELECT 'ParentOf', 'ADD', count(*) FROM (SELECT s.* FROM spar s SEMI JOIN (SELECT tree_id, person_id AS parent_id FROM rp) USING (tree_id, parent_id) SEMI JOIN (SELECT tree_id, person_id AS child_id FROM rp) USING (tree_id, child_id) ANTI JOIN tq USING (tree_id, parent_id, child_id, relation_type))
  UNION ALL SELECT 'Event', 'UPDATE', count(*) FROM hit WHERE changed
  UNION ALL SELECT 'Event', 'ADD', count(*) FROM fresh
  UNION ALL SELECT 'EventCitation', 'REPLACE', count(*) FROM made
) WHERE rows > 0"""


_GATES = """w AS (
  SELECT import_batch_id FROM (SELECT import_batch_id, unnest(events) AS e FROM once) WHERE regexp_matches(upper(e.date_raw), '^(ABT|BEF|AFT|BET|EST|CAL|FROM|TO) ')
), g AS (
  SELECT b.import_batch_id, 'high_confidence_duplicates' AS gate, 'blocker' AS bad, (SELECT count(*) FROM once o WHERE o.import_batch_id = b.import_batch_id AND o.status = 'suggested' AND o.score >= 0.9) AS issues FROM gedcom_import_batch b
  UNION ALL SELECT b.import_batch_id, 'name_parsing_issues', 'warning', (SELECT count(*) FROM once o WHERE o.import_batch_id = b.import_batch_id AND regexp_matches(o.import_person1_name, '[.?\\[]')) FROM gedcom_import_batch b
  UNION ALL SELECT b.import_batch_id, 'date_warnings', 'warning', (SELECT count(*) FROM w WHERE w.import_batch_id = b.import_batch_id) FROM gedcom_import_batch b
  UNION ALL SELECT import_batch_id, 'scope_invalid', 'warning', coalesce(scope_invalid_count, 0) FROM gedcom_import_batch
)"""
_ONCE = "once AS (SELECT DISTINCT ON (duplicate_candidate_id) * FROM duplicate_candidate)"

ORACLE = {
    "c_preview": sql(
        f"""SELECT entity, change, rows FROM (
  SELECT 'Person' AS entity, 'ADD' AS change, count(*) AS rows FROM sp s ANTI JOIN person_v t USING (tree_id, person_id)
  UNION ALL SELECT 'Person', 'MISSING_FROM_IMPORT', count(*) FROM person_v s ANTI JOIN sp t USING (tree_id, person_id)
  UNION ALL SELECT 'Person', 'UPDATE', count(*) FROM sp s JOIN person_v t USING (tree_id, person_id) WHERE coalesce(s.external_id, '') <> coalesce(t.external_id, '') OR coalesce(s.sex, '') <> coalesce(t.sex, '') OR coalesce(s.is_living, false) <> coalesce(t.is_living, false) OR coalesce(s.display_name, '') <> coalesce(t.display_name, '') OR coalesce(s.surname_normalized, '') <> coalesce(t.surname_normalized, '')
  UNION ALL SELECT 'PersonName', 'ADD', count(*) FROM sn s ANTI JOIN name_v t USING (tree_id, person_id, script_code, full_name_normalized)
  UNION ALL SELECT 'PersonName', 'MISSING_FROM_IMPORT', count(*) FROM name_v s ANTI JOIN sn t USING (tree_id, person_id, script_code, full_name_normalized)
  UNION ALL SELECT 'ParentOf', 'ADD', count(*) FROM spar s ANTI JOIN tpar t USING (tree_id, parent_id, child_id, relation_type)
  UNION ALL SELECT 'ParentOf', 'MISSING_FROM_IMPORT', count(*) FROM tpar s ANTI JOIN spar t USING (tree_id, parent_id, child_id, relation_type)
  UNION ALL SELECT 'FamilyChild', 'ADD', count(*) FROM sfc s ANTI JOIN fc t USING (tree_id, family_id, child_id)
  UNION ALL SELECT 'FamilyChild', 'MISSING_FROM_IMPORT', count(*) FROM fc s ANTI JOIN sfc t USING (tree_id, family_id, child_id)
  UNION ALL SELECT 'Place', 'ADD', count(DISTINCT place_raw) FROM se s ANTI JOIN place t USING (place_raw) WHERE place_raw IS NOT NULL
  UNION ALL SELECT 'Family', 'ADD', count(*) FROM sf s ANTI JOIN family_v t USING (tree_id, family_id)
  UNION ALL SELECT 'Family', 'MISSING_FROM_IMPORT', count(*) FROM family_v s ANTI JOIN sf t USING (tree_id, family_id)
  UNION ALL SELECT 'Family', 'UPDATE', count(*) FROM sf s JOIN family_v t USING (tree_id, family_id) WHERE coalesce(s.marriage_date_raw, '') <> coalesce(t.marriage_date_raw, '') OR coalesce(s.marriage_year, -1) <> coalesce(t.marriage_year, -1) OR coalesce(s.marriage_place, '') <> coalesce(t.marriage_place, '')
  UNION ALL SELECT 'SpouseOf', 'ADD', count(*) FROM sf s ANTI JOIN family_v t USING (tree_id, spouse1_id, spouse2_id)
  UNION ALL SELECT 'Event', 'UPDATE', count(*) FROM bs s JOIN bt t ON {_SAME} WHERE t.event_key IS NULL AND (
    (s.event_type = 'MARR' AND s.is_derived AND t.event_type = 'MARR' AND NOT t.is_derived AND t.pl = s.pl) OR (s.event_type = 'CHR' AND t.event_type = 'BIRT' AND NOT t.is_derived AND t.pl = s.pl) OR (s.event_type = 'DEAT' AND t.event_type = 'DEAT' AND t.is_derived = s.is_derived AND t.pl <> s.pl))
  UNION ALL SELECT 'Event', 'ADD', count(*) FROM bs s WHERE NOT ({_known('s', 'bt t', 'pl')})
  UNION ALL SELECT 'Event', 'MISSING_FROM_IMPORT', count(*) FROM bt t WHERE NOT ({_known('t', 'bs s', 'pt')})
  UNION ALL SELECT 'EventCitation', CASE WHEN k.known THEN 'REPLACE' ELSE 'ADD' END, count(*) FROM se s LEFT JOIN (SELECT DISTINCT tree_id, person_id, event_key, true AS known FROM e0 WHERE event_key IS NOT NULL) k USING (tree_id, person_id, event_key) WHERE s.event_id % 3 = 0 AND s.event_key IS NOT NULL GROUP BY ALL
) WHERE rows > 0""",
        _STAGED, f"bs AS ({_BLANK.format('se')})", f"bt AS ({_BLANK.format('e0')})",
    ),
    "c_preview_samples": sql(
        """SELECT tree_id, CAST(rank AS INTEGER) AS rank, change, person_id, display_name, old_name FROM (
  SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY change, display_name NULLS LAST, person_id) AS rank FROM (
    SELECT s.tree_id, s.person_id, s.display_name, t.display_name AS old_name, CASE WHEN t.person_id IS NULL THEN 'ADD' WHEN coalesce(s.display_name, '') <> coalesce(t.display_name, '') OR coalesce(s.sex, '') <> coalesce(t.sex, '') OR coalesce(s.external_id, '') <> coalesce(t.external_id, '') OR coalesce(s.is_living, false) <> coalesce(t.is_living, false) OR coalesce(s.surname_normalized, '') <> coalesce(t.surname_normalized, '') THEN 'UPDATE' END AS change FROM sp s LEFT JOIN person_v t USING (tree_id, person_id)
  ) WHERE change IS NOT NULL) WHERE rank <= 200""",
        _STAGED,
    ),
    "c_duplicates_within": sql(_DUPS.format(other="life_s", apart="<", sourced="cited_s", alike="same normalized given/surname: ", left="left person has no staged parents", right="right person has no staged parents"), _STAGED, *_LIFE_S),
    "c_duplicates_vs_tree": sql(
        _DUPS.format(other="life_t", apart="<>", sourced="cited_t", alike="same given/surname: ", left="staged person has no staged parents", right="existing person has no tree parents"),
        _STAGED, *_LIFE_S, _life("life_t", "name_v", "person_v", "e0", "parent_v"), _cited("cited_t", "e0"),
    ),
    "c_apply": sql(_CHANGES, _STAGED, _KEEP_ALL, _APPLY),
    "c_apply_delete_missing": sql(_CHANGES, _STAGED, _DELETE, _APPLY),
    "c_apply_persons": sql("SELECT tree_id, person_id, external_id, sex, is_living, display_name, surname_normalized, coalesce(t.given_name, s.given_name) AS given_name, coalesce(t.birth_year, s.birth_year) AS birth_year FROM sp s LEFT JOIN (SELECT tree_id, person_id, given_name, birth_year FROM person_v) t USING (tree_id, person_id) UNION ALL SELECT * FROM person_v ANTI JOIN sp USING (tree_id, person_id)", _STAGED),
    "c_apply_events": sql("SELECT *, NULL::VARCHAR AS family_id FROM re", _STAGED, _KEEP_ALL, _APPLY),
    "c_apply_kept_events": sql("SELECT tree_id, person_id, row_id, event_type, related_id FROM re", _STAGED, _DELETE, _APPLY),
    "c_apply_citations": sql(
        """SELECT * FROM made UNION ALL SELECT tree_id, person_id, event_key, CASE WHEN event_id % 2 = 0 THEN 'GEDCOM' ELSE 'MANUAL' END, 'S' || event_id % 7 FROM e0 WHERE event_id % 3 = 0 AND event_key IS NOT NULL
  AND NOT (event_id % 2 = 0 AND EXISTS (SELECT 1 FROM es WHERE es.tree_id = e0.tree_id AND es.person_id = e0.person_id AND es.event_key = e0.event_key))""",
        _STAGED, _KEEP_ALL, _APPLY,
    ),
    "c_candidate_summary": f"WITH {_ONCE} SELECT candidate_scope, count(*) AS candidates, sum(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN score >= 0.75 AND score < 0.9 THEN 1 ELSE 0 END)::BIGINT AS medium, max(score) AS max_score FROM once GROUP BY 1",
    "c_candidate_list": f"WITH {_ONCE} SELECT import_batch_id, CAST(rank AS INTEGER) AS rank, duplicate_candidate_id, candidate_scope, import_person1_name, import_person2_name, existing_person_name, score FROM (SELECT *, row_number() OVER (PARTITION BY import_batch_id ORDER BY score DESC, duplicate_candidate_id) AS rank FROM once WHERE status = 'suggested') WHERE rank <= 100",
    "c_candidate_events": f"WITH {_ONCE} SELECT duplicate_candidate_id, CAST(position AS INTEGER) AS position, e.side AS side, e.event_type AS event_type, e.date_raw AS date_raw, e.place_raw AS place_raw, e.has_source_citation AS has_source_citation FROM (SELECT duplicate_candidate_id, unnest(events) AS e, generate_subscripts(events, 1) - 1 AS position FROM once) WHERE e.event_type IN ('BIRT', 'CHR', 'DEAT', 'MARR')",
    "c_candidate_relatives": sql(
        """SELECT DISTINCT c.duplicate_candidate_id, 'existing' AS side, k.relation, k.relative_id, p.display_name AS name FROM (SELECT DISTINCT duplicate_candidate_id, lower(trim(existing_tree_person_id)) AS person_id FROM duplicate_candidate) c
  JOIN (SELECT tree_id, child_id AS person_id, 'parent' AS relation, parent_id AS relative_id FROM parent_v UNION ALL SELECT tree_id, parent_id, 'child', child_id FROM parent_v
    UNION ALL SELECT tree_id, spouse1_id, 'spouse', spouse2_id FROM family_v UNION ALL SELECT tree_id, spouse2_id, 'spouse', spouse1_id FROM family_v) k USING (person_id)
  JOIN person_v p ON p.tree_id = k.tree_id AND p.person_id = k.relative_id""",
    ),
    "c_readiness": f"WITH {_ONCE}, {_GATES} SELECT import_batch_id, gate, CASE WHEN issues > 0 THEN bad ELSE 'pass' END AS severity, issues, issues = 0 AS passed FROM g",
    "c_readiness_report": f"WITH {_ONCE}, {_GATES} SELECT b.import_batch_id, NOT EXISTS (SELECT 1 FROM g WHERE g.import_batch_id = b.import_batch_id AND bad = 'blocker' AND issues > 0) AS can_apply_without_review, true AS requires_explicit_confirmation, (SELECT count(*) FROM g WHERE g.import_batch_id = b.import_batch_id AND issues > 0) AS failed_gates, (SELECT count(*) FROM once o WHERE o.import_batch_id = b.import_batch_id AND o.status = 'suggested') AS duplicates, CASE WHEN b.status IN ('STAGED', 'PREVIEWED') THEN 'WAITING_FOR_CONFIRMATION' ELSE b.status END AS status FROM gedcom_import_batch b",
    "c_pending": f"WITH {_ONCE}, top AS (SELECT * FROM gedcom_import_batch WHERE status IN ('STAGED', 'PREVIEWED', 'WAITING_FOR_CONFIRMATION') ORDER BY created_at DESC NULLS LAST, import_batch_id LIMIT 50) SELECT t.import_batch_id, t.tree_name, t.status, t.person_count, count(o.duplicate_candidate_id) AS open_candidates FROM top t LEFT JOIN once o ON o.import_batch_id = t.import_batch_id AND o.status = 'suggested' GROUP BY ALL",
    "c_cancel": "SELECT import_batch_id, CASE WHEN hit THEN 'CANCELLED' ELSE status END AS status, CASE WHEN hit THEN concat_ws(chr(10), notes, 'out of scope') ELSE notes END AS notes FROM (SELECT *, coalesce(scope_invalid_count > 0, false) AND status NOT IN ('APPLIED', 'CANCELLED') AS hit FROM gedcom_import_batch)",
    "c_suppress_rejected": """WITH k AS (SELECT duplicate_candidate_id, status, lower(trim(import_batch_id)) AS b, candidate_scope AS s, lower(trim(import_tree_person_id1)) AS i1, lower(trim(import_tree_person_id2)) AS i2, lower(trim(existing_tree_person_id)) AS e FROM duplicate_candidate)
SELECT duplicate_candidate_id FROM k c WHERE NOT EXISTS (SELECT 1 FROM k r WHERE r.status = 'rejected' AND r.b = c.b AND r.s = c.s AND r.i1 = c.i1 AND r.i2 IS NOT DISTINCT FROM c.i2 AND r.e IS NOT DISTINCT FROM c.e)""",
}
