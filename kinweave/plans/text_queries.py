"""Queries of the scalar expressions and of interchange files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.dates import ABOUT, AFTER, BEFORE, MONTHS, OPEN_END, with_parsed_date
from kinweave.functions.ids import attachment_type, content_hash, event_key, mime_type, uuid5
from kinweave.functions.names import name_variants, normalized_names, primary_variant
from kinweave.functions.text import language_hint, norm_space, norm_text, place_key, script_of, strip_diacritics
from kinweave.operators.runtime import table
from kinweave.plans.adapters import sql, workspace
from kinweave.sources import gedcom


def a_norm_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("full_name")
    names = table(spark, d, "person_name").select(c).distinct()
    return names.select(c, norm_space(c).alias("spaced"), strip_diacritics(c).alias("bare"), norm_text(c).alias("normalized"))


def a_script(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("name_text")
    return table(spark, d, "record_person_mention").select(c).distinct().select(c, script_of(c).alias("script"), language_hint(c).alias("hint"))


def a_place_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person_event").select("place_raw").distinct().select("place_raw", place_key(F.col("place_raw")).alias("place_key"))


def a_parse_date(spark: SparkSession, d: str) -> DataFrame:
    return with_parsed_date(table(spark, d, "person_event").select("date_raw").distinct(), "date_raw")


def a_plain_years(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the dates that are a plain year or a day with an English month."""
    dates = table(spark, d, "person_event").select("date_raw").distinct().filter(F.col("date_raw").rlike("^([0-9]{4}|[0-9]{1,2} [A-Z]{3} [0-9]{4})$"))
    return with_parsed_date(dates, "date_raw").select("date_raw", "date_from", "date_to", "precision", "warning")


def a_name_parse(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "person_name").select("person_name_id", F.col("full_name").alias("raw_name"))
    return normalized_names(name_variants(names, "person_name_id", "raw_name")).select("person_name_id", "position", "script", "given_name", "patronymic", "surname", "full_name_normalized", "confidence", "status", "explanation")


def a_primary_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "person_name").select("person_name_id", F.col("full_name").alias("raw_name"))
    return primary_variant(name_variants(names, "person_name_id", "raw_name"), "person_name_id").select("person_name_id", "script", "given", "surname", "full_name")


def a_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person").filter("external_id is not null").select("external_id", uuid5(F.col("external_id")).alias("uuid"))


def a_event_key(spark: SparkSession, d: str) -> DataFrame:
    e = workspace(spark, d).event
    return e.select("event_id", event_key(F.col("person_id"), F.col("event_type"), F.col("event_value"), F.col("date_raw"), F.col("year_from"), F.col("year_to"), F.col("place_raw"), F.col("related_id"), F.col("is_derived"), F.col("event_id")).alias("event_key"))


def a_is_living(spark: SparkSession, d: str) -> DataFrame:
    """A death with a year says no; a birth in 1906 or later says yes; else unknown."""
    e = workspace(spark, d).event.groupBy("tree_id", "person_id").agg(F.max(F.when(F.col("event_type") == "DEAT", F.col("year_from"))).alias("died"), F.max(F.when(F.col("event_type") == "BIRT", F.col("year_to"))).alias("born"))
    return e.select("tree_id", "person_id", F.when(F.col("died").isNotNull(), False).when(F.col("born") >= 1906, True).alias("is_living"))


def a_date_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = with_parsed_date(workspace(spark, d).event.select("event_type", "date_raw"), "date_raw")
    return e.filter("warning <> ''").groupBy("event_type", "warning").agg(F.count(F.lit(1)).alias("events"))


def a_place_stats(spark: SparkSession, d: str) -> DataFrame:
    e = workspace(spark, d).event.filter("place_raw is not null")
    total = e.groupBy("place_raw").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("person_id").alias("persons"), F.count(F.when(F.col("event_type") == "BIRT", 1)).alias("births"), F.count(F.when(F.col("event_type") == "DEAT", 1)).alias("deaths"))
    return total


def a_person_stats(spark: SparkSession, d: str) -> DataFrame:
    ws = workspace(spark, d)
    parents = ws.parent.groupBy("tree_id", F.col("child_id").alias("person_id")).agg(F.count(F.lit(1)).alias("parents"))
    children = ws.parent.groupBy("tree_id", F.col("parent_id").alias("person_id")).agg(F.count(F.lit(1)).alias("children"))
    events = ws.event.groupBy("tree_id", "person_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("place_raw").alias("places"))
    df = ws.person.select("tree_id", "person_id")
    for part in (parents, children, events):
        df = df.join(part, ["tree_id", "person_id"], "left")
    return df.select("tree_id", "person_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("parents", "children", "events", "places")])


def a_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Names of several persons of a tree, told by any of their recorded names without differences of case, marks and blanks."""
    names = workspace(spark, d).name.select("tree_id", norm_text(F.col("full_name")).alias("name"), "person_id").filter("name <> ''")
    return names.groupBy("tree_id", "name").agg(F.countDistinct("person_id").alias("persons")).filter("persons > 1")


def a_event_histogram(spark: SparkSession, d: str) -> DataFrame:
    return workspace(spark, d).event.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def a_top_places(spark: SparkSession, d: str) -> DataFrame:
    return workspace(spark, d).event.filter("place_raw is not null").groupBy("place_raw").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "place_raw").limit(20)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text")


def s_gedcom_lines(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.lines(_files(spark, d))


def s_gedcom_individuals(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.parse(gedcom.lines(_files(spark, d))).individuals.select("file", "record_xref", F.element_at("names", 1).alias("name"), "sex")


def s_gedcom_events(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.parse(gedcom.lines(_files(spark, d))).events.select("file", "record_xref", "event_no", "tag", "value", "date_raw", "date_from", "date_to", "place_raw", "place_normalized", "note")


def s_gedcom_staged_events(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.staged_events(gedcom.parse(gedcom.lines(_files(spark, d)))).select("file", "xref", "ordinal", "tag", "derived", "event_key", "person_id")


def s_gedcom_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return gedcom.unresolved_references(gedcom.parse(gedcom.lines(_files(spark, d))))


def e_content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(content_hash(F.encode("text", "UTF-8")).alias("content_hash")).agg(F.count(F.lit(1)).alias("links"), F.min("doc_id").alias("first_doc"))


#: First bytes, by number, that the blobs of the query begin with; the last is no accepted type.
SIGNATURES = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "49492A00", "255044462D312E37", "3C68746D6C3E"]


def e_mime(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    which = F.element_at(F.array(*[F.lit(s) for s in SIGNATURES]), (F.pmod("doc_id", F.lit(len(SIGNATURES))) + 1).cast("int"))
    mime = mime_type(F.concat(F.unhex(which), F.encode(F.substring(F.coalesce("text", F.lit("")), 1, 16), "UTF-8")))
    return docs.select("doc_id", mime.alias("mime"), attachment_type(F.coalesce(mime, F.lit(""))).alias("attachment_type"))


QUERIES = {
    f.__name__: f
    for f in (
        a_norm_text, a_script, a_place_key, a_parse_date, a_plain_years, a_name_parse, a_primary_name, a_uuid5, a_event_key, a_is_living, a_date_warnings, a_place_stats, a_person_stats, a_name_collisions,
        a_event_histogram, a_top_places, s_gedcom_lines, s_gedcom_individuals, s_gedcom_events, s_gedcom_staged_events, s_gedcom_unresolved, e_content_hash, e_mime,
    )
}

_PREFIXES = "".join(
    f"WHEN starts_with({'s' if which == 'plain' else 'bare'}, '{prefix}') THEN {{'kind': '{kind}', 'mod': '{mod}', 'l': substr({'s' if which == 'plain' else 'bare'}, {len(prefix) + 1}), 'r': ''}} "
    for kind, prefixes in (("before", BEFORE), ("after", AFTER), ("about", ABOUT)) for which, prefix, mod in prefixes
)
_MONTHS = "MAP {" + ", ".join(f"'{name}': {n}" for n, names in MONTHS.items() for name in names) + "}"


def _single(text: str) -> str:
    """SQL of one plain date as a struct."""
    return f"""(SELECT CASE WHEN y IS NULL OR y < 1 THEN {{'a': NULL::DATE, 'z': NULL::DATE, 'p': CASE WHEN t[1] = '' THEN 'EMPTY' ELSE 'UNPARSED' END}}
      WHEN m IS NOT NULL AND d > 0 THEN {{'a': day, 'z': day, 'p': CASE WHEN day IS NULL THEN 'UNPARSED' ELSE 'DAY' END}}
      ELSE {{'a': make_date(y, coalesce(m, 1), 1), 'z': last_day(make_date(y, coalesce(m, 12), 1)), 'p': CASE WHEN m IS NULL THEN 'YEAR' ELSE 'MONTH' END}} END
    FROM (SELECT *, try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS day FROM (SELECT *, t[i]::INT AS y, {_MONTHS}[t[i - 1]] AS m, CASE WHEN i >= 3 AND regexp_full_match(t[i - 2], '[0-9]{{1,2}}') THEN t[i - 2]::INT END AS d
      FROM (SELECT t, len(t) + 1 - list_position(list_reverse([regexp_full_match(x, '[0-9]{{3,4}}') for x in t]), true) AS i
        FROM (SELECT string_split(trim(regexp_replace(regexp_replace(upper(strip_accents({text})), '[/.,]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS t)))))"""


_PARSED = f"""read AS (
  SELECT *, CASE WHEN starts_with(s, 'BET ') AND contains(s, ' AND ') THEN {{'kind': 'range', 'mod': 'BET', 'l': split_part(substr(s, 5), ' AND ', 1), 'r': substr(substr(s, 5), instr(substr(s, 5), ' AND ') + 5)}}
    WHEN starts_with(s, 'FROM ') AND contains(s, ' TO ') THEN {{'kind': 'range', 'mod': 'FROM_TO', 'l': split_part(substr(s, 6), ' TO ', 1), 'r': substr(substr(s, 6), instr(substr(s, 6), ' TO ') + 4)}}
    {_PREFIXES}ELSE {{'kind': 'plain', 'mod': '', 'l': s, 'r': ''}} END AS k
  FROM (SELECT date_raw, plain, upper(plain) AS s, strip_accents(upper(plain)) AS bare FROM (SELECT date_raw, trim(regexp_replace(coalesce(date_raw, ''), '\\s+', ' ', 'g')) AS plain FROM (SELECT DISTINCT date_raw FROM person_event)))
), ends AS (
  SELECT date_raw, plain, k.kind AS kind, k.mod AS mod, {_single('k.l')} AS l, {_single('k.r')} AS r, regexp_matches(strip_accents(k.r), '{OPEN_END}') AS open FROM read
), bounds AS (
  SELECT *, CASE WHEN kind <> 'before' THEN l.a END AS date_from, CASE WHEN kind = 'range' THEN CASE WHEN NOT open THEN r.z END WHEN kind <> 'after' THEN l.z END AS date_to,
    CASE WHEN kind = 'range' THEN CASE WHEN l.p = CASE WHEN open THEN 'OPEN' ELSE r.p END THEN l.p ELSE 'RANGE' END ELSE l.p END AS p, coalesce(date_raw, '') = '' AS blank FROM ends
), parsed AS (
  SELECT date_raw, plain, date_from, date_to, CASE WHEN blank THEN '' ELSE p END AS precision, CASE WHEN blank THEN '' ELSE mod END AS modifier, CASE WHEN blank THEN 'EMPTY' WHEN date_from IS NOT NULL OR date_to IS NOT NULL THEN 'OK' ELSE 'UNPARSED' END AS status FROM bounds
), warned AS (
  SELECT date_raw, date_from, date_to, year(date_from)::INT AS year_from, year(date_to)::INT AS year_to, precision, modifier, status, CASE WHEN plain = '' THEN '' WHEN status <> 'OK' THEN 'UNPARSED' WHEN modifier IN ('ABT', 'EST', 'CAL') THEN 'APPROXIMATE'
    WHEN modifier IN ('BEF', 'AFT', 'FROM', 'TO') THEN 'OPEN_BOUND' WHEN modifier IN ('BET', 'FROM_TO') THEN 'RANGE' ELSE '' END AS warning FROM parsed
)"""

_GED = r"^\s*(\d+)\s+(?:(@[^@]+@)\s+)?([A-Za-z0-9_]+)(?:[ \t](.*))?$"
_LINES = rf"SELECT file, line_no, level::INT AS level, nullif(xref, '') AS xref, upper(tag) AS tag, value FROM (SELECT file, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, '{_GED}', 1) AS level, regexp_extract(line, '{_GED}', 2) AS xref, regexp_extract(line, '{_GED}', 3) AS tag, regexp_extract(line, '{_GED}', 4) AS value, regexp_matches(line, '{_GED}') AS ok FROM (SELECT doc_id::VARCHAR AS file, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL))) WHERE ok AND length(level) <= 2"
_RECORDS = f"""WITH lines AS ({_LINES}), r AS (
  SELECT *, max(CASE WHEN level = 0 THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS record_no FROM lines
), h AS (
  SELECT file, line_no AS record_no, xref AS record_xref, tag AS kind FROM lines WHERE level = 0
), x AS (
  SELECT r.*, h.record_xref, h.kind FROM r JOIN h USING (file, record_no)
)"""
ORACLE = {
    "a_norm_text": r"SELECT full_name, trim(regexp_replace(full_name, '\s+', ' ', 'g')) AS spaced, strip_accents(full_name) AS bare, lower(strip_accents(trim(regexp_replace(full_name, '\s+', ' ', 'g')))) AS normalized FROM (SELECT DISTINCT full_name FROM person_name)",
    "a_script": r"SELECT name_text, CASE WHEN c AND l THEN 'MIXED' WHEN c THEN 'CYR' WHEN l THEN 'LAT' ELSE 'OTHER' END AS script, CASE WHEN c AND l THEN 'mixed' WHEN c THEN 'uk-ru' WHEN l THEN 'pl-la' ELSE 'unknown' END AS hint FROM (SELECT DISTINCT name_text, regexp_matches(coalesce(name_text, ''), '[\x{0400}-\x{052F}]') AS c, regexp_matches(coalesce(name_text, ''), '[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]') AS l FROM record_person_mention)",
    "a_plain_years": "SELECT date_raw, CASE WHEN length(date_raw) = 4 THEN make_date(date_raw::INT, 1, 1) ELSE strptime(date_raw, '%d %b %Y')::DATE END AS date_from, CASE WHEN length(date_raw) = 4 THEN make_date(date_raw::INT, 12, 31) ELSE strptime(date_raw, '%d %b %Y')::DATE END AS date_to, CASE WHEN length(date_raw) = 4 THEN 'YEAR' ELSE 'DAY' END AS precision, '' AS warning FROM (SELECT DISTINCT date_raw FROM person_event) WHERE regexp_full_match(date_raw, '[0-9]{4}|[0-9]{1,2} [A-Z]{3} [0-9]{4}')",
    "a_event_key": sql("SELECT event_id, sha1(concat_ws('|', coalesce(person_id, ''), coalesce(event_type, ''), coalesce(event_value, ''), coalesce(date_raw, ''), coalesce(year_from::VARCHAR, ''), coalesce(year_to::VARCHAR, ''), coalesce(place_raw, ''), coalesce(related_id, ''), CASE WHEN is_derived THEN '1' ELSE '0' END, event_id::VARCHAR)) AS event_key FROM event_v"),
    "a_is_living": sql("SELECT tree_id, person_id, CASE WHEN max(year_from) FILTER (event_type = 'DEAT') IS NOT NULL THEN false WHEN max(year_to) FILTER (event_type = 'BIRT') >= 1906 THEN true END AS is_living FROM event_v GROUP BY ALL"),
    "a_place_stats": sql("SELECT place_raw, count(*) AS events, count(DISTINCT person_id) AS persons, count(*) FILTER (event_type = 'BIRT') AS births, count(*) FILTER (event_type = 'DEAT') AS deaths FROM event_v WHERE place_raw IS NOT NULL GROUP BY 1"),
    "a_person_stats": sql("SELECT p.tree_id, p.person_id, (SELECT count(*) FROM parent_v e WHERE e.tree_id = p.tree_id AND e.child_id = p.person_id) AS parents, (SELECT count(*) FROM parent_v e WHERE e.tree_id = p.tree_id AND e.parent_id = p.person_id) AS children, (SELECT count(*) FROM event_v e WHERE e.tree_id = p.tree_id AND e.person_id = p.person_id) AS events, (SELECT count(DISTINCT place_raw) FROM event_v e WHERE e.tree_id = p.tree_id AND e.person_id = p.person_id) AS places FROM person_v p"),
    "a_name_collisions": sql(r"SELECT tree_id, lower(strip_accents(trim(regexp_replace(full_name, '\s+', ' ', 'g')))) AS name, count(DISTINCT person_id) AS persons FROM name_v WHERE trim(full_name) <> '' GROUP BY ALL HAVING count(DISTINCT person_id) > 1"),
    "a_event_histogram": sql("SELECT event_type, count(*) AS events FROM event_v GROUP BY 1"),
    "a_top_places": sql("SELECT place_raw, count(*) AS events FROM event_v WHERE place_raw IS NOT NULL GROUP BY 1 ORDER BY events DESC, place_raw LIMIT 20"),
    "s_gedcom_lines": _LINES,
    "s_gedcom_individuals": f"{_RECORDS} SELECT file, record_xref, arg_min(value, line_no) FILTER (level = 1 AND tag = 'NAME') AS name, upper(left(arg_min(value, line_no) FILTER (level = 1 AND tag = 'SEX'), 1)) AS sex FROM x WHERE kind = 'INDI' GROUP BY file, record_no, record_xref",
    "s_gedcom_unresolved": rf"{_RECORDS} SELECT file, record_xref AS family_xref, tag AS role, trim(regexp_replace(value, '\s+', ' ', 'g')) AS member_xref FROM x WHERE kind = 'FAM' AND level = 1 AND tag IN ('HUSB', 'WIFE', 'CHIL') AND NOT EXISTS (SELECT 1 FROM h i WHERE i.kind = 'INDI' AND i.file = x.file AND i.record_xref = trim(regexp_replace(x.value, '\s+', ' ', 'g')))",
    "a_parse_date": f"WITH {_PARSED} SELECT * FROM warned",
    "a_date_warnings": sql("SELECT event_type, warning, count(*) AS events FROM event_v e JOIN warned w ON w.date_raw IS NOT DISTINCT FROM e.date_raw WHERE warning <> '' GROUP BY ALL", _PARSED),
    "a_uuid5": "SELECT external_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS uuid FROM (SELECT external_id, lower(sha1(unhex('6f8a0d4d9b9f4d498f2d2a8c9fe2a2f1') || encode(external_id))) AS h FROM person WHERE external_id IS NOT NULL)",
    "e_content_hash": "SELECT sha256(text) AS content_hash, count(*) AS links, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "e_mime": "SELECT doc_id, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/tiff', 'application/pdf', NULL][doc_id % 7 + 1] AS mime, CASE WHEN doc_id % 7 < 5 THEN 'image' WHEN doc_id % 7 = 5 THEN 'document' ELSE 'other' END AS attachment_type FROM documents",
}
