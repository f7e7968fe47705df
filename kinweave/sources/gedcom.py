"""Line-oriented genealogical interchange files as relations.

Each file is read as lines; a line's record is the last line of level 0 before it, its
event the last event line of level 1, its citation the last source line below that: three
running windows within a file, and everything else is aggregation.  Files are the unit of
parallelism; a file is as large as one family's export.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.dates import warning_message, with_parsed_date
from kinweave.functions.ids import event_key, family_key, person_key
from kinweave.functions.text import event_value_or_none, norm_space, place_key

#: Tags of level 1 that open no event.
STRUCTURAL_INDI = ["NAME", "SEX", "FAMC", "FAMS", "CHAN", "SUBM", "REFN", "RIN", "RFN", "AFN", "ALIA", "ANCI", "DESI", "OBJE", "SOUR", "NOTE"]
STRUCTURAL_FAM = ["HUSB", "WIFE", "CHIL", "CHAN", "SUBM", "REFN", "RIN", "NCHI", "OBJE", "SOUR", "NOTE"]
#: Fixed value: level, pointer, tag and value of a line.
_LINE = r"^\s*(\d+)\s+(?:(@[^@]+@)\s+)?([A-Za-z0-9_]+)(?:[ \t](.*))?$"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files: UTF-16 by its mark, else UTF-8 with or without mark, bad bytes replaced."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 2))
    utf8 = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return raw.select(F.col("path").alias("file"), F.when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(utf8).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, level, xref, tag, value) of the lines that have the form; all others are skipped."""
    each = files.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    part = lambda k: F.regexp_extract("line", _LINE, k)
    rows = each.filter(F.col("line").rlike(_LINE)).select("file", "line_no", part(1).alias("level"), F.nullif(part(2), F.lit("")).alias("xref"), F.upper(part(3)).alias("tag"), part(4).alias("value"))
    return rows.filter(F.length("level") <= 2).withColumn("level", F.col("level").cast("int"))


@dataclass(frozen=True)
class Gedcom:
    individuals: DataFrame
    families: DataFrame
    members: DataFrame
    events: DataFrame
    citations: DataFrame
    sources: DataFrame


def parse(rows: DataFrame) -> Gedcom:
    """Individuals, families with members, events, citations and sources of parsed lines."""
    order = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    df = rows.withColumn("record", last(F.when(F.col("level") == 0, F.struct("line_no", "xref", F.col("tag").alias("kind")))))
    df = df.filter("record is not null").withColumns({"record_no": F.col("record.line_no"), "record_xref": F.col("record.xref"), "kind": F.col("record.kind")}).drop("record")
    df = df.filter(F.col("kind").isin("INDI", "FAM", "SOUR"))
    opens = (F.col("level") == 1) & (((F.col("kind") == "INDI") & ~F.col("tag").isin(*STRUCTURAL_INDI)) | ((F.col("kind") == "FAM") & ~F.col("tag").isin(*STRUCTURAL_FAM)))
    inner = W.partitionBy("file", "record_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") == 1, F.struct("line_no", "tag", "value", opens.alias("event"))), ignorenulls=True).over(inner)
    df = df.withColumn("top", top)
    in_event = F.coalesce(F.col("top.event"), F.lit(False)) & (F.col("level") >= 1)
    df = df.withColumn("event_no", F.when(in_event, F.col("top.line_no")))
    # a citation opens at a source line below an event and ends with the next line of its level or above
    part = W.partitionBy("file", "record_no", "event_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    cite = F.last(F.when((F.col("tag") == "SOUR") & (F.col("level") >= 2), F.struct("line_no", "level")).when(F.col("level") <= 2, F.struct(F.lit(None).cast("int").alias("line_no"), F.col("level"))), ignorenulls=True).over(part)
    df = df.withColumn("cite", F.when(F.col("event_no").isNotNull(), cite)).withColumn("citation_no", F.col("cite.line_no"))
    # texts that continue: CONC joins, CONT starts a line
    text = F.concat_ws("", F.when(F.col("tag") == "CONT", "\n"), F.coalesce("value", F.lit("")))
    joined = lambda cond: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("line_no", text.alias("x"))))), lambda s: s["x"]), ""), F.lit(""))
    one = lambda cond: F.min(F.when(cond, F.struct("line_no", "value")))["value"]
    tag, level = F.col("tag"), F.col("level")
    key = ["file", "record_no", "record_xref"]
    indi = df.filter("kind = 'INDI'").groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(F.when((level == 1) & (tag == "NAME"), F.struct("line_no", "value")))), lambda s: s["value"]).alias("names"), F.upper(F.substring(one((level == 1) & (tag == "SEX")), 1, 1)).alias("sex")
    )
    fam = df.filter("kind = 'FAM'").groupBy(*key).agg(one((level == 1) & (tag == "HUSB")).alias("husband"), one((level == 1) & (tag == "WIFE")).alias("wife"))
    members = df.filter((F.col("kind") == "FAM") & (level == 1) & tag.isin("HUSB", "WIFE", "CHIL")).select("file", "record_no", F.col("record_xref").alias("family_xref"), "line_no", tag.alias("role"), norm_space(F.col("value")).alias("member_xref"))
    plain = F.col("citation_no").isNull()
    event = df.filter("event_no is not null").groupBy("file", "record_no", "record_xref", "kind", "event_no").agg(
        F.min(F.when(F.col("line_no") == F.col("event_no"), tag)).alias("tag"), F.min(F.when(F.col("line_no") == F.col("event_no"), F.col("value"))).alias("raw_value"),
        one(plain & (level == 2) & (tag == "DATE")).alias("date_raw"), one(plain & (level == 2) & (tag == "PLAC")).alias("plac"), one(plain & (level == 2) & (tag == "ADDR")).alias("addr"),
        one(plain & (level == 2) & (tag == "TYPE")).alias("event_type_text"), joined(plain & ((tag == "NOTE") | (tag.isin("CONT", "CONC") & (level > 2)))).alias("note"),
    )
    place = F.nullif(norm_space(F.concat_ws(" ", "plac", "addr")), F.lit(""))
    event = event.withColumns({"place_raw": place, "value": event_value_or_none(F.col("raw_value"), F.col("tag")), "date_raw": F.nullif(norm_space(F.col("date_raw")), F.lit(""))}).drop("plac", "addr", "raw_value")
    # a custom event says something only with a place
    event = event.filter(~F.col("tag").startswith("_") | F.col("place_raw").isNotNull())
    event = with_parsed_date(event, "date_raw").withColumn("place_normalized", place_key(F.col("place_raw")))
    inside = df.filter("citation_no is not null")
    citation = inside.groupBy("file", "record_no", "record_xref", "event_no", "citation_no").agg(
        F.min(F.when(F.col("line_no") == F.col("citation_no"), norm_space(F.col("value")))).alias("source_ref"), one(tag == "PAGE").alias("page"), one(tag == "QUAY").alias("quality"),
        one(tag == "DATE").alias("citation_date_raw"), one(tag == "TITL").alias("inline_title"), joined(tag.isin("TEXT", "CONT", "CONC")).alias("citation_text"), one(tag == "NOTE").alias("note"),
    )
    source = df.filter("kind = 'SOUR'").groupBy(*key).agg(*[one((level == 1) & (tag == t)).alias(n) for t, n in (("TITL", "title"), ("ABBR", "abbreviation"), ("AUTH", "author"))], joined(tag.isin("TEXT", "NOTE", "CONT", "CONC")).alias("text"))
    titles = source.select("file", F.col("record_xref").alias("source_ref"), F.coalesce("title", "abbreviation", "author").alias("known_title"))
    citation = citation.join(titles, ["file", "source_ref"], "left").withColumn("source_title", F.coalesce("inline_title", "known_title")).drop("inline_title", "known_title")
    return Gedcom(indi, fam, members, event, citation, source)


def unresolved_references(g: Gedcom) -> DataFrame:
    """Family members that no individual of the file stands for."""
    known = g.individuals.select("file", F.col("record_xref").alias("member_xref"))
    return g.members.join(known, ["file", "member_xref"], "left_anti").select("file", "family_xref", "role", "member_xref")


_DATE = ["date_raw", "date_from", "date_to", "year_from", "year_to", "precision", "modifier", "status", "warning"]


def _tree(tree_id: str | None) -> Column:
    """The tree that ids belong to; without one each file is a tree, told by its name whatever its folder."""
    return F.lit(tree_id) if tree_id is not None else F.substring_index("file", "/", -1)


def staged_events(g: Gedcom, tree_id: str | None = None) -> DataFrame:
    """Own events, family events for both spouses, and births of children for the parents, with keys and numbers.

    An event's ordinal counts within its person in the order own, family, children.
    """
    own = g.events.filter("kind = 'INDI'").select("file", F.col("record_xref").alias("xref"), F.lit(1).alias("phase"), F.col("record_no").alias("a"), F.col("event_no").alias("b"), "tag", "value", *_DATE, "place_raw", F.lit(None).cast("string").alias("related"), F.lit(False).alias("derived"))
    spouses = g.members.filter("role in ('HUSB', 'WIFE')").join(g.individuals.select("file", F.col("record_xref").alias("member_xref")), ["file", "member_xref"], "left_semi")
    fam = g.events.filter("kind = 'FAM'").join(spouses.select("file", "record_no", "member_xref"), ["file", "record_no"]).select("file", F.col("member_xref").alias("xref"), F.lit(2).alias("phase"), F.col("record_no").alias("a"), F.col("event_no").alias("b"), "tag", "value", *_DATE, "place_raw", F.col("record_xref").alias("related"), F.lit(True).alias("derived"))
    kids = g.members.filter("role = 'CHIL'").select("file", "record_no", "line_no", F.col("member_xref").alias("child"))
    birth = g.events.filter("kind = 'INDI' and tag = 'BIRT'").groupBy("file", F.col("record_xref").alias("child")).agg(F.min(F.struct("event_no", *_DATE, "place_raw")).alias("e"))
    child = spouses.select("file", "record_no", "member_xref").join(kids, ["file", "record_no"]).join(birth, ["file", "child"]).select("file", F.col("member_xref").alias("xref"), F.lit(3).alias("phase"), F.col("record_no").alias("a"), F.col("line_no").alias("b"), F.lit("CHILD_BIRTH").alias("tag"), F.lit(None).cast("string").alias("value"), *[f"e.{c}" for c in (*_DATE, "place_raw")], F.col("child").alias("related"), F.lit(True).alias("derived"))
    rows = own.unionByName(fam).unionByName(child).filter("tag <> 'BURI'")
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("file", "xref").orderBy("phase", "a", "b")))
    keyed = rows.withColumn("event_key", event_key(F.col("xref"), F.col("tag"), F.col("value"), F.col("date_raw"), F.col("year_from"), F.col("year_to"), F.col("place_raw"), F.col("related"), F.col("derived"), F.col("ordinal")))
    return keyed.withColumn("person_id", person_key(F.col("xref"), _tree(tree_id)))


def staged_families(g: Gedcom, tree_id: str | None = None) -> DataFrame:
    """Families with both spouses known and distinct: ids by name, first marriage."""
    known = g.individuals.select("file", F.col("record_xref").alias("x"))
    f = g.families.join(known.withColumnRenamed("x", "husband"), ["file", "husband"], "left_semi").join(known.withColumnRenamed("x", "wife"), ["file", "wife"], "left_semi").filter("husband <> wife")
    wed = g.events.filter("kind = 'FAM' and tag = 'MARR'").groupBy("file", "record_no").agg(F.min(F.struct("event_no", "date_raw", "year_from", "place_raw")).alias("m"))
    return f.join(wed, ["file", "record_no"], "left").select("file", family_key(F.col("record_xref"), _tree(tree_id)).alias("family_id"), "husband", "wife", F.col("m.date_raw").alias("marriage_date_raw"), F.col("m.year_from").alias("marriage_year"), F.col("m.place_raw").alias("marriage_place"))


def parent_edges(g: Gedcom) -> DataFrame:
    """(file, parent_xref, child_xref), both known, each once."""
    known = g.individuals.select("file", F.col("record_xref").alias("x"))
    m = g.members
    parent = m.filter("role in ('HUSB', 'WIFE')").select("file", "record_no", F.col("member_xref").alias("parent_xref")).join(known.withColumnRenamed("x", "parent_xref"), ["file", "parent_xref"], "left_semi")
    child = m.filter("role = 'CHIL'").select("file", "record_no", F.col("member_xref").alias("child_xref")).join(known.withColumnRenamed("x", "child_xref"), ["file", "child_xref"], "left_semi")
    return parent.join(child, ["file", "record_no"]).filter("parent_xref <> child_xref").select("file", "parent_xref", "child_xref").distinct()


def person_labels(g: Gedcom, tree_id: str | None = None) -> DataFrame:
    """(file, xref, person_id, name, label): the cleaned first name of each individual, and a label for one without.

    An unnamed person is called after the spouse, or the first named child, of the first
    family in the file that tells either; else after the pointer.
    """
    people = g.individuals.select("file", F.col("record_xref").alias("xref"), "record_no", "sex", F.col("names"), norm_space(F.replace(F.coalesce(F.get("names", F.lit(0)), F.lit("")), F.lit("/"), F.lit(" "))).alias("clean"))
    # what others see: the first name, or the pointer of a person without any name line
    people = people.withColumn("shown", F.when(F.size("names") == 0, F.col("xref")).otherwise(F.col("clean")))
    named = people.filter("clean <> ''").select("file", F.col("xref").alias("child"), F.col("clean").alias("child_name"))
    parents = g.members.filter("role in ('HUSB', 'WIFE')").select("file", "record_no", F.col("member_xref").alias("xref"))
    other = parents.withColumnRenamed("xref", "spouse").join(people.select("file", F.col("xref").alias("spouse"), F.col("shown").alias("spouse_name")), ["file", "spouse"])
    kids = g.members.filter("role = 'CHIL'").select("file", "record_no", "line_no", F.col("member_xref").alias("child")).join(named, ["file", "child"])
    kids = kids.groupBy("file", "record_no").agg(F.min(F.struct("line_no", "child_name"))["child_name"].alias("child_name"))
    lone = people.filter("clean = ''").select("file", "xref")
    homes = parents.join(lone, ["file", "xref"], "left_semi").join(other, ["file", "record_no"], "left").filter("spouse is null or spouse <> xref")
    homes = parents.join(lone, ["file", "xref"], "left_semi").join(homes, ["file", "record_no", "xref"], "left").join(kids, ["file", "record_no"], "left")
    homes = homes.withColumn("spouse_name", F.nullif("spouse_name", F.lit(""))).filter("spouse_name is not null or child_name is not null")
    first = homes.groupBy("file", "xref").agg(F.min(F.struct("record_no", "spouse_name", "child_name")).alias("home"))
    role = F.when(F.col("sex") == "F", "wife").when(F.col("sex") == "M", "husband").otherwise("spouse")
    label = (
        F.when(F.col("clean") != "", F.col("clean")).when(F.col("home.spouse_name").isNotNull(), F.concat(F.lit("Unnamed "), role, F.lit(" of "), F.col("home.spouse_name")))
        .when(F.col("home.child_name").isNotNull(), F.concat(F.lit("Unnamed parent of "), F.col("home.child_name"))).otherwise(F.concat(F.lit("Unnamed person "), F.col("xref")))
    )
    return people.join(first, ["file", "xref"], "left").select("file", "xref", person_key(F.col("xref"), _tree(tree_id)).alias("person_id"), F.col("shown").alias("name"), label.alias("label"))


def staged_date_warnings(g: Gedcom, tree_id: str | None = None) -> DataFrame:
    """The staged events whose dates are doubtful, open or no dates, with the person's name, the kind and its text."""
    rows = staged_events(g, tree_id).filter("warning <> ''")
    named = person_labels(g, tree_id).select("file", "xref", F.col("name").alias("person_name"))
    return rows.join(named, ["file", "xref"], "left").select(
        "file", "xref", "person_id", "person_name", "ordinal", F.col("tag").alias("event_type"), "date_raw", "date_from", "date_to", "precision", "modifier", "status", "warning", warning_message(F.col("warning")).alias("message")
    )


def spouse_edges(g: Gedcom, tree_id: str | None = None) -> DataFrame:
    """(file, from_xref, to_xref, from_id, to_id, family_id, relation_type, marriage_year, marriage_place): each marriage both ways."""
    f = staged_families(g, tree_id)
    way = lambda a, b: F.struct(F.col(a).alias("from_xref"), F.col(b).alias("to_xref"))
    both = f.select("file", "family_id", "marriage_year", "marriage_place", F.inline(F.array(way("husband", "wife"), way("wife", "husband"))))
    ids = [person_key(F.col(c), _tree(tree_id)).alias(c.replace("xref", "id")) for c in ("from_xref", "to_xref")]
    return both.select("file", "from_xref", "to_xref", *ids, "family_id", F.lit("MARR").alias("relation_type"), "marriage_year", "marriage_place")


def staged_places(g: Gedcom) -> DataFrame:
    """(file, row_number, place_raw, place_normalized): the places of each file's events, once each, numbered by their text."""
    once = g.events.filter("place_raw is not null").select("file", "place_raw", "place_normalized").distinct()
    return once.withColumn("row_number", F.row_number().over(W.partitionBy("file").orderBy("place_raw"))).select("file", "row_number", "place_raw", "place_normalized")
