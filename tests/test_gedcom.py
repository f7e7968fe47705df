import pytest

from kinweave.sources import gedcom, staging
from kinweave.sources.staging import json_documents, read_manifest, read_tsv, write_tsv
from kinweave.streaming.arrivals import arriving_lines, store_lines

TEXT = """0 HEAD
not a line
0 @I1@ INDI
1 NAME Іван /Коваль/
1 SEX M
1 BIRT
2 DATE 12 OCT 1798
2 PLAC с. Немиринці
2 ADDR дім 5
2 SOUR @S1@
3 PAGE 12
3 QUAY 3
3 DATA
4 TEXT перший
5 CONT другий
2 NOTE після
1 BURI
1 _CUST
1 _HOME
2 PLAC Київ
0 @I2@ INDI
1 NAME Марія //
1 BIRT Y
0 @I3@ INDI
1 NAME Петро /Коваль/
1 BIRT
2 DATE ABT 1820
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I9@
1 MARR
2 DATE 1818
0 @S1@ SOUR
1 ABBR Книга
0 TRLR
"""


@pytest.fixture(scope="module")
def parsed(spark):
    return gedcom.parse(gedcom.lines(spark.createDataFrame([("f", TEXT), ("empty", ""), ("odd", None)], "file string, text string")))


def test_relations(parsed):
    assert parsed.individuals.count() == 3 and parsed.families.count() == 1
    e = {(r.record_xref, r.tag): r for r in parsed.events.collect()}
    assert set(e) == {("@I1@", "BIRT"), ("@I1@", "BURI"), ("@I1@", "_HOME"), ("@I2@", "BIRT"), ("@I3@", "BIRT"), ("@F1@", "MARR")}
    birth = e["@I1@", "BIRT"]
    assert (birth.place_raw, birth.note, birth.year_from) == ("с. Немиринці дім 5", "після", 1798)
    assert e["@I2@", "BIRT"].value is None
    c = parsed.citations.collect()
    assert [(r.source_ref, r.page, r.quality, r.source_title, r.citation_text) for r in c] == [("@S1@", "12", "3", "Книга", "перший\nдругий")]
    assert [r.member_xref for r in gedcom.unresolved_references(parsed).collect()] == ["@I9@"]


def test_staged(parsed):
    rows = gedcom.staged_events(parsed).collect()
    assert sorted((r.xref, r.ordinal, r.tag, r.derived) for r in rows) == [
        ("@I1@", 1, "BIRT", False), ("@I1@", 2, "_HOME", False), ("@I1@", 3, "MARR", True), ("@I1@", 4, "CHILD_BIRTH", True),
        ("@I2@", 1, "BIRT", False), ("@I2@", 2, "MARR", True), ("@I2@", 3, "CHILD_BIRTH", True), ("@I3@", 1, "BIRT", False),
    ]
    assert len({r.event_key for r in rows}) == len(rows)
    assert gedcom.staged_families(parsed).first().marriage_year == 1818
    assert {(r.parent_xref, r.child_xref) for r in gedcom.parent_edges(parsed).collect()} == {("@I1@", "@I3@"), ("@I2@", "@I3@")}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ged").write_bytes(b"\xef\xbb\xbf" + TEXT.encode())
    (tmp_path / "in/b.ged").write_bytes(TEXT.encode("utf-16"))
    (tmp_path / "in/c.ged").write_bytes(b"0 HEAD\n1 NOTE \xff\xfe\xfa\n")
    rows = gedcom.lines(gedcom.read_text_files(spark, str(tmp_path / "in"))).groupBy("file").count().collect()
    by = {r["file"][-5:]: r["count"] for r in rows}
    assert by["a.ged"] == by["b.ged"] and by["c.ged"] == 2
    (tmp_path / "in/b.ged").unlink()
    store_lines(arriving_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == by["a.ged"] + by["c.ged"]


def test_staging_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "p1", "@I1@", "M", True, "Іван\nКоваль", None), ("b", "p2", None, None, None, 'a "quoted"', "x")], "ImportBatchId string, TreePersonId string, ExternalId string, Sex string, IsLiving boolean, PrimaryDisplayName string, SurnameNormalized string")
    write_tsv(df, str(tmp_path / "person"))
    rows = sorted(map(tuple, read_tsv(spark, str(tmp_path / "person"), "person").collect()))
    assert rows == [("b", "p1", "@I1@", "M", True, "Іван Коваль", None), ("b", "p2", None, None, None, 'a "quoted"', "x")]
    assert read_manifest('{"relations": [{"name": "Person", "rows": 2}, {"name": "Place"}]}') == {"person": 2, "place": 0}
    assert json_documents(spark.createDataFrame([(1, None)], "tree_id int, display_name string")).first()[0] == '{"treeId":1,"displayName":null}'


def test_labels_and_ids(spark):
    text = "0 @I1@ INDI\n1 NAME Іван /Коваль/\n1 SEX M\n0 @I2@ INDI\n1 NAME //\n1 SEX F\n0 @I3@ INDI\n1 SEX M\n0 @I4@ INDI\n0 @F1@ FAM\n1 HUSB @I1@\n1 WIFE @I2@\n0 @F2@ FAM\n1 HUSB @I3@\n1 CHIL @I1@\n"
    rows = spark.createDataFrame([("/a/x.ged", text), ("/b/x.ged", text)], "file string, text string")
    g = gedcom.parse(gedcom.lines(rows))
    got = {r.xref: r.label for r in gedcom.person_labels(g).filter("file = '/a/x.ged'").collect()}
    assert got == {"@I1@": "Іван Коваль", "@I2@": "Unnamed wife of Іван Коваль", "@I3@": "Unnamed parent of Іван Коваль", "@I4@": "Unnamed person @I4@"}
    ids = gedcom.person_labels(g)
    assert ids.select("person_id").distinct().count() == 4  # the folder does not matter
    assert gedcom.person_labels(g, "t").join(ids, ["file", "xref", "person_id"]).count() == 0


def test_warnings_spouses_and_places(spark):
    rows = spark.createDataFrame([("f", TEXT)], "file string, text string")
    g = gedcom.parse(gedcom.lines(rows))
    got = {(r.xref, r.event_type, r.warning, r.message.split(";")[0]) for r in gedcom.staged_date_warnings(g, "t").collect()}
    assert ("@I3@", "BIRT", "APPROXIMATE", "Approximate/calculated date") in got and ("@I1@", "CHILD_BIRTH", "APPROXIMATE", "Approximate/calculated date") in got
    assert {(r.from_xref, r.to_xref, r.marriage_year) for r in gedcom.spouse_edges(g, "t").collect()} == {("@I1@", "@I2@", 1818), ("@I2@", "@I1@", 1818)}
    assert [r.row_number for r in gedcom.staged_places(g).orderBy("row_number").collect()] == [1, 2]


def test_staged_batch_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("b", 1, "x", "y", "MARR", None, 1818, "Київ\tcity")], "ImportBatchId string, RowNumber int, FromTreePersonId string, ToTreePersonId string, RelationType string, FamilyId string, MarriageYear int, MarriagePlaceRaw string")
    described = staging.export_batch({"spouse_of": edges}, str(tmp_path), batchId="b", sourceFileHash="h")
    assert described["counts"] == {"gedcom_import_spouse_of.tsv": 1} and described["batchId"] == "b"
    back = staging.load_batch(spark, str(tmp_path), described)["spouse_of"]
    assert [tuple(r) for r in back.collect()] == [("b", 1, "x", "y", "MARR", None, 1818, "Київ\tcity")]
    with pytest.raises(ValueError):
        staging.load_batch(spark, str(tmp_path), described | {"counts": {"gedcom_import_spouse_of.tsv": 2}})
