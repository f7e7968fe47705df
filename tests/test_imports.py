"""Applying imports, guards, and duplicates with cited dates."""

import pytest

from kinweave.operators import imports
from kinweave.operators.imports import Refused, Snapshot, apply_batch, apply_import, duplicates, regenerate, sourced_dates, sourced_evidence


def _side(spark, people, edges, families, kids, events, cites, names=None):
    df = spark.createDataFrame
    e = "tree_id string, person_id string, event_key string, event_type string, date_raw string, place_raw string, related_id string, family_id string, is_derived boolean, row_id string, place_normalized string, year_from int, year_to int, date_from date, date_to date, event_value string"
    rows = [("t", p, k, kind, date, place, rel, fam, False, row, place, None, None, None, None, None) for p, k, kind, date, place, rel, fam, row in events]
    places = sorted({r[5] for r in rows if r[5]})
    return Snapshot(
        df([("t", p, None, "M", None, n, None, extra) for p, n, extra in people], "tree_id string, person_id string, external_id string, sex string, is_living boolean, display_name string, surname_normalized string, given_name string"),
        df([("t", p, "LAT", g, s, f"{g} {s}", f"{g} {s}".lower(), True) for p, g, s in names or []], "tree_id string, person_id string, script_code string, given string, surname string, full_name string, full_name_normalized string, is_primary boolean"),
        df([("t", a, b, "B") for a, b in edges], "tree_id string, parent_id string, child_id string, relation_type string"),
        df([("t", f, a, b, y) for f, a, b, y in families], "tree_id string, family_id string, spouse1_id string, spouse2_id string, marriage_year int"),
        df(rows, e), df([(k, p) for k, p in enumerate(places)], "place_id long, place_raw string"),
        df([("t", p, k, o, r) for p, k, o, r in cites], "tree_id string, person_id string, event_key string, source_origin string, source_ref string"),
        df([("t", f, c) for f, c in kids], "tree_id string, family_id string, child_id string"),
    )


@pytest.fixture(scope="module")
def sides(spark):
    stored = _side(
        spark, [("a", "A", "Ann"), ("b", "B", None), ("gone", "G", None)], [("a", "gone")], [("f1", "a", "b", 1800), ("f2", "a", "gone", 1801)], [("f2", "gone")],
        [("a", "k1", "BIRT", "1800", "X", None, None, "1"), ("a", None, "OCCU", "1820", None, None, None, "2"), ("b", "k2", "RESI", "1830", None, "gone", None, "3"), ("gone", "k3", "DEAT", "1850", None, None, "f2", "4")],
        [("a", "k1", "GEDCOM", "old"), ("a", "k1", "MANUAL", "kept"), ("gone", "k3", "GEDCOM", "lost")], [("a", "Ann", "Ko")],
    )
    staged = _side(
        spark, [("a", "A2", None), ("b", "B", None), ("c", "C", "Cy")], [("a", "c"), ("zz", "c")], [("f1", "a", "b", 1802), ("f3", "a", "zz", 1803)], [("f1", "c"), ("f1", "zz")],
        [("a", "k1", "BIRT", "1801", "Y", None, None, "s1"), ("a", None, "OCCU", "1820", None, None, None, "s2"), ("c", "k9", "BIRT", "1825", "Y", "zz", "f1", "s3")],
        [("a", "k1", "GEDCOM", "new"), ("c", "k9", "GEDCOM", "new")], [("a", "Ann", "Kova"), ("c", "Cy", "Ko")],
    )
    return stored, staged


def _changes(df):
    return {(r.entity, r.change): r.rows for r in df.collect()}


def test_apply_keeps_all_columns_and_is_idempotent(sides):
    stored, staged = sides
    after, made = apply_import(stored, staged)
    assert _changes(made) == {
        ("Person", "ADD"): 1, ("Person", "UPDATE"): 1, ("Place", "ADD"): 1, ("PersonName", "ADD"): 2, ("Family", "UPDATE"): 1, ("FamilyChild", "ADD"): 1, ("ParentOf", "ADD"): 1,
        ("Event", "UPDATE"): 1, ("Event", "ADD"): 1, ("EventCitation", "REPLACE"): 2,
    }
    for part in ("person", "name", "parent", "family", "event", "citation", "family_child"):
        assert getattr(after, part).columns == getattr(stored, part).columns
    assert {(r.person_id, r.display_name, r.given_name) for r in after.person.collect()} == {("a", "A2", "Ann"), ("b", "B", None), ("gone", "G", None), ("c", "C", "Cy")}
    assert {(r.person_id, r.event_key, r.date_raw, r.related_id, r.family_id, r.row_id) for r in after.event.collect() if r.event_key in ("k1", "k9")} == {("a", "k1", "1801", None, None, "1"), ("c", "k9", "1825", None, "f1", "s3")}
    assert {(r.person_id, r.source_origin, r.source_ref) for r in after.citation.collect()} == {("a", "GEDCOM", "new"), ("a", "MANUAL", "kept"), ("c", "GEDCOM", "new"), ("gone", "GEDCOM", "lost")}
    assert [r.is_primary for r in after.name.filter("surname = 'Kova'").collect()] == [False]
    assert _changes(apply_import(after, staged)[1]) == {("EventCitation", "REPLACE"): 2}
    assert ("Event", "UPDATE") not in _changes(imports.preview(after, staged))


def test_delete_missing_takes_all_that_refers(sides):
    after, made = apply_import(*sides, delete_missing=True)
    got = _changes(made)
    assert {k[0]: v for k, v in got.items() if k[1] == "DELETE"} == {"Person": 1, "Family": 1, "FamilyChild": 1, "ParentOf": 1, "Event": 2}
    assert not [r for r in after.citation.collect() if r.source_ref == "lost"] and after.event.filter("event_key = 'k2'").count() == 0


def test_guards(spark, sides):
    stored, staged = sides
    batches = spark.createDataFrame([("b1", "t", "STAGED", "c"), ("b2", "t", "APPLIED", "a"), ("b3", "t", "PREVIEWED", "gone")], "import_batch_id string, tree_id string, status string, root_person_id string")
    trees = spark.createDataFrame([("t", "gone"), ("u", "x")], "tree_id string, root_person_id string")
    for batch, delete in (("none", False), ("b2", False), ("b3", True)):
        with pytest.raises(Refused):
            apply_batch(stored, staged, batches, trees, batch, delete)
    done = apply_batch(stored, staged, batches, trees, "b1", True)
    assert {r.tree_id: r.root_person_id for r in done.trees.collect()} == {"t": "c", "u": "x"}
    assert {r.import_batch_id: r.status for r in done.batches.collect()} == {"b1": "APPLIED", "b2": "APPLIED", "b3": "PREVIEWED"}


def test_each_cited_date_counts(spark):
    people = [("p", "P", None), ("q", "Q", None)]
    events = [("p", "k1", "BIRT", "1800", None, None, None, "1"), ("p", "k2", "BIRT", "1810 ", None, None, None, "2"), ("q", "k3", "BIRT", "1810", None, None, None, "3"), ("q", "k4", "DEAT", "1850", None, None, None, "4")]
    names = [("p", "Ann", "Ko"), ("q", "Ann", "Ko")]
    side = _side(spark, people, [], [], [], events, [("p", "k1", "GEDCOM", "s"), ("p", "k2", "GEDCOM", "s"), ("q", "k3", "GEDCOM", "s")], names)
    pairs = spark.createDataFrame([("t", "p", "q")], "tree_id string, id1 string, id2 string")
    row = sourced_evidence(pairs, sourced_dates(side), sourced_dates(side)).first()
    assert (row.agree, row.conflict) == (1, 1) and row.conflict_text == "source-backed BIRT dates differ: 1800 vs 1810"
    assert duplicates(side).count() == 0  # the conflict takes a whole point
    calm = _side(spark, people, [], [], [], events, [], names)
    assert [(r.id1, r.id2, float(r.score)) for r in duplicates(calm).collect()] == [("p", "q", 0.875)]
    assert duplicates(calm, side).count() == 2


def test_rejection_needs_the_whole_identity(spark):
    schema = "import_batch_id string, candidate_scope string, import_tree_person_id1 string, import_tree_person_id2 string, existing_tree_person_id string, status string"
    stored = spark.createDataFrame([("b", "within_import", "X", "y", None, "rejected"), ("b", "within_import", "x", "w", None, "stale"), ("c", "within_import", "x", "z", None, "suggested")], schema)
    fresh = spark.createDataFrame([("b", "within_import", "x", "y", None, None), ("b", "within_import", "x", "z", None, None)], schema)
    got = {(r.import_batch_id, r.import_tree_person_id2, r.status) for r in regenerate(stored, fresh).collect()}
    assert got == {("b", "y", "rejected"), ("c", "z", "suggested"), ("b", "z", "suggested")}
