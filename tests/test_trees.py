"""Traversals over a small tree with a loop, against hand-worked results."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import graphs, trees
from kinweave.operators.evidence import Facets, Limits, accept_on_mentions, blobs_of_files, decide_links, decoded_blobs, orphan_contents, persist_candidates, search_records, store_attachments, suggest_links
from kinweave.operators.imports import apply_import, cancel, duplicates, preview
from kinweave.operators.merges import merge_snapshot, or_equi_join
from kinweave.plans.adapters import Workspace
from kinweave.plans.import_queries import snapshots

EDGES = [("gp", "fa"), ("gm", "fa"), ("gp", "au"), ("fa", "ch"), ("mo", "ch"), ("fa", "si"), ("x", "y"), ("y", "z"), ("z", "x")]
PEOPLE = sorted({p for e in EDGES for p in e} | {"lone"})


@pytest.fixture(scope="module")
def ws(spark):
    person = spark.createDataFrame([("t", p, f"@{p}@", "M" if p in ("gp", "fa") else "F", None, p.upper(), p, p, None) for p in PEOPLE], "tree_id string, person_id string, external_id string, sex string, is_living boolean, display_name string, surname_normalized string, given_name string, birth_year short")
    name = spark.createDataFrame([(k, "t", p, "LAT", "birth", p, p, f"{p} Name%_", f"{p} name%_", True) for k, p in enumerate(PEOPLE)], "person_name_id long, tree_id string, person_id string, script_code string, name_type string, given string, surname string, full_name string, full_name_normalized string, is_primary boolean")
    ev = "event_id long, external_event_key string, tree_id string, person_id string, event_type string, event_value string, date_raw string, date_from date, date_to date, year_from short, year_to short, place_raw string, place_normalized string, related_id string, is_derived boolean"
    rows = [(1, "k1", "t", "fa", "CHR", None, "1919", None, None, 1919, 1919, "P", "p", None, False), (2, "k2", "t", "fa", "BIRT", None, "1920", None, None, 1920, 1920, "Q", "q", None, False), (3, None, "t", "fa", "DEAT", None, "1990", None, None, 1990, 1990, None, None, None, False), (4, None, "t", "fa", "OCCU", "smith", None, None, None, None, None, None, None, None, False)]
    event = spark.createDataFrame(rows, ev)
    parent = spark.createDataFrame([("t", a, b) for a, b in EDGES], "tree_id string, parent_id string, child_id string")
    family = spark.createDataFrame([("t", "fa", "mo", 1950, "P", "fa+mo")], "tree_id string, spouse1_id string, spouse2_id string, marriage_year int, marriage_place string, family_id string")
    return Workspace(spark.createDataFrame([("t", "Tree")], "tree_id string, name string"), person, name, event, parent, family, spark.createDataFrame([(1, "P", "p")], "place_id long, place_raw string, place_normalized string"))


def test_walks(ws):
    up = {(r.person_id, r.ancestor_id, r.generation) for r in graphs.ancestors(ws).collect()}
    assert {x for x in up if x[0] == "ch"} == {("ch", "fa", 1), ("ch", "mo", 1), ("ch", "gp", 2), ("ch", "gm", 2)}
    assert {x[1] for x in up if x[0] == "x"} == {"y", "z"}
    assert {(r.descendant_id, r.generation) for r in graphs.descendants(ws).collect() if r.ancestor_id == "gp"} == {("fa", 1), ("au", 1), ("ch", 2), ("si", 2)}
    born = {r.ancestor_id: r.birth_year for r in graphs.ancestors(ws).collect()}
    assert born["fa"] == 1920  # BIRT goes before CHR
    roots = {r.person_id for r in graphs.person_tree(ws, True, 0).collect()}
    assert roots == set(PEOPLE)
    assert {(r.person_id, r.generation) for r in graphs.nearest(ws.parent, False, 9).collect() if r.start_id == "x"} == {("y", 1), ("z", 2)}


def test_closure_against_plain_search(ws):
    kids = defaultdict(set)
    for a, b in EDGES:
        kids[a].add(b)
    want = set()
    for a in PEOPLE:
        todo = [a]
        seen = set()
        while todo:
            for k in kids[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        want |= {(a, k) for k in seen if k != a}
    assert {(r.ancestor_id, r.descendant_id) for r in graphs.closure(ws.parent).collect()} == want


def test_pairs(ws, spark):
    pairs = spark.createDataFrame([("t", "p1", "ch", "au"), ("t", "p2", "ch", "lone"), ("t", "p3", "ch", "ch"), ("t", "p4", "ch", "fa")], "tree_id string, pair_id string, a_id string, b_id string")
    got = {r.pair_id: (r.ancestor_id, r.depth_a, r.depth_b) for r in graphs.common_ancestors(ws, pairs).collect()}
    assert got == {"p1": ("gp", 2, 1), "p3": ("ch", 0, 0), "p4": ("fa", 1, 0)}
    ways = {r.pair_id: (r.steps, r.relations) for r in graphs.paths_between(ws, pairs).collect()}
    assert ways == {"p1": (3, "CHILD_OF>CHILD_OF>PARENT_OF"), "p4": (1, "CHILD_OF")}


def test_year_and_scope(ws, spark):
    rows = graphs.descendants_at_year(ws, 1985).collect()
    assert [r.role for r in rows if r.person_id == "mo" and r.ancestor_id == "gp"] == ["SPOUSE"]
    assert not [r for r in graphs.descendants_at_year(ws, 1995).collect() if r.person_id == "fa"]
    scope = {r.person_id: r.scope for r in graphs.validate_scope(ws, spark.createDataFrame([("t", "si")], "tree_id string, root_id string")).collect()}
    assert scope["gp"] == scope["ch"] == "BLOOD" and scope["mo"] == "SPOUSE" and scope["lone"] == scope["x"] == "INVALID"


def test_context_and_search(ws):
    assert {r.sibling_id for r in trees.rich_siblings(ws).collect() if r.person_id == "ch"} == {"si"}
    assert {(r.child_id, r.other_parent_id) for r in trees.rich_children(ws).collect() if r.person_id == "fa"} == {("ch", "mo"), ("si", None)}
    assert [r.event_type for r in trees.life_events(ws).orderBy("position").collect()] == ["CHR", "BIRT", "DEAT", "OCCU"]
    assert {r.person_id for r in trees.search_by_name(ws, "name%_").collect()} == set(PEOPLE)
    assert trees.search_by_name(ws, "n_me").count() == 0 and trees.search_by_name(ws, " ").count() == 0
    assert [r.person_id for r in trees.find_persons(ws, "ch", father="fa", mother="mo").collect()] == ["ch"]
    assert trees.find_persons(ws, "fa", year_from=1921).count() == 0
    assert trees.resolve_person(ws, "fa").first().is_exact


def test_merge_and_or_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "new"), (4, "d")], "k int, v string")
    merged, counts = merge_snapshot(a, b, ["k"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "x"), (2, None), (3, "new"), (4, "d")]
    assert {r.change: r.rows for r in counts.collect()} == {"ADD": 1, "UPDATE": 1}
    left = spark.createDataFrame([(1, "a", "p"), (2, None, "q")], "i int, x string, y string")
    right = spark.createDataFrame([(7, "a", "p"), (8, None, "q")], "j int, u string, w string")
    assert sorted((r.i, r.j) for r in or_equi_join(left, right, [[("x", "u")], [("y", "w")]], ["i", "j"]).collect()) == [(1, 7), (2, 8)]


def test_import_cycle(spark):
    stored, staged = snapshots(spark, "/root/testdata/sf0.001")
    after, first = apply_import(stored, staged)
    assert {(r.entity, r.change) for r in first.collect()} >= {("Person", "ADD"), ("Person", "UPDATE"), ("Place", "ADD")}
    again = {r.entity: r.rows for r in preview(stored, stored).collect()}
    assert set(again) <= {"EventCitation", "Event", "Place"}  # stored places that the list lacks stay to be added
    assert apply_import(stored, stored)[1].filter("entity in ('Person', 'Family', 'ParentOf', 'PersonName', 'Event')").count() == 0


def test_duplicate_scores(spark):
    stored, staged = snapshots(spark, "/root/testdata/sf0.001")
    rows = duplicates(staged).collect()
    assert all(0.75 <= r.score <= 1 and r.id1 < r.id2 for r in rows)
    batches = spark.createDataFrame([("a", "STAGED", None), ("b", "APPLIED", "n")], "import_batch_id string, status string, notes string")
    out = {r.import_batch_id: (r.status, r.notes) for r in cancel(batches, batches.select("import_batch_id"), "why").collect()}
    assert out == {"a": ("CANCELLED", "why"), "b": ("APPLIED", "n")}


def test_links_and_attachments(spark):
    m = spark.createDataFrame([("m1", "t", "Ko", "Ivan", 1850)], "person_mention_id string, tree_id string, surname string, given_name string, estimated_birth_year short")
    p = spark.createDataFrame([("t", "a", "ko", "Ivan", 1851), ("t", "b", "ko", "Iva", 1900), ("u", "c", "ko", "Ivan", 1850)], "tree_id string, person_id string, surname_normalized string, given_name string, birth_year short")
    got = [(r.person_id, float(r.score)) for r in suggest_links(m, p).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.65)]
    stored = spark.createDataFrame([("m1", "a", "rejected", 0.1)], "person_mention_id string, person_id string, status string, score double")
    assert {r.person_id: r.action for r in persist_candidates(suggest_links(m, p), stored).collect()} == {"a": "skip", "b": "insert"}
    c = spark.createDataFrame([("m1", "a", "suggested"), ("m1", "b", "suggested")], "person_mention_id string, person_id string, status string")
    assert {r.person_id: r.status for r in decide_links(c, c.filter("person_id = 'a'"), c.limit(0)).collect()} == {"a": "accepted", "b": "superseded"}
    pdf = bytearray(b"%PDF-1")
    blobs = spark.createDataFrame([("r1", pdf, 1), ("r2", pdf, 1), ("r1", bytearray(b"text"), 2), ("r1", bytearray(b""), 3), ("r1", bytearray(b"%PDF-22"), 4)], "source_record_id string, content binary, sequence_no int")
    contents, links, rejected = store_attachments(blobs, Limits(record_bytes=10))
    assert contents.count() == 1 and links.count() == 2
    assert sorted(r.reason for r in rejected.collect()) == ["empty", "quota", "type not accepted"]
    assert orphan_contents(contents, links.limit(0)).count() == 1


def test_link_pool_is_whole(spark):
    random.seed(7)
    surnames, given = ["ko", "Koval", "kovalenko", " boiko", "boi", None, ""], ["Ivan", "Iva", "van", "Olena", "Ole", None, " "]
    pick = lambda n: [(random.choice("tu"), f"{k:03}", random.choice(surnames), random.choice(given), random.choice([None, 1850, 1851, 1853, 1857, 1870])) for k in range(n)]
    people, typed = pick(150), pick(60)
    m = spark.createDataFrame(typed, "tree_id string, person_mention_id string, surname string, given_name string, estimated_birth_year short")
    p = spark.createDataFrame(people, "tree_id string, person_id string, surname_normalized string, given_name string, birth_year short")
    plain = lambda x: (x or "").strip().lower()

    def text(a, b, exact, partial):
        return 0 if not a or not b else exact if a == b else partial if a in b or b in a else 0

    def year(a, b):
        return 0 if a is None or b is None else next((v for d, v in ((1, 20), (3, 10), (7, 5)) if abs(a - b) <= d), 0)

    for top in (2, 10):
        want = set()
        for t, i, s, g, y in typed:
            s, g = plain(s), plain(g)
            pool = [(-text(s, plain(s2), 50, 25) - text(g, plain(g2), 30, 15) - year(y, b), j) for t2, j, s2, g2, b in people if t == t2 and ((s and s in plain(s2)) or (g and g in plain(g2)))]
            want |= {(i, j, -v, r) for r, (v, j) in enumerate(sorted(pool)[:top], 1)}
        assert {(r.person_mention_id, r.person_id, int(r.score * 100), r.rank) for r in suggest_links(m, p, top).collect()} == want


def test_walk_tells_ids_that_contain_each_other(spark):
    edges = spark.createDataFrame([("t", "222", "111"), ("t", "11", "222"), ("t", "1", "11"), ("t", "111", "1")], "tree_id string, parent_id string, child_id string")
    got = {(r.person_id, r.generation) for r in graphs.walk(edges, True, 9).filter("start_id = '111'").collect()}
    assert got == {("222", 1), ("11", 2), ("1", 3)}


def test_accepted_links_and_blob_channels(spark):
    m = spark.createDataFrame([("m1", "unlinked"), ("m2", "unlinked")], "person_mention_id string, status string")
    link = spark.createDataFrame([("m1", "p", 0.5)], "person_mention_id string, person_id string, score double")
    assert {tuple(r) for r in accept_on_mentions(m, link).select("person_mention_id", "status", "accepted_person_id", "link_confidence").collect()} == {("m1", "accepted", "p", 0.5), ("m2", "unlinked", None, None)}
    texts = spark.createDataFrame([("r", "JVBERi0=", 1), ("r", "!!", 2), ("r", "QUFB" * 9, 3), ("r", None, 4)], "source_record_id string, base64 string, sequence_no int")
    good, bad = decoded_blobs(texts, Limits(base64_bytes=12))
    assert {(r.sequence_no, bytes(r.content)) for r in good.collect()} == {(1, b"%PDF-"), (4, b"")} and {(r.sequence_no, r.reason) for r in bad.collect()} == {(2, "no base64"), (3, "too large")}
    files = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "source_record_id string, path string, sequence_no int")
    good, bad = blobs_of_files(files, spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary"))
    assert [r.sequence_no for r in good.collect()] == [1] and [r.sequence_no for r in bad.collect()] == [2]


def test_search_facets_of_known_columns(spark):
    rows = [("r1", "births", "t", "Київ", None, "12", "T1"), ("r2", None, None, None, "st. Anna", "21", "t1 "), ("r3", None, "births", "Львів", None, None, None)]
    records = spark.createDataFrame(rows, "source_record_id string, title string, text string, place_text string, church_text string, fond string, tree_id string").withColumn("created_at", F.current_timestamp())
    people = spark.createDataFrame([], "source_record_id string, surname string, given_name string, role string, status string")
    places = spark.createDataFrame([("r3", "Anna-hof", None)], "source_record_id string, place_text string, normalized_name string")
    run = lambda **f: {r.source_record_id for r in search_records(records, people, places, Facets(**f)).collect()}
    assert run(free_text="BIRTH") == {"r1", "r3"} and run(place="anna") == {"r2", "r3"} and run(place="київ") == {"r1"}
    assert run(fond="1") == {"r1", "r2"} and run(tree_id="T1", fond="2", free_text="t") == {"r1"} and run(tree_id="T1") == {"r1", "r2"}
    with pytest.raises(Exception, match="opis"):
        run(opis="1")
