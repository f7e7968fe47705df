"""Orphan references and hierarchies against plain code, with odd input."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest

from kinweave.operators.hierarchy import descendants, forest, paths
from kinweave.operators.joins import counted_join
from kinweave.operators import runtime
from kinweave.operators.references import Parents, References, orphan_references, orphan_report

T = dt.datetime


def _orphans(spark, people, events):
    person = spark.createDataFrame(people, "tree_id string, person_id string, created_at timestamp_ntz, key string")
    event = spark.createDataFrame(events, "event_id long, tree_id string, ref string, created_at timestamp_ntz, salt int, parent string")
    return orphan_references([References(event, "e", "event_id", "ref", "p")], [Parents(person, "p", "person_id")])


def test_orphan_references(spark):
    old, new = T(2024, 1, 1), T(2025, 1, 1)
    people = [("t", "AB-1", old, "x"), ("t", "late", new, None), ("t", "nowhen", None, None), ("u", "other", old, None), (None, "notree", old, None), ("t", None, old, None)]
    events = [
        (1, "t", " ab1 ", old, 1, None), (2, "t", "late", old, 1, None), (3, "t", "other", old, 1, None), (4, "t", "@VOID@", old, 1, None), (5, "t", None, old, 1, None), (6, "t", " ", old, 1, None),
        (7, None, "ab1", old, 1, None), (8, "t", "late", None, 1, None), (9, "t", "nowhen", old, 1, None), (3, "t", "other", old, 1, None),
    ]
    out = _orphans(spark, people, events)
    assert sorted((r.record_id, r.reason) for r in out.collect()) == [("2", "later"), ("3", "missing"), ("7", "missing")]
    assert sum(r.orphans for r in orphan_report(out).collect()) == 3
    assert _orphans(spark, [], []).count() == 0
    assert _orphans(spark, [], events[:1]).count() == 1


def _expected(pairs):
    clean = lambda x: (x or "").strip().lower() or None
    parent = {}
    for a, b in pairs:
        a, b = clean(a), clean(b)
        for x in (a, b):
            if x:
                parent.setdefault(x, None)
        if a and b:
            parent[a] = min(filter(None, (parent[a], b)))
    out = {}
    for x in parent:
        seen, y = [x], x
        while parent[y] and parent[y] not in seen:
            y = parent[y]
            seen.append(y)
        out[x] = ("", -1) if parent[y] else (y, len(seen) - 1)
    return out


def test_forest_random(spark):
    random.seed(5)
    pairs = [(f"N{k}", f"n{random.randrange(k)}" if random.random() < 0.9 else None) for k in range(1, 80)]
    pairs += [(f"c{k}", f"c{k - 1}") for k in range(1, 40)]
    pairs += [("loop1", "loop2"), ("loop2", "loop3"), ("loop3", "loop1"), ("below", "loop2"), ("below2", "BELOW"), ("self", "self"), (None, "lone"), ("", "lone"), (None, None), pairs[3]]
    rows = spark.createDataFrame([(a, b, 7) for a, b in pairs], "person_id string, parent_person_id string, v int")
    f = forest(rows, "person_id", "parent_person_id")
    got = f.nodes.collect()
    assert {r.node: (r.root, r.depth) for r in got} == _expected(pairs)
    assert {r.node: r.state for r in got}["below2"] == "below_cycle" and {r.node: r.state for r in got}["self"] == "cycle"
    tree = {r.node: r for r in got if r.state == "tree"}
    below = {(r.node, r.descendant) for r in descendants(f).collect()}
    for x in tree.values():
        inside = {y.node for y in tree.values() if y.root == x.root and x.entry < y.entry and y.exit < x.exit}
        assert len(inside) == x.descendants and {(x.node, y) for y in inside} == {p for p in below if p[0] == x.node}
    way = {r.node: r.path for r in paths(f).collect()}
    assert way["c39"].split(">") == [f"c{k}" for k in range(40)] and way["loop1"] is None


def test_forest_empty(spark):
    rows = spark.createDataFrame([], "person_id string, parent_person_id string")
    f = forest(rows, "person_id", "parent_person_id")
    assert f.nodes.count() == 0 and paths(f).count() == 0


def test_counted_join(spark):
    rows = spark.createDataFrame([("a",)] * 500 + [("b",), ("c",), (None,)], "k string")
    values = spark.createDataFrame([("a", 1, 500), ("b", 2, 1)], "k string, v int, n long")
    got = sorted((r.k or "", r.v) for r in counted_join(rows, values, "k", "n").filter("k <> 'a' or k is null").collect())
    assert got == [("", None), ("b", 2), ("c", None)]
    assert counted_join(rows, values, "k", "n", "inner").count() == 501


def test_ids_with_the_separator(spark):
    rows = spark.createDataFrame([("a>b", "r"), ("c", "a>b")], "person_id string, parent_person_id string")
    got = {tuple(r) for r in descendants(forest(rows, "person_id", "parent_person_id")).select("node", "descendant", "distance").collect()}
    assert got == {("r", "a>b", 1), ("r", "c", 2), ("a>b", "c", 1)}


def test_descendants_of_wide_and_deep_trees(spark):
    pairs = [(f"k{k}", "root") for k in range(300)] + [(f"d{k}", f"d{k - 1}" if k else "k7") for k in range(60)]
    f = forest(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    got = descendants(f)
    assert got.count() == got.select("node", "descendant").distinct().count() == f.nodes.selectExpr("sum(depth)").first()[0]


def test_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        runtime.checkpoint_root(spark)
