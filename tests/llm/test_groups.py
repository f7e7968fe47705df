"""Components and survivors against plain code."""

import datetime as dt
import random

import pytest

from kinweave.llm import components, survivors
from kinweave.llm.components import connected_components
from kinweave.llm.survivors import date_parts, duplicate_values, name_tokens, progressive


def _plain(pairs):
    clean = lambda x: (x or "").strip().lower() or None
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = clean(a), clean(b)
        for x in (a, b):
            if x:
                root.setdefault(x, x)
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("peel", [2, 6])
def test_components(spark, monkeypatch, peel):
    monkeypatch.setattr(components, "PEEL_ROUNDS", peel)
    random.seed(peel)
    chain = [f"c{random.randrange(10**6)}" for _ in range(60)]
    pairs = [*zip(chain, chain[1:]), *[("hub", f"leaf{k}") for k in range(40)], ("LEAF3 ", chain[7]), ("a", "A"), ("z", None), (None, "y"), (None, None), ("", "w"), ("p", "q"), ("q", "p"), ("p", "q")]
    pairs += [(f"r{random.randrange(60)}", f"r{random.randrange(60)}") for _ in range(40)]
    df = spark.createDataFrame([(a, b, "s", "t") for a, b in pairs], "a string, b string, s string, l string")
    assert {r.id: r.group for r in connected_components(df, "a", "b").collect()} == _plain(pairs)


def test_ordered_chain_takes_few_rounds(spark, monkeypatch):
    least = []
    plain = components.Scratch.save
    monkeypatch.setattr(components.Scratch, "save", lambda self, df: (least.append("m") if {"v", "l", "n"} == set(df.columns) else None, plain(self, df))[1])
    n = 10_000
    chain = spark.range(n - 1).selectExpr("lpad(id, 6, '0') as a", "lpad(id + 1, 6, '0') as b")
    got = connected_components(chain, "a", "b")
    assert got.count() == n and [r.group for r in got.select("group").distinct().collect()] == ["000000"]
    # two such tables a round
    assert len(least) <= 2 * 20


def test_components_edge_cases(spark):
    df = spark.createDataFrame([("a", None), ("a", "a")], "a string, b string")
    assert [tuple(r) for r in connected_components(df, "a", "b").collect()] == [("a", "a")]
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_name_order():
    keys = lambda n: [k for k, _ in name_tokens(n)]
    full = keys("Григорій Михайлович Чивубробрак")
    for n in ("Чивубробрак Григорій Михайлович", "ЧИВУБРОБРАК Григорій Михайлович", "Чивубробрак, Григорій Михайлович", "Hryhorii Mykhailovych Chyvubrobrak"):
        assert keys(n) == full
    assert keys("Чивубробрак Г.") == ["h.", full[2]] and keys("[...] Михайлович Чивубробрак")[0] == "*"
    assert keys("") == keys(None) == []
    assert date_parts("25.02.1872") == date_parts("25 лютого 1872") == date_parts("1872-02-25") == {"day": "25", "month": "2", "year": "1872"}
    assert date_parts("ABT 1872") == date_parts("BET 1870 AND 1872") == date_parts("бл. 1872") == date_parts(None) == {}
    assert date_parts("DEC 1744") == {"month": "12", "year": "1744"}


def test_progressive_order_does_not_matter():
    values = ["Іван Петрович Коваль", "І. П. Коваль", "? Коваль", "Іван Коваль", "Коваль І."]
    p = []
    for n, v in enumerate(values):
        own = name_tokens(v)
        p.append([{k: ((-survivors.completeness("name", own), 1, n, "s"), 1)} for k, _ in own])
    assert progressive(p) == progressive(p[::-1])
    assert survivors.consensus(progressive(p)) == ["ivan", "petroviC", "koval"]


@pytest.mark.parametrize("chunk", [2, 256])
def test_survivors(spark, monkeypatch, chunk):
    monkeypatch.setattr(survivors, "CHUNK", chunk)
    t = lambda d: dt.datetime(2025, 1, d)
    ev = lambda side, kind, date, place=None, cited=False: (side, kind, date, place, cited)
    rows = [
        ("E1", "I1", "Іван Петрович Коваль", "Іван Коваль", t(1), None, [ev("existing", "BIRT", "1800"), ev("import1", "BIRT", "1800-05-01"), ev("import1", "MARR", "1820")]),
        ("e1", "I2", "Ivan Petrovych Koval", "Іван Коваль", t(2), t(9), [ev("import1", "BIRT", "1 MAY 1800", " ", True)]),
        ("e1", "I3", "Іван[?] Петрович Коваль", "Іван Коваль", t(3), t(30), None),
        ("e1", "I4", None, "Іван Коваль", None, None, []),
        ("e2", "I5", None, None, t(1), None, [ev("import1", "DEAT", None)]),
        ("e3", "I6", "Олена Іванівна Бик", "Бик, Олена Іванівна", t(1), None, None), ("e3", "I6", "Олена Іванівна Бик", "Бик, Олена Іванівна", t(1), None, None),
        (None, "I7", "x", "y", t(1), None, None),
    ]
    schema = "existing_tree_person_id string, import_tree_person_id1 string, import_person1_name string, existing_person_name string, created_at timestamp_ntz, updated_at timestamp_ntz, events array<struct<side string, event_type string, date_raw string, place_raw string, has_source_citation boolean>>, candidate_scope string, status string, value string, field string"
    df = spark.createDataFrame([(*r, "import_vs_tree", "suggested", "clash", "clash") for r in rows], schema)
    got = {(r.group, r.field): r.source for r in survivors.survivors(duplicate_values(df)).collect()}
    assert got == {("e1", "name"): "i2", ("e1", "birth"): "i2", ("e2", "name"): "e2", ("e2", "death"): "i5", ("e3", "name"): "e3"}
    assert survivors.survivors(duplicate_values(df.limit(0))).count() == 0


def test_consensus_decides(spark, monkeypatch):
    rows = [
        ("g", "name", "Іван Коваль", "e", 0, 1), ("g", "name", "Іван Петрович Коваль", "i1", 1, 2),
        ("h", "birth", "1800-05-01\x0100", "i1", 1, 9), ("h", "birth", "1801-05-01\x0100", "a2", 1, 5), ("h", "birth", "1801-05-01\x0100", "a3", 1, 4), ("h", "birth", "1800\x0111", "a1", 1, 99),
    ]
    df = spark.createDataFrame([(*r[:5], dt.datetime(2025, 1, 1) + dt.timedelta(days=r[5])) for r in rows], "group string, field string, value string, source string, imported int, at timestamp_ntz")
    run = lambda: {(r.group, r.field): r.source for r in survivors.survivors(df).collect()}
    # the finest date, then the vote of the latest row, against two rows that agree otherwise
    assert run() == {("g", "name"): "i1", ("h", "birth"): "i1"}
    monkeypatch.setattr(survivors, "consensus", lambda profile, parts=3: ["q1", "q2"] if parts == 3 else ["year:1801", "month:5", "day:1"])
    assert run() == {("g", "name"): "e", ("h", "birth"): "a2"}
