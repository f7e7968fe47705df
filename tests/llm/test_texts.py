"""Leaked passages and truncated texts against plain code."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm.leaks import MIN_WORDS, ONE_IN, LeakIndex, leaks, longest_passage, words
from kinweave.llm.truncation import judged, length_spikes, truncation_rates

ITEM = "Why would the auditor hide 16 lenient foreign sealed charters from the stained lowland travelling herald keep the dubious neglected vintage rota on display and still date it"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=0, max_size=70))
def test_longest_passage(draws):
    equal = [x > 0 for x in draws]
    best = max((b - a for a in range(len(equal)) for b in range(a + MIN_WORDS, len(equal) + 1) if ONE_IN * sum(not x for x in equal[a:b]) <= b - a), default=None)
    got = longest_passage(equal)
    assert (got and got[1] - got[0]) == best
    assert got is None or got[2] == sum(not x for x in equal[got[0] : got[1]])


def test_words_and_offsets():
    text = "«Ab» c​d\x00e, trans-\nlated; ﬁn 5th"
    w, spans = words(text)
    assert w == ["ab", "cde", "translated", "fin", "5th"]
    assert [text[a:b].lower()[:1] for a, b in spans] == ["a", "c", "t", "ﬁ", "5"]


def test_leaks(spark):
    w = ITEM.split()
    typo = [x + "q" if k in (5, 14) else x for k, x in enumerate(w[:20])]
    worse = [x + "q" if k in (3, 8, 13, 18) else x for k, x in enumerate(w[:20])]
    docs = [(1, "Before. " + ITEM.upper() + " after"), (2, " ".join(w[3:21])), (3, " ".join(w[:15]) + " end of it"), (4, "x " + ",\n".join(typo)), (5, " ".join(worse)), (6, None), (7, ""), (8, "short"), (1, "Before. " + ITEM.upper() + " after"), (9, ("filler words go here " * 4000) + ITEM)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, "en"), (8, None, "en"), (9, "too short", "en"), (7, ITEM, "en")], "item_id long, text string, lang string")
    rows = {(r.doc_id, r.item_id): r for r in leaks(d, items).collect()}
    assert set(rows) == {(1, 7), (2, 7), (4, 7), (9, 7)}
    assert (rows[4, 7].words, rows[4, 7].altered, rows[2, 7].words) == (20, 2, 18)
    text = docs[0][1]
    assert text[rows[1, 7].begin : rows[1, 7].end] == ITEM.upper()
    assert leaks(d.limit(0), items).count() == 0 and leaks(d, items.limit(0)).count() == 0


def test_index_travels():
    import pickle

    a = LeakIndex([(1, ITEM)])
    b = pickle.loads(pickle.dumps(a))
    assert list(a.passages(ITEM)) == list(b.passages(ITEM)) != []


WHOLE = ["All is said.", 'Who knows "Koval, 1754"?', "Said.\n0 TRLR", "Said.\nVarvara Chibrishakhyshyn", "Said.\n(Varvara Muvok)", "Said.\n«Tekla Beso»", "Said.\nfol. 170v", "Said.\n6.4.1890", "Said.\nAmen", "Said.\n* * *", "Lost [illegible].", "Said. [illegible]", "Said.\nN.N.", "Said. \n\n​", "Said.»"]
CUT = ["The cow called ", "In 1786 a fire", "Said. A", "Name is lost [", "The ho…", "The ho...", "Said. My [...]", "See F. 746, op.", "See F.", "2 PLAC Habry", "in the �", "sold it for 22 roub", "photograph labelled \"Tas", "Said.\n(Varvara Muv", "Said.\nfol. 17", "Said.\n6.4.18", "one, two,"]


def test_endings(spark):
    rows = [(k, t, f"s{k}") for k, t in enumerate([*WHOLE, *CUT, None, "", " \n​"])]
    got = {r.doc_id: r.truncated for r in judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [WHOLE[k] for k in range(len(WHOLE)) if got[k]] == []
    assert [CUT[k] for k in range(len(CUT)) if not got[len(WHOLE) + k]] == []
    assert not any(got[k] for k in range(len(WHOLE) + len(CUT), len(rows)))


def test_long_last_lines(spark):
    rows = [(1, "Said.\n(" + "very " * 300 + "long)"), (2, "Said.\n(" + "very " * 300 + "long"), (3, "[" + "very " * 300 + "long]"), (4, "(\n" + "very " * 300 + "long)")]
    got = {r.doc_id: r.truncated for r in judged(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_spikes(spark):
    random.seed(6)
    rows = [(k, "w" * random.randrange(20, 99) + ".", "limited") for k in range(100)]
    rows += [(100 + k, "s" * 80 + ".\n" + "Oksana " + "K" + "o" * 11, "limited") for k in range(6)]
    rows += [(200 + k, "s" * 80 + ".\n" + "Oksana " + "K" + "o" * 11, None if k else "free") for k in range(2)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n int")
    spikes = length_spikes(docs).collect()
    assert {(r.source, r.unit, r.length) for r in spikes} == {("limited", "chars", 101), ("limited", "bytes", 101)}
    got = {r.doc_id for r in judged(docs).filter("truncated").collect()}
    assert got == {100 + k for k in range(6)}  # a name at the limit may be cut, elsewhere it closes the text
    assert {r.source: r.truncated for r in truncation_rates(docs).collect()} == {"limited": 6, "free": 0, None: 0}
    assert judged(docs.limit(0)).count() == 0
