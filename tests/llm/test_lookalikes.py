import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloka.llm import lookalikes as L

COLS = "row_id long, text string, raw_text string, field string, value string, vh int"


@pytest.mark.parametrize("a, b, same", [
    ("Malang", "Mаlаng", True), ("Rp80", "Ｒｐ８０", True), ("paǌang", "panjang", True), ("crème", unicodedata.normalize("NFD", "crème"), True),
    ("so­to", "soto", True), ("a b", "a b", True), ("Οpen", "Open", True), ("nasi", "Nasi", False), ("creme", "crème", False), ("a b", "ab", False), ("nasi ", "nasi", False),
    ("👨‍👩‍👧", "👨👩👧", False), ("ти", "tu", False), ("รสน้ำ", "รสน้ำ", True),
])
def test_fold(a, b, same):
    assert (L.fold(a) == L.fold(b)) is same
    assert L.fold(L.fold(a)) == L.fold(a)


def test_trie_costs():
    t = L.Trie()
    for w, n in (("bakso", 5), ("bakмi", 1), ("soto", 2)):
        t.add(w, n)
    assert t.search("bаkѕo") == [(0, "bakso", 5)]
    assert t.search("ba​kso") == [(0, "bakso", 5)]
    assert t.search("bakzo") == [] and t.search("bakzo", 1) == [(1, "bakso", 5)]
    assert sorted(t.search("sotto", 1)) == [(1, "soto", 2)]
    assert t.search("bamso") == [] and sorted(t.search("bako", 2)) == [(1, "bakso", 5), (2, "bakмi", 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aeoаеоéï\u0301\u0308і\u200b\u200d\ufe0f👨👩❤ﬀｋǌ1️ぎき\u3099"), max_size=8).map("".join), st.lists(st.sampled_from("aoаéе\u0301\u200dﬀf👨"), max_size=5).map("".join))
def test_cost_nothing_is_looking_the_same(x, y):
    t = L.Trie()
    t.add(y, 1)
    t.add(x, 1)
    assert x in {h[1] for h in t.search(x)}
    assert (y in {h[1] for h in t.search(x)}) is (L.fold(x) == L.fold(y))


@settings(max_examples=200, deadline=None)
@given(st.text("abаο", max_size=5), st.text("abaо\u200b", max_size=5))
def test_costs_are_edit_distances(x, y):
    t = L.Trie()
    t.add(y, 1)
    a, b = L.fold(x), L.fold(y)
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, k in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != k)))
        row = new
    assert t.search(x, 2) == ([(row[-1], y, 1)] if row[-1] <= 2 else [])


def test_pairs_against_brute_force(spark):
    texts = ["Enak di Malang", "Enаk di Malang", "Enak di Malang", "enak di Malang", "Рядом есть суп", "Рядoм ecть cуп", "Рядом есть cуп", "с", "c", "é" * 3, unicodedata.normalize("NFD", "é" * 3), "", None, "​", "Enak di Malang", "x" * 50_000, "x" * 49_999 + "​x", "a\nb", "a\n​b"]
    rows = [(i, t, t if i % 2 else None, "f", "v", 0) for i, t in enumerate(texts)]
    got = {(r["row_id_a"], r["row_id_b"], r["field"]) for r in L.found(spark.createDataFrame(rows, COLS), ["text", "raw_text"]).collect()}
    want = set()
    for k, f in ((1, "text"), (2, "raw_text")):
        have = [(r[0], r[k]) for r in rows if r[k]]
        want |= {(a, b, f) for a, x in have for b, y in have if a < b and x != y and L.fold(x) == L.fold(y)}
    assert got == want


def test_canonical_spellings(spark):
    rows = [(1, "bakso enak", None, "", "", 0), (2, "bаkso enak", None, "", "", 0), (3, "Рядом суп", None, "", "", 0), (4, "Рядoм суп", None, "", "", 0), (5, "ｘｙｚ  ok", None, "", "", 0)]
    got = {r["row_id"]: r["canon"] for r in L.canonical(spark.createDataFrame(rows, COLS), ["text", "raw_text"]).collect()}
    assert got[1] == got[2] == "bakso enak" and got[3] == got[4] == "Рядом суп" and got[5] == "xyz  ok"


def test_empty(spark):
    e = spark.createDataFrame([], COLS)
    assert L.found(e, ["text", "raw_text"]).count() == 0 and L.canonical(e, ["text"]).count() == 0
