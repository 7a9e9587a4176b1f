import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm.lookalike import Folder, UnionFind, frequencies, lookalike_classes, lookalike_pairs, native, normalize

F = Folder({})
SAME = [
    ("abc", "ａｂｃ"), ("é", "é"), ("fix", "ﬁx"), ("a b", "a b"), ("ab", "a​b"), ("pace", "расе"),
    ("ë", "ё"), ("ë", "ё"), ("x-y", "x‑y"), ("a\nb", "a\r\nb"), ("a\nb", "a  \nb "), ("Å", "Å"),
    ("a b", "a　b"), ("é", "ｅ́"), ("co­op".replace("­", ""), "co­op"),
]
APART = [("m2", "m²"), ("a", "A"), ("e", "é"), ("1", "l"), ("0", "O"), ("ß", "ss"), ("①", "1"), ("½", "1/2"), ("k", "κ")]


def test_same_and_apart():
    for a, b in SAME:
        assert F.form(a) == F.form(b), (a, b)
    for a, b in APART:
        assert F.form(a) != F.form(b), (a, b)


def test_union_find_is_transitive():
    u = UnionFind()
    u.join("a", "b"), u.join("c", "d"), u.join("b", "c")
    assert len({u.find(x) for x in "abcd"}) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé̈ \n\t\rﬁｅоО‍🙂🏽m²­ёй台"), max_size=12), max_size=6))
def test_table_equals_automaton(texts):
    fast = [a.tobytes().decode("utf-32-le") for a in F.forms(texts)]
    assert fast == [F.form(t) for t in texts]
    assert [F.form(t) for t in fast] == fast


def test_frequency_chooses_the_representative():
    assert Folder({"а": 9, "a": 8}).form("pace") == "pаce" and Folder({"а": 8, "a": 8}).form("а") == "a"
    assert Folder({"а": 9}).form("á") == Folder({"а": 9}).form("а́") and Folder({"\u00a0": 9}).form("a\u00a0b") == "a b"
    assert Folder({"µ": 1, "μ": 9}).form("µ") == "μ"
    assert Folder({"µ": 9, "μ": 1}).form("μ") == "µ"


def test_words_of_other_scripts_stay_in_them():
    for t in ("Согласно разделу, урожай ещё вырос", "Σύμφωνα με την ενότητα, ο χρόνος", "In 2008 году Skírför Agency"):
        assert native(F.form(t)).replace("B ", "В ") == t or t.startswith("Σ")
    assert native(F.form("Комитет")) == "Комитет" == native(F.form("Koмитeт")) and native("paper") == "paper" == native(F.form("рареr"))
    assert native("Kж") == "Кж" and native("Rж") == "Rж"


def brute(rows):
    ids = {}
    for i, t in rows:
        if i is not None and t is not None and F.form(t):
            ids.setdefault(i, t)
    return sorted((a, b) for a, b in itertools.combinations(sorted(ids), 2) if ids[a] != ids[b] and F.form(ids[a]) == F.form(ids[b]))


def test_pairs_against_brute_force(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, None), (5, ""), (6, "​"), (7, " "), (8, "аbc"), (9, "abd"), (9, "abd"),
            (10, "x" * 50000), (11, "x" * 49999 + "х"), (None, "abc")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, form string")
    assert sorted(map(tuple, lookalike_pairs(df).collect())) == brute(rows)
    assert lookalike_pairs(df.limit(0)).count() == lookalike_classes(df.limit(0)).count() == 0
    links = {r.doc_id: (r.class_id, r.links) for r in lookalike_classes(df).collect()}
    want = {i: sum(i in p for p in brute(rows)) for i in {x for p in brute(rows) for x in p}}
    assert {i: n for i, (_, n) in links.items()} == want and links[1][0] == links[8][0] != links[10][0]
    assert {chr(r.cp): r.n for r in frequencies(df.filter("doc_id < 9")).collect()}["b"] == 4
    out = {r.doc_id: r.form for r in normalize(df, "text", "form").collect() if r.doc_id}
    assert out[4] is None and out[5] == "" and out[2] == "abc"
