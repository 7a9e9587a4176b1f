import random

from cellgrid.llm.scans import CONFUSIONS, LEAST, Lexicon, accepted, compact, distance, examine, fold, head_key, index_keys, page, page_number, strokes

WORDS = "the committee approved several hundred litres of reserve for storage racks near orchards with failures although measured operators long-term".split()


def lex():
    return Lexicon(fixes={("wifh", ""): "with"}, joins={("long", "term"): False, ("long", "tcrm"): False})


def best(word, n=1, f=500):
    """The lexicon word that a word is a misreading of, by the index and the distance."""
    found = [(accepted(word, n, c, f), c) for c in WORDS + ["moment", "information", "summarum"] if index_keys(word) & index_keys(c)]
    return min(((d, c) for d, c in found if d is not None), default=(None, None))[1]


def test_distance_and_fold():
    for a, b in CONFUSIONS:
        assert distance(f"qu{a}x", f"qu{b}x") <= 0.3
    assert distance("house", "mouse") == 1 and distance("abc", "abc") == 0
    for a, b in (("e", "c"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("w", "vv"), ("h", "b"), ("li", "h"), ("ri", "n"), ("a", "@"), ("s", "5")):
        assert fold(f"xx{a}yy") == fold(f"xx{b}yy"), (a, b)


def test_strokes_undo_every_confusion():
    for a, b in CONFUSIONS:
        assert strokes(f"qu{a}x") == strokes(f"qu{b}x"), (a, b)


def test_index_finds_planted_confusions():
    rnd = random.Random(1)
    for w in WORDS:
        if "-" in w or len(w) < 4:
            continue
        for a, b in CONFUSIONS:
            if a in w:
                at = rnd.choice([i for i in range(len(w)) if w.startswith(a, i)])
                assert best(w[:at] + b + w[at + len(a) :]) == w, (w, a, b)
    assert best("rnornent") == "moment" and best("inforrnafion") == "information" and best("surnrnarum") == "summarum" and best("falures") is None
    assert best("faillures") == "failures" and best("faillures", n=LEAST) is None and best("measurcd", n=200) is None and best("fajlures") is None
    assert all(best(w) is None for w in ("zebra", "failures", "x", "unseenname", ""))
    assert Lexicon().repair("B2B") is None and Lexicon().repair("c0mmon") == "common" and Lexicon(known={"c0mmon"}).repair("c0mmon") is None and Lexicon().repair("@") == "a"


def test_numbers_and_heads():
    assert page_number("Page 3 of 8") == (3, True) and page_number("p. l26") == (126, True) and page_number("- 7 -") == (7, True)
    assert page_number("xiv") == (14, False) and page_number("2005") == (2005, False)
    assert page_number("79.0%") is None and page_number("CO2 302") is None and page_number("of reserve.") is None and page_number("") is None
    assert head_key("ACME WORKS: OUTPUT 2003") == head_key("Acme  Works: 0utput 2003") != head_key("Acme Works: Income 2003")


def run(spark, rows, labels):
    spans = "array<struct<text string, bbox array<double>>>"
    pages = spark.createDataFrame([(d, p, None, None if s is None else [(t, None) for t in s]) for d, p, s in rows], f"doc_id string, page_index int, image_path string, text_spans {spans}")
    labels = spark.createDataFrame(labels, "doc_id string")
    got = examine(pages, labels).collect()
    found = sorted((r.doc_id, r.page_index, n, k) for r in got for n, k in zip(r.span_no, r.noise))
    short = examine(pages, labels, text=False).collect()
    assert found == sorted((r.doc_id, r.page_index, n, k) for r in short for n, k in zip(r.span_no, r.noise))
    return found, {(r.doc_id, r.page_index): r.text for r in got}


def test_pages(spark):
    plain = ["the committee approved several hundred litres of reserve for storage racks near orchards with failures",
             "although measured operators approved the long-term reserve for orchards. several failures measured"]
    rows = [("z", i, plain * 3) for i in range(4)]
    rows += [
        ("a", 0, ["Acme Works: Output 2003", None, "the comm-", "ittee approved the long-", "term reserve near orch-"]),
        ("a", 1, ["ACME WORKS: OUTPUT 2003", "2", "ards wifh failures.", "", "42", "the operators"]),
        ("a", 2, ["3", "Acmc Works: Output 2003", "measured several litres"]),
        ("a", 3, None), ("a", 4, []), ("a", 5, ["", " "]), ("b", 0, ["Acme Works: Output 2003", "c0mmittee"]),
        ("long", 0, ["the committee approved litres"] * 5000), ("two", 0, ["x", "the cornrniftee approved scvcral", "orchards with rneasured litrcs and lirnits-"]), ("two", 1, ["beside storage racks"]),
    ]
    found, text = run(spark, rows, [("a",), ("long",), ("a",), (None,), ("none",), ("two",)])
    assert found == [
        ("a", 0, 2, "hyphen"), ("a", 0, 4, "hyphen"), ("a", 1, 0, "header"), ("a", 1, 1, "page_number"), ("a", 1, 2, "misread"),
        ("a", 2, 0, "page_number"), ("a", 2, 1, "header"), ("two", 0, 1, "misread"), ("two", 0, 2, "hyphen"), ("two", 0, 2, "misread"),
    ]
    assert "the committee approved several orchards with measured litres" in text["two", 0]
    assert text["a", 0].endswith("the committee approved the long-term reserve near orchards") and text["a", 1].startswith("with failures.")
    assert text["a", 3] == text["a", 5] == "" and ("b", 0) not in text and len(text["long", 0].split()) == 20000


def test_empty(spark):
    assert run(spark, [], [("a",)]) == ([], {}) and run(spark, [("a", 0, ["x"])], [])[0] == []


def test_paragraphs():
    lines = ["Acme Works: Output 2003", "The committee approved several hundred litres of reserve for", "storage racks.", "Failures near orchards measured several litres of reserve with", "operators.", "", "1.2 Reserve", "The committee approved"]
    text = page(lex(), lines, None, None, None, None, True)[1].split("\n\n")
    assert [p.split()[0] for p in text] == ["Acme", "The", "Failures", "1.2", "The"]


def test_compound_with_a_misread_part():
    lx = lex()
    assert not lx.joined("long", "tcrm") and not lx.joined("long", "term.") and lx.joined("comm", "ittee") and lx.joined("comm", "itfee")


def test_compact_keeps_what_matters():
    lines = ["the committee wifh near orch-", "ards with", "", None or "", "failures -"]
    assert compact(lines, lambda t: t == "wifh") == [". committee wifh . orch-", "ards .", "", "", "."] and LEAST > 1


def test_page_alone():
    assert page(lex(), [], None, None, None, None) == ([], "")
    assert page(lex(), ["several litr-"], None, None, None, None) == ([], "several litr-")
