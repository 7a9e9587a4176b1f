import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm.tokenize import Prefixes, Vocabulary, _chunk, encode, encode_column

pytest.importorskip("public_tokenizers")
V = Vocabulary.read()


def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


T = library()
text = st.text(st.sampled_from("aeinst BbZ019.,'é²\n\t 　😀日本​<|>"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text)
def test_against_the_library(t):
    assert encode(V, t) == T.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=12), st.integers(0, 30))
def test_prefixes_append_and_edit(a, b, at):
    p = Prefixes(V, a)
    assert p.ids() == V.merge(a)
    p.append(b)
    assert p.ids() == V.merge(a + b)
    at = min(at, len(a + b))
    p.edit(at, b"xyz")
    assert p.ids() == V.merge((a + b)[:at] + b"xyz")


def test_long_piece_and_specials():
    for t in ("a" * 20000, "<|endoftext|> x", "   ", "x  y   z ", "​" * 300):
        assert encode(V, t) == T.encode(t, add_special_tokens=False).ids
    assert _chunk(V, "") == []
    assert encode(V, "a\ud800b") == encode(V, "a\ufffdb")
    began = time.time()
    assert V.merge(b" " * 300) == encode(V, " " * 300) and sum(len(V.token[i]) for i in encode(V, " " * 160_000)) == 160_000
    assert time.time() - began < 6


def test_column(spark):
    df = spark.createDataFrame([(1, "Hello  world", 1), (2, None, 1), (3, "", 1), (4, " ", 1), (4, " ", 1)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode_column(df).collect())
    one = T.encode("Hello  world").ids
    assert got == [(1, one), (2, []), (3, []), (4, [220]), (4, [220])]
    assert encode_column(df.limit(0)).count() == 0
