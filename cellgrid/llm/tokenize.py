"""Encoding of a corpus with a public byte-level BPE vocabulary.

A piece (what the tokenizer's split pattern yields) is encoded by prefix dynamic
programming: for each byte prefix the one token that its encoding ends in is stored. A
token t that ends prefix i is that token when the prefix before it is empty, or when the
last token u of the prefix before it and t stay as they are if u + t is encoded together;
exactly one token passes. The table gives the encoding by walking back, lets bytes be
appended exactly (`append` only fills the new places), and lets an edit be re-encoded
from its place on (`edit` keeps the prefixes before it). The cost is linear in the
length, where merging pair by pair is not.

Texts are cut at single blanks, where no piece can cross, and encoded chunks are kept in
a bounded cache per process, so that frequent words cost one lookup. Blank runs, and
whatever else stands between, go through the split pattern.

The vocabulary file is read on the driver and sent with the tasks (its size does not
depend on the data).

Defined results: null and empty texts give the empty list; blank texts are encoded as they
are; the strings of special tokens are ordinary text; lone surrogates become U+FFFD.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a process's chunk cache.
CACHE = 400_000
# Fixed value: the split pattern of the vocabulary (published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Tokens and their ranks; which neighbours may follow each other."""

    def __init__(self, lines: bytes, pattern: str = PATTERN) -> None:
        self.lines, self.pattern = lines, pattern
        self._load()

    @classmethod
    def read(cls, path: str | None = None) -> Vocabulary:
        with open(path or default_path(), "rb") as f:
            return cls(f.read())

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _load(self) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, self.lines.split(b"\n")))}
        self.token = {v: k for k, v in self.rank.items()}
        # lengths of the tokens that end in two given bytes, longest first
        sizes: dict[bytes, set[int]] = {}
        for k in self.rank:
            if len(k) > 1:
                sizes.setdefault(k[-2:], set()).add(len(k))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.split = regex.compile(self.pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Plain pair merging; used for pairs of tokens and as the tests' yardstick."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def stays(self, u: int, t: int) -> bool:
        """Whether u then t is the encoding of their joined bytes."""
        key = u, t
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[u] + self.token[t]) == [u, t]
        return known

    def reached(self, t: int) -> bool:
        """Whether merging the bytes of t gives t; a vocabulary may list others."""
        key = t, -1
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merge(self.token[t]) == [t]
        return known


class Prefixes:
    """The prefix table of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.v, self.last
        rank, sizes, stays, reached = v.rank, v.sizes, v.stays, v.reached
        start, self.data = len(self.data), self.data + more
        data = self.data
        for end in range(start + 1, len(data) + 1):
            for size in (*sizes.get(data[max(end - 2, 0) : end], ()), 1):
                begin = end - size
                if begin < 0:
                    continue
                t = rank.get(data[begin:end])
                if t is not None and reached(t) and (begin == 0 or stays(last[begin - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, at: int, data: bytes) -> None:
        """Replace what follows the first `at` bytes."""
        self.data = self.data[:at]
        del self.last[at:]
        self.append(data)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= len(self.v.token[t])
        return out[::-1]


def _chunk(v: Vocabulary, text: str) -> list[int]:
    """Ids of a chunk through the split pattern and the prefix table."""
    out: list[int] = []
    for piece in v.split.findall(text):
        data = piece.encode("utf-8")
        whole = v.rank.get(data)
        if whole is not None and v.reached(whole):
            out.append(whole)
        else:
            out += Prefixes(v, data).ids()
    return out


def encode(v: Vocabulary, text: str | None) -> list[int]:
    """The ids of a text."""
    if not text:
        return []
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        text = "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in text)
    cache = v.cache
    if len(cache) > CACHE:
        cache.clear()
    words = text.split(" ")
    out: list[int] = []
    pending = words[0]
    # a blank starts a new chunk only between two visible characters; others stay inside one
    for w in words[1:]:
        if w and pending and not pending[-1].isspace() and not w[0].isspace():
            ids = cache.get(pending)
            if ids is None:
                ids = cache[pending] = _chunk(v, pending)
            out += ids
            pending = " " + w
        else:
            pending = pending + " " + w
    ids = cache.get(pending)
    if ids is None:
        ids = _chunk(v, pending)
        if len(pending) < 64:
            cache[pending] = ids
    return out + ids


@lru_cache(maxsize=2)
def _vocabulary(lines: bytes) -> Vocabulary:
    """The vocabulary of this process."""
    return Vocabulary(lines)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids: the ids of every row's text."""
    lines = Vocabulary.read(path).lines
    shared = df.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [encode(v, t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
