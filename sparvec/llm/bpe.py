"""Encoding texts with a byte-level BPE vocabulary given as a rank file.

A text is split into words by the vocabulary's pattern; each word's byte positions are the leaves
of a segment tree. A leaf holds (rank of the pair that starts there, position), a node the lesser
of its children, so the root is the leftmost pair of least rank. A merge rewrites three leaves (the
pair itself, its left neighbour, the swallowed right part), each a logarithmic update; a word of
n bytes costs O(n log n) however long it is.

Words repeat, so each Python worker remembers the ids of short words in a bounded table. The rank
file is read on the driver and broadcast as its bytes (its size is checked).

Defined cases
    * null and empty texts give an empty list;
    * strings that look like special tokens are ordinary text; no special id is ever produced;
    * a null identifier is kept; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the word pattern that belongs to the byte-level rank files.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE_MB = 64
REMEMBERED_WORDS = 100_000
REMEMBERED_LENGTH = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """``base64(token) rank`` lines as a table."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if n else []
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))  # where the part that starts at i ends
    before = list(range(-1, n))
    mask = size - 1
    while (top := tree[1]) != none:
        i = top & mask
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        h = before[i]
        changes = [(j, none), (i, none)]
        if end < n:
            r = get(word[i : after[end]])
            if r is not None:
                changes[1] = (i, r * size + i)
        if h >= 0:
            r = get(word[h:end])
            changes.append((h, none if r is None else r * size + h))
        for at, v in changes:
            at += size
            if tree[at] == v:
                continue
            tree[at] = v
            while at > 1:
                other = tree[at ^ 1]
                if other < v:
                    v = other
                at >>= 1
                if tree[at] == v:
                    break
                tree[at] = v
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of short words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN) -> None:
        self.ranks, self.words, self.known = ranks, regex.compile(pattern), {}

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        known = self.known
        for w in self.words.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = merge_word(w.encode(), self.ranks)
                if len(w) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    known[w] = ids
            out.extend(ids)
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(data), pattern)
    return _encoders[key]


def encode_documents(documents: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row."""
    with open(rank_file, "rb") as f:
        data = f.read(RANK_FILE_MB * 1_000_000 + 1)
    if len(data) > RANK_FILE_MB * 1_000_000:
        raise ValueError(f"a rank file of more than {RANK_FILE_MB} MB is not broadcast")
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                flat.extend(encoder.encode(text))
                ends.append(len(flat))
            values = pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
