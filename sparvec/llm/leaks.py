"""Evaluation texts that reappear in training text.

Pigeonhole edit matching. A passage of an item is a window of ``passage`` units (words, or letters
for scripts without spaces). With an error budget of e, the window is split into e + 1 pieces; a
document that repeats the window with at most e edits holds one of the pieces unchanged. Pieces of
all windows lie in one automaton; a document is read through it, and each hit is verified with
Myers' bit-parallel distance between the window and the document's units around the hit.

The items are the broadcast side: they are read in blocks of bounded size (rows and bytes), and
every block meets all documents in a map-only pass, so the corpus is never shuffled.

Defined cases
    * null and empty texts, and items shorter than a passage, match nothing;
    * rows with a null identifier are left out; a repeated document row gives its pairs once;
    * very long texts are searched whole; other columns are ignored;
    * an empty document or item table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnorm import folded, letters, spaced, words

BLOCK_ROWS = 20_000
#: Text of a block: its pieces take some hundred bytes in the automaton for each.
BLOCK_BYTES = 1_000_000
#: Languages whose passages are counted in letters.
LETTER_LANGUAGES = ("zh", "ja")


@dataclass(frozen=True)
class Passages:
    """What counts as a passage: ``passage`` units, of which ``errors`` may differ."""

    passage: int
    errors: int

    def __post_init__(self) -> None:
        if self.errors < 0 or self.passage < self.errors + 1:
            raise ValueError("a passage must hold more units than errors")

    @property
    def cuts(self) -> list[tuple[int, int]]:
        """(start, end) of the errors + 1 pieces in a window."""
        n = self.errors + 1
        at = [self.passage * i // n for i in range(n + 1)]
        return list(zip(at, at[1:]))


def window_masks(window: Sequence[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, unit in enumerate(window):
        masks[unit] = masks.get(unit, 0) | 1 << i
    return masks


def least_distance(masks: dict[str, int], m: int, text: Sequence[str]) -> int:
    """Least edit distance between the window and any stretch of ``text`` (Myers 1999, bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for unit in text:
        eq = masks.get(unit, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
    return best


class PieceIndex:
    """The pieces of all windows of a block of items, in an Aho-Corasick automaton: a text is read once, whatever their number.

    Words are joined by single blanks, with one at either end, so a piece of words is a string that starts and ends at words.
    """

    def __init__(self, items: list[tuple[int, Sequence[str]]], rule: Passages) -> None:
        self.rule, self.items = rule, [(i, u) for i, u in items if len(u) >= rule.passage]
        pieces: dict[str, list[tuple[int, int, int]]] = {}  # piece -> [(item, window start, piece start in window)]
        for n, (_, units) in enumerate(self.items):
            for start in range(len(units) - rule.passage + 1):
                for a, b in rule.cuts:
                    pieces.setdefault(joined(units[start + a : start + b]), []).append((n, start, a))
        #: Whether a text of ASCII alone can hold a piece.
        self.ascii = any(k.isascii() for k in pieces)
        self.automaton = ahocorasick.Automaton()
        for k, where in pieces.items():
            self.automaton.add_word(k, (len(k), where))
        self.automaton.make_automaton()
        self.masks: dict[tuple[int, int], dict[str, int]] = {}

    def search(self, units: Sequence[str]) -> dict[int, tuple[int, int]]:
        """item id -> (least errors of any passage, longest run of equal units) of the document's units."""
        return self.search_text(joined(units))

    def search_text(self, text: str) -> dict[int, tuple[int, int]]:
        """The same for units already joined."""
        rule, found, seen, runs = self.rule, {}, set(), {}
        if not self.items:
            return found
        blanks: list[int] = []
        units: Sequence[str] = text
        for end, (length, where) in self.automaton.iter(text):
            p = end - length + 1
            if text[:1] == " ":
                if not blanks:
                    blanks, units = [i for i, c in enumerate(text) if c == " "], text.split()
                p = bisect_left(blanks, p)
            for n, start, a in where:
                diagonal = p - a - start
                if (n, start, diagonal) in seen:
                    continue
                seen.add((n, start, diagonal))
                item_id, item = self.items[n]
                window = item[start : start + rule.passage]
                if p >= a and units[p - a : p - a + rule.passage] == window:
                    d = 0
                else:
                    if (n, start) not in self.masks:
                        self.masks[n, start] = window_masks(window)
                    around = units[max(0, p - a - rule.errors) : p - a + rule.passage + rule.errors]
                    if len(self.masks[n, start].keys() & set(around)) < len(self.masks[n, start]) - rule.errors:
                        continue  # each edit takes at most one unit of the window away
                    d = least_distance(self.masks[n, start], rule.passage, around)
                    if d > rule.errors:
                        continue
                if (n, diagonal) not in runs:
                    runs[n, diagonal] = longest_run(item, units, diagonal)
                old = found.get(item_id, (rule.passage, 0))
                found[item_id] = (min(old[0], d), max(old[1], runs[n, diagonal]))
        return found


def joined(units: Sequence[str]) -> str:
    """Letters as they are; words between single blanks."""
    return units if isinstance(units, str) else f" {' '.join(units)} "


def longest_run(item: Sequence[str], units: Sequence[str], diagonal: int) -> int:
    """Longest run of equal units at equal offset."""
    best = run = 0
    for i in range(max(0, -diagonal), min(len(item), len(units) - diagonal)):
        run = run + 1 if item[i] == units[i + diagonal] else 0
        best = max(best, run)
    return best


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    word_rule: Passages = Passages(8, 1),
    letter_rule: Passages = Passages(20, 1),
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    lang: str = "lang",
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, errors, run, unit)``: documents that repeat a passage of an item with few edits.

    ``errors`` is the least distance of a passage, ``run`` the longest stretch of equal units, ``unit`` word or letter.
    """
    spark = documents.sparkSession
    held = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text, lang)
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_rows), math.ceil(size / block_bytes))
    source = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))
    schema = f"`{doc_id}` long, `{item_id}` long, errors int, run int, letters int"
    out = None
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == k)
        rows = [(int(r[0]), r[1], (r[2] or "").lower()[:2]) for r in part.collect()]  # bounded by the block
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        found = source.mapInArrow(_searcher(sent, word_rule, letter_rule, doc_id, item_id), schema)
        out = found if out is None else out.unionByName(found)
    kind = F.when(F.min("letters") == 0, "word").otherwise("letter")
    return out.groupBy(doc_id, item_id).agg(F.min("errors").alias("errors"), F.max("run").alias("run"), kind.alias("unit"))


#: The indexes of the block this worker searched last: tasks of one block share them.
_last: dict[str, tuple[PieceIndex, PieceIndex]] = {}


def _indexes(sent, word_rule: Passages, letter_rule: Passages) -> tuple[PieceIndex, PieceIndex]:
    name, rows = sent.value
    if name not in _last:
        by_word, by_letter = [], []
        for i, text, lang in rows:
            if lang in LETTER_LANGUAGES:
                by_letter.append((i, letters(folded(text))))
            else:
                by_word.append((i, words(folded(text))))
        _last.clear()
        _last[name] = PieceIndex(by_word, word_rule), PieceIndex(by_letter, letter_rule)
    return _last[name]


def _searcher(sent, word_rule: Passages, letter_rule: Passages, doc_id: str, item_id: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_index, letter_index = _indexes(sent, word_rule, letter_rule)
        for batch in batches:
            out: list[tuple] = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = folded(text)
                if word_index.items:
                    out += [(d, i, e, r, 0) for i, (e, r) in word_index.search_text(spaced(plain)).items()]
                if letter_index.items and (letter_index.ascii or not plain.isascii()):
                    out += [(d, i, e, r, 1) for i, (e, r) in letter_index.search_text(letters(plain)).items()]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[doc_id, item_id, "errors", "run", "letters"])

    return search


def exact_leaks(leaks: DataFrame, word_rule: Passages = Passages(8, 1), letter_rule: Passages = Passages(20, 1)) -> DataFrame:
    """The leaks whose longest run of equal units is a whole passage."""
    return leaks.where(F.col("run") >= F.when(F.col("unit") == "word", word_rule.passage).otherwise(letter_rule.passage))
