"""The blocks of a forum post: stretches of prose whose line breaks are mere wrapping.

A masked copy of the text, of the same length, holds quote marks, tags and entities as filler, so
that every position found in it is a position of the text. Blocks end at blank lines (lines of bare
quote marks or only tags among them) and where the quote depth changes; an attribution line and
each line of a signature is a block of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex

from .textnorm import ENTITY, TAG

GONE, ENTITY_FILL = "\x01", "\x02"
BREAK_TAG = regex.compile(r"(?i)<br\s*/?>")
QUOTE_TAG = regex.compile(r"(?i)\[(/?)quote(?:=[^\[\]\n]*)?\]")
QUOTE_MARKS = regex.compile(r"[ \t\x01]*(?:[>|][ \t]?)+")
#: Lines that announce a signature.
SIGNATURE = regex.compile(r"[ \t]*(?:--|~~~|_{3,})[ \t\r]*")
ATTRIBUTION = regex.compile(r"[:：][ \t\r\x01\xa0 ]*$")
ENDED = regex.compile(r"""[.!?…。！？।॥؟:：)\]"'”’»」』）]$""")
LETTER = regex.compile(r"[\p{L}\p{N}]")


@dataclass
class Block:
    """``text[start:end]``; ``line``: the whole of it is one unit."""

    start: int
    end: int
    line: bool


def masked(text: str) -> str:
    def fill(m: regex.Match) -> str:
        return GONE * (m.end() - m.start())

    if "\x01" in text or "\x02" in text:
        text = text.replace("\x01", " ").replace("\x02", " ")
    if "<" in text or "[" in text:
        text = TAG.sub(fill, BREAK_TAG.sub(fill, text))
    if "&" in text:
        text = ENTITY.sub(lambda m: ENTITY_FILL * (m.end() - m.start()), text)
    return text


def blocks(text: str) -> tuple[str, list[Block]]:
    """The masked text and its blocks in order."""
    mask = masked(text)
    tags = {m.start(): (m.end(), -1 if m.group(1) else 1) for m in QUOTE_TAG.finditer(text)} if "quote" in text or "QUOTE" in text else {}
    chars = None
    out: list[Block] = []
    nesting, depth, signature = 0, None, False
    begin = end = -1  # the open block
    lines: list[tuple[int, int]] = []  # its lines

    def close(deeper: bool) -> None:
        nonlocal begin, end, lines
        if begin < 0:
            return
        a, b = lines[-1]
        if deeper and b - a < 100 and ATTRIBUTION.search(mask[a:b]):
            before = mask[begin:a].rstrip(" \t\r\n\x01>|")
            if len(lines) == 1 or ENDED.search(before):
                if a > begin:
                    out.append(Block(begin, lines[-2][1], False))
                begin = -1
                out.append(Block(a, b, True))
        if begin >= 0:
            out.append(Block(begin, end, False))
        begin, lines = -1, []

    at = 0
    for raw in text.split("\n"):
        stop = at + len(raw)
        m = QUOTE_MARKS.match(mask, at, stop)
        first = at
        marks = 0
        if m:
            first = m.end()
            marks = sum(c in ">|" for c in mask[at:first])
            if chars is None:
                chars = list(mask)
            chars[at:first] = GONE * (first - at)
        # pieces of the line between quote tags
        pieces, p = [], first
        for t in [t for t in tags if first <= t < stop] if tags else ():
            pieces.append((p, t, 0))
            pieces.append((t, tags[t][0], tags[t][1]))
            p = tags[t][0]
        pieces.append((p, stop, 0))
        only_tags = not mask[first:stop].strip(" \t\r\x01\xa0​﻿\xad　")
        for a, b, turn in pieces:
            if turn:
                close(turn > 0)
                nesting, depth, signature = max(0, nesting + turn), None, False
                continue
            if not mask[a:b].strip(" \t\r\x01\xa0​﻿\xad　"):
                if only_tags:
                    close(False)
                    signature = False
                continue
            here = (marks, nesting)
            if depth is not None and here != depth:
                close(marks > depth[0])
                signature = False
            depth = here
            if SIGNATURE.fullmatch(mask, a, b):
                close(False)
                signature = True
                continue
            if signature:
                out.append(Block(a, b, True))
                continue
            if begin < 0:
                begin = a
            end = b
            lines.append((a, b))
        at = stop + 1
    close(False)
    return ("".join(chars) if chars is not None else mask), [b for b in out if LETTER.search(mask, b.start, b.end)]
