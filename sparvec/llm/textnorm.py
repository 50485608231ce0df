"""A text as comparable words or letters: what is left when form is disregarded.

Tags vanish (``<br>`` and character entities separate words), soft hyphens and zero-width marks
vanish, compatibility forms and accents are composed, case is folded. Words are runs of letters,
digits and combining marks; the letter stream holds the letters and digits alone.
"""

from __future__ import annotations

import re
import unicodedata

import regex

#: Bracket words that are markup in forum posts. Other bracketed text is text.
BBCODES = "quote|b|i|u|s|img|url|code|size|color|list|center|spoiler|email|left|right|sub|sup|font|hr|table|tr|td"
BREAK = regex.compile(r"(?i)<br\s*/?>")
TAG = regex.compile(rf"(?i)</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->|\[/?(?:{BBCODES})(?:=[^\[\]\n]*)?\]")
ENTITY = regex.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Soft hyphen, zero-width space, joiners, direction marks, word joiner, byte order mark, variation selectors.
UNSEEN = re.compile("[\xad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f]+")
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
NO_LETTER = regex.compile(r"[^\p{L}\p{N}]+")


def folded(text: str) -> str:
    if "<" in text or "[" in text:
        text = TAG.sub("", BREAK.sub(" ", text))
    if "&" in text:
        text = ENTITY.sub(" ", text)
    if text.isascii():
        return text.lower()
    text = UNSEEN.sub("", text)
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(folded_text: str) -> list[str]:
    return WORD.findall(folded_text)


NO_WORD_ASCII = re.compile(r"[^A-Za-z0-9]+")
NO_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def spaced(folded_text: str) -> str:
    """The words between single blanks, one at either end."""
    apart = NO_WORD_ASCII if folded_text.isascii() else NO_WORD
    return f" {apart.sub(' ', folded_text).strip(' ')} "


def letters(folded_text: str) -> str:
    return NO_LETTER.sub("", folded_text)
