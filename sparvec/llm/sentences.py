"""Sentence units across languages and scripts.

A hidden-event n-gram language model: between words the model may insert a boundary token <s>, and
the probability of a token depends on the two tokens before it, the boundary among them. Where a
boundary is possible (a gap: after terminal punctuation with its closing marks, and, where a script
has no such punctuation, at spaces) the model weighs

    P(<s> | h, a) P(b | <s>) P(c | <s>, b)    against    P(no <s> | h, a) P(b | a) P(c | b)

with a the token before the gap, b and c those after it, and h the token before a, which is itself a
boundary if the gap before a holds one. So neighbouring gaps depend on each other, and
forward-backward over the gaps of a block gives each gap's posterior.

The model is trained on the whole corpus without labels. Ends and starts of blocks (see ``posts``)
are boundaries that layout gives away; how often a token ends a block against how often it occurs
says how often it ends a sentence, and expectation maximisation over the gaps inside blocks refines
that with what follows.

Texts are parsed once, into a written table of gaps; training and segmentation both read that, in
numpy. All statistics cover all documents, and no type is dropped however large the corpus: the same
counts give the same probabilities beside any number of others. The model grows with the distinct
rows, far slower than the corpus.

Defined cases
    * null and empty texts, and texts without a letter or digit, have no units;
    * rows with a null identifier are left out; repeated rows are judged each;
    * very long texts are segmented whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .posts import GONE, LETTER, Block, blocks

#: Terminal and closing marks.
FULL_STOPS = "。！？．"
STOPS = ".!?…।॥؟۔" + FULL_STOPS
CLOSERS = r""")\]}"'”’»›」』）】〉》"""
SPACE = r"\s\xa0 　​﻿\x01\x02"
GAP = regex.compile(
    rf"(?P<full>[{FULL_STOPS}]+[…!?]*(?:\x01*[{CLOSERS}])*)"
    rf"|(?P<stop>[.!?…।॥؟۔]+(?:\x01*[{CLOSERS}“]|[ \xa0 ]+»)*)"
    r"|(?<=\p{Thai})(?P<thai>[ \t\r\n\x01]*[ \n][ \t\r\n\x01]*)(?=[\p{Thai}\p{Lu}(\"“«])"
)
#: What may stand between a unit and the next: white space, filler, emoji, ornaments.
BETWEEN = rf"(?:[{SPACE}*_~=•]|\p{{So}}|\p{{Sk}}|\p{{Cf}}|[\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF️]|--+)*+"
OPENERS = r"""[\p{Ps}\p{Pi}„"'¿¡—–-]*"""
TOKEN = r"\p{Thai}{1,4}|[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|[\p{L}\p{M}\p{N}'’]+"
#: What follows a gap: openers, a token, and the token behind it where no mark stands between.
NEXT = regex.compile(rf"{BETWEEN}(?P<open>{OPENERS})\s*(?P<word>{TOKEN})?(?:[ \t\r\n]*(?P<second>{TOKEN}))?")
#: The token before a gap, read backwards.
BEFORE = regex.compile(r"(?r)(?:[\p{Han}\p{Hiragana}\p{Katakana}ー]{1,2}|\p{Thai}{1,4}|[^\s\x01\x02\p{Ps}\p{Pi}„\"—。！？．\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}]{1,24})")
TRAILING = regex.compile(rf"[{SPACE}*_~=•|>—–-]|\p{{So}}|\p{{Sk}}|\p{{Cf}}|[\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF️]")
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}][^\s\x01\x02]*")
NUMBERED = regex.compile(r"[\p{P}\p{N}\p{S}]*\s*([\p{L}\p{M}]+)?")
DIGITS = regex.compile(r"\p{N}+")


#: Tokens whose plain form, class and code a worker remembers.
REMEMBERED = 200_000


@lru_cache(maxsize=REMEMBERED)
def _plain(word: str) -> str:
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word)
    return DIGITS.sub("0", word.casefold())


@lru_cache(maxsize=REMEMBERED)
def _shape(word: str) -> str:
    """The class of a word."""
    if not word:
        return "-"
    c = word[0]
    if c.isdigit():
        return "0"
    if "฀" <= c <= "๿":
        return "thai"
    if "぀" <= c <= "ヿ":
        return "kana"
    if "一" <= c <= "鿿":
        return "han"
    if "؀" <= c <= "ۿ":
        return "arab" if len(word.rstrip(".")) > 1 else "arab1"
    if "ऀ" <= c <= "ॿ":
        return "deva"
    bare = word.rstrip(".")
    kind = "cyr" if "Ѐ" <= c <= "ӿ" else "lat"
    if "." in bare:
        return kind + "."
    return kind + ("1" if len(bare) == 1 else "")


@lru_cache(maxsize=REMEMBERED)
def _code(token: str) -> int:
    """A 64-bit number for a token; 0 is no token."""
    return (xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) - (1 << 63)) or 1 if token else 0


def _case(word: str) -> int:
    return UPPER if word[:1].isupper() else LOWER if word[:1].islower() else 0


#: Flags of a parsed row: case of the token after, posts that start sentences in lower case, a token before that is
#: the first of its sentence if the gap (or block start) before it is a boundary, a gap that script decides.
UPPER, LOWER, LOWERED, FIRST, SURE = 1, 2, 4, 8, 16
#: Kinds of parsed rows: a gap, the end (and start) of a block of prose, a line that is one unit.
GAP_ROW, BLOCK_ROW, LINE_ROW = 0, 1, 2
#: Columns of a parsed row. Tokens are 64-bit codes, classes as well.
KIND, END, BLOCK, A, KA, B, KB, C, FLAGS = range(9)


def _tokens_after(mask: str, at: int, end: int) -> tuple[str, str, str, int]:
    """The token after a position, its class, the token behind it, and the case."""
    m = NEXT.match(mask, at, end)
    opening, word, second = m.group("open", "word", "second")
    if not word:
        if opening:
            return opening, opening + "-", "", 0
        rest = mask[m.end("open") : m.end("open") + 1] if m.end("open") < end else ""
        return rest, "?", "", 0
    low = _plain(word)
    if low == "0":  # a bare number says little: the word behind it tells which kind
        behind = NUMBERED.match(mask, m.end("word"), end)
        low += " " + _plain(behind.group(1)) if behind and behind.group(1) else ""
    return opening + low, opening + _shape(word), _plain(second) if second else "", _case(word)


def _token_before(mask: str, start: int, at: int) -> str:
    w = BEFORE.match(mask, max(start, at - 24), at)
    return w.group() if w else ""


def _last_of(mask: str, block: Block) -> int:
    last = block.end
    while last > block.start and TRAILING.match(mask, last - 1):  # from behind: long runs of blanks cost their length once
        last -= 1
    return last


def gaps(mask: str, block: Block, last: int) -> list[tuple[int, str, str, str, str, str, int]]:
    """The gaps inside a block of prose that ends at ``last``: end, token before and its class, token after and its class, second token after, flags."""
    out: list[tuple[int, str, str, str, str, str, int]] = []
    start = floor = block.start
    done = start  # end of the last gap
    for m in GAP.finditer(mask, start, last):
        at, after = m.span()
        if not (at > floor and mask[at - 1].isalnum()) and not LETTER.search(mask, floor, at):  # mostly decided by one character
            floor = at
            continue
        if m.lastgroup == "thai":
            end, marks = at, "_"
            sure = SURE if "฀" <= mask[after] <= "๿" else 0
        else:
            end, marks, sure = after, m.group().replace(GONE, ""), 0
            if after >= last:
                break
            if m.lastgroup == "stop":
                c = mask[after]
                if c in ",;:،؛、，；：" or (c not in "—–-«„“(（「『¿¡" and (c.isalnum() or not (c.isspace() or c in "\x01\x02​﻿" or ord(c) > 0x2000))):
                    continue
        word = _token_before(mask, start, at)
        b, kb, second, case = _tokens_after(mask, after, last)
        if not mask[after + 1 : min(after + 2, last)].isalnum() and not LETTER.search(mask, after, last):
            break
        begin = at - len(word)
        first = 0 if done + 1 < begin and mask[done + 1].isalnum() or LETTER.search(mask, done, begin) else FIRST
        out.append((end, _plain(word) + marks, _shape(word) + marks, b, kb, second, case | first | sure))
        floor = done = after
    return out


LAST = regex.compile(rf"(?:[{FULL_STOPS}]+[…!?]*(?:\x01*[{CLOSERS}])*|[.!?…।॥؟۔]+(?:\x01*[{CLOSERS}“]|[ \xa0 ]+»)*)\Z")


def last_token(mask: str, block: Block, last: int) -> tuple[str, str, int]:
    """The token that ends a block, its class and where it begins, if it ends in terminal marks (or in Thai letters)."""
    low = max(block.start, last - 40)
    if tail := LAST.search(mask[low:last]):
        at, marks = low + tail.start(), tail.group().replace(GONE, "")
    elif "฀" <= mask[last - 1] <= "๿":
        at, marks = last, "_"
    else:
        return "", "", last
    word = _token_before(mask, block.start, at)
    return _plain(word) + marks, _shape(word) + marks, at - len(word)


def parsed(text: str) -> list[tuple[int, ...]]:
    """The rows of a text, in order of their ends."""
    mask, parts = blocks(text)
    found, lowered = [], 0
    for b in parts:
        last = _last_of(mask, b)
        first = ("", "", "", 0) if b.line else _tokens_after(mask, b.start, last)
        if first[3] == LOWER:
            lowered = LOWERED
        found.append((b, last, first))
    out: list[tuple[int, ...]] = []
    for b, last, (word, kind, second, case) in found:
        if b.line:
            out.append((LINE_ROW, last, 0, 0, 0, 0, 0, 0, 0))
            continue
        inside = gaps(mask, b, last)
        body = "".join(mask[b.start : last].replace(GONE, "").split())
        key = xxhash.xxh3_64_intdigest(body.encode("utf-8", "replace")) - (1 << 63)
        for end, a, ka, t, kt, t2, flags in inside:
            out.append((GAP_ROW, end, key, _code(a), _code(ka), _code(t), _code(kt), _code(t2), flags | lowered))
        a, ka, begin = last_token(mask, b, last)
        one = FIRST if a and not LETTER.search(mask, inside[-1][0] if inside else b.start, begin) else 0
        out.append((BLOCK_ROW, last, key, _code(a), _code(ka), _code(word), _code(kind), _code(second), case | lowered | one))
    return out


class Table:
    """Numbers by 64-bit keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [np.asarray(v, np.float64)[order] for v in values]

    def get(self, keys: np.ndarray, *missing: float) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.full(len(keys), m) for m in missing]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return [np.where(there, v[at], m) for v, m in zip(self.values, missing)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.get(keys, 0.0)[0] > 0 if len(self.keys) else np.zeros(len(keys), bool)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A key for two keys."""
    z = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


@dataclass
class Model:
    """The probabilities of the hidden event and of the tokens behind it, by type with back-off to class."""

    ends: Table  # a or class -> P(<s> | a)
    singles: Table  # a -> how much less likely behind a boundary: P(<s> | <s>, a) over P(<s> | a)
    after: Table  # b or class -> P(b | <s>), P(b | no <s>)
    pairs: Table  # (a, b) -> P(b | a, <s>), P(b | a, no <s>)
    second: Table  # c -> P(c second after <s>), P(c second after none)
    trigrams: Table  # (b, c) -> counts after <s>, after none
    context: Table  # b -> counts of its second tokens after <s>, after none
    case: np.ndarray  # [<s> or none, style, case] -> probability

    def factors(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every gap P(<s> | a), P(<s> | <s>, a), and the likelihoods of what follows given <s> and none."""
        p = self.ends.get(g[:, A], -1.0)[0]
        p = np.where(p < 0, self.ends.get(g[:, KA], 0.5)[0], p)
        alone = p * self.singles.get(g[:, A], 1.0)[0]
        b = np.where(self.after.has(g[:, B]), g[:, B], g[:, KB])
        s, n = self.after.get(b, 1e-6, 1e-6)
        # both histories know a pair: half of the weight stays with what follows any boundary or none
        ps, pn = self.pairs.get(_pair(g[:, A], b), -1.0, -1.0)
        s, n = np.where(ps < 0, s, 0.5 * s + 0.5 * ps), np.where(pn < 0, n, 0.5 * n + 0.5 * pn)
        s2, n2 = self.second.get(g[:, C], 0.0, 0.0)
        known = (g[:, C] != 0) & (s2 > 0) & (n2 > 0)
        ts, tn = self.trigrams.get(_pair(b, g[:, C]), 0.0, 0.0)
        zs, zn = self.context.get(b, 0.0, 0.0)
        s = s * np.where(known, (ts + BACKOFF * s2) / (zs + BACKOFF), 1.0)
        n = n * np.where(known, (tn + BACKOFF * n2) / (zn + BACKOFF), 1.0)
        case, style = g[:, FLAGS] & 3, (g[:, FLAGS] & LOWERED) // LOWERED
        s, n = s * self.case[0, style, case], n * self.case[1, style, case]
        scale = np.maximum(s + n, 1e-300)
        return p, alone, np.maximum(s / scale, 1e-9), np.maximum(n / scale, 1e-9)

    def lone(self, g: np.ndarray) -> np.ndarray:
        """Every gap's posterior by its own odds, as if it followed no other gap."""
        p, _, s, n = self.factors(g)
        return p * s / (p * s + (1 - p) * n)

    def boundaries(self, g: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Posterior of each gap by forward-backward; ``new``: the gap is the first of its block.

        The state is whether a gap holds a boundary. It reaches the next gap if one token lies
        between: that token's history is then the boundary. All chains advance together.
        """
        m = len(g)
        if not m:
            return np.zeros(0)
        p, alone, s, n = self.factors(g)
        linked = (g[:, FLAGS] & FIRST) > 0
        begins = new | ~linked
        # f[i, x, y]: from state x before to state y at gap i
        f = np.empty((m, 2, 2))
        for x, e in ((0, p), (1, np.where(linked, alone, p))):
            f[:, x, 1], f[:, x, 0] = e * s, (1 - e) * n
        begin = np.nonzero(begins)[0]
        length = np.diff(np.append(begin, m))
        forward, backward = np.zeros((m, 2)), np.ones((m, 2))
        start = np.zeros((len(begin), 2))
        start[:, 1] = 1.0  # a block starts after a boundary
        start[~new[begin]] = 0.5  # what came before does not reach here: both rows are the same
        forward[begin] = np.einsum("cx,cxy->cy", start, f[begin])
        forward[begin] /= forward[begin].sum(axis=1, keepdims=True)
        chains, step = begin[length > 1], 1
        reach = length[length > 1]
        levels = []
        while len(chains):
            at = chains + step
            forward[at] = np.einsum("cx,cxy->cy", forward[at - 1], f[at])
            forward[at] /= forward[at].sum(axis=1, keepdims=True)
            levels.append(at)
            step += 1
            chains, reach = chains[reach > step], reach[reach > step]
        for at in reversed(levels):
            backward[at - 1] = np.einsum("cxy,cy->cx", f[at], backward[at])
            backward[at - 1] /= backward[at - 1].sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)


#: A type that occurs at most so often is spoken for by its class.
RARE_TYPE = 10
#: Occurrences that the second token's own frequency weighs against those behind the token before it.
BACKOFF = 50.0


def layout_share(n_end: np.ndarray, n_mid: np.ndarray) -> float:
    """The share of sentence ends that are block ends.

    Types that always end a sentence all show this share, mixed types and abbreviations less: it is
    the pooled share of the frequent types that show at least half of what the highest show.
    """
    t = n_end + n_mid
    keep = t >= 3 * RARE_TYPE
    e, t = (n_end[keep], t[keep]) if keep.any() else (np.array([n_end.sum()]), np.array([t.sum()]))
    share = e / np.maximum(t, 1)
    order = np.lexsort((-e, -t, -share))
    e, t, share = e[order], t[order], share[order]
    top = share[min(len(t) - 1, int(np.searchsorted(np.cumsum(t), 0.1 * t.sum())))]
    pure = share >= 0.6 * top
    return float(min(0.95, max(0.02, (e[pure].sum() + 1) / (t[pure].sum() + 4))))


def sentence_share(ends: np.ndarray, seen: np.ndarray, h: float, of_class: np.ndarray) -> np.ndarray:
    """Posterior mean of the share of each type's occurrences that end a sentence.

    The prior holds never, always, and anything between; of_class tilts it. Long runs are damped,
    since occurrences in one corpus are not independent.
    """
    damp = np.minimum(1.0, 150 / np.maximum(seen, 1))
    e, t = (ends * damp)[:, None], (seen * damp)[:, None]
    f = np.array([0.002, 0.995, *(i / 20 for i in range(1, 20))])
    w = np.full((len(ends), len(f)), 0.3 / 19)
    w[:, 0], w[:, 1] = 0.6 * (1 - of_class) + 0.05, 0.6 * of_class + 0.05
    logs = np.log(w) + e * np.log(f * h) + (t - e) * np.log(1 - f * h)
    mass = np.exp(logs - logs.max(axis=1, keepdims=True))
    return (mass @ f) / mass.sum(axis=1)


def mid_share(f: np.ndarray, h: float) -> np.ndarray:
    """The same share among the occurrences inside blocks."""
    return np.clip(f * (1 - h) / (1 - f * h), 0.0003, 0.999)


class _Index:
    """Numbers the distinct of several key columns."""

    def __init__(self, *columns: np.ndarray) -> None:
        self.keys = np.unique(np.concatenate(columns)) if columns else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, column: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, column)

    def sums(self, column: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.of(column), weights=weight, minlength=len(self.keys)).astype(np.float64)


def _counted(index: np.ndarray, weights: np.ndarray, minlength: int) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=minlength).astype(np.float64)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 3) -> Model:
    """Expectation maximisation over the distinct parsed rows and how often each occurs."""
    counts = counts.astype(np.float64)
    gap, block = rows[:, KIND] == GAP_ROW, rows[:, KIND] == BLOCK_ROW
    g, n = rows[gap], counts[gap]
    ended = block & (rows[:, A] != 0)
    e, ne = rows[ended], counts[ended]
    st, ns = rows[block], counts[block]
    types, classes = _Index(g[:, A], e[:, A]), _Index(g[:, KA], e[:, KA])
    n_end, n_mid = types.sums(e[:, A], ne), types.sums(g[:, A], n)
    end_k, mid_k = classes.sums(e[:, KA], ne), classes.sums(g[:, KA], n)
    of = np.zeros(len(types), np.int64)  # each type's class
    of[types.of(e[:, A])] = classes.of(e[:, KA])
    of[types.of(g[:, A])] = classes.of(g[:, KA])
    h = layout_share(n_end, n_mid)
    # a class speaks for its rare types: pooled over the types that occur at most RARE_TYPE times
    t = n_end + n_mid
    few = t <= RARE_TYPE
    few_e, few_t = (_counted(of[few], weights=x[few], minlength=len(classes)) for x in (n_end, t))
    pool = few_t >= RARE_TYPE
    ek, tk = np.where(pool, few_e, end_k), np.where(pool, few_t, end_k + mid_k)
    class_prior = mid_share(np.minimum(0.99, (ek / h + 0.5) / (tk + 1)), h)
    type_prior = mid_share(sentence_share(n_end, t, h, class_prior[of]), h) if len(types) else np.zeros(0)
    # the same for the token after: one that starts sentences starts blocks at its share
    tokens = _Index(g[:, B], g[:, KB], st[:, B], st[:, KB])
    n_start, n_before = tokens.sums(st[:, B], ns), tokens.sums(g[:, B], n)
    h_start = layout_share(n_start, n_before)
    start_prior = mid_share(sentence_share(n_start, n_start + n_before, h_start, np.full(len(tokens), 0.5)), h_start) if len(tokens) else np.zeros(0)

    ga, gk, gb, gkb, sb = types.of(g[:, A]), classes.of(g[:, KA]), tokens.of(g[:, B]), tokens.of(g[:, KB]), tokens.of(st[:, B])
    logit = lambda p: np.log(p / (1 - p))
    p = 1 / (1 + np.exp(-np.clip(logit(type_prior[ga]) + logit(start_prior[gb]), -30, 30)))
    pair_key = _pair(g[:, A], g[:, B])
    pairs = _Index(pair_key)
    gp = pairs.of(pair_key)
    pair_a = np.zeros(len(pairs), np.int64)
    pair_a[gp] = ga
    has_c, has_sc = g[:, C] != 0, st[:, C] != 0
    seconds = _Index(g[has_c, C], st[has_sc, C])
    tri_g, tri_s = _pair(g[has_c, B], g[has_c, C]), _pair(st[has_sc, B], st[has_sc, C])
    tris = _Index(tri_g, tri_s)
    start_case, block_case = np.zeros((2, 3)), st[:, FLAGS]
    np.add.at(start_case, ((block_case & LOWERED) // LOWERED, block_case & 3), ns)
    gap_case = (g[:, FLAGS] & LOWERED) // LOWERED * 3 + (g[:, FLAGS] & 3)
    none = np.zeros(0, np.int64)
    model = Model(*(Table(none, none) for _ in range(2)), *(Table(none, none, none) for _ in range(5)), np.full((2, 2, 3), 0.5))

    # a one-word sentence of the type, against a sentence of it in general
    first_e, first_g = (e[:, FLAGS] & FIRST) > 0, (g[:, FLAGS] & FIRST) > 0
    first_end, first_mid = types.sums(e[first_e, A], ne[first_e]), types.sums(g[first_g, A], n[first_g])
    of_all = (n_end + 0.5) / (t + 1)
    single = np.minimum(1.0, (first_end + of_all) / ((first_end + first_mid + 1) * of_all))
    for _ in range(rounds):
        yes, no = p * n, (1 - p) * n
        m = len(tokens)
        cs = _counted(sb, weights=ns, minlength=m) + _counted(gb, weights=yes, minlength=m)
        cn = _counted(gb, weights=no, minlength=m)
        other = gb != gkb
        cs += 1e-3 * _counted(gkb[other], weights=yes[other], minlength=m)
        cn += 1e-3 * _counted(gkb[other], weights=no[other], minlength=m)
        seen_b = (cs > 0) | (cn > 0)
        zs, zn = cs.sum() + 0.1 * seen_b.sum(), cn.sum() + 0.1 * seen_b.sum()
        model.after = Table(tokens.keys[seen_b], (cs[seen_b] + 0.1) / max(zs, 1e-9), (cn[seen_b] + 0.1) / max(zn, 1e-9))
        pair_yes, pair_no = _counted(gp, weights=yes, minlength=len(pairs)), _counted(gp, weights=no, minlength=len(pairs))
        a_yes, a_no = _counted(ga, weights=yes, minlength=len(types)), _counted(ga, weights=no, minlength=len(types))
        often = pair_yes + pair_no >= 5
        model.pairs = Table(pairs.keys[often], (pair_yes / (a_yes[pair_a] + 1))[often], (pair_no / (a_no[pair_a] + 1))[often])
        k_yes, k_all = _counted(gk, weights=yes, minlength=len(classes)), _counted(gk, weights=n, minlength=len(classes))
        w = 4.0 + n_mid  # the layout's evidence keeps a share however often the type occurs
        model.ends = Table(
            np.append(classes.keys, types.keys),
            np.append(np.minimum(0.999, (k_yes + 2 * class_prior) / (k_all + 2)), np.clip((a_yes + w * type_prior) / (n_mid + w), 1e-5, 0.999)),
        )
        second_s = seconds.sums(np.append(st[has_sc, C], g[has_c, C]), np.append(ns[has_sc], yes[has_c]))
        second_n = seconds.sums(g[has_c, C], no[has_c])
        v = 0.1 * len(seconds)
        model.second = Table(seconds.keys, (second_s + 0.1) / max(second_s.sum() + v, 1e-9), (second_n + 0.1) / max(second_n.sum() + v, 1e-9))
        model.trigrams = Table(tris.keys, tris.sums(np.append(tri_s, tri_g), np.append(ns[has_sc], yes[has_c])), tris.sums(tri_g, no[has_c]))
        model.context = Table(tokens.keys, tokens.sums(np.append(st[has_sc, B], g[has_c, B]), np.append(ns[has_sc], yes[has_c])), tokens.sums(g[has_c, B], no[has_c]))
        case = np.stack([start_case + _counted(gap_case, weights=yes, minlength=6).reshape(2, 3), start_case + _counted(gap_case, weights=no, minlength=6).reshape(2, 3)])
        case = (case + 1) / (case[:, :, 1:].sum(axis=2, keepdims=True) + 2)
        case[:, :, 0] = 1.0  # no case, no evidence
        model.case = case
        p = model.lone(g) if len(g) else p
    model.singles = Table(types.keys, single)
    return model


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The parsed rows of a batch of texts, and of which text each is."""
    n = len(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1]
    size = np.diff(ends) // (8 * (FLAGS + 1))
    total = int(size.sum())
    if not total:
        return np.zeros((0, FLAGS + 1), np.int64), np.zeros(0, np.int64)
    return np.frombuffer(column.buffers()[2], "<i8", total * (FLAGS + 1), int(ends[0])).reshape(total, FLAGS + 1), np.repeat(np.arange(n), size)


def _decided(rows: np.ndarray, model: Model) -> np.ndarray:
    """Whether each parsed row ends a unit."""
    out = rows[:, KIND] != GAP_ROW
    at = np.nonzero(~out)[0]
    if len(at):
        before = np.append(BLOCK_ROW, rows[:-1, KIND])
        g = rows[at]
        out[at] = (model.boundaries(g, before[at] != GAP_ROW) > 0.5) | ((g[:, FLAGS] & SURE) > 0)
    return out


def _spans(text: str, model: Model) -> list[int]:
    rows = np.array(parsed(text), np.int64).reshape(-1, FLAGS + 1)
    return rows[_decided(rows, model), END].tolist()


def parse(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, key, rows)``: the parsed rows of each text as bytes, written to the shared folder; ``key`` is a hash of the identifier."""
    kind = documents.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                each = [parsed(t) for t in part.column(2).to_pylist()]
                ends = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64) * 8 * (FLAGS + 1)
                data = np.array([r for x in each for r in x], "<i8").tobytes()
                rows = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], names=[id_col, "key", "rows"])

    source = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.xxhash64(id_col).alias("key"), text_col)
    return cut(source.mapInArrow(read, f"`{id_col}` {kind}, key long, rows binary"), "parsed")


#: Blocks posted more than once that are sent to all tasks at most (16 bytes each).
SENT_BLOCKS = 1_000_000
EVENT = "kind long, a long, ka long, b long, kb long, c long, flags long"


def _occurrence(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number for each block of a text, the same on every run: its rows carry the end of the block with them."""
    is_end = rows[:, KIND] != GAP_ROW
    number = np.cumsum(is_end) - is_end  # gaps come before the end of their block
    return key + rows[is_end, END][number] * 1_000_003


def train(texts: DataFrame) -> Model:
    """The model of a corpus of parsed texts (see ``parse``)."""
    names = ["block", "n", "at"]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = _rows(b.column(1))
            keep = rows[:, KIND] == BLOCK_ROW
            if keep.any():
                at = _occurrence(rows, b.column(0).to_numpy(zero_copy_only=False)[of])[keep]
                block, first, n = np.unique(rows[keep, BLOCK], return_inverse=True, return_counts=True)
                least = np.full(len(block), np.iinfo(np.int64).max)
                np.minimum.at(least, first, at)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(n.astype(np.int64)), pa.array(least)], names=names)

    # a block that is posted again says nothing new: reposted text would pass for evidence
    source = texts.select("key", "rows")
    again = source.mapInArrow(seen, "block long, n long, at long").groupBy("block").agg(F.sum("n").alias("n"), F.min("at").alias("at")).where("n > 1").select("block", "at")
    again = cut(again, "again")
    few = again.limit(SENT_BLOCKS + 1).count() <= SENT_BLOCKS
    known = again.orderBy("block").toArrow() if few else None
    sent = texts.sparkSession.sparkContext.broadcast(None if known is None else (known.column("block").to_numpy(), known.column("at").to_numpy()))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = _rows(b.column(1))
            if not len(rows):
                continue
            at = _occurrence(rows, b.column(0).to_numpy(zero_copy_only=False)[of])
            keep = rows[:, KIND] != LINE_ROW
            if sent.value is not None and len(sent.value[0]):
                blocks_, least = sent.value
                i = np.minimum(np.searchsorted(blocks_, rows[:, BLOCK]), len(blocks_) - 1)
                keep &= (blocks_[i] != rows[:, BLOCK]) | (least[i] == at)
            rows, at = rows[keep], at[keep]
            if sent.value is not None:  # counted here already
                cols = np.ascontiguousarray(rows[:, [KIND, A, KA, B, KB, C, FLAGS]])
                _, first, n = np.unique(cols.view([("", np.int64)] * 7).ravel(), return_index=True, return_counts=True)
                rows, at, block, n = rows[first], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), n
            else:
                block, n = rows[:, BLOCK], np.ones(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(at), pa.array(n.astype(np.int64)), *(pa.array(rows[:, j]) for j in (KIND, A, KA, B, KB, C, FLAGS))], names=["block", "at", "n", "kind", "a", "ka", "b", "kb", "c", "flags"])

    found = source.mapInArrow(events, f"block long, at long, n long, {EVENT}")
    if not few:
        found = found.join(again.withColumnRenamed("at", "least"), "block", "left").where("least is null or least = at")
    key = ["kind", "a", "ka", "b", "kb", "c", "flags"]
    held = found.groupBy(*key).agg(F.sum("n").alias("n"))
    t = held.orderBy(*key).toArrow()  # the distinct rows, 64 bytes each
    rows = np.zeros((t.num_rows, FLAGS + 1), np.int64)
    for j, c in zip((KIND, A, KA, B, KB, C, FLAGS), key):
        rows[:, j] = t.column(c).to_numpy()
    return fit(rows, t.column("n").to_numpy())


def sentence_units(texts: DataFrame, model: Model) -> DataFrame:
    """``(id, end_pos, unit)`` of parsed texts (see ``parse``): a row per unit; ``end_pos`` counts code points up to the unit's end."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    id_col = texts.columns[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = _rows(b.column(1))
            keep = _decided(rows, sent.value)
            of, ends = of[keep], rows[keep, END]
            number = np.arange(len(of)) - np.searchsorted(of, of)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(ends), pa.array(number.astype(np.int64))], names=[id_col, "end_pos", "unit"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, "rows").mapInArrow(split, f"`{id_col}` {kind}, end_pos long, unit long")
