import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparvec.llm.bpe import WORD_PATTERN, Encoder, encode_documents, merge_word, parse_ranks
from sparvec.llm.leaks import PieceIndex, Passages, exact_leaks, find_leaks, least_distance, window_masks
from sparvec.llm.posts import blocks
from sparvec.llm.queries import RANK_FILE
from sparvec.llm.sentences import FLAGS, Model, _pair, fit, parse, parsed, sentence_units, train
from sparvec.llm.textnorm import folded, letters, words

RANKS = parse_ranks(open(RANK_FILE, "rb").read())
REFERENCE = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_the_library(text):
    assert Encoder(RANKS).encode(text).tolist() == REFERENCE.encode_ordinary(text)


def test_long_words_and_round_trip():
    e = Encoder(RANKS)
    for text in ("a" * 5000, "ab" * 2500, " " * 3000, "ж" * 2000, "the<|endoftext|>cat", "\n\n\t x", "👩‍🔧" * 100):
        ids = e.encode(text).tolist()
        assert ids == REFERENCE.encode_ordinary(text) and REFERENCE.decode(ids) == text
    assert merge_word(b"", RANKS) == [] and len(merge_word(b"a", RANKS)) == 1


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0, 0) for i, t in rows], "doc_id long, text string, lang string, ids int, errors int")


def test_encode_documents(spark, small):
    df = documents(spark, [(1, "hello world"), (2, ""), (3, None), (None, "x"), (1, "hello world")])
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_documents(df, RANK_FILE).collect()), key=str)
    assert got == sorted([(1, REFERENCE.encode("hello world"))] * 2 + [(2, []), (3, []), (None, REFERENCE.encode("x"))], key=str)
    assert encode_documents(df.where("false"), RANK_FILE).count() == 0
    whole = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: REFERENCE.encode_ordinary(r["text"] or "") for r in whole.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in encode_documents(whole, RANK_FILE).collect()} == want


def edit(a, b):
    """Least edits between ``a`` and a stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", max_size=25))
def test_bit_parallel_distance(a, b):
    assert least_distance(window_masks(a), len(a), b) == edit(a, b)


def test_pieces_find_every_passage_within_budget():
    rng = random.Random(4)
    item = [f"w{rng.randrange(40)}" for _ in range(30)]
    for errors in (0, 1, 2):
        rule = Passages(8, errors)
        index = PieceIndex([(1, item)], rule)
        for _ in range(150):
            start = rng.randrange(len(item) - 8)
            text = item[start : start + 8]
            for _ in range(rng.randrange(errors + 2)):
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice([["zz"], [], ["zz", text[at]]]) + text[at + 1 :]
            doc = [f"v{rng.randrange(9)}" for _ in range(5)] + text + [f"v{rng.randrange(9)}" for _ in range(5)]
            least = min(edit(item[s : s + 8], doc) for s in range(len(item) - 7))
            found = index.search(doc)
            assert (1 in found) == (least <= errors) and (least > errors or found[1][0] == least)
    with pytest.raises(ValueError):
        Passages(2, 2)


ITEM = "The council of Orvelle ruled in year 560 that no anvil taller than 132 cubits may shade 31 stalls"
ZH = "奥维城的商人带着782个粮仓出发，每过920座桥就丢掉813个，到达莱莫港时538个还剩多少？"


def test_forms_make_no_difference(spark):
    same = [
        ITEM.upper(), ITEM.replace(" ", "\n> "), ITEM.replace("council", "coun\xadcil").replace("year", "ye​ar"), ITEM.replace(" of ", " <b>of</b> "), ITEM.replace(" ", "&nbsp;"),
        ITEM.replace(" ", "<br>"), "xx " + " ".join(ITEM.split()[3:11]) + " yy", ITEM.replace("The", "Ｔｈｅ"), ITEM.replace(",", ";").replace(" ", " — "), "[quote=\"a\"]" + ITEM + "[/quote]",
    ]
    other = [" ".join(ITEM.split()[:7]), ITEM.replace(" ", "")[:60], " ".join(w + " x" if i % 6 == 5 else w for i, w in enumerate(ITEM.split())), "", None]
    df = documents(spark, [*enumerate(same), *enumerate(other, 100), (200, "哈" + ZH.replace("，", " ").replace("782", "７８２")), (201, ZH[:14]), (None, ITEM), (0, same[0])])
    items = spark.createDataFrame([(1, "en", ITEM, "t"), (2, "zh", ZH, "t"), (3, "en", "too short", "t"), (4, "en", None, "t"), (None, "en", ITEM, "t"), (5, None, "", "t")], "item_id long, lang string, text string, task string")
    want = {(i, 1) for i in range(len(same))} | {(200, 2)}
    for kw in ({}, {"block_rows": 2}, {"block_bytes": 60}):
        got = [(r["doc_id"], r["item_id"]) for r in exact_leaks(find_leaks(df, items, **kw)).collect()]
        assert set(got) == want and len(got) == len(want)
    assert find_leaks(df.where("false"), items).count() == 0 and find_leaks(df, items.where("false")).count() == 0
    loose = {(r["doc_id"], r["item_id"]): r["errors"] for r in find_leaks(df, items).collect()}
    assert loose[102, 1] == 1


def test_leaks_against_brute_force(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    grams = {}
    for r in items.collect():
        u, n = (letters(folded(r["text"])), 20) if r["lang"] in ("zh", "ja") else (tuple(words(folded(r["text"]))), 8)
        for s in range(len(u) - n + 1):
            grams.setdefault(u[s : s + n], set()).add(r["item_id"])
    want = set()
    for r in docs.where("text is not null").collect():
        w, c = tuple(words(folded(r["text"]))), letters(folded(r["text"]))
        for u, n in ((w, 8), (c, 20)):
            for s in range(len(u) - n + 1):
                want |= {(r["doc_id"], i) for i in grams.get(u[s : s + n], ())}
    assert {(r["doc_id"], r["item_id"]) for r in exact_leaks(find_leaks(docs, items)).collect()} == want


def texts_of(text):
    mask, parts = blocks(text)
    return [text[b.start : b.end].strip() for b in parts]


def test_blocks():
    assert texts_of("one\ntwo\n\nthree") == ["one\ntwo", "three"]
    assert texts_of("> a\n> b\nc") == ["a\n> b", "c"]
    assert texts_of("ann wrote:\n> a\n> > b\n>\n> c\n\nd") == ["ann wrote:", "a", "b", "c", "d"]
    assert texts_of("x\n<br />\ny\n[b][/b]\nz") == ["x", "y", "z"]
    assert texts_of('[quote="a"]\nq\n[/quote]\nr') == ["q", "r"]
    assert texts_of("text\n-- \nMod\nSent. From v. 2\n\nmore") == ["text", "Mod", "Sent. From v. 2", "more"]
    assert texts_of("***\n\n👍\n\n&nbsp;\n\n[img][/img]") == []
    assert texts_of("") == []


FIXED = [
    ("What a mess! It broke.", ["What a mess!", "It broke."]),
    ("Dr. Halmer paid approx. 5.50 for it. It broke.", ["Dr. Halmer paid approx. 5.50 for it.", "It broke."]),
    ('"Is it dry?" asked Dr. Halmer. It broke. 👍', ['"Is it dry?" asked Dr. Halmer.', "It broke."]),
    ("ann wrote:\n> It\n> broke.\n\nTIA", ["ann wrote:", "It\n> broke.", "TIA"]),
    ("真的吗？！它坏了。", ["真的吗？！", "它坏了。"]),
    ("เลนส์เสีย ปั๊มเสีย", ["เลนส์เสีย", "ปั๊มเสีย"]),
]


@pytest.fixture(scope="module")
def model(spark):
    parts = ["What a mess!", "It broke.", "Dr. Halmer paid approx. 5.50 for it.", '"Is it dry?" asked Dr. Halmer.', "The old pump held.", "She sold the lens."]
    rng = random.Random(1)
    rows = []
    for i in range(600):
        paras = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(3)]
        rows.append((i, "\n\n".join(paras)))
    zh = ["真的吗？！", "它坏了。", "它重3公斤。"]
    rows += [(1000 + i, "\n\n".join("".join(rng.choice(zh) for _ in range(rng.randrange(1, 5))) for _ in range(3))) for i in range(200)]
    return train(parse(documents(spark, rows)))


def units_of(df, model):
    return sentence_units(parse(df), model)


@pytest.mark.parametrize(("text", "units"), FIXED)
def test_units(spark, model, text, units):
    ends = [r["end_pos"] for r in units_of(documents(spark, [(1, text)]), model).orderBy("unit").collect()]
    want, at = [], 0
    for u in units:
        at = text.index(u, at) + len(u)
        want.append(at)
    assert ends == want


def test_unit_cases(spark, model):
    df = documents(spark, [(1, ""), (2, None), (3, "... !!! 👍"), (None, "It broke."), (4, "x" * 50_000), (5, "It broke. " * 3000)])
    got = {}
    for r in units_of(df, model).collect():
        got.setdefault(r["doc_id"], []).append(r["end_pos"])
    assert set(got) == {4, 5} and got[4] == [50_000] and len(got[5]) == 3000
    assert units_of(df.where("false"), model).count() == 0
    untrained = train(parse(df.where("false")))
    assert units_of(documents(spark, [(1, "It broke. It held.")]), untrained).count() in (1, 2)


def test_posteriors_against_all_paths(model):
    """Forward-backward against the sum over every placing of boundaries."""
    from itertools import product

    rng = np.random.default_rng(5)
    rows = [r for r in parsed("Dr. No. It broke. Yes. Ok. It held. approx. 5. Then it broke. A. B. C. It held. Dr. Halmer.") if r[0] == 0]
    g = np.array(rows, np.int64)
    g[:, FLAGS] |= 8 * rng.integers(0, 2, len(g))  # some more chains
    new = np.zeros(len(g), bool)
    new[[0, 6]] = True
    p, alone, s, n = model.factors(g)
    linked = (g[:, FLAGS] & 8) > 0
    want = np.zeros(len(g))
    total = 0.0
    for path in product((0, 1), repeat=len(g)):
        weight = 1.0
        for i, y in enumerate(path):
            before = 1 if new[i] else path[i - 1] if linked[i] else 0
            e = alone[i] if linked[i] and before else p[i]
            weight *= e * s[i] if y else (1 - e) * n[i]
        total += weight
        want += weight * np.array(path)
    assert linked.sum() >= 3 and np.allclose(model.boundaries(g, new), want / total, atol=1e-9)
    assert isinstance(model, Model) and len(set(_pair(g[:, 3], g[:, 5]).tolist())) <= len(g)


def test_reposted_blocks_count_once(spark, monkeypatch):
    import sparvec.llm.sentences as S

    rows = [(i, f"It broke at {i} today. She sold the lens.\n\nDr. Halmer paid. It held.") for i in range(60)] + [(100 + i, "Buy. Now. Cheap.") for i in range(50)]
    held = []
    monkeypatch.setattr(S, "fit", lambda r, n: held.append((r.tolist(), n.tolist())))
    texts = parse(documents(spark, rows))
    for sent in (1_000_000, 0):  # sent to all tasks, or joined
        monkeypatch.setattr(S, "SENT_BLOCKS", sent)
        S.train(texts)
    assert held[0] == held[1] and sum(held[0][1]) == sum(len(parsed(t)) for t in {b for _, t in rows[:60] for b in [t.split("\n\n")[0]]} | {"Dr. Halmer paid. It held.", "Buy. Now. Cheap."})


def test_rare_types_are_kept_in_a_large_corpus(spark, monkeypatch):
    import pyarrow as pa

    import sparvec.llm.sentences as S

    rare = np.array(parsed("Dr. Halmer paid. It held. Rather odd. It broke."), np.int64)
    common = np.array(parsed("It broke. It held."), np.int64)
    texts = []
    for i in range(300):  # 600,000 gaps in blocks of their own
        some = np.concatenate([np.repeat(common[:1], 2_000, axis=0), common[-1:]])
        some[:, 2] = i
        texts.append(some)
    held = []
    monkeypatch.setattr(S, "fit", lambda r, n: held.append((r, n)))
    for part in ([rare], [rare, *texts]):
        rows = pa.array([r.astype("<i8").tobytes() for r in part], pa.binary())
        S.train(spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(part))), "key": pa.array(range(len(part))), "rows": rows})))
    small, large = ({tuple(x[3:]) for x in r.tolist()} for r, _ in held)
    assert small == {tuple(x[3:]) for x in rare.tolist()} and small <= large and held[1][1].sum() > 600_000


def test_long_runs_take_no_square_time(model):
    from time import perf_counter

    from sparvec.llm.sentences import _spans

    t = perf_counter()
    for text in ("It broke." + " " * 200_000 + "It held.", "... " * 50_000 + "It broke.", "👍" * 100_000, "> " * 50_000, "\n" * 100_000, "It broke. " + "\xad" * 100_000):
        _spans(text, model)
    assert perf_counter() - t < 10


def test_units_of_a_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = parse(docs)
    rows = sentence_units(texts, train(texts)).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["unit"], r["end_pos"]))
    for d, ends in by.items():
        e = [p for _, p in sorted(ends)]
        assert e == sorted(set(e)) and e[-1] <= len(text[d]) and all(any(c.isalnum() for c in text[d][a:b]) for a, b in zip([0, *e], e))
