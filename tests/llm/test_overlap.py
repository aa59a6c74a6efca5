import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm.overlap import banded_distance, cross_split_overlaps, overlap_pairs, rarest_segments

SCHEMA = "sample_id long, split string, body string, parent_body string"


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(1, 4), max_size=12)), min_size=1, max_size=5), st.integers(0, 6))
def test_band(pairs, band):
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    pad = lambda k, w: np.array([p[k] + [0] * (w - len(p[k])) for p in pairs], np.uint64).reshape(len(pairs), w)
    got = banded_distance(pad(0, n.max()), n, pad(1, m.max()), m, band)
    for g, (a, b) in zip(got, pairs, strict=True):
        want = distance(a, b)
        assert g == want if want <= band else g > band


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 3), st.integers(1, 3), st.data())
def test_rarest_segments_are_disjoint_and_cheapest(size, need, data):
    starts = data.draw(st.integers(size * (need - 1) + 1, size * need + 5))
    cost = np.array([data.draw(st.lists(st.integers(0, 9), min_size=starts, max_size=starts))], float)
    got = rarest_segments(cost, size, need)[0]
    assert all(b - a >= size for a, b in zip(got, got[1:], strict=False))

    def best(at, left):
        if not left:
            return 0
        return min((cost[0][i] + best(i + size, left - 1) for i in range(at, starts)), default=float("inf"))

    assert cost[0][got].sum() == best(0, need)


def words(rng, n):
    return [rng.choice("red blue green old new cold warm small great lost found slow".split()) + str(rng.randrange(30)) for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = "changed" + str(rng.randrange(99))
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "put" + str(rng.randrange(99)))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        text = words(rng, rng.choice([4, 5, 7, 9, 11, 12, 14, 20, 33, 60, 120]))
        rows.append((i, "train", " ".join(text), None))
        if i % 2:
            k = rng.randrange(0, len(text) // 4 + 1)
            rows.append((1000 + i, rng.choice(["test", "validation"]), "> " + ", ".join(edited(rng, text, k)).upper(), ""))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.eval_id, r.train_id, r.field) for r in overlap_pairs(*cross_split_overlaps(df)).collect()}
    import re

    toks = {i: re.findall(r"[^\W_]+", b.lower()) for i, _, b, _ in rows}
    toks = {i: t for i, t in toks.items() if len("".join(t)) >= 20}
    want = {
        (e, t, "body")
        for e in toks if e >= 1000 for t in toks if t < 1000
        if distance(toks[e], toks[t]) <= max(len(toks[e]), len(toks[t])) // 5
    }
    assert got == want and len(want) > 20


def test_one_phrase_in_half_of_all_texts(spark):
    """A phrase that half of the texts hold is chosen as a segment by many; with several rounds and salts no link is lost."""
    rng = random.Random(8)
    phrase = "please read the rules before you post here again".split()
    texts = {}
    for i in range(240):
        text = words(rng, rng.choice([3, 4, 6, 12, 30]))
        if i % 2:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + phrase + text[at:]
        texts[i] = text
        if i % 4 == 1:
            texts[1000 + i] = edited(rng, text, rng.randrange(0, len(text) // 4 + 1))
    rows = [(i, "train" if i < 1000 and i % 8 != 3 else "test", " ".join(t), None) for i, t in texts.items()]
    texts = {i: t for i, t in texts.items() if len("".join(t)) >= 20}
    want = {
        (e, t) for e, se, _, _ in rows for t, st_, _, _ in rows
        if se == "test" and st_ == "train" and e in texts and t in texts
        and distance(texts[e], texts[t]) <= max(len(texts[e]), len(texts[t])) // 5
    }
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for size in ({}, {"round_words": 400, "hot_key": 9}):
        got = {(r.eval_id, r.train_id) for r in overlap_pairs(*cross_split_overlaps(df, **size)).collect()}
        assert got == want and len(want) > 40


def test_copies_fields_and_edges(spark):
    a = "this sentence is long enough to count as a text"
    fields = "Goal: paint the shed | Cost: two hundred coins"
    turned = "cost: Two Hundred Coins\ngoal: paint the shed"
    rows = [
        (1, "train", a, fields), (2, "TRAIN", a.upper(), None), (3, "test", a + "!", turned), (4, "validation", None, ""),
        (5, None, a, fields), (6, "test", "short", None), (7, "dev", a, None), (None, "test", a, None), (3, "test", a + "!", turned),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", class int")
    members, links = cross_split_overlaps(df)
    got = Counter((r.eval_id, r.train_id, r.field, r.edits) for r in overlap_pairs(members, links).collect())
    assert set(got) == {(3, 1, "body", 0), (3, 2, "body", 0), (3, 1, "parent_body", 0)}
    assert links.count() == 2
    assert cross_split_overlaps(spark.createDataFrame([], SCHEMA))[1].collect() == []
    assert cross_split_overlaps(df.where("split = 'train'"))[1].collect() == []


def test_hot_text(spark):
    hot = "the very same words again and again in every row of it"
    rows = [(i, "train" if i % 3 else "test", hot, None) for i in range(900)]
    members, links = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA).repartition(9))
    assert links.count() == 1 and members.count() == 900


def test_each_spacing_of_a_text_is_compared(spark):
    apart = "we don't sell second hand books in this small town"
    joined = "we dont sell secondhand books in this small town"
    near = "we dont sell secondhand magazines in this small town"  # one edit from joined, four of ten words from apart
    for side, other in (("train", "test"), ("test", "train")):
        for first, second in ((apart, joined), (joined, apart)):
            rows = [(1, side, first, None), (2, side, second, None), (3, other, near, None)]
            members, links = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA).coalesce(1))
            assert [r.edits for r in links.collect()] == [1]
            assert {frozenset((r.eval_id, r.train_id)) for r in overlap_pairs(members, links).collect()} == {frozenset((1, 3)), frozenset((2, 3))}


def test_lists_carry_over(spark):
    listed, lost = "goal: paint the shed | cost: two hundred coins", "Goal paint the shed, cost two hundred coins"
    turned = "cost: two hundred coins; goal: paint the shed"
    pairs = lambda rows: {
        (r.eval_id, r.train_id, r.edits)
        for r in overlap_pairs(*cross_split_overlaps(spark.createDataFrame([(*r, None) for r in rows], SCHEMA))).collect()
    }
    assert pairs([(1, "test", lost), (2, "train", listed), (3, "train", turned)]) == {(1, 2, 0), (1, 3, 0)}
    assert pairs([(1, "train", lost), (2, "test", listed), (3, "test", turned)]) == {(2, 1, 0), (3, 1, 0)}
    # The same letters as two lists, each with a copy in the other order.
    one, two = "red barn: left side | of town: north", "red barn: left | side of town: north"
    one_turned, two_turned = "of town: north | red barn: left side", "side of town: north | red barn: left"
    got = pairs([(1, "train", one), (2, "train", two), (3, "test", one_turned), (4, "train", two_turned)])
    assert got == {(3, 1, 0), (3, 2, 0), (3, 4, 0)}
