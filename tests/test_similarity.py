"""The prefix-filtered bigram join against all pairs."""

import collections
import random
import time

import pytest
from docloom.operators import relational


def grams(t):
    return collections.Counter(t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 1 else collections.Counter([t] if t else [])


def likeness(s, t):
    a, b = grams(s), grams(t)
    common = sum((a & b).values())
    return (common / sum(a.values()) + common / sum(b.values())) / 2 if common else 0.0


def brute(left, right, least, share):
    out = {}
    for i, k, p, s in left:
        for j, m, q, t in right:
            if k is None or k != m or s is None or t is None or (p is not None and q is not None and abs(p - q) > 1):
                continue
            if min(len(s), len(t)) >= share * max(len(s), len(t)) and (x := likeness(s, t)) >= least:
                out[i, j] = x
    return out


def texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd \U0001f600") for _ in range(r.choice([1, 2, 8, 30]))) for _ in range(12)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = r.choice("abxy")
        out.append((i, r.choice(["k", "k", "m", None]), r.choice([1, 2, 3, None]), r.choice(["".join(t)] * 9 + [None, ""])))
    return out


@pytest.mark.parametrize(("least", "share"), [(0.6, 0.25), (0.9, 0.0), (0.4, 0.5), (1.0, 0.25)])
def test_candidates_are_all_pairs_above_the_bound(spark, least, share):
    left, right = texts(1, 60), texts(2, 60)
    df = lambda rows: spark.createDataFrame(rows, "id long, k string, page int, text string")
    got = {(r.a, r.b): r.similarity for r in relational.match_candidates(df(left), df(right), least, share, ("k",)).collect()}
    want = brute(left, right, least, share)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert relational.match_candidates(df(left).limit(0), df(right), least, share, ("k",)).collect() == []


def test_matched_turns_take_the_best_pair_again_and_again(spark, sf):
    from docloom.plans import catalogue

    pairs = sorted(catalogue.QUERIES["similar_turns"](spark, sf).collect(), key=lambda r: (-r.similarity, r.a, r.b))
    used, want = set(), set()
    for r in pairs:
        if ("a", r.a) not in used and ("b", r.b) not in used:
            used |= {("a", r.a), ("b", r.b)}
            want.add((r.a, r.b))
    got = {(r.a, r.b) for r in catalogue.QUERIES["matched_turns"](spark, sf).collect()}
    assert got == want and want


def test_bigrams_of_long_texts(spark, monkeypatch):
    rows = [(1, "abcab" * 40), (2, "é"), (3, ""), (4, None), (5, "x\U0001f600" * 20), (6, "a\nb\r\n" * 30)]
    df = spark.createDataFrame(rows, "id int, t string")
    for piece in ((1, 1), (7, 2), (64, 8), relational.PIECE_CHARS):
        monkeypatch.setattr(relational, "PIECE_CHARS", piece)
        got = collections.defaultdict(collections.Counter)
        for r in relational.bigrams(df, "id", "t").collect():
            got[r.id][r.gram] = r.n
        assert got == {i: grams(t) for i, t in rows if t}
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 100_000)], "id int, t string").repartition(1)
    began = time.perf_counter()
    assert sum(r.n for r in relational.bigrams(long, "id", "t").collect()) == 1_799_999
    assert time.perf_counter() - began < 20
