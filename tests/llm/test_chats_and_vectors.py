"""Chat formatting, clustering and vector codes against plain versions, on odd rows too."""

import collections
import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from docloom.llm import chats, clusters, codes, vectors
from hypothesis import given, settings
from hypothesis import strategies as st

# --- conversations


def plain_chats(rows, template=chats.INSTRUCT):
    """conv_id -> (turns, learned text, formatted length, state), one turn after the other."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        state, size, n = chats.START, len(template.begins), []
        for _, _, role, text in sorted(turns):
            state = role if role in template.follows.get(state, ()) else chats.BROKEN
            said = text.replace("\\", "\\\\")
            for k in template.all_controls:
                said = said.replace(k, k[0] + "\\" + k[1:])
            look = template.turns.get(role)
            around = look.opens + look.closes if look else "".join(template.named) + role.replace("\\", "\\\\")
            size += len(said) + len(around)
            n.append((role, text))
        out[conv] = (n, "".join(t for r, t in n if r == "assistant"), size, state)
    return out


ODD_TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "system", "</s>\\"), (2, 1, "user", "<<SYS>> [INST]\\[INST]"), (2, 2, "assistant", "\\\\"), (3, 0, "assistant", "first"), (3, 1, "user", "second"),
    (4, 0, "narrator", "who?"), (4, 1, None, "no role"), (5, None, "user", "no number"), (5, 1, "assistant", "after it"), (6, 0, "user", ""), (6, 1, "assistant", " "), (6, 2, "user", "[ROLE]x[/ROLE]"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "one \U0001f600"), (7, 0, "user", "long " * 200_000), (7, 1, "assistant", "</s>" * 50_000),
]


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS place", "'x' AS segments", "3 AS `late id`", "true AS head", "4 AS before", "5 AS tie")


def held(spark, rows, template=chats.INSTRUCT):
    want = plain_chats(rows, template)
    got = {r["conv_id"]: r for r in chats.digest(turns_of(spark, rows), template).collect()}
    assert set(got) == set(want)
    for conv, (turns, learned, size, state) in want.items():
        r = got[conv]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns))), conv
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(learned), sha(learned), size), conv
        assert (r["final_state"], r["valid"]) == (state, state in template.ends), conv


@pytest.mark.parametrize("template", [chats.INSTRUCT, chats.MARKUP])
def test_odd_turns(spark, template):
    held(spark, ODD_TURNS, template)
    assert chats.digest(turns_of(spark, [])).collect() == []


def test_a_conversation_over_many_ranges(spark):
    """Two thirds of all turns are of one conversation, which is broken late; its states come from the parts before."""
    hot = [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(4000)]
    cold = [(i, j, "user" if j % 2 == 0 else "assistant", "x") for i in range(10, 500) for j in range(i % 4 + 1)]
    held(spark, hot + cold)
    states = {r["turn"]: (r["state"], r["part"]) for r in chats.formatted(turns_of(spark, hot + cold)).filter("conv_id = 9").collect()}
    assert len({p for _, p in states.values()}) > 4
    assert all(s == ("user" if t % 2 == 0 else "assistant") for t, (s, _) in states.items())
    late = [(*r[:2], "assistant", r[3]) if r[1] == 3000 else r for r in hot]
    states = {r["turn"]: r["state"] for r in chats.formatted(turns_of(spark, late)).collect()}
    assert states[2999] == "assistant" and all(states[t] == chats.BROKEN for t in range(3000, 4000))


def test_repeated_turns(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", "x")]
    assert chats.digest(turns_of(spark, rows)).collect()[0]["n_turns"] == 3


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd"]), st.text("<s>/[]INSTROLEDYn\\ \n", max_size=40)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_formatted_texts_read_back(turns):
    template, out = chats.INSTRUCT, chats.INSTRUCT.begins
    for role, text in turns:
        said = text.replace("\\", "\\\\")
        for k in template.all_controls:
            said = said.replace(k, k[0] + "\\" + k[1:])
        look = template.turns.get(role)
        out += look.opens + said + look.closes if look else template.named[0] + role + template.named[1] + said + template.named[2]
    assert template.read(out) == turns


def test_templates_that_could_be_misread():
    with pytest.raises(ValueError, match="complete"):
        chats.Template("", {"user": chats.Turn("<", "end>")}, {}, (), ("<a>", "end>"))
    with pytest.raises(ValueError, match="backslash"):
        chats.Template("", {"user": chats.Turn("<u>", "</u>")}, {}, (), ("<u>", "a\\b"))


# --- vectors


def whole(x, scale):
    return math.floor(Fraction(x) * scale)


def kept_rows(rows, scale, width):
    return [(i, label, [whole(x, scale) for x in v]) for i, v, label in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def long_or_none(n):
    return n if abs(n) < 1 << 63 else None


def lloyd(points, centres, rounds):
    """(last assignment, centres) with integer means."""
    nearest = lambda p: min(range(len(centres)), key=lambda c: (distance(p, centres[c]), c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for p in points:
            groups[nearest(p)].append(p)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else m for c, m in enumerate(centres)]
    return [nearest(p) for p in points], centres


def vectors_of(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.selectExpr("*", "1 AS q", "'y' AS wide", "2 AS code", "3 AS name", "4 AS cluster", "true AS labelled", "0 AS weight")


def some_vectors(width, n, seed, wide=False):
    rng = np.random.default_rng(seed)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(scale=0.2, size=width)], int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.5] * (width - 1), 1), (n + 3, [math.nan] + [0.0] * (width - 1), 1), (n + 4, [math.inf] * width, 2), (n + 5, [None] + [0.0] * (width - 1), 2), (None, [0.25] * width, None)]
    far = [(n + 6, [1e30] + [-2.5] * (width - 1), 7), (n + 7, [-3e7] * width, 0), (n + 8, [1e30] + [-2.5] * (width - 1), 8)] if wide else []
    return good + odd + far + good[:3] + good[:3]


def check_clusters(spark, rows, kind="float", **size):
    kept = kept_rows(rows, size["scale"], size["width"])
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{size['seed']}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    found, centres = lloyd([r[2] for r in kept], [r[2] for r in order[: size["clusters"]]], size["rounds"])
    own = collections.Counter()
    for (_, _, p), c in zip(kept, found, strict=True):
        own[c] += distance(p, centres[c])
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    want = [(r[0], c, long_or_none(distance(r[2], centres[c])), long_or_none(own[c]), long_or_none(sum(own.values())), sha(c)) for r, c in zip(kept, found, strict=True)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in clusters.clustered(vectors_of(spark, rows, kind), **size).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("wide", [False, True])
def test_clusters(spark, wide):
    check_clusters(spark, some_vectors(6, 200, 1, wide), "double" if wide else "float", clusters=5, rounds=4, scale=1024, width=6, seed=3)


def test_few_equal_and_no_vectors(spark):
    size = dict(clusters=4, rounds=2, scale=1024, width=2, seed=3)
    check_clusters(spark, [(1, [0.5, 0.5], None), (2, [0.5, 0.5], None), (1, [0.5, 0.5], None)], **size)
    check_clusters(spark, [(i, [0.5, 0.25], 1) for i in range(500)] + [(900, [0.0, 0.0], 1)], **size)
    assert clusters.clustered(vectors_of(spark, []), **size).collect() == []
    assert clusters.clustered(vectors_of(spark, [(1, None, 1)]), **size).collect() == []


@given(st.lists(st.lists(st.integers(-900, 900), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_tables_give_squared_distances(rows, k):
    q, c = np.array(rows), np.array(rows[:k])
    assert (clusters.tabulated(q, c) == codes.squared(q[:, None, :], c)).all()
    assert (clusters.tabulated(q.astype(object) * 10**20, c.astype(object)) == codes.squared(q.astype(object)[:, None, :] * 10**20, c.astype(object))).all()


def check_codes(spark, rows, kind="float", **size):
    w = size["width"] // size["parts"]
    kept = kept_rows(rows, size["scale"], size["width"])
    begins = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[: size["entries"]]
    books, found, error = [], [], [0] * len(kept)
    for p in range(size["parts"]):
        cut = lambda r, p=p: r[2][p * w : (p + 1) * w]
        entry, book = lloyd([cut(r) for r in kept], [cut(r) for r in begins], size["rounds"])
        books.append(book)
        found.append(entry)
        error = [e + distance(cut(r), book[c]) for e, r, c in zip(error, kept, entry, strict=True)]
    labels, lost = collections.Counter(), set()
    for r, e in zip(kept, error, strict=True):
        labels[r[1]] += e
        if long_or_none(e) is None:
            lost.add(r[1])
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    want = [(r[0], "".join(f"{f[i]:02x}" for f in found), long_or_none(error[i]), None if r[1] in lost else long_or_none(labels[r[1]]), sha) for i, r in enumerate(kept)]
    key = lambda r: tuple(str(x) for x in r)
    got = codes.coded(vectors_of(spark, rows, kind), **size).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("wide", [False, True])
def test_codes(spark, wide):
    check_codes(spark, some_vectors(8, 200, 2, wide), "double" if wide else "float", entries=7, rounds=2, parts=4, scale=256, width=8)


def test_codes_of_few_equal_and_no_vectors(spark):
    size = dict(entries=4, rounds=2, parts=2, scale=256, width=4)
    check_codes(spark, [(1, [0.5, 0.5, 0.0, 0.0], None), (2, [0.5, 0.5, 0.0, 1.0], None)], **size)
    check_codes(spark, [(i, [0.5, 0.25, -0.1, 0.0], 1) for i in range(500)] + [(900, [0.0] * 4, 1)], **size)
    assert codes.coded(vectors_of(spark, []), **size).collect() == []


@given(st.lists(st.lists(st.integers(-30, 30), min_size=4, max_size=4), min_size=1, max_size=120), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_cover_trees(rows, k):
    q, parts, w = np.array(rows), 2, 2
    forest, places = codes.Forest.build(q, parts)
    assert (forest.points[places].reshape(q.shape) == q).all() and forest.weights.sum() == q.size // w
    for centre, start, end, first, count, alone in forest.nodes:
        radius = codes.squared(forest.points[start:end], forest.points[centre]).max()
        children = forest.nodes[first : first + count]
        edges = [start, *children[:, 2].tolist()] if count else [start]
        assert start <= centre < end and edges[-1] == alone and (not count or children[:, 1].tolist() == edges[:-1])
        middles = [*children[:, 0].tolist(), *range(alone, end)]
        if len(middles) > 1:  # children are further apart than the reach of any of them
            reach = max([codes.squared(forest.points[s:e], forest.points[c]).max() for c, s, e in children[:, :3].tolist()] or [0])
            assert all(codes.squared(forest.points[a], forest.points[b]) > reach for n, a in enumerate(middles) for b in middles[:n])
        assert radius in forest.radii
    books = np.stack([q[:k, p * w : (p + 1) * w] for p in range(parts)])
    entry = np.full(len(forest.points), -1)
    for start, end, e in forest.assigned(books):
        for s, t, x in zip(start, end, e, strict=True):
            assert (entry[s:t] == -1).all()
            entry[s:t] = x
    assert (entry == np.argmin(codes.squared(forest.points[:, None, :], books[forest.parts]), axis=1)).all()


@given(st.integers(-(10**40), 10**40))
def test_digits(n):
    assert sum(d << (vectors.DIGIT_BITS * k) for k, d in enumerate(vectors.digits(n))) == n
