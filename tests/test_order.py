"""Order scores against dynamic programming, and the queries over documents against a plain version."""

import random

import pytest
from docloom.operators import order
from docloom.plans import catalogue


def table_of_lengths(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("letters", [2, 5, 40, 1000])
def test_common_length_equals_dynamic_programming(letters):
    r = random.Random(letters)
    for _ in range(60):
        a = [r.randrange(letters) for _ in range(r.randrange(90))]
        b = list(a) if r.random() < 0.5 else [r.randrange(letters) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(6)):
            if b:
                x = b.pop(r.randrange(len(b)))
                b.insert(r.randrange(len(b) + 1), x)
        assert order.common_length(a, b) == table_of_lengths(a, b)


def test_both_ways_give_the_same():
    r = random.Random(3)
    for letters in (1, 3, 30):
        a, b = ([r.randrange(letters) for _ in range(70)] for _ in range(2))
        places = {}
        for j, x in enumerate(b):
            places.setdefault(x, []).append(j)
        kept = [x for x in a if x in places]
        assert order._chain(kept, places) == order._bits(kept, places, len(b)) == table_of_lengths(a, b)


def test_long_texts_of_one_word_and_reversed_ones():
    assert order.common_length(["x", "y"] * 5000, ["y"] * 20000) == 5000
    assert order.common_length(list(range(200_000)), list(range(200_000))[::-1]) == 1
    assert order.common_length([], ["a"]) == 0


def test_empty_and_missing_texts(spark):
    rows = spark.createDataFrame([(1, None, "a b"), (2, " \n", None), (3, "a b c", "c a b"), (4, "a b", "")], "id int, truth string, out string")
    got = {r.id: (r.total, r.ordered, r.order_score) for r in order.order_scores(rows, "truth", "out").collect()}
    assert got == {1: (0, 0, 1.0), 2: (0, 0, 1.0), 3: (3, 2, 2 / 3), 4: (2, 0, 0.0)}


def test_bases_of_ties_missing_values_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "s", "a\nb"), (2, "s", "c\nd"), (3, "s", "a\n d \nb\nc"), (4, "t", "a"), (5, None, "a"), (6, "s", None), (7, "s", " \n"), (8, "s", "d\nd\na")], "id int, source string, text string")
    lined = order.lines(docs, "id", "source", "text")
    assert sorted(tuple(r) for r in order.bases(lined, "id", "source").collect()) == [(3, 1, 2), (8, 2, 2)]
    moved = order.moved_lines(lined, order.bases(lined, "id", "source"), "id")
    assert sorted(tuple(r) for r in moved.collect()) == [(3, 1, 2, 0.5, 1.0)]
    assert order.bases(lined.limit(0), "id", "source").count() == 0


def test_query_equals_dynamic_programming(spark, sf):
    texts = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["order_scores"](spark, sf).collect()
    assert rows and all(r.base < r.doc_id for r in rows)
    for r in rows:
        if len(texts[r.base]) * len(texts[r.doc_id]) < 1_000_000:
            assert (r.total, r.ordered) == (len(texts[r.base]), table_of_lengths(texts[r.base], texts[r.doc_id]))
