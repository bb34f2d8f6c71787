"""Patterns that can match, and words replaced in one pass, against regular expressions."""

import collections
import random
import re

import pytest
from docloom.operators import patterns
from docloom.plans import catalogue, classify
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("abc", {"abc"}), ("(?i)ABC|De+f", {"abc", "d"}), ("a?bc*", {"b"}), ("(?:ab|x*)c", {"c"}), ("[ab]", set()), ("x|y?", set()), (r"^\s*(?:foo)+\d+barn", {"barn"}), ("(a(bc|bd)){2}", {"a"}), ("a.*", {"a"})],
)
def test_literals_that_a_match_needs(pattern, literals):
    assert patterns.needed(pattern) == literals


def test_every_pattern_of_the_classifier_needs_a_literal():
    found = [patterns.needed(p) for p in [*classify.patterns_of(classify.RULES), classify.CREATIVE]]
    assert sum(1 for f in found if f and min(map(len, f)) >= 2) >= 0.8 * len(found)


def test_what_cannot_match_does_not(spark):
    """Texts made of the patterns' own literals: where a pattern matches, it is among the possible ones."""
    every, r = classify.patterns_of(classify.RULES), random.Random(1)
    pool = sorted({w for p in every for w in re.findall(r"[^\W\d_][\w ]+", p)} | {w for p in every for w in patterns.needed(p)})
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(8))).upper() if i % 3 == 0 else r.choice(["\n", " ", ": "]).join(r.choice(pool) for _ in range(r.randrange(8))) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").withColumn("may", patterns.possible(F.col("t"), every))
    rows = df.select("i", "may", F.array(*(F.col("t").rlike(p) for p in every)).alias("does")).collect()
    assert sum(sum(r.does) for r in rows if r.i >= 0) > 200 and all(not d or m for r in rows if r.i >= 0 for d, m in zip(r.does, r.may, strict=True))
    assert sum(sum(r.may) for r in rows if r.i >= 0) < 0.5 * len(every) * len(texts)
    plain, guarded = (df.select("i", classify.score_columns(F.col("t"), classify.RULES, m).alias("s")).filter("i >= 0").orderBy("i").collect() for m in (None, F.col("may")))
    assert plain == guarded


@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text("abcd", max_size=60))
@settings(max_examples=300, deadline=None)
def test_the_longest_words_from_the_left(words, text):
    held = tuple(sorted(words))
    want = [(m.start(), m.end()) for m in re.finditer("|".join(sorted(map(re.escape, words), key=len, reverse=True)), text)]
    assert [(b, e) for b, e, _ in patterns._longest(text, patterns._automaton(held))] == want


def test_corpus_dictionary(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    n = collections.Counter(w for r in docs for w in re.findall(r"[^\x20\x09-\x0D]{2,}", r.text or ""))
    rank = {w: i for i, (w, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[: catalogue.DICTIONARY_WORDS], 1)}
    every = re.compile("|".join(map(re.escape, sorted(rank, key=len, reverse=True))))
    got = {r.doc_id: (r.text, r.n_replaced) for r in catalogue.QUERIES["corpus_dictionary"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs[:60]:
        assert got[r.doc_id] == every.subn(lambda m: f"⟨{rank[m[0]]}⟩", r.text or "")
    small = spark.createDataFrame([(1, None), (2, ""), (3, "aab")], "id int, t string")
    words = spark.createDataFrame([("a", "1"), ("aa", "2"), ("aa", "3"), ("b", " "), ("", "x"), (None, "y")], "word string, replacement string")
    assert sorted(map(tuple, patterns.replaced_at_once(small, "t", words).collect())) == [(1, None, 0), (2, "", 0), (3, "2b", 1)]
    assert patterns.replaced_at_once(small, "t", words.limit(0)).filter("id = 3").first().t == "aab"


def test_a_dictionary_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(patterns, "MOST_CHARACTERS", 3)
    with pytest.raises(ValueError, match="characters"):
        patterns.replaced_at_once(spark.createDataFrame([("x",)], "t string"), "t", spark.createDataFrame([("abc", "d")], "word string, replacement string"))
