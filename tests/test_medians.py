"""Exact medians by rounds against sorted lists, and origins by suffixes against the rule as it reads."""

import math
import random

import pytest
from docloom.operators import medians, relational
from pyspark.sql import functions as F


def upper(values):
    held = sorted((v for v in values if v is not None), key=lambda v: (v != v, 0.0 if v != v else v))
    return held[len(held) // 2] if held else None


def same(a, b):
    return a == b or (a != a and b != b)


def keyed(seed):
    r = random.Random(seed)
    makers = {
        "even": lambda: r.random() * 100,
        "tiny": lambda: 2.0 ** -r.randrange(1000),
        "huge": lambda: r.choice([-1, 1]) * 1.7e308 * r.random(),
        "odd": lambda: r.choice([None, math.nan, math.inf, -math.inf, 0.0, r.random()]),
        "nans": lambda: r.choice([math.nan, math.nan, 1.0]),
        "one": lambda: 7.0,
        "none": lambda: None,
        None: lambda: float(r.randrange(5)),
    }
    return [(k, make()) for k, make in makers.items() for _ in range(r.choice([1, 2, 700, 701]))] + [("hot", r.gauss(0, 1)) for _ in range(5000)]


@pytest.mark.parametrize("spread", [True, False, None])
def test_medians_equal_sorted_lists(spark, spread):
    rows = keyed(1)
    got = {r.k: r.mid for r in medians.upper_medians(spark.createDataFrame(rows, "k string, x double").repartition(8), ["k"], "x", spread=spread, most=3).collect()}
    want = {k: upper(v for j, v in rows if j == k) for k in {r[0] for r in rows}}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys()
    assert all(same(got[k], want[k]) for k in want), [(k, got[k], want[k]) for k in want if not same(got[k], want[k])]


def test_whole_numbers_that_doubles_cannot_tell_apart(spark):
    big = 2**62
    df = spark.range(2001).select(F.lit("a").alias("k"), (F.col("id") + big).alias("x"))
    assert medians.upper_medians(df, ["k"], "x", spread=True, most=2001 // 2).first().mid == big + 1000
    assert medians.upper_medians(df.limit(0), ["k"], "x", spread=True).count() == 0


def admits(origin, patterns):
    """The rule as it reads, pattern by pattern."""
    from urllib.parse import urlsplit

    if not origin or not (host := urlsplit(origin).hostname):
        return False
    for p in (x.strip().lower() for x in patterns if x and x.strip()):
        scheme, _, rest = p.rpartition("://")
        bare = rest.split("/")[0]
        if p in ("*", origin.lower()) or (bare.startswith("*.") and (host == bare[2:] or host.endswith("." + bare[2:]))):
            return True
        if bare and bare == host and origin.lower().startswith(f"{scheme}://" if scheme else ""):
            return True
    return False


ORIGINS = ["https://a.b.example", "http://A.B.example", "https://example", "https://b.example:8443", "https://notexample", "ftp://x.com/path", "https://com", "plain", "", None, "https://a.b.example"]


@pytest.mark.parametrize("patterns", [["*.example"], ["*"], ["https://*.b.example/x"], ["http://a.b.example"], ["b.example"], ["https://b.example:8443"], [" COM ", None, ""], [], ["*.com", "example"], ["*.a.b.example", "https://com/"]])
def test_origins(spark, patterns):
    o, p = spark.createDataFrame([(x,) for x in ORIGINS], "origin string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = sorted(r.origin for r in relational.origin_allowed(o, p).collect())
    assert got == sorted(x for x in ORIGINS if x and admits(x, patterns))


def test_many_patterns_need_no_nested_loop(spark):
    o = spark.range(1000).select(F.concat(F.lit("https://h"), F.col("id"), F.lit(".n"), F.col("id") % 100, F.lit(".org")).alias("origin"))
    p = spark.range(100_000).select(F.concat(F.lit("*.n"), F.col("id") + 50, F.lit(".org")).alias("pattern"))
    out = relational.origin_allowed(o, p)
    assert out.count() == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
