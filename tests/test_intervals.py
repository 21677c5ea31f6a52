"""Interval joins against brute force, with spans of any length."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from captrail.operators import intervals as I


def spans(rng, n, far):
    out = []
    for k in range(n):
        start = rng.uniform(-500, 3000)
        length = rng.choice([0.0, rng.uniform(0, 5), rng.uniform(0, 400), rng.uniform(500, 3000), far, -3.0])
        out.append((rng.randrange(2), k, start, start + length))
    return [*out, (0, n, -math.inf, 10.0), (1, n + 1, 5.0, math.inf), (1, n + 2, 700.0, 8 * 64 + 700.0), (0, n + 3, 0.0, 8.0 * 2**20)]


@pytest.fixture(scope="module", params=[1e9, 1e17])
def tables(spark, request):
    rng = random.Random(6)
    a, b = spans(rng, 60, request.param), spans(rng, 60, request.param)
    p = [(rng.randrange(2), k, rng.uniform(-600, 4000)) for k in range(80)] + [(0, 90, 1e9), (1, 91, 1e12), (0, 92, 1e16), (1, 93, math.inf), (0, 94, None)]
    return (a, spark.createDataFrame(a, "key int, a long, s double, e double")), (b, spark.createDataFrame(b, "key int, b long, t double, u double")), (p, spark.createDataFrame(p, "key int, p long, at double"))


def test_overlap_join(tables):
    (a, left), (b, right), _ = tables
    got = I.overlap_join(left, right, ["key"], (F.col("s"), F.col("e")), (F.col("t"), F.col("u")))
    assert got.columns == ["key", "a", "s", "e", "b", "t", "u"]
    want = Counter((k, i, j) for k, i, s, e in a for m, j, t, u in b if k == m and s <= u and t <= e)
    assert Counter((r.key, r.a, r.b) for r in got.collect()) == want
    some = I.overlap_join(left, right, ["key"], (F.col("s"), F.col("e")), (F.col("t"), F.col("u")), F.col("a") < F.col("b"))
    assert Counter((r.key, r.a, r.b) for r in some.collect()) == Counter(x for x in want if x[1] < x[2])


def test_points_in_spans(tables):
    (a, left), _, (p, points) = tables
    got = I.points_in_spans(left, points, ["key"], (F.col("s"), F.col("e")), F.col("at"))
    assert Counter((r.key, r.a, r.p) for r in got.collect()) == Counter((k, i, j) for k, i, s, e in a for m, j, t in p if k == m and t is not None and s <= t <= e)


def test_a_span_lies_in_few_bins(spark):
    long = spark.createDataFrame([(1, float(k), float(k) + 10.0**k) for k in range(3, 18)], "key int, _ls double, _le double")
    level = F.ceil(F.log2((F.col("_le") - F.col("_ls")) / 8))
    size = F.lit(8.0) * F.pow(F.lit(2.0), level)
    rows = long.withColumn("bin", I._bins(F.col("_ls"), F.col("_le"), size)).groupBy("_ls").count()
    assert rows.agg(F.max("count")).first()[0] <= 3
