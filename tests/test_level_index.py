"""Sums and differences of level indices against exact numbers, where these exist."""

import math
import random

from pyspark.sql import functions as F

from tessella.functions import numbers


def index(x):
    level = 0
    while x > 1:
        x, level = math.log(x), level + 1
    return level + x


def number(x):
    level = math.floor(x)
    x -= level
    for _ in range(level):
        x = math.exp(x)
    return x


def combined(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, x double, y double")
    df = df.select("k", numbers.add_level_index(F.col("x"), F.col("y")).alias("sum"), numbers.subtract_level_index(F.col("x"), F.col("y")).alias("difference"))
    return [(r["sum"], r.difference) for r in sorted(df.collect())]


def test_numbers_that_a_double_holds(spark):
    r = random.Random(4)
    values = [(r.choice([-1, 1]) * 10 ** r.uniform(-3, 12), r.choice([-1, 1]) * 10 ** r.uniform(-3, 12)) for _ in range(300)]
    values += [(1.0, 1.0), (0.0, 0.0), (0.0, 5.0), (3.0, 0.0), (0.5, 0.5), (1.0, 2.0), (7.0, 7.0), (2.0, 1.5), (math.e, 1.0), (100.0, 99.0), (1e9, 1e9)]
    signed = lambda v: math.copysign(index(abs(v)), v) if v else 0.0
    got = combined(spark, [(signed(a), signed(b)) for a, b in values])
    for (a, b), (plus, minus) in zip(values, got, strict=True):
        for want, have in ((a + b, plus), (a - b, minus)):
            back = math.copysign(number(abs(have)), have)
            assert math.isclose(back, want, rel_tol=1e-8, abs_tol=1e-8 * (abs(a) + abs(b))), (a, b, want, back)


def test_numbers_far_beyond_a_double(spark):
    """exp(p) and exp(q) with p, q up to 1e300: the logarithm of the sum is known."""
    cases = [(1e6, 1e6 - 1), (1e6, 5e5), (1e300, 1e300), (1e300, 1e10), (5000.0, 4999.5), (5000.0, 4000.0), (1e5, 1e5 - 1e-3)]
    got = combined(spark, [(1 + index(p), 1 + index(q)) for p, q in cases])
    for (p, q), (plus, minus) in zip(cases, got, strict=True):
        assert math.isclose(plus, 1 + index(p + math.log1p(math.exp(q - p))), rel_tol=1e-9)
        if p - q > 1e-6:
            assert math.isclose(minus, 1 + index(p + math.log1p(-math.exp(q - p))), rel_tol=1e-6)
        elif p == q:
            assert minus == 0


def test_laws(spark):
    r = random.Random(8)
    pairs = [(r.uniform(-7, 7), r.uniform(-7, 7)) for _ in range(200)] + [(6.5, 6.5), (6.9, 0.1), (7.2, -7.2)]
    forth, back = combined(spark, pairs), combined(spark, [(y, x) for x, y in pairs])
    for (x, y), (plus, minus), (plus2, minus2) in zip(pairs, forth, back, strict=True):
        assert plus == plus2 and minus == -minus2
        big = max(abs(x), abs(y))
        assert abs(plus) <= big + 1 and (x * y < 0 or abs(plus) >= big - 1e-12)
        if big > 5.5 and abs(abs(x) - abs(y)) > 0.1:  # the smaller one is nothing beside the larger one
            assert math.isclose(abs(plus), big, rel_tol=1e-12)
    assert combined(spark, [(None, 1.0), (1.0, None)]) == [(None, None)] * 2
