"""Number theory as column expressions over BIGINT and DECIMAL columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; BIGINTs need at most 92."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))))["x"]


def gcd_of(values: Column) -> Column:
    """Of an array; 0 if it is empty."""
    return F.aggregate(values, F.lit(0).cast("long"), gcd)


def bezout(a: Column, b: Column) -> Column:
    """(g, m, n) with g = gcd(a, b) = m a + n b, for positive a and b."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    names = ("r", "s", "t", "r2", "s2", "t2")
    struct = lambda *c: F.struct(*(x.cast("long").alias(n) for x, n in zip(c, names, strict=True)))

    def step(x: Column, _: Column) -> Column:
        q = F.floor(x["r"] / F.when(x["r2"] == 0, 1).otherwise(x["r2"]))
        return F.when(x["r2"] == 0, x).otherwise(struct(x["r2"], x["s2"], x["t2"], x["r"] - q * x["r2"], x["s"] - q * x["s2"], x["t"] - q * x["t2"]))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(92)), struct(a, one, zero, b, zero, one), step)
    return F.struct(done["r"].alias("g"), done["s"].alias("m"), done["t"].alias("n"))


def factorial(n: Column) -> Column:
    """Null beyond 20, where a BIGINT ends."""
    return F.factorial(n)


def is_prime(n: Column) -> Column:
    """No divisor from 2 to the root; 1 counts as prime, as it has none. Null and smaller numbers: null."""
    small = F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(n)).cast("long"), F.lit(2).cast("long")))
    return F.when(n >= 1, ~F.exists(small, lambda d: (d * d <= n) & (n % d == 0)))


def square_roots(s: Column, modulus: Column) -> Column:
    """All r from 0 to modulus - 1 with r r = s (mod modulus)."""
    every = F.sequence(F.lit(0).cast("long"), modulus.cast("long") - 1)
    return F.filter(every, lambda r: (r * r) % modulus == F.pmod(s, modulus))


def square_roots_of_product(s: Column, a: Column, b: Column) -> Column:
    """The roots modulo a b, each root modulo a being combined with each one modulo b (a and b without a common divisor)."""
    p, m = a * b, bezout(a, b)["m"]
    every = F.flatten(F.transform(square_roots(s, a), lambda x: F.transform(square_roots(s, b), lambda y: F.pmod(F.pmod(y - x, b) * F.pmod(m, b) % b * a + x, p))))
    return F.array_sort(F.filter(every, lambda r: (r * r) % p == F.pmod(s, p)))


def pair_to_single(i: Column, j: Column) -> Column:
    """One whole number for two: counts along the diagonals."""
    i, j = i.cast("decimal(18,0)"), j.cast("decimal(18,0)")
    d = (i + j).cast("decimal(19,0)")
    return (((d * d + d) / 2).cast("decimal(38,0)") + j).cast("decimal(38,0)")


def _triangle(d: Column) -> Column:
    """d (d + 1) / 2, exactly."""
    d = d.cast("decimal(18,0)")
    return (d * (d + 1) * F.lit(Decimal("0.5"))).cast("decimal(38,0)")


def single_to_pair(n: Column) -> Column:
    """(i, j), the inverse of pair_to_single, for i + j below 2^50: the root is estimated, then corrected in whole numbers.

    A negative number, or one that stands for a larger sum, is an error.
    """
    n = n.cast("decimal(38,0)")
    beyond = F.lit(Decimal(2**49 * (2**50 - 1) + 2**50 - 1)).cast("decimal(38,0)")
    n = F.when((n < 0) | (n > beyond), F.raise_error(F.concat(F.lit("no pair below 2^50 for "), n.cast("string"))).cast("decimal(38,0)")).otherwise(n)
    d = F.floor((F.sqrt(8 * n.cast("double") + 1) - 1) / 2).cast("long")
    d = F.when(_triangle(d) > n, d - 1).when(_triangle(d + 1) <= n, d + 1).otherwise(d)
    j = (n - _triangle(d)).cast("long")
    return F.struct((d - j).alias("i"), j.alias("j"))


def to_level_index(x: Column, levels: int = 6) -> Column:
    """Symmetric level index: how often to take the logarithm until at most 1 is left, plus what is left, with the sign."""
    start = F.struct(F.abs(x).cast("double").alias("a"), F.lit(0.0).alias("l"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, lambda s, _: F.when(s["a"] <= 1, s).otherwise(F.struct(F.log(s["a"]).alias("a"), (s["l"] + 1).alias("l"))))
    return F.signum(x) * (done["l"] + done["a"])


def from_level_index(s: Column, levels: int = 6) -> Column:
    """The number of a symmetric level index."""
    a = F.abs(s).cast("double")
    level = F.when(a <= 1, 0).otherwise(F.floor(a))
    steps = F.sequence(F.lit(1), F.lit(levels))
    return F.signum(s) * F.aggregate(steps, a - level, lambda n, k: F.when(k <= level, F.exp(n)).otherwise(n))


def _divided(a: Column, b: Column, otherwise: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(otherwise)


def _combined(x: Column, y: Column, sign: int) -> Column:
    """The level index of X + Y or X - Y for level indices x >= y >= 0, without X or Y.

    With phi(t) for the number of a level index t, the scales a_j = 1 / phi(x - j), the ratios b_j =
    phi(y - j) / phi(x - j), kept as logarithms, and c_j = phi(z - j) / phi(x - j) are all small: a and b come from the last
    level down, as phi(t) = exp(phi(t - 1)), and c goes up again, by c_j = 1 + a_j ln c_(j - 1).
    """
    level, other = F.floor(x).cast("int"), F.floor(y).cast("int")
    f, g = x - level, y - other
    none = F.array().cast("array<int>")
    scales = F.aggregate(
        F.when(level > 1, F.sequence(F.lit(2), level)).otherwise(none),
        F.array(F.exp(-f)),
        lambda s, _: F.concat(F.array(F.when(s[0] > 0, F.exp(F.lit(-1.0) / F.when(s[0] > 0, s[0]))).otherwise(F.lit(0.0))), s),
    )

    def put(a: Column) -> Column:
        down = F.when(other > 1, F.sequence(other - 1, F.lit(1))).otherwise(none)
        far = F.lit(-1e300)
        # logarithms of the ratios: exactly 0 where x = y
        first = F.when(other == level, g - f).otherwise(g - _divided(F.lit(1.0), F.get(a, other), -far))
        deep = F.aggregate(down, first, lambda d, j: _divided(F.expm1(d), F.when(a[j] > 0, a[j]), F.when(d < 0, far).otherwise(F.lit(0.0))))
        ratio = F.when(other > 0, deep).otherwise(F.log(F.when(a[0] * g > 0, a[0] * g)))
        c0 = (1 + F.exp(ratio)) if sign > 0 else -F.expm1(ratio)
        start = F.struct(F.coalesce(c0, F.lit(1.0)).alias("c"), F.lit(None).cast("double").alias("z"))

        def up(s: Column, j: Column) -> Column:
            c = F.when(j == 0, s["c"]).otherwise(1 + a[j] * F.log(F.when(s["c"] > 0, s["c"])))
            return F.when(s["z"].isNotNull(), s).otherwise(F.struct(c.alias("c"), F.when((c < a[j]) | (c <= 0), j + _divided(c, F.when(a[j] > 0, a[j]), F.lit(0.0))).alias("z")))

        done = F.aggregate(F.sequence(F.lit(0), level - 1), start, up)
        v = f + F.log(F.when(done["c"] > 0, done["c"]))
        return F.coalesce(done["z"], level + F.when(v <= 1, v).otherwise(1 + F.log(F.when(v > 0, v))))

    small = f + sign * g
    flat = F.when(small <= 1, small).otherwise(1 + F.log(F.when(small > 0, small)))
    return F.when(level == 0, flat).otherwise(F.element_at(F.transform(F.array(scales), put), 1))


def add_level_index(x: Column, y: Column) -> Column:
    """The level index of the sum of the numbers of two level indices, which may be far beyond a DOUBLE; null if one is null."""
    x, y = x.cast("double"), y.cast("double")
    larger, smaller = F.when(F.abs(x) >= F.abs(y), x).otherwise(y), F.when(F.abs(x) >= F.abs(y), y).otherwise(x)
    same = F.signum(larger) * F.signum(smaller) >= 0
    value = F.when(same, _combined(F.abs(larger), F.abs(smaller), 1)).otherwise(_combined(F.abs(larger), F.abs(smaller), -1))
    return F.when(x.isNotNull() & y.isNotNull(), F.signum(larger) * value)


def subtract_level_index(x: Column, y: Column) -> Column:
    """The level index of the difference."""
    return add_level_index(x, -y)
