"""Lists as ARRAY columns. Positions count from 0; a negative one counts from the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def push(values: Column, x: Column) -> Column:
    return F.array_append(values, x)


def unshift(values: Column, x: Column) -> Column:
    return F.array_prepend(values, x)


def pop(values: Column) -> Column:
    """(value, rest); a null value if there is none."""
    return F.struct(at(values, F.lit(-1)).alias("value"), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))).alias("rest"))


def shift(values: Column) -> Column:
    """(value, rest), from the front."""
    return F.struct(F.get(values, 0).alias("value"), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))).alias("rest"))


def at(values: Column, k: Column) -> Column:
    return F.get(values, F.when(k < 0, F.size(values) + k).otherwise(k))


def index_of(values: Column, x: Column) -> Column:
    """Counted from 1; 0 if it is not there."""
    return F.array_position(values, x)


def count_less(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v < x))


def count_greater(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v > x))


def span(inner: Column, outer: Column) -> Column:
    """How many of outer's elements are passed over before all of inner has been met in its order; null if it isn't."""
    start = F.struct(F.lit(0).alias("met"), F.lit(0).alias("passed"))

    def step(s: Column, x: Column) -> Column:
        here = x == F.get(inner, s["met"])
        return F.when(s["met"] >= F.size(inner), s).when(here, F.struct((s["met"] + 1).alias("met"), s["passed"].alias("passed"))).otherwise(F.struct(s["met"].alias("met"), (s["passed"] + 1).alias("passed")))

    done = F.aggregate(outer, start, step)
    return F.when(done["met"] == F.size(inner), done["passed"])


def has_subsequence(inner: Column, outer: Column) -> Column:
    return span(inner, outer).isNotNull()


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def least_span(inner: Column, outer: Column) -> Column:
    """The least span of inner from any start in outer: in its order, else reversed, else in any order; null if outer lacks some of it.

    From a start, the arrangement of inner that is met first is the one of the shortest stretch
    that holds every element as often as inner does, so arrangements need not be made. In its order
    inner can be met from all starts up to a last one, and reversed from those up to another, so each
    of the three ways is one pass over the elements of inner that outer has, behind the last start of
    the ways before it. A pass keeps a place for each element of inner and the least span so far.
    """
    size = F.size(inner)
    codes = F.transform(inner, lambda w: F.array_position(inner, w).cast("int"))
    met = F.transform(outer, lambda w, k: F.struct((k + 1).alias("at"), F.array_position(inner, w).cast("int").alias("code")))
    unset = F.struct(F.array_repeat(F.lit(0), size).alias("places"), F.lit(None).cast("int").alias("least"))

    def passed(places: Callable[[Column, Column], Column], start: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
        """A step of a pass; places start at 1, and a start of 0 says that something is not met yet."""

        def step(s: Column, x: Column) -> Column:
            span = lambda p: F.when(start(p) > 0, x["at"] - start(p) + 1 - F.size(p))
            return _let(places(s["places"], x), lambda p: F.struct(p.alias("places"), F.least(s["least"], span(p)).alias("least")))

        return step

    def in_order(order: Column) -> Callable[[Column, Column], Column]:
        # the latest start from which the first 1, 2, .. elements are met up to here
        places = lambda p, x: F.transform(p, lambda v, j: F.when(F.get(order, j) == x["code"], F.when(j == 0, x["at"]).otherwise(F.get(p, j - 1))).otherwise(v))
        return passed(places, lambda p: F.element_at(p, -1))

    def in_any_order(order: Column, before: Column) -> Callable[[Column, Column], Column]:
        # where each element was met last, and one that inner has n times, the n last times
        places = lambda p, x: F.transform(p, lambda v, j: F.when(F.get(order, j) == x["code"], F.coalesce(F.get(p, F.get(before, j)), x["at"])).otherwise(v))
        return passed(places, F.array_min)

    def before(order: Column) -> Column:
        """For each element where inner has the same one before, or null."""
        return F.transform(order, lambda c, j: F.array_max(F.transform(order, lambda d, i: F.when((d == c) & (i < j), i))))

    def scored(order: Column, rows: Column) -> Column:
        beyond = lambda rows, last: F.filter(rows, lambda x: x["at"] > F.element_at(last["places"], -1))
        third = lambda rows: _let(before(order), lambda b: F.aggregate(rows, unset, in_any_order(order, b)))["least"]
        reversed_ = lambda rows: _let(F.reverse(order), lambda back: F.aggregate(rows, unset, in_order(back)))
        second = lambda rows: _let(reversed_(rows), lambda s: F.least(s["least"], third(beyond(rows, s))))
        return _let(F.aggregate(rows, unset, in_order(order)), lambda s: F.least(s["least"], second(beyond(rows, s))))

    least = _let(codes, lambda order: _let(F.filter(met, lambda x: x["code"] > 0), lambda rows: scored(order, rows)))
    return F.when((F.size(outer) > 0) & (size == 0), 0).when((F.size(outer) > 0) & (F.size(F.array_except(inner, outer)) == 0), least)
