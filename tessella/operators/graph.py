"""Reachability over tables of links: components, closures, paths. Rounds are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import derived, materialise, release


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable from each node that has a link.

    Every round passes the smallest known label along the links and then replaces each label
    by the label of that label, so the rounds grow with the logarithm of a chain's length.
    Both steps are an equi-join with one row on one side, which adaptive execution can split,
    and a minimum, which is combined before the shuffle. Null ends are left out; no links give
    no rows.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = materialise(pairs.select("x", "y").union(pairs.select("y", "x")).distinct(), "links")
    label = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "label")
    known = label
    for _ in range(most_rounds):
        heard = both.join(label, F.col("x") == F.col("node")).groupBy(F.col("y").alias("to")).agg(F.min("label").alias("heard"))
        near = label.join(heard, F.col("node") == F.col("to"), "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = label.select(F.col("node").alias("at"), F.col("label").alias("further"))
        far = near.join(jump, F.col("label") == F.col("at"), "left").select("node", "was", F.least("label", "further").alias("label"))
        last, far = known, materialise(far, "label")
        release(last)
        known, label = far, far.select("node", "label")
        if far.where("label <> was").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    release(both)
    return derived(label.select("node", F.col("label").alias("component")), known)


def closure(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """a, b, steps: every node that each node reaches in one step or more, with the fewest steps.

    The known paths are doubled in each round, so that a path of n steps takes log n rounds. Cycles end, as a pair is kept once.
    """
    known = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct().withColumn("steps", F.lit(1))
    known = materialise(known, "closure")
    size = known.count()
    for _ in range(most_rounds):
        on = known.select(F.col("a").alias("m"), F.col("b").alias("c"), F.col("steps").alias("more"))
        longer = known.join(on, F.col("b") == F.col("m")).select("a", F.col("c").alias("b"), (F.col("steps") + F.col("more")).alias("steps"))
        known = materialise(known.union(longer).groupBy("a", "b").agg(F.min("steps").alias("steps")), "closure")
        total = known.agg(F.count("*").alias("n"), F.sum("steps").alias("s")).first()
        if (total.n, total.s) == size:
            return known
        size = (total.n, total.s)
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def paths(links: DataFrame, roots: DataFrame, longest: int, a: str = "a", b: str = "b") -> DataFrame:
    """root, node, path: all ways without a repeated node from the roots (column node), of at most `longest` links."""
    edges = links.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    level = roots.select(F.col("node").alias("root"), "node", F.array("node").alias("path"))
    every = level
    for _ in range(longest):
        level = level.join(edges, F.col("node") == F.col("_a")).where(~F.array_contains("path", F.col("_b"))).select("root", F.col("_b").alias("node"), F.array_append("path", F.col("_b")).alias("path"))
        every = every.unionByName(level)
    return every


def unanimous(links: DataFrame, values: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, value, many: the one value that a node and all below it have, or that there are several.

    links: above, below. values: node, value; nulls say nothing. A node without any value below it is
    left out. A state is nothing, one value or many, so what comes up is joined by a minimum and a
    maximum, which are combined before the shuffle; a round carries it one level up and only passes
    on what has changed. Cycles end, as states only grow.
    """
    up = materialise(links.select("above", "below").where("above is not null and below is not null and above <> below").distinct(), "links")
    joined = (F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    state = materialise(values.where("node is not null and value is not null").groupBy("node").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "states")
    changed = state
    for _ in range(most_rounds):
        told = up.join(changed.withColumnRenamed("node", "below"), "below").groupBy(F.col("above").alias("node")).agg(*joined)
        met = told.join(state.select(F.col("node").alias("n"), F.col("lo").alias("l"), F.col("hi").alias("h")), F.col("node") == F.col("n"), "left")
        grown = met.select("node", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"), "n", "l", "h").where("n is null or lo < l or hi > h")
        changed = materialise(grown.select("node", "lo", "hi"), "changed")
        if changed.isEmpty():
            return state.select("node", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"), (F.col("lo") < F.col("hi")).alias("many"))
        state = materialise(state.unionByName(changed).groupBy("node").agg(*joined), "states")
    raise RuntimeError(f"the values did not settle in {most_rounds} rounds")
