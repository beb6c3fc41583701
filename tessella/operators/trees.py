"""Ordered trees as tables: a node's path is the array of positions from the root, which sorts in document order.

Columns: tree, node, path. The root's path is empty; the k-th child adds k (from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1))


def is_above(upper: Column, lower: Column) -> Column:
    """Whether a node is an ancestor of another."""
    return (F.size(upper) < F.size(lower)) & (F.slice(lower, 1, F.size(upper)) == upper)


def is_before(first: Column, second: Column) -> Column:
    """Whether a node ends before another begins."""
    return (first < second) & ~is_above(first, second)


def located(nodes: DataFrame) -> DataFrame:
    """nodes with depth, is_first, is_last, is_top, is_only, is_empty. Siblings meet by the parent's path; children are counted, not gathered."""
    p = nodes.withColumns({"depth": F.size("path"), "_parent": parent_path(F.col("path")), "_pos": F.get(F.col("path"), F.size("path") - 1)})
    family = p.where("_parent is not null").groupBy("tree", "_parent").agg(F.count("*").alias("_n"), F.max("_pos").alias("_last"), F.min("_pos").alias("_first"))
    met = p.join(family, ["tree", "_parent"], "left")
    own = family.select("tree", F.col("_parent").alias("path"), F.col("_n").alias("_children"))
    met = met.join(own, ["tree", "path"], "left")
    top = F.col("depth") == 0
    return met.select(
        *nodes.columns,
        "depth",
        (top | (F.col("_pos") == F.col("_first"))).alias("is_first"),
        (top | (F.col("_pos") == F.col("_last"))).alias("is_last"),
        top.alias("is_top"),
        (top | (F.col("_n") == 1)).alias("is_only"),
        F.col("_children").isNull().alias("is_empty"),
    )


def siblings_between(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """start, finish, node: siblings strictly between two nodes of spans (tree, start, finish)."""
    at = nodes.select("tree", "node", parent_path(F.col("path")).alias("up"), F.get(F.col("path"), F.size("path") - 1).alias("pos"))
    a = at.select("tree", F.col("node").alias("start"), F.col("up").alias("ua"), F.col("pos").alias("pa"))
    b = at.select("tree", F.col("node").alias("finish"), F.col("up").alias("ub"), F.col("pos").alias("pb"))
    ends = spans.join(a, ["tree", "start"]).join(b, ["tree", "finish"]).where("ua = ub")
    between = ends.join(at.withColumnRenamed("up", "ua"), ["tree", "ua"]).where("pos > pa and pos < pb")
    return between.select("tree", "start", "finish", "node")


def ancestors(nodes: DataFrame) -> DataFrame:
    """tree, node, ancestor, distance: each node with all above it. A node names its ancestors' paths itself, so they meet by an equi-join."""
    up = nodes.where(F.size("path") > 0).select("tree", "node", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("_k"))
    named = up.select("tree", "node", F.slice("path", F.lit(1), F.col("_k")).alias("_p"), (F.size("path") - F.col("_k")).alias("distance"))
    return named.join(nodes.select("tree", F.col("path").alias("_p"), F.col("node").alias("ancestor")), ["tree", "_p"]).select("tree", "node", "ancestor", "distance")


def ranks(nodes: DataFrame) -> DataFrame:
    """nodes with `pre`, `post` and `reversed`: places in pre-order, post-order and from the last, within each tree.

    In post-order a node follows its descendants: a place beyond all children is added to its path.
    """
    beyond = F.array_append(F.col("path").cast("array<int>"), F.lit(2**31 - 1))
    pre = F.row_number().over(W.partitionBy("tree").orderBy("path"))
    post = F.row_number().over(W.partitionBy("tree").orderBy(beyond))
    n = F.count("*").over(W.partitionBy("tree"))
    ranked = nodes.withColumns({"pre": pre, "post": post, "_n": n})
    return ranked.withColumn("reversed", (F.col("_n") - F.col("pre") + 1).cast("int")).drop("_n")


def from_parents(rows: DataFrame, deepest: int) -> DataFrame:
    """tree, node, path from (tree, node, parent, pos): paths grow level by level from the roots (parent null), as many joins as levels.

    A node below `deepest` levels is an error when the result is computed.
    """
    pos = F.row_number().over(W.partitionBy("tree", "parent").orderBy("pos", "node")) - 1
    child = rows.where("parent is not null").select("tree", F.col("node").alias("child"), F.col("parent").alias("node"), pos.alias("pos"))
    level = rows.where("parent is null").select("tree", "node", F.array().cast("array<int>").alias("path"))
    every = level
    for _ in range(deepest):
        level = level.join(child, ["tree", "node"]).select("tree", F.col("child").alias("node"), F.array_append("path", F.col("pos")).alias("path"))
        every = every.unionByName(level)
    # the message needs both sides, so that it is only made of joined rows
    below = level.join(child, ["tree", "node"]).select("tree", F.col("child").alias("node"), F.raise_error(F.concat(F.lit(f"more than {deepest} levels: "), F.col("child").cast("string"), F.size("path").cast("string"))).cast("array<int>").alias("path"))
    return every.unionByName(below)


def common_path(a: Column, b: Column) -> Column:
    """The longest path that both paths begin with."""
    both = F.least(F.size(a), F.size(b))
    steps = F.when(both > 0, F.sequence(F.lit(1), both)).otherwise(F.array().cast("array<int>"))
    return F.slice(a, 1, F.size(F.filter(steps, lambda k: F.slice(a, 1, k) == F.slice(b, 1, k))))


def common_ancestors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (tree, a, b) with `ancestor`, the lowest node that is above both or one of them. Pairs with unknown nodes give no rows."""
    a = nodes.select("tree", F.col("node").alias("a"), F.col("path").alias("_a"))
    b = nodes.select("tree", F.col("node").alias("b"), F.col("path").alias("_b"))
    met = pairs.join(a, ["tree", "a"]).join(b, ["tree", "b"]).withColumn("path", common_path(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return met.join(nodes.select("tree", "path", F.col("node").alias("ancestor")), ["tree", "path"]).drop("path")


def _upper_paths(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree", parent_path(F.col("path")).alias("path")).where("path is not null").distinct()


def leaves(nodes: DataFrame) -> DataFrame:
    """The nodes without children."""
    return nodes.join(_upper_paths(nodes), ["tree", "path"], "left_anti").select(*nodes.columns)


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes with children."""
    return nodes.join(_upper_paths(nodes), ["tree", "path"], "left_semi").select(*nodes.columns)


def outermost(nodes: DataFrame) -> DataFrame:
    """tree, node, first, last, n: of each parent the first and the last leaf below it in document order, and how many there are.

    A leaf names the paths above it; minima and maxima are combined before the shuffle.
    """
    below = leaves(nodes).where(F.size("path") > 0).select("tree", F.struct("path", "node").alias("leaf"), F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("_k"))
    ends = below.groupBy("tree", F.slice("leaf.path", F.lit(1), F.col("_k")).alias("path")).agg(F.min("leaf").alias("a"), F.max("leaf").alias("b"), F.count("*").alias("n"))
    return nodes.select("tree", "node", "path").join(ends, ["tree", "path"]).select("tree", "node", F.col("a.node").alias("first"), F.col("b.node").alias("last"), "n")


def context(nodes: DataFrame, key: str) -> DataFrame:
    """tree, node, context: the keys of a node and of all above it, itself first; as long as the node is deep."""
    above = ancestors(nodes).join(nodes.select("tree", F.col("node").alias("ancestor"), F.col(key).alias("_key")), ["tree", "ancestor"])
    own = nodes.select("tree", "node", F.lit(0).alias("distance"), F.col(key).alias("_key"))
    gathered = own.unionByName(above.select("tree", "node", "distance", "_key")).groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.struct("distance", "_key"))).alias("c"))
    return gathered.select("tree", "node", F.transform("c", lambda x: x["_key"]).alias("context"))


def at_path(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (tree, node, steps) with `found`: where the steps, numbers of children, lead from the node; null if they lead nowhere."""
    start = asked.join(nodes.select("tree", "node", F.col("path").alias("_from")), ["tree", "node"], "left").withColumn("_to", F.concat("_from", "steps"))
    return start.join(nodes.select("tree", F.col("path").alias("_to"), F.col("node").alias("found")), ["tree", "_to"], "left").select(*asked.columns, "found")


def contents(nodes: DataFrame) -> DataFrame:
    """tree, node, tag, text, md5 of nodes (tree, node, path, tag, text): what each node holds, itself included.

    text joins the texts of a node and of all below it, in document order, by blanks. md5 is that of
    a line for each of them, with its depth below the node, its tag and its text, so equal digests
    mean equal structure. Each node is sent to those above it, as many rows as it is deep; a root
    gathers one tree, which is one file. Null texts and tags are empty, but leave no blank.
    """
    held = nodes.select("tree", "path", "tag", "text", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("_k"))
    line = F.concat_ws(":", (F.size("path") - F.col("_k")).cast("string"), F.coalesce("tag", F.lit("")), F.coalesce("text", F.lit("")))
    at = held.select("tree", F.slice("path", F.lit(1), F.col("_k")).alias("_p"), F.struct("path", line.alias("line"), F.col("text").alias("text")).alias("_x"))
    below = at.groupBy("tree", "_p").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    texts = F.array_join("_x.text", " ")
    below = below.select("tree", F.col("_p").alias("path"), texts.alias("text"), F.md5(F.array_join("_x.line", "\n")).alias("md5"))
    return nodes.select("tree", "node", "path", "tag").join(below, ["tree", "path"]).select("tree", "node", "tag", "text", "md5")


def reused_contents(held: DataFrame) -> DataFrame:
    """tag, md5, text, n of the contents that occur more than once, from contents()."""
    return held.groupBy("tag", "md5").agg(F.min("text").alias("text"), F.count("*").alias("n")).where("n > 1")
