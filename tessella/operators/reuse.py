"""Content that occurs more than once in trees: digests from the leaves up, and references in place of copies.

Nodes are (tree, node, path, tag, attributes, text), as the parser gives them. A digest covers a
node and all below it. It is made level by level, from the deepest up: a node reads the digests
of its own children, so no list is longer than a node has children, and each node is read once
and its digest passed on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.trees import parent_path
from tessella.session import materialise, release


def _own(tag: Column, attributes: Column, text: Column, below: Column) -> Column:
    """A digest of digests, all of the same length, so that no two different nodes are written alike."""
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(F.md5(e["key"]), F.md5(F.coalesce(e["value"], F.lit("")))))
    parts = (F.md5(F.coalesce(tag, F.lit(""))), F.coalesce(F.array_join(pairs, ""), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.coalesce(F.array_join(below, ""), F.lit("")))
    return F.md5(F.concat_ws("|", *parts))


def digests(nodes: DataFrame) -> DataFrame:
    """nodes with md5, chars (of all texts) and size (nodes) of the subtree at each node.

    Null tags and texts are empty; attributes are in no order. As many rounds as the deepest tree has levels.
    """
    rows = materialise(nodes.withColumn("_depth", F.size("path")).sortWithinPartitions("_depth"), "levels")
    deepest = rows.agg(F.max("_depth")).first()[0]
    if deepest is None:
        return rows.drop("_depth").select("*", F.lit("").alias("md5"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("size"))
    done, below = [], None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("_depth") == depth)
        if below is None:
            level = level.withColumns({"_below": F.array().cast("array<string>"), "_chars": F.lit(0), "_size": F.lit(0)})
        else:
            child = F.struct(F.element_at("path", -1).alias("pos"), "md5")
            families = below.groupBy("tree", parent_path(F.col("path")).alias("path")).agg(F.sort_array(F.collect_list(child)).alias("c"), F.sum("chars").alias("_chars"), F.sum("size").alias("_size"))
            level = level.join(families, ["tree", "path"], "left").withColumn("_below", F.col("c")["md5"])
        md5 = _own(F.col("tag"), F.col("attributes"), F.col("text"), F.col("_below"))
        chars = (F.coalesce(F.length("text"), F.lit(0)) + F.coalesce("_chars", F.lit(0))).cast("long")
        below = materialise(level.select(*nodes.columns, md5.alias("md5"), chars.alias("chars"), (F.coalesce("_size", F.lit(0)) + 1).cast("long").alias("size")), "digests")
        done.append(below)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    whole = materialise(out, "digests")
    release(rows, *done)
    return whole


def reused(digested: DataFrame, least_uses: int = 2, least_chars: int = 1, tags: list[str] | None = None) -> DataFrame:
    """md5, tag, uses, chars, tree, path of the contents that occur least_uses times or more; tree and path are those of the first occurrence."""
    rows = digested if tags is None else digested.where(F.col("tag").isin(*tags))
    first = F.min(F.struct("tree", "path"))
    found = rows.where(F.col("chars") >= least_chars).groupBy("md5").agg(F.first("tag").alias("tag"), F.count("*").alias("uses"), F.first("chars").alias("chars"), first.alias("first"))
    return found.where(F.col("uses") >= least_uses).select("md5", "tag", "uses", "chars", "first.tree", "first.path")


def _above(rows: DataFrame, name: str) -> DataFrame:
    """rows, one for each node above theirs, whose path is `name`."""
    n = F.size("path")
    return rows.withColumn("_k", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))).withColumn(name, F.slice("path", F.lit(1), F.col("_k"))).drop("_k")


def topmost(places: DataFrame) -> DataFrame:
    """Of places (tree, path), those that are below no other one."""
    covered = _above(places.select("tree", "path"), "_up").join(places.select("tree", F.col("path").alias("_up")), ["tree", "_up"], "left_semi")
    return places.join(covered.select("tree", "path").distinct(), ["tree", "path"], "left_anti")


def _referring(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """nodes without those below places (tree, path); `reference` is the digest at a place and null elsewhere."""
    inner = _above(nodes.select("tree", "path"), "_up").join(places.select("tree", F.col("path").alias("_up")), ["tree", "_up"], "left_semi")
    rest = nodes.join(inner.select("tree", "path").distinct(), ["tree", "path"], "left_anti")
    return rest.join(places.select("tree", "path", F.lit(True).alias("_here")), ["tree", "path"], "left").withColumn("reference", F.when(F.col("_here"), F.col("md5"))).drop("_here")


def replaced(digested: DataFrame, contents: DataFrame) -> DataFrame:
    """The trees with a reference in place of each largest block whose content is in contents (md5).

    The nodes below such a block go; the block itself stays, with its content's digest as its `reference`.
    """
    places = materialise(topmost(digested.join(contents.select("md5"), "md5", "left_semi").select("tree", "path")), "places")
    return _referring(digested, places)


def dictionary(digested: DataFrame, contents: DataFrame) -> DataFrame:
    """One tree for each of contents, named by its digest, with references to the other contents in it.

    tree, node, path, tag, attributes, text, md5, reference: the root's path is empty; nodes have the
    numbers of the first occurrence. Expanding references again and again ends, as each leads to a
    smaller block, and gives every tree as it was.
    """
    first = contents.select(F.col("md5").alias("_entry"), "tree", F.col("path").alias("_root"))
    at = _above(digested.withColumn("_last", F.array(F.lit(0))).withColumn("path", F.concat("path", "_last")), "_root")
    inside = at.join(first, ["tree", "_root"]).withColumn("path", F.slice("path", F.size("_root") + 1, F.size("path") - F.size("_root") - 1))
    entries = materialise(inside.select(F.col("_entry").alias("tree"), "node", "path", "tag", "attributes", "text", "md5"), "entries")
    places = entries.where(F.size("path") > 0).join(contents.select("md5"), "md5", "left_semi").select("tree", "path")
    return _referring(entries, materialise(topmost(places), "places"))
