"""Queries over the trees that the parser finds in the pages: edits, and content that is used again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import grids, groups, images, reuse, tree_edits
from tessella.plans.registry import register
from tessella.session import materialise, release, table
from tessella.sources import markup


def page_trees(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """tree (page), node, path and, unless only some are asked for, tag, attributes, text of all pages."""
    pages = table(spark, sf_dir, "pages").withColumn("file", F.col("page_id").cast("string"))
    nodes = markup.nodes(pages, "file", "html").select(F.col("file").cast("long").alias("tree"), "node", "path", *(columns or ("tag", "attributes", "text")))
    return materialise(nodes, "page-trees")


_ITEM = "concat(md5('li'), '||', md5(''), '|', {0})"
_LINK = "md5(concat(md5('a'), '|', md5('href'), md5(href), '|', md5(''), '|', md5(concat(md5('CDATA'), '||', md5(word), '|'))))"


@register(
    "reused_items",
    rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS word FROM pages),
    d AS (SELECT page_id, length(word) AS chars, {_LINK} AS link FROM l),
    e AS (SELECT page_id, chars, 'a' AS tag, link AS md5, false AS top FROM d UNION ALL SELECT page_id, chars, 'li', md5({_ITEM.format("link")}), true FROM d)
    SELECT md5, tag, count(*) AS uses, CAST(any_value(chars) AS BIGINT) AS chars, min(page_id) AS tree, CAST(count(*) FILTER (top) AS BIGINT) AS references_made FROM e GROUP BY md5, tag HAVING count(*) >= 2""",
)
def reused_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items, and links in them, whose content several pages have; references are put where the largest blocks were."""
    digested = reuse.digests(page_trees(spark, sf_dir))
    contents = materialise(reuse.reused(digested, tags=["a", "li"]), "contents")
    made = reuse.replaced(digested, contents).where("reference is not null").groupBy(F.col("reference").alias("md5")).agg(F.count("*").alias("references_made"))
    return contents.join(made, "md5", "left").select("md5", "tag", "uses", "chars", "tree", F.coalesce("references_made", F.lit(0)).alias("references_made"))


@register("reused_blocks")
def reused_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tag: contents of 20 characters or more that are used again, their uses, the references put in pages, and those put in the dictionary."""
    digested = reuse.digests(page_trees(spark, sf_dir))
    contents = materialise(reuse.reused(digested, least_chars=20), "contents")
    counts = contents.groupBy("tag").agg(F.count("*").alias("contents"), F.sum("uses").alias("uses"))
    for name, trees in (("in_pages", reuse.replaced(digested, contents)), ("in_dictionary", reuse.dictionary(digested, contents))):
        counts = counts.join(trees.where("reference is not null").groupBy("tag").agg(F.count("*").alias(name)), "tag", "left")
    return counts.select("tag", "contents", "uses", F.coalesce("in_pages", F.lit(0)).alias("in_pages"), F.coalesce("in_dictionary", F.lit(0)).alias("in_dictionary"))


def edits_of_pages(nodes: DataFrame, batch: int) -> DataFrame:
    """tree, seq, op, node, other, key: what is done to every page, in three batches.

    First scripts and styles go, lists are wrapped in a section, bold text is unwrapped and an
    article's content is wrapped. Then navigation goes last in the page and the notice goes before
    the first heading; then lists are split, and articles merge with what is like them.
    """
    tags = ["body", "nav", "h1", "div"]
    by_tag = nodes.where(F.col("tag").isin(tags)).groupBy("tree").agg(*(F.min(F.when(F.col("tag") == t, F.col("node"))).alias(t) for t in tags))
    if batch == 1:
        what = F.create_map(*(F.lit(x) for x in ("script", "cut", "style", "cut", "ul", "wrap", "b", "unwrap", "article", "wrap_children")))
        done = nodes.withColumn("op", what[F.col("tag")]).where("op is not null")
        return done.select("tree", F.lit(1).alias("seq"), "op", "node", F.lit(None).cast("int").alias("other"), F.when(F.col("tag") == "ul", "section").when(F.col("tag") == "article", "content").alias("key"))
    if batch == 2:
        last = by_tag.select("tree", F.lit(1).alias("seq"), F.lit("put_last").alias("op"), F.col("nav").alias("node"), F.col("body").alias("other"))
        notice = by_tag.select("tree", F.lit(2).alias("seq"), F.lit("put_previous").alias("op"), F.col("div").alias("node"), F.col("h1").alias("other"))
        return last.unionByName(notice).where("node is not null and other is not null").withColumn("key", F.lit(None).cast("string"))
    op = F.when(F.col("tag") == "ul", "split").when(F.col("tag") == "article", "merge")
    return nodes.withColumn("op", op).where("op is not null").select("tree", F.lit(1).alias("seq"), "op", "node", F.lit(None).cast("int").alias("other"), F.lit(None).cast("string").alias("key"))


@register("edited_trees")
def edited_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as trees after three batches of edits: tree, node, path, tag."""
    nodes = page_trees(spark, sf_dir, "tag")
    for batch in (1, 2, 3):
        before, nodes = nodes, tree_edits.edit(nodes, edits_of_pages(nodes, batch))
        release(before)
    return nodes.select("tree", "node", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "tag")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tags follow each other among the children of each tag, over all elements of all pages."""
    nodes = page_trees(spark, sf_dir).where("tag <> 'CDATA'")
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    owners = nodes.select("tree", F.col("path").alias("up"), F.col("tag").alias("parent"), F.concat_ws("/", F.col("tree").cast("string"), F.col("node").cast("string")).alias("owner"))
    children = nodes.select("tree", up.alias("up"), F.element_at("path", -1).alias("pos"), "tag")
    return materialise(groups.content_edges(owners.join(children, ["tree", "up"], "left").select("parent", "owner", "pos", "tag")), "page-edges")


@register("page_content_chains")
def page_content_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every element of a tag must hold, in which order, and what may only stand beside it, as far as the pages show."""
    edges = page_edges(spark, sf_dir)
    return groups.content_follows(edges).join(groups.content_chains(edges), ["parent", "tag"], "left")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, text: for each market segment a drawing with a mark where a nation (across) has a customer of some balance (down, by 500)."""
    dots = table(spark, sf_dir, "customer").selectExpr("c_mktsegment as image", "cast(c_nationkey as int) as x", "cast(floor(c_acctbal / 500) + 2 as int) as y").distinct()
    lines = dots.groupBy("image", "y").agg(F.collect_set("x").alias("xs"), F.max("x").alias("wide"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("wide")), lambda x: F.when(F.array_contains("xs", x), "#").otherwise(" ")), "")
    return lines.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("y", line.alias("line")))).alias("l")).select(
        "image", F.array_join(F.transform(F.sequence(F.lit(0), F.array_max("l.y")), lambda y: F.coalesce(F.get(F.filter("l", lambda r: r["y"] == y), 0)["line"], F.lit(""))), "\n").alias("text")
    )


@register("drawing_loops")
def drawing_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of drawings read from text: each pixel's layer, and whether it is in a loop or between loops."""
    dots = materialise(images.pixels(drawings(spark, sf_dir), "image", "text"), "pixels")
    core = images.core(dots).withColumn("in_core", F.lit(True))
    return images.layers(dots).join(core, ["image", "x", "y"], "left").select("image", "x", "y", "layer", F.coalesce("in_core", F.lit(False)).alias("in_core"))


@register("drawing_paths")
def drawing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of drawings read from text: shortest paths between far ends of all parts of three pixels or more."""
    dots = materialise(images.pixels(drawings(spark, sf_dir), "image", "text"), "pixels")
    found = images.long_paths(dots, least=3)
    return found.select("image", F.col("part.x").alias("part_x"), F.col("part.y").alias("part_y"), "x", "y", "steps")


@register("table_grids")
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of three cells a row, spanning columns and rows by quantity and part: how many have which faults."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.col("l_orderkey").alias("table"), F.floor(F.col("l_linenumber") / 3).alias("row"), F.col("l_linenumber").alias("pos"), (1 + F.col("l_quantity").cast("int") % 3).alias("colspan"), (1 + F.col("l_partkey") % 2).alias("rowspan"))
    found = grids.dimensions(materialise(grids.placed(cells), "grid"))
    return found.groupBy("rows", "columns", "ragged", "overlapping", "hanging").agg(F.count("*").alias("n"))
