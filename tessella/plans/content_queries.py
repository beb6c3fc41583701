"""Queries about what elements hold: repeated contents, content models, selectors, edits in place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import groups, trees
from tessella.plans.registry import register
from tessella.session import table
from tessella.sources import files


@register(
    "reused_contents",
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS i, l_returnflag AS tag, CAST(l_linenumber AS VARCHAR) AS text FROM lineitem),
    c AS (SELECT tag, '0:' || tag || ':' || text AS s, text FROM l
      UNION ALL SELECT 'order', '0:order:' || chr(10) || string_agg('1:' || tag || ':' || text, chr(10) ORDER BY i), string_agg(text, ' ' ORDER BY i) FROM l GROUP BY k)
    SELECT tag, md5(s) AS md5, min(text) AS text, count(*) AS n FROM c GROUP BY tag, md5(s) HAVING count(*) > 1""",
)
def reused_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are trees whose children are their lines: which contents, of lines and of whole orders, occur more than once."""
    lines = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag"))
    leaf = lines.select(F.col("l_orderkey").alias("tree"), place.alias("node"), F.col("l_returnflag").alias("tag"), F.col("l_linenumber").cast("string").alias("text")).withColumn("path", F.array(F.col("node") - 1))
    root = lines.select(F.col("l_orderkey").alias("tree")).distinct().select("tree", F.lit(0).alias("node"), F.lit("order").alias("tag"), F.lit(None).cast("string").alias("text"), F.array().cast("array<int>").alias("path"))
    return trees.reused_contents(trees.contents(root.unionByName(leaf)))


_CHILDREN = """SELECT o_orderpriority AS parent, o_orderkey AS owner, coalesce(l_linenumber, 0) AS pos, l_returnflag AS tag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"""
_EDGES = f"""WITH c AS (SELECT parent, tag, lead(tag) OVER w AS next, row_number() OVER w AS k FROM ({_CHILDREN}) WINDOW w AS (PARTITION BY owner ORDER BY pos, tag)),
    e AS (SELECT parent, tag, next FROM c UNION ALL SELECT parent, NULL, tag FROM c WHERE k = 1 AND tag IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("tag"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parent"), F.col("o_orderkey").alias("owner"))
    return groups.content_edges(owners.join(lines, "owner", "left"))


@register("content_edges", f"{_EDGES} SELECT parent, tag, next, count(*) AS n FROM e GROUP BY ALL")
def content_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which flags follow each other on the lines of orders of each priority."""
    return _edges(spark, sf_dir)


@register(
    "content_places",
    f"""{_EDGES} SELECT parent, tag, EXISTS (SELECT 1 FROM e f WHERE f.parent = e.parent AND f.tag IS NULL AND f.next = e.tag) AS may_be_first, bool_or(next IS NULL) AS may_be_last,
    EXISTS (SELECT 1 FROM e f WHERE f.parent = e.parent AND f.tag IS NULL AND f.next IS NULL) AS parent_may_be_empty FROM e WHERE tag IS NOT NULL GROUP BY parent, tag""",
)
def content_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which flags may begin and end the lines of orders of each priority, and whether there may be none."""
    return groups.content_places(_edges(spark, sf_dir))


@register(
    "selected_parts",
    """SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND regexp_matches(p_type, 'E') AND p_partkey % 2 = 1
    AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def selected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd parts of some brands, of types that hold an E, that were returned: a selector of each kind."""
    returned = groups.selected(table(spark, sf_dir, "lineitem"), "l_returnflag", "R").select("l_partkey")
    parts = groups.matching(table(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#12", "Brand#13"], "p_type": re.compile("E")})
    odd = groups.selected(parts, "p_partkey", lambda key: key % 2 == 1)
    return groups.selected(odd, "p_partkey", returned).select("p_partkey", "p_brand", "p_type")


@register(
    "edited_pages",
    r"""WITH b AS (SELECT page_id, html || chr(10) || '<!-- checked -->' AS html, regexp_extract(html, '<title>[^<]*</title>') AS body FROM pages),
    e AS (SELECT page_id, regexp_extract(html, '^(\s*<![A-Za-z][^>]*>)*\s*') || body || regexp_extract(html, '\s*<!-- checked -->$') AS edited FROM b)
    SELECT page_id, edited, sha1('blob ' || strlen(edited) || chr(0) || edited) AS blob FROM e""",
)
def edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut down to their titles, between the old header and trailer, and the names of the files that hold them."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit("\n<!-- checked -->")))
    edited = files.with_body(F.col("html"), F.regexp_extract("html", "<title>[^<]*</title>", 0))
    return pages.select("page_id", edited.alias("edited")).withColumn("blob", T.blob_sha(F.col("edited")))
