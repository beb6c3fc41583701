"""Rules in plain text, applied to nodes by joins, with statistics of what they did.

A rule text has a description in the first column and, indented below it, lines of a method and
a context of tags, the innermost first. `#` begins a comment. Methods are names from a fixed
list; nothing in a rule is ever run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a rule can do with a node: give it another tag, or take it away.
METHODS = ("rename", "delete")


def parse(lines: DataFrame, rule_set: str, number: str, text: str) -> DataFrame:
    """rule_set, line, description, method, argument, context of the lines (number, text) of each rule set. Lines with an unknown method are left out."""
    bare = F.rtrim(F.regexp_replace(F.col(text), "#.*$", ""))
    rows = lines.select(F.col(rule_set).alias("rule_set"), F.col(number).alias("line"), bare.alias("t")).where("t <> ''")
    w = W.partitionBy("rule_set").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(~F.col("t").rlike(r"^\s"), F.col("t"))
    told = rows.withColumn("description", F.last(heading, True).over(w)).where(F.col("t").rlike(r"^\s"))
    words = F.split(F.trim("t"), r"\s+")
    parsed = told.select("rule_set", "line", "description", words.alias("w")).select("rule_set", "line", "description", F.get("w", F.lit(0)).alias("method"), "w")
    takes = F.when(F.col("method") == "rename", 1).otherwise(0)
    argument = F.when(takes == 1, F.get("w", F.lit(1)))
    context = F.slice("w", F.lit(2) + takes, F.greatest(F.size("w") - F.lit(1) - takes, F.lit(0)))
    return parsed.where(F.col("method").isin(*METHODS)).select("rule_set", "line", "description", "method", argument.alias("argument"), context.alias("context")).where("size(context) > 0")


def apply(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes (file, node, context: own tag, then the parents') with the first rule that fits: line, description, method, argument.

    A rule fits if its context begins the node's. The join is on the innermost tag; what it
    leaves is compared as arrays. Nodes that no rule fits have nulls.
    """
    named = rules.select(F.col("context").alias("_c"), F.get("context", F.lit(0)).alias("_tag"), "line", "description", "method", "argument")
    own = nodes.withColumn("_tag", F.get("context", F.lit(0)))
    fit = own.join(named, "_tag").where(F.slice("context", F.lit(1), F.size("_c")) == F.col("_c"))
    first = fit.groupBy("file", "node").agg(F.min(F.struct("line", "description", "method", "argument")).alias("r"))
    return nodes.join(first, ["file", "node"], "left").select(*nodes.columns, "r.line", "r.description", "r.method", "r.argument")


def outcome(applied: DataFrame) -> DataFrame:
    """file, node, tag after the rules; deleted nodes are left out."""
    tag = F.when(F.col("method") == "rename", F.col("argument")).otherwise(F.get("context", F.lit(0)))
    return applied.where(F.coalesce(F.col("method"), F.lit("")) != "delete").select("file", "node", tag.alias("tag"))


def statistics(applied: DataFrame, rules: DataFrame) -> DataFrame:
    """line, description, hits of every rule, those that fit nothing included."""
    hits = applied.where("line is not null").groupBy("line").agg(F.count("*").alias("hits"))
    return rules.select("line", "description").join(hits, "line", "left").select("line", "description", F.coalesce("hits", F.lit(0)).alias("hits"))
