"""Aggregations: all combine before they shuffle, so that a hot key costs one row for each task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.session import materialise


def duplicates(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """md5, n, first: contents that several rows hold, with the smallest name among them. Null contents are left out."""
    return rows.where(key.isNotNull()).groupBy(F.md5(key).alias("md5")).agg(F.count("*").alias("n"), F.min(name).alias("first")).where("n > 1")


def keep_first(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row of each content, the one with the smallest name; how content-addressed storage sees the rows."""
    return rows.where(key.isNotNull()).groupBy(F.md5(key).alias("md5")).agg(F.min(name).alias(name))


def word_index(files: DataFrame, file: str, text: str, longest: int = 15) -> DataFrame:
    """word, file, n: which files hold a word how often.

    A word in n files is kept if n n is at most the number of distinct words. The index is written
    once, as the words' counts and what is kept of it both need it; it meets the kept words by an
    equi-join.
    """
    index = files.select(F.col(file).alias("file"), F.explode(T.letter_words(F.col(text), longest)).alias("word")).groupBy("word", "file").agg(F.count("*").alias("n"))
    index = materialise(index, "word-index")
    held = index.groupBy("word").agg(F.count("*").alias("files"))
    kept = held.join(held.agg(F.count("*").alias("every")), F.col("files") * F.col("files") <= F.col("every"))
    return index.join(kept.select("word"), "word", "left_semi")


def pass_rates(rows: DataFrame, key: str, passed: Column) -> DataFrame:
    """key, passed, failed, percent (4 places) by key."""
    ok = F.sum(F.when(passed, 1).otherwise(0))
    bad = F.sum(F.when(passed, 0).otherwise(1))
    return rows.groupBy(key).agg(ok.alias("passed"), bad.alias("failed"), F.round(100.0 * ok / (ok + bad), 4).alias("percent"))


def pivot_counts(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A row for each key and a column for each value: how often it occurs."""
    return rows.groupBy(key).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, subset=values)


def reuse(rows: DataFrame, item: str, user: str) -> DataFrame:
    """item, n, users: in how many rows and by how many different users an item is used."""
    return rows.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"))


def levels(facts: DataFrame, *keys: str) -> DataFrame:
    """depth, n: the number of different key prefixes of each depth."""
    out = None
    for k in range(1, len(keys) + 1):
        one = facts.select(*keys[:k]).distinct().agg(F.count("*").alias("n")).select(F.lit(k).alias("depth"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status(counts: DataFrame) -> DataFrame:
    """n, line of (name, n): 'n names', or 'n name' for one; zeros are left out. The status line is these by n falling, then name."""
    line = F.concat_ws(" ", F.col("n").cast("string"), F.when(F.col("n") == 1, F.regexp_replace("name", "s$", "")).otherwise(F.col("name")))
    return counts.where("n > 0").select("n", line.alias("line"))


def mode(rows: DataFrame, column: str) -> DataFrame:
    """value, n of the most frequent value, ties to the larger value."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("value")).limit(1)


def rule_statistics(outcomes: DataFrame) -> DataFrame:
    """Of (rule, line, passed): rule, passes, furthest (the last line at which it failed; null once it has passed)."""
    passes = F.sum(F.when(F.col("passed"), 1).otherwise(0))
    return outcomes.groupBy("rule").agg(passes.alias("passes"), F.when(passes == 0, F.max("line")).alias("furthest"))


def genre_counts(items: DataFrame, genres: str) -> DataFrame:
    """genre, n: items in each genre; an item counts once for a genre."""
    return items.select(F.explode(F.array_distinct(F.col(genres))).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


def genre_overlap(items: DataFrame, item: str, genres: str) -> DataFrame:
    """g, h, ratio: items in both genres over items in either, for pairs of genres that share an item. Pairs are made inside an item's own list."""
    own = items.select(F.col(item).alias("item"), F.array_sort(F.array_distinct(F.col(genres))).alias("gs"))
    pairs = F.flatten(F.transform("gs", lambda g: F.transform(F.filter("gs", lambda h: h > g), lambda h: F.struct(g.alias("g"), h.alias("h")))))
    both = own.select(F.explode(pairs).alias("x")).groupBy("x.g", "x.h").agg(F.count("*").alias("both_n"))
    n = genre_counts(items, genres)
    met = both.join(n.select(F.col("genre").alias("g"), F.col("n").alias("ng")), "g").join(n.select(F.col("genre").alias("h"), F.col("n").alias("nh")), "h")
    return met.select("g", "h", F.round(F.col("both_n") / (F.col("ng") + F.col("nh") - F.col("both_n")), 6).alias("ratio"))


def promote(items: DataFrame, group: str, item: str, popularity: str, slots: int) -> DataFrame:
    """The most popular items of each group, as many as there are slots; ties to the smaller item."""
    place = W.partitionBy(group).orderBy(F.desc(popularity), item)
    return items.withColumn("slot", F.row_number().over(place)).where(F.col("slot") <= slots)


def argmin(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes first in an order, without a sort: the smallest struct."""
    first = F.min(F.struct(*order, *(c for c in rows.columns if c not in order and c != key)))
    return rows.groupBy(key).agg(first.alias("x")).select(key, "x.*")


def fits_between(first: DataFrame, second: DataFrame) -> DataFrame:
    """tag, may_follow, may_precede of two lists of tags: those that may stand after one and before the other."""
    a, b = first.select(F.col("tag"), F.lit(True).alias("may_follow")).distinct(), second.select(F.col("tag"), F.lit(True).alias("may_precede")).distinct()
    return a.join(b, "tag", "full").select("tag", F.coalesce("may_follow", F.lit(False)).alias("may_follow"), F.coalesce("may_precede", F.lit(False)).alias("may_precede"))


def content_edges(children: DataFrame) -> DataFrame:
    """parent, tag, next, n: which tags follow each other inside a parent's tag, and how often.

    children: parent (a tag), owner (the element), pos, tag; an element without children has one row
    without a tag. A null tag is the beginning, a null next the end, so an edge from null to null
    says that the parent may be empty. Children at one place are taken in the order of their tags.
    """
    w = W.partitionBy("owner").orderBy("pos", "tag")
    rows = children.withColumns({"next": F.lead("tag").over(w), "_k": F.row_number().over(w)})
    begins = rows.where("_k = 1 and tag is not null").select("parent", F.lit(None).cast("string").alias("tag"), F.col("tag").alias("next"))
    return rows.select("parent", "tag", "next").unionByName(begins).groupBy("parent", "tag", "next").agg(F.count("*").alias("n"))


def content_places(edges: DataFrame) -> DataFrame:
    """parent, tag, may_be_first, may_be_last, parent_may_be_empty for each tag that content_edges has inside a parent."""
    inside = edges.where("tag is not null").groupBy("parent", "tag").agg(F.max(F.col("next").isNull()).alias("may_be_last"))
    first = edges.where("tag is null and next is not null").select("parent", F.col("next").alias("tag"), F.lit(True).alias("may_be_first")).distinct()
    empty = edges.where("tag is null and next is null").select("parent", F.lit(True).alias("parent_may_be_empty")).distinct()
    met = inside.join(first, ["parent", "tag"], "left").join(empty, "parent", "left")
    return met.select("parent", "tag", F.coalesce("may_be_first", F.lit(False)).alias("may_be_first"), "may_be_last", F.coalesce("parent_may_be_empty", F.lit(False)).alias("parent_may_be_empty"))


def selected(rows: DataFrame, column: str, wanted) -> DataFrame:
    """The rows whose column is as wanted: equal to a value, one of a list, tuple, set or dict's keys, found by a compiled
    pattern (in Java's syntax), accepted by a function of the column, or in the first column of a DataFrame. Nulls are never selected."""
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(F.col(wanted.columns[0]).alias(column)).distinct(), column, "left_semi").select(*rows.columns)
    value = F.col(column)
    if isinstance(wanted, re.Pattern):
        return rows.where(value.rlike(wanted.pattern))
    if isinstance(wanted, (list, tuple, set, frozenset, dict)):
        return rows.where(value.isin(*wanted))
    return rows.where(wanted(value) if callable(wanted) else value == wanted)


def matching(rows: DataFrame, wanted: dict) -> DataFrame:
    """The rows that are as wanted in every column named; a column that rows lack, or no column at all, is an error."""
    unknown = [c for c in wanted if c not in rows.columns]
    if unknown or not wanted:
        raise ValueError(f"no such column: {', '.join(map(repr, unknown))}" if unknown else "say which columns must match")
    for column, how in wanted.items():
        rows = selected(rows, column, how)
    return rows


def content_chains(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """parent, tag, place: the tags that every content of a parent has, in the order in which they must first come; places count from 1.

    edges: what content_edges gives. A tag must be there if no way from the beginning to the end
    leaves it out, and comes before another one if that can't be reached without it. All tags of
    all parents are left out at once, each in a copy of its parent's edges, and the ways grow by
    an edge a round. Tables of edges have a row for each two tags, whatever the number of elements.
    """
    end = "\u0000end"
    steps = edges.select("parent", F.coalesce("tag", F.lit("")).alias("a"), F.coalesce("next", F.lit(end)).alias("b")).distinct()
    steps = materialise(steps, "content-steps")
    tags = steps.where("a <> ''").select("parent", F.col("a").alias("without")).unionByName(steps.where(F.col("b") != end).select("parent", F.col("b").alias("without"))).distinct()
    reached = front = materialise(tags.select("parent", "without", F.lit("").alias("b")), "content-ways")
    for _ in range(most_rounds):
        near = front.withColumnRenamed("b", "a").join(steps, ["parent", "a"]).where("b <> without").select("parent", "without", "b").distinct()
        front = materialise(near.join(reached, ["parent", "without", "b"], "left_anti"), "content-ways")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    else:
        raise RuntimeError(f"the ways were not found in {most_rounds} rounds")
    must = tags.join(reached.where(F.col("b") == end).select("parent", "without"), ["parent", "without"], "left_anti")
    must = materialise(must, "content-musts")
    pairs = must.select("parent", F.col("without").alias("tag")).join(must, "parent")
    # what must come before a tag: itself, and what it is not reached without
    before = pairs.join(reached.withColumnRenamed("b", "tag"), ["parent", "without", "tag"], "left_anti")
    return before.groupBy("parent", "tag").agg(F.count("*").alias("place"))


def content_follows(edges: DataFrame) -> DataFrame:
    """parent, tag, must_precede, must_follow: the only tag that may come next, and the only one that may come before; null if there are several, or an end is one."""
    inside = edges.where("tag is not null or next is not null")
    only = lambda c: F.when((F.count_distinct(F.coalesce(c, F.lit("\u0000"))) == 1), F.min(c))
    after = inside.where("tag is not null").groupBy("parent", "tag").agg(only(F.col("next")).alias("must_precede"))
    before = inside.where("next is not null").groupBy("parent", F.col("next").alias("tag")).agg(only(F.col("tag")).alias("must_follow"))
    return after.join(before, ["parent", "tag"], "full")
