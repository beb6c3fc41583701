"""A tree of choices: items divided by their most frequent genres until no set has too many, all open sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialise, release

_PLACED = "item string, popularity double, path array<string>, problem string"


def divide(items: DataFrame, most: int, most_rounds: int = 1000) -> DataFrame:
    """item, popularity, path, problem: the set that each of items (item, genres, popularity) is put in.

    In every round each open set is divided once: its most frequent genre, ties to the smaller one,
    becomes a set below it and takes its items with it. A set of at most `most` items is done, a larger one is
    open in the next round, without that genre. problem says what could not be divided: an item
    without a further genre, or one that is left when its set has `most` sets below it already;
    its path is that of the set that it stays in. Genres are counted before the shuffle, and no set is gathered.
    Null and repeated genres count once; items are told by their names.
    """
    genres = F.array_distinct(F.filter(F.coalesce("genres", F.array().cast("array<string>")), lambda g: g.isNotNull()))
    rows = items.select(F.col("item").cast("string").alias("item"), F.col("popularity").cast("double").alias("popularity"), genres.alias("genres"))
    # taken: how many sets are below the one that the item is in
    open_ = materialise(rows.withColumns({"path": F.array().cast("array<string>"), "taken": F.lit(0)}), "open")
    done = []
    for _ in range(most_rounds):
        lost = F.when(F.size("genres") == 0, "no genre left").when(F.col("taken") >= most, "too many choices")
        done.append(materialise(open_.withColumn("problem", lost).where("problem is not null").select("item", "popularity", "path", "problem"), "undivided"))
        left = open_.where((F.size("genres") > 0) & (F.col("taken") < most))
        counts = left.select("path", F.explode("genres").alias("genre")).groupBy("path", "genre").agg(F.count("*").alias("n"))
        # an item without genres or room is no longer counted, as it can't be divided
        best = counts.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("m"), "genre")).alias("b")).select("path", "b.genre", (-F.col("b.m")).alias("n"))
        met = left.join(best, "path")
        has = F.array_contains("genres", F.col("genre"))
        below = met.where(has).withColumns({"path": F.concat("path", F.array("genre")), "genres": F.array_remove("genres", F.col("genre"))})
        done.append(materialise(below.where(F.col("n") <= most).select("item", "popularity", "path", F.lit(None).cast("string").alias("problem")), "divided"))
        further = below.where(F.col("n") > most).withColumn("taken", F.lit(0))
        stay = met.where(~has).withColumn("taken", F.col("taken") + 1)
        after = materialise(further.unionByName(stay).select("item", "popularity", "genres", "path", "taken"), "open")
        release(open_)
        open_ = after
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"the items were not divided in {most_rounds} rounds")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    whole = materialise(out, "choices")
    release(*done)
    return whole


def _first(path: Column, n: int | Column) -> Column:
    return F.slice(path, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def promote(divided: DataFrame, most: int) -> DataFrame:
    """item, popularity, path, shown: where each divided item is shown when free places are filled from below.

    From the top down, a set with fewer than `most` sets and items takes items from below that no set above
    has taken: set by set in their order, the most popular first, ties by name. shown is the set that took an item, or its
    own. As many rounds as the tree is deep; a task passes on at most `most` items for a set.
    """
    rows = materialise(divided.select("item", "popularity", "path", F.col("path").alias("shown")), "shown")
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest):
        deeper = rows.where(F.size("path") > depth).withColumn("_set", _first(F.col("path"), depth))
        below = deeper.groupBy("_set").agg(F.count_distinct(F.get("path", F.lit(depth))).alias("_sets"))
        own = rows.where(F.size("path") == depth).groupBy(F.col("path").alias("_set")).agg(F.count("*").alias("_own"))
        free = below.join(own, "_set", "left").select("_set", (most - F.col("_sets") - F.coalesce("_own", F.lit(0))).alias("_free"))
        waiting = deeper.where(F.size("shown") == F.size("path"))
        order = W.partitionBy("_set").orderBy(F.get("path", F.lit(depth)), F.desc("popularity"), "item")
        taken = waiting.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).join(free, "_set").where(F.col("_k") <= F.col("_free")).select(F.col("item").alias("_i"), F.col("_set"))
        rows = materialise(rows.join(taken, F.col("item") == F.col("_i"), "left").select("item", "popularity", "path", F.coalesce("_set", "shown").alias("shown")), "shown")
    return rows


def unwrap_singles(shown: DataFrame) -> DataFrame:
    """shown, but an item that is alone in a set, with what the sets above have not taken, is shown one set higher; of several such sets the highest counts.

    A set counts the items below it that are shown in their own sets, and those that it has taken itself.
    """
    at = shown.withColumn("_k", F.explode(F.when(F.size("shown") > 0, F.sequence(F.lit(1), F.size("shown"))).otherwise(F.array(F.lit(0))))).withColumn("_set", _first(F.col("shown"), F.col("_k")))
    own = F.size("shown") == F.size("path")
    counted = at.where((F.col("_k") > 0) & (own | (F.col("_k") == F.size("shown"))))
    alone = counted.groupBy("_set").agg(F.count("*").alias("n"), F.min("item").alias("_i")).where("n = 1")
    highest = alone.groupBy("_i").agg(F.min(F.size("_set")).alias("_d"))
    met = shown.join(highest, F.col("item") == F.col("_i"), "left")
    return met.select("item", "popularity", "path", F.when(F.col("_d").isNull(), F.col("shown")).otherwise(_first(F.col("shown"), F.col("_d") - 1)).alias("shown"))
