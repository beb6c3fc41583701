"""All arrangements of an array's elements as rows. The results grow as fast as their definitions say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise


def cartesian(*sets: DataFrame) -> DataFrame:
    """Every combination of one row from each of a few sets; their column names must differ."""
    return reduce(DataFrame.crossJoin, sets)


def _places(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def _short_enough(df: DataFrame, values: str, longest: int) -> DataFrame:
    """df; an array with more than `longest` elements is an error when its row is computed, rather than missing from the result."""
    n = F.size(values)
    said = F.concat(F.lit(f"an array in {values} has more than {longest} elements: "), n.cast("string"))
    return df.where(F.when(n > longest, F.raise_error(said).cast("boolean")).otherwise(n >= 0))


def arrangements(df: DataFrame, values: str, longest: int, out: str = "arrangement", allowed=None) -> DataFrame:
    """Permutations of an array of at most `longest` elements, built one place at a time.

    allowed(place, element): a condition on putting the element (its number) at the place. A
    longer array is an error; null gives no rows, an empty array its one arrangement.
    """
    left = F.col("_left")
    rows = _short_enough(df, values, longest).withColumn("_left", _places(F.col(values))).withColumn("_made", F.array().cast("array<int>"))
    for _ in range(longest):
        grown = rows.withColumn("_next", F.explode_outer(left))
        if allowed is not None:
            grown = grown.where(F.col("_next").isNull() | allowed(F.size("_made"), F.col("_next")))
        keep = F.col("_next").isNull()
        rows = grown.withColumn("_made", F.when(keep, F.col("_made")).otherwise(F.array_append("_made", F.col("_next")))).withColumn("_left", F.when(keep, left).otherwise(F.array_remove(left, F.col("_next")))).drop("_next")
    return rows.withColumn(out, F.transform("_made", lambda k: F.get(F.col(values), k))).drop("_left", "_made")


def permutations(df: DataFrame, values: str, longest: int, out: str = "arrangement") -> DataFrame:
    """All permutations; the caller says how long arrays are at most, and longer ones are an error."""
    return arrangements(df, values, longest, out)


def derangements(df: DataFrame, values: str, longest: int, out: str = "arrangement") -> DataFrame:
    """Permutations that leave no element in its place."""
    return arrangements(df, values, longest, out, lambda place, k: place != k)


def subsets(df: DataFrame, values: str, longest: int, out: str = "subset") -> DataFrame:
    """All subsets, elements in their order; arrays longer than `longest` are an error."""
    numbered = _short_enough(df, values, longest).withColumn("_mask", F.explode(F.expr(f"sequence(0L, shiftleft(1L, size({values})) - 1)")))
    picked = F.filter(F.transform(F.col(values), lambda v, k: F.struct(v.alias("v"), (F.floor(F.col("_mask") / F.pow(F.lit(2.0), k)) % 2).alias("b"))), lambda s: s["b"] == 1)
    return numbered.withColumn(out, F.transform(picked, lambda s: s["v"])).drop("_mask")


def permutations_in_blocks(df: DataFrame, blocks: str, longest: int) -> DataFrame:
    """Arrangements of an array of arrays where each inner array is permuted by itself and the order of the blocks stays.

    At most `longest` blocks of at most `longest` elements; longer ones are an error. No blocks give no rows.
    """
    made = _short_enough(df, blocks, longest).where(F.size(blocks) > 0).withColumn("arrangement", F.array().cast("array<string>")).withColumn("_k", F.lit(0))
    for _ in range(longest):
        there = made.where(F.col("_k") < F.size(blocks)).withColumn("_block", F.get(F.col(blocks), F.col("_k")))
        done = made.where(F.col("_k") >= F.size(blocks))
        grown = arrangements(there, "_block", longest, "_own").withColumn("arrangement", F.concat("arrangement", "_own")).withColumn("_k", F.col("_k") + 1).drop("_block", "_own")
        made = grown.unionByName(done)
    return made.where(F.col("_k") >= F.size(blocks)).drop("_k")


def transforms(df: DataFrame, values: str, moves: list[list[int]], out: str = "arrangement") -> DataFrame:
    """Every arrangement that the moves reach, applied in any order and number, the array as it is included.

    A move lists, for each place, the number of the element that comes there. The reached orders
    of places grow round by round, each joined only with the moves, until a round adds none; they
    are as many as the moves' group has. Arrays of another length are an error.
    """
    if not moves or any(sorted(m) != list(range(len(moves[0]))) for m in moves):
        raise ValueError("each move must hold every place's number once")
    spark, n = df.sparkSession, len(moves[0])
    step = F.array(*(F.array(*map(F.lit, m)) for m in moves))
    latest = spark.range(1).select(F.array(*map(F.lit, range(n))).alias("_order"))
    reached = materialise(latest, "orders")
    latest = reached
    while not latest.isEmpty():
        grown = latest.withColumn("_move", F.explode(step)).select(F.transform("_move", lambda k: F.get("_order", k)).alias("_order")).distinct()
        latest = materialise(grown.join(reached, "_order", "left_anti"), "orders")
        reached = reached.unionByName(latest)
    sized = F.when(F.size(values) == n, F.col(values)).otherwise(F.raise_error(F.lit(f"an array does not have {n} elements")).cast(df.schema[values].dataType))
    return df.withColumn("_v", sized).crossJoin(reached).withColumn(out, F.transform("_order", lambda k: F.get("_v", k))).drop("_v", "_order")
