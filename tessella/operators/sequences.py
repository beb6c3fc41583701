"""Operators that depend on an order. Every window names a partition key, so no order is made of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as T


def unique_names(rows: DataFrame, text: str, order: list[str], longest: int = 16, out: str = "unique_name") -> DataFrame:
    """A name for each row: the text's stem, then the stem with 1, 2, ... for later rows in the given order."""
    stem = rows.withColumn("_stem", T.name_stem(F.col(text), longest))
    k = F.row_number().over(W.partitionBy("_stem").orderBy(*order)) - 1
    return stem.withColumn(out, F.concat("_stem", F.when(k > 0, k.cast("string")).otherwise(""))).drop("_stem")


def later_holders(rows: DataFrame, key: str, holder: str) -> DataFrame:
    """key, holder, first: each holder of a key but the first, with the first. The first one is a minimum, not a window."""
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min(holder).alias("first"))
    return rows.join(first, F.col(key) == F.col("_k")).where(F.col(holder) > F.col("first")).select(key, holder, "first")


def blank_repeats(rows: DataFrame, partition: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows with columns emptied that equal the row before, from the left as long as all before them do."""
    w, same, out = W.partitionBy(partition).orderBy(*order), F.lit(True), {}
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c)) & F.lag(F.lit(1)).over(w).isNotNull()
        out[c] = F.when(same, "").otherwise(F.col(c).cast("string"))
    return rows.withColumns(out)


def neighbours(rows: DataFrame, partition: str, order: list[str], name: str) -> DataFrame:
    """rows with `previous` and `following` in an order."""
    w = W.partitionBy(partition).orderBy(*order)
    return rows.withColumns({"previous": F.lag(name).over(w), "following": F.lead(name).over(w)})


def longest_runs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, length, low, high: the longest run of consecutive whole numbers among a key's values.

    Values are taken in order and a repeated one ends a run, as it does not follow itself. Of runs
    of one length the lowest counts.
    """
    w = W.partitionBy(key).orderBy(value)
    steps = rows.where(F.col(value).isNotNull()).withColumn("_new", F.when(F.col(value) == F.lag(value).over(w) + 1, 0).otherwise(1))
    runs = steps.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "_run").agg(F.count("*").alias("length"), F.min(value).alias("low"), F.max(value).alias("high"))
    best = F.min(F.struct((-F.col("length")).alias("l"), "low", "high"))
    return runs.groupBy(key).agg(best.alias("x")).select(key, (-F.col("x.l")).alias("length"), "x.low", "x.high")


def examples(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k + 1 rows of each key in an order; each task passes on at most as many."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= k + 1)


def under_headings(rows: DataFrame, partition: str, order: list[str], level: str, name: str) -> DataFrame:
    """rows with `section`: the name of the last heading (level not null) at or before the row, and `outer`: of the last one of level 1."""
    w = W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col(level).isNotNull(), F.col(name))
    top = F.when(F.col(level) == 1, F.col(name))
    return rows.withColumns({"section": F.last(head, True).over(w), "outer": F.last(top, True).over(w)})


def writes_and_reads(events: DataFrame, address: str, order: list[str], op: str) -> DataFrame:
    """address, double_writes, unread: writes that follow a write, and whether the last operation is one, for (address, op = 'write' or 'read') in order."""
    w = W.partitionBy(address).orderBy(*order)
    seen = events.withColumns({"_before": F.lag(op).over(w), "_after": F.lead(op).over(w)})
    double = F.sum(F.when((F.col(op) == "write") & (F.col("_before") == "write"), 1).otherwise(0))
    unread = F.max(F.when((F.col(op) == "write") & F.col("_after").isNull(), 1).otherwise(0))
    return seen.groupBy(address).agg(double.alias("double_writes"), (unread == 1).alias("unread"))


def with_group_size(rows: DataFrame, keys: list[str], out: str = "in_group") -> DataFrame:
    """rows with the number of rows that share their keys. A count joined back: unlike a window it does not sort a hot key in one task."""
    n = rows.groupBy(*keys).agg(F.count("*").alias(out))
    return rows.join(n, keys)


def sorted_runs(rows: DataFrame, values: str, out: str = "runs") -> DataFrame:
    """An array cut into runs that do not fall: an array of arrays."""
    cut = F.aggregate(
        F.col(values),
        F.array().cast("array<array<string>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), -1) <= x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array_append(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(F.array(x)))),
    )
    return rows.withColumn(out, F.when(F.size(values) == 0, F.array().cast("array<array<string>>")).otherwise(cut))
