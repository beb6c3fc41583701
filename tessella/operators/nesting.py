"""Headings of any depth: which ones are open at each row of a document, however long the document is.

The whole order is cut into ranges, and a range is read once with a stack of open headings. A
heading closes those of its level or a deeper one. What is left at the end of a range is its
summary; those of a document are put one on top of the other in the same way, which gives what
was open before each range. So a long document is as many tasks as it has ranges, and nothing is
gathered but a stack for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

_ENTRY = pa.struct([("level", pa.int64()), ("name", pa.string())])
_STACK = "array<struct<level: bigint, name: string>>"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row in order: the headings of its range that are open before it, and the smallest level in its range so far.

    Columns: document, level, name, and what is passed on.
    """
    document, stack, least = None, [], None
    for batch in batches:
        before, smallest = [], []
        for key, level, name in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != document:
                document, stack, least = key, [], None
            if level is not None:
                while stack and stack[-1]["level"] >= level:
                    stack.pop()
                least = level if least is None else min(least, level)
            before.append(list(stack))
            smallest.append(least)
            if level is not None:
                stack.append({"level": level, "name": name})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.list_(_ENTRY)), pa.array(smallest, pa.int64())], names=[*batch.schema.names, "_before", "_least"])


def _still(stack: Column, least: Column) -> Column:
    """Of open headings, those that one of level `least` leaves open."""
    return F.when(least.isNull(), stack).otherwise(F.filter(stack, lambda x: x["level"] < least))


def under_headings(rows: DataFrame, document: str, order: list[str], level: str, name: str) -> DataFrame:
    """rows with `trail`: the names of the headings that are open at each row, outermost first, the row's own not included.

    A row with a level is a heading; under it stand the rows behind it, up to the next heading of
    its level or a smaller one. Levels are whole numbers, any of which may be missing. Rows stand in
    the order of `order`, nulls first, ties in that of level and name. Null documents are one document.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]
    named = rows.select(F.to_json(F.struct(F.col(document).alias("d"))).alias("_doc"), F.col(level).cast("long").alias("_level"), F.col(name).cast("string").alias("_name"), *own, F.struct(*rows.columns).alias("_row"))
    keys = ["_doc", *(f"_o{k}" for k in range(len(order))), "_level", "_name"]
    ranges = named.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranges = ranges.select("_doc", "_level", "_name", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), "_row")
    kind = f"_doc string, _level bigint, _name string, _part int, _at bigint, _row {named.schema['_row'].dataType.simpleString()}, _before {_STACK}, _least bigint"
    read = materialise(ranges.mapInArrow(_open, kind), "headings")
    last = F.max_by(F.struct("_before", "_level", "_name", "_least"), "_at").alias("x")
    ends = read.groupBy("_doc", "_part").agg(last).select("_doc", F.struct("_part", "x._before", "x._level", "x._name", "x._least").alias("end"))
    # a list as long as a document has ranges
    every = ends.groupBy("_doc").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    start = F.struct(F.expr(f"cast(array() as {_STACK})").alias("now"), F.expr(f"cast(array() as array<struct<part: int, stack: {_STACK}>>)").alias("known"))

    def put(s: Column, e: Column) -> Column:
        own = F.when(e["_level"].isNull(), e["_before"]).otherwise(F.concat(e["_before"], F.array(F.struct(e["_level"].alias("level"), e["_name"].alias("name")))))
        return F.struct(F.concat(_still(s["now"], e["_least"]), own).alias("now"), F.concat(s["known"], F.array(F.struct(e["_part"].alias("part"), s["now"].alias("stack")))).alias("known"))

    known = every.select(F.col("_doc").alias("_d"), F.explode(F.aggregate("ends", start, put)["known"]).alias("k")).select("_d", F.col("k.part").alias("_p"), F.col("k.stack").alias("_earlier"))
    met = read.join(known, (F.col("_doc") == F.col("_d")) & (F.col("_part") == F.col("_p")))
    trail = F.transform(F.concat(_still(F.col("_earlier"), F.col("_least")), F.col("_before")), lambda x: x["name"])
    return met.select("_row.*", trail.alias("trail"))
