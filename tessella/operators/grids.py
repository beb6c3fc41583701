"""Where the cells of tables stand, when cells span columns and rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACED = "table string, row int, pos int, column int, width int, height int, overlaps int"


def cells_of(nodes: DataFrame) -> DataFrame:
    """table, row, pos, colspan, rowspan of the parser's nodes: td and th elements below tr below table, however deep.

    A table is named by its file and node. A cell belongs to the nearest row above it and a row to the
    nearest table; rows and cells count in document order, so a table inside a cell is one of its own.
    """
    up = F.size("path") - 1
    above = nodes.where(F.col("tag").isin("td", "th", "tr")).select("file", "node", "tag", "path", "attributes", F.explode(F.sequence(F.lit(1), up)).alias("k"))
    above = above.withColumn("at", F.slice("path", F.lit(1), F.col("k")))
    holders = nodes.where(F.col("tag").isin("table", "tr")).select("file", F.col("path").alias("at"), F.col("node").alias("holder"), F.col("tag").alias("kind"))
    met = above.join(holders, ["file", "at"]).where("(tag = 'tr' and kind = 'table') or (tag <> 'tr' and kind = 'tr')")
    nearest = met.groupBy("file", "node", "tag").agg(F.max_by("holder", "k").alias("holder"), F.first("attributes").alias("attributes"))
    rows = nearest.where("tag = 'tr'").select("file", F.col("node").alias("holder"), F.col("holder").alias("own"))
    span = lambda name: F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(F.col("attributes")[name], F.lit("")), "^ *([0-9]{1,6})", 1), F.lit("999999")).cast("int"), F.lit(1))
    cells = nearest.where("tag <> 'tr'").join(rows, ["file", "holder"])
    return cells.select(F.concat_ws("#", "file", F.col("own").cast("string")).alias("table"), F.col("holder").alias("row"), F.col("node").alias("pos"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order; busy has, for each column, how many rows from this one on are taken from above."""
    table = row = None
    busy: dict[int, int] = {}
    taken: set[int] = set()
    at = 0
    for batch in batches:
        out = []
        for name, line, pos, wide, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (name, line) != (table, row):
                busy = {c: n - 1 for c, n in busy.items() if n > 1} if name == table else {}
                table, row, at, taken = name, line, 0, set(busy)
            while at in taken:
                at += 1
            covered = range(at, at + wide)
            out.append((name, line, pos, at, wide, high, sum(c in taken for c in covered)))
            for c in covered:
                taken.add(c)
                busy[c] = max(busy.get(c, 0), high)
            at += wide
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), *[pa.int32()] * 6), strict=True)] if out else [pa.array([], kind) for kind in (pa.string(), *[pa.int32()] * 6)], names=["table", "row", "pos", "column", "width", "height", "overlaps"])


def placed(cells: DataFrame) -> DataFrame:
    """table, row, pos, column, width, height, overlaps of cells (table, row, pos, colspan, rowspan); columns count from 0.

    Row by row, a cell takes the first column that neither an earlier cell of its row nor one that
    hangs down from a row above covers; overlaps says how many of its further columns are covered
    all the same. Spans below 1 and null ones are 1, rows that hold no cell are not known of. A table
    is swept in one task, as it is part of one file; what is kept of it are its open columns.
    """
    span = lambda c: F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(1))
    rows = cells.where("table is not null").select(F.col("table").cast("string").alias("table"), F.col("row").cast("int").alias("row"), F.col("pos").cast("int").alias("pos"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"))
    return rows.repartition("table").sortWithinPartitions("table", "row", "pos", "colspan", "rowspan").mapInArrow(_place, _PLACED)


def dimensions(cells: DataFrame) -> DataFrame:
    """table, rows, columns, ragged, overlapping, hanging of placed cells.

    ragged: rows whose cells, with those that hang down into them, cover fewer columns than the widest;
    overlapping: cells that cover a column which is covered already; hanging: cells that reach below the last row.
    """
    order = cells.select("table", "row").distinct()
    place = order.groupBy("table").agg(F.sort_array(F.collect_list("row")).alias("lines"))
    named = cells.join(place, "table").withColumn("line", F.array_position("lines", F.col("row")).cast("int"))
    lines = F.size("lines")
    covered = named.select("table", "column", "width", F.explode(F.sequence(F.col("line"), F.least(F.col("line") + F.col("height") - 1, lines))).alias("line"))
    covered = covered.select("table", "line", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("width") - 1)).alias("c")).distinct()
    widths = covered.groupBy("table", "line").agg(F.count("*").alias("n"))
    whole = named.groupBy("table").agg(F.max(lines).alias("rows"), F.max(F.col("column") + F.col("width")).alias("columns"), F.sum((F.col("overlaps") > 0).cast("int")).alias("overlapping"), F.sum((F.col("line") + F.col("height") - 1 > lines).cast("int")).alias("hanging"))
    ragged = widths.join(whole.select("table", "columns"), "table").groupBy("table").agg(F.sum((F.col("n") < F.col("columns")).cast("int")).alias("ragged"))
    return whole.join(ragged, "table").select("table", "rows", "columns", "ragged", "overlapping", "hanging")
