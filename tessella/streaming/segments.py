"""Shared documents that grow by segments, as a stream: what users send is stamped, kept, and assembled newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import trim
from tessella.session import materialise

MESSAGES = "issue string, user string, stamp timestamp, text string"
#: A message that begins so is still being written.
IN_PROGRESS = "(?i)^\\s*in progress"


def stamped(messages: DataFrame, separator: str = "____") -> DataFrame:
    """issue, user, stamp, segment: the text above the separator; messages in progress, blank ones and nulls are left out."""
    above = trim(F.split_part("text", F.lit(separator), F.lit(1)))
    rows = messages.where(F.col("issue").isNotNull() & ~F.col("text").rlike(IN_PROGRESS))
    return rows.select("issue", "user", "stamp", above.alias("segment")).where("segment <> ''")


def assembled(segments: DataFrame, separator: str = "____") -> DataFrame:
    """issue, n, text: the segments of each issue, newest first, ties by user and text; repeated segments count once."""
    rows = segments.distinct().groupBy("issue").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("stamp", "user", "segment")), asc=False).alias("s"))
    return rows.select("issue", "n", F.array_join(F.transform("s", lambda x: F.concat(x["user"], F.lit(": "), x["segment"])), f"\n{separator}\n").alias("text"))


def placed(segments: DataFrame) -> DataFrame:
    """issue, n, place, stamp, user, segment: the order of assembled() as rows, for issues of any size; places count from 1.

    Ranges of the whole order become partitions; a segment's place is its place in its range after
    the issue's segments in the ranges before, so no issue is gathered in one task.
    """
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    newest = [F.desc("stamp"), F.desc("user"), F.desc("segment")]
    ranges = segments.select("issue", "stamp", "user", "segment").distinct().repartitionByRange(parts, "issue", *newest)
    rows = materialise(ranges.withColumn("part", F.spark_partition_id()), "segments")
    held = rows.groupBy("issue", "part").agg(F.count("*").alias("m"))
    every = W.partitionBy("issue")
    before = F.coalesce(F.sum("m").over(every.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("issue", "part", F.sum("m").over(every).alias("n"), before.alias("before"))
    own = rows.withColumn("k", F.row_number().over(W.partitionBy("issue", "part").orderBy(*newest)))
    return own.join(held, ["issue", "part"]).select("issue", "n", (F.col("k") + F.col("before")).alias("place"), "stamp", "user", "segment")


def exchange(spark: SparkSession, inbox: str, store: str, checkpoint: str, **trigger) -> None:
    """Append what has arrived in the inbox (JSON files) to the store. By default it takes what is there and ends; processingTime='5 seconds' goes on."""
    arrived = spark.readStream.schema(MESSAGES).json(inbox)
    kept = stamped(arrived.withWatermark("stamp", "1 day").dropDuplicatesWithinWatermark(["issue", "user", "stamp", "text"]))
    query = kept.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, kind, n, value: events in tumbling windows, late ones up to the watermark. Works on streams and tables alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    counted = rows.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n", "value")


def sliding_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """start, kind, n: events in windows that begin at every step, so that each event is in width / step of them. Works on streams and tables alike."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    counted = rows.groupBy(F.window(time, width, step).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def session_counts(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """key, start, end, n: the events of a key that follow each other with less than a gap between, from the first event to a gap after the last.

    On a stream a session is told once the watermark has passed its end; events older than the
    watermark are dropped, others join the sessions they touch. Sessions are merged in each task
    before the shuffle. Rows without a time are left out.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    counted = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
