"""Jobs of several steps that are taken up again after the last step that is still good."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run(spark: SparkSession, source: DataFrame, version: str, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str) -> tuple[DataFrame, list[str]]:
    """(the last step's table, names of the steps that ran).

    Every step's table is written to folder/version/number-name and read by the next. A step whose
    table is complete (it has Spark's _SUCCESS mark) is not run again; a new version of the source
    runs all. A step that is lost half way leaves no mark and is written anew. folder: a path that
    all machines see.
    """
    ran, df = [], source
    for k, (name, step) in enumerate(steps):
        path = f"{folder.rstrip('/')}/{version}/{k:02d}-{name}"
        if ran or not _exists(spark, f"{path}/_SUCCESS"):
            step(df).write.mode("overwrite").parquet(path)
            ran.append(name)
        df = spark.read.parquet(path)
    return df, ran
