"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", app: str = "tessella", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir where the cluster names one. Where that is unset, a session on one
    machine, as in tests, gets a folder in the warehouse; on a cluster that would be a disk which
    other machines don't see, so it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = f"{warehouse}/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder. Results that were not saved elsewhere can't be read afterwards."""
    return _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    A lost executor then costs a reread of Parquet files rather than a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out, lambda _, k=id(out): _written.pop(k, None)), path)
    return out


#: Where the tables that materialise has returned are, by their identity.
_written: dict[int, tuple[weakref.ref, str]] = {}


def derived(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, whose release from now on deletes what materialise has written for table."""
    _, path = _written.pop(id(table))
    _written[id(df)] = (weakref.ref(df, lambda _, k=id(df): _written.pop(k, None)), path)
    return df


def release(*tables: DataFrame) -> None:
    """Delete what materialise has written for these tables; nothing that isn't written yet may depend on them."""
    for df in tables:
        kept = _written.pop(id(df), None)
        if kept:
            _delete(df.sparkSession, kept[1])


#: Bytes of a batch that goes to a Python worker; the number of rows alone does not bound it.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this library where it is not installed (the same path on every machine), and bound what they are handed at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{have}" if have else root
    return spark
