"""The folder that driver and executors share, tables kept there for a while, and column names that clash with none."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder in the warehouse, which driver and executors share too. Only a local session, which is one
    process, gets a temporary folder; a cluster whose warehouse is a local folder as well is refused."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if re.fullmatch(r"local(\[.*\])?", sc.master):
            found = tempfile.mkdtemp(prefix="palmleaf-")
        elif re.match(r"(file:|/)", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            found = f"{warehouse}/palmleaf-checkpoints"
        sc.setCheckpointDir(found)
    return str(found).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/palmleaf-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    # a path must be there to be noted; Spark writes over the empty folder
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there and lost executors cost nothing. The
    table goes when the driver ends."""
    path = scratch(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def store_of(path: str):
    """The file system and path of a folder, as pyarrow names them; for tasks that read or write single files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
