"""The shared folder of the cluster, and cutting lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one (tests) gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as no column's name has (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh place in the shared folder; all places of one application lie in one folder, to be removed after it."""
    return f"{shared_dir(spark).rstrip('/')}/quillspark-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; unlike a checkpoint it is compressed and columnar.

    Row groups are small, as a writer holds a whole one in memory.
    """
    path = new_path(df.sparkSession, "table")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.parquet(path)
