"""Reliable cut of a lineage that is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local session, where
    driver and tasks share one disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, which keeps its partitions and their order."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the session's checkpoint folder and read back.

    Stored by column and compressed, where a row of a checkpoint takes eight bytes a field and more.
    Partitions and their order are not kept; ``checkpointed`` keeps them.
    """
    if "void" in df.schema.simpleString():  # has no column format
        return checkpointed(df)
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
