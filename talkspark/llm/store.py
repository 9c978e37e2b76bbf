"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN = threading.local()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the lineage ends there.

    Only a local session without that setting, as in tests, uses a folder of its own machine.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scopes = getattr(_OPEN, "scopes", [])
    if scopes:
        scopes[-1].paths.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


class scope:  # noqa: N801
    """Tables kept inside are deleted at the end, but for those given to ``save``.

    Right where everything that reads them is itself kept inside: a result that is kept needs the
    tables it was made from no more, also if executors are lost.
    """

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []
        self.saved: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        """``df``, as ``keep`` returned it, outlives the scope."""
        self.saved.add(df.kept_at)
        return df

    def __enter__(self) -> scope:
        if not hasattr(_OPEN, "scopes"):
            _OPEN.scopes = []
        _OPEN.scopes.append(self)
        return self

    def __exit__(self, failed, *_) -> None:
        scopes = _OPEN.scopes
        scopes.remove(self)
        for spark, path in self.paths:
            if path in self.saved:
                if scopes:
                    scopes[-1].paths.append((spark, path))
            else:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
