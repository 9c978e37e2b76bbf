"""Tables that are rewritten video by video, with a commit, and read as one.

A run writes the rows of the videos it worked on to a folder of its own (``table/run=N``) and
commits by writing its state: which run holds each video under which input fingerprint, and which
(video, run) pairs are dead.  The newest complete state decides what a reader sees, so a run that
dies half-way changes nothing.  Readers leave out dead pairs, which are few between two calls of
``vacuum``, and never join the table with all its videos.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions.lineage import cut

#: Runs of a shared table that ``vacuum`` leaves as they are.
MANY = 16
STATE = "video_id long, input_fp string, run long, dead boolean"


class Versions:
    """The versioned tables of one stage below ``root``; ``tables`` maps a name to its columns in DDL.

    Rows of the tables in ``shared`` belong to no video: they are only added to and never dead, all
    their complete runs are read, and ``vacuum`` leaves them alone until they have many.
    """

    def __init__(
        self, spark: SparkSession, root: str, stage: str, tables: dict[str, str], split: dict[str, str] | None = None, shared: Sequence[str] = ()
    ):
        self.spark, self.at, self.tables, self.split, self.shared = spark, f"{root.rstrip('/')}/{stage}", tables, split or {}, shared

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self, name: str, complete: bool = False) -> list[int]:
        """Numbers of the run folders of a table, or of the states that were written to the end."""
        fs, folder = self._fs(), self._path(f"{self.at}/{name}")
        if not fs.exists(folder):
            return []
        found = [f.getPath().toString() for f in fs.listStatus(folder)]
        return sorted(int(p.rsplit("=", 1)[1]) for p in found if "run=" in p and (not complete or fs.exists(self._path(f"{p}/_SUCCESS"))))

    def newest(self) -> int | None:
        runs = self._runs("state", complete=True)
        return runs[-1] if runs else None

    def state(self) -> DataFrame:
        """``video_id, input_fp, run, dead`` as last committed."""
        run = self.newest()
        if run is None:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.at}/state/run={run}")

    def read(self, name: str) -> DataFrame:
        """The live rows of a table, with the columns of its definition.

        Only runs that the state names are read.  Their number, not that of the rows or videos,
        is what the driver learns.
        """
        columns = self.tables[name]
        state = self.state()
        if name in self.shared:
            held = set(self._runs(name, complete=True))
        else:
            held = {r["run"] for r in state.select("run").distinct().collect()} & set(self._runs(name))
        if not held:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(f"{columns}, run long").option("basePath", f"{self.at}/{name}").parquet(*[f"{self.at}/{name}/run={r}" for r in sorted(held)])
        if name in self.shared or state.where("dead").isEmpty():
            return rows.drop("run")
        dead = cut(state.where("dead").select("video_id", "run"))  # stored, so that Spark knows how few they are
        return rows.join(dead, ["video_id", "run"], "left_anti").drop("run")

    def commit(self, outputs: dict[str, DataFrame], done: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds a run: the rows of the videos in ``done`` (video_id, input_fp) replace older ones; those in ``gone`` end.

        ``done`` and ``gone`` must not change while the run is written (stored tables).
        """
        run = max([0, *self._runs("state"), *(r for t in self.tables for r in self._runs(t))]) + 1
        for name, rows in outputs.items():
            writer = rows.select(*self.spark.createDataFrame([], self.tables[name]).columns).write
            writer = writer.partitionBy(self.split[name]) if name in self.split else writer
            writer.parquet(f"{self.at}/{name}/run={run}")
        old = self.state()
        ended = done.select("video_id") if gone is None else done.select("video_id").unionByName(gone.select("video_id"))
        marked = old.join(ended.distinct().withColumn("ended", F.lit(True)), "video_id", "left")
        older = marked.select("video_id", "input_fp", "run", (F.col("dead") | F.coalesce("ended", F.lit(False))).alias("dead"))
        fresh = done.select("video_id", "input_fp", F.lit(run).cast("long").alias("run"), F.lit(False).alias("dead"))
        older.unionByName(fresh).write.parquet(f"{self.at}/state/run={run}")
        return run

    def vacuum(self) -> int:
        """Live rows alone, in one run; older folders are deleted after the commit.

        If it dies before the commit nothing has changed; if after it, the old folders are in no
        state any more and go with the next call.
        """
        run = max([0, *self._runs("state"), *(r for t in self.tables for r in self._runs(t))]) + 1
        kept = [name for name in self.shared if len(self._runs(name)) <= MANY]
        for name in self.tables.keys() - kept:
            rows = self.read(name)
            writer = rows.write.partitionBy(self.split[name]) if name in self.split else rows.write
            writer.parquet(f"{self.at}/{name}/run={run}")
        live = self.state().where("not dead").withColumn("run", F.lit(run).cast("long"))
        live.write.parquet(f"{self.at}/state/run={run}")
        fs = self._fs()
        for name in (*(self.tables.keys() - kept), "state"):
            for old in self._runs(name):
                if old != run:
                    fs.delete(self._path(f"{self.at}/{name}/run={old}"), True)
        return run


def changes(held: Versions, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos whose input is new or other than the held one (with its fingerprint), and videos that are no more."""
    now = held.state().where("not dead").select("video_id", "input_fp")
    changed = cut(prints.select("video_id", "input_fp").join(now, ["video_id", "input_fp"], "left_anti"))
    gone = cut(now.join(prints, "video_id", "left_anti").select("video_id"))
    return changed, gone
