"""Structured Streaming jobs: attempt metering and chunk ingest.

Both sinks write one folder per micro-batch and replace it when the batch is replayed, so a
restart from the checkpoint neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkspark.operators import normalize as N
from talkspark.sources.responses import response_rows

WATERMARK = "10 minutes"
RESPONSES = "video_id bigint, chunk_index bigint, chunk_start double, chunk_end double, response string"
#: State in RocksDB: what a batch costs goes with its own chunks, not with all that were ever seen.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def per_minute(attempts: DataFrame) -> DataFrame:
    """Attempts per key and minute of event time; ``run_available`` counts those over ten minutes late."""
    return (
        attempts.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", "1 minute"), "key_hash")
        .agg(F.count(F.lit(1)).alias("attempts"))
        .select("key_hash", F.col("window.start").alias("minute"), "attempts")
    )


def per_day(attempts: DataFrame) -> DataFrame:
    """Attempts per key and Pacific day.

    The watermark runs on Pacific clock time, so the state of a day is dropped ten minutes after
    its midnight; the hour repeated in autumn lies inside its day and is never late.
    """
    return (
        attempts.withColumn("local_ts", F.from_utc_timestamp("ts", "America/Los_Angeles"))
        .withWatermark("local_ts", WATERMARK)
        .groupBy(F.window("local_ts", "1 day"), "key_hash")
        .agg(F.count(F.lit(1)).alias("attempts"))
        .select("key_hash", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "attempts")
    )


def _by_batch(path: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d):
    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", shape=lambda d: d) -> int:
    """Process what has arrived, then stop; the number of rows that came behind the watermark."""
    done = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_by_batch(path, shape))
        .trigger(availableNow=True)
        .start()
    )
    done.awaitTermination()
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in done.recentProgress for s in p["stateOperators"])


def current_words(spark: SparkSession, out: str) -> DataFrame:
    """Words of each chunk's latest accepted response."""
    at = F.struct("batch_id", "turn")
    chunks = spark.read.parquet(f"{out}/chunks").filter("accepted")
    newest = chunks.groupBy("video_id", "chunk_index").agg(F.max(at).alias("_at")).select("video_id", "chunk_index", "_at.*")
    words = spark.read.parquet(f"{out}/words")
    return words.join(newest, ["video_id", "chunk_index", "batch_id", "turn"], "left_semi").drop("turn")


def latest(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """Update-mode output: the value of the last batch per key."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def _unseen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A chunk's responses that it has not had yet, numbered as they arrived."""
    had = state.get[0].split(",") if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["arrived", "path", "fingerprint"])
    fresh = rows[~rows["fingerprint"].isin(had)].drop_duplicates("fingerprint")
    if len(fresh):
        state.update((",".join([*had, *fresh["fingerprint"]]),))
    yield fresh.drop(columns=["arrived", "path"]).assign(turn=range(len(fresh)))


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """New response files to checked words on the video's clock.

    A chunk that fails the corruption gate is recorded, not hidden.  The state of a chunk is the
    fingerprints of its responses, so a repeated one is not processed again, whenever it comes, and
    no batch reads what earlier ones stored.  Different responses of one chunk in one batch are
    checked each on its own and count in the order of their files (time, then path).
    """
    stream = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(source)
    arrived = stream.select(
        "*",
        F.sha2(F.coalesce("response", F.lit("")), 256).alias("fingerprint"),
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("path"),
    )
    unseen = arrived.groupBy("video_id", "chunk_index").applyInPandasWithState(
        _unseen, f"{RESPONSES}, fingerprint string, turn bigint", "had string", "append", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by each step below; the state must not be walked for each
        # A response stands for its chunk until all are checked.
        tagged = batch.withColumn("chunk_index", F.struct("chunk_index", "turn")).drop("turn")
        # Responses are parsed and dealt by chunk once; what follows finds its chunks in place.
        entries = (
            response_rows(tagged.drop("fingerprint"))
            .withColumn("audio_s", F.col("chunk_end") - F.col("chunk_start"))
            .drop("at")
            .repartition(*N.CHUNK)
            .persist()
        )
        fixed = N.repair(entries).persist()
        gate = N.corruption(fixed, tagged).persist()
        try:
            words = N.absolute(N.drop_duplicates(fixed)).join(
                gate.filter("accepted").select(*N.CHUNK), N.CHUNK, "left_semi"
            )
            words.select("video_id", "chunk_index.*", "pos", "text", "start_s", "end_s", "speaker").write.mode("overwrite").parquet(
                f"{out}/words/batch_id={batch_id}"
            )
            checked = tagged.select(*N.CHUNK, "fingerprint").join(gate, N.CHUNK, "left").withColumn(
                "accepted", F.coalesce("accepted", F.lit(False))
            )
            others = [c for c in checked.columns if c not in N.CHUNK]
            checked.select("video_id", "chunk_index.*", *others).write.mode("overwrite").parquet(f"{out}/chunks/batch_id={batch_id}")
        finally:
            for held in (gate, fixed, entries, batch):
                held.unpersist()

    name, store = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        query = (
            unseen.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()
