"""Readers for caption, metadata and URL inputs, and table sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.lineage import folder

TIMING = "^(\\d{2}:\\d{2}:\\d{2},\\d{3})\\s+-->\\s+(\\d{2}:\\d{2}:\\d{2},\\d{3})"
VIDEO_ID = "(?:v=|youtu\\.be/|/shorts/|/embed/)([0-9A-Za-z_-]{11})"
CAPTIONS = (
    "struct<source:string,language:string,original:boolean,video_id:string,error:string,"
    "cues:array<struct<start:double,end:double,text:string>>>"
)


def read_texts(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """Whole files as (path, content), one row each."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def srt_blocks(texts: DataFrame, content: str = "content") -> DataFrame:
    """SRT blocks that have a timing row: index, start, end, non-empty trimmed lines."""
    keep = [c for c in texts.columns if c != content]
    clean = F.replace(F.regexp_replace(F.col(content), "^\\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))
    chunk = texts.select(
        *keep, F.posexplode(F.split(X.trim_ws(clean), "\\n\\s*\\n")).alias("_i", "_chunk")
    )
    rows = F.transform(F.split("_chunk", "\\n"), X.trim_ws)
    timed = chunk.withColumn("_rows", rows).withColumn(
        "_at", F.array_position(F.transform("_rows", lambda r: r.rlike(TIMING)), F.lit(True)).cast("int")
    ).filter("_at > 0")
    timing = F.element_at("_rows", F.col("_at"))
    return timed.select(
        *keep,
        F.col("_i").alias("block_idx"),
        X.srt_seconds(F.regexp_extract(timing, TIMING, 1)).alias("b_start"),
        X.srt_seconds(F.regexp_extract(timing, TIMING, 2)).alias("b_end"),
        F.filter(F.slice("_rows", F.col("_at") + 1, F.size("_rows")), lambda r: r != "").alias("lines"),
    )


def dense_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Renumber blocks after untimed ones were dropped, so that neighbours stay neighbours."""
    from talkspark.functions.ordered import numbered

    return numbered(
        blocks.withColumnRenamed("block_idx", "_old"), key, F.expr("_old div 8192"), [F.col("_old")], out="block_idx"
    ).drop("_old")


def block_lines(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        *[c for c in blocks.columns if c != "lines"], F.explode("lines").alias("line")
    )


def captions(files: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Caption files as (tracks, cues); old files take their language from the source name."""
    parsed = files.withColumn("_c", F.from_json(json, CAPTIONS))
    keep = [c for c in files.columns if c != json]
    tracks = parsed.select(
        *keep, F.col("_c.source").alias("source"), F.col("_c.language").alias("language"),
        F.col("_c.original").alias("original"), F.col("_c.error").alias("error"),
    )
    cues = parsed.select(*keep, F.posexplode("_c.cues").alias("cue_idx", "_q")).select(
        *keep, "cue_idx", F.col("_q.start").alias("cue_start"), F.col("_q.end").alias("cue_end"),
        F.col("_q.text").alias("cue_text"),
    )
    return tracks, cues


def metadata(files: DataFrame, json: str = "json") -> DataFrame:
    """Metadata kept of a video's full information: only what later stages use.

    A non-boolean embed flag counts as unknown, so the record is read as VARIANT.
    """
    v = F.try_parse_json(json)

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    keys = lambda p: F.map_keys(
        F.coalesce(F.try_variant_get(v, p, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    )
    embed = F.try_variant_get(v, "$.playable_in_embed", "variant")
    return files.select(
        text("$.id").alias("video_id"),
        F.substring(F.coalesce(text("$.title"), F.lit("")), 1, 200).alias("title"),
        F.coalesce(F.nullif(text("$.channel"), F.lit("")), text("$.uploader")).alias("channel"),
        text("$.language").alias("language"),
        F.array_sort(F.filter(keys("$.automatic_captions"), lambda k: k.endswith("-orig"))).alias("auto_caption_langs"),
        F.slice(F.array_sort(keys("$.subtitles")), 1, 20).alias("subtitle_langs"),
        F.when(F.schema_of_variant(embed) == "BOOLEAN", F.try_variant_get(v, "$.playable_in_embed", "boolean")).alias(
            "playable_in_embed"
        ),
    )


def video_id(url: Column) -> Column:
    """Id in a link, or a bare 11-character id; null when there is none."""
    found = F.regexp_extract(url, VIDEO_ID, 1)
    bare = X.trim_ws(url)
    return F.when(found != "", found).when(bare.rlike("^[0-9A-Za-z_-]{11}$"), bare)


def split_urls(urls: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(accepted with video_id, rejected)."""
    marked = urls.withColumn("video_id", video_id(F.col(url)))
    return marked.filter("video_id is not null"), marked.filter("video_id is null").drop("video_id")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, reachable from all executors."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Whole-table replace, partitioned by kind and ordered for range pruning on video and time."""
    evidence.repartitionByRange("source_kind", "video_id", "start_s").sortWithinPartitions(
        "source_kind", "video_id", "start_s"
    ).write.mode("overwrite").partitionBy("source_kind").parquet(path)


def write_srt(blocks: DataFrame, path: str) -> None:
    """SRT text, one partition folder per video, blocks in cue order."""
    out = blocks.repartitionByRange("video_id", "cue_no").sortWithinPartitions("video_id", "cue_no")
    out.select("video_id", F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(
        "video_id"
    ).text(path)


def rewrite_without(spark: SparkSession, path: str, gone: DataFrame, keys: list[str], partition: str) -> str:
    """A new version of the table at ``path`` without the rows whose ``keys`` are in ``gone``.

    Overwriting partitions in place would leave those that have no rows any more.  The new
    version is written whole, and only then is the old folder deleted; its path is returned.
    """
    left = spark.read.parquet(path).join(gone.select(*keys).distinct(), keys, "left_anti")
    version = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    left.write.partitionBy(partition).parquet(version)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return version


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The summary each video keeps through a rebuild of the derived tables."""
    rest = [c for c in summaries.columns if c != "video_id"]
    return summaries.groupBy("video_id").agg(F.max_by(F.struct(*rest), "stored_at").alias("_s")).select(
        "video_id", "_s.*"
    )


def rebuild(evidence: DataFrame, summaries: DataFrame, path: str) -> DataFrame:
    """Replace the evidence table; host summaries cannot be derived and are carried over."""
    write_evidence(evidence, path)
    return latest_summaries(summaries)
