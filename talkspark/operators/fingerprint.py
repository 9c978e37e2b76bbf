"""Content fingerprints: equal content, equal key.

Rows are hashed in blocks and the block hashes hashed again, so no task concatenates a whole
video.  Inputs are whole milliseconds and text in a fixed field order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions.ordered import as_list

HASH_BLOCK = 4096


def tree_hash(
    df: DataFrame, keys: str | Sequence[str], idx: str, row: Column, out: str = "fingerprint"
) -> DataFrame:
    """sha256 over rows in ``idx`` order, in two levels of 4,096."""
    keys = as_list(keys)

    def level(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, F.expr(f"_i div {HASH_BLOCK}").alias("_b")).agg(
            F.sha2(
                F.array_join(F.array_sort(F.collect_list(F.struct("_i", "_h"))).getField("_h"), "\n"), 256
            ).alias("_h")
        ).withColumnRenamed("_b", "_i")

    base = df.select(*keys, F.col(idx).cast("long").alias("_i"), row.alias("_h"))
    top = level(level(base)).groupBy(*keys).agg(
        F.sha2(
            F.array_join(F.array_sort(F.collect_list(F.struct("_i", "_h"))).getField("_h"), "\n"), 256
        ).alias(out)
    )
    return top.withColumn(out, F.concat(F.lit("sha256:"), F.col(out)))


def unordered(df: DataFrame, keys: str | Sequence[str], row: Sequence[Column], out: str = "fingerprint") -> DataFrame:
    """A key of a set of rows, in whatever order they lie; ``row`` must tell a row's place.

    Four 64-bit hashes of each row are summed apart and stand beside the number of rows, so a task
    hands on one row a key and no text is shuffled.
    """
    sums = [F.sum(F.xxhash64(F.lit(n), *row).cast("decimal(20,0)")).cast("string") for n in range(4)]
    return df.groupBy(*as_list(keys)).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias(out))


def millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long").cast("string")


def transcript(words: DataFrame) -> DataFrame:
    row = F.concat_ws(
        "|", millis(F.col("start_s")), millis(F.col("end_s")), F.coalesce("speaker", F.lit("")), "text"
    )
    return tree_hash(words, "video_id", "idx", row, "transcript_fp")


def chapter_table(chapters: DataFrame) -> DataFrame:
    row = F.concat_ws(
        "|",
        "chapter_id",
        millis(F.col("c_start")),
        millis(F.col("c_end")),
        "title",
        F.array_join("keywords", ","),
        F.array_join("excerpts", "\n"),
    )
    return tree_hash(chapters, "video_id", "chapter_no", row, "chapters_fp")


def sentence_list(sentences: DataFrame) -> DataFrame:
    return tree_hash(sentences, "video_id", "no", F.col("sentence_key"), "sentences_fp")


def files(files: DataFrame) -> DataFrame:
    """sha256 of whole file contents (``binaryFile`` source rows)."""
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("fingerprint"))
