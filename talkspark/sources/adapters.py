"""Talk-shaped views over the shared test tables.

Times are computed in integer milliseconds and divided once, so every engine holds the same
doubles.  All views are built without per-conversation tasks (see ``functions.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions.lineage import cut
from talkspark.functions.ordered import running
from talkspark.operators.chunks import plan_chunks
from talkspark.operators.joins import point_join

TURN_BLOCK = 1024


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def words(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("video_id"),
        "turn",
        "role",
        F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)).alias("tokens"),
    )
    turns = running(
        turns,
        "video_id",
        "turn",
        {"first": ("sum", F.size("tokens").cast("long"))},
        inclusive=False,
        block=TURN_BLOCK,
    )
    flat = turns.select(
        "video_id", "turn", "role", "first", F.posexplode("tokens").alias("p", "orig")
    ).withColumn("idx", F.col("first") + F.col("p"))
    names = F.array(*[F.lit(x) for x in ("torch", "GPT-4.1", "ConvNetJS", "ResNet50")])
    pause = F.array(*[F.lit(x) for x in (500, 1400, 3200, 6200)])
    flat = flat.withColumn(
        "text",
        F.when((F.col("p") == 0) & (F.col("turn") % 4).isin(2, 3), F.lit("라는"))
        .when(F.expr("idx % 41 = 7"), F.element_at(names, F.expr("cast((idx div 41) % 4 + 1 as int)")))
        .when(F.expr("idx % 53 = 11"), F.lit("1,200"))
        .when(F.expr("idx % 89 = 20"), F.lit("보시면"))
        .otherwise(F.col("orig")),
    )
    start = F.expr("idx * 400 + (turn div 4) * 6200") + F.element_at(
        pause, F.expr("cast(turn % 4 + 1 as int)")
    )
    return (
        flat.withColumn("start_ms", start)
        .withColumn("end_ms", F.expr("start_ms + 150 + (length(orig) * 37) % 230"))
        .select(
            "video_id",
            "idx",
            "text",
            "start_ms",
            "end_ms",
            seconds(F.col("start_ms")).alias("start_s"),
            seconds(F.col("end_ms")).alias("end_s"),
            F.col("role").alias("speaker"),
            F.col("role").alias("speaker_global"),
            F.expr(
                "CASE WHEN idx % 101 = 50 THEN 'unresolved' WHEN turn % 3 = 1 THEN 'inferred' "
                "ELSE 'confirmed' END"
            ).alias("speaker_status"),
            F.lit("gemini").alias("origin"),
        )
    )


def cues(spark: SparkSession, sf: str, spoken: DataFrame | None = None) -> DataFrame:
    """Six words a cue; ``spoken`` are the words where they are stored already."""
    shown = (
        F.when(F.col("text") == "torch", F.lit("PyTorch"))
        .when(F.col("text") == "라는", F.lit("self supervised 라는"))
        .otherwise(F.col("text"))
    )
    return (
        (spoken or words(spark, sf))
        .groupBy("video_id", F.expr("idx div 6").alias("cue_idx"))
        .agg(
            F.min("start_ms").alias("cue_start_ms"),
            (F.max("end_ms") + 400).alias("cue_end_ms"),
            F.sort_array(F.collect_list(F.struct("idx", shown.alias("t")))).alias("_t"),
        )
        .select(
            "video_id",
            "cue_idx",
            "cue_start_ms",
            "cue_end_ms",
            seconds(F.col("cue_start_ms")).alias("cue_start"),
            seconds(F.col("cue_end_ms")).alias("cue_end"),
            F.array_join("_t.t", " ").alias("cue_text"),
        )
    )


def caption_tracks(spark: SparkSession, sf: str) -> DataFrame:
    original = F.col("video_id") % 10 != 9
    return videos(spark, sf).select(
        "video_id",
        original.alias("original"),
        F.when(original, "en-orig").otherwise("ko").alias("language"),
        F.when(F.col("video_id") % 13 == 0, "fetch failed").alias("error"),
    )


def srt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling captions: block 2n shows lines n−1 and n, block 2n+1 shows n alone for 10 ms."""
    c = cut(cues(spark, sf))
    both = c.select(
        "video_id",
        F.expr("cue_idx * 2").alias("block_idx"),
        F.col("cue_start_ms").alias("b_start_ms"),
        (F.col("cue_end_ms") - 10).alias("b_end_ms"),
        F.col("cue_text").alias("line"),
        F.lit(1).alias("line_no"),
    )
    alone = c.select(
        "video_id",
        F.expr("cue_idx * 2 + 1").alias("block_idx"),
        (F.col("cue_end_ms") - 10).alias("b_start_ms"),
        F.col("cue_end_ms").alias("b_end_ms"),
        F.col("cue_text").alias("line"),
        F.lit(1).alias("line_no"),
    )
    # the previous line in block 2n: take each cue's times from the next cue by an equi join
    following = c.select(
        "video_id",
        F.expr("cue_idx * 2").alias("block_idx"),
        F.col("cue_start_ms").alias("b_start_ms"),
        (F.col("cue_end_ms") - 10).alias("b_end_ms"),
        (F.col("cue_idx") - 1).alias("cue_idx"),
    )
    rolled = c.select("video_id", "cue_idx", F.col("cue_text").alias("line")).join(
        following, ["video_id", "cue_idx"]
    ).select("video_id", "block_idx", "b_start_ms", "b_end_ms", "line", F.lit(0).alias("line_no"))
    return both.unionByName(alone).unionByName(rolled)


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy("video_id").agg(F.max("end_s").alias("total_s"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return plan_chunks(durations(spark, sf), 90.0, 10.0)


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr(
        "concat('spk:', cast((CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"
        " + chunk_index) % 3 AS string))"
    )
    joined = point_join(
        words(spark, sf),
        chunks(spark, sf).select("video_id", "chunk_index", "chunk_start", "chunk_end"),
        "video_id",
        F.col("start_s"),
        (F.col("chunk_start"), F.col("chunk_end")),
        bucket=60.0,
    )
    return joined.select(
        "video_id",
        "chunk_index",
        "chunk_start",
        "chunk_end",
        F.col("idx").alias("pos"),
        "text",
        "start_ms",
        "end_ms",
        "start_s",
        "end_s",
        label.alias("speaker_raw"),
    )


def response_words(spark: SparkSession, sf: str) -> DataFrame:
    """Speech output per chunk: offsets as strings, some missing, some far outside."""
    rel = "cast({0} - cast(round(chunk_start * 1000) as bigint) as bigint)"
    fmt = (
        "concat(cast({r} div 1000 as string), '.', lpad(cast({r} % 1000 as string), 3, '0'), 's')"
    )
    ms = chunk_words(spark, sf).withColumn(
        "rel_start", F.greatest(F.lit(0), F.expr(rel.format("start_ms")))
    ).withColumn("rel_end", F.greatest(F.lit(0), F.expr(rel.format("end_ms"))))
    return ms.select(
        "video_id",
        "chunk_index",
        "chunk_start",
        "chunk_end",
        "pos",
        "text",
        F.when(F.col("pos") % 307 == 5, "22979s")
        .otherwise(F.expr(fmt.format(r="rel_start")))
        .alias("start_offset"),
        F.when(F.col("pos") % 211 != 3, F.expr(fmt.format(r="rel_end"))).alias("end_offset"),
        F.col("speaker_raw").alias("speaker"),
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    lengths = [20, 150, 30, 40, 600, 90, 60]
    starts = [sum(lengths[:i]) for i in range(len(lengths))]
    native = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("start_time"),
                F.lit(float(s + n)).alias("end_time"),
                F.lit(f"Part {i}").alias("title"),
            )
            for i, (s, n) in enumerate(zip(starts, lengths))
        ]
    )
    return base.select(
        "video_id",
        F.expr("CASE video_id % 4 WHEN 1 THEN 'en' WHEN 2 THEN 'ko' WHEN 3 THEN 'fr' END").alias(
            "language"
        ),
        F.expr(
            "CASE WHEN video_id % 3 = 0 THEN array('en-orig') ELSE cast(array() as array<string>) END"
        ).alias("auto_caption_langs"),
        F.expr("CASE video_id % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("playable_in_embed"),
        F.when(F.col("video_id") % 5 == 0, native).alias("native_chapters"),
    )


def guard_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id"),
        F.when(F.col("doc_id") % 11 == 0, F.repeat(F.lit("안녕하세요 여러분 "), 10))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("doc_id") % 7 == 0, "ko").otherwise(F.col("lang")).alias("langs"),
    )


def frames(spark: SparkSession, sf: str, spoken: DataFrame | None = None) -> DataFrame:
    """One frame per 120 words; ``confidence`` present, null or missing in turn."""
    w = (spoken or words(spark, sf)).filter("idx % 120 in (60, 61)")
    return (
        w.groupBy("video_id", F.expr("idx div 120").alias("n"))
        .agg(
            F.min(F.when(F.expr("idx % 120 = 60"), F.col("start_ms"))).alias("start_ms"),
            F.array_join(
                F.array_sort(F.collect_list(F.struct("idx", "text"))).getField("text"), " "
            ).alias("ocr_text"),
        )
        .filter("start_ms is not null")
        .select(
            "video_id",
            F.col("n").alias("frame_no"),
            seconds(F.col("start_ms")).alias("frame_at"),
            "ocr_text",
            F.expr(
                "CASE n % 3 WHEN 0 THEN '{\"confidence\":0.8}' WHEN 1 THEN '{\"confidence\":null}' "
                "ELSE '{}' END"
            ).alias("extra"),
        )
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"), F.col("text").alias("query"))
    fixed = spark.createDataFrame(
        [("f0", "PyTorch"), ("f1", "1,200"), ("f2", "라는"), ("f3", "zzzunseen")],
        "question_id string, query string",
    )
    return own.unionByName(fixed)


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("key_hash"),
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def urls(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.lpad(F.col("page_id").cast("string"), 11, "0")
    return table(spark, sf, "pages").select(
        "page_id",
        F.explode(
            F.array(
                F.concat(F.lit("https://youtu.be/"), padded),
                F.concat(F.lit("https://www.youtube.com/watch?v="), padded, F.lit("&list=x")),
                F.concat(F.lit("https://www.youtube.com/shorts/"), padded),
                F.concat(F.lit(" "), padded),
                F.col("url"),
            )
        ).alias("url"),
    )


def secret_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(
            F.col("doc_id") % 9 == 0, F.concat(F.col("text"), F.lit(" AIza" + "a" * 32))
        ).otherwise(F.col("text")).alias("text"),
    )
