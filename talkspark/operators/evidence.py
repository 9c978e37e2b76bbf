"""The evidence table and keyword search over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.operators.joins import interval_join
from talkspark.operators.patterns import pattern_join

COLUMNS = [
    "video_id", "start_s", "end_s", "text", "source_kind", "speaker", "speaker_candidate",
    "speaker_status", "speaker_confidence", "confidence",
]
UNSCORED = 0.5


def prefer_merged(plain: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged transcripts, and plain ones of videos that have no merged one."""
    return merged.unionByName(
        plain.join(merged.select("video_id").distinct(), "video_id", "left_anti")
    )


def record_confidence(extra: Column) -> Column:
    """Missing means certain, null means unscored; needs VARIANT to tell them apart."""
    v = F.try_parse_json(extra)
    field = F.try_variant_get(v, "$.confidence", "variant")
    return (
        F.when(F.is_variant_null(field), F.lit(UNSCORED))
        .when(field.isNull(), F.lit(1.0))
        .otherwise(F.try_variant_get(v, "$.confidence", "double"))
    )


def optional_records(records: DataFrame, kind: str) -> DataFrame:
    """Chapter or frame records as evidence.

    Text is the first non-empty of ``text``, ``title``, ``ocr_text``; a missing start falls back
    to the timestamp, then 0; a missing end to the start.  Absent columns count as missing.
    """

    def col(name: str, kind_: str = "string") -> Column:
        return F.col(name) if name in records.columns else F.lit(None).cast(kind_)

    text = X.trim_ws(
        F.coalesce(*[F.nullif(col(n), F.lit("")) for n in ("text", "title", "ocr_text")], F.lit(""))
    )
    start = F.coalesce(col("start", "double"), col("timestamp", "double"), F.lit(0.0))
    return records.select(
        "video_id",
        start.alias("start_s"),
        F.coalesce(col("end", "double"), start).alias("end_s"),
        text.alias("text"),
        F.lit(kind).alias("source_kind"),
        col("speaker").alias("speaker"),
        col("speaker").alias("speaker_candidate"),
        F.lit(None).cast("string").alias("speaker_status"),
        F.lit(None).cast("double").alias("speaker_confidence"),
        record_confidence(col("extra")).alias("confidence"),
    ).filter("text <> ''")


def evidence(spans: DataFrame, *others: DataFrame) -> DataFrame:
    out = spans.withColumn("source_kind", F.lit("transcript")).select(*COLUMNS)
    for other in others:
        out = out.unionByName(other.select(*COLUMNS))
    return out


def query_terms(questions: DataFrame) -> DataFrame:
    """Distinct lower-case terms per question, once if it is asked of several videos."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(L.QUERY_TOKEN), F.lit(0)))
    return questions.select("question_id", F.explode(terms).alias("term")).distinct()


def term_hits(rows: DataFrame, terms: DataFrame, row_id: list[str], text: str = "text") -> DataFrame:
    """(row, term, count) for every row that contains the term, all terms in one walk over the text."""
    asked = terms.select("term").distinct()
    found = pattern_join(rows.select(*row_id, F.col(text).alias("_body")), asked, [], "_body", "term", carry=row_id)
    return found.select(*row_id, "term", F.col("_n").alias("n"))


def with_id(rows: DataFrame) -> DataFrame:
    """Adds ``evidence_id``; equal rows are told apart by their number."""
    named = rows.withColumn("_print", F.xxhash64(*COLUMNS))
    nth = F.row_number().over(Window.partitionBy("_print").orderBy("start_s"))
    return named.withColumn("evidence_id", F.concat_ws("-", F.hex("_print"), nth)).drop("_print")


def search(
    rows: DataFrame,
    questions: DataFrame,
    limit: int = 8,
    per_video: bool = True,
) -> DataFrame:
    """Top ``limit`` evidence rows per question (and video): term count, confidence, start.

    Every evidence row counts on its own, equal ones too.  Questions with a ``video_id`` meet the
    rows of that video alone.  Hits are ranked on ids; a row's other columns are joined to the
    winners.
    """
    keyed = rows if "evidence_id" in rows.columns else with_id(rows)
    asked = ["question_id", *(c for c in ("video_id",) if c in questions.columns)]
    terms = query_terms(questions)
    hits = term_hits(keyed, terms, ["evidence_id"]).join(terms, "term").groupBy("question_id", "evidence_id").agg(F.sum("n").alias("hits"))
    described = hits.join(keyed, "evidence_id")
    if len(asked) > 1:
        described = described.join(questions.select(*asked).distinct(), asked, "left_semi")
    part = ["question_id", "video_id"] if per_video else ["question_id"]
    order = [F.col("hits").desc(), F.col("confidence").desc(), F.col("start_s")]
    tie = [F.col("video_id"), F.col("end_s"), F.col("source_kind"), F.col("text")]
    w = Window.partitionBy(*part).orderBy(*order, *tie)
    columns = ["question_id", "video_id", "start_s", "source_kind", "end_s", "text", "confidence", "speaker", "hits"]
    return described.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*columns, "rank")



def answers(found: DataFrame, asked: DataFrame, frames: DataFrame, pad: float = 2.0) -> DataFrame:
    """Search hits with the frames seen within ±2 s, and a row for every unanswered question.

    ``asked(question_id, video_id)``; ``frames(video_id, frame_no, frame_at)``.
    """
    seen = interval_join(
        found.select("question_id", "video_id", "rank", "start_s", "end_s"),
        frames.select("video_id", "frame_no", "frame_at"),
        "video_id",
        (F.col("start_s") - pad, F.col("end_s") + pad),
        (F.col("frame_at"), F.col("frame_at")),
        60.0,
    ).groupBy("question_id", "video_id", "rank").agg(
        F.array_sort(F.collect_list(F.struct("frame_at", "frame_no"))).alias("_f")
    )
    out = (
        asked.join(found, ["question_id", "video_id"], "left")
        .join(seen, ["question_id", "video_id", "rank"], "left")
    )
    return out.select(
        "question_id",
        "video_id",
        "rank",
        "start_s",
        "end_s",
        "source_kind",
        "hits",
        F.when(F.col("start_s").isNotNull(), X.timecode(F.col("start_s"))).alias("timecode"),
        F.coalesce(
            F.array_join(F.transform(F.col("_f.frame_no"), lambda x: x.cast("string")), ","), F.lit("")
        ).alias("frame_nos"),
        F.col("rank").isNotNull().alias("answered"),
    )


MAX_EXCERPT = 12000
EXCERPT_BLOCK = 512


def excerpts(requests: DataFrame, words: DataFrame, frames: DataFrame, limit: int = MAX_EXCERPT) -> DataFrame:
    """Words overlapping each requested range (closed), cut at ``limit`` characters.

    ``requests(video_id, request_id, r_start, r_end)`` with ``r_end > r_start``.  Words are met
    without their texts first, which tells each request's length.  Requests within the limit gather
    their texts in one grouping.  For the others lengths are summed in blocks of words, and only the
    blocks that begin up to the limit are met word by word, so no request gathers more than ``limit``
    + 1 words, and shuffles few more, however long its range is.
    """
    key = ["video_id", "request_id"]
    asked = requests.filter("r_end > r_start")

    sized = words.select(
        "video_id", "idx", "text", F.coalesce(F.length("text") + 1, F.lit(0)).cast("long").alias("_len"), F.expr(f"idx div {EXCERPT_BLOCK}").alias("_blk"), "start_s", "end_s"
    )

    def within(ranges: DataFrame, on: list[str], *columns: str) -> DataFrame:
        met = interval_join(ranges, sized, on, (F.col("r_start"), F.col("r_end")), (F.col("start_s"), F.col("end_s")), 60.0)
        return met.select(*key, "_len", *columns)

    def joined(rows: DataFrame) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("idx", "text"))).getField("text")
        return rows.groupBy(*key).agg(F.array_join(texts, " ").alias("_head"))

    met = within(asked, ["video_id"])
    size = cut(met.groupBy(*key).agg(F.count(F.lit(1)).alias("word_count"), F.greatest(F.sum("_len") - 1, F.lit(0)).alias("_full")))
    over = size.filter(F.col("_full") > limit).select(*key)
    blocks = within(asked.join(over, key, "left_semi"), ["video_id"], "_blk").groupBy(*key, "_blk").agg(F.sum("_len").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).filter(F.col("_before") <= limit)
    ahead = Window.partitionBy(*key, "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    near = within(asked.join(first.select(*key, "_blk", "_before"), key), ["video_id", "_blk"], "_blk", "_before", "idx", "text")
    begun = near.filter("_len > 0").withColumn("_at", F.col("_before") + F.coalesce(F.sum("_len").over(ahead), F.lit(0))).filter(F.col("_at") <= limit)
    head = joined(within(asked.join(over, key, "left_anti"), ["video_id"], "idx", "text").filter("_len > 0")).unionByName(joined(begun))
    pics = interval_join(
        asked,
        frames.select("video_id", "frame_no", "frame_at"),
        "video_id",
        (F.col("r_start"), F.col("r_end")),
        (F.col("frame_at"), F.col("frame_at")),
        60.0,
    ).groupBy("video_id", "request_id").agg(F.count(F.lit(1)).alias("n_frames"))
    full, length = F.coalesce("_head", F.lit("")), F.coalesce("_full", F.lit(0)).cast("int")
    long = length > limit
    return (
        asked.join(size, key, "left")
        .join(head, key, "left")
        .join(pics, key, "left")
        .select(
            "video_id",
            "request_id",
            F.concat_ws(" - ", X.timecode(F.col("r_start")), X.timecode(F.col("r_end"))).alias("timecode"),
            F.when(long, cut_text(full, limit)).otherwise(full).alias("text"),
            F.coalesce("word_count", F.lit(0)).alias("word_count"),
            F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
            long.alias("truncated"),
            length.alias("full_length"),
        )
    )


def cut_text(text: Column, limit: int) -> Column:
    """First ``limit`` characters back to the last space, if there is one past the start."""
    head = F.substring(text, 1, limit)
    back = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.instr(F.reverse(head), " ") > 0, F.when(back > 0, head.substr(F.lit(1), back)).otherwise(head)).otherwise(head)
