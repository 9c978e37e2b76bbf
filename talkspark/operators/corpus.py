"""The corpus job: transcripts to searchable evidence, redone only where inputs changed.

Stages are spans, chapters, evidence and index.  Each keeps a fingerprint of its inputs per video;
a run works on the videos whose fingerprint differs and commits stage by stage, so a run that was
broken off goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.functions.lineage import cut
from talkspark.operators import chapters, fingerprint, index, segment
from talkspark.operators import evidence as E
from talkspark.sources.versions import Versions, changes

SPANS = (
    "video_id long, start_s double, end_s double, text string, speaker string, speaker_candidate string, "
    "speaker_status string, speaker_confidence double, confidence double"
)
CHAPTERS = "video_id long, chapter_no int, start double, end double, title string"
EVIDENCE = (
    "video_id long, evidence_id string, source_path string, start_s double, end_s double, text string, source_kind string, speaker string, "
    "speaker_candidate string, speaker_status string, speaker_confidence double, confidence double"
)
#: Raised when a stage computes something else, so that all videos are redone.
VERSION = {"spans": 1, "chapters": 1, "evidence": 1, "index": 1}


def prints(words: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """``video_id, words_fp, frames_fp, native_fp`` of every video that has words."""
    seen = F.concat_ws("|", fingerprint.millis(F.col("frame_at")), F.coalesce("ocr_text", F.lit("")), F.coalesce("extra", F.lit("")))
    spoken = F.concat_ws(
        "|", fingerprint.millis(F.col("start_s")), fingerprint.millis(F.col("end_s")), F.coalesce("speaker", F.lit("")), F.coalesce("speaker_status", F.lit("")), "text"
    )
    native = videos.select("video_id", F.sha2(F.coalesce(F.to_json("native_chapters"), F.lit("")), 256).alias("native_fp"))
    return (
        fingerprint.unordered(words, "video_id", [F.col("idx"), spoken], "words_fp")
        .join(fingerprint.unordered(frames, "video_id", [F.col("frame_no"), seen], "frames_fp"), "video_id", "left")
        .join(native, "video_id", "left")
    )


class Corpus:
    """The job's stored tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.spans = Versions(spark, root, "spans", {"spans": SPANS})
        self.chapters = Versions(spark, root, "chapters", {"chapters": CHAPTERS})
        self.evidence = Versions(spark, root, "evidence", {"evidence": EVIDENCE}, {"evidence": "source_kind"})
        self.index = Versions(spark, root, "index", {"postings": index.POSTINGS, "pieces": f"video_id long, {index.GRAMS}"}, {"postings": "bucket", "pieces": "bucket"}, ["pieces"])

    def refresh(self, words: DataFrame, frames: DataFrame, videos: DataFrame, chapter_words: DataFrame | None = None) -> dict[str, int]:
        """Brings all stages up to the inputs; returns how many videos each stage worked on.

        ``chapter_words`` are the words that chapters are cut from, if not the same.  Videos that
        have no words any more leave all tables.  The inputs are read several times, so they
        should be stored tables.
        """
        marks = cut(prints(words, frames, videos))
        every = marks.count()
        told = {}
        for name, uses in (("spans", ["words_fp"]), ("chapters", ["words_fp", "native_fp"]), ("evidence", ["words_fp", "native_fp", "frames_fp"]), ("index", ["words_fp", "native_fp", "frames_fp"])):
            held: Versions = getattr(self, name)
            mark = F.sha2(F.concat_ws("|", F.lit(f"{name} {VERSION[name]}"), *[F.coalesce(u, F.lit("-")) for u in uses]), 256)
            changed, gone = changes(held, marks.select("video_id", mark.alias("input_fp")))
            told[name] = changed.count()
            if told[name] or not gone.isEmpty():
                heard = words if chapter_words is None else chapter_words
                held.commit(self._make(name, changed.select("video_id"), told[name] == every, words, frames, videos, heard), changed, gone)
        return told

    def _make(
        self, name: str, todo: DataFrame, every: bool, words: DataFrame, frames: DataFrame, videos: DataFrame, chapter_words: DataFrame
    ) -> dict[str, DataFrame]:
        def mine(rows: DataFrame) -> DataFrame:
            return rows.join(todo, "video_id", "left_semi")

        def spoken(rows: DataFrame) -> DataFrame:
            # where all videos are to be done, words are neither shuffled to be picked nor stored again
            return rows if every else cut(mine(rows))

        if name == "spans":
            return {"spans": segment.spans(spoken(words))}
        if name == "chapters":
            built = chapters.build(spoken(chapter_words), mine(videos))
            return {"chapters": mine(built.select("video_id", F.col("chapter_no").cast("int"), F.col("c_start").alias("start"), F.col("c_end").alias("end"), "title"))}
        if name == "evidence":
            frame_rows = E.optional_records(mine(frames).withColumnRenamed("frame_at", "timestamp"), "frame")
            chapter_rows = E.optional_records(mine(self.chapters.read("chapters")), "chapter")
            rows = E.with_id(E.evidence(mine(self.spans.read("spans")), frame_rows, chapter_rows))
            path = F.concat_ws("/", F.col("source_kind"), F.col("video_id").cast("string"))
            ordered = rows.withColumn("source_path", path).repartitionByRange("source_kind", "video_id", "start_s")
            return {"evidence": ordered.sortWithinPartitions("source_kind", "video_id", "start_s")}
        rows = mine(self.evidence.read("evidence"))
        # A token belongs to the vocabulary, not to a video: only tokens that are new are added.
        known = self.index.read("pieces").select("token").distinct()
        fresh = index.grams(index.vocabulary(rows).join(known, "token", "left_anti"))
        return {"postings": index.postings(rows), "pieces": fresh.withColumn("video_id", F.lit(None).cast("long"))}

    def answers(self, questions: DataFrame, limit: int = 8, per_video: bool = True) -> DataFrame:
        return index.search(questions, self.index.read("pieces"), self.index.read("postings"), self.evidence.read("evidence"), limit, per_video)

    def forget(self, gone: DataFrame) -> None:
        """Takes videos down: their rows leave every table, and the files that held them are deleted."""
        gone = cut(gone.select("video_id").distinct())
        nothing = self.spark.createDataFrame([], "video_id long, input_fp string")
        for held in (self.index, self.evidence, self.chapters, self.spans):
            held.commit({}, nothing, gone)
            held.vacuum()
