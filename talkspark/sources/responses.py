"""Speech responses: nested JSON to word rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.functions import text as X

SCHEMA = (
    "struct<steps:array<struct<content:array<struct<annotations:array<struct<"
    "type:string,text:string,start_offset:string,end_offset:string,speaker:string>>>>>>>"
)


def response_rows(responses: DataFrame, json: str = "response") -> DataFrame:
    """Word rows in array order: only ``word_info`` entries whose trimmed text is not empty."""
    keep = [c for c in responses.columns if c != json]
    parsed = responses.withColumn("_r", F.from_json(json, SCHEMA))
    steps = parsed.select(*keep, F.posexplode("_r.steps").alias("_i", "_s"))
    contents = steps.select(*keep, "_i", F.posexplode("_s.content").alias("_j", "_c"))
    notes = contents.select(*keep, "_i", "_j", F.posexplode("_c.annotations").alias("_k", "_a"))
    text = X.trim_ws(F.col("_a.text"))
    # one order over all steps, blocks and entries (two million blocks a step, entries a block)
    position = F.shiftleft(F.col("_i").cast("long"), 42) + F.shiftleft(F.col("_j").cast("long"), 21) + F.col("_k")
    return notes.filter((F.col("_a.type") == "word_info") & (text != "")).select(
        *keep,
        F.struct("_i", "_j", "_k").alias("at"),
        position.alias("pos"),
        text.alias("text"),
        X.parse_offset(F.col("_a.start_offset")).alias("start_s"),
        X.parse_offset(F.col("_a.end_offset")).alias("end_s"),
        F.col("_a.speaker").alias("speaker"),
    )
