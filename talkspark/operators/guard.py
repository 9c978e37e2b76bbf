"""Scripts of texts, and transcripts that are really translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X

MIN_TRANSCRIPT = 40
MIN_CAPTIONS = 20
DOMINANT = 0.3
TRACE = 0.05


def script_counts(texts: DataFrame, text: str = "text", prefix: str = "n_") -> DataFrame:
    """``texts`` plus one count column per script; no shuffle.

    The text beyond ASCII is taken out once, and of that what no common script holds, so the many
    classes scan little of most texts.
    """
    counts = X.script_counts(F.col(text), F.col("_rest"), F.col("_rare"))
    return (
        texts.withColumn("_rest", X.beyond_ascii(F.col(text)))
        .withColumn("_rare", X.without_class(F.col("_rest"), L.script_class(*L.COMMON_SCRIPTS)))
        .withColumns({prefix + s: c for s, c in counts.items()})
        .drop("_rest", "_rare")
    )


def _total(prefix: str = "n_") -> Column:
    total = F.lit(0)
    for s in L.SCRIPTS:
        total = total + F.col(prefix + s)
    return total


def dominant(prefix: str = "n_") -> Column:
    """Script of a text from its count columns; kana decide for japanese early."""
    total = _total(prefix)
    best = F.greatest(*[F.struct(F.col(prefix + s).alias("n"), F.lit(s).alias("s")) for s in L.SCRIPTS])
    return (
        F.when(total == 0, F.lit(None))
        .when(F.col(prefix + "japanese") / total >= TRACE, F.lit("japanese"))
        .when(best["n"] / total >= DOMINANT, best["s"])
    )


def share(script: Column, prefix: str = "n_") -> Column:
    total = _total(prefix)
    count = F.lit(0)
    for s in L.SCRIPTS:
        count = F.when(script == s, F.col(prefix + s)).otherwise(count)
    count = count + F.when(script == "japanese", F.col(prefix + "han")).otherwise(F.lit(0))
    return F.when(total == 0, F.lit(0.0)).otherwise(count / total)


def metadata_script(videos: DataFrame) -> DataFrame:
    """Script the metadata implies: declared language first, then the first usable auto track."""
    auto = F.array_compact(
        F.transform(
            "auto_caption_langs", lambda c: X.requested_script(F.regexp_replace(c, "-orig$", ""))
        )
    )
    return videos.select(
        "video_id", F.coalesce(X.requested_script(F.col("language")), F.get(auto, 0)).alias("meta_script")
    )


def check(rows: DataFrame) -> DataFrame:
    """Flags texts whose expected script is nearly absent.

    ``rows`` holds ``text``, ``captions``, ``captions_language``, ``langs``, ``meta_script``
    (all nullable but ``text``).  Evidence order: original captions, requested languages,
    metadata.
    """
    caps = F.col("_caps")
    base = script_counts(
        script_counts(rows.withColumn("_caps", F.coalesce("captions", F.lit("")))), "_caps", "c_"
    )
    from_captions = F.when(
        F.coalesce(F.col("captions_language").endswith("-orig"), F.lit(False))
        & (F.length(caps) >= MIN_CAPTIONS),
        dominant("c_"),
    )
    out = base.withColumn(
        "expected_script",
        F.coalesce(from_captions, X.requested_script(F.col("langs")), F.col("meta_script")),
    ).withColumn("text_script", dominant())
    flagged = (
        (F.length("text") >= MIN_TRANSCRIPT)
        & F.col("expected_script").isNotNull()
        & (share(F.col("expected_script")) < TRACE)
    )
    return out.withColumn("translated", F.coalesce(flagged, F.lit(False))).drop(
        "_caps", *[p + s for p in ("n_", "c_") for s in L.SCRIPTS]
    )
