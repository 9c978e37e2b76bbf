"""Request metering: daily counts, attempts in the last minute, waiting time, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions.ordered import running

MINUTE = 60_000_000  # microseconds
BUCKET = 600_000_000


def pacific_day(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "America/Los_Angeles"), "yyyy-MM-dd")


def daily(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("key_hash", pacific_day(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("attempts")
    )


def _minutes(rows: DataFrame) -> DataFrame:
    """Rows in ten-minute buckets with the minute before each bucket copied in."""
    us = F.unix_micros("ts")
    base = rows.withColumn("us", us).withColumn("day", pacific_day(F.col("ts"))).withColumn(
        "_home", F.floor(us / BUCKET).cast("long")
    )
    late = F.col("us") - F.col("_home") * BUCKET >= BUCKET - MINUTE
    return base.withColumn(
        "_b", F.explode(F.array_compact(F.array("_home", F.when(late, F.col("_home") + 1))))
    )


def recent(attempts: DataFrame, limit: int) -> DataFrame:
    """Attempts within the last 60 s of the same key and Pacific day, and seconds until one of
    ``limit`` slots frees.  An attempt exactly 60 s old is outside; attempts of one microsecond
    all wait for the same slot, so the largest of their lags is taken."""
    w = Window.partitionBy("key_hash", "day", "_b").orderBy("us")
    out = (
        _minutes(attempts)
        .withColumn("rpm_attempts", F.count(F.lit(1)).over(w.rangeBetween(-(MINUTE - 1), 0)))
        .withColumn("_nth", F.lag("us", limit - 1).over(w) if limit > 1 else F.col("us"))
        .withColumn("_nth", F.max("_nth").over(w.rangeBetween(Window.currentRow, Window.currentRow)))
    )
    full = (F.col("rpm_attempts") >= limit) & (F.col("_nth") > F.col("us") - MINUTE)
    return out.filter("_b = _home").select(
        *[c for c in attempts.columns],
        "day",
        "rpm_attempts",
        F.when(full, F.col("_nth") + MINUTE - F.col("us")).otherwise(F.lit(0)).alias("wait_us"),
    )


def usage_at(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts so far that Pacific day and in the last minute, at each request's time.

    ``requests(request_id, key_hash, ts, …)``.
    """
    asked = requests.withColumn("_q", F.struct(*requests.columns)).select("key_hash", "ts", "_q").withColumn(
        "_side", F.lit(1)
    )
    both = attempts.select("key_hash", "ts").withColumn("_side", F.lit(0)).unionByName(
        asked, allowMissingColumns=True
    )
    both = both.withColumn("us", F.unix_micros("ts")).withColumn("day", pacific_day(F.col("ts")))
    counted = running(
        both, ["key_hash", "day"], "us", {"attempts": ("sum", F.expr("cast(1 - _side as bigint)"))},
        bucket=F.floor(F.col("us") / BUCKET).cast("long"), order=[F.col("us"), F.col("_side")],
    )
    w = Window.partitionBy("key_hash", "day", "_b").orderBy("us").rangeBetween(-(MINUTE - 1), 0)
    return (
        _minutes(counted)
        .withColumn("rpm_attempts", F.sum(F.expr("1 - _side")).over(w))
        .filter("_b = _home and _side = 1")
        .select("_q.*", "day", "attempts", "rpm_attempts")
    )


def preflight(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Verdict per request: ``requests`` also carries expected_calls, daily_limit, rpm_limit
    (nullable) and free_mode."""
    u = usage_at(requests, attempts)
    remaining = F.greatest(F.lit(0), F.col("daily_limit") - F.col("attempts"))
    return u.withColumn("remaining", remaining).withColumn(
        "verdict",
        F.when(
            (F.col("expected_calls") < 0) | (F.col("daily_limit") <= 0) | F.coalesce(F.col("rpm_limit") <= 0, F.lit(False)),
            "invalid",
        )
        .when(F.col("free_mode") & (F.col("expected_calls") > F.col("remaining")), "daily limit")
        .when(F.coalesce(F.col("rpm_attempts") >= F.col("rpm_limit"), F.lit(False)), "minute limit")
        .otherwise("ok"),
    ).withColumn("after_expected", F.col("attempts") + F.col("expected_calls"))
