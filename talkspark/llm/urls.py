"""URL filters: host and path rules, and boosted trees on lexical features for the rest.

The trees learn from a bounded sample of the URLs that a rule judges, and judge those without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.llm import arrow, boost, sample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
LEXICAL = ("length", "depth", "digit_share", "entropy", "parameters", "host_parts", "hyphens", "longest_run")
SUFFIX = ("suffix_urls", "suffix_length", "suffix_depth", "suffix_digits")
FEATURES = LEXICAL + SUFFIX


def parts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``page_id, url, host, path, suffix, rule, ruled``; ``rules`` are (verdict, host/path).

    A rule is a short configuration list; it fits its host and all subdomains if the path starts
    with the rule's path.  The longest rule wins.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    out = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )

    def fits(rule: str) -> Column:
        host, path = rule.split("/", 1)
        own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        return own & F.startswith(F.col("path"), F.lit("/" + path))

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    named = F.coalesce(*[F.when(fits(rule), F.lit(rule)) for _, rule in ordered], F.lit(None).cast("string"))
    out = out.withColumn("rule", named).withColumn("suffix", F.substring_index("host", ".", -1))
    verdicts = F.coalesce(
        *[F.when(F.col("rule") == rule, F.lit(verdict)) for verdict, rule in ordered], F.lit(None).cast("string")
    )
    return out.withColumn("ruled", verdicts)


def with_suffix_statistics(parted: DataFrame) -> DataFrame:
    """Adds what all URLs of the same last host label look like: their number, length, depth, digits.

    Partial sums are made before the shuffle.  The joined table has a row per suffix; Spark
    broadcasts it if it measures it to be small and splits hot suffixes otherwise.
    """
    stats = parted.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_urls"),
        F.avg(F.length("url")).alias("suffix_length"),
        F.avg(F.length(F.translate("path", "/" + UPPER + LOWER, "/"))).alias("suffix_depth"),
        F.avg(F.length("url") - F.length(F.translate("url", "0123456789", ""))).alias("suffix_digits"),
    )
    return parted.join(stats, "suffix")


def lexical(urls: pa.Array) -> np.ndarray:
    """A row of ``LEXICAL`` numbers per URL, from its UTF-8 bytes."""
    data, offsets = arrow.raw(urls)
    n, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    out = np.zeros((n, len(LEXICAL)))
    if not len(data):
        return out
    text = np.repeat(np.arange(n), np.diff(offsets))
    histogram = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram / np.maximum(size, 1)[:, None]
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    run = np.zeros(len(data), np.int64)
    breaks = ~letter
    breaks[offsets[:-1][offsets[:-1] < len(data)]] = True
    run = np.arange(len(data)) - np.maximum.accumulate(np.where(breaks, np.arange(len(data)), 0))
    full = np.flatnonzero(size)
    out[:, 0] = size
    out[:, 1] = histogram[:, ord("/")]
    out[:, 2] = histogram[:, 48:58].sum(1) / np.maximum(size, 1)
    out[:, 3] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    out[:, 4] = histogram[:, ord("=")]
    out[:, 5] = histogram[:, ord(".")]
    out[:, 6] = histogram[:, ord("-")]
    out[full, 7] = np.maximum.reduceat(run, offsets[:-1][full])
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    texts = [lexical(part.column("url")) for part in arrow.slices(batch, "url")]
    more = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SUFFIX], 1)
    return np.concatenate([np.concatenate(texts), more], 1) if texts else np.zeros((0, len(FEATURES)))


def train(described: DataFrame, most: int = 20_000) -> boost.Trees:
    """Trees for "allow" from at most ``most`` URLs that a rule judges (a few numbers each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("label"), *(pa.array(x[:, j]) for j in range(x.shape[1]))],
                names=["page_id", "label", *FEATURES],
            )

    rows = described.where("ruled is not null").select(
        "page_id", "url", (F.col("ruled") == ALLOW).cast("int").alias("label"), *SUFFIX
    )
    schema = "page_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = sample.bounded(rows, "page_id", most).mapInArrow(run, schema).toPandas()
    table = table.sort_values(["page_id", *FEATURES], kind="stable")
    return boost.fit(table[list(FEATURES)].to_numpy(), table["label"].to_numpy())


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages``.

    A null URL or one without ``://`` has an empty host and path and no rule.  A rule's verdict
    stands; else the trees allow a URL whose score is at least ``threshold``.  Null ids stay null,
    repeated rows give repeated rows, other columns are not read, an empty table gives an empty
    result (the trees then hold only the even base share).
    """
    described = with_suffix_statistics(parts(pages, rules))
    trees = train(described, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = trees.score(_matrix(batch))
            own = np.where(score >= threshold, ALLOW, BLOCK)
            ruled = batch.column("ruled").to_pylist()
            verdict = [r or o for r, o in zip(ruled, own.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    picked = described.select("page_id", "url", "host", "path", "rule", "ruled", *SUFFIX)
    return picked.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
