"""An inverted index beside the evidence: questions read their buckets, not the corpus.

A question term has only token characters, so wherever it stands in a text it stands inside one
token.  Three tables follow from that: the vocabulary's grams (three characters from each place
of a token, which tell the tokens that may hold a term), the
postings (which rows hold a token, how often), and the evidence itself.  Grams and postings are
split into hash buckets; a search reads the buckets it asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions.lineage import cut
from talkspark.operators.evidence import query_terms
from talkspark.operators.ranking import ranked

BUCKETS = 64
#: Characters of a gram.
WIDTH = 3
POSTINGS = "video_id long, evidence_id string, token string, tf long, confidence double, start_s double, bucket int"
GRAMS = "gram string, token string, bucket int"


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def tokens() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(L.QUERY_TOKEN), F.lit(0))


def vocabulary(rows: DataFrame) -> DataFrame:
    """``token``: every distinct token of the rows."""
    return rows.select(F.explode(F.array_distinct(tokens())).alias("token")).distinct()


def postings(rows: DataFrame) -> DataFrame:
    """A row per evidence row and token, with what a ranking asks first; ``rows`` has ``evidence_id``.

    Ordered by bucket, token and row, so that a token of any number of rows is spread over many
    tasks and files, and a file's statistics tell its tokens.
    """
    sorted_ = rows.select("video_id", "evidence_id", "confidence", "start_s", F.array_sort(tokens()).alias("_all")).where(F.size("_all") > 0)
    begins = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda i: (i == 1) | (F.get("_all", i - 1) != F.get("_all", i - 2)))
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size("_all") + 1))
    counts = F.zip_with("_begins", ends, lambda a, b: F.struct(F.get("_all", a - 1).alias("token"), (b - a).cast("long").alias("tf")))
    each = sorted_.withColumn("_begins", begins).select("video_id", "evidence_id", "confidence", "start_s", F.explode(counts).alias("_c"))
    placed = each.select("video_id", "evidence_id", "_c.token", "_c.tf", "confidence", "start_s").withColumn("bucket", bucket("token"))
    return placed.repartitionByRange("bucket", "token", "evidence_id").sortWithinPartitions("bucket", "token", "evidence_id")


def grams(tokens: DataFrame) -> DataFrame:
    """``gram, token, bucket``: the three characters from each place of a distinct token, fewer at its end.

    The bucket is that of the first character, so that a term of one or two finds its grams too.
    """
    runs = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.col("token").substr(i, F.lit(WIDTH)))
    each = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(runs)).alias("gram"))
    return each.withColumn("_head", F.substring("gram", 1, 1)).select("gram", "token", bucket("_head").alias("bucket")).repartitionByRange("bucket", "gram", "token").sortWithinPartitions("bucket", "gram")


def only(rows: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """``rows`` of the buckets that ``asked`` names; at most ``BUCKETS`` numbers reach the driver."""
    held = [r[0] for r in asked.select(bucket(column)).distinct().collect()]
    return rows.where(F.col("bucket").isin(held)) if held else rows.where(F.lit(False))


def asked_tokens(terms: DataFrame, gram_rows: DataFrame) -> DataFrame:
    """``token``: the vocabulary's tokens that hold a term."""
    asked = cut(terms.select("term").distinct().withColumns({"_start": F.substring("term", 1, WIDTH), "_head": F.substring("term", 1, 1)}))
    widths = sorted(r[0] for r in asked.select(F.length("_start")).distinct().collect())  # at most WIDTH numbers
    starts = F.array_distinct(F.array(*[F.substring("gram", 1, n) for n in widths or [WIDTH]]))
    near = only(gram_rows, asked, "_head").select("token", F.explode(starts).alias("_start"))
    found = near.join(asked, "_start").where(F.col("token").contains(F.col("term")))
    return found.select("token").distinct()


def search(
    questions: DataFrame, gram_rows: DataFrame, posting_rows: DataFrame, rows: DataFrame, limit: int = 8, per_video: bool = True
) -> DataFrame:
    """Top ``limit`` evidence rows per question (and video): term count, confidence, start.

    Same answers as ``evidence.search``.  The buckets that hold asked tokens are read; hits are
    counted and ranked where the rows are (``ranking``), so what is shuffled goes with rows and
    postings and not with rows times questions.
    """
    terms = cut(query_terms(questions))
    held = only(posting_rows, cut(asked_tokens(terms, gram_rows)), "token")
    shown = ["video_id", "start_s", "source_kind", "end_s", "text", "confidence", "speaker"]
    best = ranked(questions, terms, held, rows.select("evidence_id", *shown), limit, per_video)
    return best.select("question_id", *shown, "hits", "rank")
