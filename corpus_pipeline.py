"""Training-corpus pipeline: reject, deduplicate, cut repeats, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read back as
the next stage's ``docs``.  All but the last return the columns of ``documents``.

Null and empty texts: the classifier scores them by its bias, near-dedup and the cut of repeats
keep them, the mix leaves out documents without words.  Null ids and sources, ties and repeated
rows are described at the operators; repeated rows are one row after stage 2.  Columns beyond those
of ``documents`` are not carried.  An empty table gives empty stages.  Texts are never shortened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm import minhash, mixing, pieces, quality, suffix
from talkspark.llm.store import keep

#: Bytes of the strings that stage 3 cuts: 51 words of four letters with their spaces, so that a
#: repeated passage of over 50 words goes also where its words are shorter than usual.
PASSAGE_BYTES = 256
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.7)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs.select(*COLUMNS), *quality.train(docs, labels), threshold=0.7)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays (five-word shingles, similarity 0.8), whatever its doc_id."""
    return minhash.one_of_each_group(docs.select(*COLUMNS), percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` that repeat go wherever they stand, none of them stays; emptied documents go."""
    cut = suffix.without_repeats(docs.select(*COLUMNS), PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each shard in one partition, shuffled within."""
    mixed = mixing.mixed_documents(docs.select(*COLUMNS))
    return mixed.repartition("shard").sortWithinPartitions("shard", "place").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentation of each document, with a check that it decodes to the same text."""
    return pieces.encode(docs, carry=("source",))


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier and the sampled segmentation can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; the rows between stages are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs)
    return docs
