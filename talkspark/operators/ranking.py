"""Best evidence rows per question, ranked where the rows are.

Every question meets every row that holds one of its words, so hits outnumber rows by the number of
questions and are never shuffled.  Rows and postings go to buckets once; each bucket also gets the
questions, in parts of at most ``PART``.  A task streams a bucket block by block (a video's rows, or
``BLOCK`` of them), counts a block's hits as one matrix, and lets only the best rows of each question
leave, a row once with the questions it answers.  Blocks of one video, or of the whole table, are
ranked again together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions.lineage import cut

PART = 256
BLOCK = 4096
BUCKET_ROWS = 4096
#: Postings whose weights are held at once.
STEP = 8192
#: Tokens whose weights are kept for later blocks.
KNOWN = 16384
QUESTION, ROW, POSTING = 0, 1, 2
#: Sorts before every video.
FIRST = -(1 << 62)
PLACE = ["_bucket", "_part"]


class Questions:
    """Terms of some questions, and the weight of a token for each: how often their terms stand in it."""

    def __init__(self, held: list[tuple[str, list[str]]]):
        self.ids = pa.array([q for q, _ in held], pa.string())
        asking: dict[str, list[int]] = {}
        for place, (_, terms) in enumerate(held):
            for term in terms:
                asking.setdefault(term, []).append(place)
        self.terms = list(asking)
        self.asked_by = np.zeros((len(asking), len(held)), np.int32)
        #: What a term begins with, and its number where that is all of it.
        self.begun: dict[str, int] = {}
        for number, (term, places) in enumerate(asking.items()):
            self.asked_by[number, places] = 1
            for n in range(1, len(term)):
                self.begun.setdefault(term[:n], -1)
            self.begun[term] = number
        self.known: dict[str, int] = {}
        self.weights = np.zeros((0, len(held)), np.int32)

    def held_in(self, token: str) -> dict[int, int]:
        """Terms that stand in a token, with how often, none counted over itself."""
        found: dict[int, int] = {}
        begun, size = self.begun, len(token)
        for i in range(size):
            for j in range(i + 1, size + 1):
                number = begun.get(token[i:j])
                if number is None:
                    break
                if number >= 0:
                    found[number] = found.get(number, 0) + 1
        for number, n in found.items():
            if n > 1:
                found[number] = token.count(self.terms[number])
        return found

    def weigh(self, tokens: list[str]) -> np.ndarray:
        """A row per token, at most ``STEP`` of them, and a column per question."""
        fresh = [t for t in tokens if t not in self.known]
        if len(self.known) + len(fresh) > KNOWN:
            self.known, fresh = {}, tokens
        if fresh:
            at, end = len(self.known), len(self.known) + len(fresh)
            if end > len(self.weights):
                self.weights = np.resize(self.weights, (min(KNOWN, max(end, 2 * len(self.weights))), len(self.ids)))
            more = self.weights[at:end]
            more[:] = 0
            held = [self.held_in(t) for t in fresh]
            rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
            numbers = np.array([n for h in held for n in h], np.int64)
            times = np.array([n for h in held for n in h.values()], np.int32)
            for a in range(0, len(rows), STEP):
                own = rows[a : a + STEP]
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                more[own[begins]] += np.add.reduceat(self.asked_by[numbers[a : a + STEP]] * times[a : a + STEP, None], begins, axis=0)
            self.known.update(zip(fresh, range(at, end)))
        return self.weights[[self.known[t] for t in tokens]]


class Block:
    """Rows in the order that equal hits are ranked by, and their hits of each question so far."""

    def __init__(self, asked: Questions, rows: list[pa.RecordBatch]):
        self.asked, self.rows = asked, pa.concat_arrays([b.column("_row") for b in rows])
        self.names = pa.concat_arrays([b.column("_id") for b in rows])
        self.hits = np.zeros((len(self.rows), len(asked.ids)), np.int64)

    def add(self, postings: pa.RecordBatch) -> None:
        at = pc.fill_null(pc.index_in(postings.column("_id"), value_set=self.names), -1).to_numpy(zero_copy_only=False)
        for a in range(0, len(at), STEP):
            coded = postings.column("_token").slice(a, STEP).dictionary_encode()
            weights = self.asked.weigh(coded.dictionary.to_pylist())
            times = postings.column("_tf").slice(a, STEP).to_numpy()
            own = at[a : a + STEP]
            by_row = np.argsort(own, kind="stable")
            by_row = by_row[own[by_row] >= 0]
            if not len(by_row):
                continue
            begins = np.flatnonzero(np.diff(own[by_row], prepend=-1))
            counted = weights[coded.indices.to_numpy()[by_row]] * times[by_row, None]
            self.hits[own[by_row][begins]] += np.add.reduceat(counted, begins, axis=0)

    def best(self, limit: int) -> pa.RecordBatch | None:
        order = np.argsort(-self.hits, axis=0, kind="stable")[:limit]
        rank, question = np.nonzero(np.take_along_axis(self.hits, order, axis=0))
        row = order[rank, question]
        if not len(row):
            return None
        by_row = np.argsort(row, kind="stable")
        rank, question, row = rank[by_row], question[by_row], row[by_row]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        found = pa.StructArray.from_arrays(
            [self.asked.ids.take(pa.array(question)), pa.array(self.hits[row, question]), pa.array((rank + 1).astype(np.int32))],
            names=["question_id", "hits", "rank"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), found)
        return pa.RecordBatch.from_arrays([self.rows.take(pa.array(row[begins])), lists], names=["_row", "_found"])


def _walk(limit: int, bound: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket after bucket: its questions, then block after block: its rows, their postings."""
        place = block_of = None
        pending: list[tuple[str, list[str]]] = []
        rows: list[pa.RecordBatch] = []
        asked: Questions | None = None
        block: Block | None = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*PLACE, "_key", "_block", "_side")])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in pairwise(edges):
                bucket, part, key, number, side = keys[:, a].tolist()
                part_rows = batch.slice(a, b - a)
                if (bucket, part, key, number) != block_of:
                    if block is not None and (done := block.best(limit)) is not None:
                        yield done
                    rows, block, block_of = [], None, (bucket, part, key, number)
                    if bound:
                        pending, asked = [], None
                if (bucket, part) != place:
                    place, pending, asked = (bucket, part), [], None
                if side == QUESTION:
                    pending += zip(part_rows.column("_id").to_pylist(), (t.split(" ") for t in part_rows.column("_terms").to_pylist()))
                elif not pending:
                    continue
                elif side == ROW:
                    rows.append(part_rows.select(["_row", "_id"]))
                elif rows or block is not None:
                    if asked is None:
                        asked = Questions(pending)
                    if block is None:
                        block, rows = Block(asked, rows), []
                    block.add(part_rows)
        if block is not None and (done := block.best(limit)) is not None:
            yield done

    return run


def ranked(questions: DataFrame, terms: DataFrame, postings: DataFrame, rows: DataFrame, limit: int, per_video: bool) -> DataFrame:
    """``rows`` with ``question_id, hits, rank``: the best ``limit`` of each question (and video).

    ``terms(question_id, term)``; ``postings(evidence_id, video_id, token, tf)``.  Order: hits,
    confidence, start; then video, end, kind and text.  Questions with a ``video_id`` meet the rows
    of that video alone.
    """
    bound = "video_id" in questions.columns
    total = max(1, rows.count())
    buckets, cuts_of_all = -(-total // BUCKET_ROWS), -(-total // BLOCK)
    # one string: a list column that is null in all other rows is walked by Arrow's writer from its start at each of them
    whole = terms.groupBy("question_id").agg(F.array_join(F.collect_list("term"), " ").alias("_terms"))
    parts = 1 if bound else max(1, -(-whole.count() // PART))
    by_video = per_video or bound
    cuts = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_cuts")
    many = cut(rows.groupBy("video_id").agg(cuts).where("_cuts > 1")) if by_video else None
    single = many is None or many.isEmpty()
    bucket = F.pmod(F.xxhash64("_key", "_block"), F.lit(buckets)).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)

    def cuts_known(df: DataFrame) -> DataFrame:
        if single:
            return df.withColumn("_cuts", F.lit(1 if by_video else cuts_of_all))
        return df.join(many, "video_id", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1)))

    def placed(df: DataFrame) -> DataFrame:
        key = F.col("video_id").cast("long") if by_video else F.lit(0).cast("long")
        number = F.pmod(F.xxhash64("evidence_id"), F.col("_cuts")).cast("int")
        return cuts_known(df).withColumns({"_key": key, "_block": number}).withColumns({"_bucket": bucket, "_part": every_part})

    def best(which: str) -> DataFrame:
        own = placed(rows).where(which).select(*PLACE, "_key", "_block", F.lit(ROW).alias("_side"), F.col("evidence_id").alias("_id"), F.struct(*rows.columns).alias("_row"))
        held = placed(postings).where(which).select(
            *PLACE, "_key", "_block", F.lit(POSTING).alias("_side"), F.col("evidence_id").alias("_id"), F.col("token").alias("_token"), F.col("tf").cast("long").alias("_tf")
        )
        if bound:
            named = cuts_known(questions.select("question_id", "video_id").distinct()).where(which).join(whole, "question_id")
            numbers = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
            asked = named.withColumns({"_key": F.col("video_id").cast("long"), "_block": numbers}).withColumns({"_bucket": bucket, "_part": F.lit(0)})
        else:
            asked = whole.withColumns({"_key": F.lit(FIRST), "_block": F.lit(-1), "_part": F.pmod(F.xxhash64("question_id"), F.lit(parts)).cast("int")}).withColumn(
                "_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
            )
        asked = asked.select(*PLACE, "_key", "_block", F.lit(QUESTION).alias("_side"), F.col("question_id").alias("_id"), "_terms")
        every = asked.unionByName(own, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)
        tie = [F.col("_row.confidence").desc(), *(F.col(f"_row.{c}") for c in ("start_s", "video_id", "end_s", "source_kind", "text"))]
        dealt = every.repartition(*PLACE).sortWithinPartitions(*PLACE, "_key", "_block", "_side", *tie)
        found = T.ArrayType(T.StructType([T.StructField("question_id", T.StringType()), T.StructField("hits", T.LongType()), T.StructField("rank", T.IntegerType())]))
        out = dealt.mapInArrow(_walk(limit, bound), T.StructType([dealt.schema["_row"], T.StructField("_found", found)]))
        return out.select("_row.*", F.explode("_found").alias("_f")).select(*rows.columns, "_f.*")

    def again(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("question_id", *(["video_id"] if per_video else [])).orderBy(
            F.col("hits").desc(), F.col("confidence").desc(), "start_s", "video_id", "end_s", "source_kind", "text"
        )
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)

    if not per_video:
        return again(best("true"))
    return best("true") if single else best("_cuts = 1").unionByName(again(best("_cuts > 1")))
