"""Importance resampling towards a target text collection.

Every run of one to three words is a feature; features fall into buckets by their
CRC-32.  A bucket's gain is the log of how much likelier it is in the target than in
the source, in thousandths.  A document's weight is the sum of its features' gains; with
seeded Gumbel noise added, the highest scores are a draw without replacement.

* Bucket counts are arrays that each task adds up; their number is fixed, so the sums are
  as large on any input.  A second pass scores the documents with the array of gains.
* The last score drawn is found by a distributed quickselect: a few random keys of the
  rows still in question cut them into intervals, one aggregation counts the rows below
  and at each key, and the interval that holds the wanted place is cut again.  Keys are
  ``(score, key, number of the row)``, so no two are equal.
* Only the drawn rows are sorted and ranked, by ranges, never in one task.

Null texts have no words; a document without features weighs 0.  Ties go to the smaller
key, nulls last, then to the row that was written first: equal scores and repeated rows
are drawn one by one.  Null keys take noise like an empty one.  Texts are read whole, an
empty table gives no rows, and only the named columns are used, whatever else there is; a
kept column with the name of an output is refused.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import refuse_clash, slices, whole_text, write_checkpoint

BUCKETS = 10_000
ORDER = 3  # words in the longest features
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIVOTS = 15
SLICE = 2 << 20
ROWS_OF_A_TASK = 33  # bits of monotonically_increasing_id() that number the rows of a partition

# What is no letter and no digit becomes a space, A-Z become small; bytes of longer characters stay.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shifts() -> np.ndarray:
    """``[b, k, v]``: what byte ``k`` of a CRC, if it is ``v``, adds to the CRC after ``2 ** b`` further zero bytes."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, low >> 1 ^ np.uint32(0xEDB88320), low >> 1).astype(np.uint32)
    one = np.stack([low, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]])
    out = [one]
    for _ in range(31):
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return np.stack(out)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


SHIFTS = _shifts()


def appended(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts with a second text after them, from both CRCs and the second's number of bytes."""
    out = crc.copy()
    for b in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> b & 1)
        out[at] = _apply(SHIFTS[b], out[at])
    return out ^ more


def feature_buckets(texts: list[str | None], order: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of features their buckets, by first word, and the number of words of each text.

    Array ``k`` has an entry for every word; where no ``k + 1`` words of the text are left it is ``buckets``.
    """
    split = [[] if t is None else t.encode("utf-8").translate(LETTERS).split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64, int(counts.sum()))
    crc = np.array([zlib.crc32(w) for w in number], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in number], np.uint32)
    length = np.array([len(w) + 1 for w in number], np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(ids))
    now, out = crc[ids] if len(ids) else np.zeros(0, np.uint32), []
    for k in range(order):
        if k:
            fits = np.flatnonzero(left > k)
            now = now.copy()
            now[fits] = appended(now[fits], after[ids[fits + k]], length[ids[fits + k]])
        out.append(np.where(left > k, now % np.uint32(buckets), buckets).astype(np.int64))
    return out, counts


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                for b in feature_buckets(batch.column(0).to_pylist(), order, buckets)[0]:
                    total += np.bincount(b, minlength=buckets + 1)
        used = np.flatnonzero(total[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # ``buckets`` rows at most
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log likelihood ratios with one added to each bucket, in whole thousandths."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, text: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_features`` and ``weight``."""
    at, kept = docs.columns.index(text), [f for f in docs.schema.fields if f.name != text]
    table = np.append(gains, 0)  # the last stands for features that there are none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, SLICE):
                found, counts = feature_buckets(batch.column(at).to_pylist(), order, len(gains))
                sums = np.append(0, np.cumsum(sum(table[b] for b in found)))
                ends = np.cumsum(counts)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                features = sum(np.maximum(counts - k, 0) for k in range(order))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(features), pa.array(sums[ends] - sums[ends - counts])],
                                                 names=[*[f.name for f in kept], "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, StructType([*kept, *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]]))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, drawn by a hash of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


@dataclass
class Order:
    """The composite key of rows: higher score, smaller key with nulls last, earlier row."""

    kind: str  # the key's type
    key: str

    def of_rows(self) -> Column:
        return F.struct((-F.col("score")).alias("a"), F.col(self.key).isNull().alias("b"), F.col(self.key).alias("c"), F.col("row").alias("d"))

    def literal(self, row: Row) -> Column:
        return F.struct(F.lit(-row.score).cast("long").alias("a"), F.lit(row.key is None).alias("b"), F.lit(row.key).cast(self.kind).alias("c"),
                        F.lit(row.row).cast("long").alias("d"))


def kth_key(rows: DataFrame, order: Order, k: int, seed: int = SEED, pivots: int = PIVOTS) -> Column | None:
    """The ``k``-th key (from 1) of ``rows``, which have distinct keys; None for ``k`` of 0."""
    if k < 1:
        return None
    key, low, high, turn = order.of_rows(), None, None, 0
    while True:
        turn += 1
        open_rows = rows.where((F.lit(True) if low is None else key > low) & (F.lit(True) if high is None else key < high))
        drawn = open_rows.select("score", F.col(order.key).alias("key"), "row").orderBy(F.xxhash64(F.lit(seed + turn), "row"), "row").limit(pivots).collect()
        if not drawn:
            raise ValueError(f"no key in place {k}")
        at = [order.literal(r) for r in drawn]
        # Counts over all rows, not the open ones, so that places need no carrying over.
        counts = rows.agg(*[F.count_if(key < p) for p in at], *[F.count_if(key == p) for p in at]).first()
        below, equal = counts[:len(at)], counts[len(at):]
        for p, b, e in zip(at, below, equal):
            if b < k <= b + e:
                return p
        under = [(b, i) for i, b in enumerate(below) if b < k]
        over = [(b, i) for i, b in enumerate(below) if b >= k]
        low = at[max(under)[1]] if under else low
        high = at[min(over)[1]] if over else high


def ranked(rows: DataFrame, order: Order) -> DataFrame:
    """``rows`` with ``rank``, their place from 1 in the order: sorted by ranges, then the ranges' counts added up."""
    names = rows.columns
    spread = rows.withColumn("k", order.of_rows()).repartitionByRange("k").sortWithinPartitions("k").drop("k")
    placed = write_checkpoint(spread.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", ROWS_OF_A_TASK)
    # One row for each range; their sums are as many numbers as there are tasks.
    before, starts = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((row.part, before))
        before += row.n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    place = F.col("start") + F.col("at") - F.shiftleft("part", ROWS_OF_A_TASK) + 1
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(*names, place.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's key and ``keep`` columns, ``n_features``, ``weight``, ``score`` and ``rank`` (null where it is not drawn).

    ``percent`` of the rows with at least ``min_words`` words are drawn.
    """
    chosen = docs.select(key, *keep, F.col(text).alias("text"))
    refuse_clash(chosen.drop("text"), "text", "n_words", "n_features", "weight", "score", "rank", "row", "at", "part", "start", "k")
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weighted(chosen.withColumn("text", whole_text(F.col("text"))), gains).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    # Written once: all passes below read these few numbers, and a row keeps its number.
    rows = write_checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    long_enough = rows.where(F.col("n_words") >= min_words)
    order = Order(docs.schema[key].dataType.simpleString(), key)
    last = kth_key(long_enough, order, percent * long_enough.count() // 100, seed)
    columns = [key, *keep, "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    wins = (F.col("n_words") >= min_words) & (order.of_rows() <= last)
    losers = rows.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(wins), order).select(*columns, "rank").unionByName(losers)
