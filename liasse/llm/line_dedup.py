"""Repeated runs of lines deleted from all but their first place.

All texts together are one sequence of line ids, cut at the documents' ends.  A
suffix array over it, sorted as deep as needed, brings equal runs together:
ranks of runs of 1, 2, 4, ... lines come from ranks of their halves (prefix
doubling), each round one aggregation and one distributed sort of the distinct
pairs.  Runs that occur once leave at once.

How deep is needed: a run counts when it has ``least_words`` words, so from each
line on, the fewest lines that reach them decide.  Suffixes that share that many
lines form an interval of the array with a long enough common prefix; it is
named by the ranks of the two (overlapping) halves of the run.  All members but
the first, by document id and line, are later copies.  Overlapping copies join
to the maximal repeated run, and all its lines are deleted.

Lines are compared as they are (by 128-bit hashes), blank ones too; words are
runs of other characters than blanks.  Null texts stay null, empty ones empty.
Null ids sort first.  Rows that agree in id and text share their lines' fate.
The other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import write_checkpoint

LEAST_WORDS = 50
MOST_SENT = 1_000_000  # documents whose deletions are sent to all executors; above, texts are shuffled

DOC = ("doc_id", "a", "b")


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    i, t = F.col(doc_id), F.col(text)
    return df.select(i.alias("doc_id"), F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"), t.alias("text"))


def line_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, a, b, line, h1, h2, span``: a row per line.

    ``span`` is the least number of lines from here on with ``least_words``
    words, 0 when the rest of the document has fewer.
    """
    rows = _keyed(df, doc_id, text).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, spans, hashes = [], [], []
                for text in batch.column(3).to_pylist():
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    ends = np.cumsum([0] + [len(x.split()) for x in lines])
                    reach = np.searchsorted(ends, ends[:-1] + least_words)
                    spans.append(np.where(reach <= len(lines), reach - np.arange(len(lines)), 0))
                    sizes.append(len(lines))
                    hashes += [xxhash.xxh3_128_digest(x) for x in lines]
                n = np.array(sizes, np.int64)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                line = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(at) for c in range(3)], pa.array(line.astype(np.int32)), pa.array(np.ascontiguousarray(h[:, 0])),
                     pa.array(np.ascontiguousarray(h[:, 1])), pa.array(np.concatenate(spans).astype(np.int32))],
                    names=[*DOC, "line", "h1", "h2", "span"])

    schema = StructType([*rows.select(*DOC).schema.fields, StructField("line", IntegerType()), StructField("h1", LongType()),
                         StructField("h2", LongType()), StructField("span", IntegerType())])
    return rows.mapInArrow(run, schema)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose ``by`` occurs twice or more, with its rank in the sorted order of all of them.

    Distinct values are sorted over all executors; a row's number there grows with the order.
    """
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    ranks = groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    return rows.join(write_checkpoint(ranks), by).drop(*by)


def _further(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """``rows`` with the rank that stands ``by`` lines further in the same document; rows without one go."""
    there = rows.select(*[F.col(c).alias(f"{c}_") for c in DOC], F.col("line").alias("line_"), F.col("rank").alias(name))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in DOC])
    return rows.withColumn("to", F.col("line") + by).join(there, same & (F.col("to") == F.col("line_"))).drop("to", "line_", *[f"{c}_" for c in DOC])


def later_copies(lines: DataFrame) -> DataFrame:
    """``doc_id, a, b, line, span``: runs of enough words that stand in an earlier place too."""
    rows = write_checkpoint(_ranked(lines, ["h1", "h2"]))
    found, size = [], 1
    while True:
        due = rows.where(F.col("span").between(size, 2 * size - 1))
        exact = due.where(F.col("span") == size).withColumn("rank2", F.col("rank"))
        if size > 1:
            mixed = _further(rows, F.col("span") - size, "rank2").where((F.col("span") > size) & (F.col("span") < 2 * size))
            exact = exact.unionByName(mixed)
        found.append(exact.withColumn("size", F.lit(size)))
        if rows.where(F.col("span") >= 2 * size).isEmpty():
            break
        rows = write_checkpoint(_ranked(_further(rows, F.lit(size), "rank2").withColumnRenamed("rank", "rank1"), ["rank1", "rank2"]))
        size *= 2
    runs = reduce(DataFrame.unionByName, found)
    place, name = F.struct(*DOC, "line"), ["size", "span", "rank", "rank2"]
    intervals = runs.groupBy(*name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return runs.join(intervals, name).where(~place.eqNullSafe(F.col("first"))).select(*DOC, "line", "span")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_lines", IntegerType()), StructField("n_removed", IntegerType())]))
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, runs in batches:
        out = []
        for text, cut in zip(texts, runs):
            if text is None:
                out.append((None, 0, 0))
                continue
            lines = text.split("\n")
            gone = np.zeros(len(lines) + 1, np.int64)
            for r in cut if cut is not None else ():
                gone[r["line"]] += 1
                gone[r["line"] + r["span"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            out.append((text if not gone.any() else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), int(gone.sum())))
        yield pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


# Else a filter on its results runs it once more below, in a worker of its own.
_without = _without.asNondeterministic()


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``row`` (the input's columns), ``text`` without later copies of runs, ``n_lines`` and ``n_removed``."""
    copies = later_copies(line_rows(df, doc_id, text, least_words))
    cut = write_checkpoint(copies.distinct().groupBy("a", "b").agg(F.collect_list(F.struct("line", "span")).alias("runs")))
    if cut.count() <= MOST_SENT:
        cut = F.broadcast(cut)
    i, t = F.col(doc_id), F.col(text)
    rows = df.select(F.struct("*").alias("row"), F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b")).join(cut, ["a", "b"], "left")
    # Most texts lose nothing: only those that do are held once more, by a worker.
    whole, cut_here = F.col("row").getField(text), F.col("runs").isNotNull()
    n_lines = F.coalesce(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return rows.withColumn("new", _without(F.when(cut_here, whole), F.col("runs"))).select(
        "row", F.when(cut_here, F.col("new.text")).otherwise(whole).alias("text"), F.when(cut_here, F.col("new.n_lines")).otherwise(n_lines).alias("n_lines"),
        F.col("new.n_removed").alias("n_removed"))
