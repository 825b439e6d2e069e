"""Words and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scale import cut_lineage as write_checkpoint  # noqa: F401  in the folder that spark.checkpoint.dir names

# Blanks between words: the space and the ASCII controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a whole text in order; none for null."""
    return F.filter(F.split(whole_text(text), BLANKS), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def refuse_clash(df: DataFrame, *names: str) -> None:
    """Stop where a column that an operator adds is there already."""
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise ValueError(f"the input has columns of these names: {', '.join(taken)}")


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``most`` UTF-8 bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
