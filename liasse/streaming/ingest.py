"""Incremental page ingest as a stream that keeps its own state.

Two keyed states, one after the other, decide what is new and which numbers it
gets; neither ever sees page text, and the page table is not read again:

* per (case, file) the ranges of page numbers that have landed.  A file that has
  arrived whole is one range, so the state grows with files and gaps, not pages;
* per case the last number given.  Its input is ranges too, in order of file name.

A micro-batch then reads the files it names once more, joins their pages with
the fresh ranges and writes them under its number, ``lot``, replacing whatever an
attempt before has left there; quotations on these pages are verified likewise.

Pages without a number in their file are not landed.  A page that comes twice in
one micro-batch lands once, as the smaller of the two rows' hashes says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.scale import cut_lineage
from ..operators.verification import verify
from ..schemas import PAGES
from ..sources.pages import pages_with_marks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_INTS = ArrayType(IntegerType())
_RANGES = StructType([StructField("debuts", _INTS), StructField("fins", _INTS)])
_LAST = StructType([StructField("dernier", IntegerType())])
_FRESH = StructType([StructField("dossier_id", StringType()), StructField("fichier_source", StringType()), StructField("debut", IntegerType()),
                     StructField("fin", IntegerType()), StructField("chemins", ArrayType(StringType()))])
_NUMBERED = StructType([*_FRESH.fields, StructField("premier", IntegerType())])


def ranges(pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers of a sorted array without repeats."""
    if not len(pages):
        return pages, pages
    cut = np.flatnonzero(np.diff(pages) > 1)
    return pages[np.append(0, cut + 1)], pages[np.append(cut, len(pages) - 1)]


def outside(pages: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers that are in none of these ranges, which are sorted and apart."""
    if not len(starts):
        return pages
    at = np.searchsorted(starts, pages, side="right") - 1
    return pages[(at < 0) | (pages > ends[np.maximum(at, 0)])]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges in order, those that touch made one."""
    by = np.argsort(starts)
    starts, ends = starts[by], ends[by]
    if not len(starts):
        return starts, ends
    cut = np.flatnonzero(starts[1:] > ends[:-1] + 1)
    return starts[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]


class LandedPages(StatefulProcessor):
    """Per (case, file): what of the arriving pages has not landed yet, as ranges."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("plages", _RANGES)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        pages = np.unique(initial["page_fichier"].dropna().to_numpy(np.int64))
        self._keep(*ranges(pages))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        arrived, paths = np.zeros(0, np.int64), set()
        for part in rows:
            arrived = np.union1d(arrived, part["page_fichier"].to_numpy(np.int64))
            paths.update(part["chemin"])
        known = tuple(np.array(x, np.int64) for x in self.state.get()) if self.state.exists() else (np.zeros(0, np.int64),) * 2
        starts, ends = ranges(outside(arrived, *known))
        if not len(starts):
            return
        self._keep(*joined(np.concatenate([known[0], starts]), np.concatenate([known[1], ends])))
        yield pd.DataFrame({"dossier_id": key[0], "fichier_source": key[1], "debut": starts.astype(np.int32), "fin": ends.astype(np.int32),
                            "chemins": [sorted(paths)] * len(starts)})

    def _keep(self, starts: np.ndarray, ends: np.ndarray) -> None:
        self.state.update((starts.tolist(), ends.tolist()))

    def close(self) -> None:
        pass


class LastNumber(StatefulProcessor):
    """Per case: ranges in order of file and page get the numbers after the last one given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("dernier", _LAST)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.state.update((int(initial["numero_global"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(rows).sort_values(["fichier_source", "debut"])
        sizes = (fresh["fin"] - fresh["debut"] + 1).to_numpy(np.int64)
        last = self.state.get()[0] if self.state.exists() else 0
        self.state.update((int(last + sizes.sum()),))
        yield fresh.assign(premier=(last + 1 + np.cumsum(sizes) - sizes).astype(np.int32))

    def close(self) -> None:
        pass


def numbered_ranges(raw: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The stream of fresh ranges with the number of their first page.

    ``raw`` streams page rows with ``chemin``, the file they were read from.
    ``existing`` has the pages that landed before this stream began.
    """
    keys = raw.where("dossier_id IS NOT NULL AND fichier_source IS NOT NULL AND page_fichier IS NOT NULL").select(
        "dossier_id", "fichier_source", "page_fichier", "chemin")
    seen = last = None
    if existing is not None:
        seen = existing.select("dossier_id", "fichier_source", "page_fichier").groupBy("dossier_id", "fichier_source")
        last = existing.groupBy("dossier_id").agg(F.max("numero_global").alias("numero_global")).groupBy("dossier_id")
    fresh = keys.groupBy("dossier_id", "fichier_source").transformWithStateInPandas(LandedPages(), _FRESH, "append", "none", seen)
    return fresh.groupBy("dossier_id").transformWithStateInPandas(LastNumber(), _NUMBERED, "append", "none", last)


def land(session: SparkSession, fresh: DataFrame, lot: int, pages_path: str) -> DataFrame:
    """Write the pages of these ranges as ``lot`` and read them back."""
    # As many paths as a micro-batch takes files.
    paths = [r.chemin for r in fresh.select(F.explode("chemins").alias("chemin")).distinct().orderBy("chemin").collect()]
    raw = session.read.schema(PAGES).parquet(*paths) if paths else session.createDataFrame([], PAGES)
    page = ["dossier_id", "fichier_source", "page_fichier"]
    once = raw.groupBy(*page).agg(F.min_by(F.struct(*[c for c in PAGES.names if c not in page]), F.xxhash64(*PAGES.names)).alias("x"))
    ours = once.join(fresh.drop("chemins"), page[:2]).where(F.col("page_fichier").between(F.col("debut"), F.col("fin")))
    number = (F.col("premier") + F.col("page_fichier") - F.col("debut")).alias("numero_global")
    numbered = ours.select(*page, number, *[F.col("x")[c].alias(c) for c in PAGES.names if c not in (*page, "numero_global")])
    _replace_lot(pages_with_marks(numbered), lot, pages_path)
    return session.read.schema(StructType([*PAGES.fields, StructField("lot", IntegerType())])).parquet(pages_path).where(F.col("lot") == lot).drop("lot")


def _replace_lot(rows: DataFrame, lot: int, path: str) -> None:
    rows.withColumn("lot", F.lit(lot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lot").parquet(path)


def ingest_stream(spark: SparkSession, incoming: str, pages_path: str, quotes_path: str | None, out_path: str, checkpoint: str,
                  existing: DataFrame | None = None, max_files: int = 1000):
    """Land what has arrived in ``incoming`` and stop; each (case, file, page) lands once, however often it is sent.

    Files are taken ``max_files`` at a time.  Started again with the same
    ``checkpoint`` it goes on where it stopped; a batch that failed midway is run
    again and replaces what it had written.
    """
    raw = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(incoming)
    fresh = numbered_ranges(raw.withColumn("chemin", F.col("_metadata.file_path")), existing)

    def run(batch: DataFrame, epoch: int) -> None:
        once = cut_lineage(batch)  # the states advance once, whatever is read below
        landed = land(batch.sparkSession, once, epoch, pages_path)
        if quotes_path is not None:
            on_new = batch.sparkSession.read.parquet(quotes_path).join(
                landed.select("dossier_id", F.col("numero_global").alias("page")), ["dossier_id", "page"], "left_semi")
            _replace_lot(verify(on_new, landed), epoch, out_path)

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed states need it; a running query keeps the setting it began with
    try:
        return fresh.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
