"""Streaming job: silent runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import vocab as v


def orphans(heartbeats: DataFrame, now) -> DataFrame:
    """Cases whose run went silent at ``now`` (batch): last heartbeat too old.

    A finished or failed case never is; an unreadable timestamp never is.
    """
    last = heartbeats.filter("mis_a_jour_le is not null").groupBy("dossier_id").agg(F.max_by(F.struct("statut", "mis_a_jour_le"), "mis_a_jour_le").alias("x"))
    delay = F.when(F.col("x.statut") == "en_cours", v.DELAIS_ORPHELIN_S["en_cours"]).when(F.col("x.statut") == "en_attente", v.DELAIS_ORPHELIN_S["en_attente"])
    silent = F.unix_micros(now) - F.unix_micros("x.mis_a_jour_le")
    return last.filter(silent > delay * 1_000_000).select("dossier_id", "x.statut", "x.mis_a_jour_le")


_OUT = StructType([StructField("dossier_id", StringType()), StructField("statut", StringType()), StructField("orphelin", BooleanType())])
_STATE = StructType([StructField("statut", StringType()), StructField("dernier_ms", LongType())])


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        status, _ = state.get
        state.remove()
        yield pd.DataFrame([(key[0], status, True)], columns=_OUT.names)
        return
    status, last = state.get if state.exists else (None, -1)
    for batch in batches:
        for s, t in zip(batch["statut"], batch["mis_a_jour_le"]):
            ms = int(t.timestamp() * 1000)
            if ms >= last:
                status, last = s, ms
    delay = v.DELAIS_ORPHELIN_S.get(status)
    if delay is None:  # finished or failed: nothing to watch
        if state.exists:
            state.remove()
        return
    state.update((status, last))
    due = last + delay * 1000
    if due > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(due)
    else:
        state.remove()
        yield pd.DataFrame([(key[0], status, True)], columns=_OUT.names)


def orphans_stream(heartbeats: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Silent runs as they happen: state per case, event-time timer."""
    watched = heartbeats.select("dossier_id", "statut", "mis_a_jour_le").filter("mis_a_jour_le is not null").withWatermark("mis_a_jour_le", lateness)
    return watched.groupBy("dossier_id").applyInPandasWithState(
        _watch, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

