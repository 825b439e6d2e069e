"""Ordered scans that never gather a whole key in one task.

A window over ``dossier_id`` puts every row of a case in one task; one case may
hold a third of all rows.  These helpers cut each key in blocks of its order,
scan inside the blocks, scan the (few) block totals, and add both.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = 4096


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[Column | str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums, last non-null values and previous-row values per key.

    ``block`` must grow with ``order``.  Running values include the row itself;
    ``lags`` are those of the row before, null on the first row of a key.
    """
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    rows = df.withColumn("__b", block)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    totals = rows.groupBy(*keys, "__b").agg(
        *[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), place)).alias(f"__l_{n}") for n, e in lasts.items()],
        *[F.max_by(F.struct(e.alias("x")), place).alias(f"__g_{n}") for n, e in lags.items()],
    )
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b",
        *[F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}") for n in lasts],
        *[F.last(f"__g_{n}").over(before).alias(f"__g_{n}") for n in lags],
    )
    local = rows.select(
        "*",
        *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(n) for n, e in lasts.items()],
        *[F.lag(F.struct(e.alias("x"))).over(inside).alias(n) for n, e in lags.items()],
    )
    joined = local.join(offsets, [*keys, "__b"])
    return joined.select(
        *[c for c in df.columns],
        *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(f"__s_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(n), F.col(f"__l_{n}")).alias(n) for n in lasts],
        *[F.coalesce(F.col(n), F.col(f"__g_{n}"))["x"].alias(n) for n in lags],
    )


def ordered_rank(
    df: DataFrame, keys: list[str], block: Column | list[Column], order: list[Column | str], name: str
) -> DataFrame:
    """``row_number`` per key, over one or more nested levels of blocks.

    Rows are ranked inside the finest block; the counts of the blocks before
    it, level by level, give the offset.  Levels must grow with the order.
    """
    levels = block if isinstance(block, list) else [block]
    names = [f"__b{i}" for i in range(len(levels))]
    rows = df.withColumns(dict(zip(names, levels)))
    groups = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    offsets = groups.withColumn("__offset", F.lit(0))
    for depth in range(len(names), 0, -1):
        own, parent = names[:depth], names[: depth - 1]
        before = Window.partitionBy(*keys, *parent).orderBy(own[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = groups.groupBy(*keys, *own).agg(F.sum("__n").alias("__m")) if depth < len(names) else (
            groups.withColumnRenamed("__n", "__m"))
        level = level.select(*keys, *own, F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__o"))
        offsets = offsets.join(level, [*keys, *own]).withColumn("__offset", F.col("__offset") + F.col("__o")).drop("__o")
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    local = rows.withColumn("__r", F.row_number().over(inside))
    return local.join(offsets.drop("__n"), [*keys, *names]).select(
        *df.columns, (F.col("__r") + F.col("__offset")).cast("int").alias(name)
    )


def page_block(column: str = "numero_global") -> Column:
    return F.floor(F.col(column) / BLOCK)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by columns to as many tasks as a shuffle has, however few bytes they are: what follows makes many rows or much work of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    A session on one machine may leave it unset, as tests do, and then gets a
    folder of its own; on a cluster that would be a folder no other machine
    sees, so the call fails.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that a query writes on its way."""
    return f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4()}"


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
