"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory;
pass two shuffles each bucket on its own (Spark's ``shuffle`` is a Fisher-Yates
shuffle) and lays the buckets end to end.  The place of a record in that order
decides its shard and its slot, so shard sizes differ by one record at most.

Ties and repeated rows are records like any other: rows that agree in key and
text meet in one bucket, and a bucket that such rows make too large is scattered
a second time at random (written down first, so that a lost task draws nothing
anew).  Null keys and texts hash as absent; an empty table gives no rows.  The
other columns travel with their record, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import ordered_scan
from .common import whole_text, write_checkpoint

BUCKET_BYTES = 8 << 20
OVERFULL = 4  # times the wanted size; only repeated rows or one long text get there


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, and one more for its end."""
    return (F.octet_length(whole_text(text)) + 1).cast("long")


def _per_bucket(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def scatter(df: DataFrame, key: str, text: str, seed: int, bucket_bytes: int, total: int) -> tuple[DataFrame, DataFrame]:
    """The records with their bucket, and each bucket's number of records and bytes."""
    buckets = max(1, -(-total // bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = df.select(mark.alias("mark"), F.pmod(mark, F.lit(buckets)).alias("bucket"), F.lit(0).alias("part"),
                     record_size(F.col(text)).alias("size"), F.struct("*").alias("record"))
    counts = _per_bucket(rows)
    overfull = counts.where((F.col("bytes") > OVERFULL * bucket_bytes) & (F.col("n") > 1))
    if overfull.isEmpty():
        return rows, counts
    parts = overfull.select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    drawn = F.floor(F.rand(seed) * F.coalesce("parts", F.lit(1))).cast("int")
    rows = write_checkpoint(rows.drop("part").join(parts, "bucket", "left").withColumn("part", drawn).drop("parts"))
    return rows, _per_bucket(rows)


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 2025, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record`` (all columns of the input) and ``place``, its number from 0 in the shuffled order."""
    total = df.agg(F.sum(record_size(F.col(text)))).first()[0] or 0
    rows, counts = scatter(df, key, text, seed, bucket_bytes, total)
    ends = ordered_scan(counts.withColumn("all", F.lit(0)), ["all"], F.floor(F.col("bucket") / 4096), ["bucket", "part"], sums={"end": F.col("n")})
    starts = ends.select("bucket", "part", (F.col("end") - F.col("n")).alias("start"))
    held = rows.join(starts.hint("shuffle_hash"), ["bucket", "part"]).groupBy("bucket", "part", "start").agg(
        F.collect_list(F.struct("mark", "size", "record")).alias("held"))
    # One order of buckets in a task and of records in a bucket, so that a task run again draws the same.
    def order(a: Column, b: Column) -> Column:
        return (F.when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1)
                .when(a["size"] < b["size"], -1).when(a["size"] > b["size"], 1).otherwise(0))

    fixed = held.select("bucket", "part", "start", F.array_sort("held", order).alias("held")).sortWithinPartitions("bucket", "part")
    drawn = fixed.select("start", F.shuffle("held", F.lit(seed)).alias("held"))
    return drawn.select("start", F.posexplode("held").alias("at", "x")).select(
        F.col("x")["record"].alias("record"), (F.col("start") + F.col("at")).alias("place"))


def into_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 2025,
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record``, ``shard`` and ``slot``: shard counts differ by one at most, slots run from 0."""
    n = df.count()
    first = lambda s: F.ceil(s * F.lit(n) / F.lit(shards)).cast("long")
    rows = shuffled(df, key, text, seed, bucket_bytes)
    shard = F.expr(f"cast(place * {shards} div {max(n, 1)} as int)")
    return rows.withColumn("shard", shard).select("record", "shard", (F.col("place") - first(F.col("shard").cast("long"))).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write the records by shard, in slot order, over ``files`` tasks of near equal size."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").select(
        "record.*", "shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
