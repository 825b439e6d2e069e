"""Documents that hold passages of a benchmark, found by spaced-seed hashing.

A mask ignores some positions of a run of tokens; the hash of the others stays
the same when an ignored token is changed.  The masks' hashes of all benchmark
runs are joined with those of all document runs.  A hit lines the item up with
the document; the tokens around it are compared one by one, and the passage
counts when a stretch of ``WINDOW`` tokens (the whole item if it is shorter)
agrees but for ``SUBSTITUTED`` of them.

The masks lose nothing: any such stretch of 8 to 20 tokens with that many
substitutions leaves some mask untouched (a test tries all ways).  Items under
``LEAST_TOKENS`` tokens are no evidence and are not searched.

Tokens are runs of letters and digits, in lower case.  Null and empty texts have
none.  Rows that agree in id and text are one document; equal items are reported
each, items with one id (null included) at the best place of any.  The benchmark goes to the executors in blocks of at most ``BLOCK_SEEDS``
hashes, each a broadcast of bounded size, however many items there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, whole_text, write_checkpoint

MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 6))
WINDOW = 20
SUBSTITUTED = 0.15  # of the window, rounded down
LEAST_TOKENS = 8
BLOCK_SEEDS = 2_000_000
MOST_FLAGGED = 2_000_000  # keys sent to the executors; above, rows are shuffled


def token_hashes(text: Column) -> Column:
    tokens = F.filter(F.split(F.lower(whole_text(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def _seeds(h: Column, i: Column) -> Column:
    """The hash of each mask laid at ``i``; null where it would reach past the end."""
    return F.array(*[F.when(i + max(m) < F.size(h), F.xxhash64(F.lit(n), *[h[i + d] for d in m])) for n, m in enumerate(MASKS)])


def _each_seed(rows: DataFrame, *kept: str) -> DataFrame:
    """A row per position and mask.  The hashes are made after the explode, where they are compiled code."""
    last = F.size("h") - min(max(m) for m in MASKS) - 1
    placed = rows.where(last >= 0).select(*kept, "h", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return placed.select(*kept, "h", "i", F.explode(_seeds(F.col("h"), F.col("i"))).alias("seed")).where(F.col("seed").isNotNull())


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(text)).alias("h")).distinct()
    return items.where(F.size("h") >= LEAST_TOKENS)


def agreeing(item: Column, piece: Column, skipped: Column) -> Column:
    """Most agreeing tokens in a window of the item; ``piece`` starts ``skipped`` tokens into it."""
    same = F.transform(item, lambda x, j: F.when((j >= skipped) & (F.get(piece, j - skipped) == x), 1).otherwise(0))
    width = F.least(F.lit(WINDOW), F.size(item))
    return F.array_max(bind(same, lambda each: F.transform(
        F.sequence(F.lit(1), F.size(item) - width + 1), lambda s: F.aggregate(F.slice(each, s, width), F.lit(0), lambda a, x: a + x))))


def passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, key, item_id, start, agreeing, item_tokens``: each item that a document holds, at its best place.

    ``start`` is the token of the document at which the item's first token would stand.
    """
    items = items_of(benchmark, item_id, item_text)
    seeds = items.agg(F.sum(F.size("h"))).first()[0] or 0
    blocks = max(1, -(-seeds * len(MASKS) // BLOCK_SEEDS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), token_hashes(F.col(text)).alias("h"))
    found = [_hits(rows, items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", F.lit(3)), F.lit(blocks)) == b)) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, found)
    width = F.least(F.lit(WINDOW), F.col("item_tokens"))
    good = hits.where(F.col("agreeing") >= width - F.floor(width * SUBSTITUTED))
    best = good.groupBy("key", "item_id").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.struct("agreeing", (-F.col("diagonal")).alias("back"))).alias("best"), F.first("item_tokens").alias("item_tokens"))
    return best.select("doc_id", "key", "item_id", (-F.col("best")["back"]).alias("start"), F.col("best")["agreeing"].alias("agreeing"), "item_tokens")


def _hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    planted = _each_seed(items, "item_id").select("seed", "item_id", F.col("i").alias("j"), F.size("h").alias("item_tokens")).distinct()
    diagonal = (F.col("i") - F.col("j")).alias("diagonal")
    lined = _each_seed(rows, "doc_id", "key").join(F.broadcast(planted), "seed").select("doc_id", "key", "h", "item_id", "item_tokens", diagonal)
    start = F.greatest(F.col("diagonal"), F.lit(0))
    piece = F.slice("h", start + 1, F.greatest(F.lit(0), F.col("diagonal") + F.col("item_tokens") - start))
    once = lined.select("doc_id", "key", "item_id", "item_tokens", "diagonal", piece.alias("piece")).groupBy(
        "key", "item_id", "item_tokens", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("piece").alias("piece"))
    tokens = F.broadcast(items.select(F.col("item_id").alias("of"), F.col("h").alias("item")))
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    return once.join(tokens, F.col("item_id").eqNullSafe(F.col("of"))).where(F.size("item") == F.col("item_tokens")).select(
        "doc_id", "key", "item_id", "item_tokens", "diagonal", agreeing(F.col("item"), F.col("piece"), skipped).alias("agreeing"))


def drop_contaminated(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any of the passages ``found`` in them."""
    flagged = write_checkpoint(found.select("key").distinct())  # the search runs once
    if flagged.count() <= MOST_FLAGGED:
        flagged = F.broadcast(flagged)
    return docs.join(flagged, row_key(F.col(doc_id), F.col(text)) == flagged["key"], "left_anti")
