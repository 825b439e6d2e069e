"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character from the ``ORDER - 1`` before it.  Its counts
are those of all trusted texts; each n-gram of any document is valued once, by
joins of counts on n-grams, their contexts and their endings, level by level, so
that no table has to fit in one place.  The values then go back to the documents:
sent to all executors while there are at most ``MOST_SENT`` of them, else joined
with the n-grams of each block of documents.

A document is kept when its perplexity is at most a quantile of the trusted
documents' perplexities in its language; a language without ``LEAST_TRUSTED``
trusted documents (null included) takes the quantile over all languages.  From
``LEAST_TRUSTED`` documents on, the largest perplexity lies above the quantile,
so one mislabelled document sets no threshold.

A null text counts as empty; an empty one has no perplexity (null) and is kept.
Repeated rows are judged one by one and alike.  Without trusted text the model
knows nothing, there are no thresholds, and all documents are kept.  Texts are
read whole; only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import whole_text, write_checkpoint

ORDER = 4
QUANTILE = 0.99
LEAST_TRUSTED = 100  # of fewer, that quantile is the largest
MOST_SENT = 8_000_000
BLOCK_CHARS = 8_000_000
DOCS_AT_ONCE = 512
GRAMS_HELD = 2_000_000  # distinct n-grams a task counts before it passes them on
START = "\u0002"  # stands before the first character of a text


def _codes(texts: list[str | None], order: int) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts end to end, each after ``order - 1`` starts; where n-grams start, and each text's number of them."""
    clean = [(t or "").replace(START, " ") for t in texts]
    whole = START * (order - 1) + (START * (order - 1)).join(clean)
    counts = np.array([len(t) for t in clean], np.int64)
    starts = np.cumsum(counts + order - 1) - counts - (order - 1)
    return whole, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum()), counts


def _hashes(whole: str, at: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at these places."""
    letters = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(letters) - order + 1, 0), np.uint64)
    for d in range(order):
        h = (h ^ letters[d:d + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h[at].view(np.int64)


class _Counted:
    """Distinct n-grams of a task so far: sorted hashes, their strings and their counts in trusted rows."""

    def __init__(self) -> None:
        self.keys, self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, texts: list[str | None], trusted: np.ndarray, order: int) -> None:
        whole, at, counts = _codes(texts, order)
        h = _hashes(whole, at, order)
        known = np.repeat(trusted, counts)
        distinct, n = np.unique(h[known], return_counts=True)
        fresh = np.setdiff1d(np.unique(h[~known]), distinct, assume_unique=True)
        keys, n = np.concatenate([distinct, fresh]), np.concatenate([n, np.zeros(len(fresh), np.int64)])
        place = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        if len(self.keys):
            old = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        self.n[place[old]] += n[old]
        keys, n = keys[~old], n[~old]
        if len(keys):
            # Where the new ones stand: a last writer for each of many slots; what loses its slot is looked for alone.
            slots = np.full(1 << 22, -1, np.int64)
            slots[h.view(np.uint64) >> np.uint64(42)] = np.arange(len(h))
            found = slots[keys.view(np.uint64) >> np.uint64(42)]
            lost = np.flatnonzero(h[found] != keys)
            if len(lost):
                sure = np.flatnonzero(np.isin(h, keys[lost]))
                by = sure[np.argsort(h[sure], kind="stable")]
                found[lost] = by[np.searchsorted(h[by], keys[lost])]
            grams = np.array([whole[i:i + order] for i in at[found].tolist()] + [None], object)[:-1]
            keys, grams, n = np.concatenate([self.keys, keys]), np.concatenate([self.grams, grams]), np.concatenate([self.n, n])
            by = np.argsort(keys)
            self.keys, self.grams, self.n = keys[by], grams[by], n[by]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.grams.tolist(), pa.string()), pa.array(self.keys), pa.array(self.n)], names=["gram", "hash", "n"])


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, hash, n``: every n-gram of ``text`` with its count in rows that are ``trusted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counted()
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                seen.add(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), order)
                if len(seen.keys) > GRAMS_HELD:
                    yield seen.batch()
                    seen = _Counted()
        yield seen.batch()

    found = docs.select(whole_text(F.col("text")).alias("text"), F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(run, "gram string, hash long, n long")
    return found.groupBy("gram", "hash").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified discounts for counts of 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) for k in (1, 2, 3))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def gram_values(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``hash, value``: log2 probability of each n-gram's last character after the others.

    ``grams`` holds all n-grams to be valued, those with ``n`` = 0 too.  Levels
    go from single characters up; a level's counts are those of the text at the
    top, and below it the number of different characters before the n-gram.
    """
    last = lambda c, k: F.substring(c, order - k + 1, k)  # noqa: E731  the last k characters of an n-gram
    levels = {order: grams.select("gram", "n")}
    for k in range(order - 1, 0, -1):
        above = levels[k + 1]
        levels[k] = above.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"))
    value = None
    for k in range(1, order + 1):
        counts = levels[k] if k in (1, order) else write_checkpoint(levels[k])
        d = _discounts(counts)
        if k == 1:
            total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
            total, kinds = total or 0, kinds or 0
            taken = counts.agg(F.sum(_discount(F.col("n"), d))).first()[0] or 0.0
            even = F.lit(1.0 / (kinds + 1))
            p = even if not total else (F.col("n") - _discount(F.col("n"), d)) / F.lit(float(total)) + F.lit(taken / total) * even
            value = write_checkpoint(counts.select("gram", p.alias("p")))
            continue
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("taken"))
        below = value.select(F.col("gram").alias("ending"), F.col("p").alias("lower"))
        joined = counts.select("gram", "n", context, F.substring("gram", 2, k - 1).alias("ending")).join(sums, "context").join(below, "ending")
        p = F.when(F.col("total") > 0, (F.col("n") - _discount(F.col("n"), d)) / F.col("total") + F.col("taken") / F.col("total") * F.col("lower")).otherwise(F.col("lower"))
        value = joined.select("gram", p.alias("p"))
        if k < order:
            value = write_checkpoint(value)
    return grams.select("gram", "hash").join(value, "gram").select("hash", F.log2("p").alias("value"))


class _Values:
    """A table of hashes with their values, for look-ups of many that are all in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, used = np.zeros(1 << bits, np.int64), np.zeros(1 << bits), np.zeros(1 << bits, bool)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            slot, first = np.unique(place[left], return_index=True)
            free = ~used[slot]
            won = left[first[free]]
            self.keys[slot[free]], self.values[slot[free]], used[slot[free]] = keys[won], values[won], True
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        out = self.values[place]
        wrong = np.flatnonzero(self.keys[place] != keys)
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & self.mask
            out[wrong] = self.values[place[wrong]]
            wrong = wrong[self.keys[place[wrong]] != keys[wrong]]
        return out


def _sums(texts: list[str | None], values: _Values, order: int) -> tuple[np.ndarray, np.ndarray]:
    whole, at, counts = _codes(texts, order)
    found = values.of(_hashes(whole, at, order))
    return counts, np.bincount(np.repeat(np.arange(len(counts)), counts), found, len(counts))


def perplexities(docs: DataFrame, values: DataFrame, order: int = ORDER, most_sent: int = MOST_SENT) -> DataFrame:
    """``row`` (the input's columns), ``chars`` and ``perplexity`` per character."""
    rows = docs.select(whole_text(F.col("text")).alias("text"), F.struct("*").alias("row"))
    names = ["row", "chars", "bits"]
    schema = StructType([rows.schema["row"], StructField("chars", LongType()), StructField("bits", DoubleType())])
    values = write_checkpoint(values)
    if values.count() <= most_sent:
        table = values.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((table["hash"].to_numpy(), table["value"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Values(*sent.value)
            for whole in batches:
                for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                    batch = whole.slice(start, DOCS_AT_ONCE)
                    counts, sums = _sums(batch.column(0).to_pylist(), known, order)
                    yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts), pa.array(sums)], names=names)

        found = rows.mapInArrow(run, schema)
    else:
        found = _by_blocks(rows, values, order, names, schema)
    n = F.greatest("chars", F.lit(1))
    return found.select("row", "chars", F.when(F.col("chars") > 0, F.pow(F.lit(2.0), -F.col("bits") / n)).alias("perplexity"))


def _by_blocks(rows: DataFrame, values: DataFrame, order: int, names: list[str], schema: StructType) -> DataFrame:
    """Each block of documents meets the values of its own n-grams only."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    placed = rows.withColumn("block", F.pmod(F.xxhash64("text", F.rand(7)), F.lit(max(1, -(-chars // BLOCK_CHARS)))).cast("long"))
    placed = write_checkpoint(placed)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at, counts = _codes(batch.column(0).to_pylist(), order)
            block = np.repeat(batch.column(1).to_numpy(), counts)
            pairs = np.unique(np.stack([block, _hashes(whole, at, order)]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["block", "hash"])

    asked = placed.select("text", "block").mapInArrow(grams, "block long, hash long").distinct().join(values, "hash")

    def run(key, docs: pa.Table, known: pa.Table) -> pa.Table:
        counts, sums = _sums(docs["text"].to_pylist(), _Values(known["hash"].to_numpy(), known["value"].to_numpy()), order)
        return pa.Table.from_arrays([docs["row"], pa.array(counts), pa.array(sums)], names=names)

    return placed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = LEAST_TRUSTED) -> tuple[DataFrame, float | None]:
    """``lang, most`` from the trusted rows of ``scored`` (lang, trusted, perplexity), and the one over all languages."""
    trusted = scored.where(F.col("trusted") & F.col("perplexity").isNotNull())
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = trusted.groupBy("lang").agg(cut.alias("most"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("lang").isNotNull())
    return by_lang.select("lang", "most"), trusted.agg(cut).first()[0]


def trusted_by_label(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs`` with ``trusted``: labelled of good quality, and not of bad."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted")).where("trusted")
    if good.count() <= most_sent:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, lang, chars, perplexity, threshold, kept``."""
    rows = trusted_by_label(docs.select("doc_id", "text", "lang"), labels, most_sent)
    grams = write_checkpoint(gram_counts(rows, order))
    scored = perplexities(rows, gram_values(grams, order), order, most_sent).select(
        "row.doc_id", "row.lang", "row.trusted", "chars", "perplexity")
    scored = write_checkpoint(scored)
    by_lang, overall = thresholds(scored, quantile)
    out = scored.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", F.coalesce("most", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
