"""Toxicity by two Kneser-Ney word models, one of toxic and one of ordinary texts.

A text's log likelihood under either model, divided by its number of words,
makes a difference that a logistic curve turns into a score from 0 to 1.

Both models are interpolated bigram models: discounted bigram counts of the
class, then discounted continuation counts of the class, then continuation
counts that the classes share.  An expression counts once per document.  Words
of under ``LEAST_COUNT`` training documents, and expressions whose documents
divide among the classes as chance would have it (G under ``LEAST_G``), have only
the shared counts, in either class alike, so they say nothing.

Counts cover all training texts.  The curve's two numbers are fitted on at most
``CURVE_ROWS`` labelled rows (by the hash of their id; one in ten of the training
rows), which the counts leave out.  A table of at most ``MOST_SENT`` entries is
sent to the executors; larger ones are joined by word instead.

A null text counts as empty; an empty one has difference 0.  Several labels of
one id count as toxic if one says so; null labels and ids are no labels.
Repeated rows are scored one by one and alike.  Without labels of both classes
all differences are 0 and the score is 0.5.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import whole_text, write_checkpoint

LEAST_COUNT = 5  # documents
LEAST_G = 20.0
CURVE_ROWS = 20_000
MOST_SENT = 8_000_000
WORDS_KEPT = 500_000  # words a task remembers; affects speed only
THRESHOLD = 0.7


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def _tokens(texts: list[str | None], seen: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and each text's number of words."""
    split = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    return np.fromiter((seen[w] for s in split for w in s), np.int64, int(counts.sum())), counts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def for_curve(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(10)) == 0


def training(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows that are not held out."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    if kept.count() <= most_sent:
        kept = F.broadcast(kept)
    return docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(kept, "doc_id")


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))


def _per_class(keys: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each distinct key with its number of toxic and of ordinary documents."""
    order = np.lexsort((doc, *keys[::-1]))
    keys, doc = [k[order] for k in keys], doc[order]
    once = _edges(*keys, doc)
    keys, bad = [k[once] for k in keys], toxic[doc[once]].astype(np.int64)
    edge = _edges(*keys)
    n = np.diff(np.append(edge, len(bad)))
    n_bad = np.add.reduceat(bad, edge) if len(edge) else n
    return [np.ascontiguousarray(k[edge]) for k in keys], n_bad, n - n_bad


def _counted(texts: DataFrame, keys_of, packed: bool) -> DataFrame:
    """``first, second, n``: in how many documents of either class each pair of keys stands.

    ``n`` holds the toxic ones in its upper half.  Packed keys share ``first``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for batch in batches:
            tokens, counts = _tokens(batch.column(0).to_pylist(), seen)
            keys, at = keys_of(tokens, counts)
            doc = np.repeat(np.arange(len(counts)), counts)[at]
            keys, bad, good = _per_class(keys, doc, batch.column(1).to_numpy(zero_copy_only=False) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, (bad << 32) + good)], names=[*names, "n"])

    names = ["first"] if packed else ["first", "second"]
    found = texts.select("text", "toxic").mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "n")))
    return found.groupBy(*names).agg(F.sum("n").alias("n"))


def _classes() -> list[Column]:
    return [F.shiftright("n", 32).alias("toxic"), F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("ordinary")]


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, toxic, ordinary``: the documents of either class with each word, by hash."""
    found = _counted(texts, lambda tokens, counts: ([tokens], np.arange(len(tokens))), True)
    return found.select(F.col("first").alias("word"), *_classes())


def pair_counts(texts: DataFrame, words: np.ndarray | None) -> DataFrame:
    """``first, second, toxic, ordinary``: the documents in which two words follow each other.

    With sorted ``words``, of these only and by their numbers, written compactly
    (``checkpoint``); else of all words and by hash.
    """
    sent = None if words is None else texts.sparkSession.sparkContext.broadcast(words)

    def pairs(tokens: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        start = np.zeros(len(tokens) + 1, bool)
        start[np.cumsum(counts) - counts] = True
        ok = ~start[1:-1]
        if sent is None:
            at = np.flatnonzero(ok)
            return [tokens[at], tokens[at + 1]], at
        number = _places(sent.value, tokens)
        at = np.flatnonzero(ok & (number[:-1] >= 0) & (number[1:] >= 0))
        return [(number[at] << 32) + number[at + 1]], at

    if sent is None:
        return _counted(texts, pairs, False).select("first", "second", *_classes())
    kept = write_checkpoint(_counted(texts, pairs, True))
    return kept.select(F.shiftright("first", 32).alias("first"), F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).alias("second"), *_classes())


def _places(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the values stand among sorted keys, -1 for absent ones."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


@dataclass
class Ratios:
    """``words``: word, ratio; ``pairs``: first, second, ratio (log, toxic over ordinary).  Others have ratio 0, or that of their second word."""

    words: DataFrame
    pairs: DataFrame
    size: int


def _discount(counts: DataFrame, column: str) -> float:
    one, two = counts.agg(F.count(F.when(F.col(column) == 1, 1)), F.count(F.when(F.col(column) == 2, 1))).first()
    return one / (one + 2 * two) if one and two else 0.5


def _telling(toxic: Column, ordinary: Column, share: float) -> Column:
    """Whether the classes differ beyond chance (the G-test against the toxic share of the documents)."""
    n = toxic + ordinary
    part = lambda k, s: F.when(k > 0, k * F.log(k / (n * s))).otherwise(F.lit(0.0))
    return 2 * (part(toxic, F.lit(share)) + part(ordinary, F.lit(1 - share))) >= LEAST_G


def fit(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> Ratios:
    """Log ratios of all words and pairs that tell the classes apart."""
    texts = training(docs, labels, most_sent).where(~for_curve(F.col("doc_id")))
    classes = ("toxic", "ordinary")
    bad, good = texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        none = docs.sparkSession.createDataFrame([], "first long, second long, ratio double")
        return Ratios(none.select(F.col("first").alias("word"), "ratio"), none, 0)
    share = bad / (bad + good)
    words = write_checkpoint(word_counts(texts).where(F.col("toxic") + F.col("ordinary") >= LEAST_COUNT))
    n_words = words.count()
    names = None
    if n_words <= most_sent:
        # Words go by their numbers, half as long as hashes, until the end.
        sent = np.sort(words.select("word").toArrow()["word"].to_numpy())
        names = docs.sparkSession.createDataFrame(pa.table({"word": np.arange(len(sent)), "hash": sent}))
        words = write_checkpoint(words.withColumnRenamed("word", "hash").join(names, "hash").drop("hash"))
        pairs = pair_counts(texts, sent)
    else:
        known = lambda c: words.select(F.col("word").alias(c))
        pairs = write_checkpoint(pair_counts(texts, None).join(known("first"), "first", "left_semi").join(known("second"), "second", "left_semi"))
    d = {c: _discount(pairs, c) for c in classes}
    ends = pairs.groupBy(F.col("second").alias("word")).agg(
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"n_{c}") for c in classes], F.count(F.lit(1)).alias("n_all"))
    begins = pairs.groupBy(F.col("first").alias("word")).agg(*[F.sum(c).alias(f"c_{c}") for c in classes], F.count(F.lit(1)).alias("k_all"))
    each = write_checkpoint(words.join(ends, "word", "left").join(begins, "word", "left").na.fill(0))
    sums = each.agg(F.sum("n_all"), F.count(F.lit(1)), *[F.sum(f"n_{c}") for c in classes], *[F.count(F.when(F.col(f"n_{c}") > 0, 1)) for c in classes]).first()
    everything, kinds = sums[0] or 0, sums[1]
    total, used = dict(zip(classes, sums[2:4])), dict(zip(classes, sums[4:6]))
    shared = (F.col("n_all") + 0.5) / F.lit(everything + 0.5 * (kinds + 1.0))

    def own(c: str) -> Column:
        """Continuation counts of the class over the shared ones; these alone for a word that tells nothing."""
        if not total[c]:
            return shared
        seen = F.greatest(F.col(f"n_{c}") - F.lit(d[c]), F.lit(0.0)) / F.lit(float(total[c]))
        return F.when(_telling(F.col("toxic"), F.col("ordinary"), share), seen + F.lit(d[c] * used[c] / total[c]) * shared).otherwise(shared)

    count = F.col("c_toxic") + F.col("c_ordinary")
    back = F.when(count > 0, F.lit((d["toxic"] + d["ordinary"]) / 2) * F.col("k_all") / count).otherwise(F.lit(1.0))  # shared by the classes
    table = write_checkpoint(each.select("word", *[own(c).alias(f"p_{c}") for c in classes], back.alias("back"), *[f"c_{c}" for c in classes]))
    telling = pairs.where(_telling(F.col("toxic"), F.col("ordinary"), share))
    joined = telling.join(table.select(F.col("word").alias("first"), "back", "c_toxic", "c_ordinary"), "first").join(
        table.select(F.col("word").alias("second"), "p_toxic", "p_ordinary"), "second")

    def pair(c: str) -> Column:
        seen = F.when(F.col(f"c_{c}") > 0, F.greatest(F.col(c) - F.lit(d[c]), F.lit(0.0)) / F.col(f"c_{c}")).otherwise(F.lit(0.0))
        return seen + F.col("back") * F.col(f"p_{c}")

    of_pairs = write_checkpoint(joined.select("first", "second", (F.log(pair("toxic")) - F.log(pair("ordinary"))).alias("ratio")))
    of_words = table.select("word", (F.log("p_toxic") - F.log("p_ordinary")).alias("ratio")).where("ratio <> 0")
    if names is not None:
        of_words = of_words.join(names, "word").select(F.col("hash").alias("word"), "ratio")
        for c in ("first", "second"):
            of_pairs = of_pairs.join(names.select(F.col("word").alias(c), "hash"), c).drop(c).withColumnRenamed("hash", c)
    return Ratios(of_words, of_pairs, max(n_words, of_pairs.count()))


def differences(docs: DataFrame, ratios: Ratios, most_sent: int = MOST_SENT) -> DataFrame:
    """``row`` (the input's columns), ``n_words`` and ``difference``, the mean log ratio of a word."""
    if ratios.size > most_sent:
        return _differences_by_joins(docs, ratios)
    w, p = ratios.words.toArrow(), ratios.pairs.toArrow()
    ends = [p[c].to_numpy() for c in ("first", "second")]
    # Words of any ratio, and those of pairs, numbered; pairs by the numbers of their words.
    word = np.unique(np.concatenate([w["word"].to_numpy(), *ends]))
    own = np.zeros(len(word), np.float32)
    own[_places(word, w["word"].to_numpy())] = w["ratio"].to_numpy()
    key = _places(word, ends[0]) * len(word) + _places(word, ends[1])
    order = np.argsort(key)
    sent = docs.sparkSession.sparkContext.broadcast((word, own, key[order], p["ratio"].to_numpy()[order].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, keys, ratio = sent.value
        seen = Hashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                tokens, counts = _tokens(batch.column(0).to_pylist(), seen)
                at = _places(words, tokens)
                value = np.zeros(len(at), np.float32)
                known = np.flatnonzero(at >= 0)
                value[known] = own[at[known]]
                first = np.zeros(len(at) + 1, bool)
                first[np.cumsum(counts) - counts] = True
                after = known[(known > 0) & ~first[:-1][known]]
                after = after[at[after - 1] >= 0]
                place = _places(keys, at[after - 1] * len(words) + at[after])
                value[after[place >= 0]] = ratio[place[place >= 0]]
                sums = np.bincount(np.repeat(np.arange(len(counts)), counts), value, len(counts))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts), pa.array(sums / np.maximum(counts, 1))],
                                                 names=[*batch.schema.names[1:], "n_words", "difference"])

    rows = docs.select(whole_text(F.col("text")).alias("text"), F.struct("*").alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("difference", DoubleType())]))


def _differences_by_joins(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """The same by joins on words, for tables too large to send."""
    key = [F.xxhash64(whole_text(F.col("text"))).alias("a"), F.xxhash64(F.lit(1), whole_text(F.col("text"))).alias("b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                tokens, counts = _tokens(batch.column(0).to_pylist(), seen)
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                before = np.append(-1, tokens[:-1]) if len(tokens) else tokens
                before[(np.cumsum(counts) - counts)[counts > 0]] = -1
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(before), pa.array(tokens)],
                                                 names=["a", "b", "first", "second"])

    texts = docs.select(whole_text(F.col("text")).alias("text"), *key).dropDuplicates(["a", "b"])
    pairs = texts.mapInArrow(run, "a long, b long, first long, second long").groupBy("a", "b", "first", "second").agg(F.count(F.lit(1)).alias("n"))
    valued = pairs.join(ratios.pairs, ["first", "second"], "left").join(
        ratios.words.select(F.col("word").alias("second"), F.col("ratio").alias("own")), "second", "left")
    value = F.coalesce("ratio", "own", F.lit(0.0))
    sums = valued.groupBy("a", "b").agg(F.sum(F.col("n") * value).alias("s"), F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return docs.select(F.struct("*").alias("row"), *key).join(sums, ["a", "b"], "left").select(
        "row", n.alias("n_words"), F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("difference"))


def curve(differences: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with a light penalty on the slope."""
    if len(set(toxic.tolist())) < 2:
        return 1.0, 0.0
    scale = float(np.std(differences)) or 1.0
    x = np.column_stack([differences / scale, np.ones(len(differences))])
    w = np.zeros(2)
    penalty = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT, curve_rows: int = CURVE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, with ``n_words`` and ``difference``."""
    docs = docs.select("doc_id", "text")
    ratios = fit(docs, labels, most_sent)
    tried = training(docs, labels, most_sent).where(for_curve(F.col("doc_id")))
    sample = differences(tried.select("doc_id", "text", "toxic"), ratios, most_sent).select("difference", "row.toxic").limit(curve_rows).toArrow()
    a, b = curve(sample["difference"].to_numpy(), sample["toxic"].to_numpy().astype(float))
    found = differences(docs, ratios, most_sent).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "difference", held_out(F.col("row.doc_id")).alias("held_out"),
        (1 / (1 + F.exp(-(F.lit(a) * F.col("difference") + F.lit(b))))).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "difference")
