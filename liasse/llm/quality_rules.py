"""Quality rules as a short-circuit cascade, cheapest rejection first.

A rule is a condition under which a text is rejected.  A text is kept when no
rule rejects it, so the order changes only the cost: rules are measured on a
bounded sample and those with the most rejections per second go first.  The
cascade is one ``CASE WHEN``, whose later branches are not evaluated once an
earlier one holds.

Null and empty texts have no words and no lines; all their figures are 0.
Repeated rows are judged one by one and alike.  Other columns of the input pass
through untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, whole_text, words

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_SYMBOLS_PER_WORD = 0.3
MOST_UPPER_SHARE = 0.3
MOST_DUPLICATE_LINES = 0.4
WORD_LENGTHS = (3.0, 12.0)
SAMPLE_ROWS = 1000


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    whole = whole_text(text)
    return (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(whole_text(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return bind(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


# Repeated windows, in three steps over arrays of numbers.  A code holds the leading bits of a window's
# hash above its place, so that sorting the codes brings equal windows together; windows that agree in
# those bits are then compared by their whole hash.


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(h: Column, i: Column) -> Column:
    return F.xxhash64(h[i], h[i + 1], h[i + 2])


def _place_bits(h: Column) -> Column:
    return F.length(F.bin(F.size(h)))


def window_codes(h: Column, bits: Column) -> Column:
    """Sorted codes of all 3-word windows; ``h`` are the words' hashes."""
    starts = F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0)))
    return F.sort_array(F.transform(starts, lambda x, i: F.call_function(
        "shiftleft", F.xxhash64(x, h[i + 1], h[i + 2]), bits).bitwiseOR(i.cast("long"))))


def covered_words(h: Column, codes: Column, bits: Column) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included."""
    nexts = F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1)))
    alike = F.zip_with(codes, nexts, lambda a, b: F.when(F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0, F.array(a, b)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    places = F.array_distinct(F.transform(F.flatten(F.filter(alike, lambda x: x.isNotNull())), lambda x: x.bitwiseAND(mask).cast("int")))
    marked = F.sort_array(F.transform(places, lambda i: F.struct(_window(h, i).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p"))
    return F.aggregate(F.sort_array(F.transform(bind(marked, repeated), lambda x: x["i"])), start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first one included."""
    return bind(word_hashes(words(text)), lambda h: covered_words(h, window_codes(h, _place_bits(h)), _place_bits(h)))


def upper_share(text: Column) -> Column:
    whole = whole_text(text)
    return (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}", ""))) / F.greatest(F.length(whole), F.lit(1))


class Figures:
    """The figures of a text by name: columns that are there already, or else their expressions."""

    _made = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
             "n_lines": lambda t: F.size(lines_with_words(t)), "upper_share": upper_share}

    def __init__(self, text: Column, **ready: Column) -> None:
        self.text, self.ready = text, ready

    def __getitem__(self, name: str) -> Column:
        return self.ready[name] if name in self.ready else self._made[name](self.text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Figures], Column]  # null counts as no


SHORT = Rule("short", lambda f: f["n_words"] < LEAST_WORDS)
REPEATS = Rule("repeats", lambda f: 100 * f["n_repeat_words"] > MOST_REPEATED_PERCENT * f["n_words"])
EXTRA_RULES = (
    Rule("symbols", lambda f: f["n_symbols"] > MOST_SYMBOLS_PER_WORD * f["n_words"]),
    Rule("upper", lambda f: f["upper_share"] > MOST_UPPER_SHARE),
    Rule("duplicate_lines", lambda f: f["n_dup_lines"] > MOST_DUPLICATE_LINES * f["n_lines"]),
    Rule("word_length", lambda f: ~(f["word_chars"] / F.greatest(f["n_words"], F.lit(1))).between(*WORD_LENGTHS)),
)
ALL_RULES = (SHORT, REPEATS, *EXTRA_RULES)


def ordered_rules(df: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on at most ``sample_rows`` rows.

    The sample decides the order only; without rows the given order stays.
    """
    sample = df.select(F.col(text).alias("t")).limit(sample_rows).persist()
    try:
        rates = sample.select(*[F.avg(r.rejects(Figures(F.col("t"))).cast("int")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
        seconds = []
        for rule in rules:
            start = time.perf_counter()
            sample.agg(F.count(F.when(rule.rejects(Figures(F.col("t"))), 1))).first()
            seconds.append(time.perf_counter() - start)
    finally:
        sample.unpersist()
    gain = [-(rates[i] or 0.0) / max(s, 1e-6) for i, s in enumerate(seconds)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (gain[i], i))]


def rejected_by(rules: list[Rule], figures: Figures) -> Column:
    """The first rule, in this order, that rejects the text; null when none does."""
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.rejects(figures), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = ALL_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their columns as they were."""
    return df.where(rejected_by(ordered_rules(df, rules, text, sample_rows), Figures(F.col(text))).isNull())


def quality_figures(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The figures of each row, ``base_failed`` and the verdict of the cascade."""
    t, h, bits = F.col("t"), F.col("h"), F.col("bits")
    order = ordered_rules(df, EXTRA_RULES, text, sample_rows)
    # Each step is a projection of its own: arrays that a later one reads many times are computed once.
    rows = df.select(F.col(doc_id).alias("doc_id"), whole_text(F.col(text)).alias("t")).withColumn("w", words(t))
    rows = rows.select("doc_id", "t", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                       n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), F.size(lines_with_words(t)).alias("n_lines"), word_hashes(F.col("w")).alias("h"))
    rows = rows.withColumn("bits", _place_bits(h)).withColumn("codes", window_codes(h, bits))
    figures = rows.withColumn("n_repeat_words", covered_words(h, F.col("codes"), bits))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    known = Figures(t, **{c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")})
    return figures.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(rejected_by(order, known).isNull()).alias("kept"))
