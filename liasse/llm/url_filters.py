"""URL filters: listed rules first, then naive Bayes over the words of host and path.

Names in hosts are often several words run together.  A unigram Viterbi cuts
each distinct name into the words that make it likeliest; the counts of its
parts come from a join with the words of all pages, so no vocabulary is held in
one place.  A multinomial naive Bayes model, trained on the URLs of the table,
then judges the words of host and path.

Training has no labels to start from but a short list of words that sell or
track (``UNWANTED``): URLs whose host holds such a word, alone or inside a name,
are the positive class.  The model carries that over to the words they share.

Null and empty URLs and those without ``://`` have an empty host and path, fit
no rule and are allowed.  Repeated rows are judged one by one and alike.  Names
longer than 63 characters, more than a host label may have, stay whole.  Only
the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import write_checkpoint

# Word list of the positive class; a parameter of the functions below.
UNWANTED = ("ads", "adult", "banner", "bet", "bets", "betting", "casino", "cheap", "escort", "farm", "free", "jackpot", "lottery", "pharma", "pharmacy",
            "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "win", "xxx")
# Of those, the ones that are enough by themselves.
PLAIN = ("ads", "adult", "bets", "betting", "casino", "escort", "jackpot", "lottery", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "tracking", "viagra", "xxx")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_NAME = 63
LONGEST_WORD = 24
SEED_COUNT = 50  # pseudo-count of each listed word among the unigrams
SALTS = 16


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; at equal length a block goes first."""
    rule, says = F, F
    for action, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, says = rule.when(fits, F.lit(domain + start)), says.when(fits, F.lit(action))
    return (rule, says) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def names(host: Column, path: Column) -> Column:
    """The runs of letters of host and path, in order."""
    both = F.lower(F.concat_ws("/", host, path))
    return F.filter(F.split(both, r"[^\p{L}]+"), lambda w: w != "")


def word_counts(pages: DataFrame, html: str | None, words: Sequence[str] = UNWANTED) -> DataFrame:
    """How often each word stands in the visible text of all pages; listed words have a pseudo-count."""
    listed_words = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in words], "word string, n long")
    if html is None:
        return listed_words
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    found = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, LONGEST_WORD))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(listed_words).groupBy("word").agg(F.sum("n").alias("n"))


@F.pandas_udf(ArrayType(StringType()))
def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Viterbi over one name: parts are (start, length, count), letters outside any word cost as a rare one."""
    def cut(name: str, parts, total: float) -> list[str]:
        best = [0.0] + [-math.inf] * len(name)
        back = [0] * (len(name) + 1)
        ending: dict[int, list[tuple[int, float]]] = {}
        for part in parts:
            ending.setdefault(part["i"] + part["k"], []).append((part["i"], math.log(part["n"] / total)))
        single = math.log(0.1 / total)
        for end in range(1, len(name) + 1):
            for start, score in [*ending.get(end, ()), (end - 1, single)]:
                if best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]

    for name, parts, total in batches:
        yield pd.Series([cut(a, b, c) for a, b, c in zip(name, parts, total)], dtype=object)


def _salted(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left join of many rows with a table that has each value once; a common value is spread over ``SALTS`` parts."""
    spread = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [column, "salt"], "left").drop("salt")


def segment(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``name`` and its ``words`` for each distinct name of ``found``."""
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 1.0
    distinct = found.select("name").distinct()
    short = distinct.where(F.length("name").between(2, LONGEST_NAME))
    starts = short.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("s"))
    longest = F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("s") + 1)
    parts = starts.select("name", "s", F.explode(F.sequence(F.lit(1), longest)).alias("k")).select(
        "name", (F.col("s") - 1).alias("i"), "k", F.expr("substring(name, s, k)").alias("word"))
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("i", "k", "n")).alias("parts"))
    done = known.select("name", _cut("name", "parts", F.lit(total)).alias("words"))
    return distinct.join(done, "name", "left").select("name", F.coalesce("words", F.array("name")).alias("words"))


def url_words(pages: DataFrame, counts: DataFrame, plain: Sequence[str] = PLAIN) -> DataFrame:
    """Each distinct (host, path) with its number of rows, its words and whether its host holds a plainly unwanted one."""
    urls = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"))
    parts = [urls.select("host", "path", F.explode(names(F.col(c), F.lit(None))).alias("name"), F.lit(c == "host").alias("of_host")) for c in ("host", "path")]
    found = parts[0].unionByName(parts[1])
    cut = _salted(found, segment(found, counts), "name").select("host", "path", "of_host", F.explode("words").alias("word"))
    held = cut.groupBy("host", "path").agg(
        F.collect_list("word").alias("words"), F.max(F.col("of_host") & F.col("word").isin(*plain)).alias("unwanted"))
    return urls.join(held, ["host", "path"]).where(F.size("words") > 0)


def word_ratios(urls: DataFrame) -> tuple[DataFrame, float]:
    """log P(word | unwanted) - log P(word | other) with add-one smoothing, and the log ratio of the classes."""
    each = urls.select(F.explode("words").alias("word"), F.when(F.col("unwanted"), F.col("rows")).otherwise(0).alias("bad"),
                       F.when(F.col("unwanted"), 0).otherwise(F.col("rows")).alias("good"))
    counts = each.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = counts.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    bad, good, kinds = [x or 0 for x in sums]
    n = urls.agg(F.sum(F.when(F.col("unwanted"), F.col("rows"))), F.sum(F.when(~F.col("unwanted"), F.col("rows")))).first()
    ratio = F.log((F.col("bad") + 1) / F.lit(bad + kinds + 1.0)) - F.log((F.col("good") + 1) / F.lit(good + kinds + 1.0))
    return counts.select("word", ratio.alias("ratio")), math.log(((n[0] or 0) + 1) / ((n[1] or 0) + 1))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html",
               rules: Sequence[tuple[str, str, str]] = RULES, unwanted: Sequence[str] = UNWANTED, plain: Sequence[str] = PLAIN) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``score``, the log odds of the model (null where there are no words)."""
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    urls = write_checkpoint(url_words(rows, word_counts(pages, html, unwanted), plain))
    ratios, prior = word_ratios(urls)
    words = urls.select("host", "path", F.explode("words").alias("word"))
    scores = _salted(words, ratios, "word").groupBy("host", "path").agg((F.sum("ratio") + F.lit(prior)).alias("score"))
    rule, says = listed(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.join(scores, ["host", "path"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "score")
