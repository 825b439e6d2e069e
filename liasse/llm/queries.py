"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (alignment, decontamination, line_dedup, near_dedup, perplexity, pieces, quality_rules, resampling, secret_scan, sharding, toxicity,
               url_filters, warc_revisits)
from .common import read, whole_text

# A vocabulary file of a public tokenizer; read by the driver, sent to the tasks.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS lines, length(t) AS chars, length(regexp_replace(t, '\p{Lu}', '', 'g')) AS low
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.3 * n_words
  OR (chars - low) > 0.3 * chars OR n_dup_lines > 0.4 * lines OR NOT word_chars / greatest(n_words, 1) BETWEEN 3 AND 12) AS kept FROM b
"""


@_query("op9_quality_rules", QUALITY_SQL)
def _quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_figures(read(spark, folder, "documents"))


@_query("op4_sharding")
def _sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``rows``: shard counts are at most one apart."""
    sharded = sharding.into_shards(read(spark, folder, "documents"), 16)
    text = whole_text(F.col("record")["text"])
    return sharded.select(
        F.col("record")["doc_id"].alias("doc_id"), sharding.record_size(text).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


WARC_SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u,
  md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n FROM pages),
c AS (SELECT page_id, digest, n, regexp_extract(u, '^[^?]*', 0, 's') AS p,
  list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM b),
p AS (SELECT page_id, digest, n, '"' || substr(digest, 1, 16) || '"' AS tag,
  regexp_replace(regexp_replace(lower(regexp_extract(p, '^[^/]*', 0, 's')), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(p, '^[^/]*(.*)$', 1, 's'), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM c),
v AS (SELECT page_id, url, 10 * page_id + 5 + 10 * (7919 * page_id % 997) AS "at", CASE WHEN page_id % 7 <> 0 THEN tag END AS tag FROM p),
r AS (SELECT page_id, url, 10 * page_id AS "at", tag, digest, n FROM p),
j AS (SELECT v.page_id, v.url, v."at", v.tag, r.page_id AS response_id, r."at" AS response_at, r.tag AS rtag, r.digest, r.n
  FROM v ASOF LEFT JOIN r ON v.url = r.url AND v."at" > r."at")
SELECT page_id AS record_id, url AS canonical_url, "at", response_id, response_at,
  CASE WHEN response_id IS NULL THEN 'missing' WHEN tag IS NULL THEN 'unverified' WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN response_id IS NOT NULL AND coalesce(tag = rtag, true) THEN 'cache-control=max-age=60;content-length=' || n || ';content-type=text/html;date=t' || "at" || ';etag=' || rtag END AS headers,
  CASE WHEN response_id IS NOT NULL AND coalesce(tag = rtag, true) THEN digest END AS digest FROM j
"""


@_query("op3_warc_revisits", WARC_SQL)
def _warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.page_captures(read(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(lines, ";"))


@_query("op7_url_filters")
def _url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge_urls(read(spark, folder, "pages"))


@_query("op5_sentencepiece")
def _sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text, and whether decoding gives the text back."""
    model = pieces.load(PIECES)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, model, round_trip="round_trip")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", "round_trip")


@_query("op6_decontamination")
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each benchmark item that a document holds."""
    found = decontamination.passages(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.drop("key")


LINES_SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, s, unnest(range(len(s))) AS p FROM s WHERE text IS NOT NULL),
m AS (SELECT doc_id, p, s[p + 1] AS x, len(list_filter(string_split_regex(s[p + 1], '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM m),
r AS (SELECT a.doc_id, a.p, min(b.p) AS q FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.e - a.e + a.w >= 50 GROUP BY ALL),
k AS (SELECT r.doc_id, r.p, r.q, string_agg(c.x, chr(10) ORDER BY c.p) AS t FROM r JOIN c ON c.doc_id = r.doc_id AND c.p BETWEEN r.p AND r.q GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT DISTINCT c.doc_id, c.p FROM f JOIN c ON c.doc_id = f.doc_id AND c.p BETWEEN f.p AND f.q WHERE n > 1),
d AS (SELECT c.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY c.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.p = g.p GROUP BY ALL)
SELECT s.doc_id, d.text, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed FROM s LEFT JOIN d USING (doc_id)
"""


@_query("op8_line_dedup", LINES_SQL)
def _line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, folder, "documents"))
    return found.select(F.col("row")["doc_id"].alias("doc_id"), "text", "n_lines", "n_removed")


@_query("op2_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


@_query("op10_perplexity")
def _perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))


@_query("op1_near_dedup")
def _near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents")).drop("a", "b")


@_query("op11_token_alignment")
def _token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs, vocabularies = read(spark, folder, "documents").select("doc_id", "text"), alignment.load(BYTES, PIECES)
    return alignment.aligned(docs, vocabularies, alignment.count_links(docs, vocabularies)).drop("text")


@_query("op12_secret_scan")
def _secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(read(spark, folder, "documents"))


RESAMPLING_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 4) r(k))),
wanted AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM aims, range(1, 4) r(k))),
bits(v, n, c) AS (SELECT v, 0, v FROM range(256) r(v) UNION ALL SELECT v, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE n < 8),
crc AS MATERIALIZED (SELECT v, c FROM bits WHERE n = 8),
grams AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM runs UNION SELECT f FROM wanted)),
step(f, x, p, c) AS (SELECT f, x, 1, 4294967295::BIGINT FROM grams
  UNION ALL SELECT f, x, p + 2, xor(s.c >> 8, t.c) FROM step s JOIN crc t ON t.v = xor(s.c & 255, ('0x' || substr(x, p, 2))::BIGINT) WHERE p < length(x)),
hashed AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS b FROM step WHERE p > length(x)),
source AS (SELECT b, count(*) AS s FROM runs JOIN hashed USING (f) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY b),
gains AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM source)::DOUBLE + 10000) /
  ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM target), 0)::DOUBLE + 10000))))::BIGINT AS g
  FROM range(10000) r(b) LEFT JOIN source USING (b) LEFT JOIN target USING (b)),
weights AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS w FROM runs JOIN hashed USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT words.doc_id, len(words.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weights.w, 0)::BIGINT AS weight,
  coalesce(weights.w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || words.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM drawn) * 5 // 100 THEN rank END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""


@_query("op13_resampling", RESAMPLING_SQL)
def _resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
