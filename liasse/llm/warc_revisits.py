"""Revisit records of a web archive resolved to the response they stand for.

A server that answers "not modified" sends no body; the archive then holds a
revisit record.  It is resolved by an as-of join: the latest full response of
the same canonical URL that is strictly earlier.  The validators of both are
compared, and the headers that a 304 may renew are merged into the response's.

Records: ``record_id, url, at, kind`` (``response`` or ``revisit``), ``etag``,
``last_modified``, ``digest``, ``headers`` (map of lower-case names).

Status: ``resolved`` when at least one validator is on both sides and all of
those agree, ``mismatch`` when one disagrees, ``unverified`` when none can be
compared, ``missing`` without an earlier response.  Null or empty URLs and null
times are ``missing``.  Of responses at one instant the largest ``record_id``
counts as the latest.  Repeated revisits are resolved one by one.  Only the
named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import ordered_scan

# The header fields that a 304 response renews (RFC 9110, section 15.4.5), and the date fields that go with them.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BLOCK_SECONDS = 40_960


def canonical_url(url: Column) -> Column:
    """Host (lower case, no ``www.``, no port 80 or 443) with path and the sorted query that is left without tracking."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"(?s)^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"(?s)^([^/]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"(?s)^[^/]*(.*)$", 1), r"/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def status(revisit: Column, response: Column) -> Column:
    agree = [_tag(revisit["etag"]) == _tag(response["etag"])]
    agree += [revisit[c] == response[c] for c in ("last_modified", "digest")]
    return (F.when(response.isNull(), "missing").when(F.coalesce(F.least(*agree), F.lit(True)) == F.lit(False), "mismatch")
            .when(F.coalesce(*agree).isNull(), "unverified").otherwise("resolved"))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those that a 304 may renew taken from the revisit."""
    empty = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce(revisit, empty), lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(response, empty), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(kept, fresh)


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, at, response_id, response_at, status, headers, digest``.

    Each URL's records are scanned in blocks of time, so a URL that holds a large
    part of all records is not one task; only block totals are scanned per URL.
    """
    full = F.col("kind") == "response"
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"), full.cast("int").alias("full"),
        F.struct("etag", "last_modified", "digest", "headers").alias("own"))
    usable = (F.col("canonical_url") != "") & F.col("at").isNotNull()
    response = F.when(F.col("full") == 1, F.struct("record_id", "at", "own"))
    seen = ordered_scan(rows.where(usable), ["canonical_url"], F.floor(F.col("at") / block_seconds), ["at", "full", "record_id"], lasts={"latest": response})
    lost = rows.where(~F.coalesce(usable, F.lit(False)))
    asked = seen.unionByName(lost, allowMissingColumns=True).where("full = 0")
    own, latest = F.col("own"), F.col("latest")
    found = asked.withColumn("status", status(own, latest["own"]))
    good = F.col("status").isin("resolved", "unverified")
    return found.select(
        "record_id", "canonical_url", "at", latest["record_id"].alias("response_id"), latest["at"].alias("response_at"), "status",
        F.when(good, merged_headers(latest["own"]["headers"], own["headers"])).alias("headers"),
        F.when(good, F.coalesce(latest["own"]["digest"], own["digest"])).alias("digest"))


def attach_bodies(resolved: DataFrame, bodies: DataFrame, record_id: str = "record_id", body: str = "body") -> DataFrame:
    """The resolved revisits with the body of their response; null where there is none."""
    held = bodies.select(F.col(record_id).alias("response_id"), F.col(body).alias("body"))
    return resolved.join(held, "response_id", "left")


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records for a table of pages: each page's response, and one later revisit of it.

    A page is captured at ten times its number.  Its revisit comes after a
    while that its number decides; others may have changed the URL meanwhile,
    and one revisit in seven bears no validator.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    response = p.select(
        F.col("page_id").alias("record_id"), "url", (10 * F.col("page_id")).alias("at"), F.lit("response").alias("kind"), tag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n").cast("string"), F.lit("etag"), tag,
                     F.lit("date"), F.concat(F.lit("t"), 10 * F.col("page_id"))).alias("headers"))
    later = 10 * F.col("page_id") + 5 + 10 * F.pmod(7919 * F.col("page_id"), F.lit(997))
    bare = F.pmod("page_id", F.lit(7)) == 0
    revisit = p.select(
        F.col("page_id").alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"),
        F.when(~bare, F.concat(F.lit("W/"), tag)).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("date"), F.concat(F.lit("t"), later), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    return response.unionByName(revisit)
