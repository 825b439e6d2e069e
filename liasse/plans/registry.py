"""Registered queries: a Spark plan per operator, and its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.casefiles import view, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Blanks as the JVM's Unicode classes see them, for SQL regular expressions.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Views:
    """The case-file views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @property
    def page_keys(self) -> DataFrame:
        """The pages without their texts."""
        return view(self.spark, self.folder, "cf_pages", texts=False)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, f"cf_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


def query(name: str, *, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = "", recursive: bool = False):
    """Register ``fn(views) -> DataFrame``; ``sql`` reads ``views`` and ``ctes``."""
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            head = with_clause(*[f"cf_{x}" for x in views]) if views else ""
            if ctes:
                head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
            if recursive:
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[name] = f"{head}\n{sql}"
        return fn
    return register


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def lines_sql(c: str) -> str:
    split = rf"string_split_regex({c}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"list_filter(list_transform({split}, lambda x: {strip_sql('x')}), lambda x: x <> '')"


def norm_sql(c: str) -> str:
    folded = f"regexp_replace(translate({c}, '’‘', chr(39) || chr(39)), '{WS}+', ' ', 'g')"
    return f"lower({strip_sql(folded)})"


TITLE_CHARS = r"[A-ZÀ-Ÿ0-9°''’«»()/\-–—\s.,]"


def title_sql(line: str) -> str:
    bare = strip_sql(f"regexp_replace({line}, '^[_|~•*·`¦]+|[_|~•*·`¦]+$', '', 'g')")
    bare = strip_sql(rf"regexp_replace({bare}, '(?i)\s+(Feuillet\b.*|Date\s*:.*|Heure\b.*|N°\s*\S*\s*:.*)$', '')")
    return rf"regexp_full_match({bare}, '{TITLE_CHARS}{{8,}}')"
