"""Documents cleaned in stages; each stage works on all rows its predecessor kept.

Nulls, empty texts, ties and repeated rows are handled as the operators state.
Stages but the last return the columns of their input; the last adds the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from liasse.llm import decontamination, line_dedup, near_dedup, pieces, quality_rules
from liasse.llm.common import read

# A vocabulary file of a public tokenizer; read by the driver, sent to the tasks.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Texts whose shingle sets have so much in common are near-duplicates; op1's query has a limit of its own.
NEAR_PERCENT = 80


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_rules(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are later copies of a run; a document of which no word is left goes.

    ``n_chars``, where there is one, becomes the length of the new text.
    """
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    cut = F.col("n_removed") > 0
    columns = [F.when(cut, F.col("text")).otherwise(F.col("row.text")).alias("text") if c == "text"
               else F.when(cut, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col("row")[c].alias(c) for c in docs.columns]
    return left.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return near_dedup.kept_documents(docs, percent=NEAR_PERCENT)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.drop_contaminated(docs, decontamination.passages(docs, read(spark, sf_dir, "benchmark")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts and the number of them."""
    return pieces.encode(docs, pieces.load(PIECES)).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [("quality_rules", drop_low_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_benchmark_passages), ("sentencepiece", encode_pieces)]
ORACLE_SQL = None  # piece ids are not for SQL; a test runs plain Python versions of all stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
