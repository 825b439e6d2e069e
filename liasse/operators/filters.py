"""Filters and joins between pages, pieces, acts and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as v
from ..functions.scale import BLOCK
from .extraction import legibility_score


def page_ids_of_pieces(pieces: DataFrame, *columns: str) -> DataFrame:
    """One row per page of each piece: the interval as an equi-join key.

    Long intervals are cut in blocks first, so no array grows with a piece.
    """
    blocks = pieces.select(
        "dossier_id", *columns, "page_debut", "page_fin",
        F.explode(F.sequence(F.floor(F.col("page_debut") / BLOCK), F.floor(F.col("page_fin") / BLOCK))).alias("__b"),
    )
    low = F.greatest(F.col("page_debut").cast("long"), F.col("__b") * BLOCK)
    high = F.least(F.col("page_fin").cast("long"), F.col("__b") * BLOCK + BLOCK - 1)
    return blocks.select("dossier_id", *columns, F.explode(F.sequence(low, high)).alias("numero_global")).withColumn(
        "numero_global", F.col("numero_global").cast("int"))


def route_ocr(meta: DataFrame) -> DataFrame:
    """Pages to recognise: hardly any text, or a scanned page with little text."""
    n = F.length(F.regexp_replace("texte_natif", r"(?U)\s+", ""))
    return meta.filter(
        (n < v.SEUIL_OCR)
        | ((n < v.SEUIL_OCR_IMAGE) & (F.col("couverture_image") >= v.COUVERTURE_SCAN) & ~F.col("texte_invisible"))
    )


def procedure_pages(pages: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pages outside inventories and lawyer's documents."""
    outside = page_ids_of_pieces(pieces.filter(F.col("type").isin(*v.TYPES_HORS_PROCEDURE)))
    return pages.join(outside, ["dossier_id", "numero_global"], "left_anti")


def procedure_rows(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows read from pages (``numero_global``) without those of inventories and lawyer's documents.

    An anti-join would be laid under the reading of the texts, which would then run in the few
    tasks that a join of mere keys gets; this join stays above it.
    """
    key = ["dossier_id", "numero_global"]
    outside = page_ids_of_pieces(pieces.filter(F.col("type").isin(*v.TYPES_HORS_PROCEDURE))).distinct()
    return rows.join(outside.withColumn("__hors", F.lit(True)), key, "left").filter("__hors IS NULL").select(*rows.columns)


def eligible_pieces(pieces: DataFrame, purpose: str) -> DataFrame:
    """Pieces read for facts, acts or statements."""
    if purpose == "faits":
        return pieces.filter(~F.col("type").isin(*v.TYPES_SANS_FAITS))
    if purpose == "actes":
        return pieces.filter(~F.col("type").isin(*v.TYPES_SANS_ACTES))
    if purpose == "declarations":
        return pieces.filter(F.col("type").isin(*v.TYPES_AUDITION, v.TYPE_CONFRONTATION))
    raise ValueError(f"unknown purpose {purpose!r}")


def review_queue(pieces: DataFrame, threshold: float = v.SEUIL_CONFIANCE) -> DataFrame:
    return pieces.filter((F.col("confiance") < threshold) | (F.col("type") == v.NON_IDENTIFIE))


def page_source_map(pages: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each page with its file, reference mark, piece type and legibility."""
    of_piece = page_ids_of_pieces(pieces, "cote", "type")
    return pages.join(of_piece, ["dossier_id", "numero_global"], "left").select(
        "dossier_id", F.col("numero_global").alias("page"), "fichier_source", "page_fichier",
        F.coalesce("cote", "cote_detectee").alias("cote"), F.col("type").alias("type_piece"),
        (legibility_score(F.col("texte")) >= v.SEUIL_ILLISIBILITE).alias("illisible"),
    )


def acts_with_person(acts: DataFrame, persons: DataFrame, how: str = "left") -> DataFrame:
    """Verified acts with the name of their person."""
    names = persons.select("dossier_id", "personne_id", "nom", "est_client")
    return acts.filter(F.col("statut_verif") == "verifie").join(names, ["dossier_id", "personne_id"], how)
