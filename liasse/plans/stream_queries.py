"""Streams over tables that stand still: everything that has arrived is taken, then they stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import scratch_folder
from ..operators.verification import verify
from ..schemas import PAGES
from ..sources.pages import conform
from ..streaming.ingest import ingest_stream
from .registry import norm_sql, query, strip_sql

# Each document is a page: twenty to a file, twenty files to a case.  They arrive three
# times: the first half of every file, then two files of three, then all, so most are sent again.
ARRIVALS = ("doc_id % 20 < 10", "doc_id % 60 < 40", "true")


@query("stream_page_ingest", views=("documents",), sql=f"""
, o_p AS (SELECT 'D' || (numero_global // 400) AS dossier_id, 'f' || lpad(CAST(numero_global % 400 // 20 AS VARCHAR), 2, '0') || '.pdf' AS fichier_source, numero_global % 20 + 1 AS page_fichier,
  texte, CASE WHEN numero_global % 20 < 10 THEN 1 WHEN numero_global % 60 < 40 THEN 2 ELSE 3 END AS envoi FROM cf_documents),
o_n AS (SELECT *, row_number() OVER (PARTITION BY dossier_id ORDER BY envoi, fichier_source, page_fichier) AS numero_global FROM o_p),
o_q AS (SELECT *, CASE WHEN numero_global % 3 = 0 THEN 'Texte inventé' ELSE substr(texte, 1, 60) END AS citation FROM o_n)
SELECT dossier_id, fichier_source, CAST(page_fichier AS INT) AS page_fichier, CAST(numero_global AS INT) AS numero_global, sha256({strip_sql('texte')}) AS empreinte_sha256,
  CASE WHEN {norm_sql('citation')} <> '' AND contains({norm_sql('texte')}, {norm_sql('citation')}) THEN 'exacte' ELSE 'rejetee' END AS methode_verif FROM o_q""")
def stream_page_ingest(d):
    root, spark = scratch_folder(d.spark, "ingest"), d.spark
    docs = d.table("documents")
    n = F.col("doc_id")
    pages = docs.select(
        n, F.concat(F.lit("D"), F.floor(n / 400)).alias("dossier_id"), F.concat(F.lit("f"), F.lpad(F.floor(n % 400 / 20).cast("string"), 2, "0"), F.lit(".pdf")).alias("fichier_source"),
        (n % 20 + 1).cast("int").alias("page_fichier"), F.col("text").alias("texte"))
    for arrival in ARRIVALS:
        conform(pages.where(arrival), PAGES).write.mode("append").parquet(f"{root}/in")
        ingest_stream(spark, f"{root}/in", f"{root}/pages", None, f"{root}/out", f"{root}/state").awaitTermination()
    landed = spark.read.parquet(f"{root}/pages")
    quotes = landed.select("dossier_id", F.col("numero_global").alias("page"), F.when(F.col("numero_global") % 3 == 0, F.lit("Texte inventé")).otherwise(
        F.substring("texte", 1, 60)).alias("citation"))
    found = verify(quotes, landed).select("dossier_id", F.col("page").alias("numero_global"), "methode_verif")
    return landed.join(found, ["dossier_id", "numero_global"]).select("dossier_id", "fichier_source", "page_fichier", "numero_global", "empreinte_sha256", "methode_verif")
