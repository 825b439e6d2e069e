"""Segmentation, classification, batches and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.scale import cut_lineage
from ..operators import segmentation as g
from .registry import Views, lines_sql, query, title_sql
from .text_queries import LEGIBILITY_SQL, MARK_CTE, SCORE_SQL

_LAWYER = r"(?i)\bparloir\b|cabinet\s+de\s+ma[îi]tre|\btoque\b|[àa]\s+faire\s*:|notes?\s+d[''’]entretien|\bhonoraires\b"
_PV = r"(?i)PROC[ÈE]S[- ]?VERBAL|\bNous,\s"
_SHEET = r"(?i)\b(?:Feuillet|Page)\s*(?:n[°o]\s*)?(\d{1,3})\s*/\s*(\d{1,3})\b"
ISLANDS_CTE = rf"""o_f AS (SELECT *, {lines_sql('texte')} AS ls,
  regexp_matches(texte, '{_LAWYER}') AND NOT regexp_matches(substr(texte, 1, 600), '{_PV}') AS avocat FROM cf_pages),
o_t AS (SELECT *, list_filter(list_transform(list_filter(ls[1:15] || ls[greatest(1, len(ls) - 3):], lambda l: regexp_matches(l, '{_SHEET}')),
    lambda l: CAST(regexp_extract(l, '{_SHEET}', 1) AS INT)), lambda a: a > 0)[1] AS feuillet,
  len(list_filter(list_filter(list_transform(string_split(texte, chr(10))[1:12], lambda l: trim(l)),
    lambda l: l <> '' AND NOT (length(l) < 12 AND NOT regexp_matches(replace(l, 'COTE', ''), '[A-Za-zÀ-ÿ]{{3,}}')))[1:3], lambda l: {title_sql('l')})) > 0 AS titre FROM o_f),
o_o AS (SELECT *, CASE WHEN lag(fichier_source) OVER w IS NULL OR lag(fichier_source) OVER w <> fichier_source OR avocat THEN TRUE
  WHEN lag(avocat) OVER w THEN TRUE WHEN feuillet IS NOT NULL THEN feuillet = 1 ELSE titre END AS ouvre
  FROM o_t WINDOW w AS (PARTITION BY dossier_id ORDER BY numero_global)),
o_p AS (SELECT *, CAST(sum(CAST(ouvre AS INT)) OVER (PARTITION BY dossier_id ORDER BY numero_global ROWS UNBOUNDED PRECEDING) AS INT) AS piece_id FROM o_o)"""


def segmented(d: Views):
    return g.attach_pieces(d.pages, g.segment(d.pages))


@query("piece_segmentation", views=("pages",), ctes=ISLANDS_CTE, sql="""
SELECT dossier_id, piece_id, CAST(min(numero_global) AS INT) AS page_debut, CAST(max(numero_global) AS INT) AS page_fin FROM o_p GROUP BY ALL""")
def piece_segmentation(d):
    return g.piece_bounds(g.segment(d.pages))


_META = r"(?i)^(N°\s|N°$|FEUILLET\b|DATE\b|HEURE\b|PROCÉDURE\b|[A-Za-zÀ-ÿ°''\s]{1,30}:\s*\S)"
_STRONG = (r"^\s*(?:BORDEREAU|INVENTAIRE|PROC[ÈE]S[- ]VERBAL\s+D|ORDONNANCE|R[ÉE]QUISITOIRE|CERTIFICAT|AUTORISATION|RAPPORT)"
           r"[^a-z]{4,}$")
_RULES = " ".join(
    "WHEN " + " AND ".join("contains(m, '" + w.replace("'", "''") + "')" for w in words) + " THEN '" + kind.replace("'", "''") + "'"
    for words, kind in v.REGLES_TYPE)
# Head of a page: the titles before the first line that neither is a title nor may be skipped.
TYPES_CTE = rf"""o_h AS (SELECT dossier_id, piece_id, texte, list_transform(ls, lambda l: {title_sql('l')}) AS ts, ls FROM o_p WHERE ouvre),
o_h1 AS (SELECT *, coalesce(list_position(ts, TRUE), 99) AS premier FROM o_h),
o_h2 AS (SELECT *, CASE WHEN premier > 7 THEN 0 ELSE list_filter(list_transform(ls, lambda l, i:
    CASE WHEN i > premier AND NOT ts[i] AND NOT (regexp_matches(l, '{_META}') AND premier - 1
      + len(list_filter(list_transform(ls[premier + 1:i], lambda z, j: NOT ts[premier + j]), lambda q: q)) <= 6) THEN i END), lambda i: i IS NOT NULL)[1] END AS arret FROM o_h1),
o_h3 AS (SELECT *, array_to_string(list_filter(list_transform(ls, lambda l, i: CASE WHEN ts[i] AND i < coalesce(arret, 999) THEN l END), lambda l: l IS NOT NULL), ' ')
  || ' ' || array_to_string(list_filter(ls[1:15], lambda l: regexp_matches(l, '{_STRONG}')), ' ') AS intitule FROM o_h2),
o_a AS (SELECT dossier_id, piece_id, min(numero_global) AS page_debut, max(numero_global) AS page_fin,
  bool_or(regexp_matches(texte, '{_LAWYER}')) AND NOT regexp_matches(arg_min(substr(texte, 1, 600), numero_global), '{_PV}') AS avocat FROM o_p GROUP BY ALL),
o_types AS (SELECT a.dossier_id, a.piece_id, CAST(page_debut AS INT) AS page_debut, CAST(page_fin AS INT) AS page_fin,
  CASE WHEN avocat THEN 'Document de l''avocat (hors procédure)' ELSE (SELECT CASE {_RULES} ELSE 'Non identifié' END
    FROM (SELECT replace(strip_accents(upper(intitule)), '’', '''') AS m)) END AS type FROM o_a a JOIN o_h3 h USING (dossier_id, piece_id))"""


@query("piece_type_rules", views=("pages",), ctes=ISLANDS_CTE + ",\n" + TYPES_CTE, sql="""
SELECT *, CASE WHEN type = 'Non identifié' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confiance,
  CASE WHEN type = 'Non identifié' THEN 'a_relire' ELSE 'ok' END AS statut_revision FROM o_types""")
def piece_type_rules(d):
    return g.segment_and_classify(d.pages).drop("intitule")


@query("type_proposals", views=("pieces",), sql="""
, o_c AS (SELECT dossier_id, piece_id, type, CAST(confiance AS DOUBLE) AS confiance, CASE WHEN CAST(substr(dossier_id, 13, 1) AS INT) % 3 = 0 THEN 'Facture' WHEN CAST(substr(dossier_id, 13, 1) AS INT) % 3 = 1 THEN 'Roman' END AS propose FROM cf_pieces)
SELECT dossier_id, piece_id, CASE WHEN type = 'Non identifié' AND propose = 'Facture' THEN 'Facture' ELSE type END AS type,
  CASE WHEN type = 'Non identifié' AND propose = 'Facture' THEN 0.9 ELSE confiance END AS confiance,
  CASE WHEN type = 'Non identifié' AND propose = 'Facture' THEN 'ok' WHEN type = 'Non identifié' OR confiance < 0.7 THEN 'a_relire' ELSE 'ok' END AS statut_revision FROM o_c""")
def type_proposals(d):
    digit = F.substring("dossier_id", 13, 1).cast("int") % 3
    proposals = d.pieces.select(
        "dossier_id", "piece_id", F.when(digit == 0, "Facture").when(digit == 1, "Roman").alias("type"), F.lit(0.9).alias("confiance"))
    return g.accept_types(d.pieces, proposals).select("dossier_id", "piece_id", "type", F.col("confiance").cast("double").alias("confiance"), "statut_revision")


@query("piece_attributes")
def piece_attributes(d):
    return g.piece_attributes(segmented(d))


@query("consecutive_ranges", views=("pages",), sql=f"""
, o_w AS (SELECT dossier_id, numero_global AS page, {LEGIBILITY_SQL} AS ws FROM cf_pages),
o_i AS (SELECT dossier_id, page, page - row_number() OVER (PARTITION BY dossier_id ORDER BY page) AS i FROM o_w WHERE ({SCORE_SQL}) >= 0.35)
SELECT dossier_id, CAST(min(page) AS INT) AS debut, CAST(max(page) AS INT) AS fin FROM o_i GROUP BY dossier_id, i""")
def consecutive_ranges(d):
    from ..operators.extraction import legibility

    # The ranges read their pages several times: these are scored once.
    poor = legibility(d.pages).filter("illisible").select("dossier_id", F.col("numero_global").alias("page"))
    return g.consecutive_ranges(cut_lineage(poor))


@query("page_batches")
def page_batches(d):
    docs = d.documents.select("dossier_id", F.lit(1).alias("piece_id"), F.col("numero_global").cast("int").alias("numero_global"), "texte")
    return g.page_batches(docs)


@query("title_batches", views=("pieces",), sql="""
SELECT dossier_id, piece_id, CAST((row_number() OVER (PARTITION BY dossier_id ORDER BY page_debut) - 1) // 8 + 1 AS INT) AS lot FROM cf_pieces""")
def title_batches(d):
    return g.title_batches(d.pieces).select("dossier_id", "piece_id", "lot")


@query("piece_index", views=("pieces",), sql="""
, o_x AS (SELECT *, try_strptime(date_apparente || ' ' || coalesce(heure_apparente, '00h00'), '%d/%m/%Y %Hh%M') AS t FROM cf_pieces)
SELECT dossier_id, piece_id, CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY page_debut) AS INT) AS ordre_pages,
  CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY t NULLS LAST, page_debut) AS INT) AS ordre_chronologique FROM o_x""")
def piece_index(d):
    return g.piece_index(d.pieces).select("dossier_id", "piece_id", "ordre_pages", "ordre_chronologique")
