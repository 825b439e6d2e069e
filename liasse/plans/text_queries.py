"""Sources, filters and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab as v
from ..functions.dates import _cardinals
from ..operators import extraction as x, filters as f
from ..functions.scale import scratch_folder
from ..sources import pages as s, sinks
from .registry import WS, lines_sql, norm_sql, query, strip_sql, title_sql

# --- marks and fingerprints, reused by several SQL checks --------------------

_MARK = r"(?i)\bcote\b\s*(?:n[°ºo]\.?\s*)?[:.]?\s*([A-Za-z]?)\s*[.\-]?\s*(\d{1,6})(?:\s*/\s*(\d{1,4}))?(?:[^\d/]|$)"
_STAMP = r"^([A-DP])\s?[.\-]?\s?(\d{1,5})(?:\s?/\s?(\d{1,4}))?$"


def _mark_of(source: str, pattern: str) -> str:
    def group(n: int) -> str:
        return f"regexp_extract({source}, '{pattern}', {n})"
    return f"upper({group(1)}) || {group(2)} || CASE WHEN {group(3)} <> '' THEN '/' || {group(3)} ELSE '' END"


MARK_CTE = rf"""o_lines AS (SELECT *, {lines_sql('texte')} AS ls FROM cf_pages),
o_stamps AS (SELECT *, list_filter(ls[1:3] || ls[greatest(1, len(ls) - 2):], lambda y: regexp_matches(y, '{_STAMP}'))[1] AS stamp FROM o_lines),
o_marks AS (SELECT dossier_id, numero_global, CASE WHEN regexp_matches(texte, '{_MARK}') THEN {_mark_of('texte', _MARK)}
  WHEN stamp IS NOT NULL THEN {_mark_of('stamp', _STAMP)} END AS cote FROM o_stamps)"""


@query("pages_source", views=("pages",), ctes=MARK_CTE, sql=f"""
SELECT p.dossier_id, CAST(p.numero_global AS INT) AS numero_global, fichier_source, CAST(page_fichier AS INT) AS page_fichier, texte,
  ocr_applique, sha256({strip_sql('texte')}) AS empreinte_sha256, m.cote AS cote_detectee, 'ingere' AS statut
FROM cf_pages p JOIN o_marks m USING (dossier_id, numero_global)""")
def pages_source(d):
    return s.pages_with_marks(d.pages)


@query("page_numbering", views=("pages",), sql="""
SELECT dossier_id, fichier_source, CAST(page_fichier AS INT) AS page_fichier,
  CAST(9 + row_number() OVER (PARTITION BY dossier_id ORDER BY CASE fichier_source WHEN 'tome2.pdf' THEN 1 WHEN 'annexe17.pdf' THEN 2 ELSE 3 END, page_fichier) AS INT) AS numero_global
FROM cf_pages WHERE fichier_source <> 'tome1.pdf'""")
def page_numbering(d):
    pages = d.pages
    rank = F.when(F.col("fichier_source") == "tome2.pdf", 1).when(F.col("fichier_source") == "annexe17.pdf", 2).otherwise(3)
    new = pages.filter("fichier_source <> 'tome1.pdf'").select(
        "dossier_id", "fichier_source", "page_fichier", rank.alias("rang_fichier"))
    return s.number_pages(new, pages.filter("fichier_source = 'tome1.pdf'")).drop("rang_fichier")


@query("incremental_ingest", views=("pages",), sql="""
SELECT dossier_id, fichier_source, CAST(page_fichier AS INT) AS page_fichier FROM cf_pages b WHERE NOT EXISTS (
  SELECT 1 FROM cf_pages e WHERE e.ocr_applique AND e.dossier_id = b.dossier_id AND e.fichier_source = b.fichier_source)""")
def incremental_ingest(d):
    batch = d.pages.select("dossier_id", "fichier_source", "page_fichier")
    return s.new_files(batch, d.pages.filter("ocr_applique"))


@query("forced_ingest", views=("documents",), sql=f"""
, o_old AS (SELECT * FROM cf_documents WHERE numero_global % 3 <> 0),
o_batch AS (SELECT dossier_id, 'f' || (numero_global % 5) || '.pdf' AS fichier_source, numero_global AS page_fichier, texte FROM cf_documents WHERE numero_global % 7 < 3 AND length(dossier_id) % 2 = 0),
o_kept AS (SELECT dossier_id, 'ancien.pdf' AS fichier_source, numero_global AS page_fichier, row_number() OVER (PARTITION BY dossier_id ORDER BY numero_global) AS numero_global, texte
  FROM o_old WHERE dossier_id NOT IN (SELECT dossier_id FROM o_batch)),
o_new AS (SELECT dossier_id, fichier_source, page_fichier, row_number() OVER (PARTITION BY dossier_id ORDER BY fichier_source, page_fichier) AS numero_global, texte FROM o_batch)
SELECT dossier_id, fichier_source, CAST(page_fichier AS INT) AS page_fichier, CAST(numero_global AS INT) AS numero_global, sha256({strip_sql('texte')}) AS empreinte_sha256
FROM (SELECT * FROM o_kept UNION ALL SELECT * FROM o_new)""")
def forced_ingest(d):
    """A case given again as a whole replaces its old pages at the sink, also when the run is repeated."""
    pages, path = d.documents, scratch_folder(d.spark, "pages")
    old = s.number_pages(pages.where("numero_global % 3 <> 0").select(
        "dossier_id", F.lit("ancien.pdf").alias("fichier_source"), F.col("numero_global").cast("int").alias("page_fichier"), "texte", F.lit(1).alias("rang_fichier")),
        d.spark.createDataFrame([], "dossier_id string, numero_global int"))
    sinks.write_replacing(s.pages_with_marks(old), path, ["dossier_id"])
    batch = pages.where("numero_global % 7 < 3 AND length(dossier_id) % 2 = 0").select(
        "dossier_id", F.concat(F.lit("f"), F.col("numero_global") % 5, F.lit(".pdf")).alias("fichier_source"), F.col("numero_global").cast("int").alias("page_fichier"), "texte",
        (F.col("numero_global") % 5 + 1).alias("rang_fichier"))
    for _ in range(2):
        there = d.spark.read.parquet(path).drop(sinks.BUCKET)
        after = s.ingest_files(batch, there, force=True)
        sinks.write_replacing(after.join(batch.select("dossier_id").distinct(), "dossier_id", "left_semi"), path, ["dossier_id"])
    return d.spark.read.parquet(path).select("dossier_id", "fichier_source", "page_fichier", "numero_global", "empreinte_sha256")


@query("replaced_rows", views=("heartbeats",), sql="""
SELECT dossier_id, statut, arg_max({'m': mis_a_jour_le}, event_id)['m'] AS mis_a_jour_le, max(event_id) AS event_id,
  arg_max({'j': CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN event_id END}, event_id)['j'] AS jetons
FROM (SELECT *, count(*) FILTER (WHERE event_id % 2 = 1) OVER (PARTITION BY dossier_id, statut) AS n FROM cf_heartbeats)
WHERE n = 0 AND event_id % 2 = 0 OR event_id % 2 = 1 GROUP BY dossier_id, statut""")
def replaced_rows(d):
    """One row per case and status; a row that comes again replaces the old one, its nulls included."""
    rows = d.heartbeats.select("dossier_id", "statut", "mis_a_jour_le", "event_id")
    old = rows.filter("event_id % 2 = 0").groupBy("dossier_id", "statut").agg(F.max_by(F.struct("mis_a_jour_le", "event_id"), "event_id").alias("x")).select(
        "dossier_id", "statut", "x.*", F.lit(-1).cast("long").alias("jetons"))
    updates = rows.filter("event_id % 2 = 1").withColumn("jetons", F.when(F.expr("event_id % 5 <> 0"), F.col("event_id").cast("long")))
    found = s.replace_rows(old, updates, ["dossier_id", "statut"], "event_id")
    return found.withColumn("jetons", F.when(F.col("jetons") >= 0, F.col("jetons")))


@query("file_name_disambiguation", views=("files",), recursive=True, sql="""
, o_files AS (SELECT *, row_number() OVER (PARTITION BY dossier_id ORDER BY rang) AS i FROM cf_files),
o_steps AS (
  SELECT dossier_id, i, rang, nom, nom AS nom_final, [nom] AS taken FROM o_files WHERE i = 1
  UNION ALL
  SELECT f.dossier_id, f.i, f.rang, f.nom, c.nom_final, list_append(s.taken, c.nom_final) FROM o_steps s
  JOIN o_files f ON f.dossier_id = s.dossier_id AND f.i = s.i + 1,
  LATERAL (SELECT CASE WHEN NOT list_contains(s.taken, f.nom) THEN f.nom ELSE list_filter(
     list_transform(range(2, 20), lambda n: regexp_replace(f.nom, '^(.+?)(\\.[^.]*)?$', '\\1_' || CAST(n AS VARCHAR) || '\\2')),
     lambda n: NOT list_contains(s.taken, n))[1] END AS nom_final) c)
SELECT dossier_id, CAST(rang AS INT) AS rang, nom, nom_final FROM o_steps""")
def file_name_disambiguation(d):
    return s.disambiguate(d.files.select("dossier_id", "rang", "nom"))


@query("page_fingerprint", views=("documents",), sql=f"""
SELECT dossier_id, numero_global, sha256({strip_sql('texte')}) AS empreinte_sha256 FROM cf_documents""")
def page_fingerprint(d):
    return d.documents.select("dossier_id", "numero_global", s.fingerprint(F.col("texte")).alias("empreinte_sha256"))


@query("admission_limits", views=("files",), sql="""
, o_r AS (SELECT *, CASE WHEN taille_mo > 50 THEN 'fichier trop lourd' WHEN NOT lisible THEN 'fichier endommagé' WHEN protege THEN 'fichier protégé' END AS m FROM cf_files),
o_c AS (SELECT dossier_id, arg_min(m, rang) FILTER (WHERE m IS NOT NULL) AS m, arg_min(nom, rang) FILTER (WHERE m IS NOT NULL) AS fichier, sum(pages) AS total_pages FROM o_r GROUP BY dossier_id)
SELECT dossier_id, coalesce(m, CASE WHEN total_pages > 400 THEN 'trop de pages' END) IS NULL AS accepte,
  coalesce(m, CASE WHEN total_pages > 400 THEN 'trop de pages' END) AS motif, fichier, CAST(total_pages AS BIGINT) AS total_pages FROM o_c""")
def admission_limits(d):
    return s.admit(d.files)


@query("upsert_last_wins", views=("heartbeats",), sql="""
SELECT dossier_id, statut, arg_max(mis_a_jour_le, event_id) FILTER (WHERE mis_a_jour_le IS NOT NULL) AS mis_a_jour_le,
  max(event_id) AS event_id, arg_max(event_id, event_id) FILTER (WHERE event_id % 2 = 1 AND event_id % 5 <> 0) AS jetons
FROM cf_heartbeats GROUP BY dossier_id, statut""")
def upsert_last_wins(d):
    rows = d.heartbeats
    updates = rows.filter("event_id % 2 = 1").withColumn("jetons", F.when(F.expr("event_id % 5 <> 0"), F.col("event_id")))
    return s.upsert(rows.filter("event_id % 2 = 0"), updates, ["dossier_id", "statut"], "event_id")


@query("schema_upgrade", views=("persons",), sql="""
SELECT dossier_id, personne_id, nom, role, CASE WHEN personne_id IN ('P1', 'P2') THEN est_client ELSE FALSE END AS est_client FROM cf_persons""")
def schema_upgrade(d):
    from ..schemas import PERSONNES

    old = d.persons.filter("personne_id NOT IN ('P1', 'P2')").drop("est_client")
    new = d.persons.filter("personne_id IN ('P1', 'P2')")
    return s.conform(old.unionByName(new, allowMissingColumns=True), PERSONNES).drop("alias")


# --- filters and joins -------------------------------------------------------

@query("pages_to_ocr", views=("documents",), sql=rf"""
SELECT dossier_id, numero_global FROM (SELECT *, length(regexp_replace(texte, '{WS}+', '', 'g')) AS n FROM cf_documents)
WHERE n < 50 OR (n < 300 AND numero_global % 10 >= 6 AND numero_global % 4 <> 0)""")
def pages_to_ocr(d):
    meta = d.documents.select(
        "dossier_id", "numero_global", F.col("texte").alias("texte_natif"),
        (F.col("numero_global") % 10 / 10).alias("couverture_image"), (F.col("numero_global") % 4 == 0).alias("texte_invisible"))
    return f.route_ocr(meta).select("dossier_id", "numero_global")


@query("procedure_pages", views=("pages", "pieces"), sql="""
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global FROM cf_pages p WHERE NOT EXISTS (SELECT 1 FROM cf_pieces i WHERE i.dossier_id = p.dossier_id
  AND i.type IN ('Bordereau / inventaire des pièces', 'Document de l''avocat (hors procédure)') AND p.numero_global BETWEEN i.page_debut AND i.page_fin)""")
def procedure_pages(d):
    return f.procedure_pages(d.pages, d.pieces).select("dossier_id", "numero_global")


def _list(values) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in values)


@query("pieces_by_purpose", views=("pieces",), sql=f"""
SELECT 'faits' AS usage, dossier_id, piece_id FROM cf_pieces WHERE type NOT IN ({_list(v.TYPES_SANS_FAITS)})
UNION ALL SELECT 'actes', dossier_id, piece_id FROM cf_pieces WHERE type NOT IN ({_list(v.TYPES_SANS_ACTES)})
UNION ALL SELECT 'declarations', dossier_id, piece_id FROM cf_pieces WHERE type IN ({_list((*v.TYPES_AUDITION, v.TYPE_CONFRONTATION))})""")
def pieces_by_purpose(d):
    parts = [f.eligible_pieces(d.pieces, p).select(F.lit(p).alias("usage"), "dossier_id", "piece_id")
             for p in ("faits", "actes", "declarations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("review_queue", views=("pieces",), sql="""
SELECT dossier_id, piece_id, type, CAST(confiance AS DOUBLE) AS confiance FROM cf_pieces WHERE confiance < 0.7 OR type = 'Non identifié'""")
def review_queue(d):
    return f.review_queue(d.pieces).select("dossier_id", "piece_id", "type", F.col("confiance").cast("double").alias("confiance"))


_LETTERS = r"[A-ZÀ-ÖØ-Þa-zß-öø-ÿ]"
_UP, _LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
LEGIBILITY_SQL = rf"""list_filter(list_transform(string_split_regex({strip_sql('texte')}, '{WS}+'),
    lambda w: regexp_replace(w, '^[.,;:!?()«»"''—\-]+|[.,;:!?()«»"''—\-]+$', '', 'g')), lambda w: regexp_matches(w, '{_LETTERS}'))"""


def _share(test: str) -> str:
    return f"len(list_filter(ws, lambda w: {test})) / len(ws)"


SCORE_SQL = (
    "CASE WHEN len(ws) < 15 THEN 0.0 ELSE least(1.0, "
    + _share(f"regexp_matches(w, '{_LOW}{_UP}')") + " * 3 + "
    + _share(r"regexp_matches(w, '[#@&|~^\\*_}{\]\[<>¢£¤§±µ¶]')") + " * 5 + "
    + _share(f"length(regexp_replace(w, '[^A-ZÀ-ÖØ-Þa-zß-öø-ÿ]', '', 'g')) >= 3 AND NOT regexp_matches(w, '[{v.VOYELLES}]')") + " * 4 + "
    + _share(f"length(w) = 1 AND NOT regexp_matches(lower(w), '[{v.LETTRES_ISOLEES}]')") + " * 4 + "
    + _share(f"regexp_matches(w, '{_LETTERS}[0-9]+{_LETTERS}')") + " * 5 + "
    + _share(f"regexp_matches(regexp_replace(w, '(?i)nstr|nscr|bstr|bscr|rstr|ctr|ngtr|mpt|rchr', '', 'g'), '[{v.CONSONNES}]{{4}}')") + " * 4) END"
)


@query("page_source_map", views=("pages", "pieces"), ctes=MARK_CTE + f""",
o_w AS (SELECT dossier_id, numero_global, {LEGIBILITY_SQL} AS ws FROM cf_pages)""", sql=f"""
SELECT p.dossier_id, CAST(p.numero_global AS INT) AS page, p.fichier_source, CAST(p.page_fichier AS INT) AS page_fichier,
  coalesce(i.cote, m.cote) AS cote, i.type AS type_piece, ({SCORE_SQL}) >= 0.35 AS illisible
FROM cf_pages p JOIN o_marks m USING (dossier_id, numero_global) JOIN o_w w USING (dossier_id, numero_global)
LEFT JOIN cf_pieces i ON i.dossier_id = p.dossier_id AND p.numero_global BETWEEN i.page_debut AND i.page_fin""")
def page_source_map(d):
    return f.page_source_map(s.pages_with_marks(d.pages), d.pieces)


@query("acts_with_person", views=("acts", "persons"), sql="""
SELECT a.dossier_id, acte_id, a.personne_id, nature, nom, est_client FROM cf_acts a LEFT JOIN cf_persons p USING (dossier_id, personne_id)
WHERE a.statut_verif = 'verifie'""")
def acts_with_person(d):
    return f.acts_with_person(d.acts, d.persons).select("dossier_id", "acte_id", "personne_id", "nature", "nom", "est_client")


# --- extraction --------------------------------------------------------------

@query("ocr_hour_repair", views=("pages",), sql=r"""
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, CASE WHEN ocr_applique THEN regexp_replace(
  regexp_replace(texte, '(^|[^\p{L}\p{N}_])[€689Oo](\d)\s*h\s*(\d{2})($|[^\d])', '\10\2h\3\4', 'g'),
  '(^|[^\p{L}\p{N}_])([01]?\d|2[0-3])[Ff]([0-5]\d)($|[^\d])', '\1\2h\3\4', 'g') ELSE texte END AS texte FROM cf_pages""")
def ocr_hour_repair(d):
    return x.repair_hours(d.pages).select("dossier_id", "numero_global", "texte")


@query("fused_pages", views=("documents",), sql=rf"""
, o_p AS (SELECT *, CASE WHEN numero_global % 4 = 0 THEN '  ' ELSE substr(texte, 1, 12) END AS natif FROM cf_documents WHERE ocr_applique),
o_r AS (SELECT *, regexp_replace(regexp_replace(texte, '(^|[^\p{{L}}\p{{N}}_])[€689Oo](\d)\s*h\s*(\d{{2}})($|[^\d])', '\10\2h\3\4', 'g'),
  '(^|[^\p{{L}}\p{{N}}_])([01]?\d|2[0-3])[Ff]([0-5]\d)($|[^\d])', '\1\2h\3\4', 'g') AS relu FROM o_p)
SELECT dossier_id, numero_global, CASE WHEN {strip_sql('natif')} = '' THEN relu ELSE {strip_sql('natif')} || chr(10) || relu END AS texte FROM o_r""")
def fused_pages(d):
    """Recognised pages: the little native text they bore, then the recognised one with its hours repaired."""
    native = F.when(F.col("numero_global") % 4 == 0, F.lit("  ")).otherwise(F.substring("texte", 1, 12))
    return d.documents.filter("ocr_applique").select("dossier_id", "numero_global", x.fused_text(native, F.col("texte")).alias("texte"))


@query("cote_per_page", views=("pages",), ctes=MARK_CTE, sql="SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, cote FROM o_marks")
def cote_per_page(d):
    return x.cotes(d.pages)


@query("procedure_number", views=("pages",), sql=r"""
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, nullif(regexp_extract(texte, '(?i)N[°ºo]\s*PARQUET\s*([\d/]+)', 1), '') AS numero_procedure FROM cf_pages""")
def procedure_number(d):
    return x.procedure_numbers(d.pages)


_MONTHS = "[" + ", ".join(f"'{m}'" for m in v.MOIS) + "]"
_MONTH_NO = "[" + ", ".join(str(n) for n in v.MOIS.values()) + "]"
_DATE_SQL = v.DATE.replace("'", "''")


def date_sql(raw: str) -> str:
    day = rf"lpad(regexp_extract({raw}, '^(\d+)', 1), 2, '0')"
    return (
        rf"CASE WHEN {raw} LIKE '%/%' THEN {day} || '/' || lpad(split_part({raw}, '/', 2), 2, '0') || '/' || split_part({raw}, '/', 3) "
        rf"ELSE {day} || '/' || lpad(CAST(({_MONTH_NO})[list_position({_MONTHS}, lower(regexp_extract({raw}, '({v.NOMS_MOIS})', 1)))] AS VARCHAR), 2, '0') "
        rf"|| '/' || regexp_extract({raw}, '(\d{{4}})$', 1) END"
    )


@query("date_mentions", views=("pages",), sql=f"""
, o_m AS (SELECT dossier_id, numero_global, unnest(regexp_extract_all(texte, '(?i){_DATE_SQL}', 1)) AS b,
   generate_subscripts(regexp_extract_all(texte, '(?i){_DATE_SQL}', 1), 1) - 1 AS ordre FROM cf_pages)
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, CAST(ordre AS INT) AS ordre, {date_sql('b')} AS date FROM o_m""")
def date_mentions(d):
    return x.date_mentions(d.pages)


_CARD = _cardinals()
_NUMBER_WORDS = "|".join(sorted((w.replace("-", r"[\s-]+(?:et[\s-]+)?") for w in _CARD), key=len, reverse=True))
_LOOSE = (rf"(?i)\b(?:midi|minuit|(?:\d{{1,2}}|{_NUMBER_WORDS})\s*heures?"
          rf"(?:\s+(?:et\s+)?(?:demie?|\d{{1,2}}|{_NUMBER_WORDS})(?:\s*minutes?)?)?)\b")
_CARD_KEYS = "[" + ", ".join(f"'{w}'" for w in _CARD) + "]"
_CARD_VALUES = "[" + ", ".join(str(n) for n in _CARD.values()) + "]"


def _number_sql(c: str) -> str:
    key = rf"regexp_replace(regexp_replace(lower(trim({c})), '[\s-]+et[\s-]+', '-', 'g'), '[\s-]+', '-', 'g')"
    return rf"coalesce(try_cast({c} AS INT), CASE WHEN {key} IN ('demie', 'demi') THEN 30 END, ({_CARD_VALUES})[list_position({_CARD_KEYS}, {key})])"


@query("hour_mentions", views=("pages",), sql=rf"""
, o_c AS (SELECT dossier_id, numero_global, 'compacte' AS forme, unnest(regexp_extract_all(texte, '\d{{1,2}}\s*[hH]\s*\d{{2}}')) AS b,
   generate_subscripts(regexp_extract_all(texte, '\d{{1,2}}\s*[hH]\s*\d{{2}}'), 1) - 1 AS ordre FROM cf_pages),
o_l AS (SELECT dossier_id, numero_global, 'libre' AS forme, unnest(regexp_extract_all(texte, '{_LOOSE}')) AS b,
   generate_subscripts(regexp_extract_all(texte, '{_LOOSE}'), 1) - 1 AS ordre FROM cf_pages),
o_h AS (SELECT dossier_id, numero_global, forme, ordre, lpad(regexp_extract(b, '^(\d+)', 1), 2, '0') || 'h' || regexp_extract(b, '(\d\d)$', 1) AS heure FROM o_c
UNION ALL SELECT dossier_id, numero_global, forme, ordre, CASE lower(b) WHEN 'midi' THEN '12h00' WHEN 'minuit' THEN '00h00' ELSE
  CASE WHEN {_number_sql(r"regexp_extract(b, '(?i)^(.*?)\s*heures?', 1)")} <= 23 THEN
  lpad(CAST({_number_sql(r"regexp_extract(b, '(?i)^(.*?)\s*heures?', 1)")} AS VARCHAR), 2, '0') || 'h' ||
  lpad(CAST(CASE WHEN regexp_matches(b, '(?i)heures?$') THEN 0 ELSE {_number_sql(r"regexp_extract(b, '(?i)heures?\s+(?:et\s+)?(.*?)(?:\s*minutes?)?$', 1)")} END AS VARCHAR), 2, '0') END END FROM o_l)
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, forme, CAST(ordre AS INT) AS ordre, heure FROM o_h WHERE heure IS NOT NULL""")
def hour_mentions(d):
    return x.hour_mentions(d.pages)


@query("act_opening")
def act_opening(d):
    return x.act_openings(d.pages)


BODY_CTE = rf"""o_bl AS (SELECT *, {lines_sql('texte')} AS ls FROM cf_pages),
o_bk AS (SELECT dossier_id, numero_global, list_transform(ls, lambda l, i: CASE WHEN {title_sql('l')} OR contains(l, 'N° PARQUET')
   OR regexp_full_match(l, '(?i)cote\s*(?:n[°ºo]\.?\s*)?[:.]?\s*[A-Za-z]?\s*[.\-]?\s*\d{{1,6}}(?:\s*/\s*\d{{1,4}})?')
   OR ((i <= 3 OR i > len(ls) - 3) AND regexp_matches(l, '{_STAMP}')) THEN chr(8233) ELSE l END) AS ks FROM o_bl),
o_body AS (SELECT dossier_id, numero_global, regexp_replace(regexp_replace(array_to_string(ks, ' '), '\x{{2029}}(?: \x{{2029}})+', chr(8233), 'g'),
   '^\x{{2029}} ?| ?\x{{2029}}$', '', 'g') AS corps FROM o_bk)"""


@query("body_text", views=("pages",), ctes=BODY_CTE, sql="SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, corps FROM o_body")
def body_text(d):
    return x.body_text(d.pages)


def sentences_sql(c: str) -> str:
    kept = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])([A-ZÀ-Ÿ])\.', '\1\2' || chr(29), 'g')"
    cut = rf"regexp_replace(regexp_replace({kept}, '\.({WS}|$)', '.' || chr(30) || '\1', 'g'), '\x{{2029}}', chr(8233) || chr(30), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(30)), lambda z: {strip_sql('replace(z, chr(29), chr(46))')}), lambda z: z <> '')"


@query("sentences", views=("documents",), sql=f"""
, o_s AS (SELECT dossier_id, numero_global, {sentences_sql('texte')} AS ss FROM cf_documents)
SELECT dossier_id, numero_global, unnest(ss) AS phrase, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS ordre FROM o_s""")
def sentences(d):
    return x.sentence_rows(d.documents.withColumnRenamed("texte", "corps"))


@query("person_mentions", views=("pages", "page_pieces"), sql=r"""
SELECT DISTINCT p.dossier_id, i.piece_id, regexp_replace(trim(nom), '\s+', ' ', 'g') AS nom FROM (
  SELECT dossier_id, numero_global, unnest(regexp_extract_all(texte,
    '(?:^|[^\p{L}\p{N}_])([A-ZÀ-Ÿ][a-zà-ÿ]+\s+[A-ZÀ-Ÿ]{2,}(?:-[A-ZÀ-Ÿ]{2,})?)\b', 1)) AS nom FROM cf_pages) p
JOIN cf_page_pieces i ON i.dossier_id = p.dossier_id AND i.page = p.numero_global""")
def person_mentions(d):
    linked = d.pages.join(d.page_pieces.withColumnRenamed("page", "numero_global"), ["dossier_id", "numero_global"])
    return x.person_mentions(linked)


@query("service_mentions", views=("pages",), sql=r"""
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, nullif(regexp_extract(texte,
 '(?i)\b(brigade\s+de\s+gendarmerie\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ''-]+|commissariat\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ''-]+|Procureur\s+de\s+la\s+République\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ''-]+)', 1), '') AS service FROM cf_pages""")
def service_mentions(d):
    return x.service_mentions(d.pages)


_IDS = {
    "Téléphone": (r"\b0[1-9](?:[\s.-]?\d{2}){4}\b", r"regexp_replace(v, '\D', '', 'g')"),
    "Plaque d''immatriculation": (r"\b[A-Z]{2}-\d{3}-[A-Z]{2}\b", "replace(upper(v), ' ', '')"),
    "IBAN": (r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b", "replace(upper(v), ' ', '')"),
    "Adresse": (r"(?i)\b\d{1,4}[,]?\s+(?:rue|avenue|boulevard|chemin|impasse|allée|place|route|quai|cours|zone\s+industrielle|zone\s+d[''’]activit[ée])\s+[A-Za-zÀ-ÿ''\-]+(?:\s+[A-Za-zÀ-ÿ''\-]+){0,4}",
                "lower(regexp_replace(trim(v), '\\s+', ' ', 'g'))"),
}
PROCEDURE_CTE = ("o_procedure AS (SELECT * FROM cf_pages p WHERE NOT EXISTS (SELECT 1 FROM cf_pieces i WHERE i.dossier_id = p.dossier_id "
                 f"AND i.type IN ({_list(v.TYPES_HORS_PROCEDURE)}) AND p.numero_global BETWEEN i.page_debut AND i.page_fin))")
# Places of all matches: the text is cut before each one, and what comes before is as long as the parts before.
def matches_sql(source: str, kind: str, pattern: str) -> str:
    return (f"SELECT dossier_id, numero_global, texte, '{kind}' AS type, unnest(regexp_extract_all(texte, '{pattern}')) AS v0, "
            f"generate_subscripts(regexp_extract_all(texte, '{pattern}'), 1) - 1 AS ordre, "
            f"list_transform(string_split(regexp_replace(texte, '({pattern})', chr(64976) || '\\1', 'g'), chr(64976)), lambda z: length(z)) AS tailles FROM {source}")


def identifiers_sql(source: str, prefix: str) -> list[str]:
    return [f"{prefix}{i} AS ({matches_sql(source, kind, p)})" for i, (kind, (p, _)) in enumerate(_IDS.items())] + [
        f"{prefix} AS (" + " UNION ALL ".join(
            f"SELECT dossier_id, numero_global, texte, type, v AS valeur_brute, {norm} AS cle, ordre, list_sum(tailles[1:ordre + 1])::BIGINT + 1 AS debut "
            f"FROM (SELECT *, regexp_replace(trim(v0), ',+$', '') AS v FROM {prefix}{i})" for i, (_, norm) in enumerate(_IDS.values())) + ")"]


IDENTIFIERS_CTE = ",\n".join(
    [PROCEDURE_CTE, *identifiers_sql("o_procedure", "o_ids0"),
     "o_ids AS (SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, type, cle, valeur_brute, CAST(ordre AS INT) AS ordre, "
     "trim(string_split(texte, chr(10))[length(substr(texte, 1, debut - 1)) - length(replace(substr(texte, 1, debut - 1), chr(10), '')) + 1]) AS citation FROM o_ids0 "
     "WHERE cle <> '' QUALIFY row_number() OVER (PARTITION BY dossier_id, numero_global, type, cle ORDER BY ordre) = 1)"])


@query("identifier_mentions", views=("pages", "pieces"), ctes=IDENTIFIERS_CTE, sql="SELECT * FROM o_ids")
def identifier_mentions(d):
    return f.procedure_rows(x.identifier_mentions(d.pages), d.pieces)


def raw_sentences_sql(c: str) -> str:
    """The sentences with their blanks, end to end."""
    kept = rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])([A-ZÀ-Ÿ])\.', '\1\2' || chr(29), 'g')"
    cut = rf"regexp_replace(regexp_replace({kept}, '\.({WS}|$)', '.' || chr(30) || '\1', 'g'), '\x{{2029}}', chr(8233) || chr(30), 'g')"
    return f"list_transform(string_split({cut}, chr(30)), lambda z: replace(z, chr(29), chr(46)))"


def sentence_ends_sql(source: str) -> str:
    return (f"o_s AS (SELECT dossier_id, numero_global, {raw_sentences_sql('texte')} AS ss FROM {source}), "
            "o_e AS (SELECT dossier_id, numero_global, unnest(ss) AS phrase, generate_subscripts(ss, 1) AS n FROM o_s), "
            "o_f AS (SELECT *, sum(length(phrase)) OVER (PARTITION BY dossier_id, numero_global ORDER BY n) AS fin FROM o_e)")


@query("identifier_sentences", views=("pages",), ctes=",\n".join(identifiers_sql("cf_pages", "o_all")), sql=f"""
, {sentence_ends_sql('cf_pages')}
SELECT a.dossier_id, CAST(a.numero_global AS INT) AS numero_global, a.type, a.cle, CAST(a.debut AS INT) AS debut, {strip_sql('f.phrase')} AS phrase
FROM o_all a JOIN o_f f ON f.dossier_id = a.dossier_id AND f.numero_global = a.numero_global AND a.debut > f.fin - length(f.phrase) AND a.debut <= f.fin WHERE a.cle <> ''""")
def identifier_sentences(d):
    return x.identifier_sentences(d.pages)


@query("offset_sentences", views=("documents",), ctes=f"o_all AS ({matches_sql('cf_documents', 'n', '[0-9]{4,}')})", sql=f"""
, {sentence_ends_sql('cf_documents')}, o_m AS (SELECT *, list_sum(tailles[1:ordre + 1])::BIGINT + 1 AS debut FROM o_all)
SELECT a.dossier_id, a.numero_global, CAST(a.ordre AS INT) AS ordre, a.v0 AS valeur, CAST(a.debut AS INT) AS debut, {strip_sql('f.phrase')} AS phrase
FROM o_m a JOIN o_f f ON f.dossier_id = a.dossier_id AND f.numero_global = a.numero_global AND a.debut > f.fin - length(f.phrase) AND a.debut <= f.fin""")
def offset_sentences(d):
    """The sentence that covers the place of each longer number, over whole documents."""
    return x.sentences_of(d.documents, "[0-9]{4,}")


@query("seal_mentions")
def seal_mentions(d):
    return f.procedure_rows(x.seal_mentions(d.pages), d.pieces).withColumn("couleurs", F.array_join("couleurs", ",")).withColumn(
        "mesures", F.array_join("mesures", ","))


@query("legibility_score", views=("pages",), sql=f"""
, o_w AS (SELECT dossier_id, numero_global, ocr_applique, {LEGIBILITY_SQL} AS ws FROM cf_pages)
SELECT dossier_id, CAST(numero_global AS INT) AS numero_global, ocr_applique, round({SCORE_SQL}, 6) AS score, ({SCORE_SQL}) >= 0.35 AS illisible FROM o_w""")
def legibility_score(d):
    return x.legibility(d.pages).withColumn("score", F.round("score", 6))


@query("reading_plausibility", views=("documents",), sql=f"""
, o_w AS (SELECT dossier_id, numero_global, list_transform(regexp_extract_all(texte, '[A-Za-zÀ-ÿ]{{2,}}'), lambda w: lower(w)) AS ws FROM cf_documents),
o_p AS (SELECT *, CASE WHEN len(ws) >= 10 THEN len(list_filter(ws, lambda w: w IN ({_list(v.PETITS_MOTS)}))) / len(ws) END AS part FROM o_w)
SELECT dossier_id, numero_global, round(part, 9) AS part, part >= 0.22 AS plausible FROM o_p""")
def reading_plausibility(d):
    return x.plausibility(d.documents).withColumn("part", F.round("part", 9))
