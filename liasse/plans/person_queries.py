"""Persons and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import spread
from ..operators import persons as p, verification as w
from .registry import Views, norm_sql, query


def linked(d: Views, texts: bool = True):
    """Pages with the number of their piece, dealt out to as many tasks as a shuffle has: their texts are read next.

    Without ``texts`` the same rows come without them, and none is made.
    """
    pieces = d.page_pieces.withColumnRenamed("page", "numero_global")
    return spread(d.pages if texts else d.page_keys, "dossier_id", "numero_global").join(pieces, ["dossier_id", "numero_global"]).withColumn("ouvre", F.col("piece_id") == F.col("numero_global"))


_TAG = r"((?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+)\s+(?:[A-ZÀ-ÖØ-Þ]{2,}))\s*\((MIS EN CAUSE|VICTIME|TÉMOIN)\)"


@query("tagged_persons", views=("pages",), sql=rf"""
, o_t AS (SELECT dossier_id, CASE numero_global WHEN 4 THEN 3 WHEN 9 THEN 8 ELSE numero_global END AS piece_id, regexp_extract(texte, '{_TAG}', 1) AS nom,
   CASE regexp_extract(texte, '{_TAG}', 2) WHEN 'MIS EN CAUSE' THEN 'mis_en_cause' WHEN 'VICTIME' THEN 'victime' WHEN 'TÉMOIN' THEN 'témoin' END AS role FROM cf_pages),
o_c AS (SELECT dossier_id, numero_global AS piece_id, regexp_extract(texte, 'Personne entendue : ([A-Z]+) (\S+)', 2) || ' ' || regexp_extract(texte, 'Personne entendue : ([A-Z]+) (\S+)', 1) AS nom, 'témoin' AS role
  FROM cf_pages WHERE texte LIKE '%TÉMOIN' || chr(10) || 'Personne entendue : %'),
o_a AS (SELECT * FROM o_t WHERE nom <> '' UNION ALL SELECT * FROM o_c)
SELECT dossier_id, nom, arg_max(role, CASE role WHEN 'mis_en_cause' THEN 3 WHEN 'victime' THEN 2 ELSE 1 END) AS role, CAST(min(piece_id) AS INT) AS premiere_piece FROM o_a GROUP BY ALL""")
def tagged_persons(d):
    return p.tagged_persons(linked(d))


@query("first_person_mention")
def first_person_mention(d):
    return p.first_mentions(linked(d))


@query("piece_main_person")
def piece_main_person(d):
    return p.main_persons(linked(d), d.pieces)[1]


@query("person_merge")
def person_merge(d):
    rows = d.spellings.groupBy("dossier_id", "nom").agg(
        F.min("personne_id").alias("personne_id"), F.min_by("role", "personne_id").alias("role"), F.bool_or("est_client").alias("est_client"))
    return p.merge_persons(rows, d.pages)[0]


@query("person_name_resolution", views=("free_names", "persons"), sql=r"""
, o_n AS (SELECT *, list_sort(list_distinct(string_split_regex(lower(trim(nom_libre)), '\s+'))) AS mots FROM cf_free_names),
o_p AS (SELECT *, list_sort(list_distinct(string_split_regex(lower(nom), '\s+'))) AS mots,
   array_to_string(list_filter(string_split(nom, ' '), lambda z: z = upper(z) AND length(z) > 1), ' ') AS s, lower(strip_accents(array_to_string(list_filter(string_split(nom, ' '), lambda z: z <> upper(z)), ''))) AS f FROM cf_persons),
o_r AS (SELECT n.dossier_id, nom_id, nom_libre, coalesce(
   (SELECT min(personne_id) FROM o_p q WHERE q.dossier_id = n.dossier_id AND lower(q.nom) = lower(n.nom_libre)),
   CASE WHEN len(n.mots) >= 2 THEN (SELECT min(personne_id) FROM o_p q WHERE q.dossier_id = n.dossier_id AND q.mots = n.mots) END,
   CASE WHEN len(n.mots) >= 2 THEN (SELECT CASE WHEN count(DISTINCT personne_id) = 1 THEN min(personne_id) END FROM o_p q,
      (SELECT array_to_string(list_filter(string_split(n.nom_libre, ' '), lambda z: z = upper(z) AND length(z) > 1), ' ') AS s2,
        lower(strip_accents(array_to_string(list_filter(string_split(n.nom_libre, ' '), lambda z: z <> upper(z)), ''))) AS f2) z
     WHERE q.dossier_id = n.dossier_id AND s2 <> '' AND f2 <> '' AND substr(s2, 1, 1) = substr(q.s, 1, 1) AND levenshtein(f2, q.f) <= 1
       AND levenshtein(s2, q.s) <= CASE WHEN least(length(s2), length(q.s)) >= 9 AND abs(length(s2) - length(q.s)) <= 1 THEN 2 ELSE 1 END) END) AS personne_id FROM o_n n)
SELECT * FROM o_r""")
def person_name_resolution(d):
    return p.resolve_names(d.free_names, d.persons)


@query("person_proposals_guard", views=("pages", "page_pieces", "persons"), sql=r"""
, o_t AS (SELECT p.dossier_id, i.piece_id, p.texte FROM cf_pages p JOIN cf_page_pieces i ON i.dossier_id = p.dossier_id AND i.page = p.numero_global),
o_q AS (SELECT dossier_id, piece_id, tranche, CASE tranche WHEN 1 THEN 'Docteur Jean INVENTÉ' WHEN 2 THEN CASE WHEN piece_id % 2 = 0 THEN 'TARKAN Selim' ELSE 'Gauthier Gilles' END ELSE 'Yanis DERRADJI' END AS nom
   FROM (SELECT dossier_id, piece_id FROM cf_page_pieces WHERE page = piece_id) p, (VALUES (1), (2), (3), (4)) t(tranche)),
o_v AS (SELECT q.*, CASE WHEN nom = 'TARKAN Selim' THEN (SELECT min(x.nom) FROM cf_persons x WHERE x.dossier_id = q.dossier_id AND x.nom = 'Selim TARKAN')
   WHEN nom = 'Yanis DERRADJI' THEN coalesce((SELECT min(x.nom) FROM cf_persons x WHERE x.dossier_id = q.dossier_id AND x.nom = 'Yanis DERRADJI'),
     CASE WHEN EXISTS (SELECT 1 FROM o_t g WHERE g.dossier_id = q.dossier_id AND g.piece_id = q.piece_id AND contains(lower(g.texte), 'yanis derradji')) THEN 'Yanis DERRADJI' 
          WHEN (SELECT bool_or(regexp_matches(lower(g.texte), '\byanis\b')) AND bool_or(regexp_matches(lower(g.texte), '\bderradji\b')) FROM o_t g WHERE g.dossier_id = q.dossier_id AND g.piece_id = q.piece_id) THEN 'Yanis DERRADJI' END)
   WHEN nom = 'Gauthier Gilles' AND (SELECT bool_or(regexp_matches(lower(g.texte), '\bgauthier\b')) AND bool_or(regexp_matches(lower(g.texte), '\bgilles\b')) FROM o_t g WHERE g.dossier_id = q.dossier_id AND g.piece_id = q.piece_id) THEN nom END AS garde FROM o_q q)
SELECT dossier_id, CAST(piece_id AS INT) AS piece_id, arg_min(garde, tranche) AS nom, 'mis_en_cause' AS role FROM o_v WHERE garde IS NOT NULL GROUP BY ALL""")
def person_proposals_guard(d):
    pages = linked(d)
    asked = linked(d, texts=False).filter("ouvre").select("dossier_id", "piece_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("tranche"))
    name = (F.when(F.col("tranche") == 1, "Docteur Jean INVENTÉ")
            .when((F.col("tranche") == 2) & (F.col("piece_id") % 2 == 0), "TARKAN Selim").when(F.col("tranche") == 2, "Gauthier Gilles")
            .otherwise("Yanis DERRADJI"))
    return p.guard_persons(asked.withColumn("nom", name).withColumn("role", F.lit("mis_en_cause")), d.persons, pages)


@query("designate_client", views=("persons",), sql="""
, o_d AS (SELECT DISTINCT dossier_id, CASE CAST(substr(dossier_id, 13, 1) AS INT) % 3 WHEN 0 THEN 'Selim TARKAN' WHEN 1 THEN 'Personne INCONNUE' END AS nom FROM cf_persons),
o_v AS (SELECT * FROM o_d d WHERE nom IS NULL OR EXISTS (SELECT 1 FROM cf_persons p WHERE p.dossier_id = d.dossier_id AND p.nom = d.nom))
SELECT p.dossier_id, p.personne_id, p.nom, p.role, CASE WHEN v.dossier_id IS NULL THEN p.est_client ELSE coalesce(p.nom = v.nom, FALSE) END AS est_client
FROM cf_persons p LEFT JOIN o_v v USING (dossier_id)""")
def designate_client(d):
    digit = F.substring("dossier_id", 13, 1).cast("int") % 3
    asked = d.persons.select("dossier_id").distinct().withColumn(
        "nom", F.when(digit == 0, "Selim TARKAN").when(digit == 1, "Personne INCONNUE"))
    return p.designate_client(d.persons, asked, d.persons.select("dossier_id"))[0]


@query("summary_addressee", views=("persons",), sql="""
SELECT dossier_id, coalesce(min(nom) FILTER (WHERE est_client), CASE WHEN count(*) FILTER (WHERE role = 'mis_en_cause') = 1 THEN min(nom) FILTER (WHERE role = 'mis_en_cause') END) AS destinataire
FROM cf_persons GROUP BY dossier_id""")
def summary_addressee(d):
    return p.addressee(d.persons)


@query("personality_elements")
def personality_elements(d):
    suspects = p.tagged_persons(linked(d)).select("dossier_id", F.col("nom").alias("personne_id"), "nom", "role")
    return p.personality(suspects, d.pages, d.pieces)


# --- verification ------------------------------------------------------------

def quotations(d: Views):
    """One proposed quotation per document: true, re-spaced, or altered."""
    t = F.col("texte")
    cut = F.substring(t, 1, 60)
    kind = F.col("numero_global") % 4
    asked = (F.when(kind == 0, F.lower(cut)).when(kind == 1, F.concat(F.lit("  "), F.regexp_replace(cut, "[ \n]", "  ")))
             .when(kind == 2, F.concat(F.lit("Texte inventé "), F.substring(t, 1, 12))).otherwise(F.lit("")))
    return d.documents.select("dossier_id", F.col("numero_global").alias("id"), F.when(F.col("numero_global") % 17 == 0, -1).otherwise(
        F.col("numero_global")).alias("page"), asked.alias("citation"), F.lit("a_faire").alias("statut_verif"))


@query("verify_citations", views=("documents",), sql=rf"""
, o_r AS (SELECT dossier_id, numero_global AS id, CASE WHEN numero_global % 17 = 0 THEN -1 ELSE numero_global END AS page, CASE numero_global % 4
   WHEN 0 THEN lower(substr(texte, 1, 60)) WHEN 1 THEN '  ' || regexp_replace(substr(texte, 1, 60), '[ \n]', '  ', 'g') WHEN 2 THEN 'Texte inventé ' || substr(texte, 1, 12) ELSE '' END AS citation FROM cf_documents),
o_j AS (SELECT r.*, {norm_sql('citation')} <> '' AND contains({norm_sql('texte')}, {norm_sql('citation')}) AS exacte, texte IS NULL AS absente
  FROM o_r r LEFT JOIN cf_documents p ON p.dossier_id = r.dossier_id AND p.numero_global = r.page)
SELECT dossier_id, id, page, citation, CASE WHEN exacte THEN 'verifie' ELSE 'rejete' END AS statut_verif, CASE WHEN exacte THEN 'exacte' ELSE 'rejetee' END AS methode_verif,
  CASE WHEN exacte THEN NULL WHEN absente THEN 'page annoncée introuvable dans le dossier' ELSE 'citation introuvable sur la page annoncée' END AS raison FROM o_j""")
def verify_citations(d):
    return w.verify(quotations(d), d.documents).drop("citation_proposee")


@query("literal_passage")
def literal_passage(d):
    """Quotations with one letter changed, shown in the page's own words."""
    altered = d.documents.filter("ocr_applique").select(
        "dossier_id", F.col("numero_global").alias("id"), F.col("numero_global").alias("page"),
        F.concat(F.substring("texte", 1, 40), F.lit("q"), F.col("texte").substr(F.lit(42), F.lit(40))).alias("citation"))
    return w.literal_passages(altered, d.documents)


@query("citation_spans", views=("documents",), sql=r"""
, o_c AS (SELECT dossier_id, numero_global AS page, CASE WHEN numero_global % 2 = 0 THEN substr(texte, 5, 50) ELSE substr(texte, 1, 60) || ' fin inventée' END AS citation,
   CASE numero_global % 3 WHEN 0 THEN 'jaune' WHEN 1 THEN 'bleu' ELSE 'vert' END AS couleur, texte FROM cf_documents),
o_w AS (SELECT *, string_split_regex(regexp_replace(citation, '^\s+|\s+$', '', 'g'), '\s+') AS ws FROM o_c),
o_x AS (SELECT *, CASE WHEN len(ws) >= 6 THEN array_to_string(ws[1:6], ' ') END AS court FROM o_w)
SELECT dossier_id, page, citation, couleur, CAST(CASE WHEN instr(texte, citation) > 0 THEN instr(texte, citation) WHEN instr(texte, court) > 0 THEN instr(texte, court) END AS INT) AS debut,
 CAST(CASE WHEN instr(texte, citation) > 0 THEN instr(texte, citation) + length(citation) - 1 WHEN instr(texte, court) > 0 THEN instr(texte, court) + length(court) - 1 END AS INT) AS fin FROM o_x""")
def citation_spans(d):
    n = F.col("numero_global")
    rows = d.documents.select("dossier_id", n.alias("page"), F.when(n % 2 == 0, F.substring("texte", 5, 50)).otherwise(
        F.concat(F.substring("texte", 1, 60), F.lit(" fin inventée"))).alias("citation"), F.lit("verifie").alias("statut_verif"))
    return w.citation_spans(*[rows.filter(F.col("page") % 3 == i) for i in range(3)], d.documents)
