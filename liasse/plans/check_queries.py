"""Acts by rules, statements and cross-document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import acts as a, crosscheck as k, extraction as x, filters as f, statements as s
from .custody_queries import with_details
from .person_queries import linked
from .registry import Views, norm_sql, query
from .text_queries import IDENTIFIERS_CTE


@query("procedural_acts")
def procedural_acts(d):
    return a.numbered_acts(a.acts_by_rules(linked(d), d.pieces))


def act_proposals(d: Views):
    """Two proposed acts for every piece whose type has an act: one in the page's own words, one that it does not say."""
    nature = F.try_element_at(F.create_map(*[F.lit(z) for pair in v.NATURE_PAR_TYPE.items() for z in pair]), F.col("type"))
    base = linked(d).filter("ouvre").join(f.eligible_pieces(d.pieces, "actes").select("dossier_id", "piece_id", "type"), ["dossier_id", "piece_id"])
    base = base.withColumn("nature", nature).filter("nature IS NOT NULL").select("dossier_id", "piece_id", F.col("numero_global").alias("page"), "nature", "texte")
    # The first line with an hour.
    true_ = base.withColumn("citation", F.get(F.filter(F.split("texte", "\n"), lambda z: z.rlike(v.HEURE)), F.lit(0)))
    false_ = base.withColumn("citation", F.lit("Le médecin n'est pas venu")).withColumn("nature", F.lit("realisation_examen_medical"))
    rows = true_.unionByName(false_).filter("citation is not null").drop("texte")
    return rows.select(
        "*", (F.col("page") * 10 + F.when(F.col("nature") == "realisation_examen_medical", 1).otherwise(0)).alias("fiche_id"),
        F.coalesce(x.text.found(F.col("citation"), v.HEURE, 1), F.lit("23h59")).alias("heure"), F.lit("01/01/1999").alias("date"),
        F.lit("OPJ").alias("agent"), F.lit("absent").alias("avocat"), F.lit(None).cast("string").alias("interprete"),
        F.lit("non").alias("presentation"), F.lit("oui").alias("assentiment"), F.lit("oui").alias("autorisation_juge"))


@query("act_evidence_guard")
def act_evidence_guard(d):
    kept = a.guard_acts(act_proposals(d), d.pieces, d.pages)
    return kept.withColumn("details", F.to_json("details"))


@query("act_merge", views=("acts",), sql="""
, o_r AS (SELECT *, 0 AS s FROM cf_acts WHERE acte_id % 3 > 0 UNION ALL SELECT *, 1 FROM cf_acts WHERE acte_id % 3 = 0),
o_g AS (SELECT *, CASE WHEN nature IN ('interpellation', 'placement_garde_a_vue', 'notification_droits', 'fin_garde_a_vue', 'prolongation_garde_a_vue', 'debut_perquisition', 'fin_perquisition') THEN '' ELSE coalesce(heure, '?') END AS gr FROM o_r),
o_n AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, piece_id, nature, gr ORDER BY s, acte_id) AS rn,
  arg_min(agent, (s, acte_id)) FILTER (WHERE agent IS NOT NULL) OVER (PARTITION BY dossier_id, piece_id, nature, gr) AS agent1 FROM o_g)
SELECT dossier_id, CAST(acte_id AS BIGINT) AS id, nature, heure, CASE WHEN rn = 1 THEN agent1 ELSE agent END AS agent, CASE WHEN s = 0 THEN 'existant' ELSE 'propose' END AS origine FROM o_n WHERE rn = 1 OR s = 0""")
def act_merge(d):
    rows = with_details(d.acts)
    merged = a.merge_acts(rows.filter("acte_id % 3 > 0"), rows.filter("acte_id % 3 = 0").withColumn("fiche_id", F.col("acte_id")))
    return merged.select("dossier_id", "id", "nature", "heure", F.try_element_at("details", F.lit("agent")).alias("agent"), "origine")


@query("written_details", views=("pages",), sql=r"""
SELECT dossier_id, CAST(numero_global AS INT) AS page, CASE WHEN numero_global % 2 = 0 AND regexp_matches(texte, '(?i)sans\s+présentation') THEN 'non' END AS presentation, 'OPJ' AS agent
FROM cf_pages""")
def written_details(d):
    pages = d.pages
    acts = pages.select("dossier_id", F.col("numero_global").alias("page"), F.when(F.col("numero_global") % 2 == 0, "prolongation_garde_a_vue").otherwise(
        "debut_audition").alias("nature"), F.lit("audition débutée").alias("citation"), F.create_map(F.lit("agent"), F.lit("OPJ")).alias("details"))
    out = a.written_details(acts, pages)
    return out.select("dossier_id", "page", F.try_element_at("details", F.lit("presentation")).alias("presentation"), F.try_element_at("details", F.lit("agent")).alias("agent"))


@query("question_answer_pairs")
def question_answer_pairs(d):
    return s.qa_pairs(heard(d))


def heard(d: Views):
    """Pages of the pieces that are read for statements."""
    return linked(d).join(f.eligible_pieces(d.pieces, "declarations").select("dossier_id", "piece_id"), ["dossier_id", "piece_id"], "left_semi")


@query("statements")
def statements(d):
    pairs = s.qa_pairs(heard(d))
    from ..operators.persons import tagged_persons

    persons = tagged_persons(linked(d)).select("dossier_id", F.col("nom").alias("personne_id"), "nom")
    return s.statements(pairs, d.pieces, persons)


@query("divergences", views=("declarations",), sql=f"""
, o_d AS (SELECT *, {norm_sql('citation')} AS q, lag(declaration_id) OVER w AS pid, lag(piece_id) OVER w AS pp, lag({norm_sql('citation')}) OVER w AS pq FROM cf_declarations
  WHERE statut_verif = 'verifie' AND personne_id IS NOT NULL WINDOW w AS (PARTITION BY dossier_id, personne_id, point_factuel ORDER BY page, declaration_id))
SELECT dossier_id, personne_id, point_factuel, CAST(pid AS INT) AS declaration_id_a, CAST(declaration_id AS INT) AS declaration_id_b FROM o_d WHERE pid IS NOT NULL AND pp <> piece_id AND pq <> q""")
def divergences(d):
    return s.divergences(d.declarations)


@query("confrontations", views=("declarations", "persons"), sql="""
, o_n AS (SELECT d.*, p.nom AS personne FROM cf_declarations d LEFT JOIN cf_persons p USING (dossier_id, personne_id) WHERE statut_verif = 'verifie')
SELECT dossier_id, point_factuel, personne, CAST(page AS INT) AS page, citation, CAST(declaration_id AS INT) AS declaration_id FROM o_n n
WHERE (SELECT count(DISTINCT m.personne) FROM o_n m WHERE m.dossier_id = n.dossier_id AND m.point_factuel = n.point_factuel) >= 2""")
def confrontations(d):
    return s.confrontations(d.declarations, d.persons)


@query("shared_identifiers", views=("pages", "pieces"), ctes=IDENTIFIERS_CTE, sql="""
, o_s AS (SELECT dossier_id, type, cle, count(*) AS pages, arg_min(valeur_brute, numero_global) AS valeur FROM o_ids GROUP BY ALL HAVING count(DISTINCT numero_global) >= 2)
SELECT dossier_id, type, cle, valeur, pages, numero_global AS page, citation, valeur_brute FROM o_ids JOIN o_s USING (dossier_id, type, cle)""")
def shared_identifiers(d):
    return k.shared_identifiers(f.procedure_rows(x.identifier_mentions(d.pages), d.pieces))


@query("acts_dated_differently")
def acts_dated_differently(d):
    return k.dated_differently(d.acts, d.persons, d.act_pieces)


@query("near_identifiers", views=("pages", "pieces"), ctes=IDENTIFIERS_CTE, sql="""
, o_u AS (SELECT dossier_id, type, cle, min(numero_global) AS page, arg_min(valeur_brute, numero_global) AS valeur, arg_min(citation, numero_global) AS citation, count(*) AS pages
   FROM o_ids WHERE type IN ('Téléphone', 'Plaque d''immatriculation') GROUP BY ALL),
o_p AS (SELECT a.dossier_id, a.type, a.cle AS ka, b.cle AS kb, a.valeur AS va, b.valeur AS vb, a.page AS page_a, b.page AS page_b, a.citation AS citation_a, b.citation AS citation_b, a.pages AS pages_a, b.pages AS pages_b,
   list_filter(range(1, length(a.cle) + 1), lambda i: substr(a.cle, i, 1) <> substr(b.cle, i, 1)) AS ds
   FROM o_u a JOIN o_u b ON a.dossier_id = b.dossier_id AND a.type = b.type AND a.cle < b.cle AND length(a.cle) = length(b.cle))
SELECT dossier_id, type, type || ' : ' || va || ' ou ' || vb AS titre, page_a, citation_a, pages_a, page_b, citation_b, pages_b,
  EXISTS (SELECT 1 FROM cf_pages p WHERE p.dossier_id = o_p.dossier_id AND p.numero_global IN (page_a, page_b) AND p.ocr_applique) AS page_numerisee FROM o_p
WHERE (len(ds) = 1 OR (len(ds) = 2 AND ds[2] = ds[1] + 1 AND substr(ka, ds[1], 1) = substr(kb, ds[2], 1) AND substr(ka, ds[2], 1) = substr(kb, ds[1], 1)))
AND NOT EXISTS (SELECT 1 FROM o_ids i JOIN o_ids j ON i.dossier_id = j.dossier_id AND i.numero_global = j.numero_global AND i.type = j.type
  WHERE i.dossier_id = o_p.dossier_id AND i.type = o_p.type AND i.cle = ka AND j.cle = kb)""")
def near_identifiers(d):
    return k.near_identifiers(f.procedure_rows(x.identifier_mentions(d.pages), d.pieces), d.pages)


@query("acts_before_opening", views=("acts", "act_pieces"), sql="""
, o_s AS (SELECT dossier_id, date_apparente, heure_apparente, page_debut, citation FROM cf_act_pieces WHERE type = 'PV de saisine'),
o_a AS (SELECT *, bool_and(date IS NULL) OVER (PARTITION BY dossier_id) AS nul FROM cf_acts WHERE statut_verif = 'verifie' AND heure IS NOT NULL
   AND nature IN ('interpellation', 'placement_garde_a_vue', 'notification_droits', 'fin_garde_a_vue', 'debut_audition', 'avis_avocat', 'avis_parquet', 'debut_perquisition')),
o_b AS (SELECT a.*, s.page_debut AS page_a, s.citation AS citation_a, s.heure_apparente AS hs FROM o_a a JOIN o_s s USING (dossier_id)
   WHERE try_strptime(a.date || ' ' || a.heure, '%d/%m/%Y %Hh%M') < try_strptime(s.date_apparente || ' ' || s.heure_apparente, '%d/%m/%Y %Hh%M'))
SELECT dossier_id, nature, CASE nature WHEN 'interpellation' THEN 'Interpellation' WHEN 'placement_garde_a_vue' THEN 'Placement en garde à vue' WHEN 'notification_droits' THEN 'Notification des droits'
  WHEN 'fin_garde_a_vue' THEN 'Fin de garde à vue' WHEN 'debut_audition' THEN 'Audition' WHEN 'avis_avocat' THEN 'Avis à l''avocat' WHEN 'avis_parquet' THEN 'Avis au procureur' ELSE 'Perquisition' END
  || ' à ' || heure || ', avant la saisine à ' || hs AS titre, CAST(page_a AS INT) AS page_a, citation_a, CAST(page AS INT) AS page_b, citation AS citation_b, FALSE AS sans_date FROM o_b
QUALIFY row_number() OVER (PARTITION BY dossier_id, nature ORDER BY page, acte_id) = 1""")
def acts_before_opening(d):
    return k.before_opening(d.acts, d.act_pieces)


@query("seals_described_differently")
def seals_described_differently(d):
    return k.seal_conflicts(f.procedure_rows(x.seal_mentions(d.pages), d.pieces))


def rule_rows(d: Views):
    return k.rule_contradictions(
        k.dated_differently(d.acts, d.persons, d.act_pieces), k.before_opening(d.acts, d.act_pieces),
        k.near_identifiers(f.procedure_rows(x.identifier_mentions(d.pages), d.pieces), d.pages), k.seal_conflicts(f.procedure_rows(x.seal_mentions(d.pages), d.pieces)))


@query("all_contradictions")
def all_contradictions(d):
    from ..functions.scale import cut_lineage, ordered_rank

    rules = cut_lineage(rule_rows(d))
    # Half of the rule results come back as proposals, and each proposal twice.
    again = rules.filter("regle in ('K3', 'K4')").select("dossier_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copie"), "titre", "page", "citation", "regle", "domaine")
    # Equal titles of one case share a number, others never do.
    titles = ordered_rank(again.select("dossier_id", "titre").distinct(), ["dossier_id"], F.substring("titre", 1, 12), ["titre"], "rang")
    ordered = again.join(titles, ["dossier_id", "titre"]).withColumn("ordre", F.col("rang") * 2 + F.col("copie"))
    changed = F.when(F.col("regle") == "K4", F.concat(F.lit("Autre "), F.col("citation"))).otherwise(F.col("citation"))
    proposed = ordered.select("dossier_id", "ordre", "titre", F.lit("").alias("description"), "domaine", "page", changed.alias("citation"))
    return k.all_contradictions(rules, proposed)


@query("known_versions")
def known_versions(d):
    rules = k.dated_differently(d.acts, d.persons, d.act_pieces).select("dossier_id", "titre")
    return k.known_versions(rules).withColumn("versions", F.array_join("versions", " | "))
