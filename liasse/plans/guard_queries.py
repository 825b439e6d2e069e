"""Guards, retrieval, reports, sinks and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text, vocab as v
from ..functions.scale import cut_lineage
from ..operators import custody as c, extraction as x, filters as f, findings as r, guards as g, retrieval as q, reports as rp, segmentation as sg, statements as st
from ..operators.persons import personality, tagged_persons
from ..sources import sinks, pages as s
from ..streaming import jobs
from .check_queries import rule_rows
from .custody_queries import CUSTODY_CTE, custodies, with_details
from .person_queries import linked
from .registry import Views, query
from .text_queries import LEGIBILITY_SQL, MARK_CTE, SCORE_SQL

# --- free text ---------------------------------------------------------------

SAID = (
    "Le véhicule est arrivé vers 21h00.", "Il a discuté une dizaine de minutes.", "Il connaît la victime depuis un an.",
    "Des violences sont relatées par Marc ROQUIER.", "La procédure est entachée de nullité.", "Il ment pour se protéger.",
    "Entre mars 2031 et mars 2031, [nom] est passé.", "Il est arrivé vers 22 heures.", "L'audition est close.",
)


def said(d: Views):
    """A model sentence per report page, true or not."""
    i = (F.col("numero_global") + F.substring("dossier_id", 13, 1).cast("int")) % len(SAID)
    return d.pages.select("dossier_id", "numero_global", "texte", F.element_at(F.array(*[F.lit(t) for t in SAID]), (i + 1).cast("int")).alias("dit"))


@query("absent_elements")
def absent_elements(d):
    from ..functions.elements import absent_elements as absent

    return said(d).select("dossier_id", "numero_global", "dit", F.array_join(absent(F.col("dit"), F.col("texte")), " | ").alias("absents"))


@query("wording_problems")
def wording_problems(d):
    return said(d).select("dossier_id", "numero_global", "dit", F.array_join(g.wording_problems(F.col("dit"), F.col("texte")), " ; ").alias("problemes"))


@query("parse_model_json", views=("documents",), sql=r"""
, o_r AS (SELECT dossier_id, numero_global, CASE numero_global % 5 WHEN 0 THEN '{"id": ' || CAST(numero_global AS VARCHAR) || '}' WHEN 1 THEN 'Voici : ' || chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '{"id": 1}' || chr(10) || chr(96) || chr(96) || chr(96)
   WHEN 2 THEN 'Réponse {"id": [1, 2]} fin' WHEN 3 THEN substr(texte, 1, 20) || ' {"id": ' ELSE 'liste [1, 2]' END AS raw FROM cf_documents),
o_c AS (SELECT *, CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\s*(.*?)```') THEN trim(regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)```', 1), E' \n') ELSE trim(raw) END AS c FROM o_r)
SELECT dossier_id, numero_global, CASE WHEN json_valid(c) THEN c WHEN json_valid(regexp_extract(c, '(?s)\{.*\}')) THEN regexp_extract(c, '(?s)\{.*\}') WHEN json_valid(regexp_extract(c, '(?s)\[.*\]')) THEN regexp_extract(c, '(?s)\[.*\]') END AS json FROM o_c""")
def parse_model_json(d):
    n = F.col("numero_global") % 5
    fence = "`" * 3
    raw = (F.when(n == 0, F.concat(F.lit('{"id": '), F.col("numero_global").cast("string"), F.lit("}")))
           .when(n == 1, F.lit(f'Voici : {fence}json\n{{"id": 1}}\n{fence}')).when(n == 2, F.lit('Réponse {"id": [1, 2]} fin'))
           .when(n == 3, F.concat(F.substring("texte", 1, 20), F.lit(' {"id": '))).otherwise(F.lit("liste [1, 2]")))
    return g.parse_answers(d.documents.withColumn("raw", raw)).select("dossier_id", "numero_global", "json")


@query("title_guard")
def title_guard(d):
    digit = F.col("piece_id") % 3
    title = F.when(digit == 0, "Audition de Paul INVENTÉ").when(digit == 1, F.col("type")).otherwise("Acte nul pour irrégularité")
    proposals = d.pieces.select("dossier_id", "piece_id", title.alias("titre"))
    return g.guard_titles(d.pieces, proposals, linked(d)).select("dossier_id", "piece_id", "titre")


@query("fact_description_guard")
def fact_description_guard(d):
    facts = said(d).select("dossier_id", F.col("numero_global").alias("piece_id"), F.col("numero_global").alias("fait_id"), F.col("dit").alias("description"))
    return g.guard_descriptions(facts, d.pages.withColumn("piece_id", F.col("numero_global")))


@query("name_completion", views=("pages", "persons"), sql=r"""
, o_w AS (SELECT dossier_id, numero_global, unnest(list_distinct(flatten(list_transform(regexp_extract_all(texte, '(?:^|[^A-Za-zÀ-ÖØ-öø-ÿ''’-])([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ''’-]*)', 1),
   lambda w: string_split_regex(lower(strip_accents(w)), '[''’-]'))))) AS p FROM cf_pages),
o_n AS (SELECT dossier_id, personne_id, nom, unnest(list_distinct(list_filter(regexp_extract_all(lower(strip_accents(nom)), '[a-z]+'), lambda z: length(z) >= 3))) AS p FROM cf_persons),
o_a AS (SELECT dossier_id, numero_global, string_agg(nom, chr(10) ORDER BY personne_id, nom) AS noms FROM (SELECT DISTINCT w.dossier_id, numero_global, personne_id, nom FROM o_w w JOIN o_n n ON n.dossier_id = w.dossier_id AND n.p = w.p) GROUP BY ALL)
SELECT g.dossier_id, CAST(g.numero_global AS INT) AS numero_global, texte || coalesce(chr(10) || noms, '') AS reference FROM cf_pages g LEFT JOIN o_a a ON a.dossier_id = g.dossier_id AND a.numero_global = g.numero_global""")
def name_completion(d):
    pages = d.pages.select("dossier_id", "numero_global", F.col("texte").alias("reference"))
    return g.complete_names(pages, d.persons, ["numero_global"])


def case_elements_of(d: Views):
    return q.case_elements(d.faits, d.acts, d.declarations, d.persons, d.act_pieces)


@query("case_elements", views=("faits", "acts", "declarations", "persons", "act_pieces"), sql="""
SELECT f.dossier_id, 'F' AS famille, 'F' || CAST(fait_id AS VARCHAR) AS cle, CAST(page AS INT) AS page, coalesce(nom, '') AS libelle,
  coalesce('[pièce du ' || i.date_apparente || ' ' || i.heure_apparente || '] ', '') || description || coalesce(' (' || nom || ')', '') || ' — « ' || f.citation || ' »' AS ligne
FROM cf_faits f LEFT JOIN cf_persons p ON p.dossier_id = f.dossier_id AND p.personne_id = f.personne_id_source LEFT JOIN cf_act_pieces i ON i.dossier_id = f.dossier_id AND i.piece_id = f.piece_id WHERE statut_verif = 'verifie'
UNION ALL SELECT a.dossier_id, 'P', 'P' || CAST(acte_id AS VARCHAR), CAST(page AS INT), coalesce(nom, ''), nature || ' ' || concat_ws(' ', date, heure) || coalesce(', ' || nom, '') || ' — « ' || citation || ' »'
FROM cf_acts a LEFT JOIN cf_persons p ON p.dossier_id = a.dossier_id AND p.personne_id = a.personne_id WHERE statut_verif = 'verifie'
UNION ALL SELECT d.dossier_id, 'D', 'D' || CAST(declaration_id AS VARCHAR), CAST(page AS INT), coalesce(nom, ''), coalesce('Le ' || i.date_apparente || ', ', '') || coalesce(nom, 'déclarant non identifié') || ' déclare : ' || point_factuel || ' — « ' || d.citation || ' »'
FROM cf_declarations d LEFT JOIN cf_persons p ON p.dossier_id = d.dossier_id AND p.personne_id = d.personne_id LEFT JOIN cf_act_pieces i ON i.dossier_id = d.dossier_id AND i.piece_id = d.piece_id WHERE statut_verif = 'verifie'""")
def case_elements(d):
    return case_elements_of(d).drop("citation")


@query("elements_within_budget")
def elements_within_budget(d):
    return q.within_budget(case_elements_of(d), 3000).select("dossier_id", "cle")


def known(d: Views):
    return d.acts.select("dossier_id").distinct().select("dossier_id", F.lit("Interpellation de Selim TARKAN").alias("libelle"), F.array(F.lit("07h50"), F.lit("08h05")).alias("versions"))


# Versions of what a case says of an act: its distinct hours and officers, where there are several.
_COMPACT = "regexp_replace(lower(strip_accents(replace({}, '…', '...'))), '[\\s.-]', '', 'g')"


@query("single_version_guard", views=("acts",), sql=rf"""
, o_w AS (SELECT dossier_id, nature AS libelle, list_sort(list_distinct(list(w))) AS versions FROM (
    SELECT dossier_id, nature, heure AS w FROM cf_acts WHERE heure IS NOT NULL UNION ALL SELECT dossier_id, nature, agent FROM cf_acts WHERE agent IS NOT NULL) GROUP BY ALL),
o_v AS (SELECT dossier_id, libelle, len(versions) AS total, unnest(versions) AS version FROM o_w WHERE len(versions) > 1),
o_t AS (SELECT dossier_id, acte_id, coalesce(citation, '') || ' à ' || coalesce(heure, 'une heure inconnue') || ', ' || coalesce(agent, '') AS texte, heure FROM cf_acts),
o_c AS (SELECT t.dossier_id, t.acte_id, libelle, total, count(DISTINCT version) AS citees FROM o_t t JOIN o_v v ON v.dossier_id = t.dossier_id
    AND contains({_COMPACT.format('texte')}, {_COMPACT.format('version')}) GROUP BY ALL)
SELECT dossier_id, CAST(acte_id AS INT) AS acte_id, libelle, citees FROM o_c WHERE citees < total""")
def single_version_guard(d):
    said = d.acts.select("dossier_id", F.col("nature").alias("libelle"), F.explode(F.array("heure", "agent")).alias("w")).where("w IS NOT NULL")
    versions = said.groupBy("dossier_id", "libelle").agg(F.sort_array(F.collect_set("w")).alias("versions")).where("size(versions) > 1")
    texts = d.acts.select("dossier_id", "acte_id", F.concat(
        F.coalesce("citation", F.lit("")), F.lit(" à "), F.coalesce("heure", F.lit("une heure inconnue")), F.lit(", "), F.coalesce("agent", F.lit(""))).alias("texte"))
    return g.single_version(texts, versions, ["acte_id"])


@query("contradiction_proposals_guard")
def contradiction_proposals_guard(d):
    elements = cut_lineage(case_elements_of(d))
    pairs = d.acts.select("dossier_id", F.col("acte_id").alias("ordre"), F.when(F.col("acte_id") % 4 == 0, "Il ment").otherwise(
        "Heures selon les pièces").alias("titre"), F.concat(F.lit("Les deux pièces ne concordent pas (F"), F.col("acte_id"), F.lit(").")).alias("description"), F.lit("fond").alias("domaine"),
        F.array(F.concat(F.lit("F"), F.col("acte_id")), F.concat(F.lit("P"), (F.col("acte_id") + 5))).alias("sources"))
    reviews = pairs.select("dossier_id", "ordre", (F.col("ordre") % 5 > 0).alias("fidele"), F.lit(True).alias("contradiction_reelle"))
    return g.guard_contradictions(pairs, elements, d.persons, reviews).withColumn("sources", F.to_json("sources"))


def sentences_of(d: Views):
    elements = cut_lineage(case_elements_of(d))
    name = F.when(F.col("acte_id") % 3 == 0, "Selim TARKAN est passé.").when(F.col("acte_id") % 3 == 1, "La voiture est passée selon F1.").otherwise("Il est arrivé à 23h11.")
    rows = d.acts.select("dossier_id", F.col("acte_id").alias("phrase_id"), (F.col("acte_id") % 2 + 1).alias("essai"),
                         F.element_at(F.array(*[F.lit(t) for t in v.SECTIONS]), (F.col("acte_id") % 5 + 1).cast("int")).alias("section"), name.alias("texte"),
                         F.array(F.concat(F.lit("P"), F.col("acte_id")), F.concat(F.lit("F"), F.col("acte_id"))).alias("sources"))
    return g.guard_sentences(rows, elements, d.persons, known(d))


@query("summary_sentence_guard")
def summary_sentence_guard(d):
    return g.detailed_summary(sentences_of(d)).withColumn("sources", F.to_json("sources")).drop("problemes")


@query("short_summary")
def short_summary(d):
    return g.short_summary(sentences_of(d)).withColumn("defauts", F.array_join("defauts", " ; "))


# --- retrieval ---------------------------------------------------------------

def questions_of(d: Views):
    """Whole texts whose number is divisible by 50 are asked for among all texts."""
    return d.documents.filter("numero_global % 50 = 0").select("dossier_id", F.col("numero_global").alias("question_id"), F.col("texte").alias("question"))


_STEMS = ("list_distinct(list_transform(list_filter(regexp_extract_all(lower(strip_accents({c})), '[a-z0-9]+'), "
          "lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in v.MOTS_VIDES) + ")), lambda w: substr(w, 1, 7)))")


@query("relevance_scores", views=("documents",), sql=f"""
, o_q AS (SELECT dossier_id, numero_global AS question_id, unnest({_STEMS.format(c='texte')}) AS racine FROM cf_documents WHERE numero_global % 50 = 0),
o_x AS (SELECT dossier_id, numero_global, unnest({_STEMS.format(c='texte')}) AS racine FROM cf_documents),
o_n AS (SELECT dossier_id, count(*) AS n FROM cf_documents GROUP BY ALL),
o_w AS (SELECT dossier_id, racine, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS poids FROM o_x JOIN o_n USING (dossier_id) GROUP BY dossier_id, racine)
SELECT dossier_id, question_id, numero_global, round(sum(poids), 6) AS score FROM o_q JOIN o_x USING (dossier_id, racine) JOIN o_w USING (dossier_id, racine) GROUP BY ALL""")
def relevance_scores(d):
    return q.relevance(questions_of(d), d.documents)


@query("relevant_pages")
def relevant_pages(d):
    return q.relevant_pages(questions_of(d), d.documents)


@query("answer_guard")
def answer_guard(d):
    pages = d.pages
    asked = pages.select("dossier_id", F.col("numero_global").alias("question_id"), F.lit("À quelle heure ?").alias("question"), "texte")
    line = F.get(F.split("texte", "\n"), F.lit(2))
    first = asked.select("dossier_id", "question_id", F.lit(1).alias("essai"), F.when(F.col("question_id") % 3 == 1, F.lit("C'est une nullité.")).otherwise(F.lit("À 03h33.")).alias("reponse"),
                         F.array(F.struct(F.col("question_id").alias("page"), line.alias("citation"))).alias("citations"))
    second = first.withColumn("essai", F.lit(2)).withColumn("reponse", F.lit("Le fait est écrit."))
    persons = d.persons
    questions = d.page_keys.select("dossier_id", F.col("numero_global").alias("question_id"), F.lit("À quelle heure ?").alias("question"))
    return q.guard_answers(first.unionByName(second), questions, pages, persons, known(d)).withColumn("citations", F.to_json("citations"))


@query("procedure_points_answer", views=("acts", "persons"), ctes=CUSTODY_CTE, sql="""
SELECT dossier_id, CAST(acte_id AS BIGINT) AS question_id, 'passages' AS statut, 'Fin de garde à vue non identifiée' || CASE WHEN NOT une AND nom IS NOT NULL THEN ' — ' || nom ELSE '' END AS titre, CAST(o.page AS INT) AS page, o.citation
FROM cf_acts a JOIN (SELECT o.dossier_id, o.page, o.citation, une, nom FROM o_g o LEFT JOIN cf_persons p ON p.dossier_id = o.dossier_id AND p.personne_id = o.g WHERE fin IS NULL) o USING (dossier_id) WHERE acte_id % 3 > 0""")
def procedure_points_answer(d):
    held, visible = custodies(d)
    found = r.findings_custody(held, visible, d.act_pieces, with_details(d.acts)).filter("regle = 'R1'")
    asked = d.acts.select("dossier_id", F.col("acte_id").cast("long").alias("question_id"), F.when(
        F.col("acte_id") % 3 > 0, "Y a-t-il une nullité à soulever ?").otherwise("Qui est entendu ?").alias("question"))
    return q.procedure_points(asked, found)


# --- reports -----------------------------------------------------------------

@query("control_report", views=("pages", "pieces"), ctes=MARK_CTE + f""",
o_w AS (SELECT dossier_id, numero_global, {LEGIBILITY_SQL} AS ws FROM cf_pages),
o_l AS (SELECT dossier_id, numero_global, ({SCORE_SQL}) >= 0.35 AS peu FROM o_w)""", sql="""
, o_1 AS (SELECT p.dossier_id, count(*) AS pages, count(*) FILTER (WHERE ocr_applique) AS pages_ocr, count(*) FILTER (WHERE m.cote IS NULL) AS pages_sans_cote, count(*) FILTER (WHERE l.peu) AS pages_peu_lisibles
   FROM cf_pages p JOIN o_marks m USING (dossier_id, numero_global) JOIN o_l l USING (dossier_id, numero_global) GROUP BY ALL),
o_2 AS (SELECT dossier_id, count(*) AS pieces, count(*) FILTER (WHERE type = 'Non identifié') AS pieces_non_identifiees, count(*) FILTER (WHERE date_apparente IS NULL) AS pieces_sans_date, count(*) FILTER (WHERE service_redacteur IS NULL) AS pieces_sans_service,
   count(*) FILTER (WHERE confiance < 0.7) AS rejets, count(*) FILTER (WHERE cote IS NULL) AS signalements, count(*) FILTER (WHERE piece_id % 3 = 0) AS citations_floues FROM cf_pieces GROUP BY ALL)
SELECT * FROM o_1 JOIN o_2 USING (dossier_id)""")
def control_report(d):
    pieces = d.pieces
    methods = pieces.select("dossier_id", F.when(F.col("piece_id") % 3 == 0, "floue_ocr").otherwise("exacte").alias("methode_verif"))
    return rp.control_report(s.pages_with_marks(d.pages), pieces, {"acts": methods}, pieces.filter("confiance < 0.7"), pieces.filter("cote is null"))


@query("illegible_ranges")
def illegible_ranges(d):
    return rp.illegible_ranges(d.pages)


@query("run_costs", views=("runs",), sql="""
, o_r AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, etape ORDER BY run_id DESC, debut DESC, fin DESC, tokens_in DESC, tokens_out DESC, cout_usd DESC) AS rn FROM cf_runs)
SELECT dossier_id, etape, run_id, CAST(epoch(fin) - epoch(debut) AS BIGINT) AS duree_s, tokens_in, tokens_out, cout_usd FROM o_r WHERE rn = 1""")
def run_costs(d):
    return rp.run_costs(d.runs)


@query("call_counters", views=("calls",), sql="""
, o_c AS (SELECT modele, count(*) AS appels, count(*) FILTER (WHERE echec) AS echecs, CAST(sum(CASE WHEN echec THEN 0 ELSE tokens_in END) AS BIGINT) AS jetons_entree,
   CAST(sum(CASE WHEN echec THEN 0 ELSE tokens_out END) AS BIGINT) AS jetons_sortie, sum(secondes) AS secondes FROM cf_calls GROUP BY ALL)
SELECT modele, appels, echecs, jetons_entree, jetons_sortie, secondes, round(CASE modele WHEN 'modele-A' THEN jetons_entree / 1e6 * 2.0 + jetons_sortie / 1e6 * 10.0 WHEN 'modele-N' THEN jetons_entree / 1e6 * 0.5 + jetons_sortie / 1e6 * 1.5 ELSE 0.0 END, 6) AS cout_estime FROM o_c""")
def call_counters(d):
    tariffs = d.spark.createDataFrame([("modele-A", 2.0, 10.0), ("modele-N", 0.5, 1.5)], "modele string, entree_par_million double, sortie_par_million double")
    return rp.call_counters(d.calls, tariffs).withColumn("cout_estime", F.round("cout_estime", 6))


def truth_of(d: Views):
    people = d.persons
    rows = people.select("dossier_id", F.when(F.col("role") == "mis_en_cause", "mis_en_cause").otherwise("jamais_mis_en_cause").alias("sorte"), F.col("nom").alias("attendu"), F.lit("0").alias("valeur"))
    lengths = people.filter("role = 'mis_en_cause'").select("dossier_id", F.lit("duree").alias("sorte"), F.col("nom").alias("attendu"), F.lit("1000").alias("valeur"))
    notes = people.select("dossier_id").distinct().select("dossier_id", F.explode(F.array(F.lit("signalement"), F.lit("jamais_signale"))).alias("sorte"), F.lit("Fin de garde à vue").alias("attendu"), F.lit("0").alias("valeur"))
    pair = people.filter("role = 'mis_en_cause'").select("dossier_id", F.lit("contradiction").alias("sorte"), F.concat(F.lit("Interpellation / "), F.col("nom")).alias("attendu"), F.lit("0").alias("valeur"))
    return rows.unionByName(lengths).unionByName(notes).unionByName(pair)


def evaluated(d: Views):
    from ..operators.crosscheck import dated_differently

    held, visible = custodies(d)
    found = r.findings_custody(held, visible, d.act_pieces, with_details(d.acts))
    return rp.evaluate(truth_of(d), dated_differently(d.acts, d.persons, d.act_pieces), d.persons, found, held)


@query("truth_evaluation")
def truth_evaluation(d):
    return evaluated(d)


@query("safety_evaluation")
def safety_evaluation(d):
    rows = said(d)
    texts = rows.select("dossier_id", F.col("numero_global").alias("texte_id"), F.col("dit").alias("texte"))
    quotes = rows.select("dossier_id", F.col("numero_global").alias("page"), F.substring("texte", 3, 40).alias("citation"))
    return rp.safety(texts, d.pages, quotes)


@query("check_stability", views=("acts",), sql="""
SELECT CASE WHEN acte_id % 2 = 0 THEN 'sécurité' ELSE 'qualité' END AS famille, nature AS controle, count(*) FILTER (WHERE statut_verif = 'verifie') AS reussis, count(*) AS passages, bool_and(statut_verif = 'verifie') AS acquis FROM cf_acts GROUP BY ALL""")
def check_stability(d):
    return rp.stability(d.acts.select(F.when(F.col("acte_id") % 2 == 0, "sécurité").otherwise("qualité").alias("famille"), F.col("nature").alias("controle"), (F.col("statut_verif") == "verifie").alias("ok")))


@query("case_status_list", views=("heartbeats", "event_base"), sql="""
, o_c AS (SELECT dossier_id, min(mis_a_jour_le) AS cree_le, arg_max(statut, event_id) AS statut FROM cf_heartbeats GROUP BY ALL)
SELECT c.dossier_id, c.cree_le, c.statut, e.event_type AS etape, 'termine' AS statut_etape, e.ts AS debut FROM o_c c LEFT JOIN cf_event_base e ON 'U' || CAST(e.u AS VARCHAR) = c.dossier_id""")
def case_status_list(d):
    cases = d.heartbeats.groupBy("dossier_id").agg(F.min("mis_a_jour_le").alias("cree_le"), F.max_by("statut", "event_id").alias("statut"))
    stages = d.event_base.select(F.concat(F.lit("U"), F.col("u").cast("string")).alias("dossier_id"), F.col("event_type").alias("etape"), F.lit("termine").alias("statut"), F.col("ts").alias("debut"))
    return rp.case_status(cases, stages)


# --- sinks -------------------------------------------------------------------

def sections(d: Views) -> dict[str, tuple]:
    """Every section of a case: its rows and their order."""
    held, visible = custodies(d)
    acts = with_details(d.acts)
    found = cut_lineage(r.findings_custody(held, visible, d.act_pieces, acts).unionByName(r.findings_acts(held, visible)).unionByName(
        r.findings_case(acts, d.act_pieces, d.pages.withColumn("piece_id", F.col("numero_global")))))
    rules = cut_lineage(rule_rows(d))
    names = d.persons.select("dossier_id", "personne_id", F.col("nom").alias("personne"))
    told = d.declarations.filter("statut_verif = 'verifie'").join(names, ["dossier_id", "personne_id"], "left")
    index = sg.piece_index(d.pieces).withColumn("titre", F.lit(None).cast("string")).withColumn("statut_revision", sg.revision_status())
    return {
        "personnes": (d.persons.withColumn("ordre", F.concat(F.when(F.col("est_client"), "0").otherwise("1"), "role", "nom")), ["ordre"]),
        "chronologie_procedure": (c.act_chronology(d.acts.filter("statut_verif = 'verifie'")).join(names, ["dossier_id", "personne_id"], "left"), ["ordre"]),
        "chronologie_faits": (c.fact_chronology(d.faits, d.act_pieces, d.persons), ["ordre"]),
        "gardes_a_vue": (held, ["gardien"]), "signalements": (found, ["regle", "page", "titre"]), "declarations": (told, ["page", "declaration_id"]),
        "divergences": (st.divergences(d.declarations), ["declaration_id_a", "declaration_id_b"]),
        "confrontations": (st.confrontations(d.declarations, d.persons), ["point_factuel", "page", "declaration_id"]),
        "contradictions": (rules, ["regle", "titre", "rang", "page"]),
        "recoupements": (f.procedure_rows(x.identifier_mentions(d.pages), d.pieces), ["numero_global", "type", "cle"]),
        "sources_des_pages": (f.page_source_map(s.pages_with_marks(d.pages), d.pieces), ["page"]), "index_pieces": (index, ["page_debut"])}


@query("deliverable_tables")
def deliverable_tables(d):
    """The ten deliverables, a row each as JSON."""
    of = {name: rows for name, (rows, _) in sections(d).items()}
    suspects = tagged_persons(linked(d)).select("dossier_id", F.col("nom").alias("personne_id"), "nom", "role")
    report = rp.control_report(s.pages_with_marks(d.pages), d.pieces, {"acts": with_details(d.acts)}, d.acts.filter("statut_verif = 'rejete'"), of["signalements"])
    tables = sinks.deliverable_tables({
        "index": of["index_pieces"], "acts": of["chronologie_procedure"], "custodies": of["gardes_a_vue"], "facts": of["chronologie_faits"], "statements": of["declarations"],
        "divergences": of["divergences"], "personality": personality(suspects, d.pages, d.pieces), "findings": of["signalements"], "contradictions": of["contradictions"], "report": report})
    rows = [df.select("dossier_id", F.lit(name).alias("livrable"), F.to_json(F.struct(*[x_ for x_ in df.columns if x_ != "dossier_id"])).alias("ligne")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


@query("case_payload")
def case_payload(d):
    """Every section of every case, in parts of a thousand rows."""
    return sinks.case_payload(sections(d))


@query("run_totals", views=("runs",), sql="""
, o_r AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, etape ORDER BY run_id DESC, debut DESC, fin DESC, tokens_in DESC, tokens_out DESC, cout_usd DESC) AS rn FROM cf_runs)
SELECT dossier_id, CAST(sum(epoch(fin) - epoch(debut)) AS BIGINT) AS duree_s, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cout_usd), 4) AS cout_usd
FROM o_r WHERE rn = 1 GROUP BY dossier_id""")
def run_totals(d):
    """Seconds, tokens and cost of the latest run of every stage, added up."""
    return rp.cost_totals(rp.run_costs(d.runs)).withColumn("cout_usd", F.round("cout_usd", 4))


# --- streaming ---------------------------------------------------------------

@query("orphan_runs", views=("heartbeats",), sql="""
, o_l AS (SELECT dossier_id, arg_max(statut, mis_a_jour_le) AS statut, max(mis_a_jour_le) AS mis_a_jour_le FROM cf_heartbeats GROUP BY ALL)
SELECT * FROM o_l WHERE CASE statut WHEN 'en_cours' THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(mis_a_jour_le) > 300000000 WHEN 'en_attente' THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(mis_a_jour_le) > 1800000000 ELSE FALSE END""")
def orphan_runs(d):
    return jobs.orphans(d.heartbeats.withColumn("mis_a_jour_le", F.col("mis_a_jour_le").cast("timestamp")), F.lit("2024-02-01 00:00:00").cast("timestamp")).withColumn(
        "mis_a_jour_le", F.col("mis_a_jour_le").cast("timestamp_ntz"))
