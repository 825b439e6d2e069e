"""Case-file views derived from the generic driver tables.

The driver tables hold no case-file text, so each view is a SQL projection that
turns their rows into case-file rows; the volume follows the tables.  The text
of a view is valid both for Spark SQL and for DuckDB (``lpad``, ``split_part``,
``chr``, date + int behave alike), so a query and its SQL check start from the
same rows.  All views are projections: no shuffle happens before an operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

PAGES_PER_CASE = 18
EVENTS_PER_CASE = 24


def _text(template: str) -> str:
    """``Le {d1} à …`` → a SQL concatenation; line breaks become chr(10)."""
    parts: list[str] = []
    for piece in re.split(r"(\{\w+\}|\n)", template):
        if not piece:
            continue
        if piece == "\n":
            parts.append("chr(10)")
        elif piece.startswith("{"):
            parts.append(piece[1:-1])
        else:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


def _date(expr: str) -> str:
    return (
        f"lpad(CAST(day({expr}) AS STRING), 2, '0') || '/' || "
        f"lpad(CAST(month({expr}) AS STRING), 2, '0') || '/' || CAST(year({expr}) AS STRING)"
    )


def _two(expr: str) -> str:
    return f"lpad(CAST({expr} AS STRING), 2, '0')"


def _pick(values: str, index: str) -> str:
    n = len(values.split(","))
    return f"split_part('{values}', ',', CAST(({index}) % {n} AS INT) + 1)"


FOOTER = "\nN° PARQUET 2031/{k5}"

# One report per page position of a case (position 1..18).
TEMPLATES: dict[int, str] = {
    1: "PROCÈS-VERBAL DE SAISINE ET DE CONSTATATIONS\nCote D1\n"
       "Le {d1} à {hs}h00, nous, capitaine Anne BASTIER, de la brigade de gendarmerie de Valmont, sommes avisés d'un vol.\n"
       "Constatons la présence du véhicule immatriculé {plate} devant le {num} rue des Lilas, propriété de {V}.\n"
       "Le témoin {T} nous remet le numéro {tel}." + FOOTER,
    2: "PROCÈS-VERBAL D'INTERPELLATION\nCOTE : D. 2\n"
       "Le {d1} à {hi}h50, nous, Gilles GAUTHIER, agent de police judiciaire au commissariat de Valmont, "
       "interpellons le nommé {na} {pa}, né le {birth} à Lyon, demeurant 12 rue des Acacias.\n"
       "L'individu circulait à bord du véhicule {plate}. Il remet spontanément son téléphone." + FOOTER,
    3: "D.3\nPROCÈS-VERBAL DE PLACEMENT EN GARDE À VUE\nFeuillet 1/2\n"
       "Le {d1} à {hp}h15, nous notifions à {A} son placement en garde à vue pour des faits de vol.\n"
       "Interpellation effectuée le {d1} à {hi}h{mi}, en flagrance.\n"
       "À {hp}h20, nous avisons Monsieur le Procureur de la République." + FOOTER,
    4: "PROCÈS-VERBAL DE PLACEMENT EN GARDE À VUE\nFeuillet 2/2\n"
       "À {hp}h25, nous contactons la permanence du barreau. Maître VIDAL est informé.\n"
       "L'intéressé demande un examen médical. Lecture faite, il signe avec nous." + FOOTER,
    5: "PROCÈS-VERBAL DE NOTIFICATION DES DROITS\nCote n° D 5\n"
       "Le {d1} à {hp}h20, nous notifions à {A} les droits prévus par la loi.\n"
       "Il ne souhaite pas faire prévenir un proche. L'acte est lu par M. Paul DURAND." + FOOTER,
    6: "CERTIFICAT MÉDICAL\nD 6\n"
       "Je soussigné, Docteur Agathe MERCIER, certifie sur réquisition du {d1} reçue à {hp}h30 avoir vu {A}.\n"
       "La personne a été examinée ; elle a été examiné ce jour {d1} à {ha}h45 dans nos locaux.\n"
       "État compatible avec la mesure. Fin de la visite à {hocr}." + FOOTER,
    7: "PROCÈS-VERBAL D'ENTRETIEN AVEC UN AVOCAT\nCote D7\n"
       "Demande d'entretien formulée le {d1} à {hp}h25 par {A}. Entretien réalisé le {d1} de {ha}h00 à {ha}h30." + FOOTER,
    8: "PROCÈS-VERBAL D'AUDITION\n{A} (MIS EN CAUSE)\nCote D8\n"
       "Le {d1}, audition débutée à {hb}h40, close à {hc}h50.\n"
       "Question : À quelle heure êtes-vous arrivé sur les lieux ?\n"
       "Réponse : Je suis arrivé vers {q1} heures\net je suis reparti ensuite.\n"
       "Q. Connaissez-vous {V} ?\nR. Oui, depuis deux ans. Son numéro est le {tel}.\n"
       "Question : Avez-vous vu la voiture {plate}\nstationnée dans la rue ?\n"
       "Réponse : Non, je n'ai rien vu" + FOOTER,
    9: "de particulier ce soir-là.\n"
       "Question : Qui vous accompagnait ? Réponse : J'étais seul.\n"
       "D 12\nR : Je le répète.\n"
       "D : Quelle était la couleur de la voiture ?\nR : Elle était grise." + FOOTER,
    10: "PROCÈS-VERBAL DE PERQUISITION\nCote D10\n"
        "Le {d1} de {hq}h20 à {hr}h10, nous procédons à la perquisition du domicile de {A}.\n"
        "Scellé n° 3 (sac noir de 20 cm)\nMORVAN-DEUX Sweat à capuche gris\n"
        "L'occupant donne son assentiment exprès." + FOOTER,
    11: "PROCÈS-VERBAL D'AUDITION DE TÉMOIN\nPersonne entendue : {nt} {pt}\nCote D11\n"
        "Le {d1} à {hc}h05, nous entendons {T}, voisin, en nos locaux du commissariat de Valmont.\n"
        "Question : À quelle heure le véhicule est-il arrivé ?\n"
        "Réponse : Le véhicule {plateb} est arrivé vers vingt-deux heures.\n"
        "Question : Quel est votre numéro ?\nRéponse : C'est le {telb}." + FOOTER,
    12: "PROCÈS-VERBAL DE PROLONGATION DE GARDE À VUE\nCote D12/1\n"
        "L'an deux mille trente et un, le {jl} {mois} à {ha} heures 30, l'autorisation est accordée par le procureur "
        "pour {A} sans présentation préalable." + FOOTER,
    13: "PROCÈS-VERBAL D'AUDITION\n{A} (MIS EN CAUSE)\nCote D13\n"
        "Le {d2}, audition débutée à {hb}h10.\n"
        "Question : À quelle heure êtes-vous arrivé ?\nRéponse : Je suis arrivé vers {q2} heures.\n"
        "Question : Connaissez-vous {V} ?\nRéponse : Oui, depuis deux ans. Son numéro est le {tel}.\n"
        "Audition close à {hc}h30." + FOOTER,
    14: "PROCÈS-VERBAL DE CONFRONTATION\nCote D14\n"
        "Le {d2} à 16h00, nous procédons à la confrontation.\n"
        "Question à {A} : Étiez-vous sur place ?\nRéponse de {A} : Non, pas ce soir-là.\n"
        "Question à {T} : Le reconnaissez-vous ?\nRéponse de {T} : Oui, c'est lui.\n"
        "Réponse de Jean INCONNU : Je ne sais pas." + FOOTER,
    15: "PROCÈS-VERBAL D'EXPLOITATION\nCote D15\n"
        "Le {d2} à 18h00, nous exploitons le scellé n° 3 (sac {coul} de {mes} cm) et le scellé MORVAN-DEUX (sweat {coul} à capuche).\n"
        "Le téléphone {teld} figure au répertoire ; virement vers FR76 3000 4000 {iban} 0000 123.\n"
        "L'adresse du {num} rue des Lilas y est notée." + FOOTER,
    16: "PROCÈS-VERBAL DE FIN DE GARDE À VUE\nCote D16\n"
        "Le {dfin} à {hf}h15, nous mettons fin à la garde à vue de {A} et le remettons en liberté." + FOOTER,
    17: "De : comptabilité\nObjet : règlement\nMadame, le montant de {num} euros a été réglé le {d1} à la société ORBIS.\n"
        "Contact : {tel} ou 4 avenue du Général Leclerc",
    18: "Cabinet de Maître Vidal, toque 12\nÀ faire : demander la copie de l'enregistrement.\n"
        "Notes de parloir du {d2} : le client évoque le numéro {telb}.",
}

GARBLED = (
    "Je SusSiha DŒt dr Mrchag certlfie #WOir eXarire ce pur Mnsr en1pr9es qi pst b dgr "
    "xkrtv qzrtp nb1d3s @ la srtgh vcxzm plqrs e r t v w"
)

VIEWS: dict[str, str] = {}

VIEWS["cf_base"] = f"""
SELECT o_orderkey AS rk, CAST(floor(o_orderkey / {PAGES_PER_CASE}) AS BIGINT) AS k,
       CAST(o_orderkey % {PAGES_PER_CASE} AS INT) + 1 AS n, o_custkey AS ck
FROM {{orders}}"""

VIEWS["cf_vars"] = f"""
SELECT rk, k, n, ck, 'C' || lpad(CAST(k AS STRING), 12, '0') AS dossier_id,
  lpad(CAST(k % 100000 AS STRING), 5, '0') AS k5,
  {_date("DATE '2031-01-05' + CAST(k % 330 AS INT)")} AS d1,
  {_date("DATE '2031-01-06' + CAST(k % 330 AS INT)")} AS d2,
  {_date("DATE '2031-01-05' + CAST(k % 330 + 1 + k % 3 AS INT)")} AS dfin,
  {_date("DATE '1995-03-01' + CAST((k * 37) % 7300 AS INT)")} AS birth,
  CAST(day(DATE '2031-01-06' + CAST(k % 330 AS INT)) AS STRING) AS jl,
  split_part('janvier,février,mars,avril,mai,juin,juillet,août,septembre,octobre,novembre,décembre', ',',
             CAST(month(DATE '2031-01-06' + CAST(k % 330 AS INT)) AS INT)) AS mois,
  {_pick("Julien,Marc,Élodie,Karim,Sofiane,Jérôme,Yanis,Paul,Camille,Kevin", "k")} AS pa,
  {_pick("MORVANNEC,DERRADJI,BENALI,TARDIEU,LEROY,VASSEUR,CARON,BOUCHARD,SERMET", "k")} AS na,
  {_pick("Odile,René,Agnès,Lucas,Nadia", "k")} || ' ' || {_pick("CHABERT,MARTIN,ARZANO,GIRARD", "k")} AS V,
  {_pick("Hugo,Louise,Antoine,Claire", "k")} AS pt, {_pick("ROQUIER,FONTAINE,LEROUX", "k")} AS nt,
  {_two("6 + (k % 5) * 2")} AS hs, {_two("6 + k % 4")} AS hi, {_two("7 + k % 4")} AS hp,
  CASE WHEN k % 4 = 0 THEN '05' ELSE '50' END AS mi,
  {_two("9 + k % 4")} AS ha, {_two("11 + k % 4")} AS hb, {_two("12 + k % 4")} AS hc,
  {_two("4 + (k % 10) * 2")} AS hq, {_two("5 + (k % 9) * 2")} AS hr, {_two("8 + k % 12")} AS hf,
  CASE WHEN ck % 3 = 0 THEN '6' || CAST(8 + k % 2 AS STRING) || 'h00'
       WHEN ck % 3 = 1 THEN '14F30' ELSE '17h45' END AS hocr,
  CAST(20 + k % 3 AS STRING) AS q1, CAST(21 + k % 2 AS STRING) AS q2,
  CAST(1 + k % 97 AS STRING) AS num,
  'GH-' || lpad(CAST((k * 7) % 1000 AS STRING), 3, '0') || '-KL' AS plate,
  'GH-' || CASE WHEN k % 2 = 0 THEN lpad(CAST((k * 7) % 1000 AS STRING), 3, '0')
           ELSE substr(lpad(CAST((k * 7) % 1000 AS STRING), 3, '0'), 1, 1)
             || substr(lpad(CAST((k * 7) % 1000 AS STRING), 3, '0'), 3, 1)
             || substr(lpad(CAST((k * 7) % 1000 AS STRING), 3, '0'), 2, 1) END || '-KL' AS plateb,
  '06 ' || {_two("k % 100")} || ' ' || {_two("(k * 3) % 100")} || ' 77 66' AS tel,
  '06 ' || {_two("k % 100")} || ' ' || {_two("(k * 3) % 100")} || ' 77 6' || CAST(6 + k % 3 AS STRING) AS telb,
  '06.' || {_two("k % 100")} || '.' || {_two("(k * 3) % 100")} || '.77.66' AS teld,
  lpad(CAST(k % 10000 AS STRING), 4, '0') AS iban,
  {_pick("noir,rouge,gris", "k")} AS coul, {_pick("20,25", "k")} AS mes
FROM cf_base"""

VIEWS["cf_names"] = "SELECT *, pa || ' ' || na AS A, pt || ' ' || nt AS T FROM cf_vars"

VIEWS["cf_pages"] = (
    "SELECT dossier_id, n AS numero_global,\n"
    "  CASE WHEN n <= 9 THEN 'tome1.pdf' WHEN n <= 16 THEN 'tome2.pdf' ELSE 'annexe' || CAST(n AS STRING) || '.pdf' END AS fichier_source,\n"
    "  CASE WHEN n <= 9 THEN n WHEN n <= 16 THEN n - 9 ELSE 1 END AS page_fichier,\n"
    f"  CASE WHEN ck % 23 = 5 THEN '{GARBLED}' ELSE CASE n\n"
    + "\n".join(f"    WHEN {n} THEN {_text(t)}" for n, t in TEMPLATES.items())
    + "\n  END END AS texte, ck % 7 = 0 AS ocr_applique\nFROM cf_names"
)

# The pieces of a case as a finished table (position, type, dates), for the
# operators that read pieces rather than derive them.
_PIECES = {
    1: ("PV de saisine", 1, "D1"), 2: ("PV d'interpellation", 2, "D2"),
    3: ("PV de notification de placement en garde à vue", 4, "D3"), 5: ("PV de notification des droits", 5, "D5"),
    6: ("Certificat médical", 6, None), 7: ("PV d'entretien avocat", 7, "D7"), 8: ("PV d'audition", 9, "D8"),
    10: ("PV de perquisition", 10, "D10"), 11: ("PV d'audition", 11, "D11"),
    12: ("PV de prolongation de garde à vue", 12, "D12"), 13: ("PV d'audition", 13, "D13"),
    14: ("PV de confrontation", 14, "D14"), 15: ("PV d'exploitation", 15, None),
    16: ("PV de fin de garde à vue", 16, "D16"), 17: ("Non identifié", 17, None),
    18: ("Document de l'avocat (hors procédure)", 18, None),
}


def _case(column: str, values: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {key} THEN {value}" for key, value in values.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _quote(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


VIEWS["cf_pieces"] = f"""
SELECT dossier_id, n AS piece_id, n AS page_debut,
  {_case("n", {n: p[1] for n, p in _PIECES.items()})} AS page_fin,
  {_case("n", {n: _quote(p[0]) for n, p in _PIECES.items()})} AS type,
  {_case("n", {n: _quote(p[2]) for n, p in _PIECES.items()})} AS cote,
  CASE WHEN n IN (6, 17, 18) OR ck % 13 = 0 THEN NULL WHEN n <= 11 THEN d1 WHEN n = 16 THEN dfin ELSE d2 END AS date_apparente,
  CASE WHEN n IN (6, 17, 18) OR ck % 5 = 0 THEN NULL WHEN n <= 4 THEN hi || 'h50' WHEN n <= 11 THEN hb || 'h40' ELSE ha || 'h30' END AS heure_apparente,
  CASE WHEN n IN (1, 2, 11) AND ck % 3 > 0 THEN 'brigade de gendarmerie de Valmont' END AS service_redacteur,
  CAST(CASE WHEN n = 17 THEN 0.0 WHEN ck % 11 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS confiance,
  CASE WHEN n IN (1, 14, 15, 17, 18) THEN NULL WHEN n = 11 THEN 'P4' ELSE 'P1' END AS personne_principale_id
FROM cf_names WHERE n IN ({", ".join(str(n) for n in _PIECES)})"""

VIEWS["cf_page_pieces"] = """
SELECT dossier_id, n AS page, CASE n WHEN 4 THEN 3 WHEN 9 THEN 8 ELSE n END AS piece_id FROM cf_names"""

_ACTS = (
    "interpellation,placement_garde_a_vue,notification_droits,avis_parquet,avis_avocat,demande_examen_medical,"
    "demande_entretien_avocat,demande_interprete,demande_avis_famille,realisation_examen_medical,"
    "realisation_entretien_avocat,debut_audition,fin_audition,avis_famille,fouille_integrale,debut_perquisition,"
    "fin_perquisition,prolongation_garde_a_vue,debut_audition,propos_hors_audition,placement_garde_a_vue,"
    "notification_droits,fin_garde_a_vue,interpellation"
)
_OFFSETS = "-40,0,5,20,30,35,40,45,50,110,150,125,260,300,310,330,380,1380,1430,1520,30,60,1000,-40"

VIEWS["cf_event_base"] = f"""
SELECT event_id, CAST(floor(event_id / {EVENTS_PER_CASE}) AS BIGINT) AS k, CAST(event_id % {EVENTS_PER_CASE} AS INT) AS i,
  user_id AS u, ts, event_type, CAST(floor(value * 100) AS BIGINT) AS v,
  'C' || lpad(CAST(CAST(floor(event_id / {EVENTS_PER_CASE}) AS BIGINT) AS STRING), 12, '0') AS dossier_id
FROM {{events}}"""

VIEWS["cf_act_base"] = f"""
SELECT *, {_pick(_ACTS, "i")} AS nature,
  480 + CAST({_pick(_OFFSETS, "i")} AS BIGINT) + u % 45 + CASE WHEN i = 22 THEN 700 * (k % 5) WHEN i = 17 THEN (u % 10) * 12 ELSE 0 END AS t
FROM cf_event_base"""

VIEWS["cf_acts"] = f"""
SELECT dossier_id, i + 1 AS acte_id, CAST(floor(i / 2) AS INT) + 1 AS piece_id, nature,
  CASE WHEN k % 29 = 0 OR u % 31 = 7 THEN NULL
       ELSE {_date("DATE '2031-02-01' + CAST(k % 300 + floor(t / 1440) AS INT)")} END AS date,
  CASE WHEN u % 37 = 5 THEN NULL ELSE {_two("CAST(floor((t % 1440) / 60) AS INT)")} || 'h' || {_two("CAST(t % 60 AS INT)")} END AS heure,
  i + 1 AS page,
  CASE WHEN i = 19 AND u % 2 = 0 THEN 'Mme DERRADJI Nadia déclare spontanément : « Il est rentré tard »'
       WHEN i = 19 THEN 'M. TARKAN déclare : « Je n''ai rien fait »'
       ELSE 'Mention ' || nature || ' numéro ' || CAST(u AS STRING) END AS citation,
  CASE WHEN u % 19 = 3 THEN NULL WHEN i IN (20, 21) THEN CASE WHEN k % 3 = 0 THEN 'P2' ELSE 'P1' END ELSE 'P1' END AS personne_id,
  CASE WHEN u % 10 = 4 THEN 'rejete' ELSE 'verifie' END AS statut_verif,
  CASE WHEN u % 9 = 0 THEN 'floue_ocr' ELSE 'exacte' END AS methode_verif,
  CASE WHEN i = 14 AND u % 3 = 0 THEN 'APJ' WHEN i = 14 AND u % 3 = 1 THEN 'OPJ'
       WHEN i = 17 AND u % 4 = 0 THEN 'OPJ' WHEN i = 17 AND u % 4 = 1 THEN 'procureur' WHEN i = 17 AND u % 4 = 2 THEN 'APJ' END AS agent,
  CASE WHEN i IN (11, 18, 19) AND u % 3 = 0 THEN 'absent' END AS avocat,
  CASE WHEN i IN (2, 11) AND u % 4 = 0 THEN 'absent' WHEN i IN (2, 11) AND u % 4 = 1 THEN 'present' END AS interprete,
  CASE WHEN i = 17 AND u % 5 = 0 THEN 'non' WHEN i = 17 AND u % 5 = 1 THEN 'oui' END AS presentation,
  CASE WHEN i = 15 AND u % 3 = 0 THEN 'non' WHEN i = 15 AND u % 3 = 1 THEN 'oui' END AS assentiment,
  CASE WHEN i = 15 AND u % 5 = 0 THEN 'oui' END AS autorisation_juge,
  CASE WHEN i = 15 AND u % 2 = 0 THEN 'preliminaire' WHEN i = 15 THEN 'flagrance' END AS cadre
FROM cf_act_base"""

VIEWS["cf_persons"] = f"""
SELECT dossier_id, 'P' || CAST(i + 1 AS STRING) AS personne_id,
  CASE i WHEN 0 THEN 'Selim TARKAN' WHEN 1 THEN 'Yanis DERRADJI'
         WHEN 2 THEN {_pick("Odile CHABERT,René MARTIN,Camille ARZANO", "k")} ELSE {_pick("Paul LEROUX,Claire FONTAINE", "k")} END AS nom,
  CASE i WHEN 0 THEN 'mis_en_cause' WHEN 1 THEN 'mis_en_cause' WHEN 2 THEN 'victime' ELSE 'témoin' END AS role,
  (i = 1 AND k % 4 = 0) OR (i = 0 AND k % 4 = 1) AS est_client
FROM cf_event_base WHERE i < 4"""

VIEWS["cf_spellings"] = f"""
SELECT dossier_id, i + 1 AS personne_id,
  {_pick("Yanis DERRADJI,DERRADIJI Yanis,Yanis DERRADII,Karim DERRADJI,Lucas MARTIN,Lucas MARTINEZ,Paul MARTIN,Élodie BASTIER,Elodie BASTIEN,Julien MORVANNEC,MORVANEC Julien", "u * 7 + i")} AS nom,
  CASE i % 3 WHEN 0 THEN 'témoin' WHEN 1 THEN 'mis_en_cause' ELSE 'victime' END AS role, i = 2 AS est_client
FROM cf_event_base WHERE i < 8"""

VIEWS["cf_free_names"] = f"""
SELECT dossier_id, event_id AS nom_id,
  {_pick("Yanis DERRADJI,derradji yanis,DERRADII Yanis,TARKAN Selim,Selim TARKANE,Paul INCONNU,TARKAN,Odile CHABERT,chabert ODILE", "u + i")} AS nom_libre
FROM cf_event_base"""

VIEWS["cf_act_pieces"] = f"""
SELECT dossier_id, CAST(floor(i / 2) AS INT) + 1 AS piece_id, i + 1 AS page_debut, i + 2 AS page_fin,
  CASE CAST(floor(i / 2) AS INT) + 1 WHEN 1 THEN 'PV de saisine' WHEN 2 THEN 'PV de notification de placement en garde à vue'
    WHEN 3 THEN CASE WHEN k % 5 = 0 THEN 'PV d''entretien avocat' ELSE 'PV d''audition' END
    WHEN 9 THEN CASE WHEN k % 2 = 0 THEN 'PV de prolongation de garde à vue' ELSE 'PV de renseignement' END
    WHEN 12 THEN 'Réquisitoire introductif' ELSE 'PV d''audition' END AS type,
  'D' || CAST(CAST(floor(i / 2) AS INT) + 1 AS STRING) AS cote,
  {_date("DATE '2031-02-01' + CAST(k % 300 AS INT)")} AS date_apparente,
  {_two("CAST(7 + k % 3 AS INT)")} || 'h45' AS heure_apparente,
  'Saisine du service' AS citation,
  CASE WHEN u % 6 = 0 THEN 'P2' ELSE 'P1' END AS personne_principale_id
FROM cf_event_base WHERE i % 2 = 0"""

VIEWS["cf_declarations"] = f"""
SELECT dossier_id, i + 1 AS declaration_id,
  CASE WHEN u % 23 = 1 THEN NULL ELSE 'P' || CAST(u % 4 + 1 AS STRING) END AS personne_id,
  CAST(floor(i / 3) AS INT) + 1 AS piece_id, CAST(floor(i / 2) AS INT) + 1 AS page,
  {_pick("heure d’arrivée sur les lieux,couleur de la voiture,lien avec la victime", "v")} AS point_factuel,
  'Je suis venu vers ' || CAST(18 + v % 4 AS STRING) || 'h00' AS citation,
  CASE WHEN u % 10 = 4 THEN 'rejete' ELSE 'verifie' END AS statut_verif,
  CASE WHEN u % 9 = 0 THEN 'floue_ocr' ELSE 'exacte' END AS methode_verif
FROM cf_event_base"""

VIEWS["cf_faits"] = f"""
SELECT dossier_id, i + 1 AS fait_id, CAST(floor(i / 2) AS INT) + 1 AS piece_id, CAST(floor(i / 2) AS INT) + 1 AS page,
  'La voiture numéro ' || CAST(v % 50 AS STRING) || ' est passée' AS citation,
  CASE WHEN u % 3 = 0 THEN NULL ELSE 'P' || CAST(u % 4 + 1 AS STRING) END AS personne_id_source,
  'Passage du véhicule' AS description,
  CASE WHEN u % 8 = 4 THEN 'rejete' ELSE 'verifie' END AS statut_verif,
  CASE WHEN u % 9 = 0 THEN 'floue_ocr' ELSE 'exacte' END AS methode_verif
FROM cf_event_base"""

VIEWS["cf_documents"] = """
SELECT 'S' || source AS dossier_id, doc_id AS numero_global, text AS texte, doc_id % 3 = 0 AS ocr_applique FROM {documents}"""

VIEWS["cf_runs"] = """
SELECT CAST(l_orderkey AS STRING) AS dossier_id,
  split_part('ingest,classify,chrono,decl,build', ',', CAST(l_linenumber % 5 AS INT) + 1) AS etape,
  l_partkey * 100000 + l_suppkey AS run_id, l_shipdate AS debut,
  l_shipdate + INTERVAL '90' SECOND AS fin, l_partkey AS tokens_in, l_suppkey AS tokens_out,
  l_extendedprice AS cout_usd
FROM {lineitem}"""

VIEWS["cf_calls"] = """
SELECT 'modele-' || l_returnflag AS modele, l_discount >= 0.1 AS echec, l_partkey AS tokens_in, l_suppkey AS tokens_out,
  l_quantity AS secondes FROM {lineitem}"""

VIEWS["cf_files"] = """
SELECT 'C' || lpad(CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING), 12, '0') AS dossier_id, CAST(p_partkey % 8 AS INT) + 1 AS rang,
  split_part('PV.pdf,PV_2.pdf,audition.pdf,PV.pdf,facture.pdf', ',', CAST((p_size + p_partkey) % 5 AS INT) + 1) AS nom,
  CAST(p_size + p_partkey % 9 AS BIGINT) AS taille_mo, CAST(p_partkey * 7 % 110 AS BIGINT) AS pages,
  p_size % 19 = 3 AS protege, p_size % 23 <> 5 AS lisible
FROM {part}"""

VIEWS["cf_heartbeats"] = """
SELECT 'U' || CAST(user_id AS STRING) AS dossier_id,
  CASE event_type WHEN 'click' THEN 'en_attente' WHEN 'view' THEN 'en_cours' WHEN 'error' THEN 'erreur' ELSE 'en_cours' END AS statut,
  ts AS mis_a_jour_le, event_id FROM {events}"""

DRIVER_TABLES = ("orders", "events", "documents", "lineitem", "part", "conversations", "pages", "customer")


def _dependencies(name: str, found: list[str]) -> list[str]:
    for other in VIEWS:
        if other != name and other not in found and re.search(rf"\b{other}\b", VIEWS[name]):
            _dependencies(other, found)
    if name not in found:
        found.append(name)
    return found


def with_clause(*names: str) -> str:
    """``WITH a AS (…), b AS (…)`` for the views and all they read, tables by name."""
    order: list[str] = []
    for name in names:
        _dependencies(name, order)
    tables = {t: t for t in DRIVER_TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in order)


# Tables of keys that case files of text are made from.
_TABLE_KEYS = {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey", "part": "p_partkey"}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; keys that text is made from are dealt out first, while they are small."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in _TABLE_KEYS:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _TABLE_KEYS[name])
    return df


def view(spark: SparkSession, sf_dir: str, name: str, texts: bool = True) -> DataFrame:
    """One case-file view as a DataFrame over the driver's parquet files; without ``texts`` the pages come without them."""
    order = _dependencies(name, [])
    used = [t for t in DRIVER_TABLES if any("{" + t + "}" in VIEWS[n] for n in order)]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    df = spark.sql(f"WITH {ctes} SELECT * FROM {name}", **{t: driver_table(spark, sf_dir, t) for t in used})
    if name == "cf_pages":
        # Keep the template out of the operators' expressions: a page text read
        # from a table is a plain column, and so it is here once generated.
        others = [c for c in df.columns if c != "texte"]
        df = df.select(*others) if not texts else df.select(*others, F.explode(F.array("texte")).alias("texte"))
    return df
