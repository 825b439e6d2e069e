"""Word lists, lookup tables, thresholds and patterns.

These must equal the published ones for the results to be right, so they are
stated plainly and together.  Patterns are written for the JVM regex engine:
``(?U)`` makes classes Unicode-aware, ``(?i)`` ignores case.
"""

from __future__ import annotations

# --- Fixed values: dates and hours ------------------------------------------

MOIS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
NOMS_MOIS = "|".join(MOIS)
DATE = rf"(\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}(?:er)?\s+(?:{NOMS_MOIS})\s+\d{{4}})"
HEURE = r"(\d{1,2}\s*[hH]\s*\d{2})"
UNITES = {
    "zéro": 0, "zero": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7,
    "huit": 8, "neuf": 9,
}
DIX_A_DIX_NEUF = {
    "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "dix-sept": 17, "dix-huit": 18, "dix-neuf": 19,
}
DIZAINES = {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60}

# --- Fixed values: reference marks and page layout --------------------------

RE_COTE = r"(?iU)\bcote\b\s*(?:n[°ºo]\.?\s*)?[:.]?\s*([A-Za-z]?)\s*[.\-]?\s*(\d{1,6})(?:\s*/\s*(\d{1,4}))?(?![\d/])"
RE_TAMPON_COTE = r"(?U)^([A-DP])\s?[.\-]?\s?(\d{1,5})(?:\s?/\s?(\d{1,4}))?$"
RE_LIGNE_COTE = r"(?iU)^cote\s*(?:n[°ºo]\.?\s*)?[:.]?\s*[A-Za-z]?\s*[.\-]?\s*\d{1,6}(?:\s*/\s*\d{1,4})?$"
LIGNES_DE_MARGE = 3
RE_NUM_PROCEDURE = r"(?iU)N[°ºo]\s*PARQUET\s*([\d/]+)"
PIED_PARQUET = "N° PARQUET"
_DE_TITRE = r"[A-ZÀ-Ÿ0-9°'’«»()/\-–—\s.,]"
RE_TITRE = rf"(?U)^{_DE_TITRE}{{8,}}$"
RE_SUFFIXE_COLONNE = r"(?iU)\s+(Feuillet\b.*|Date\s*:.*|Heure\b.*|N°\s*\S*\s*:.*)$"
PARASITES_BORD = "_|~•*·`¦"
RE_DEBUT_TITRE = rf"(?U)^\s*[{PARASITES_BORD}]*\s*{_DE_TITRE}{{8}}"
RE_METADONNEE_ENTETE = r"(?iU)^(N°\s|N°$|FEUILLET\b|DATE\b|HEURE\b|PROCÉDURE\b|[A-Za-zÀ-ÿ°'\s]{1,30}:\s*\S)"
RE_MOT_PLEIN = r"[A-Za-zÀ-ÿ]{3,}"
RE_FEUILLET = r"(?iU)\b(?:Feuillet|Page)\s*(?:n[°o]\s*)?(\d{1,3})\s*/\s*(\d{1,3})\b"
RE_DOCUMENT_AVOCAT = (
    r"(?iU)\bparloir\b|cabinet\s+de\s+ma[îi]tre|\btoque\b|[àa]\s+faire\s*:|notes?\s+d['’]entretien|\bhonoraires\b"
)
RE_PROCES_VERBAL = r"(?iU)PROC[ÈE]S[- ]?VERBAL|\bNous,\s"
RE_OBJET = r"(?iU)\bObjet\s*:\s*([^\n]{4,120})"
RE_INTITULE_FORT = (
    r"(?U)^\s*(?:BORDEREAU|INVENTAIRE|PROC[ÈE]S[- ]VERBAL\s+D|ORDONNANCE|R[ÉE]QUISITOIRE|CERTIFICAT|AUTORISATION|RAPPORT)"
    r"[^a-z]{4,}$"
)
LIGNES_FRONTIERE, LIGNES_BRUIT, LIGNES_FEUILLET, LIGNES_TETE = 3, 6, 15, 6
FIN_PHRASE = r"(?U)(?<!\b[A-ZÀ-Ÿ])\.(?=\s|$)|\u2029"
SEPARATEUR = "\u2029"

# --- Fixed values: piece types ----------------------------------------------

NON_IDENTIFIE = "Non identifié"
BORDEREAU = "Bordereau / inventaire des pièces"
DOCUMENT_AVOCAT = "Document de l'avocat (hors procédure)"
TYPES_HORS_PROCEDURE = (BORDEREAU, DOCUMENT_AVOCAT)
CATEGORIES = (
    "PV d'audition", "PV d'audition libre", "PV de plainte", "PV d'interpellation", "PV de surveillance",
    "PV de notification de placement en garde à vue", "PV de notification des droits",
    "PV de prolongation de garde à vue", "PV de fin de garde à vue", "Certificat médical", "PV d'entretien avocat",
    "PV de perquisition", "PV de saisie", "PV de constatations", "PV de saisine", "PV de synthèse",
    "PV de confrontation", "PV de renseignement", "PV de placement sous scellés", "PV d'exploitation",
    "PV d'enquête de voisinage", "PV de découverte", "PV de restitution", "PV d'identification", "PV de recherches",
    "Ordonnance du juge des libertés et de la détention", "Réquisition", "Réquisitoire introductif",
    "PV d'interrogatoire de première comparution", "Rapport d'expertise", "Analyse téléphonique", "Retranscription",
    "Soit-transmis", "Enquête de personnalité", "Casier judiciaire", "Relevé bancaire", "Facture",
    "Signalement (article 40 CPP ou L.823-12 du Code de commerce)", "Correspondance saisie (e-mail, courrier, SMS)",
    "Pièce de procédure – autre", BORDEREAU, DOCUMENT_AVOCAT, NON_IDENTIFIE,
)
# Ordered keyword rules: the first one whose words all occur gives the type.
REGLES_TYPE: tuple[tuple[tuple[str, ...], str], ...] = (
    (("BORDEREAU",), BORDEREAU),
    (("INVENTAIRE DES PIECES",), BORDEREAU),
    (("NOTIFICATION", "PLACEMENT", "GARDE A VUE"), "PV de notification de placement en garde à vue"),
    (("NOTIFICATION", "MESURE", "GARDE A VUE"), "PV de notification de placement en garde à vue"),
    (("NOTIFICATION", "DROITS"), "PV de notification des droits"),
    (("PROLONGATION", "GARDE A VUE"), "PV de prolongation de garde à vue"),
    (("FIN DE GARDE A VUE",), "PV de fin de garde à vue"),
    (("PLACEMENT", "GARDE A VUE"), "PV de notification de placement en garde à vue"),
    (("VERBAL DE SAISINE",), "PV de saisine"),
    (("INTERPELLATION",), "PV d'interpellation"),
    (("SURVEILLANCE",), "PV de surveillance"),
    (("CERTIFICAT MEDICAL",), "Certificat médical"),
    (("ENTRETIEN", "AVOCAT"), "PV d'entretien avocat"),
    (("PERQUISITION",), "PV de perquisition"),
    (("SAISIE",), "PV de saisie"),
    (("CONSTATATIONS",), "PV de constatations"),
    (("SYNTHESE",), "PV de synthèse"),
    (("SOIT-TRANSMIS",), "Soit-transmis"),
    (("ENQUETE DE PERSONNALITE",), "Enquête de personnalité"),
    (("CASIER JUDICIAIRE",), "Casier judiciaire"),
    (("AUTORISATION", "INTERCEPTION"), "Ordonnance du juge des libertés et de la détention"),
    (("DETENTION PROVISOIRE",), "Ordonnance du juge des libertés et de la détention"),
    (("REQUISITOIRE",), "Réquisitoire introductif"),
    (("REQUISITION",), "Réquisition"),
    (("INTERROGATOIRE", "COMPARUTION"), "PV d'interrogatoire de première comparution"),
    (("RAPPORT D'ANALYSE",), "Rapport d'expertise"),
    (("EXPERTISE",), "Rapport d'expertise"),
    (("ANALYSE TELEPHONIQUE",), "Analyse téléphonique"),
    (("TRANSCRIPTION",), "Retranscription"),
    (("CONFRONTATION",), "PV de confrontation"),
    (("DE PLAINTE",), "PV de plainte"),
    (("PLAIGNANT",), "PV de plainte"),
    (("AUDITION LIBRE",), "PV d'audition libre"),
    (("AUDITION",), "PV d'audition"),
    (("EXTRAIT DE COMPTE",), "Relevé bancaire"),
    (("RELEVE DE COMPTE",), "Relevé bancaire"),
    (("RELEVE BANCAIRE",), "Relevé bancaire"),
    (("FACTURE",), "Facture"),
    (("INVOICE",), "Facture"),
    (("SOUS SCELLES",), "PV de placement sous scellés"),
    (("ENQUETE DE VOISINAGE",), "PV d'enquête de voisinage"),
    (("VERBAL DE RENSEIGNEMENT",), "PV de renseignement"),
    (("VERBAL D'EXPLOITATION",), "PV d'exploitation"),
    (("VERBAL DE DECOUVERTE",), "PV de découverte"),
    (("VERBAL DE RESTITUTION",), "PV de restitution"),
    (("VERBAL D'IDENTIFICATION",), "PV d'identification"),
    (("VERBAL DE RECHERCHE",), "PV de recherches"),
)
SEUIL_CONFIANCE = 0.7
TYPES_AUDITION = ("PV d'audition", "PV d'audition libre", "PV de plainte")
TYPE_CONFRONTATION = "PV de confrontation"
TYPES_SANS_FAITS = (
    BORDEREAU, DOCUMENT_AVOCAT, "PV d'entretien avocat", "Réquisition", "Soit-transmis", "Enquête de personnalité",
    "Casier judiciaire",
)
TYPES_SANS_ACTES = (
    BORDEREAU, DOCUMENT_AVOCAT, "Relevé bancaire", "Facture", "Casier judiciaire", "Enquête de personnalité",
    "Correspondance saisie (e-mail, courrier, SMS)", "Analyse téléphonique", "Retranscription", "Rapport d'expertise",
    "PV de synthèse", "Signalement (article 40 CPP ou L.823-12 du Code de commerce)",
)
PIECES_PERSONNALITE = ("Enquête de personnalité", "Casier judiciaire")
TYPES_PREMIERE_MENTION = (
    "PV de notification de placement en garde à vue", "PV de notification des droits",
    "PV de prolongation de garde à vue", "PV de fin de garde à vue", "Certificat médical", "PV d'entretien avocat",
    "PV de perquisition", "PV d'interpellation",
)
NATURE_PAR_TYPE = {
    "PV d'interpellation": "interpellation",
    "PV de notification de placement en garde à vue": "placement_garde_a_vue",
    "PV de notification des droits": "notification_droits",
    "PV de prolongation de garde à vue": "prolongation_garde_a_vue",
    "PV de fin de garde à vue": "fin_garde_a_vue",
}

# --- Fixed values: persons --------------------------------------------------

RE_PERSONNE = r"(?U)\b([A-ZÀ-Ÿ][a-zà-ÿ]+)\s+([A-ZÀ-Ÿ]{2,}(?:-[A-ZÀ-Ÿ]{2,})?)\b"
RE_SERVICE = (
    r"(?iU)\b(brigade\s+de\s+gendarmerie\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ'-]+|commissariat\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ'-]+"
    r"|Procureur\s+de\s+la\s+République\s+de\s+[A-ZÀ-Ÿ][\wà-ÿ'-]+)\b"
)
PARTICULES = r"(?:LE|LA|DE|DU|DES|DA|DI|DOS|VAN|VON|DER|EL|BEN|AÏT|AIT|MAC|MC)"
MAJ, LETTRE = "A-ZÀ-ÖØ-Þ", "A-Za-zÀ-ÖØ-öø-ÿ"
RE_ROLE_TAG = (
    rf"(?U)(?<![{LETTRE}])((?!{PARTICULES}\s)[{MAJ}][{LETTRE}]+(?:-[{MAJ}][{LETTRE}]+)?)\s+"
    rf"((?:{PARTICULES}\s+)*[{MAJ}]{{2,}}(?:[-'][{MAJ}]{{2,}})*)\s*\((MIS EN CAUSE|VICTIME|TÉMOIN)\)"
)
ROLE_PAR_TAG = {"MIS EN CAUSE": "mis_en_cause", "VICTIME": "victime", "TÉMOIN": "témoin"}
ROLES_VALIDES = ("mis_en_cause", "victime", "témoin", "expert", "enqueteur")
PRIORITE_ROLE = {"mis_en_cause": 3, "victime": 2, "témoin": 1}
NOM_MAJUSCULES = r"[A-ZÀ-Ÿ]{2,}(?:-[A-ZÀ-Ÿ]{2,})?"
PRENOM = r"[A-ZÀ-Ÿ][a-zà-ÿ]+(?:-[A-ZÀ-Ÿ][a-zà-ÿ]+)?"
RE_PERSONNE_CHAMP = (
    r"(?U)\bPersonne(?:\s+(?:entendue|auditionn[ée]e|gard[ée]e\s+[àa]\s+vue|interpell[ée]e|concern[ée]e"
    r"|mise\s+en\s+cause|soup[çc]onn[ée]e))?\s*:\s*"
    rf"(?:({NOM_MAJUSCULES})\s+({PRENOM})|({PRENOM})\s+({NOM_MAJUSCULES})\b)"
)
RE_PERSONNE_ENTENDUE = (
    r"(?U)\b(?:entendons|auditionnons)\s+(?:(?:M\.|Mme|Mlle|Monsieur|Madame|Mademoiselle)\s+)?"
    rf"(?:({NOM_MAJUSCULES})\s+({PRENOM})|({PRENOM})\s+({NOM_MAJUSCULES})\b)"
)
RE_PERSONNE_DENOMMEE = (
    r"(?U)\b(?:d[ée]nomm[ée]e?|se\s+nomm(?:e|er|ant)|(?:au|du|le|la)\s+nomm[ée]e?)\b[^:\n]{0,20}:?\s+"
    rf"({NOM_MAJUSCULES})\s+({PRENOM})"
)
ROLES_PAR_INTITULE = (
    (r"\bGARDEE?\s+A\s+VUE\b|\bAUDITION\s+LIBRE\b|\bMIS\s+EN\s+CAUSE\b|\bSUSPECT|\bINTERROGATOIRE\b", "mis_en_cause"),
    (r"\bDE\s+PLAINTE\b|\bPLAIGNANTE?\b|\bVICTIME\b|\bPARTIE\s+CIVILE\b", "victime"),
    (r"\bTEMOIN\b", "témoin"),
)
TITRES_A_EXCLURE = (
    "capitaine", "commandant", "lieutenant", "colonel", "major", "brigadier", "adjudant", "gardien", "maréchal",
    "docteur", "maître", "monsieur", "madame", "procureur", "procureure", "vice-procureur", "substitut", "juge",
    "magistrat", "greffier", "greffière", "avocat", "avocate",
)
FONCTIONS_AVANT = ("agent", "officier")
RE_FONCTION_APRES = r"(?iU)^(?:agent|officier)s?\s+de\s+(?:la\s+)?(?:police|gendarmerie)"
HONORIFIQUES_ABREGES = ("me", "mme", "mlle", "m")
CIVILITES = TITRES_A_EXCLURE + HONORIFIQUES_ABREGES + ("dr", "pr", "professeur", "mademoiselle")
MAX_TRANCHES = 3
RE_NE_LE = r"(?U)né(?:e)?\s+le\s+(\d{2}/\d{2}/\d{4})\s+à\s+([A-ZÀ-Ÿ][\wà-ÿ'\-]+)"
RE_DEMEURANT = r"(?U)demeurant\s+([^,.\n]+)"

# --- Fixed values: act openings and procedural acts -------------------------

RE_OUVERTURE_LETTRES = (
    r"(?iU)\bl['’]an\s+(deux\s+mille(?:[\s-]+[a-zà-ÿ]+){0,3})\s*,\s*"
    rf"le\s+(\d{{1,2}}(?:er)?|[a-zà-ÿ]+(?:[\s-][a-zà-ÿ]+)?)\s+({NOMS_MOIS})(?:\s*,?\s+à\s+([^.,;\n]{{1,40}}))?"
)
# A date of birth or a recalled date is not that of the act.
_PAS_UNE_DATE_D_ACTE = (
    r"(?<!(?:\bn[ée]e?s?|naissance\s{0,5}:?)\s{0,10}Le)(?<!\b(?:depuis|jusqu['’]au|avant)\s{0,10}Le)"
)
RE_LE_DATE_A = rf"(?iU)\bLe{_PAS_UNE_DATE_D_ACTE}\s+{DATE}\s+à\s+([^.,;\n]{{1,40}})"
RE_LE_DATE = rf"(?U)\bLe\s+{DATE}\b"
RE_DATE_ACTE = rf"(?iU)\bLe{_PAS_UNE_DATE_D_ACTE}\s+{DATE}\b"
RE_HEURE_SUIVANTE = rf"(?iU)^Le\s+{DATE}\b[^.;\n]{{0,40}}?\b(?:à|de)\s+{HEURE}"
RE_DATE_BOITE = (
    rf"(?iU)\bDate\b(?!\s+de\s+(?:naissance|d[ée]livrance))[^:\n]{{0,30}}:\s*{DATE}\s+à\s+{HEURE}"
)
LONGUEUR_OUVERTURE = 400
RE_HEURE_SEULE = (
    rf"(?U)(?:(?m:^)\s*[AÀ]|\b[Cc]e\s+jour\s+[àa])\s+{HEURE}\b(?=[^.\n]{{0,60}}?\b(?:nous|[a-zéè]{{3,}}ons)\b)"
)
RE_INTERPELLATION = rf"(?iU)interpellation\s+effectuée\s+le\s+{DATE}\s+à\s+{HEURE}"
RE_RETROACTIF = rf"(?isU)(?:rétroactivement|à\s+compter\s+du)\s*.{{0,60}}?{DATE}\s+à\s+([^.,;\n(]{{1,40}})"
RE_DEMANDE_MEDECIN = rf"(?iU)réquisition\s+du\s+{DATE}\s+reçue\s+à\s+{HEURE}"
RE_REALISATION_MEDECIN = rf"(?iU)examiné\s+ce\s+jour\s+{DATE}\s+à\s+{HEURE}"
RE_DEMANDE_AVOCAT = rf"(?iU)demande\s+d'entretien\s+formulée\s+le\s+{DATE}\s+à\s+{HEURE}"
RE_REALISATION_AVOCAT = rf"(?iU)réalisé\s+le\s+{DATE}\s+de\s+{HEURE}\s+à\s+{HEURE}"
RE_PERQUISITION = rf"(?iU)le\s+{DATE}\s+de\s+{HEURE}\s+à\s+{HEURE}"
RE_AUDITION_DEBUT_FIN = rf"(?iU)le\s+{DATE},?\s*audition\s+débutée\s+à\s+{HEURE},?\s*close\s+à\s+{HEURE}"
RE_AUDITION_DEBUT = rf"(?iU)le\s+{DATE},?\s*audition\s+débutée\s+à\s+{HEURE}"
RE_AUDITION_FIN = rf"(?iU)audition\s+close\s+à\s+{HEURE}"
RE_DROITS_DIFFERES = rf"(?isU)notification.{{0,60}}?droits.{{0,200}}?à\s+{HEURE}"
RE_DROITS_DANS_PLACEMENT = r"(?iU)\bnotifions\b[^.]{0,80}\bb[ée]n[ée]ficie\s+du\s+droit"
# Time-stamped acts recognised in any piece, in order: (nature, pattern, group of the hour).
ACTES_HORODATES = (
    ("notification_droits",
     rf"(?iU)\b[AÀ]\s+{HEURE}\s*,\s*(?:nous\s+)?(?:lui\s+)?notifions\s+[^.]{{0,40}}?\bdroits\b"),
    ("notification_droits", rf"(?iU)\bdroits\s+(?:lui\s+(?:ont\s+été\s+|sont\s+)?)?notifi[ée]s\s+à\s+{HEURE}"),
    ("demande_examen_medical",
     rf"(?iU)m[ée]decins?\b[^.]{{0,30}}?\b(?:contact[ée]|requis|avis[ée]|sollicit[ée])\s+à\s+{HEURE}"),
    ("debut_perquisition",
     rf"(?iU)(?:d[ée]butons|commen[çc]ons|proc[ée]dons\s+aux?)\s+(?:les\s+)?(?:op[ée]rations\s+de\s+)?perquisition\w*\s+à\s+{HEURE}"),
    ("avis_avocat",
     rf"(?iU)\b[AÀ]\s+{HEURE}\s*,\s*(?:nous\s+)?(?:contactons|avisons|informons|joignons|appelons|pr[ée]venons)\s+"
     r"[^.]{0,60}?(?:avocat|ma[îi]tre|barreau|permanence)"),
    ("realisation_entretien_avocat",
     rf"(?iU)\b[àa]\s+{HEURE}\s*,\s*(?:Me|Ma[îi]tre)\b[^.]{{0,80}}?\bse\s+pr[ée]sente\b[^.]{{0,80}}\.\s*"
     r"[^.]{0,160}?\bs['’]entretenir\b"),
    ("avis_parquet",
     rf"(?iU)\b[AÀ]\s+{HEURE}\s*,\s*(?:nous\s+)?(?:avisons|informons|pr[ée]venons|contactons)\s+"
     r"[^.]{0,60}?(?:procureur|parquet)"),
    ("avis_parquet",
     r"(?iU)\bavis\s+(?:est\s+|a\s+été\s+)?donn[ée]\s+[^.]{0,40}?procureure?\b[^.]{0,60}?\bà\s+([^.,;\n]{1,40})"),
)
NATURES_GAV = (
    "interpellation", "placement_garde_a_vue", "notification_droits", "demande_examen_medical",
    "realisation_examen_medical", "demande_entretien_avocat", "realisation_entretien_avocat", "debut_audition",
    "fin_audition", "debut_perquisition", "fin_perquisition", "prolongation_garde_a_vue", "fin_garde_a_vue",
    "avis_avocat", "avis_parquet", "demande_interprete", "demande_avis_famille", "avis_famille", "fouille_integrale",
    "propos_hors_audition",
)
# Nature of a proposed act → words its quotation must hold.
NATURES_PREUVE = {
    "interpellation": r"interpell|appr[ée]hend|ma[îi]tris|menott|libert[ée]|arr[êe]t|p[ée]n[ée]tr|conduit|contr[ôo]le",
    "placement_garde_a_vue": r"garde\s+[àa]\s+vue|\bGAV\b",
    "notification_droits": r"droits",
    "demande_entretien_avocat": r"avocat|ma[îi]tre|conseil|\bMe\b",
    "avis_avocat": r"avocat|ma[îi]tre|conseil|barreau|permanence|\bMe\b",
    "realisation_entretien_avocat": r"entretien|avocat|ma[îi]tre|\bMe\b",
    "demande_examen_medical": r"m[ée]decin|m[ée]dical",
    "realisation_examen_medical": r"m[ée]decin|m[ée]dical|examin",
    "demande_interprete": r"interpr[èe]te|tradu",
    "demande_avis_famille": r"famille|proche|parent|m[èe]re|p[èe]re|[ée]pou|conjoint|employeur|pr[ée]venir",
    "avis_famille": r"famille|proche|parent|m[èe]re|p[èe]re|[ée]pou|conjoint|employeur|avis",
    "avis_parquet": r"procureur|parquet|magistrat|substitut",
    "debut_audition": r"audition|entend|extray|question|interrog|d[ée]clar",
    "fin_audition": r"audition|clos|lecture|fin",
    "debut_perquisition": r"perquisition|visite|fouill|p[ée]n[ée]tr|introduisons",
    "fin_perquisition": r"perquisition|visite|fouill|termin|fin",
    "fouille_integrale": r"fouille|mise\s+[àa]\s+nu|int[ée]grale",
    "prolongation_garde_a_vue": r"prolong",
    "fin_garde_a_vue": r"fin\b|lev[ée]e|libert[ée]|d[ée]f[ée]r|terme|lib[ée]r|pr[ée]sent[ée]|conduit|remis",
    "propos_hors_audition": r"hors|oralement|spontan|couloir|transfert|v[ée]hicule",
}
NATURES_REALISATION = (
    "realisation_examen_medical", "realisation_entretien_avocat", "avis_famille", "fin_garde_a_vue",
)
NATURES_DEMANDE = (
    "demande_examen_medical", "demande_entretien_avocat", "demande_interprete", "demande_avis_famille",
)
ACTES_UNIQUES_PAR_PIECE = (
    "interpellation", "placement_garde_a_vue", "notification_droits", "fin_garde_a_vue", "prolongation_garde_a_vue",
    "debut_perquisition", "fin_perquisition",
)
RE_NEGATION = (
    r"(?iU)\bsans\b|\bpas\b|\bjamais\b|\baucun|n['’]a\s+(?:pas\s+)?(?:pu|été)\s+(?:pas\s+)?|indisponible|impossible"
)
RE_REFUS = (
    r"(?iU)[:«]\s*«?\s*non\b|\bne\s+(?:souhaite|veut|demande|d[ée]sire|sollicite)\s+pas|\brefuse|\brenonce|"
    r"n['’]a\s+sollicit[ée]\s+aucun|\baucun\s+(?:examen|avocat|interpr)"
)
RE_ARRIVEE = r"(?iU)\bse\s+pr[ée]sente\b|\barriv"
RE_AVIS = r"(?iU)avis|contact|t[ée]l[ée]phon|inform|pr[ée]venu|joint|message|appel"
RE_SANS_PRESENTATION = r"(?iU)sans\s+pr[ée]sentation\b"
RE_PRESENTEE = r"(?iU)\b(?:a\s+été|est|été)\s+pr[ée]sent[ée]e?\s+(?:au|à|devant)\b|visio"
RE_HORS_PRESENCE_AVOCAT = r"(?iU)hors\s+(?:la\s+)?pr[ée]sence\s+de\s+(?:son|l['’]|leur)\s*(?:avocat|conseil)"
RE_MAGISTRAT = r"(?iU)procureur|parquet|substitut|\bjuge\b|\bJLD\b"
FENETRE_PREUVE = 320
_AVOCAT, _INTERPRETE = r"avocat|conseil|ma[îi]tre|\bMe\b", r"interpr[èe]te|tradu"
_ABSENCE = (
    r"\bsans\b|absen|\bhors\b|pas\s+(?:encore\s+|toujours\s+)?(?:pr[ée]sent|disponible|venu|arriv)"
    r"|n['’]est\s+(?:toujours\s+)?pas|indisponible|en\s+fran[çc]ais"
)
_PRESENCE = r"pr[ée]sence\s+de|assist[ée]|en\s+pr[ée]sence|pr[ée]sent\b|par\s+l['’]interm[ée]diaire"
# Detail of an act → value → patterns that must all hit its evidence.
PRECISIONS: dict[str, dict[str, tuple[str, ...]]] = {
    "agent": {
        "OPJ": (r"\bOPJ\b|officier\s+de\s+police\s+judiciaire",),
        "APJ": (r"\bAPJA?\b|agent\s+de\s+police\s+judiciaire|gendarme\s+adjoint|policier\s+adjoint",),
        "procureur": (r"procureur|parquet|substitut",),
        "juge": (r"\bjuge\b|\bJLD\b|libert[ée]s\s+et\s+de\s+la\s+d[ée]tention",),
    },
    "avocat": {"absent": (_AVOCAT, _ABSENCE), "present": (_AVOCAT, _PRESENCE)},
    "interprete": {"absent": (_INTERPRETE, _ABSENCE), "present": (_INTERPRETE, _PRESENCE)},
    "presentation": {
        "non": (r"(?:pas|sans|non)\b[^.]{0,40}pr[ée]sent",),
        "oui": (r"pr[ée]sent[ée]e?\s+(?:au|devant|[àa])|visio|pr[ée]sentation",),
    },
    "assentiment": {
        "non": (r"sans\s+(?:l['’]\s*)?assentiment|sans\s+(?:son\s+|l['’])?(?:accord|consentement)|refus|forc",),
        "oui": (r"assentiment|accord\s+expr[èe]s|consent",),
    },
    "autorisation_juge": {
        "non": (r"sans\s+(?:autorisation|ordonnance)[^.]{0,60}(?:juge|JLD|libert)",),
        "oui": (r"(?:autoris|ordonnance)[^.]{0,60}(?:juge|JLD|libert)",),
    },
}
CADRES = (
    ("flagrance", r"(?iU)flagran"),
    ("preliminaire", r"(?iU)enqu[êe]te\s+pr[ée]liminaire|\bpr[ée]liminaire\b"),
    ("commission_rogatoire", r"(?iU)commission\s+rogatoire"),
)

# --- Fixed values: statements -----------------------------------------------

RE_QUESTION = r"(?iU)^(?:(?:question|q)[.:\s]+|d\s*[.:\-–—]\s*(?=[^\W\d]))(.+)$"
RE_REPONSE = r"(?iU)^(?:(?:r[ée]ponse|r)[.:\s]+|r\s*[.:\-–—]\s*(?=[^\W\d]))(.+)$"
RE_QUESTION_A = r"(?iU)^Question\s+à\s+([^:]{3,60}?)\s*:\s*(.+)$"
RE_REPONSE_DE = r"(?iU)^R[ée]ponse\s+de\s+([^:]{3,60}?)\s*:\s*(.+)$"
RE_QR_EN_LIGNE = r"(?U)(?<=[?.!»])\s+(?=(?:Question|QUESTION|Réponse|REPONSE|RÉPONSE)\s*:)"
RE_VOIX_ENQUETEUR = (
    r"(?iU)^\W*(?:[AÀ]\s+\d{1,2}\s*h\s*\d{2}\s*,\s*)?(?:nous\b|constatons|d[ée]cidons|mentionnons|proc[ée]dons|"
    r"notifions|avisons|disons|relevons|requ[ée]rons|transportons|interpellons|informons|extrayons)"
)
POINTS_CONNUS = (("heure d'arrivée sur les lieux", ("arriv",)),)

# --- Fixed values: identifiers and seals ------------------------------------

RE_TELEPHONE = r"(?U)\b0[1-9](?:[\s.-]?\d{2}){4}\b"
RE_PLAQUE = r"(?U)\b[A-Z]{2}-\d{3}-[A-Z]{2}\b"
RE_IBAN = r"(?U)\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b"
RE_ADRESSE = (
    r"(?iU)\b\d{1,4}[,]?\s+(?:rue|avenue|boulevard|chemin|impasse|allée|place|route|quai|cours|"
    r"zone\s+industrielle|zone\s+d['’]activit[ée])\s+[A-Za-zÀ-ÿ'\-]+(?:\s+[A-Za-zÀ-ÿ'\-]+){0,4}"
)
TYPES_PROCHES = ("Plaque d'immatriculation", "Téléphone")
NUMEROS_SCELLES = {
    "UN": 1, "DEUX": 2, "TROIS": 3, "QUATRE": 4, "CINQ": 5, "SIX": 6, "SEPT": 7, "HUIT": 8, "NEUF": 9, "DIX": 10,
    "ONZE": 11, "DOUZE": 12, "TREIZE": 13, "QUATORZE": 14, "QUINZE": 15, "SEIZE": 16,
}
RE_SCELLE = (
    r"(?iU)\b([A-Z]{3,})-(" + "|".join(NUMEROS_SCELLES) + r"|\d{1,2})\b|\bscell[ée]\s+n[°o]\s*(\d{1,3})\b"
)
COULEURS = (
    "gris", "noir", "blanc", "bleu", "rouge", "vert", "jaune", "marron", "beige", "rose", "violet", "orange", "kaki",
    "bordeaux", "argent", "dor[ée]",
)
RE_COULEUR = r"(?iU)\b(" + "|".join(COULEURS) + r")(?:e|s|es)?\b"
RE_MESURE = r"(?iU)\b(\d+(?:[.,]\d+)?)\s*(cm|mm)\b"
ACTES_UNIQUES = {
    "interpellation": "Interpellation", "placement_garde_a_vue": "Placement en garde à vue",
    "notification_droits": "Notification des droits", "fin_garde_a_vue": "Fin de garde à vue",
}
LIBELLES_ACTES = {
    **ACTES_UNIQUES, "debut_audition": "Audition", "avis_avocat": "Avis à l'avocat",
    "avis_parquet": "Avis au procureur", "debut_perquisition": "Perquisition",
}

# --- Fixed values: text quality ---------------------------------------------

MAJUSCULES_LATINES, MINUSCULES_LATINES = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
CONSONNES = "bcdfghjklmnpqrstvwxzßçñBCDFGHJKLMNPQRSTVWXZÇÑ"
GROUPES_LEGITIMES = r"(?i)nstr|nscr|bstr|bscr|rstr|ctr|ngtr|mpt|rchr"
VOYELLES = "aeiouyàâäéèêëîïôöùûüÿæœAEIOUYÀÂÄÉÈÊËÎÏÔÖÙÛÜŸÆŒ"
PARASITES = r"#@&|~^\\*_}{\]\[<>¢£¤§±µ¶"
PONCTUATION_BORD = r".,;:!?()«»\"'—\-"
LETTRES_ISOLEES = "aàyounjldcmstq"
MOTS_MINIMUM, SEUIL_ILLISIBILITE = 15, 0.35
PETITS_MOTS = (
    "le la les de des du un une et en au aux que qui ne pas pour par sur dans est il elle nous vous je se son sa ses ce "
    "cette avec été mais ou où plus qu"
).split()
PART_PETITS_MOTS_MIN, MOTS_MIN_POUR_JUGER = 0.22, 10
SEUIL_OCR, SEUIL_OCR_IMAGE, COUVERTURE_SCAN = 50, 300, 0.6
SEUIL_FLOU_OCR = 97
RE_HEURE_ZERO = r"(?U)(?<![\d\w])([€6890Oo])(\d)\s*h\s*(\d{2})(?!\d)"
RE_HEURE_F = r"(?U)(?<![\d\w])(\d{1,2})[Ff](\d{2})(?!\d)"

# --- Fixed values: questions ------------------------------------------------

MOTS_VIDES = (
    "le la les un une des du de d l au aux et ou en dans sur sous par pour avec sans que qui quoi quel quelle quels "
    "quelles dont est sont a ont été etre être avoir fait il elle ils elles on se sa son ses leur leurs ce cet cette ces "
    "y ne pas plus comment pourquoi quand combien lui eux nous vous je tu me te mon ma mes votre vos notre nos t il-y "
    "dossier piece pieces page pages"
).split()
LONGUEUR_RACINE = 7
BUDGET_QUESTION, LONGUEUR_QUESTION = 40_000, 500
BUDGET_ELEMENTS = 120_000
RE_QUESTION_NULLITE = r"(?iU)nullit|irr[ée]gularit|vices?\s+de\s+proc[ée]dure|annul"
MESSAGE_INTROUVABLE = "Le dossier ne permet pas de répondre à cette question avec un passage vérifiable."
MESSAGE_QUALIFICATION = (
    "Je ne qualifie pas juridiquement les éléments du dossier. Voici les passages des pièces qui se rapportent à votre "
    "question."
)
MESSAGE_PASSAGES = "Voici les passages des pièces qui se rapportent à votre question."
MESSAGE_PROCEDURE = (
    "Je ne qualifie pas juridiquement les éléments du dossier. Les contrôles de procédure signalent ces points à "
    "vérifier (détail dans l'onglet Procédure) :"
)

# --- Fixed values: guards on free text --------------------------------------

RE_QUALIFICATION = (
    r"(?iU)nullit|irr[ée]gul|invocable|qualit[ée] (?:pour|à) agir|\bgrief\b|vice de proc|ill[ée]gal|annulable|entach"
)
RE_JUGEMENT = (
    r"(?iU)\bment\b|\bmenti(?!on)|mensong|faux t[ée]moignage|coupable|culpabilit|innocen|\bpreuve|\bprouve|\bavoue|"
    r"incrimin|disculp|r[ée]pr[ée]hensible|d[ée]lictueu"
)
RE_PERIODE_VIDE = r"(?iU)\bentre (?:le |les |l')?(.{3,40}?) et (?:le |les |l')?\1\b"
RE_COUPURE = r"(?iU)\[\s*(?:\.{3}|…|pages?\s+\d+(?:\s*(?:,|et|-)\s*\d+)*|p\.\s*\d+)\s*\]"
MOTS_GENERIQUES = (
    "pv", "gav", "cpp", "opj", "apj", "jld", "ji", "tj", "cp", "rg", "m", "mme", "mlle", "me", "dr", "maitre",
    "monsieur", "madame", "docteur",
)
NOMBRES_EN_LETTRES = {
    "zero": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8,
    "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "vingt": 20, "vingts": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "cent": 100,
    "cents": 100, "mille": 1000,
}
NOMBRES_AMBIGUS = ("un", "une", "neuf")
DIZAINES_ET = ("vingt", "trente", "quarante", "cinquante", "soixante")
UNITES_COMPTE = (
    "an", "ans", "annee", "annees", "mois", "semaine", "semaines", "jour", "jours", "nuit", "nuits", "heure", "heures",
    "minute", "minutes", "fois", "euro", "euros", "metre", "metres", "kilometre", "kilometres", "km", "personne",
    "personnes", "individu", "individus", "homme", "hommes", "femme", "femmes", "enfant", "enfants", "coup", "coups",
    "balle", "balles", "vehicule", "vehicules", "telephone", "telephones",
)
UNITES_DUREE = {
    "an": "an", "ans": "an", "annee": "an", "annees": "an", "mois": "mois", "semaine": "semaine",
    "semaines": "semaine", "jour": "jour", "jours": "jour", "nuit": "nuit", "nuits": "nuit", "minute": "minute",
    "minutes": "minute",
}
ADJECTIFS_DE_COMPTE = ("differentes", "distinctes", "successives", "contradictoires", "divergentes", "differents")
APPROXIMATIONS = {
    "dizaine": 10, "douzaine": 12, "quinzaine": 15, "vingtaine": 20, "trentaine": 30, "quarantaine": 40,
    "cinquantaine": 50, "soixantaine": 60, "centaine": 100, "millier": 1000,
}
TERMES_A_SOURCER = (
    r"violen\w*", r"\bvols?\b", r"\bviols?\b", r"meurtr\w*", r"assassin\w*", r"homicid\w*", r"menac\w*", r"escroq\w*",
    r"abus de confiance", r"trafic\w*", r"stupefiant\w*", r"recel\w*", r"extorsion\w*", r"sequestr\w*", r"harcel\w*",
    r"degradation\w*", r"incendi\w*", r"outrage\w*", r"rebellion\w*", r"\barmes?\b", r"blanchi\w*", r"malfaiteurs",
    r"cambriol\w*", r"enlevement\w*", r"racket\w*", r"requisitoire\w*", r"information judiciaire", r"mise? en examen",
    r"juge d.instruction", r"\bordonnance\w*", r"controle judiciaire", r"detention provisoire", r"comparution\w*",
    r"\brenvo[iy]\w*", r"\bjugement\w*", r"condamn\w*", r"tribunal\w*", r"cour d.assises", r"\baudience\w*",
    r"classement sans suite", r"deferr?e?ment\w*", r"\bplaintes?\b", r"qualification\w*", r"\baveux?\b",
    r"temoin assiste", r"partie civile", r"mandat d", r"\becrou\w*", r"incarcer\w*",
)
RE_SILENCE = (
    r"(?iU)non\s+pr[ée]cis|ne\s+pr[ée]cise\s+pas|sans\s+pr[ée]ciser|non\s+mentionn|ne\s+mentionne\s+pas|non\s+indiqu|"
    r"n'indique\s+pas|ne\s+dit\s+rien|non\s+renseign"
)
MAX_CONTRADICTIONS = 12
LONGUEUR_TITRE = 90
MAX_PHRASES, MOTS_RESUME = 4, 160
SECTIONS = (
    "Les faits", "L'enquête", "Les interpellations et les mesures", "Les déclarations",
    "Les expertises et l'état du dossier",
)
TAILLE_LOT, PIECES_PAR_APPEL = 8000, 8

# --- Fixed values: controls -------------------------------------------------

RE_LOCUTEUR = (
    r"(?U)\b(?:M\.|Mme|Mlle|Madame|Monsieur|Mademoiselle)\s+((?:[A-ZÀ-Ý][\w'’-]+\s+){0,2}[A-ZÀ-Ý][\w'’-]+)"
    r"[^.«:]{0,40}?\b(?:d[ée]clare|indique|dit|pr[ée]cise|affirme|ajoute|s['’][ée]crie)"
)
RE_NAISSANCE = rf"(?iU)\bn[ée]e?\s+le\s+{DATE}"
RE_FLAGRANCE, RE_ROGATOIRE = r"(?iU)flagran", r"(?iU)commission\s+rogatoire"
RE_GEOLOCALISATION = r"(?iU)(?:g[ée]o)?localisation\s+en\s+temps\s+r[ée]el|g[ée]olocalisation"
RE_AUTORISATION = (
    r"(?iU)autoris[ée]e?s?\b[^.]{0,80}(?:procureur|juge|JLD|libert[ée]s)|(?:procureur|juge|JLD)[^.]{0,80}autoris"
)
RE_PHOTO_ISOLEE = (
    r"(?iU)\b(?:envoy|montr|pr[ée]sent|fait\s+voir|soumis)\w*\s+(?:une|la|sa|cette)\s+(?:seule\s+)?photo(?:graphie)?s?\b"
    r"(?![^.]{0,40}\bplanche)(?=[^«»]{0,200}?(?:si\s+c['’][ée]tait\s+lui|reconna|identifi|c['’]est\s+lui|ressembl))"
)
RE_PLANCHE = r"(?iU)planche\s+(?:photographique|comportant|de\s+(?:\d+|six|cinq|huit|dix))|tapissage"
DELAI_AVOCAT_MIN = 120
LIMITE_PAGES, LIMITE_MO = 400, 50
DELAIS_ORPHELIN_S = {"en_cours": 300, "en_attente": 1800}
NON_TROUVE = "NON TROUVÉ"
