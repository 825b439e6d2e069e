"""Parsing tables: reference marks, hours, openings, sentences, guards."""

import random
import re

from pyspark.sql import functions as F

from liasse.functions import dates, elements, text, vocab as v
from liasse.functions.elements import absent_elements, hours_in, reference_keys
from liasse.operators import extraction as x, guards as g, persons as p, segmentation as s, statements as st


def test_reference_marks(one):
    cases = {
        "COTE : D. 1": "D1", "cote n° D 45/2": "D45/2", "COTE D-012 / PV de synthèse": "D012", "Cote 45": "45",
        "Première ligne\nDeuxième ligne\nD.45/3": "D45/3",
        "vu la côte 3": None, "cote de popularité 12": None, "cotée 2 fois": None, "A7 direction Lyon": None,
        "un\ndeux\ntrois\nquatre\nB 02\nsix\nsept\nhuit\nneuf": None,
    }
    assert one(list(cases), x.reference_mark(F.col("texte"))) == list(cases.values())


def test_repaired_hours(one):
    cases = {"à 69h00": "à 09h00", "à 68h30": "à 08h30", "à 14F30": "à 14h30", "à €9h10": "à 09h10", "à 19h00": "à 19h00", "à 08h30": "à 08h30",
             "30F10": "30F10"}
    assert one(list(cases), x.repaired_hours(F.col("texte"))) == list(cases.values())


def test_dates_and_hours(one):
    assert one(["4/3/2031", "1er mars 2031", "31/02/2031", "12 brumaire 2031"], dates.date_text(F.col("texte"))) == [
        "04/03/2031", "01/03/2031", "31/02/2031", None]
    spoken = {"8 h 15": "08h15", "17 heures 52 minutes": "17h52", "9 heures": "09h00", "quatorze heures trente": "14h30", "midi": "12h00",
              "vingt et une heures et quinze minutes": "21h15", "dix heures et demie": "10h30", "trente heures": None, "plus tard": None}
    assert one(list(spoken), dates.loose_hour(F.col("texte"))) == list(spoken.values())


def test_openings(one):
    cases = {
        "A 07h30, de retour au service, nous notifions": (None, "07h30"),
        "A 23h10 il revient.": None,
        "L'an deux mille vingt-six, le deux septembre à six heures et quinze minutes, nous": ("02/09/2026", "06h15"),
        "L'an deux mille trente et un, le 14 mars, à 19 heures 45 minutes.": ("14/03/2031", "19h45"),
        "Le 03/02/2033, audition débutée à 13h15. Question : Le 14/01/2033 à 10h47, cette ligne a appelé": ("03/02/2033", "13h15"),
        "LEROY Kevin, né le 20/11/2010 à Valmont": None,
        "dont il fait l'objet depuis le 15 mars 2026 à 07h25. Fait le 16 mars 2026 à 07h05": ("16/03/2026", "07h05"),
        "Date de placement : 14/03/2031 à 08h15": ("14/03/2031", "08h15"),
        "Date de naissance : 14/03/1990 à 08h15": None,
        "Le 15 septembre 2026 à 14 heures 00. Un fait du 14 septembre 2026 à 17h35.": ("15/09/2026", "14h00"),
    }
    got = one(list(cases), dates.opening(F.col("texte")))
    assert [(o["date"], o["heure"]) if o else None for o in got] == list(cases.values())


def test_body_and_sentences(one):
    page = "D3\nPROCÈS-VERBAL DE PLACEMENT\nLe 14/03/2031 à 08h15, nous\nnotifions à M. X la mesure. Il signe.\nN° PARQUET 1/2"
    assert one([page], text.body(F.col("texte"))) == ["Le 14/03/2031 à 08h15, nous notifions à M. X la mesure. Il signe."]
    assert one(["Vu par M. Durand. Puis N. part. Fin"], text.sentences(F.col("texte"))) == [["Vu par M. Durand.", "Puis N. part.", "Fin"]]
    crossing = "Premier corps.\nTITRE EN CAPITALES\nSecond corps"
    assert one([crossing], F.array_join(text.sentences(text.body(F.col("texte"))), "|")) == ["Premier corps.|Second corps"]
    quote = "Un. Deux ici. Trois."
    assert one([quote], text.sentence_at(F.col("texte"), F.lit(quote.index("ici") + 1))) == ["Deux ici."]


def test_titles_and_types(one):
    titles = ["PROCÈS-VERBAL D'AUDITION", "_ PROCÈS-VERBAL D'AUDITION", "DIRECTION CENTRALE Feuillet N° 1/2", "Objet : audition", "D 12"]
    assert one(titles, text.is_title(F.col("texte"))) == [True, True, True, False, False]
    heads = {"NOTIFICATION DE PLACEMENT EN GARDE A VUE": "PV de notification de placement en garde à vue", "PROCÈS-VERBAL DE FIN DE GARDE À VUE": "PV de fin de garde à vue",
             "ORDONNANCE D'AUTORISATION D'INTERCEPTION RÉQUISITION": "Ordonnance du juge des libertés et de la détention", "LETTRE": "Non identifié"}
    assert one(list(heads), s.type_by_rules(F.col("texte"))) == list(heads.values())
    page = "COMMISSARIAT DE LYON 3/6 COTE : D.3\nPROCÈS-VERBAL D'AUDITION\nLe 3 mars, LES FAITS DE PERQUISITION"
    assert one([page], s.header(F.col("texte"))) == ["PROCÈS-VERBAL D'AUDITION"]
    report = "PROCÈS-VERBAL\nObjet : Audition de personne gardée à vue\nNous, OPJ"
    assert one([report], s.type_by_rules(s.heading(F.col("texte")))) == ["PV d'audition"]


def test_legibility_and_plausibility(one):
    good = "Le véhicule est arrivé dans la rue et nous avons vu la personne qui attendait devant la porte de la maison."
    bad = "Je SusSiha DŒt dr Mrchag certlfie #WOir eXarire ce pur Mnsr en1pr9es qi pst b dgr xkrtv qzrtp nb1d3s"
    scores = one([good, bad, "trois mots seulement"], x.legibility_score(F.col("texte")))
    assert scores[0] < 0.1 and scores[1] >= 0.35 and scores[2] == 0.0
    shares = one([good, "un deux"], x.plausibility_share(F.col("texte")))
    assert shares[0] > 0.22 and shares[1] is None


def test_absent_elements(spark):
    reference = "Le 14/03/2031 à 22 heures, M. Paul DURAND a discuté une vingtaine de minutes. Il connaît la victime depuis deux ans."
    cases = {
        "Il est arrivé vers 21h00.": ["21", "00", "21h00"], "Ils ont discuté une dizaine de minutes.": ["dizaine"], "Depuis un an.": ["1 an"],
        "Il a commis des violences.": ["violences"], "Vu par Antoine ROQUIER.": ["ROQUIER", "Antoine"],
        "Paul DURAND est venu vers 22h.": [], "Il connaît la victime depuis deux ans.": [], "Les deux versions concordent.": [],
        "Une discussion de 20 minutes.": ["20 minute"],
    }
    rows = spark.createDataFrame([(i, t, reference) for i, t in enumerate(cases)], "i int, t string, r string")
    got = [r["x"] for r in rows.select("i", absent_elements(F.col("t"), F.col("r")).alias("x")).orderBy("i").collect()]
    for (said, expected), found in zip(cases.items(), got):
        assert set(found) == set(expected), said


def test_reference_is_read_for_the_kinds_asked_for_only(spark):
    said = "À 22 heures, une vingtaine de minutes, Paul DURAND parle de violences."
    df = spark.createDataFrame([(said, ["w:paul", "w:luc"]), (said, ["h:22:0", "t:0"]), (said, ["n:20"]), (said, []), (None, ["t:0"])], "r string, asked array<string>")
    rows = df.select("asked", reference_keys(F.col("r"), F.col("asked")).alias("some"), reference_keys(F.col("r")).alias("every")).collect()
    for row in rows[:4]:
        assert set(row["some"]) & set(row["asked"]) == set(row["every"]) & set(row["asked"])
    assert {k[:2] for k in rows[0]["some"]} == {"w:"} and {k[:2] for k in rows[1]["some"]} == {"h:", "t:"}
    assert {k[:2] for k in rows[2]["some"]} == {"n:"} and rows[3]["some"] == [] and rows[4]["some"] is None


def test_words_and_terms_dealt_by_their_first_letters():
    for word in v.NOMBRES_EN_LETTRES:
        assert re.fullmatch(elements._WORD, word) and not re.match(elements._WORD, word + "x")
    each, dealt = re.compile("|".join(v.TERMES_A_SOURCER)), re.compile(elements._ANY_TERM)
    rng = random.Random(3)
    said = ["violences", "vols", "volet", "envol", "larmes", "armes", "renvoi", "mis en examen", "mise en examen", "juge d'instruction", "deferement", "aveu", "laveu", "mandat d"]
    for text_ in said + ["".join(rng.choice("acdeilmorstuv ") for _ in range(9)) for _ in range(3000)] + [a + b for a in said for b in said]:
        assert bool(each.search(text_)) == bool(dealt.search(text_)), text_
    assert elements._by_head(["ab", r"\bac", "b"]) == r"a(?:b|(?<=\ba)c)|b(?:)"


def test_lines_that_do_not_begin_like_a_title(one):
    lines = ["PROCÈS-VERBAL D'AUDITION", "|_ _PROCÈS-VERBAL", "  ~ AUDITION DE  Feuillet 2", "Procès-verbal D'AUDITION", "TITRE", "AUDITION Date : 3", "12/03/2031 ", "", "·ABCDEFGH·", "ABCDEFGh"]
    plain = [bool(re.search(v.RE_TITRE.replace("(?U)", ""), re.sub(v.RE_SUFFIXE_COLONNE.replace("(?iU)", "(?i)"), "", x.strip().strip(v.PARASITES_BORD).strip()).strip())) for x in lines]
    assert one(lines, text.is_title(F.col("texte"))) == plain and plain.count(True) == 5
    begins = one(lines, F.col("texte").rlike(v.RE_DEBUT_TITRE))
    assert all(b for b, title in zip(begins, plain) if title) and not begins[3] and not begins[4]


def test_absent_from_with_few_and_with_many_elements(spark):
    texts = spark.createDataFrame([("a", 1, "Vu par Paul DURAND à 21h00."), ("a", 1, "Il parle de violences."), ("b", 2, "Vu à 22h00."), (None, 3, "Vu à 23h00."), ("c", 4, None)],
                                  "dossier_id string, fait_id int, texte string")
    pages = spark.createDataFrame([("a", "M. Durand est venu."), ("a", "À vingt et une heures."), ("b", None), ("b", "22 heures"), (None, "23 heures")], "dossier_id string, texte string")
    got = [sorted(tuple(r) for r in g.absent_from(texts, pages, ["dossier_id"], ["dossier_id", "fait_id"], most).select("fait_id", "cle").collect()) for most in (0, 2, 200)]
    assert got[0] == got[1] == got[2]
    assert {"t:0", "w:paul"} <= {k for i, k in got[0] if i == 1} and not {"w:durand", "h:21:0"} & {k for _, k in got[0]}
    assert (3, "h:23:0") in got[0] and (2, "h:22:0") not in got[0]


def test_hours_in(one):
    cases = {"à 07h50": ["7:50"], "7 h 50": ["7:50"], "à sept heures cinquante": ["7:50"], "vingt-deux heures et demie": ["22:30"],
             "à deux heures différentes": [], "entre deux et trois heures": ["3:0"], "quatre-vingt-dix-huit heures": ["98:0"], "une heure": ["1:0"]}
    assert one(list(cases), hours_in(F.col("texte"))) == list(cases.values())


def test_wording_problems_name_all_absent_elements(spark):
    dates = [f"{d:02d}/03/2031" for d in range(1, 15)]
    df = spark.createDataFrame([(" puis ".join(dates),)], "t string")
    every, few = (df.select(F.array_join(g.wording_problems(F.col("t"), F.lit("rien"), n), ";").alias("x")).first()["x"] for n in (None, 3))
    assert every.count(", ") >= 13 and few.count(", ") == 2


def test_wording_problems(spark):
    rows = [("La procédure est irrégulière.", "qualification"), ("Il ment.", "jugement"), ("Voir [nom].", "crochets"), ("Il vient [...] ici.", ""),
            ("Vu entre mars 2031 et mars 2031.", "bornes"), ("Mention de la suite.", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r["x"] for r in df.select("i", F.array_join(g.wording_problems(F.col("t"), F.lit("mars 2031")), ";").alias("x")).orderBy("i").collect()]
    for (said, word), found in zip(rows, got):
        assert (word in found) if word else found == "", (said, found)


def test_json_answers(spark):
    raws = ['```json\n{"a": 1}\n```', '{"a": 1}', 'Voici [1, 2] fin', 'rien', 'x {"a": [1]} y']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    assert [r["json"] for r in g.parse_answers(df).orderBy("i").collect()] == ['{"a": 1}', '{"a": 1}', "[1, 2]", None, '{"a": [1]}']


def test_person_fields(one):
    assert one(["Personne entendue : LEROY Kevin", "nous entendons Paul LEROUX, voisin", "Rien"], p.field_name(F.col("texte"))) == [
        "Kevin LEROY", "Paul LEROUX", None]
    assert one(["JÉRÔME VASSEUR (TÉMOIN)", "AGNÈS LE ROUX (VICTIME)"], F.get(p.tags(F.col("texte")), F.lit(0))["nom"]) == ["Jérôme VASSEUR", "Agnès LE ROUX"]
    assert one(["AUDITION DE TÉMOIN", "DÉPÔT DE PLAINTE", "AUDITION DE PERSONNE GARDÉE À VUE", "AUDITION DE TÉMOIN ET DE VICTIME"], p.role_of_heading(F.col("texte"))) == [
        "témoin", "victime", "mis_en_cause", None]
    texts = ["Nous, Gilles GAUTHIER, Capitaine de Police, notifions à Julien MORVANNEC", "nous, capitaine Élodie BASTIER, voyons Marc TESSIER, agent de police judiciaire et Paul LEROUX",
             "la victime dénommée : DURAND Anne et Paul LEROUX", "un avocat (Me SCHMITT)"]
    assert one(texts, p.first_mention_of(F.col("texte"))["nom"]) == ["Julien MORVANNEC", "Paul LEROUX", "Anne DURAND", None]
    assert one(["Docteur Agathe MERCIER", "Me SCHMITT", "M. le Docteur Paul X"], p.without_titles(F.col("texte"))) == ["Agathe MERCIER", "Me SCHMITT", "le Docteur Paul X"]


def test_topics(one):
    assert one(["Quand êtes-vous arrivé ?", "Qui est-ce ?"], st.topic(F.col("texte"), F.lit("x"))) == ["heure d'arrivée sur les lieux", "qui est-ce"]


def test_line_and_sentence_of_a_match(spark):
    texte = "Ref 0601020304059\nTel. 06 01 02 03 04. Le M. A.\nB. DUPONT, 0601020304 encore.\n﷐Fin 06\n01020304"
    pages = spark.createDataFrame([("A", 1, texte), ("A", 2, "rien")], "dossier_id string, numero_global int, texte string")
    rows = x.identifier_mentions(pages).collect()
    # The value stands earlier inside a longer number; the line is that of the match.
    assert [(r.cle, r.citation) for r in rows] == [("0601020304", "Tel. 06 01 02 03 04. Le M. A.")]
    found = x.identifier_sentences(pages).orderBy("debut").collect()
    plain = texte.replace("﷐", "")
    assert [plain[r.debut - 1:][:2] for r in found] == ["06"] * 3
    assert [r.phrase for r in found] == ["06 01 02 03 04.", "Le M. A.\nB. DUPONT, 0601020304 encore.", "Fin 06\n01020304"]


def test_unit_at_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab. A\n") for _ in range(rng.randrange(1, 40))), rng.randrange(1, 40)) for _ in range(200)]
    found = spark.createDataFrame(rows, "t string, p int").select("t", "p", text.unit_at(F.split("t", r"(?<=\n)"), F.col("p")).alias("u")).collect()
    for r in found:
        lines = r.t.splitlines(keepends=True)
        at, got = 0, lines[-1] if not r.t.endswith("\n") else ""
        for line in lines:
            if at < r.p <= at + len(line):
                got = line
                break
            at += len(line)
        if r.p <= len(r.t):
            assert r.u == got


def test_legibility_searches_a_page_before_its_words(spark):
    """Every share of words against a loop; a page without a trace of a fault is not searched word by word."""
    import re

    import pytest

    from liasse.functions import vocab as v
    from liasse.operators import extraction as x

    low, up = v.MINUSCULES_LATINES, v.MAJUSCULES_LATINES
    odd = ["«aB»", "(x#y)", "bcd-", "'k'", "a1b", "nstr", "rxkrtv", "...", "1234", "été", "dŒt", "—", "A", "(Z)", "bc\xa0d", "\"mot\"", "l'eau", "-to-"]
    texts = ["un mot clair " * 12, " ".join(odd), " \n ".join(odd * 3), "mot " * 30 + "aB", "court", "", None]

    def loop(t):
        if t is None:
            return 1.0
        bare = [re.sub(rf"^[{v.PONCTUATION_BORD}]+|[{v.PONCTUATION_BORD}]+$", "", w) for w in t.split()]
        words = [w for w in bare if re.search(f"[{up}{low}]", w)]
        if len(words) < v.MOTS_MINIMUM:
            return 0.0
        four = f"[{v.CONSONNES}]{{4}}"
        tests = [(3, lambda w: re.search(f"[{low}][{up}]", w)), (5, lambda w: re.search(f"[{v.PARASITES}]", w)),
                 (4, lambda w: len(re.sub(f"[^{up}{low}]", "", w)) >= 3 and not re.search(f"[{v.VOYELLES}]", w)),
                 (4, lambda w: len(w) == 1 and w.lower() not in v.LETTRES_ISOLEES),
                 (5, lambda w: re.search(f"[{up}{low}][0-9]+[{up}{low}]", w)),
                 (4, lambda w: re.search(four, w) and re.search(four, re.sub(v.GROUPES_LEGITIMES, "", w)))]
        return min(1.0, sum(n * len([w for w in words if f(w)]) / len(words) for n, f in tests))

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, texte string").select("i", x.legibility_score(F.col("texte")).alias("s"))
    assert [r.s for r in rows.orderBy("i").collect()] == pytest.approx([loop(t) for t in texts])
    assert len(re.findall(r"RLIKE\(texte|texte#\d+ RLIKE|texte RLIKE", rows._jdf.queryExecution().analyzed().toString())) >= 4


def test_illegible_pages_are_scored_once(spark):
    """Ranges read their pages several times; none of these reads scores a text again."""
    from liasse.operators import reports as rp

    poor = "xkrtv qzrtp nb1d3s @ srtgh vcxzm plqrs dŒt kRt bcdfg zrtpq w3x " * 5
    pages = spark.createDataFrame([("A", i, i == 2, poor if i in (2, 3, 5) else "un texte clair " * 9) for i in range(1, 7)],
                                  "dossier_id string, numero_global int, ocr_applique boolean, texte string")
    found = rp.illegible_ranges(pages)
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert sorted((r.debut, r.fin, r.origine[:3]) for r in found.collect()) == [(2, 3, "OCR"), (5, 5, "cou")]
