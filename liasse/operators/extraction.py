"""Text → rows: one corpus-wide job per kind of mention, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, vocab as v
from ..functions.dates import _cardinals, _map, date_text, hour_text, loose_hour, opening

PAGE = ["dossier_id", "numero_global"]


def repaired_hours(c: Column) -> Column:
    """``69h00`` → ``09h00``, ``14F30`` → ``14h30``."""
    zero = F.regexp_replace(c, r"(?U)(?<![\d\w])[€689Oo](\d)\s*h\s*(\d{2})(?!\d)", "0$1h$2")
    return F.regexp_replace(zero, r"(?U)(?<![\d\w])([01]?\d|2[0-3])[Ff]([0-5]\d)(?!\d)", "$1h$2")


def fused_text(native: Column, recognised: Column) -> Column:
    """The little native text of a recognised page, then its repaired text."""
    head = text.strip(native)
    return F.when(head == "", repaired_hours(recognised)).otherwise(
        F.concat(head, F.lit("\n"), repaired_hours(recognised))
    )


def repair_hours(pages: DataFrame) -> DataFrame:
    return pages.withColumn(
        "texte", F.when(F.col("ocr_applique"), repaired_hours(F.col("texte"))).otherwise(F.col("texte"))
    )


def reference_mark(c: Column) -> Column:
    """« cote … » anywhere, else a stamp alone on a margin line."""
    def mark(source: Column, pattern: str) -> Column:
        sub = F.regexp_extract(source, pattern, 3)
        return F.concat(
            F.upper(F.regexp_extract(source, pattern, 1)), F.regexp_extract(source, pattern, 2),
            F.when(sub != "", F.concat(F.lit("/"), sub)).otherwise(F.lit("")),
        )

    stamps = F.filter(text.margin(text.lines(c), v.LIGNES_DE_MARGE), lambda x: x.rlike(v.RE_TAMPON_COTE))
    return F.when(c.rlike(v.RE_COTE), mark(c, v.RE_COTE)).otherwise(
        text.let(F.get(stamps, F.lit(0)), lambda line: mark(line, v.RE_TAMPON_COTE))
    )


def cotes(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, reference_mark(F.col("texte")).alias("cote"))


def base_mark(c: Column) -> Column:
    return F.split_part(c, F.lit("/"), F.lit(1))


def procedure_numbers(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, text.found(F.col("texte"), v.RE_NUM_PROCEDURE, 1).alias("numero_procedure"))


def date_mentions(pages: DataFrame) -> DataFrame:
    raw = text.all_found(F.col("texte"), "(?iU)" + v.DATE, 1)
    return pages.select(*PAGE, F.posexplode(raw).alias("ordre", "brut")).select(
        *PAGE, "ordre", date_text(F.col("brut")).alias("date")
    )


def hour_mentions(pages: DataFrame) -> DataFrame:
    """Compact hours (``8 h 15``) and loose ones (``quatorze heures trente``)."""
    words = "|".join(sorted((w.replace("-", r"[\s-]+(?:et[\s-]+)?") for w in _cardinals()), key=len, reverse=True))
    number = rf"(?:\d{{1,2}}|{words})"
    loose = (
        rf"(?iU)\b(?:midi|minuit|{number}\s*heures?(?:\s+(?:et\s+)?(?:demie?|{number})(?:\s*minutes?)?)?)\b"
    )
    compact = pages.select(
        *PAGE, F.lit("compacte").alias("forme"), F.posexplode(text.all_found(F.col("texte"), v.HEURE, 1)).alias("ordre", "b")
    ).withColumn("heure", hour_text(F.col("b")))
    free = pages.select(
        *PAGE, F.lit("libre").alias("forme"), F.posexplode(
            F.when(F.lower("texte").rlike("heure|midi|minuit"), text.all_found(F.col("texte"), loose))
        ).alias("ordre", "b")
    ).withColumn("heure", loose_hour(F.col("b")))
    return compact.unionByName(free).filter("heure is not null").drop("b")


def act_openings(pages: DataFrame) -> DataFrame:
    """Opening of each page's body: date, hour and the sentence that says so."""
    bodies = pages.select(*PAGE, text.body(F.col("texte")).alias("corps"))
    found = bodies.select(*PAGE, "corps", F.explode(F.filter(F.array(opening(F.col("corps"))), lambda o: o.isNotNull())).alias("o"))
    return found.select(
        *PAGE, F.col("o.rang").alias("formule"), F.col("o.date").alias("date"), F.col("o.heure").alias("heure"),
        text.sentence_at(F.col("corps"), F.col("o.position")).alias("citation"),
    )


def body_text(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE, text.body(F.col("texte")).alias("corps"))


def sentence_rows(bodies: DataFrame) -> DataFrame:
    return bodies.select(*PAGE, F.posexplode(text.sentences(F.col("corps"))).alias("ordre", "phrase"))


def person_mentions(pages: DataFrame) -> DataFrame:
    """Distinct « Prénom NOM » per piece (or page when there is no piece)."""
    key = ["dossier_id", "piece_id"] if "piece_id" in pages.columns else PAGE
    names = F.transform(text.all_found(F.col("texte"), v.RE_PERSONNE), lambda m: F.regexp_replace(m, r"(?U)\s+", " "))
    return pages.select(*key, F.explode(F.array_distinct(names)).alias("nom")).distinct()


def service_mentions(pages: DataFrame) -> DataFrame:
    """First issuing service of each page."""
    return pages.select(*PAGE, text.found(F.col("texte"), v.RE_SERVICE, 1).alias("service"))


_IDENTIFIERS = (
    ("Téléphone", v.RE_TELEPHONE, lambda c: F.regexp_replace(c, r"\D", "")),
    ("Plaque d'immatriculation", v.RE_PLAQUE, lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))),
    ("IBAN", v.RE_IBAN, lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))),
    ("Adresse", v.RE_ADRESSE, lambda c: F.lower(text.squeeze(c))),
)


def identifier_mentions(pages: DataFrame) -> DataFrame:
    """Phones, plates, IBANs and addresses: one row per page and value, with the line of its first match.

    A page's text is one row, so its repeats are dropped inside the row
    (``ordre`` of the first kept) and nothing is shuffled.
    """
    def of_kind(kind: str, pattern: str, normalise) -> Column:
        def rows(found: Column) -> Column:
            raw = F.transform(found, lambda m: F.struct(F.regexp_replace(text.strip(m["valeur"]), ",+$", "").alias("valeur"), m["ligne"].alias("ligne")))
            return F.transform(raw, lambda m, i: F.struct(
                F.lit(kind).alias("type"), normalise(m["valeur"]).alias("cle"), m["valeur"].alias("valeur_brute"), i.alias("ordre"), m["ligne"].alias("citation")))

        def once(found: Column) -> Column:
            return text.let(F.transform(found, lambda r: r["cle"]), lambda keys: F.filter(
                found, lambda r, i: (r["cle"] != "") & (F.array_position(keys, r["cle"]) == i + 1)))

        return text.let(rows(text.match_lines(F.col("texte"), pattern)), once)

    mentions = F.concat(*[of_kind(*spec) for spec in _IDENTIFIERS])
    return pages.select(*PAGE, F.explode(mentions).alias("m")).select(*PAGE, "m.type", "m.cle", "m.valeur_brute", "m.ordre", "m.citation")


def identifier_sentences(pages: DataFrame) -> DataFrame:
    """Every match of an identifier with its place in the text and the sentence that covers it."""
    placed = F.concat(*[_placed(*spec) for spec in _IDENTIFIERS])
    rows = pages.select(*PAGE, "texte", F.explode(placed).alias("m")).where("m.cle <> ''")
    return rows.select(*PAGE, "m.type", "m.cle", "m.debut", _sentence_of(F.col("m.debut")).alias("phrase"))


def sentences_of(pages: DataFrame, pattern: str) -> DataFrame:
    """Every match of a pattern with its place in the text and the sentence that covers it."""
    rows = pages.select(*PAGE, "texte", F.posexplode(text.match_offsets(F.col("texte"), pattern)).alias("ordre", "m"))
    return rows.select(*PAGE, "ordre", "m.valeur", "m.debut", _sentence_of(F.col("m.debut")).alias("phrase"))


def _sentence_of(place: Column) -> Column:
    return text.sentence_at(F.replace(F.col("texte"), F.lit(text.MARK), F.lit("")), place)


def _placed(kind: str, pattern: str, normalise) -> Column:
    return F.transform(text.match_offsets(F.col("texte"), pattern), lambda m: F.struct(
        F.lit(kind).alias("type"), normalise(F.regexp_replace(text.strip(m["valeur"]), ",+$", "")).alias("cle"), m["debut"].alias("debut")))


def seal_mentions(pages: DataFrame) -> DataFrame:
    """Exhibit references with what describes them, their colours and measures."""
    # The text from each reference to the end of the page.
    pattern = v.RE_SCELLE
    parts = F.split(F.regexp_replace("texte", pattern, "\u001e$0"), "\u001e")
    starts = F.transform(
        F.slice(parts, F.lit(2), F.size(parts) - 1),
        lambda x, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), ""),
    )
    rows = pages.select(*PAGE, F.posexplode(starts).alias("ordre", "reste"))
    ref = F.regexp_extract("reste", pattern, 0)
    suite = F.col("reste").substr(F.length(ref) + 1, F.length("reste"))
    paren = F.regexp_extract(suite, r"(?U)^\s*\(([^)\n]{3,150})\)", 1)
    in_line = F.regexp_replace(
        F.substring(F.split(suite, "\n", 2)[0], 1, 150), r"^[ .:;—-]+|[ .:;—-]+$", "")
    described = F.when(paren != "", text.strip(paren)).otherwise(in_line)
    extract = F.when(
        paren != "", F.concat(ref, F.regexp_extract(suite, r"(?U)^\s*\(([^)\n]{3,150})\)", 0))
    ).otherwise(F.concat(ref, F.regexp_replace(F.substring(F.split(suite, "\n", 2)[0], 1, 150), r"(?U)\s+$", "")))
    word = F.upper(F.regexp_extract(ref, pattern, 2))
    number = F.coalesce(
        F.try_element_at(_map(v.NUMEROS_SCELLES), word), word.try_cast("int"),
        F.regexp_extract(ref, pattern, 3).try_cast("int"),
    )
    series = F.substring(F.upper(text.no_accents(F.regexp_extract(ref, pattern, 1))), 1, 4)
    colours = F.transform(text.all_found(described, v.RE_COULEUR, 1), lambda c: F.lower(text.no_accents(c)))
    measures = F.transform(
        text.all_found(described, v.RE_MESURE),
        lambda m: F.lower(F.replace(F.regexp_replace(m, r"(?U)\s+", ""), F.lit(","), F.lit("."))),
    )
    return rows.select(
        *PAGE, "ordre", series.alias("serie"), number.alias("numero"), ref.alias("nom"), described.alias("description"),
        F.array_sort(F.array_distinct(colours)).alias("couleurs"),
        F.array_sort(F.array_distinct(measures)).alias("mesures"),
        text.squeeze(extract).alias("citation"),
    ).filter("description <> ''")


def _words(c: Column) -> Column:
    letter = f"[{v.MAJUSCULES_LATINES}{v.MINUSCULES_LATINES}]"
    edge = F.lit(v.PONCTUATION_BORD.replace("\\", ""))
    bare = F.transform(F.split(text.strip(c), r"(?U)\s+"), lambda w: F.btrim(w, edge))
    return F.filter(bare, lambda w: w.rlike(letter))


def legibility_score(c: Column) -> Column:
    """0 (normal text) to 1 (degraded), a weighted sum of shares of words."""
    low, up = v.MINUSCULES_LATINES, v.MAJUSCULES_LATINES

    def letters(w: Column) -> Column:
        return F.length(F.regexp_replace(w, f"[^{up}{low}]", ""))

    # What a word is searched for, and a pattern that a page with such a word holds somewhere.
    two_cases, stray, framed = f"[{low}][{up}]", f"[{v.PARASITES}]", f"[{up}{low}][0-9]+[{up}{low}]"
    four = f"[{v.CONSONNES}]{{4}}"
    weighted = (
        (3, two_cases, lambda w: w.rlike(two_cases)),
        (5, stray, lambda w: w.rlike(stray)),
        (4, None, lambda w: ~w.rlike(f"[{v.VOYELLES}]") & (letters(w) >= 3)),
        (4, None, lambda w: (F.length(w) == 1) & ~F.lower(w).rlike(f"[{v.LETTRES_ISOLEES}]")),
        (5, framed, lambda w: w.rlike(framed)),
        (4, four, lambda w: w.rlike(four) & F.regexp_replace(w, v.GROUPES_LEGITIMES, "").rlike(four)),
    )

    def count(words: Column, held: str | None, test) -> Column:
        found = F.size(F.filter(words, test))
        # Words are parts of the page: one search of it spares all of them.
        return found if held is None else F.when(c.rlike(held), found).otherwise(0)

    def of_words(words: Column) -> Column:
        score = sum(weight * count(words, held, test) / F.size(words) for weight, held, test in weighted)
        return F.when(F.size(words) < v.MOTS_MINIMUM, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))

    return text.let(_words(c), of_words)


def legibility(pages: DataFrame, threshold: float = v.SEUIL_ILLISIBILITE) -> DataFrame:
    scored = pages.select(*PAGE, F.col("ocr_applique"), legibility_score(F.col("texte")).alias("score"))
    return scored.withColumn("illisible", F.col("score") >= threshold)


def plausibility_share(c: Column) -> Column:
    words = F.transform(text.all_found(c, r"[A-Za-zÀ-ÿ]{2,}"), F.lower)
    return text.let(words, lambda ws: F.when(
        F.size(ws) >= v.MOTS_MIN_POUR_JUGER, F.size(F.filter(ws, lambda w: w.isin(*v.PETITS_MOTS))) / F.size(ws)))


def plausibility(pages: DataFrame) -> DataFrame:
    share = plausibility_share(F.col("texte"))
    return pages.select(*PAGE, share.alias("part")).withColumn("plausible", F.col("part") >= v.PART_PETITS_MOTS_MIN)
