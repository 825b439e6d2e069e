"""Pages → pieces: boundaries, types, attributes, batches and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, vocab as v
from ..functions.dates import instant, opening, date_text
from ..functions.scale import BLOCK, cut_lineage, ordered_rank, ordered_scan, page_block
from .extraction import base_mark, reference_mark

KEY = ["dossier_id", "numero_global"]


def _sheet(lines: Column) -> Column:
    """Number of the sheet (« Feuillet 2/3 ») near the top or bottom."""
    near = F.concat(F.slice(lines, 1, v.LIGNES_FEUILLET), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 3), F.lit(4)))
    numbers = F.transform(F.filter(near, lambda x: x.rlike(v.RE_FEUILLET)), lambda x: F.struct(
        F.regexp_extract(x, v.RE_FEUILLET, 1).try_cast("int").alias("a"),
        F.regexp_extract(x, v.RE_FEUILLET, 2).try_cast("int").alias("b")))
    return F.get(F.filter(numbers, lambda n: (n["a"] > 0) & (n["a"] <= n["b"])), F.lit(0))["a"]


def _starts_with_title(c: Column) -> Column:
    head = F.slice(F.split(c, "\r\n|[\n\r\x0b\x0c]"), 1, v.LIGNES_BRUIT + 2 * v.LIGNES_FRONTIERE)
    shown = F.filter(F.transform(head, text.strip), lambda x: (x != "") & ~text.is_scan_noise(x))
    return F.exists(F.slice(shown, 1, v.LIGNES_FRONTIERE), text.is_title)


def segment(pages: DataFrame) -> DataFrame:
    """``piece_id`` (1, 2, …) and ``ouvre`` (first page of its piece) per page.

    The text is read once, into two flags; the islands are then numbered inside
    blocks of pages and the block totals added up.
    """
    return islands(pages.select(*KEY, "fichier_source", *_boundary(text.lines(F.col("texte")))))


def _boundary(lines: Column) -> list[Column]:
    t = F.col("texte")
    sheet = text.let(lines, _sheet)
    return [text.is_lawyer_page(t).alias("avocat"), F.coalesce(sheet == 1, _starts_with_title(t)).alias("titre")]


def islands(flags: DataFrame) -> DataFrame:
    """``flags`` (dossier_id, numero_global, fichier_source, avocat, titre, and what else a page carries) with ``piece_id`` and ``ouvre``."""
    carried = [c for c in flags.columns if c not in (*KEY, "fichier_source", "avocat", "titre")]
    # Rows meet the totals of their blocks below: the texts are read once, for both.
    flags = cut_lineage(flags.withColumn("bloc", page_block()))

    def opens(before: Column, now: Column) -> Column:
        return (
            before.isNull() | (now["fichier_source"] != before["fichier_source"]) | now["avocat"] | now["titre"]
            | before["avocat"]
        )

    me = F.struct("fichier_source", "avocat", "titre")
    inside = Window.partitionBy("dossier_id", "bloc").orderBy("numero_global")
    rows = flags.withColumn("page", me).withColumn("avant", F.lag(me).over(inside)).withColumn(
        "n", F.row_number().over(inside))
    rows = rows.withColumn("nouvelle", F.when(F.col("n") > 1, opens(F.col("avant"), F.col("page"))))
    # Counted before the join, in the order that the page before was read in: rows of one number keep one order.
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("suivantes", F.sum(F.coalesce(F.col("nouvelle").cast("int"), F.lit(0))).over(upto))
    blocks = rows.groupBy("dossier_id", "bloc").agg(
        F.count_if("nouvelle").alias("ouvertes"), F.min_by("page", "numero_global").alias("tete"),
        F.max_by("page", "numero_global").alias("queue"),
    )
    chain = Window.partitionBy("dossier_id").orderBy("bloc")
    blocks = blocks.withColumn("tete_ouvre", opens(F.lag("queue").over(chain), F.col("tete")))
    blocks = blocks.select(
        "dossier_id", "bloc", "tete_ouvre",
        F.coalesce(F.sum(F.col("ouvertes") + F.col("tete_ouvre").cast("int")).over(
            chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("avant_bloc"),
    )
    opened = F.coalesce("nouvelle", "tete_ouvre")
    head = F.coalesce(F.col("tete_ouvre").cast("int"), F.lit(0))
    return rows.join(blocks, ["dossier_id", "bloc"]).withColumn("ouvre", opened).select(
        *KEY, (F.col("avant_bloc") + head + F.col("suivantes")).cast("int").alias("piece_id"), "ouvre", *carried
    )


def attach_pieces(pages: DataFrame, islands: DataFrame) -> DataFrame:
    return pages.join(islands, KEY)


def piece_bounds(islands: DataFrame) -> DataFrame:
    return islands.groupBy("dossier_id", "piece_id").agg(
        F.min("numero_global").alias("page_debut"), F.max("numero_global").alias("page_fin"))


def header(c: Column) -> Column:
    """Capital lines at the head of a page, reference lines skipped (six at most)."""
    return _header(text.lines(c))


def _header(lines: Column) -> Column:
    def step(acc: Column, line: Column) -> Column:
        # Lines after the head are not looked at.
        skips = (acc["sautees"] < v.LIGNES_TETE) & ((F.size(acc["titres"]) == 0) | line.rlike(v.RE_METADONNEE_ENTETE))
        return (
            F.when(acc["fin"], acc)
            .when(text.is_title(line), F.struct(F.concat(acc["titres"], F.array(line)).alias("titres"), acc["sautees"].alias("sautees"), F.lit(False).alias("fin")))
            .when(skips, F.struct(acc["titres"].alias("titres"), (acc["sautees"] + 1).alias("sautees"), F.lit(False).alias("fin")))
            .otherwise(F.struct(acc["titres"].alias("titres"), acc["sautees"].alias("sautees"), F.lit(True).alias("fin"))))

    start = F.struct(F.array().cast("array<string>").alias("titres"), F.lit(0).alias("sautees"), F.lit(False).alias("fin"))
    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["titres"], " "))


def heading(c: Column) -> Column:
    """What a piece is typed on: « Objet : … » of a report, header, strong titles."""
    return text.let(text.lines(c), _heading)


def _heading(lines: Column) -> Column:
    def parts(top: Column) -> Column:
        return text.let(F.array_join(top, "\n"), lambda joined: with_head(top, joined))

    def with_head(top: Column, joined: Column) -> Column:
        subject = F.regexp_replace(
            F.split(F.regexp_extract(joined, v.RE_OBJET, 1), r"(?U)\s{2,}|Feuillet|N°", 2)[0], "^[ \\-–—]+|[ \\-–—]+$", "")
        link = F.when(F.upper(text.no_accents(F.substring(subject, 1, 1))).isin(*"AEIOUYH"), "D'").otherwise("DE ")
        report = F.when(
            joined.rlike(v.RE_OBJET) & joined.rlike(r"(?iU)PROC[ÈE]S[- ]?VERBAL"),
            F.concat(F.lit("PROCÈS-VERBAL "), link, F.upper(subject)))
        strong = F.array_join(F.filter(top, lambda x: x.rlike(v.RE_INTITULE_FORT)), " ")
        return F.concat_ws(" ", report, F.nullif(_header(lines), F.lit("")), F.nullif(strong, F.lit("")))

    return text.let(F.slice(lines, 1, v.LIGNES_FEUILLET), parts)


def type_by_rules(title: Column, rules=v.REGLES_TYPE) -> Column:
    """First rule, in order, all of whose accent-free words occur."""
    flat = F.replace(text.no_accents(F.upper(title)), F.lit("’"), F.lit("'"))

    def first_match(t: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for words, kind in rules:
            hit = F.lit(True)
            for word in words:
                hit = hit & t.contains(word)
            chosen = chosen.when(hit, kind)
        return chosen.otherwise(v.NON_IDENTIFIE)

    return text.let(flat, first_match)


def classify(pages: DataFrame, threshold: float = v.SEUIL_CONFIANCE, rules=v.REGLES_TYPE) -> DataFrame:
    """Pages with ``piece_id``/``ouvre`` → one typed row per piece."""
    t = F.col("texte")
    head = F.when(F.col("ouvre"), text.let(text.lines(t), lambda ls: _typed_head(ls, rules)))
    # Typed before the shuffle, where the pages are spread over all tasks.
    marks = pages.select("dossier_id", "piece_id", "numero_global", t.rlike(v.RE_DOCUMENT_AVOCAT).alias("document"), head.alias("tete"))
    return _typed(marks, threshold)


def segment_and_classify(pages: DataFrame, threshold: float = v.SEUIL_CONFIANCE, rules=v.REGLES_TYPE) -> DataFrame:
    """Pages → one typed row per piece, in one pass over the texts.

    Every page is reduced to its flags and to what it would be typed as if it opened a
    piece; the lines of a page are cut once for all of these, and no text is shuffled.
    """
    t = F.col("texte")
    read = text.let(text.lines(t), lambda ls: F.struct(_sheet(ls).alias("feuillet"), _typed_head(ls, rules).alias("tete")))
    flags = pages.select(*KEY, "fichier_source", text.is_lawyer_page(t).alias("avocat"), _starts_with_title(t).alias("haut"),
                         t.rlike(v.RE_DOCUMENT_AVOCAT).alias("document"), read.alias("lu"))
    flags = flags.select(*KEY, "fichier_source", "avocat", F.coalesce(F.col("lu.feuillet") == 1, F.col("haut")).alias("titre"), "document", F.col("lu.tete").alias("tete"))
    return _typed(islands(flags), threshold)


def _typed_head(lines: Column, rules) -> Column:
    return text.let(_heading(lines), lambda h: F.struct(
        h.alias("intitule"), type_by_rules(h, rules).alias("type"), F.substring(F.col("texte"), 1, 600).rlike(v.RE_PROCES_VERBAL).alias("pv")))


def _typed(marks: DataFrame, threshold: float) -> DataFrame:
    pieces = marks.groupBy("dossier_id", "piece_id").agg(
        F.min("numero_global").alias("page_debut"), F.max("numero_global").alias("page_fin"),
        F.bool_or("document").alias("avocat"), F.min_by("tete", "numero_global").alias("tete"),
    )
    kind = F.when(F.col("avocat") & ~F.col("tete.pv"), v.DOCUMENT_AVOCAT).otherwise(F.col("tete.type"))
    typed = pieces.select("dossier_id", "piece_id", "page_debut", "page_fin", kind.alias("type"),
                          F.col("tete.intitule").alias("intitule"))
    confidence = F.when(F.col("type") == v.NON_IDENTIFIE, 0.0).otherwise(1.0)
    return typed.withColumn("confiance", confidence).withColumn("statut_revision", revision_status(threshold))


def revision_status(threshold: float = v.SEUIL_CONFIANCE) -> Column:
    return F.when((F.col("confiance") >= threshold) & (F.col("type") != v.NON_IDENTIFIE), "ok").otherwise("a_relire")


def accept_types(pieces: DataFrame, proposals: DataFrame, threshold: float = v.SEUIL_CONFIANCE) -> DataFrame:
    """Untyped pieces take a proposed type of the closed list."""
    offered = proposals.select(
        "dossier_id", "piece_id", F.col("type").alias("__type"), F.col("confiance").cast("double").alias("__conf"))
    known = F.col("__type").isin(*v.CATEGORIES)
    open_ = F.col("type") == v.NON_IDENTIFIE
    joined = pieces.join(offered, ["dossier_id", "piece_id"], "left")
    return joined.withColumn("confiance", F.when(open_ & known, F.coalesce("__conf", F.lit(0.0))).otherwise(F.col("confiance"))
                             ).withColumn("type", F.when(open_ & known, F.col("__type")).otherwise(F.col("type"))
                                          ).withColumn("statut_revision", revision_status(threshold)).drop("__type", "__conf")


def piece_attributes(pages: DataFrame) -> DataFrame:
    """Opening date and hour, service and base reference mark of each piece.

    Candidates are read page by page, so that a piece of any length is a plain
    aggregation: the best formula wins, then the first page.
    """
    t = F.col("texte")
    found = pages.select(
        "dossier_id", "piece_id", "numero_global",
        opening(t).alias("o"), date_text(text.found(t, v.RE_DATE_ACTE, 1)).alias("d"),
        text.found(t, v.RE_SERVICE, 1).alias("s"),
        (F.col("cote_detectee") if "cote_detectee" in pages.columns else reference_mark(t)).alias("c"),
        F.col("ouvre"),
    ).withColumn("o", F.when(F.col("ouvre") | (F.col("o.rang") < 4), F.col("o")))
    n = F.col("numero_global")
    best = found.groupBy("dossier_id", "piece_id").agg(
        F.min_by("o", F.when(F.col("o").isNotNull(), F.struct(F.col("o.rang"), n))).alias("o"),
        F.min_by("d", F.when(F.col("d").isNotNull(), n)).alias("d"),
        F.min_by("s", F.when(F.col("s").isNotNull(), n)).alias("service_redacteur"),
        F.min_by("c", F.when(F.col("c").isNotNull(), n)).alias("c"),
    )
    return best.select(
        "dossier_id", "piece_id", F.when(F.col("o").isNotNull(), F.col("o.date")).otherwise(F.col("d")).alias("date_apparente"),
        F.col("o.heure").alias("heure_apparente"), "service_redacteur", base_mark(F.col("c")).alias("cote"),
    )


def consecutive_ranges(df: DataFrame, page: str = "page") -> DataFrame:
    """Page numbers → runs of consecutive pages."""
    distinct = df.select("dossier_id", page).distinct()
    ranked = ordered_rank(distinct, ["dossier_id"], F.floor(F.col(page) / BLOCK), [page], "__r")
    return ranked.groupBy("dossier_id", (F.col(page) - F.col("__r")).alias("__i")).agg(
        F.min(page).alias("debut"), F.max(page).alias("fin")).drop("__i")


def page_batches(pages: DataFrame, limit: int = v.TAILLE_LOT, fold_up_to: int = BLOCK) -> DataFrame:
    """Pack a piece's pages, in order, in batches of at most ``limit`` characters.

    A page is never split; an oversized one is alone.  Pieces of ordinary size
    are folded in one pass over their (page, length) pairs; a piece with more
    than ``fold_up_to`` pages follows the « next batch » pointers instead.
    """
    key = ["dossier_id", "piece_id"]
    sized = pages.select(*key, "numero_global", F.length("texte").alias("taille"))
    counts = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    small = sized.join(counts.filter(F.col("__n") <= fold_up_to), key, "left_semi")
    large = sized.join(counts.filter(F.col("__n") > fold_up_to), key, "left_semi")

    def step(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & (acc["taille"] + p["taille"] > limit)
        batch = F.when(full, acc["lot"] + 1).otherwise(acc["lot"])
        return F.struct(
            batch.alias("lot"), F.when(full, p["taille"]).otherwise(acc["taille"] + p["taille"]).alias("taille"),
            F.lit(1).alias("n"),
            F.concat(acc["pages"], F.array(F.struct(p["numero_global"].alias("numero_global"), batch.alias("lot")))).alias("pages"),
        )

    start = F.struct(F.lit(1).alias("lot"), F.lit(0).alias("taille"), F.lit(0).alias("n"),
                     F.array().cast("array<struct<numero_global:int,lot:int>>").alias("pages"))
    folded = small.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("numero_global", "taille"))).alias("ps")).select(
        *key, F.explode(F.aggregate("ps", start, step, lambda acc: acc["pages"])).alias("p")).select(*key, "p.*")
    return folded.unionByName(_batches_by_pointers(large, key, limit))


def _batches_by_pointers(sized: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Batches of long pieces: each page knows the first page of the batch after
    the one it would open; the batch starts are the pages reached from the first."""
    n = F.col("numero_global")
    total = ordered_scan(sized, key, page_block(), ["numero_global"], sums={"cumul": F.col("taille")})
    ends = total.select(*key, F.col("cumul").alias("valeur"), n.alias("page"), F.lit(None).cast("int").alias("depart"))
    asks = total.select(*key, (F.col("cumul") - F.col("taille") + limit).alias("valeur"), F.lit(None).cast("int").alias("page"),
                        n.alias("depart"))
    # Going down the running sizes, the last page seen is the first one past the limit.
    line = ends.unionByName(asks).withColumn("__o", F.struct(
        -F.col("valeur"), F.col("depart").isNull().cast("int"), -F.coalesce("page", F.lit(0))))
    after = ordered_scan(line, key, F.floor(-F.col("valeur") / (limit * 64)), ["__o"], lasts={"suite": F.col("page")})
    # An oversized page is alone: the batch after it opens on the very next page.
    big = ordered_scan(sized, key, F.negative(page_block()), [F.negative("numero_global")], lags={"suivante": n}).filter(F.col("taille") > limit)
    jump = after.filter("depart is not null").select(*key, F.col("depart").alias("de"), "suite").join(
        big.select(*key, n.alias("de"), "suivante", F.lit(True).alias("seule")), [*key, "de"], "left").select(
        *key, "de", F.when(F.col("seule"), F.col("suivante")).otherwise(F.col("suite")).alias("vers"))
    starts = sized.groupBy(*key).agg(F.min("numero_global").alias("de"))
    longest = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not longest:  # no long piece: nothing to follow
        return sized.select(*key, "numero_global", F.lit(0).alias("lot")).filter("false")
    # Each doubling reads the one before twice: written, the chain stays linear.
    jumps = [cut_lineage(jump)]
    while (1 << len(jumps)) <= longest:
        a, b = jumps[-1].alias("a"), jumps[-1].select(*key, F.col("de").alias("vers"), F.col("vers").alias("loin")).alias("b")
        jumps.append(cut_lineage(a.join(b, [*key, "vers"]).select(*key, "de", F.col("loin").alias("vers"))))
    for hop in reversed(jumps):
        reached = starts.join(hop, [*key, "de"]).select(*key, F.col("vers").alias("de")).filter("de is not null")
        starts = cut_lineage(starts.unionByName(reached))
    opened = sized.join(starts.distinct().withColumnRenamed("de", "numero_global").withColumn("o", F.lit(1)),
                        [*key, "numero_global"], "left")
    return ordered_scan(opened, key, page_block(), ["numero_global"], sums={"lot": F.coalesce("o", F.lit(0))}).select(
        *key, "numero_global", F.col("lot").cast("int").alias("lot"))


def title_batches(pieces: DataFrame, size: int = v.PIECES_PAR_APPEL) -> DataFrame:
    """Fixed batches of pieces, in page order."""
    ranked = ordered_rank(pieces, ["dossier_id"], F.floor(F.col("page_debut") / BLOCK), ["page_debut"], "__r")
    return ranked.withColumn("lot", F.floor((F.col("__r") - 1) / size).cast("int") + 1).drop("__r")


def piece_index(pieces: DataFrame) -> DataFrame:
    """Rank of each piece in page order and in time (undated last)."""
    when = instant(F.col("date_apparente"), F.coalesce("heure_apparente", F.lit("00h00")))
    dated = pieces.withColumn("__t", when)
    by_page = ordered_rank(dated, ["dossier_id"], F.floor(F.col("page_debut") / BLOCK), ["page_debut"], "ordre_pages")
    undated = F.col("__t").isNull()
    ranked = ordered_rank(
        by_page, ["dossier_id"],
        [F.struct(undated.alias("u"), F.to_date("__t").alias("d")),
         F.struct(F.col("__t").alias("t"), F.floor(F.col("page_debut") / BLOCK).alias("b"))],
        [undated.asc(), F.col("__t").asc(), F.col("page_debut").asc()], "ordre_chronologique",
    )
    return ranked.drop("__t")
