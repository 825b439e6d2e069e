"""Case elements, relevant pages and guarded answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, vocab as v
from ..functions.scale import BLOCK, cut_lineage, ordered_rank, ordered_scan, spread
from ..functions.search import in_blocks
from .guards import absent_among, asserted, single_version
from .verification import verify


def case_elements(facts: DataFrame, acts: DataFrame, statements: DataFrame, persons: DataFrame, pieces: DataFrame) -> DataFrame:
    """Verified facts (F), acts (P) and statements (D) as numbered elements."""
    names = persons.select("dossier_id", "personne_id", "nom")
    dates = pieces.select("dossier_id", "piece_id", F.col("date_apparente").alias("date_piece"), F.col("heure_apparente").alias("heure_piece"))

    def read(df: DataFrame, who: str) -> DataFrame:
        return df.filter("statut_verif = 'verifie'").withColumnRenamed(who, "personne_id").join(names, ["dossier_id", "personne_id"], "left")

    quote = F.concat(F.lit(" — « "), F.col("citation"), F.lit(" »"))
    shared = ["dossier_id", "famille", "cle", "page", "citation", "libelle", "ligne"]

    def out(df: DataFrame, family: str, number: str, line: Column) -> DataFrame:
        return df.select("dossier_id", F.lit(family).alias("famille"), F.concat(F.lit(family), F.col(number).cast("string")).alias("cle"), "page", "citation",
                         F.coalesce("nom", F.lit("")).alias("libelle"), line.alias("ligne")).select(*shared)

    f = read(facts, "personne_id_source").join(dates, ["dossier_id", "piece_id"], "left")
    when = F.concat_ws(" ", "date_piece", "heure_piece")
    who = F.when(F.col("nom").isNotNull(), F.concat(F.lit(" ("), F.col("nom"), F.lit(")"))).otherwise("")
    fl = F.concat(F.when(when != "", F.concat(F.lit("[pièce du "), when, F.lit("] "))).otherwise(""), F.col("description"), who, quote)
    a = read(acts, "personne_id")
    al = F.concat(F.col("nature"), F.lit(" "), F.concat_ws(" ", "date", "heure"), F.when(F.col("nom").isNotNull(), F.concat(F.lit(", "), F.col("nom"))).otherwise(""), quote)
    d = read(statements, "personne_id").join(dates, ["dossier_id", "piece_id"], "left")
    dl = F.concat(F.when(F.col("date_piece").isNotNull(), F.concat(F.lit("Le "), F.col("date_piece"), F.lit(", "))).otherwise(""),
                  F.coalesce("nom", F.lit("déclarant non identifié")), F.lit(" déclare : "), F.col("point_factuel"), quote)
    return out(f, "F", "fait_id", fl).unionByName(out(a, "P", "acte_id", al)).unionByName(out(d, "D", "declaration_id", dl))


def within_budget(elements: DataFrame, budget: int = v.BUDGET_ELEMENTS) -> DataFrame:
    """Over budget, the same share of each family at even intervals of pages."""
    size = elements.groupBy("dossier_id").agg(F.sum(F.length("ligne") + 16).alias("__t"))
    counts = elements.groupBy("dossier_id", "famille").agg(F.count(F.lit(1)).alias("__len"))
    number = F.regexp_extract("cle", r"(\d+)", 1).cast("int")
    ranked = ordered_rank(elements.withColumn("__i", number), ["dossier_id", "famille"], F.floor(F.col("page") / BLOCK), ["page", "__i"], "__r")
    joined = ranked.join(size, "dossier_id").join(counts, ["dossier_id", "famille"])
    n = F.floor(F.col("__len") * (F.lit(float(budget)) / F.col("__t")))
    # Position p is kept when p = floor(i * len / n) for some i < n.
    p = F.col("__r") - 1
    i = F.ceil(p * n / F.col("__len"))
    kept = (n > 0) & (F.floor(i * F.col("__len") / n) == p) & (i < n)
    return joined.filter((F.col("__t") <= budget) | kept).select(*elements.columns)


def summary_elements(elements: DataFrame, statements: DataFrame, persons: DataFrame) -> DataFrame:
    """Elements of the short summary: facts, acts, and statements of the client
    (of the suspects when there is no client)."""
    client = persons.filter("est_client").select("dossier_id").distinct().withColumn("__c", F.lit(True))
    chosen = persons.join(client, "dossier_id", "left").filter(F.when(F.col("__c"), F.col("est_client")).otherwise(F.col("role") == "mis_en_cause"))
    own = statements.join(chosen.select("dossier_id", "personne_id"), ["dossier_id", "personne_id"], "left_semi").select(
        "dossier_id", F.concat(F.lit("D"), F.col("declaration_id").cast("string")).alias("cle"))
    told = elements.filter("famille = 'D'").join(own, ["dossier_id", "cle"], "left_semi")
    return elements.filter("famille <> 'D'").unionByName(told)


def stems(c: Column) -> Column:
    """Useful words, cut to seven letters."""
    words = text.all_found(text.normalised(c), "[a-z0-9]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*v.MOTS_VIDES)), lambda w: F.substring(w, 1, v.LONGUEUR_RACINE)))


# Questions and pages of a case that meet in one task.
QUESTIONS_AT_ONCE, PAGES_AT_ONCE = 1000, 2000
# Scores that differ by less may be in either order once they are rounded.
ROUNDING = 2e-6


def relevance(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Score of each page for each question of its case: rare shared stems weigh more."""
    return _scores(questions, pages).select("dossier_id", "question_id", "numero_global", F.round("score", 6).alias("score"))


def _scores(questions: DataFrame, pages: DataFrame, budget: int | None = None) -> DataFrame:
    """(dossier_id, question_id, numero_global, score, taille): a row per question and page with a common stem.

    Blocks of a case's questions meet blocks of its pages, each with its stems, and scores are
    summed there: nothing is written per stem and pair.  With ``budget`` only pages that may be
    among those taken come back, with their length: before a page that is taken, all better ones
    that are no longer than it are taken too, so their lengths and its own fit the budget.
    """
    asked = questions.select("dossier_id", "question_id", F.explode(stems(F.col("question"))).alias("racine"))
    # Each text is read once; its stems are counted, dealt to blocks and scored.
    read = cut_lineage(pages.select("dossier_id", "numero_global", F.length("texte").alias("taille"), stems(F.col("texte")).alias("racines"))).where("size(racines) > 0")
    total = pages.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("__n"))
    seen = read.select("dossier_id", F.explode("racines").alias("racine")).groupBy("dossier_id", "racine").agg(F.count(F.lit(1)).alias("__df"))
    weights = seen.join(total, "dossier_id").select("dossier_id", "racine", (F.log((F.col("__n") + 1) / (F.col("__df") + 1)) + 1).alias("poids"))
    weighed = cut_lineage(asked.join(weights, ["dossier_id", "racine"]).groupBy("dossier_id", "question_id").agg(F.collect_list(F.struct("racine", "poids")).alias("x")))

    left = in_blocks(weighed, QUESTIONS_AT_ONCE, "bloc_q", F.col("question_id"))
    right = in_blocks(read, PAGES_AT_ONCE, "bloc_p", F.col("numero_global"))
    each_q, each_p = left.select("dossier_id", "bloc_q").distinct(), right.select("dossier_id", "bloc_p").distinct()
    blocks = ["dossier_id", "bloc_q", "bloc_p"]
    no = F.lit(None)
    page, question = pages.schema["numero_global"].dataType, questions.schema["question_id"].dataType
    asking = left.join(each_p, "dossier_id").select(
        *blocks, F.lit(0).alias("sorte"), "question_id", no.cast(page).alias("numero_global"), no.cast("int").alias("taille"),
        F.transform("x", lambda e: e["racine"]).alias("racines"), F.transform("x", lambda e: e["poids"]).alias("poids"))
    told = right.join(each_q, "dossier_id").select(
        *blocks, F.lit(1).alias("sorte"), no.cast(question).alias("question_id"), "numero_global", "taille", "racines", no.cast("array<double>").alias("poids"))
    both = spread(asking.unionByName(told), *blocks).sortWithinPartitions(*blocks, "sorte", "question_id", "numero_global")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                for case, q, p, kind, question_id, number, size, words, weights in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns)):
                    if block is None or block.key != (case, q, p):
                        if block is not None:
                            yield from block.rows(budget)
                        block = _Meeting((case, q, p), (whole.schema.field(4).type, whole.schema.field(5).type))
                    if kind == 0:
                        block.ask(question_id, words, weights)
                    else:
                        block.tell(number, size, words)
        if block is not None:
            yield from block.rows(budget)

    kinds = f"question_id {question.simpleString()}, numero_global {page.simpleString()}"
    return both.mapInArrow(run, f"dossier_id string, {kinds}, score double, taille int")


class _Meeting:
    """A block of questions and a block of pages of one case."""

    def __init__(self, key: tuple, kinds: tuple) -> None:
        self.key, self.kinds, self.questions, self.held = key, kinds, [], {}
        self.pages: list = []
        self.sizes: list[list[int | None]] = []
        self.scores: list[np.ndarray] = []

    def ask(self, question, words: list[str], weights: list[float]) -> None:
        for word, weight in zip(words, weights):
            at, of = self.held.setdefault(word, ([], []))
            at.append(len(self.questions))
            of.append(weight)
        self.questions.append(question)

    def tell(self, page, size: int, words: list[str]) -> None:
        if not self.scores:
            self.held = {w: (np.array(at, np.int64), np.array(of)) for w, (at, of) in self.held.items()}
        found = [self.held[w] for w in words if w in self.held]
        n = len(self.questions)
        score = np.bincount(np.concatenate([a for a, _ in found]), np.concatenate([w for _, w in found]), n) if found else np.zeros(n)
        if self.pages and self.pages[-1] == page:  # rows of one page come one after the other
            self.scores[-1] = self.scores[-1] + score
            self.sizes[-1].append(size)
        else:
            self.pages.append(page)
            self.sizes.append([size])
            self.scores.append(score)

    def rows(self, budget: int | None) -> Iterator[pa.RecordBatch]:
        if not self.scores:
            return
        scores = np.array(self.scores)
        if budget is None:
            number, size = np.arange(len(scores)), None
            keep = scores > 0
        else:
            fit = [(i, s) for i, sizes in enumerate(self.sizes) for s in sizes if s is not None and s <= budget]
            if not fit:
                return
            number, size = (np.array(column, np.int64) for column in zip(*fit))
            scores = scores[number]
            keep = (scores > 0) & _may_fit(scores, size, budget)
        questions, pages = (pa.array(ids, kind) for ids, kind in zip((self.questions, self.pages), self.kinds))
        for start in range(0, len(scores), 128):
            at, q = np.nonzero(keep[start:start + 128])
            at = at + start
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.key[0]] * len(at), pa.string()), questions.take(pa.array(q)), pages.take(pa.array(number[at])), pa.array(scores[at, q]),
                 pa.nulls(len(at), pa.int32()) if size is None else pa.array(size[at], pa.int32())],
                names=["dossier_id", "question_id", "numero_global", "score", "taille"])


def _may_fit(scores: np.ndarray, size: np.ndarray, budget: int) -> np.ndarray:
    """For pages (rows) and questions (columns): whether the better pages that are no longer than a page fit the budget with it.

    Lengths are compared with up to 32 steps, which sums up fewer pages, never more.
    """
    order = np.argsort(-scores, axis=0, kind="stable")
    ranked, long = np.take_along_axis(scores, order, 0), size[order]
    place = np.arange(len(scores))[:, None]
    gap = np.vstack([np.full((1, scores.shape[1]), True), ranked[:-1] - ranked[1:] > ROUNDING])
    first = np.maximum.accumulate(np.where(gap, place, 0), axis=0)  # pages before this place are better for certain
    steps = np.unique(np.quantile(size, np.linspace(0, 1, 32), method="lower"))
    step = np.searchsorted(steps, size, "right")[order] - 1
    fits = np.ones(scores.shape, bool)
    for i, most in enumerate(steps.tolist()):
        before = np.cumsum(np.where(long <= most, long, 0), axis=0)
        before = np.vstack([np.zeros((1, scores.shape[1]), before.dtype), before])
        fits &= (step != i) | (np.take_along_axis(before, first, 0) + long <= budget)
    out = np.empty_like(fits)
    np.put_along_axis(out, order, fits, 0)
    return out


def relevant_pages(questions: DataFrame, pages: DataFrame, budget: int = v.BUDGET_QUESTION) -> DataFrame:
    """Pages for each question: the whole case when it fits, else the best pages
    that fit, one that does not being skipped.

    Each round takes the longest prefix of the ranking that fits and drops the
    pages longer than what is left; it ends when no page fits.
    """
    sizes = pages.select("dossier_id", "numero_global", F.length("texte").alias("taille"))
    totals = sizes.groupBy("dossier_id").agg(F.sum("taille").alias("__t"))
    small = totals.filter(F.col("__t") <= budget)
    asked = questions.select("dossier_id", "question_id")
    whole = asked.join(small.select("dossier_id"), "dossier_id").join(sizes, "dossier_id").select("dossier_id", "question_id", "numero_global")
    large = questions.join(small, "dossier_id", "left_anti")
    key = ["dossier_id", "question_id"]
    scored = _scores(large, pages.join(small, "dossier_id", "left_anti"), budget).withColumn("score", F.round("score", 6)).filter("score > 0")
    waiting = cut_lineage(scored.withColumn("reste", F.lit(budget)))
    taken = None
    while not waiting.isEmpty():
        summed = cut_lineage(_prefix_sums(waiting, key))
        now = summed.filter("cumul <= reste").select(*key, "numero_global", "taille")
        taken = now if taken is None else taken.unionByName(now)
        used = now.groupBy(*key).agg(F.sum("taille").alias("__u"))
        waiting = cut_lineage(summed.filter("cumul > reste").join(used, key, "left").withColumn(
            "reste", F.col("reste") - F.coalesce("__u", F.lit(0))).filter("taille <= reste").drop("__u", "cumul"))
    if taken is not None:
        whole = whole.unionByName(taken.select("dossier_id", "question_id", "numero_global"))
    return whole


def _prefix_sums(waiting: DataFrame, key: list[str]) -> DataFrame:
    block = F.struct(F.negative("score").alias("s"), F.floor(F.col("numero_global") / BLOCK).alias("b"))
    place = waiting.withColumn("__o", F.struct(F.negative("score").alias("s"), F.col("numero_global").alias("p")))
    return ordered_scan(place, key, block, ["__o"], sums={"cumul": F.col("taille")}).drop("__o")


def guard_answers(proposals: DataFrame, questions: DataFrame, pages: DataFrame, persons: DataFrame, versions: DataFrame) -> DataFrame:
    """Status of each proposed answer: sourcee, passages or introuvable.

    ``proposals``: (dossier_id, question_id, essai, reponse, citations array of
    (page, citation)).  The second attempt replaces the first only if sourced.
    """
    key = ["dossier_id", "question_id", "essai"]
    # Answers are met several times below; whatever their citations were cut from is read once.
    proposals = cut_lineage(proposals.select(*key, text.strip(F.coalesce("reponse", F.lit(""))).alias("texte"), "citations"))
    quotes = proposals.select(*key, F.posexplode("citations").alias("rang", "c")).select(
        *key, "rang", "c.page", F.regexp_replace(text.strip(F.col("c.citation")), "^[\"“”]+|[\"“”]+$", "").alias("citation"))
    good = cut_lineage(verify(quotes, pages).filter("statut_verif = 'verifie'").select(*key, "rang", "page", "citation"))
    shown = good.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rang", "page", "citation"))), lambda x: F.struct(
        x["page"].alias("page"), x["citation"].alias("citation"))).alias("citations"))
    answers = proposals.select(*key, "texte").join(shown, key, "left")
    # The reference of an answer: the pages it cites, its question, the names these complete; only answers that assert something have it read.
    wanted = asserted(proposals.where("texte <> ''").select(*key, "texte"), key)
    checked = wanted.select(*key).distinct()
    cited = good.select(*key, "page").distinct().join(checked, key, "left_semi").join(pages.select("dossier_id", F.col("numero_global").alias("page"), "texte"), ["dossier_id", "page"]).select(*key, "texte")
    asked = proposals.select(*key).join(checked, key, "left_semi").join(questions.select("dossier_id", "question_id", F.col("question").alias("texte")), ["dossier_id", "question_id"])
    sources = cited.unionByName(asked.select(*key, "texte"))
    parts = F.array_distinct(F.transform(text.all_found(F.col("texte"), r"(?U)\b\p{Lu}[\p{L}]{2,}"), lambda w: text.normalised(w)))
    named = persons.select("dossier_id", "nom", F.explode(F.filter(F.split(text.normalised(F.col("nom")), "[^a-z]+"), lambda p: F.length(p) >= 3)).alias("partie"))
    names = sources.select(*key, F.explode(parts).alias("partie")).join(named, ["dossier_id", "partie"]).select(*key, F.col("nom").alias("texte")).distinct()
    invented = absent_among(wanted, sources.unionByName(names), key).select(*key).distinct().withColumn("invente", F.lit(True))
    t = F.col("texte")
    bare = F.regexp_replace("texte", v.RE_COUPURE, "")
    judged = answers.join(invented, key, "left").withColumn("probleme", F.coalesce("invente", F.lit(False)) | t.rlike(v.RE_JUGEMENT) | bare.rlike(r"[\[\]]") | t.rlike(v.RE_PERIODE_VIDE))
    status = (F.when(F.col("citations").isNull() | (t == ""), "introuvable").when(t.rlike(v.RE_QUALIFICATION) | F.col("probleme"), "passages").otherwise("sourcee"))
    judged = cut_lineage(judged.withColumn("statut", status))
    partial = single_version(judged.filter("statut = 'sourcee'"), versions, ["question_id", "essai"]).join(
        versions.withColumn("v", F.array_join("versions", " ou ")).select("dossier_id", "libelle", "v"), ["dossier_id", "libelle"]).groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(" Attention : les pièces ne concordent pas sur ce point ("), F.col("libelle"), F.lit(" : "), F.col("v"),
                                                         F.lit(") — voir l'onglet des contradictions.")))), "").alias("ajout"))
    answer = (F.when(F.col("statut") == "introuvable", v.MESSAGE_INTROUVABLE).when((F.col("statut") == "passages") & t.rlike(v.RE_QUALIFICATION), v.MESSAGE_QUALIFICATION)
              .when(F.col("statut") == "passages", v.MESSAGE_PASSAGES).otherwise(F.concat(t, F.coalesce("ajout", F.lit("")))))
    final = judged.join(partial, key, "left").withColumn("reponse", answer)
    preference = F.when((F.col("statut") == "sourcee") & (F.col("essai") > 1), 0).otherwise(F.col("essai"))
    return final.groupBy("dossier_id", "question_id").agg(F.min_by(F.struct(
        "essai", "statut", "reponse", F.when(F.col("statut") != "introuvable", F.col("citations")).alias("citations")), preference).alias("x")).select("dossier_id", "question_id", "x.*")


def procedure_points(questions: DataFrame, findings: DataFrame, length: int | None = None) -> DataFrame:
    """Questions on nullity get the case's findings, one row per finding; ``length`` reads only so many letters of a question."""
    said = text.strip(F.col("question"))
    asked = questions.filter((said if length is None else F.substring(said, 1, length)).rlike(v.RE_QUESTION_NULLITE))
    sourced = findings.filter("page is not null and citation is not null").select("dossier_id").distinct()
    return asked.join(sourced, "dossier_id", "left_semi").join(findings.select("dossier_id", "titre", "page", "citation"), "dossier_id").select(
        "dossier_id", "question_id", F.lit("passages").alias("statut"), "titre", "page", "citation")
