"""Page tables: reading, numbering, admission, schema upgrade, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text, vocab as v
from ..functions.scale import BLOCK, cut_lineage, ordered_rank, ordered_scan
from ..operators.extraction import reference_mark
from ..schemas import DEFAULTS, PAGES


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast, with its defaults where missing."""
    def column(field: T.StructField) -> Column:
        default = F.lit(DEFAULTS.get(field.name)).cast(field.dataType)
        if field.name not in df.columns:
            return default.alias(field.name)
        kept = F.col(field.name).cast(field.dataType)
        return (F.coalesce(kept, default) if field.name in DEFAULTS else kept).alias(field.name)

    return df.select(*[column(f) for f in schema])


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page table with an enforced schema (parquet, json, orc or csv)."""
    return spark.read.schema(PAGES).format(fmt).load(path)


def pages_with_marks(pages: DataFrame) -> DataFrame:
    """Complete raw pages with reference mark, fingerprint and status."""
    return conform(
        pages.withColumn("cote_detectee", reference_mark(F.col("texte")))
        .withColumn("empreinte_sha256", fingerprint(F.col("texte"))),
        PAGES,
    )


def fingerprint(c: Column) -> Column:
    """SHA-256 of the stripped text; an empty text hashes no bytes."""
    return F.sha2(F.encode(text.strip(c), "UTF-8"), 256)


def number_pages(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Give ``numero_global`` to new pages (``rang_fichier``, ``page_fichier``)."""
    last = existing.groupBy("dossier_id").agg(F.max("numero_global").alias("__max"))
    ranked = ordered_rank(
        new, ["dossier_id"], F.struct("rang_fichier", F.floor(F.col("page_fichier") / BLOCK)),
        ["rang_fichier", "page_fichier"], "__rang",
    )
    return (
        ranked.join(last, "dossier_id", "left")
        .withColumn("numero_global", F.col("__rang") + F.coalesce("__max", F.lit(0)))
        .drop("__rang", "__max")
    )


def new_files(batch: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Pages of files not ingested yet, by name; all of them when forced."""
    if force:
        return batch
    known = existing.select("dossier_id", "fichier_source").distinct()
    return batch.join(known, ["dossier_id", "fichier_source"], "left_anti")


# The number that a name ends with, as a later file of the name before it would get: ``a_2.pdf`` after ``a.pdf``.
_SUFFIX = "_(?:[2-9]|[1-9][0-9]{1,16})"
FOLDED = 4096  # numbers of one family that one cell holds


def _named(files: DataFrame) -> DataFrame:
    """Stem and extension of each name, the name it may be a numbered copy of, that number, and how many numbers it ends with."""
    stem = F.regexp_extract("nom", r"(?s)^(.+?)(\.[^.]*)?$", 1)
    numbered = F.regexp_extract("souche", rf"(?s)^.+?((?:{_SUFFIX})*)$", 1)
    last = F.regexp_extract("souche", rf"(?s)^(.+)_({_SUFFIX[1:]})$", 1)
    number = F.regexp_extract("souche", rf"(?s)^.+_({_SUFFIX[1:]})$", 1)
    return files.withColumn("souche", stem).withColumn("extension", F.substring("nom", F.length(stem) + 1, F.length("nom"))).withColumn(
        "profondeur", F.length(numbered) - F.length(F.regexp_replace(numbered, "_", ""))).withColumn(
        "parent", F.when(number != "", F.concat(last, F.col("extension")))).withColumn("k", F.when(number != "", number).cast("long"))


def disambiguate(files: DataFrame) -> DataFrame:
    """Same name twice in a case: the later file takes the lowest free number, ``a_2.pdf``, ``a_3.pdf`` …

    A number is taken once a file before has got it, or once one has asked for that
    very name (then it has it, or someone else does).  So the files that ask for a
    name in vain are ranked, and the numbers asked for by name are the gaps their
    ranks have to jump: number ``c``, first asked for after ``q`` of them had come,
    stands in the way of rank ``c - 1 - s`` when ``s`` gaps lie before it, unless that
    rank is ``q`` or less.  Names are settled before those that are numbered after
    them, as a given number may be what a later file asks for.
    """
    key = ["dossier_id", "nom"]
    asked = cut_lineage(ordered_rank(_named(files.select("dossier_id", "rang", "nom")), key, F.floor(F.col("rang") / BLOCK), ["rang"], "demande"))
    names = cut_lineage(asked.groupBy(*key, "souche", "extension", "parent", "k", "profondeur").agg(F.min("rang").alias("premier"), F.count(F.lit(1)).alias("n")))
    taken = None  # names that were given to files which asked for the name before
    settled, depth = [], -1
    while True:
        live = names.withColumn("pris", F.lit(False)) if taken is None else names.join(taken, key, "left").withColumn("pris", F.coalesce("pris", F.lit(False)))
        live = live.where((F.col("profondeur") > depth) & (F.col("pris") | (F.col("n") > 1)))
        depth = live.agg(F.min("profondeur")).first()[0]
        if depth is None:
            break
        now = live.where(F.col("profondeur") == depth).select(*key, "souche", "extension", "pris")
        # Rank among those that ask in vain: all where the name was given away before, else all but the first.
        waiting = asked.select(*key, "rang", "demande").join(now, key).withColumn("i", F.col("demande") - F.when(F.col("pris"), 0).otherwise(1)).where("i > 0")
        waiting = cut_lineage(waiting)
        found = cut_lineage(_numbers(waiting, names))
        settled.append(found.select("dossier_id", "rang", "nom_final"))
        given = found.select("dossier_id", F.col("nom_final").alias("nom"), F.lit(True).alias("pris"))
        taken = given if taken is None else taken.unionByName(given)
    rows = asked.select("dossier_id", "rang", "nom")
    if not settled:
        return rows.withColumn("nom_final", F.col("nom"))
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return rows.join(every, ["dossier_id", "rang"], "left").withColumn("nom_final", F.coalesce("nom_final", "nom"))


def _numbers(waiting: DataFrame, names: DataFrame) -> DataFrame:
    """``waiting`` with ``nom_final``: its rank, moved up by one for each gap before it."""
    family = ["dossier_id", "nom"]
    many = waiting.groupBy(*family).agg(F.max("i").alias("m"))
    gaps = names.where("parent IS NOT NULL").select("dossier_id", F.col("parent").alias("nom"), "k", "premier").join(many, family)
    # How many had come before the number was asked for: a running count over both in order of arrival.
    both = waiting.select(*family, F.col("rang").alias("quand"), F.lit(1).alias("un"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("int").alias("m")).unionByName(
        gaps.select(*family, F.col("premier").alias("quand"), F.lit(0).alias("un"), "k", F.col("m").cast("int").alias("m")))
    counted = ordered_scan(both, family, F.floor(F.col("quand") / BLOCK), ["quand", "un", "k"], sums={"q": F.col("un")}).where("k IS NOT NULL")
    # With all gaps before it jumped a number may still lie beyond the last rank: then nobody gets there.
    near = ordered_rank(counted.withColumn("ordre", F.least("k", F.lit(2**31 - 1)).cast("int")), family, F.floor(F.col("ordre") / BLOCK), ["k"], "j").where("k - j <= m")
    near = cut_lineage(near.withColumn("bloc", F.floor((F.col("j") - 1) / FOLDED).cast("int")))
    last = near.agg(F.max("bloc")).first()[0]
    before, moves = None, []
    for block in range(0 if last is None else last + 1):  # one, but for families with thousands of numbers asked for by name
        held = near.where(F.col("bloc") == block).groupBy(*family).agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("g"))
        held = held.withColumn("s", F.lit(0).cast("long")) if before is None else held.join(before, family, "left").withColumn("s", F.coalesce("s", F.lit(0).cast("long")))
        folded = held.select(*family, F.aggregate("g", F.struct(F.col("s"), F.array().cast("array<long>").alias("moves")), _jump).alias("x"))
        folded = cut_lineage(folded)
        moves.append(folded.select(*family, F.explode("x.moves").alias("i")))
        before = folded.select(*family, "x.s")
    rank = waiting.select(*family, "rang", F.col("i").cast("long").alias("i"), "souche", "extension", F.lit(0).cast("long").alias("saut"))
    for more in moves:
        rank = rank.unionByName(more.withColumn("saut", F.lit(1).cast("long")), allowMissingColumns=True)
    # Gaps come before the rank they move.
    moved = ordered_scan(rank, family, F.floor(F.col("i") / BLOCK), ["i", F.desc("saut")], sums={"sauts": F.col("saut")}).where("rang IS NOT NULL")
    return moved.withColumn("nom_final", F.concat("souche", F.lit("_"), (F.col("i") + 1 + F.col("sauts")).cast("string"), F.col("extension")))


def _jump(state: Column, gap: Column) -> Column:
    rank = gap["k"] - 1 - state["s"]
    jumped = rank > gap["q"]
    return F.struct(F.when(jumped, state["s"] + 1).otherwise(state["s"]).alias("s"),
                    F.when(jumped, F.concat(state["moves"], F.array(rank))).otherwise(state["moves"]).alias("moves"))


def admit(files: DataFrame, max_pages: int = v.LIMITE_PAGES, max_mb: int = v.LIMITE_MO) -> DataFrame:
    """Per case: accepted or not, with the first reason in upload order."""
    reason = (
        F.when(F.col("taille_mo") > max_mb, "fichier trop lourd")
        .when(~F.col("lisible"), "fichier endommagé")
        .when(F.col("protege"), "fichier protégé")
    )
    per_case = files.withColumn("__m", reason).groupBy("dossier_id").agg(
        F.min_by(F.struct("__m", "nom"), F.when(F.col("__m").isNotNull(), F.col("rang"))).alias("__f"),
        F.sum("pages").alias("total_pages"),
    )
    motif = F.coalesce(F.col("__f.__m"), F.when(F.col("total_pages") > max_pages, F.lit("trop de pages")))
    return per_case.select(
        "dossier_id", motif.isNull().alias("accepte"), motif.alias("motif"), F.col("__f.nom").alias("fichier"),
        "total_pages",
    )


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace by key, newest row first; a null never overwrites."""
    rows = current.unionByName(updates, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    )


def replace_rows(current: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``current`` with whole rows replaced by key: nothing of an old row stays, also where the new one has nulls.

    ``order`` names the column that tells the newest of several updates of a key; without
    it all updates of a key come in together (a case replaced as a whole, say).  Null keys
    are keys like others.
    """
    same = [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in keys]
    old = current.alias("__a").join(updates.select(*keys).distinct().alias("__b"), same, "left_anti")
    new = updates
    if order is not None:
        new = updates.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), order).alias("__x")).select("__x.*")
    return old.unionByName(new, allowMissingColumns=True)


def ingest_files(batch: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The page table after these files have come in.

    Files that are there by name are skipped, the others numbered after the last page.
    Forced, the cases of the batch start again: their old pages go, all of them, and the
    files of the batch are numbered from 1.
    """
    cases = batch.select("dossier_id").distinct()
    kept = existing.join(cases, "dossier_id", "left_anti") if force else existing
    added = number_pages(new_files(batch, existing, force), kept)
    return kept.unionByName(pages_with_marks(added).select(*existing.columns), allowMissingColumns=True)
