"""Column helpers on French dates and hours, and on act openings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import vocab as v
from .text import let, strip


def _map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(x)) for k, x in values.items()))


def _cardinals() -> dict[str, int]:
    """French cardinals 0–99 written with hyphens, built from their parts."""
    table = {**v.UNITES, **v.DIX_A_DIX_NEUF, **v.DIZAINES, "quatre-vingt": 80, "quatre-vingts": 80, "soixante-dix": 70}
    for ten, base in v.DIZAINES.items():
        table.update({f"{ten}-{unit}": base + n for unit, n in v.UNITES.items() if ten != "soixante" or n})
    for low, n in {**v.UNITES, **v.DIX_A_DIX_NEUF}.items():
        table[f"quatre-vingt-{low}"] = 80 + n
    for low, n in v.DIX_A_DIX_NEUF.items():
        table[f"soixante-{low}"] = 60 + n
    return table


def cardinal(words: Column) -> Column:
    """Number written in words, null when the writing is not recognised."""
    word = F.regexp_replace(F.lower(strip(words)), r"[\s-]+et[\s-]+", "-")
    word = F.regexp_replace(F.regexp_replace(word, r"[\s-]+", "-"), "^-+|-+$", "")
    return F.try_element_at(_map(_cardinals()), word)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def date_text(raw: Column) -> Column:
    """``4 mars 2031`` or ``4/3/2031`` → ``04/03/2031`` (no calendar check)."""
    numeric = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    literal = rf"(?iU)^(\d{{1,2}})(?:er)?\s+({v.NOMS_MOIS})\s+(\d{{4}})$"
    bare = strip(raw)
    month = F.try_element_at(_map(v.MOIS), F.lower(F.regexp_extract(bare, literal, 2)))
    return F.when(
        bare.rlike(numeric),
        F.concat_ws("/", _two(F.regexp_extract(bare, numeric, 1)), _two(F.regexp_extract(bare, numeric, 2)),
                    F.regexp_extract(bare, numeric, 3)),
    ).when(
        bare.rlike(literal),
        F.concat_ws("/", _two(F.regexp_extract(bare, literal, 1)), _two(month), F.regexp_extract(bare, literal, 3)),
    )


def hour_text(raw: Column) -> Column:
    """Compact hour ``8 h 15`` → ``08h15``."""
    pattern = r"(?U)^(\d{1,2})\s*[hH]\s*(\d{2})$"
    bare = strip(raw)
    return F.when(
        bare.rlike(pattern),
        F.concat(_two(F.regexp_extract(bare, pattern, 1)), F.lit("h"), F.regexp_extract(bare, pattern, 2)),
    )


def loose_hour(raw: Column) -> Column:
    """Compact hour, else ``14 heures 30``, else words, midi, minuit."""
    digits = r"(?iU)^(\d{1,2})\s*heures?(?:\s+(\d{1,2})(?:\s*minutes?)?)?\.?$"
    words = r"(?U)^([a-zà-ÿ\s-]+?)\s+heures?(?:\s+(?:et\s+)?([a-zà-ÿ\s-]+?)(?:\s+minutes?)?)?$"
    bare = strip(raw)
    h = F.regexp_extract(bare, digits, 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(bare, digits, 2).try_cast("int"), F.lit(0))
    low = F.regexp_replace(F.replace(F.lower(bare), F.lit("’"), F.lit("'")), "[.,;]+$", "")
    wh = cardinal(F.regexp_extract(low, words, 1))
    minute = strip(F.regexp_extract(low, words, 2))
    wm = F.when(minute == "", F.lit(0)).when(minute.isin("demie", "demi"), F.lit(30)).otherwise(cardinal(minute))
    return F.coalesce(
        hour_text(bare),
        F.when(bare.rlike(digits) & (h <= 23) & (m <= 59), F.concat(_two(h), F.lit("h"), _two(m))),
        F.when(low == "minuit", F.lit("00h00")).when(low == "midi", F.lit("12h00"))
        .when(low.rlike(words) & (wh <= 23) & (wm <= 59), F.concat(_two(wh), F.lit("h"), _two(wm))),
    )


def instant(date: Column, hour: Column) -> Column:
    """Naive timestamp; null when a part is missing or impossible."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), hour), F.lit("dd/MM/yyyy HH'h'mm")).cast("timestamp_ntz")


def minutes_between(start: Column, end: Column) -> Column:
    """Rounded minutes, null when an end is missing or the gap is negative."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.when(seconds >= 0, F.bround(seconds / 60).cast("int"))


def duration_text(minutes: Column) -> Column:
    return (
        F.when(minutes.isNull(), F.lit(v.NON_TROUVE))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), _two(minutes % 60)))
    )


def sortable_date(date: Column) -> Column:
    """``JJ/MM/AAAA`` → a number that sorts, null for anything else."""
    p = r"^\s*(\d+)/(\d+)/(\d+)\s*$"
    return F.when(
        date.rlike(p),
        F.regexp_extract(date, p, 3).cast("int") * 10000 + F.regexp_extract(date, p, 2).cast("int") * 100
        + F.regexp_extract(date, p, 1).cast("int"),
    )


def opening(text: Column) -> Column:
    """Date, hour and 1-based position of an act's own opening formula.

    ``rang`` tells which formula hit, in order of precedence: the year in words,
    « Le [date] », the boxed « Date : », the hour alone; null when none does.
    """
    def year(words: Column) -> Column:
        rest = strip(F.regexp_replace(F.lower(strip(words)), r"(?U)^deux[\s-]+mille", ""))
        return F.when(rest == "", F.lit(2000)).otherwise(2000 + cardinal(rest))

    p1 = v.RE_OUVERTURE_LETTRES

    def row(rank: int, date: Column, hour: Column, pos: Column) -> Column:
        return F.struct(F.lit(rank).alias("rang"), date.alias("date"), hour.alias("heure"), pos.alias("position"))

    def in_words(t: Column, pos: Column) -> Column:
        def dated(p: Column) -> Column:
            day = (F.when(p["j"] == "premier", F.lit(1))
                   .when(p["j"].rlike(r"^\d{1,2}(?:er)?$"), F.regexp_extract(p["j"], r"^(\d+)", 1).try_cast("int"))
                   .otherwise(cardinal(p["j"])))
            month = F.try_element_at(_map(v.MOIS), F.lower(F.regexp_extract(t, p1, 3)))
            return F.concat(_two(day), F.lit("/"), _two(month), F.lit("/"), p["a"].cast("string"))

        parts = F.struct(year(F.regexp_extract(t, p1, 1)).alias("a"),
                         F.lower(strip(F.regexp_extract(t, p1, 2))).alias("j"))
        whole = F.when(pos > 0, let(parts, dated))
        return let(whole, lambda d: F.when(d.isNotNull(), row(1, d, loose_hour(F.regexp_extract(t, p1, 4)), pos)))

    def pick(t: Column) -> Column:
        head = F.substring(t, 1, v.LONGUEUR_OUVERTURE)

        def by_date(p: Column) -> Column:
            return F.when(
                (p["p3"] > 0) & ((p["p2"] == 0) | (p["p3"] < p["p2"])),
                row(2, date_text(F.regexp_extract(t, v.RE_LE_DATE, 1)),
                    hour_text(F.regexp_extract(t.substr(p["p3"], F.length(t)), v.RE_HEURE_SUIVANTE, 2)), p["p3"]),
            ).when(p["p2"] > 0, row(2, date_text(F.regexp_extract(t, v.RE_LE_DATE_A, 1)),
                                    loose_hour(F.regexp_extract(t, v.RE_LE_DATE_A, 2)), p["p2"]))

        boxed = let(F.regexp_instr(t, F.lit(v.RE_DATE_BOITE)), lambda pos: F.when(
            pos > 0, row(3, date_text(F.regexp_extract(t, v.RE_DATE_BOITE, 1)),
                         hour_text(F.regexp_extract(t, v.RE_DATE_BOITE, 2)), pos)))
        alone = let(F.regexp_instr(head, F.lit(v.RE_HEURE_SEULE)), lambda pos: F.when(
            pos > 0, row(4, F.lit(None).cast("string"), hour_text(F.regexp_extract(head, v.RE_HEURE_SEULE, 1)), pos)))
        positions = F.struct(F.regexp_instr(t, F.lit(v.RE_LE_DATE_A)).alias("p2"),
                             F.regexp_instr(t, F.lit(v.RE_LE_DATE)).alias("p3"))
        return F.coalesce(
            let(F.regexp_instr(t, F.lit(p1)), lambda pos: in_words(t, pos)), let(positions, by_date), boxed, alone)

    return let(text, pick)
