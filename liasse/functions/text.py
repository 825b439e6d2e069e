"""Column helpers on text: blanks, lines, accents, titles, sentences."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import vocab as v

_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", c)) > 1
             and ord(unicodedata.normalize("NFKD", c)[0]) < 128]
_FROM = "".join(_ACCENTED)
_TO = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row.

    The optimiser inlines a column wherever it is read; a lambda variable is
    bound once, which matters when the value is a chain of expressions.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


# Blanks as the JVM's Unicode classes see them.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def no_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}", "")


def normalised(c: Column) -> Column:
    """Accent-free lower case, the form in which guards compare texts."""
    return F.lower(no_accents(F.replace(c, F.lit("…"), F.lit("..."))))


def normal_quote(c: Column) -> Column:
    """The form in which a quotation is looked up on its page."""
    return F.lower(squeeze(F.translate(c, "’‘", "''")))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def lines(c: Column) -> Column:
    """The lines of a text that are not blank, stripped."""
    split = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(split, strip), lambda x: x != "")


def is_title(line: Column) -> Column:
    """A line in capitals, at least eight characters long."""
    bare = F.regexp_replace(strip(line), rf"^[{v.PARASITES_BORD}]+|[{v.PARASITES_BORD}]+$", "")
    # Most lines do not even begin like one: that spares them the rest.
    return line.rlike(v.RE_DEBUT_TITRE) & strip(F.regexp_replace(strip(bare), v.RE_SUFFIXE_COLONNE, "")).rlike(v.RE_TITRE)


def is_scan_noise(line: Column) -> Column:
    return (F.length(line) < 12) & ~F.replace(line, F.lit("COTE"), F.lit("")).rlike(v.RE_MOT_PLEIN)


def is_lawyer_page(text: Column) -> Column:
    return text.rlike(v.RE_DOCUMENT_AVOCAT) & ~F.substring(text, 1, 600).rlike(v.RE_PROCES_VERBAL)


def margin(all_lines: Column, n: int) -> Column:
    """The first and last n lines (all of them, twice, on a short page)."""
    return let(all_lines, lambda ls: F.concat(
        F.slice(ls, F.lit(1), F.lit(n)), F.slice(ls, F.greatest(F.lit(1), F.size(ls) - n + 1), F.lit(n)),
    ))


def body(text: Column) -> Column:
    """Page text without titles, reference marks and court-number lines.

    Lines are glued by a space; where some were dropped after kept ones a
    paragraph separator is set, which no sentence crosses.
    """
    sep = v.SEPARATEUR

    def glue(page: Column) -> Column:
        def marked(line: Column, i: Column) -> Column:
            in_margin = (i < v.LIGNES_DE_MARGE) | (i >= page["n"] - v.LIGNES_DE_MARGE)
            dropped = (
                is_title(line) | line.contains(v.PIED_PARQUET) | line.rlike(v.RE_LIGNE_COTE)
                | (in_margin & line.rlike(v.RE_TAMPON_COTE))
            )
            return F.when(dropped, F.lit(sep)).otherwise(line)

        return F.array_join(F.transform(page["ls"], marked), " ")

    counted = let(lines(text), lambda ls: F.struct(ls.alias("ls"), F.size(ls).alias("n")))
    once = F.regexp_replace(let(counted, glue), f"{sep}(?: {sep})+", sep)
    return F.regexp_replace(once, f"^{sep} ?| ?{sep}$", "")


def sentences(text: Column) -> Column:
    """Sentences in order: a dot after a lone capital does not end one."""
    # The mark keeps the dot with its sentence when splitting.
    cut = F.regexp_replace(text, v.FIN_PHRASE, "$0\u001e")
    return F.filter(F.transform(F.split(cut, "\u001e"), strip), lambda s: s != "")


def unit_at(parts: Column, position: Column) -> Column:
    """Of texts that stand end to end, the one that covers a 1-based position; the last one beyond them all.

    As-of by one pass: a part is the answer as long as no earlier one has reached the position.
    """
    start = F.struct(F.lit(0).alias("fin"), F.lit("").alias("part"))
    return F.aggregate(parts, start, lambda at, part: F.when(at["fin"] >= position, at).otherwise(
        F.struct((at["fin"] + F.length(part)).alias("fin"), part.alias("part"))))["part"]


def sentence_at(text: Column, position: Column) -> Column:
    """The sentence that covers a 1-based position."""
    return strip(unit_at(F.split(F.regexp_replace(text, v.FIN_PHRASE, f"$0{MARK}"), MARK), position))


# A code point that stands for no character: marks where a match begins.
MARK = "\ufdd0"


def match_lines(text: Column, pattern: str) -> Column:
    """Every match in order: ``valeur`` and ``ligne``, the line it begins on, stripped.

    The matches of a line are as many as the marks set in it, so the line is that of the
    match even where the same words stand elsewhere before it.
    """
    def both(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, pattern, f"{MARK}$0"), "\n")
        repeated = F.transform(marked, lambda line: let(F.replace(line, F.lit(MARK), F.lit("")), lambda bare: F.array_repeat(
            strip(bare), F.length(line) - F.length(bare))))
        return F.transform(F.arrays_zip(all_found(t, pattern).alias("valeur"), F.flatten(repeated).alias("ligne")), lambda x: F.struct(
            x["valeur"].alias("valeur"), x["ligne"].alias("ligne")))

    none = F.array().cast("array<struct<valeur:string,ligne:string>>")
    # Most texts hold no match: one search spares them the marks and the lines.
    return let(F.replace(text, F.lit(MARK), F.lit("")), lambda t: F.when(t.rlike(pattern), both(t)).when(t.isNotNull(), none))


def match_offsets(text: Column, pattern: str) -> Column:
    """Every match in order: ``valeur`` and ``debut``, its 1-based place in the text."""
    def both(t: Column) -> Column:
        sizes = F.transform(F.split(F.regexp_replace(t, pattern, f"{MARK}$0"), MARK), F.length)
        return F.transform(all_found(t, pattern), lambda m, i: F.struct(
            m.alias("valeur"), (F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) + 1).alias("debut")))

    return let(F.replace(text, F.lit(MARK), F.lit("")), both)
