"""Scalar text functions as column expressions.  Lengths and places are in code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

NBSP = "\u00a0"
#: Line ends that part the entries of an author text; the last is a backslash and an n.
LINE_ENDS = ("\u000a", "\u000b", "\u000c", "\u000d", "\u0085", "\u2028", "\u2029", "\\n")
NAME = r"(?U)^(-?\w\. ?)+(\w{2,} ?)+"
#: Transliterations that no decomposition gives.
LATIN_EXCEPTIONS = {
    "ä": "ae", "Ä": "AE", "æ": "ae", "Æ": "AE", "ö": "oe", "Ö": "OE", "ø": "oe", "Ø": "OE", "ü": "ue", "Ü": "UE", "ß": "SS",
    "ð": "dh", "Ð": "Dh", "þ": "th", "Þ": "Th", "đ": "d", "Đ": "D", "ƒ": "f", "Ƒ": "F", "ħ": "h", "Ħ": "H", "ł": "l", "Ł": "L",
    "ŧ": "t", "Ŧ": "T", "µ": "u",
}
#: Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh",
    "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "ju", "я": "ja",
}


def transliterations() -> dict[str, str]:
    """Accented Latin letters to their base letter, with the exceptions, and Cyrillic in lower case.

    Capital Cyrillic letters map as small ones do, but for the two that have a Latin capital.
    """
    table = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
            table[chr(point)] = base
    table |= LATIN_EXCEPTIONS | CYRILLIC | {k.upper(): v for k, v in CYRILLIC.items()} | {"Е": "E", "Ё": "E"}
    return table


_TABLE = transliterations()
SINGLE = "".join(k for k, v in _TABLE.items() if len(v) == 1), "".join(v for v in _TABLE.values() if len(v) == 1)
DROPPED = "".join(k for k, v in _TABLE.items() if not v)
LONGER = {k: v for k, v in _TABLE.items() if len(v) > 1}


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def single_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def squeeze(c: Column) -> Column:
    """Every run of white space one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" \n\t"))


def author_names(c: Column) -> Column:
    """The entries of an author text that look like names: initials, then a surname of two letters or more."""
    for end in LINE_ENDS:
        c = F.replace(c, F.lit(end), F.lit(" , "))
    c = F.replace(F.replace(c, F.lit(NBSP), F.lit(" ")), F.lit(" and "), F.lit(", "))
    return F.filter(F.split(c, ", ", -1), lambda x: F.rlike(x, F.lit(NAME)))


def normal_name(c: Column) -> Column:
    """A name fit for comparing: a blank after each dot, without hyphens, asterisks and daggers."""
    c = F.replace(F.replace(c, F.lit("."), F.lit(". ")), F.lit("  "), F.lit(" "))
    return strip(F.translate(c, "-*†", ""))


def surname(c: Column) -> Column:
    """What follows the last dot and one more character; without a dot, all but the first character."""
    last = F.instr(F.reverse(c), ".")
    return F.when(last > 0, F.right(c, F.greatest(last - 2, F.lit(0)))).otherwise(F.substr(c, F.lit(2)))


def first_and_last(c: Column) -> Column:
    """The first initial and the surname."""
    return F.concat_ws(" ", F.left(c, F.lit(2)), surname(c))


def transliterate(c: Column) -> Column:
    c = F.translate(c, SINGLE[0] + DROPPED, SINGLE[1])
    for accented, plain in LONGER.items():
        c = F.replace(c, F.lit(accented), F.lit(plain))
    return c


def same_title(document: Column, catalogue: Column) -> Column:
    """Whether two titles agree but for case, blanks, tabs, line feeds and asterisks at the ends."""
    bare = lambda c: F.translate(F.upper(c), "\n \t", "")
    return bare(F.btrim(F.upper(document), F.lit("*"))) == bare(single_spaces(catalogue))


def without_line_breaks(c: Column) -> Column:
    """Without TeX's forced line breaks, two backslashes."""
    return F.replace(c, F.lit("\\\\"), F.lit(""))


def upper_ratio_ok(c: Column, least: float = 0.7) -> Column:
    """Whether more than ``least`` of the letters are capitals; without letters, no."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.coalesce(F.regexp_count(c, F.lit(r"\p{Lu}")) / F.nullif(letters, F.lit(0)) > least, F.lit(False))


def extension_ok(c: Column, allowed: str = "docx") -> Column:
    return (F.instr(c, ".") > 0) & (F.lower(F.element_at(F.split(c, r"\.", -1), -1)) == allowed)


def paper_code(c: Column) -> Column:
    """The file name before its last dot, in capitals."""
    return F.upper(F.regexp_replace(c, r"\.[^.]*$", ""))


def event_number(c: Column) -> Column:
    """What follows the last hyphen of an event's name."""
    return F.element_at(F.split(c, "-", -1), -1)
