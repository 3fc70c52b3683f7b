"""Title case, by rules of our own, as column expressions.

Small words stay small but at the ends and at the start of a phrase; the parts of compounds (hyphens,
slashes) are words of their own; what has a capital inside, a letter on both sides of a dot, or begins
with a digit stays as it is; names with an apostrophe or Mc have two capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that title case leaves small.
SMALL = "a an and as at but by en for if in of on or the to v v. via vs vs.".split()
_WORDS = r"[^ \t]+"
_SHAPED = r"(?s)\p{L}\.\p{L}|^.+//"
_INITIALS = r"^(?:\p{Lu}\.)+\p{Lu}?$"
_PHRASE_ENDS = r"[:.;?!\-–—]$"
_LETTERS = r"(?s)^([^\p{L}\p{N}_]*)(.*)$"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _capital(text: Column) -> Column:
    """The first letter or digit behind any marks raised."""
    rest = F.regexp_extract(text, _LETTERS, 2)
    return F.concat(F.regexp_extract(text, _LETTERS, 1), F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))


def _part(text: Column, edge: Column) -> Column:
    """A word, or a part of a compound with the mark that ends it."""
    bare = F.regexp_replace(text, "[-/]$", "")
    tail = lambda n: F.substring(text, n, 1 << 30)
    return (
        F.when(F.lower(bare).isin(SMALL) & ~edge, F.lower(text))
        .when(F.rlike(text, F.lit(r"(?s)^.+[A-Z]")), text)
        .when(F.rlike(text, F.lit(r"(?i)^[dl]['’][a-z]")), F.concat(F.lower(F.substring(text, 1, 2)), _capital(tail(3))))
        .when(F.rlike(text, F.lit(r"(?i)^o['’][a-z]")), F.concat(F.upper(F.substring(text, 1, 2)), _capital(tail(3))))
        .when(F.rlike(text, F.lit(r"(?i)^mc\p{L}")), F.concat(F.lit("Mc"), _capital(tail(3))))
        .otherwise(_capital(text))
    )


def _word(word: Column, opens: Column, closes: Column) -> Column:
    parts = F.split(word, "(?<=[-/])")
    each = _let(parts, lambda ps: F.array_join(F.transform(ps, lambda p, i: _part(p, (opens & (i == 0)) | (closes & (i == F.size(ps) - 1)))), ""))
    return F.when(F.rlike(word, F.lit(_SHAPED)), word).otherwise(each)


def title_case(text: Column) -> Column:
    """``text`` in title case; blanks stay as they are.  A text all in capitals is read in small letters, but for initials."""

    def cased(words: Column, upper: Column, blanks: Column) -> Column:
        def one(word: Column, i: Column) -> Column:
            opens = (i == 0) | F.rlike(F.coalesce(F.get(words, i - 1), F.lit("")), F.lit(_PHRASE_ENDS))
            plain = F.when(upper & ~F.rlike(word, F.lit(_INITIALS)), F.lower(word)).otherwise(word)
            return F.concat(F.get(blanks, i), _let(plain, lambda w: _word(w, opens, i == F.size(words) - 1)))

        return F.concat(F.array_join(F.transform(words, one), ""), F.element_at(blanks, -1))

    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return _let(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), lambda ws: _let(capitals, lambda up: _let(F.split(text, _WORDS, -1), lambda bs: cased(ws, up, bs))))


def is_title_case(text: Column) -> Column:
    """Whether a text is its own title case; null for null."""
    return title_case(text) == text
