"""Licence scan: Aho-Corasick phrases and identifier tags, licence expressions by shunting yard.

A text is reduced to its words (A-Z lower-cased, every run of digits, letters and non-ASCII
characters) joined by blanks, and one automaton finds all phrases in one pass.  Where it finds the tag
``SPDX-License-Identifier`` and the text has it in that spelling (but for case), with a colon, the
expression after it is parsed with the precedence
``with`` > ``and`` > ``or`` and evaluated: ``and`` is as strict as its stricter side, ``or`` as its
milder one, ``with`` lets an exception soften a strong copyleft.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .shared import slices

#: The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels of the method's own phrases.
MORE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "public domain": "public-domain",
    "eclipse public license": "epl",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
#: Strictness by prefix of a licence id: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 restricted.
STRICTNESS = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "unlicense": 0, "0bsd": 0, "cc0": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1, "cc-by-nc": 3, "cc-by-nd": 3, "cc-by-sa": 2, "cc-by": 0,
    "gpl": 2, "agpl": 2, "reserved": 3, "proprietary": 3,
}
OBLIGATION = ("permissive", "weak-copyleft", "strong-copyleft", "restricted")
TAG = "spdx license identifier"
TAG_RAW = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
RUN = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
ORDER = {"or": 1, "and": 2, "with": 3}

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class ExpressionError(ValueError):
    """An expression that isn't one."""


def to_postfix(text: str) -> list[str]:
    """Shunting yard.  Reading stops at the first character that no expression holds."""
    out, held, operand, at = [], [], False, 0
    while True:
        while text[at : at + 1] in (" ", "\t") and at < len(text):
            at += 1
        m = TOKEN.match(text, at)
        token = m[0] if m else None
        word = token.lower() if token else None
        if token is None or (operand and word not in ORDER and token != ")"):
            break
        if token == ")" and "(" not in held:
            break
        at = m.end()
        if token == "(":
            held.append(token)
        elif token == ")":
            if not operand:
                raise ExpressionError("nothing before )")
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif word in ORDER:
            if not operand:
                raise ExpressionError(f"nothing before {word}")
            while held and held[-1] != "(" and ORDER[held[-1]] >= ORDER[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        else:
            out.append(word.rstrip(".:-"))
            operand = True
    if not operand or "(" in held:
        raise ExpressionError("it ends too early")
    return out + held[::-1]


def strictness(name: str) -> int:
    """Of a licence id; unknown ones count as restricted."""
    known = [k for k in STRICTNESS if name == k or name.startswith(k + "-")]
    return STRICTNESS[max(known, key=len)] if known else 3


def evaluate(text: str) -> tuple[list[str], int]:
    """(licence ids in order, strictness) of an expression."""
    names: list[str] = []
    stack: list[tuple[str | None, int]] = []
    for token in to_postfix(text):
        if token not in ORDER:
            stack.append((token, strictness(token)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if token == "with":
            if left is None or right is None:
                raise ExpressionError("with stands between a licence and an exception")
            names.append(left)
            stack.append((None, 1 if l == 2 else l))
        else:
            names += [x for x in (left, right) if x is not None]
            stack.append((None, max(l, r) if token == "and" else min(l, r)))
    name, level = stack.pop()
    return names + ([name] if name else []), level


def automaton(phrases: dict[str, tuple[str, bool]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (phrase, *value))
    found.make_automaton()
    return found


_machine = None


def _phrases():
    global _machine
    if _machine is None:
        _machine = automaton({p: (v, True) for p, v in BASE_PHRASES.items()} | {p: (v, False) for p, v in MORE_PHRASES.items()} | {TAG: ("", False)})
    return _machine


def scan(raw: bytes | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, obligation, n_tags, bad_tags)."""
    words = (raw or b"").translate(_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base, labels, starts, level, tags = set(), set(), [], None, []
    at = before = 0
    for end, (phrase, label, is_base) in _phrases().iter(line) if words else ():
        start = end - len(phrase) - 1
        if is_base:
            base.add(label)
            starts.append(start)
        if label:
            labels.add(label)
            level = max(level or 0, strictness(label))
        else:
            before += line.count(" ", at, start)  # hits of one phrase come in order, so blanks are counted once
            at = start
            tags.append(before)
    n_tags = bad = 0
    if tags:
        low, wanted = raw.lower(), set(tags)
        spelled = (TAG_RAW.match(low, m.start()) for n, m in enumerate(RUN.finditer(raw.translate(_TABLE))) if n in wanted)
        for m in filter(None, spelled):
            n_tags += 1
            try:
                names, strict = evaluate(m[1].decode("utf-8", "replace"))
                labels.update(names)
                level = max(level or 0, strict)
            except ExpressionError:
                bad += 1
    # Independent pieces of evidence: a tag that parses, each phrase label, a tag that doesn't.
    doubt = 0.05 ** (n_tags > bad) * 0.5 ** len(base) * 0.6 ** len(labels - base) * 0.8 ** (bad > 0)
    place = lambda p: line.count(" ", 0, p)
    return (
        len(words), len(starts), place(min(starts)) if starts else None, place(max(starts)) if starts else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, None if level is None else OBLIGATION[level], n_tags, bad,
    )


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, obligation string, n_tags bigint, bad_tags bigint"


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; null and empty texts have no words, empty labels and score 0.

    A map over whole texts, without a shuffle; other columns aren't read.
    """
    import pyarrow as pa

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()] + [pa.int64()] * 2
    names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches):
        for batch in slices(batches):
            found = list(zip(*(scan(r.as_py()) for r in batch.column("raw")))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds))], names=names)

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")
