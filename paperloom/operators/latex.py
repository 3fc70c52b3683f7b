"""LaTeX references: comments, document body, bibliography items, identifiers and their issues.

A source is scanned once, in an Arrow pass with compiled patterns, in time proportional to its
length: no built-in function gives the places of matches.  There is no shuffle.  ``compat`` keeps the
odd tests of the original service (an item is dropped if it *contains* a whole comment, or the
document; identifiers know capitals only); otherwise an item is dropped if it starts in a comment or
outside the document.  Places are in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns and marks that define comments, items, identifiers and issues.
COMMENT = r"(?s)%.*?\n"
BEGIN, END = r"\begin{document}", r"\end{document}"
ITEM = r"(?s)\\bibitem\{(.*?)\}(.*?)(?=\\bibitem|\\end\{thebibliography\})"
DOI_COMPAT = r"10.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
#: issue: (pattern that raises it, pattern that excuses it)
ISSUES = {
    "ET_AL_WITH_COMMA": (r",\s*(\\(emph|textit)\{)?et al", None),
    "ET_AL_NOT_WRAPPED": (r"et al\.", r"\\(emph|textit)\{et al\.\}"),
    "DOI_CONTAINS_SPACE": (r"doi:\s10", None),
    "DOI_NOT_WRAPPED": (r"doi:10.", r"\\url\{doi:10\."),
    "NO_DOI_PREFIX": (r"\\url\{10\.", None),
    "DOI_IS_URL": (r"https?://doi.org", None),
}
SPAN = "struct<start:int,end:int>"
SCANNED = f"comments array<{SPAN}>, document {SPAN}, items array<struct<name:string,text:string,ref:string,doi:string,start:int,end:int>>, issues array<struct<type:string,start:int,end:int>>"
_COMMENT, _ITEM, _BLANKS, _TAIL = re.compile(COMMENT), re.compile(ITEM), re.compile(r"\s+"), re.compile(r"[.;:]+$")
_DOIS = {True: re.compile(DOI_COMPAT), False: re.compile(DOI)}
_ISSUES = [(kind, re.compile(raises), excuses and re.compile(excuses)) for kind, (raises, excuses) in ISSUES.items()]


def last_doi(text: Column, compat: bool = True) -> Column:
    found = F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(DOI_COMPAT if compat else DOI), F.lit(0)), F.lit(-1)), F.lit(""))
    return found if compat else F.regexp_replace(found, r"[.;:]+$", "")


class _Comments:
    """Spans in order, which never overlap; whether a span goes with them is one look-up."""

    def __init__(self, content: str, compat: bool):
        self.spans = [m.span() for m in _COMMENT.finditer(content)]
        self.starts, self.compat = [a for a, _ in self.spans], compat

    def rule_out(self, start: int, end: int) -> bool:
        if self.compat:
            n = bisect_left(self.starts, start)
            return n < len(self.spans) and self.spans[n][1] <= end
        n = bisect_right(self.starts, start) - 1
        return n >= 0 and start < self.spans[n][1]


def scan(content: str, compat: bool = True) -> dict:
    """SCANNED's values of a source; the document is from the first begin to the first end that no comment rules out."""
    comments = _Comments(content, compat)

    def first(mark: str, otherwise: int) -> int:
        at = content.find(mark)
        while at >= 0 and comments.rule_out(at, at + len(mark)):
            at = content.find(mark, at + len(mark))
        return otherwise if at < 0 else at

    begin, end = first(BEGIN, 0), first(END, len(content) - 1)
    items, issues = [], []
    for m in _ITEM.finditer(content):
        low, high = m.span(2)
        outside = (low <= begin and high >= end) if compat else (low < begin or high > end)
        if outside or comments.rule_out(low, high):
            continue
        ref = _BLANKS.sub(" ", m[2]).strip(" \n\t")
        found = _DOIS[compat].findall(ref)
        doi = found[-1] if found else ""
        items.append({"name": m[1], "text": m[2], "ref": ref, "doi": doi if compat else _TAIL.sub("", doi), "start": low, "end": high})
        for kind, raises, excuses in _ISSUES:
            hit = raises.search(m[2])
            if hit and not (excuses and excuses.search(m[2])):
                issues.append({"type": kind, "start": low + hit.start(), "end": low + hit.end()})
    span = lambda a, b: {"start": a, "end": b}
    return {"comments": [span(a, b) for a, b in comments.spans], "document": span(begin, end), "items": items, "issues": issues}


def check_tex(sources: DataFrame, compat: bool = True) -> DataFrame:
    """``sources`` (filename, content) with comments, document, items and issues; a null content has nulls.

    Columns that already bear those names give way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(SCANNED)
    kept = sources.drop(*made.names)
    at, kinds = kept.columns.index("content"), to_arrow_schema(made)

    def run(batches):
        import pyarrow as pa

        none = dict.fromkeys(made.names)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = pa.RecordBatch.from_pylist([none if t is None else scan(t, compat) for t in part.column(at).to_pylist()], schema=kinds)
                yield pa.RecordBatch.from_arrays([*part.columns, *found.columns], names=[*part.schema.names, *made.names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *made.fields]))


def payload(checked: DataFrame) -> DataFrame:
    """(filename, payload): the report as indented JSON."""
    location = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    body = F.struct(
        "filename", "content",
        F.transform("issues", lambda i: F.struct(i["type"].alias("type"), location(i).alias("location"))).alias("issues"),
        F.transform("items", lambda i: F.struct(i["doi"].alias("doi"), i["ref"].alias("ref"), location(i).alias("location"))).alias("bibItems"),
    )
    return checked.select("filename", F.to_json(body, {"pretty": "true"}).alias("payload"))
