"""Verdicts: folding flags of three values, and scores of a document's findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OK, UNKNOWN, FAIL = "ok", "unknown", "fail"


def rank(verdict: Column) -> Column:
    """fail < unknown < ok."""
    return F.when(verdict == FAIL, 0).when(verdict == UNKNOWN, 1).when(verdict == OK, 2)


def unrank(number: Column) -> Column:
    return F.element_at(F.array(F.lit(FAIL), F.lit(UNKNOWN), F.lit(OK)), number + 1)


def fold(verdict: Column) -> Column:
    """Aggregate: any fail fails, else any unknown is unknown; an empty group is ok."""
    return unrank(F.coalesce(F.min(rank(verdict)), F.lit(2)))


def flag(ok: Column) -> Column:
    """A verdict from a Boolean; null stays null and counts for nothing."""
    return F.when(ok, OK).when(~ok, FAIL)


def score(findings: DataFrame) -> DataFrame:
    """(doc_id, section, positive, unknown, negative) of findings (doc_id, section, verdict), and a row ``total``.

    Sections and totals come from one pass with grouping sets; null verdicts and the section
    ``Languages`` don't count.  A finding counts as often as its column ``items`` says, if there is one.
    """
    items = F.col("items") if "items" in findings.columns else F.lit(1).cast("bigint")
    counts = [F.coalesce(F.sum(F.when(F.col("verdict") == v, items)), F.lit(0)).alias(n) for v, n in ((OK, "positive"), (UNKNOWN, "unknown"), (FAIL, "negative"))]
    shown = findings.where(F.coalesce(F.col("section"), F.lit("")) != "Languages")
    both = shown.groupingSets([["doc_id", "section"], ["doc_id"]], "doc_id", "section")
    out = both.agg(F.grouping("section").alias("whole"), *counts)
    return out.select("doc_id", F.when(F.col("whole") == 1, "total").otherwise(F.col("section")).alias("section"), "positive", "unknown", "negative")


#: Sections of a document's summary, in order, and the checks that don't count towards their verdict.
SECTIONS = ("Title", "Authors", "Abstract", "Headings", "Paragraphs", "Figures", "Tables", "References", "Styles", "Margins", "Parsed Document")
ASIDE = {"Title": "title_style_ok", "Authors": "title_style_ok", "Abstract": "title_style_ok", "Tables": "used_ok", "Catalogue": "author_ok"}
#: A section that only papers known to the catalogue have.
KNOWN_ONLY = "Catalogue"


def section_summary(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, section, verdict) of every section of each document of ``docs`` (doc_id).

    A section is in order if all of its checks are; a style that can't be told leaves it unknown.
    Whether a table is referred to doesn't count, which is how the service has it, nor a single author
    beside the verdict on the whole list.  A section without findings is in order, but for the
    references: a paper without any fails.  The catalogue's section is that of papers it knows.
    """
    counted = F.lit(True)
    for section, check in ASIDE.items():
        counted = counted & ~((F.col("section") == section) & (F.col("check_name") == check))
    folded = findings.where(counted).groupBy("doc_id", "section").agg(fold(F.col("verdict")).alias("verdict"))
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    none = F.when(F.col("section") == "References", FAIL).otherwise(OK)
    all_have = every.join(folded.where(F.col("section") != KNOWN_ONLY), ["doc_id", "section"], "left").select("doc_id", "section", F.coalesce("verdict", none).alias("verdict"))
    return all_have.unionByName(folded.where(F.col("section") == KNOWN_ONLY).join(docs.select("doc_id"), "doc_id", "left_semi"))


def section_verdicts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "section").agg(fold(F.col("verdict")).alias("verdict"))
