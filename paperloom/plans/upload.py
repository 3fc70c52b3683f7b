"""The upload check: parsed Word documents to findings, section by section, and scores.

Parsed documents are written once (``sources.stage``), and each section reads the columns it needs;
no file is parsed again.  Each section's findings are written by a job of their own, so the largest plan
is that of one section.  Every section takes and gives DataFrames keyed by doc_id; findings are
(doc_id, section, item_no, items, check_name, verdict, message, details), details being the formatting
measured, as JSON, and items how many things from item_no on the finding is about: one, or the figures
missing between two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions.text import author_names, single_spaces, strip, upper_ratio_ok
from paperloom.operators import captions, citations, geometry, matching, scoring, styles
from paperloom.sources.docx import table
from paperloom.sources.stage import gathered, stored

FINDING = ("doc_id", "section", "item_no", "items", "check_name", "verdict", "message", "details")
MIN_BODY = 50


def segments(paragraphs: DataFrame) -> DataFrame:
    """Body paragraphs with part: title, authors, head, body or references.

    The title starts at the first non-blank paragraph and the authors at the first later one of
    another style; the first ``abstract`` ends the authors and the first ``references`` after it
    ends the body.
    """
    body = paragraphs.where("scope = 'body'")
    text = strip(F.col("text"))
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("para_no")
    shown = F.char_length(text) > 0
    w = body.withColumn("t", text).withColumn("shown", shown)
    w = w.withColumn("abstract_at", F.min(F.when(F.lower("t") == "abstract", F.col("para_no"))).over(doc))
    w = w.withColumn("references_at", F.min(F.when((F.lower("t") == "references") & (F.col("para_no") > F.coalesce("abstract_at", F.lit(-1))), F.col("para_no"))).over(doc))
    before = F.last(F.when(F.col("shown"), F.col("style_name")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("title_at", F.min(F.when(F.col("shown"), F.col("para_no"))).over(doc)).withColumn("_style_before", before)
    changed = F.col("shown") & (F.col("para_no") > F.col("title_at")) & ~F.col("style_name").eqNullSafe(F.col("_style_before"))
    w = w.withColumn("authors_at", F.min(F.when(changed, F.col("para_no"))).over(doc))
    n, end = F.col("para_no"), F.coalesce("abstract_at", F.lit(2**40))
    part = (
        F.when(n >= F.coalesce("references_at", F.lit(2**40)), "references")
        .when(n > end, "body").when(n == end, "head")
        .when((n >= F.col("title_at")) & (n < F.least(F.coalesce("authors_at", end), end)), "title")
        .when((n >= F.col("authors_at")) & (n < end), "authors").otherwise("before")
    )
    w = w.withColumn("authors_found", F.coalesce(F.max((part == "authors") & F.col("shown")).over(doc), F.lit(False)))
    return w.withColumn("part", part).drop("_style_before")


def _rows(df: DataFrame, section: Column | str, checks: dict[str, Column], item: str | None = None, messages: dict[str, Column] | None = None, details: Column | None = None, items: str | None = None) -> DataFrame:
    """A finding per check and row, all from one pass: the checks are exploded, not unioned.  Null verdicts are none."""
    none = F.lit(None).cast("string")
    section = F.lit(section) if isinstance(section, str) else section
    number = (F.col(item) if item else F.lit(0)).cast("bigint")
    structs = [
        F.struct(
            section.alias("section"), number.alias("item_no"), (F.col(items) if items else F.lit(1)).cast("bigint").alias("items"), F.lit(name).alias("check_name"), verdict.alias("verdict"),
            (messages or {}).get(name, none).cast("string").alias("message"), (details if details is not None and name == "style_ok" else none).alias("details"),
        )
        for name, verdict in checks.items()
    ]
    return df.select("doc_id", F.explode(F.array(*structs)).alias("f")).select("doc_id", "f.*").where("verdict is not null")


def _failures() -> Column:
    return F.array_join("failures", "; ")


def text_sections(parts: DataFrame, cased: DataFrame) -> DataFrame:
    """Title, authors, abstract, headings and body paragraphs, from segments and titles with capitals as shown."""
    heading = F.create_map(*[F.lit(x) for pair in styles.HEADING_STYLES.items() for x in pair])
    text = single_spaces(F.col("t"))
    style = F.coalesce("style_name", F.lit(""))
    body_text = (
        ~F.rlike(text, F.lit(r"^(Table |Figure |Fig\. )")) & ~style.isin(*styles.HEADING_STYLES) & ~style.isin(*styles.LIST_STYLES)
        & ~F.rlike(text, F.lit(r"(?U)^\p{Ll}")) & (F.char_length(text) >= MIN_BODY)
    )
    kind = (
        F.when((F.col("part") == "title") & F.col("shown"), "title").when((F.col("part") == "authors") & F.col("shown"), "authors")
        .when(F.col("part") == "head", "abstract").when((F.col("part") == "body") & style.isin(*styles.HEADING_STYLES), heading[style])
        .when((F.col("part") == "body") & body_text, "body")
    )
    checked = styles.check_style(parts.withColumn("rule", kind).where("rule is not null").join(cased, ["doc_id", "para_no"], "left"))
    names = {"title": "Title", "authors": "Authors", "abstract": "Abstract", "section": "Headings", "subsection": "Headings", "third_level": "Headings", "body": "Paragraphs"}
    section = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("rule"))
    wanted = F.create_map(*[F.lit(x) for rule in ("title", "authors", "abstract") for x in (rule, styles.RULES[rule]["style"])])[F.col("rule")]
    checks = {
        "style_ok": scoring.flag(F.col("style_ok")),
        "case_ok": F.when(F.col("rule") == "title", scoring.flag(upper_ratio_ok(F.coalesce("cased", F.lit(""))))),
        "title_style_ok": F.when(wanted.isNotNull(), scoring.flag(style == wanted)),
    }
    found = _rows(checked, section, checks, "para_no", {"style_ok": _failures()}, styles.details())
    # Every document that gets here has one abstract heading.
    missing = F.when(~F.col("authors_found"), F.lit("authors not found"))
    return found.unionByName(_rows(parts.where("part = 'head'"), "Authors", {"found_ok": scoring.flag(F.col("authors_found"))}, None, {"found_ok": missing}))


def figure_section(paragraphs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Figures 1 to the largest number met, and the style of each caption shown, right or wrong in form."""
    rows = paragraphs.select("doc_id", F.col("para_no").cast("bigint").alias("seq"), "text", "scope")
    figures = captions.correlate_figures(captions.figure_marks(rows))
    checks = {c: scoring.flag(F.col(c)) for c in ("caption_ok", "unique_ok", "used_ok", "found_ok")}
    flags = _rows(figures, "Figures", checks, "id", {c: F.col("text") for c in checks}, items="numbers")
    ruled = figures.where("seq is not null").select("doc_id", F.col("seq").alias("para_no"), "id").join(resolved, ["doc_id", "para_no"])
    styled = styles.check_style(ruled.withColumn("rule", captions.caption_rule(F.col("text"), "figure")))
    return flags.unionByName(_rows(styled, "Figures", {"style_ok": _caption_verdict("figure")}, "id", {"style_ok": _failures()}, styles.details()))


def _caption_verdict(kind: str) -> Column:
    known = F.coalesce(F.col("style_name").isin(*styles.CAPTION_STYLES[kind]), F.lit(False))
    return captions.caption_style_verdict(F.col("text"), F.col("style_ok"), known)


def table_section(paragraphs: DataFrame, tables: DataFrame, resolved: DataFrame) -> DataFrame:
    """Real tables: more than one row and column, and text; their title is the paragraph before."""
    real = tables.where("n_cols > 1 and n_rows > 1 and has_text")
    titles = real.join(resolved.withColumnRenamed("para_no", "prev_para_no").drop("table_no", "block_no"), ["doc_id", "prev_para_no"], "left")
    titles = titles.withColumn("text", F.coalesce("text", F.lit("")))
    refs = captions.table_references(paragraphs.where("scope = 'body'").select("doc_id", "text"), titles)
    numbered = captions.caption_format(captions.number_tables(titles, refs))
    styled = styles.check_style(numbered.withColumn("rule", captions.caption_rule(F.col("text"), "table")))
    floating = captions.is_floating(F.col("anchored"), F.col("tblpY"), F.col("tblW_type"))
    shape = F.format_string("rows: %d, columns: %d, floating: %s", "n_rows", "n_cols", F.when(floating, "True").otherwise("False"))
    checks = {c: scoring.flag(F.col(c)) for c in ("text_format_ok", "order_ok", "used_ok")} | {"style_ok": _caption_verdict("table")}
    return _rows(styled, "Tables", checks, "id", {"text_format_ok": F.array_join("messages", "; "), "order_ok": shape, "style_ok": _failures()}, styles.details())


def reference_section(parts: DataFrame, runs: DataFrame, sheets: DataFrame, strict: bool = False) -> DataFrame:
    """Entries of the reference list: form, use, order, uniqueness, style and the font of URLs.

    A URL's own font has no say in its paragraph's.  ``strict`` asks for the style by name instead of
    by what it looks like.
    """
    late = parts.where("para_no > abstract_at").select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), "text", "length")
    groups = late.select("doc_id", "para_no", "length", F.posexplode(citations.bracket_groups(F.col("text"))).alias("n", "g"))
    expanded = groups.withColumn("ids", citations.expand_group(F.col("g"), F.col("length")))
    rows = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("para_no", "n", "ids"))))
    cited = expanded.groupBy("doc_id").agg(F.transform(rows, lambda r: r["ids"]).alias("groups"), F.count_if(F.col("ids").isNull()).alias("malformed"))
    items = citations.check_items(citations.list_items(late), cited)
    listed = F.array_sort(F.collect_list(F.struct("run_no", "text", "font_name", (F.col("size_emu") / geometry.EMU_PT).alias("size"))))
    fonts = styles.character_fonts(runs, sheets).groupBy("doc_id", "para_no").agg(citations.url_font_ok(listed).alias("url_ok"))
    full = items.join(parts.drop("length"), ["doc_id", "para_no"]).join(fonts, ["doc_id", "para_no"], "left")
    full = full.withColumns({c: F.col(f"no_url_{c}") for c in ("bold", "italic", "font_size", "font_name")})
    styled = styles.check_style(full.withColumn("rule", citations.reference_rule(F.col("place"), F.col("total"))))
    form = F.rlike(strip(F.col("text")), F.lit(citations.LIST_ITEM_TAB))
    text = F.concat_ws(
        "; ", F.when(~form, F.format_string("Number format error should be [%d] followed by a tab", "place")),
        F.when(~F.coalesce("url_ok", F.lit(True)), F.lit(f"URLs and DOIs should be {citations.URL_FONT[0]} and size {citations.URL_FONT[1]:g}pt")),
    )
    named = F.create_map(*[F.lit(x) for r in ("reference_few", "reference_first", "reference_later") for x in (r, styles.RULES[r]["style"])])[F.col("rule")]
    style = F.coalesce(F.col("style_name") == named, F.lit(False)) if strict else F.col("style_ok")
    checks = {c: scoring.flag(F.col(c)) for c in ("used_ok", "order_ok", "unique_ok")} | {"style_ok": scoring.flag(style), "text_ok": scoring.flag(form & F.coalesce("url_ok", F.lit(True)))}
    found = _rows(styled, "References", checks, "place", {"style_ok": _failures(), "text_ok": text}, styles.details())
    bad = cited.where("malformed > 0")
    return found.unionByName(_rows(bad, "References", {"citation_ok": F.lit(scoring.FAIL)}, None, {"citation_ok": F.format_string("%d malformed citations", "malformed")}))


def _reason() -> Column:
    seen = F.filter("paragraphs", lambda p: p["scope"] == "body")
    tracked = F.coalesce(F.exists(seen, lambda p: p["has_insertion"]), F.lit(False))
    abstract = F.coalesce(F.exists(seen, lambda p: F.lower(strip(p["text"])) == "abstract"), F.lit(False))
    return F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(tracked, "tracked changes are on").when(~abstract, "abstract header not found")


#: The column in which a table of parsed documents holds each one's reason.
REASON = "guard_reason"


def prepared(parsed: DataFrame) -> DataFrame:
    """Parsed documents as a table with the reason of each, which is found from all paragraphs once, not by every section."""
    return stored(parsed if REASON in parsed.columns else parsed.withColumn(REASON, _reason()), "parsed")


def guards(parsed: DataFrame) -> DataFrame:
    """(doc_id, reason): why a document isn't checked, or null; the first reason that holds."""
    return parsed.select("doc_id", (F.col(REASON) if REASON in parsed.columns else _reason()).alias("reason"))


def _upload_sections(parsed: DataFrame, strict: bool, only: tuple[str, ...] | None) -> list[DataFrame]:
    """The findings of a table of parsed documents, by section."""
    # The reason is a row's own, so nothing is joined and no document shuffled for it.
    good = parsed.where(F.col(REASON).isNull())
    paragraphs, runs, tables, sheets = (table(good, n) for n in ("paragraphs", "runs", "tables", "styles"))
    resolved = stored(styles.resolve(paragraphs, sheets, styles.both_fonts(runs, citations.URL_STARTS)), "resolved")
    counted = segments(resolved).withColumn("length", F.count("*").over(Window.partitionBy("doc_id")).cast("int"))
    parts = stored(counted, "segments")

    def texts():
        cased = styles.cased_text(runs, sheets).join(resolved.select("doc_id", "para_no", "caps"), ["doc_id", "para_no"])
        return text_sections(parts, cased.select("doc_id", "para_no", F.when(F.col("caps"), F.upper("text")).otherwise(F.col("text")).alias("cased")))

    def margins():
        pages = geometry.check_sections(table(good, "sections"))
        return _rows(pages, "Margins", {"margins_ok": scoring.flag(F.col("margins_ok")), "columns_ok": scoring.flag(F.col("columns_ok"))}, "section_no", {"margins_ok": F.col("page_size")})

    made = {
        ("Document",): lambda: _rows(guards(parsed).where("reason is not null"), "Document", {"parsed_ok": F.lit(scoring.FAIL)}, None, {"parsed_ok": F.col("reason")}),
        ("Title", "Authors", "Abstract", "Headings", "Paragraphs"): texts,
        ("Figures",): lambda: figure_section(paragraphs, resolved),
        ("Tables",): lambda: table_section(paragraphs, tables, resolved),
        ("References",): lambda: reference_section(parts, runs, sheets, strict),
        ("Styles",): lambda: _rows(styles.embedded_styles(good.select("doc_id"), sheets), "Styles", {"style_ok": scoring.flag(F.col("style_ok"))}, None, {"style_ok": F.col("style")}),
        ("Margins",): margins,
        ("Parsed Document",): lambda: _rows(styles.paragraph_inventory(paragraphs), "Parsed Document", {"style_ok": F.col("verdict")}, "para_no", {"style_ok": F.col("in_table")}),
    }
    return [make().select(*FINDING) for names, make in made.items() if only is None or set(names) & set(only)]


def upload_check(parsed: DataFrame, strict: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """All findings of parsed documents (rows of ``sources.docx``), which are written first unless they are a table.

    Documents that can't be parsed, have tracked insertions or lack an abstract get one finding
    that says so, and no others.  ``only`` names the sections that are asked for; the others aren't made.
    """
    found = gathered(_upload_sections(prepared(parsed), strict, only), "findings")
    return found if only is None else found.where(F.col("section").isin(*only))


def _catalogue_sections(parsed: DataFrame, catalogue: DataFrame) -> list[DataFrame]:
    good = parsed.where(F.col(REASON).isNull())
    known = good.select("doc_id", "paper_code").join(catalogue.select("paper_id", F.col("title").alias("their_title"), "authors"), F.col("paper_code") == F.col("paper_id"))
    paragraphs, runs, sheets = (table(good, n) for n in ("paragraphs", "runs", "styles"))
    parts = stored(segments(paragraphs).where("part in ('title', 'authors') and shown").select("doc_id", "para_no", "style_name", "part"), "title-and-authors")
    caps = styles.with_base(sheets).select("doc_id", F.col("name").alias("style_name"), "caps")
    # Only the runs of these paragraphs are put together.
    runs = runs.join(parts.select("doc_id", "para_no"), ["doc_id", "para_no"], "left_semi")
    plain = styles.without_superscripts(runs).withColumnRenamed("text", "plain")
    cased = styles.cased_text(runs, sheets).withColumnRenamed("text", "cased")
    rows = parts.join(caps, ["doc_id", "style_name"], "left").join(plain, ["doc_id", "para_no"], "left").join(cased, ["doc_id", "para_no"], "left")
    shown = F.when(F.coalesce("caps", F.lit(False)), F.upper("cased")).otherwise(F.col("cased"))
    line = F.coalesce(F.when(F.col("part") == "title", shown).otherwise(F.concat("plain", F.lit(", "))), F.lit(""))
    joined = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("para_no", line.alias("line"))))), lambda r: r["line"]), "")
    texts = rows.groupBy("doc_id").agg(joined("title").alias("title"), joined("authors").alias("author_text"))
    known = stored(known.select("doc_id", "their_title", "authors").join(texts, "doc_id"), "known")
    titles = _rows(known, "Catalogue", {"title_ok": matching.title_verdict(F.col("title"), F.col("their_title"))}, None, {"title_ok": F.col("their_title")})
    ours = known.select("doc_id", F.posexplode(author_names(F.col("author_text"))).alias("pos", "name"))
    theirs = known.select("doc_id", F.posexplode("authors").alias("pos", "name"))
    matched = stored(matching.match_authors(ours, theirs), "matched-authors")
    single = _rows(matched, "Catalogue", {"author_ok": F.col("verdict")}, "ord", {"author_ok": F.concat_ws(" / ", "document", "catalogue")})
    left_over = matched.groupBy("doc_id").agg(F.count_if(F.col("verdict") == scoring.FAIL).alias("left_over"))
    lists = known.select("doc_id", F.array_join("authors", " ").alias("theirs")).join(left_over, "doc_id", "left")
    whole = _rows(lists, "Catalogue", {"authors_ok": scoring.flag(F.coalesce("left_over", F.lit(0)) == 0)}, None, {"authors_ok": F.col("theirs")})
    return [found.select(*FINDING) for found in (titles, whole, single)]


def catalogue_check(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Findings on title and authors of documents whose paper code the catalogue (paper_id, title, authors) knows.

    Titles are compared as they are shown, authors without their footnote marks.  The list of authors
    as a whole is in order if each of either side has a partner, near matches included.
    """
    return gathered(_catalogue_sections(prepared(parsed), catalogue), "catalogue-findings")


def metadata(parsed: DataFrame) -> DataFrame:
    shown = lambda c: F.date_format(F.try_to_timestamp(c), "dd/MM/yyyy HH:mm").alias(c)
    return parsed.select("doc_id", "filename", "author", "revision", "version", "language", shown("created"), shown("modified"))


def all_findings(parsed: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """The upload check's findings and, with a catalogue, those on title and authors."""
    parsed = prepared(parsed)
    return gathered(_upload_sections(parsed, False, None) + (_catalogue_sections(parsed, catalogue) if catalogue is not None else []), "findings")


def report(parsed: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(doc_id, filename, report, key): scores, sections, findings and metadata as JSON, and the JSON's own name.

    Findings are computed once and written; scores and sections are read from them.  With a catalogue
    its section is one of them.
    """
    from paperloom.operators.queue import content_key

    parsed = prepared(parsed)
    findings = all_findings(parsed, catalogue)
    scores = scoring.score(findings).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", F.array("positive", "unknown", "negative"))))).alias("scores"))
    checked = guards(parsed).where("reason is null").select("doc_id")
    sections = scoring.section_summary(checked, findings).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "verdict")))).alias("sections"))
    listed = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "item_no", "items", "check_name", "verdict", "message", "details"))).alias("summary"))
    all_of = metadata(parsed).join(scores, "doc_id").join(listed, "doc_id").join(sections, "doc_id", "left")
    body = F.to_json(F.struct("scores", "sections", "summary", F.struct("author", "revision", "version", "language", "created", "modified").alias("metadata"), "filename"))
    return all_of.select("doc_id", "filename", body.alias("report")).withColumn("key", content_key(F.col("report")))
