"""Formatting of paragraphs and runs, resolved from styles, and the rules it is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .geometry import points

#: Alignment, font size, space before and after, bold, italic, first-line indent and style by rule.
#: A missing key isn't checked; None must be unset; a tuple of operator and number compares; a list allows its members.
RULES = {
    "title": dict(alignment="CENTER", font_size=14.0, before=0.0, after=3.0, bold=True, italic=None, style="JACoW_Paper Title"),
    "authors": dict(alignment="CENTER", font_size=12.0, before=9.0, after=12.0, bold=[None, False], italic=[None, False], style="JACoW_Author List"),
    "abstract": dict(alignment=None, font_size=12.0, before=0.0, after=3.0, bold=None, italic=True, style="JACoW_Abstract_Heading"),
    "section": dict(alignment="CENTER", font_size=12.0, before=9.0, after=3.0, bold=True, italic=None, style="JACoW_Section Heading"),
    "subsection": dict(alignment=None, font_size=12.0, before=6.0, after=3.0, bold=None, italic=True, style="JACoW_Subsection Heading"),
    "third_level": dict(alignment=None, font_size=10.0, before=6.0, after=0.0, bold=True, italic=None, style="JACoW_Third - Level Heading"),
    "body": dict(alignment="JUSTIFY", font_size=10.0, before=0.0, after=0.0, first_line=9.35, style="JACoW_Body Text Indent"),
    "figure_caption_line": dict(alignment="CENTER", font_size=10.0, before=3.0, after=(">=", 3.0), bold=None, italic=None, style="Figure Caption"),
    "figure_caption_lines": dict(alignment="JUSTIFY", font_size=10.0, before=3.0, after=(">=", 3.0), bold=None, italic=None, style="Figure Caption Multi Line"),
    "table_caption_line": dict(alignment="CENTER", font_size=10.0, before=(">=", 3.0), after=3.0, bold=None, italic=None, style="Table Caption"),
    "table_caption_lines": dict(alignment="JUSTIFY", font_size=10.0, before=(">=", 3.0), after=3.0, bold=None, italic=None, style="Table Caption Multi Line"),
    "reference_few": dict(alignment="JUSTIFY", font_size=9.0, before=0.0, after=3.0, first_line=-14.75, style="JACoW_References when ≤ 9"),
    "reference_first": dict(alignment="JUSTIFY", font_size=9.0, before=0.0, after=3.0, first_line=-14.75, style="JACoW_Reference #1-9 when >= 10 Refs"),
    "reference_later": dict(alignment="JUSTIFY", font_size=9.0, before=0.0, after=3.0, first_line=-19.3, style="JACoW_Reference #10 onwards"),
}
#: Styles that a document made from the template embeds.
REQUIRED_STYLES = (
    "JACoW_Abstract_Heading", "JACoW_Author List", "JACoW_Body Text Indent", "JACoW_Bulleted List", "JACoW_Numbered list", "JACoW_Paper Title",
    "JACoW_Reference #10 onwards", "JACoW_Reference #1-9 when >= 10 Refs", "JACoW_Reference when <= 9 Refs", "JACoW_Reference Italics",
    "JACoW_Reference url_doi", "JACoW_Third-level Heading", "JACoW_Section Heading", "JACoW_Subsection Heading",
)
CAPTION_STYLES = {
    "figure": ("Figure Caption", "Figure Caption Multi Line", "Caption", "Caption Multi Line"),
    "table": ("Table Caption", "Table Caption Multi Line", "Caption", "Caption Multi Line"),
}
TEMPLATE_STYLES = ("Body Text Indent", "Normal", "Caption", "Heading 3")
LIST_STYLES = ("JACoW_Bulleted List", "JACoW_Numbered list", "Bulleted List", "Numbered list")
HEADING_STYLES = {
    "JACoW_Section Heading": "section", "Section Heading": "section", "JACoW_Subsection Heading": "subsection", "Subsection Heading": "subsection",
    "JACoW_Third - Level Heading": "third_level", "Third - Level Heading": "third_level",
}
DEFAULT_SIZE, DEFAULT_FONT = 10.0, "Times new Roman"
CHECKED = ("alignment", "font_size", "before", "after", "bold", "italic", "first_line")
SPACES = ("before", "after", "first_line")

FORMAT = ("alignment", "before_emu", "after_emu", "first_line_emu", "hanging_emu", "left_emu")
FONT = ("bold", "italic", "all_caps", "size_emu", "font_name")


def with_base(styles: DataFrame) -> DataFrame:
    """``styles`` (doc_id, name, base_name, FORMAT..., FONT...) with what one base level fills in.

    Both joins of a paragraph's resolution go by (doc_id, style name), so they share a partitioning.
    """
    base = styles.select("doc_id", F.col("name").alias("base_name"), *(F.col(c).alias(f"b_{c}") for c in FORMAT + FONT))
    joined = styles.join(base, ["doc_id", "base_name"], "left")
    # A style raises its text to capitals if it or its base does, whatever the other says.
    caps = F.coalesce("all_caps", F.lit(False)) | F.coalesce("b_all_caps", F.lit(False))
    return joined.select("doc_id", "name", "base_name", *(F.coalesce(c, f"b_{c}").alias(c) for c in FORMAT + FONT), caps.alias("caps"))


def run_fonts(runs: DataFrame, url_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, para_no, FONT): of each attribute the last value that a non-blank run sets.

    Runs that start with one of ``url_prefixes`` have no say.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    counted = runs.where(F.char_length(text) > 0)
    for prefix in url_prefixes:
        counted = counted.where(~F.startswith(text, F.lit(prefix)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("run_no"))).alias(c)
    return counted.groupBy("doc_id", "para_no").agg(*map(last, FONT))


def both_fonts(runs: DataFrame, url_prefixes: tuple[str, ...]) -> DataFrame:
    """``run_fonts`` of all runs, and beside it (as no_url_<attribute>) of those that start with no URL, from one pass."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    url = F.lit(False)
    for prefix in url_prefixes:
        url = url | F.startswith(text, F.lit(prefix))
    last = lambda c, where: F.max_by(c, F.when(where & F.col(c).isNotNull(), F.col("run_no")))
    return runs.where(F.char_length(text) > 0).groupBy("doc_id", "para_no").agg(*(last(c, F.lit(True)).alias(c) for c in FONT), *(last(c, ~url).alias(f"no_url_{c}") for c in FONT))


def character_fonts(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """``runs`` with font_name and size_emu as their character style has them, else its base, else the run itself."""
    s = with_base(styles).select("doc_id", F.col("name").alias("style_name"), F.col("font_name").alias("s_font"), F.col("size_emu").alias("s_size"))
    joined = runs.join(s, ["doc_id", "style_name"], "left")
    return joined.withColumns({"font_name": F.coalesce("s_font", "font_name"), "size_emu": F.coalesce("s_size", "size_emu")}).drop("s_font", "s_size")


def resolve(paragraphs: DataFrame, styles: DataFrame, fonts: DataFrame) -> DataFrame:
    """``paragraphs`` with CHECKED attributes in points: own value, else the style's, else its base's.

    Where ``fonts`` come from ``both_fonts``, no_url_<attribute> columns say what holds without URLs.
    ``caps`` tells whether the style raises text to capitals.

    LEFT alignment counts as none; a first-line indent that is unset or zero is the hanging indent
    negated; a font that is nowhere set is 10 pt ``Times new Roman``.
    """
    s = with_base(styles).select("doc_id", F.col("name").alias("style_name"), *(F.col(c).alias(f"s_{c}") for c in FORMAT + FONT), F.col("caps").alias("s_caps"))
    more = [c for c in fonts.columns if c.startswith("no_url_")]
    f = fonts.select("doc_id", "para_no", *(F.col(c).alias(f"r_{c}") for c in (*FONT, *more)))
    keep = [c for c in paragraphs.columns if c not in FORMAT]
    joined = paragraphs.join(s, ["doc_id", "style_name"], "left").join(f, ["doc_id", "para_no"], "left")
    own = {c: F.coalesce(F.col(c), F.col(f"s_{c}")) for c in FORMAT}
    def shown(prefix: str = ""):
        font = {c: F.coalesce(f"r_{prefix}{c}", f"s_{c}") for c in FONT}
        return [
            font["bold"].alias(f"{prefix}bold"), font["italic"].alias(f"{prefix}italic"), font["all_caps"].alias(f"{prefix}all_caps"),
            F.coalesce(points(font["size_emu"]), F.lit(DEFAULT_SIZE)).alias(f"{prefix}font_size"), F.coalesce(font["font_name"], F.lit(DEFAULT_FONT)).alias(f"{prefix}font_name"),
        ]

    first = F.when(F.coalesce(own["first_line_emu"], F.lit(0)) != 0, points(own["first_line_emu"])).when(
        F.coalesce(own["hanging_emu"], F.lit(0)) != 0, -points(own["hanging_emu"])
    ).otherwise(own["first_line_emu"].cast("double"))
    return joined.select(
        *keep, F.when(own["alignment"] != "LEFT", own["alignment"]).alias("alignment"), points(own["before_emu"]).alias("before"),
        points(own["after_emu"]).alias("after"), first.alias("first_line"), points(own["left_emu"]).alias("left_indent"),
        *shown(), *(shown("no_url_") if more else []), F.coalesce("s_caps", F.lit(False)).alias("caps"),
    )


def compare(actual: Column, op: str, limit) -> Column:
    """A comparison by its operator's name."""
    return {">": actual > limit, "<": actual < limit, ">=": actual >= limit, "<=": actual <= limit, "=": actual == limit}[op]


def _holds(attr: str, expected) -> Column:
    actual = F.col(attr)
    if isinstance(expected, tuple):
        return F.coalesce(compare(actual, *expected), F.lit(False))
    if isinstance(expected, list):
        return F.coalesce(*(F.when(actual.eqNullSafe(F.lit(e)), True) for e in expected), F.lit(False))
    if attr in SPACES and expected == 0.0:
        return F.coalesce(actual, F.lit(0.0)) == 0.0
    return actual.eqNullSafe(F.lit(expected))


def check_style(resolved: DataFrame, rule: Column | str = "rule") -> DataFrame:
    """``resolved`` with <attribute>_ok (null: not checked), style_ok (all that are checked) and failures.

    The rules are constants in the plan; there is no join.
    """
    rule = F.col(rule) if isinstance(rule, str) else rule
    flags, messages = {}, []
    for attr in CHECKED:
        # Rules that ask for the same share a branch, which keeps the plan's code small.
        asked: dict[str, tuple] = {}
        for name, wanted in RULES.items():
            if attr in wanted:
                asked.setdefault(repr(wanted[attr]), (wanted[attr], []))[1].append(name)
        case = shown = None
        for expected, names in asked.values():
            good, mine = _holds(attr, expected), rule.isin(*names)
            case = F.when(mine, good) if case is None else case.when(mine, good)
            shown = F.when(mine, _shown(expected)) if shown is None else shown.when(mine, _shown(expected))
        flags[f"{attr}_ok"] = case
        messages.append(F.when(~case, F.concat(F.lit(f"{attr}: "), F.coalesce(F.col(attr).cast("string"), F.lit("None")), F.lit(" should be "), shown)))
    out = resolved.withColumns(flags).withColumn("failures", F.array_compact(F.array(*messages)))
    return out.withColumn("style_ok", F.size("failures") == 0)


def _shown(expected) -> str:
    if isinstance(expected, tuple):
        return f"{expected[0]} {expected[1]}"
    return " or ".join(map(str, expected)) if isinstance(expected, list) else str(expected)


def embedded_styles(docs: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, style, style_ok): each required style of each document; the list is exploded, not joined to."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, REQUIRED_STYLES))).alias("style"))
    have = styles.select("doc_id", F.col("name").alias("style"), F.lit(True).alias("have")).distinct()
    return wanted.join(have, ["doc_id", "style"], "left").select("doc_id", "style", F.coalesce("have", F.lit(False)).alias("style_ok"))


def paragraph_inventory(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_no, style_name, in_table, verdict) of non-blank paragraphs; an odd style is never worse than unknown."""
    shown = paragraphs.where(F.rlike("text", F.lit(r"(?U)\S")))
    place = F.when(F.col("scope") == "cell", F.format_string("Table %d:<br/>row %d, col %d", "table_no", "row_no", "col_no")).otherwise("No")
    known = F.col("style_name").isin(*REQUIRED_STYLES, *CAPTION_STYLES["figure"], *CAPTION_STYLES["table"])
    return shown.select("doc_id", "para_no", "style_name", place.alias("in_table"), F.when(known, "ok").otherwise("unknown").alias("verdict"))


def style_histogram(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(F.rlike("text", F.lit(r"(?U)\S"))).groupBy("doc_id", "style_name").count()


def foreign_paragraphs(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """Non-blank body paragraphs whose style is neither one of the template's that their document embeds nor a common one."""
    own = styles.where(F.startswith("name", F.lit("JACoW"))).select("doc_id", F.col("name").alias("style_name")).distinct()
    shown = paragraphs.where((F.col("scope") == "body") & F.rlike("text", F.lit(r"(?U)\S")) & ~F.coalesce(F.col("style_name").isin(*TEMPLATE_STYLES), F.lit(False)))
    return shown.join(own, ["doc_id", "style_name"], "left_anti").select(*paragraphs.columns)


def heading_level(style_name: Column) -> Column:
    """A guess at the rule of a heading that isn't of the template."""
    return F.when(style_name == "Heading 2", "subsection").when(style_name == "Heading 3", "third_level").otherwise("section")


def details(prefix: str = "") -> Column:
    """What a paragraph measures, as JSON; without keys for what is unset."""
    return F.to_json(F.struct(*(F.col(prefix + c if prefix and c in ("bold", "italic", "font_size") else c).alias(c) for c in CHECKED)))


def cased_text(runs: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """(doc_id, para_no, text) with runs raised to capitals that are all-caps, or of a character style that is.

    runs: run_no, text, all_caps and, with ``styles``, style_name.  What the paragraph's own style
    raises is ``caps`` of ``resolve``.
    """
    caps = F.coalesce("all_caps", F.lit(False))
    if styles is not None:
        s = styles.select("doc_id", F.col("name").alias("style_name"), F.col("all_caps").alias("s_caps"))
        runs = runs.join(s, ["doc_id", "style_name"], "left")
        caps = caps | F.coalesce("s_caps", F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("run_no", F.when(caps, F.upper("text")).otherwise(F.col("text")).alias("t"))))
    return runs.groupBy("doc_id", "para_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def without_superscripts(runs: DataFrame) -> DataFrame:
    """(doc_id, para_no, text) of the runs that aren't superscript."""
    parts = F.array_sort(F.collect_list(F.when(~F.coalesce("superscript", F.lit(False)), F.struct("run_no", "text"))))
    return runs.groupBy("doc_id", "para_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
