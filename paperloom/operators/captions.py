"""Captions of figures and tables, and the places where the text refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions.text import NBSP, single_spaces, strip
from paperloom.functions.titlecase import is_title_case

#: The patterns of captions and references.
FIGURE_CAPTION = r"(?U)^Figure \d+[.:]"
FIGURE_WRONG = r"(?U)^Fig.\s?\d+|^Figure\s?\d+[.\s]+"
FIGURE_REFERENCE = r"(?U)Fig.\s?\d+|Figure\s?\d+[.\-\s]+"
TABLE_REFERENCE = r"(?U)Table\s?\d+|Tables\s?\d+\sand\s\d+"
TABLE_CAPTION = r"(?U)^Table \d+:"
TABLE_ORDER = r"(?U)^Table \d+"
ONE_LINE, UNSURE = 55, (40, 80)
#: Messages of the caption format.
MESSAGES = ('Does not use "Table N: " format', "Has a . at the end of the sentence", "Not in Title Case/Initial Caps")


def digits(c: Column) -> Column:
    """All digits of a text as one number; null if there is none, or more than a long takes."""
    return F.regexp_replace(c, r"(?U)\D", "").try_cast("bigint")


def figure_marks(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, seq, n, kind, id, name, text): captions (c), wrongly formed ones (w) and references (r), in one pass.

    Paragraphs (doc_id, seq, text) are those of body and cells; a column ``scope`` keeps references to
    the body.  A hit that ends in a dot and opens its paragraph is a caption and no reference.
    """
    paragraphs = paragraphs.withColumn("shown", strip(F.col("text")))
    shown = F.col("shown")
    hits = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    marked = lambda names, kind: F.transform(names, lambda name, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), name.alias("name")))
    opens = lambda name: F.endswith(name, F.lit(".")) & F.startswith(shown, name)
    references = F.filter(F.transform(hits(F.col("text"), FIGURE_REFERENCE), strip), lambda name: ~opens(name))
    if "scope" in paragraphs.columns:
        references = F.when(F.col("scope") == "body", references).otherwise(F.array().cast("array<string>"))
    every = F.concat(marked(hits(shown, FIGURE_CAPTION), "c"), marked(hits(shown, FIGURE_WRONG), "w"), marked(references, "r"))
    rows = paragraphs.select("doc_id", "seq", "shown", F.explode(every).alias("m"))
    return rows.select("doc_id", "seq", "m.n", "m.kind", digits(F.col("m.name")).alias("id"), "m.name", F.when(F.col("m.kind") != "r", shown).alias("text"))


def correlate_figures(marks: DataFrame) -> DataFrame:
    """Figures 1 to the largest number met, per document, with captions (else wrong ones), references and flags.

    A row stands for ``numbers`` figures from ``id`` on: one that is met, or all of those missing
    between two, whatever their number; ``each_number`` makes rows of them.  One shuffle by document
    serves the grouping by number and the search for gaps.
    """
    item = F.struct("seq", "n", "name", "text")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("item"))))
    rows = marks.where("id >= 1").select("doc_id", "id", "kind", item.alias("item")).repartition("doc_id")
    met = rows.groupBy("doc_id", "id").agg(*(pick(k).alias(k) for k in "cwr"))
    before = F.coalesce(F.lag("id").over(Window.partitionBy("doc_id").orderBy("id")), F.lit(0))
    met = met.withColumn("before", before)
    none = F.array().cast(dict(met.dtypes)["c"])
    missing = F.struct((F.col("before") + 1).alias("id"), (F.col("id") - F.col("before") - 1).alias("numbers"), *(none.alias(k) for k in "cwr"))
    own = F.struct("id", F.lit(1).cast("bigint").alias("numbers"), *"cwr")
    full = met.select("doc_id", F.explode(F.filter(F.array(missing, own), lambda x: x["numbers"] > 0)).alias("x")).select("doc_id", "x.*")
    shown = F.when(F.size("c") > 0, F.col("c")).when(F.size("w") > 0, F.col("w"))
    out = full.select(
        "doc_id", "id", "numbers", F.transform("r", lambda r: r["name"]).alias("refs"), (F.size("r") > 0).alias("used_ok"),
        F.when(F.size("c") > 0, F.size("c") == 1).when(F.size("w") > 0, F.size("w") == 1).otherwise(F.lit(False)).alias("unique_ok"),
        (F.size("c") + F.size("w") > 0).alias("found_ok"), (F.size("c") == 1).alias("one"), F.explode_outer(shown).alias("item"),
    )
    return out.select(
        "doc_id", "id", "numbers", F.col("item.seq").alias("seq"), F.col("item.name").alias("name"), F.col("item.text").alias("text"), "refs", "used_ok", "unique_ok", "found_ok",
        F.coalesce(F.col("one") & F.endswith(F.col("item.name"), F.lit(":")), F.lit(False)).alias("caption_ok"),
    )


def each_number(figures: DataFrame) -> DataFrame:
    """A row for every number that the rows of ``correlate_figures`` stand for."""
    each = F.explode(F.sequence(F.col("id"), F.col("id") + F.col("numbers") - 1)).alias("id")
    return figures.select("doc_id", each, *(c for c in figures.columns if c not in ("doc_id", "id", "numbers")))


def caption_rule(text: Column, kind: str) -> Column:
    """The style rule of a caption: one line or more."""
    return F.when(F.char_length(strip(text)) > ONE_LINE, f"{kind}_caption_lines").otherwise(f"{kind}_caption_line")


def caption_style_verdict(text: Column, style_ok: Column, known_style: Column) -> Column:
    """unknown where the length leaves the rule open or the style isn't a caption's; else the style's verdict."""
    n = F.char_length(strip(text))
    return F.when((n > UNSURE[0]) & (n < UNSURE[1]), "unknown").when(~known_style, "unknown").when(style_ok, "ok").otherwise("fail")


def table_references(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, id): numbers of tables named in body paragraphs that are no table's title.

    Paragraphs leave by an anti-join on (doc_id, text), before their text is searched.
    """
    body = paragraphs.join(titles.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")
    hits = body.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", NBSP, " "), F.lit(TABLE_REFERENCE), F.lit(0))).alias("hit"))
    return hits.select("doc_id", F.explode(F.split("hit", " ", -1)).alias("w")).select("doc_id", strip(F.col("w")).try_cast("int").alias("id")).where("id is not null")


def caption_messages(text: Column) -> Column:
    """array<string>: what is wrong with a table's caption, apart from title case."""
    t = strip(text)
    return F.array_compact(F.array(F.when(~F.rlike(t, F.lit(TABLE_CAPTION)), MESSAGES[0]), F.when(F.rlike(t, F.lit(r"\.$")), MESSAGES[1])))


def caption_format(titles: DataFrame) -> DataFrame:
    """``titles`` plus messages (array) and text_format_ok; title case is tested on letters and blanks."""
    plain = single_spaces(F.regexp_replace(strip(F.col("text")), "[^a-zA-Z ]", " "))
    cased = titles.withColumn("_cased", is_title_case(plain))
    messages = F.concat(caption_messages(F.col("text")), F.when(F.col("_cased"), F.array().cast("array<string>")).otherwise(F.array(F.lit(MESSAGES[2]))))
    return cased.withColumn("messages", messages).withColumn("text_format_ok", F.size("messages") == 0).drop("_cased")


def number_tables(titles: DataFrame, references: DataFrame) -> DataFrame:
    """``titles`` (doc_id, table_no, text) numbered by place, with uses, used_ok and order_ok."""
    placed = titles.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no")))
    uses = references.groupBy("doc_id", "id").agg(F.count("*").alias("uses"))
    joined = placed.join(uses, ["doc_id", "id"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    order = F.regexp_extract(strip(F.col("text")), TABLE_ORDER, 0) == F.concat(F.lit("Table "), F.col("id").cast("string"))
    return joined.withColumn("used_ok", F.col("uses") > 0).withColumn("order_ok", order)


def is_floating(anchored: Column, offset_y: Column, width_type: Column) -> Column:
    """A table that text flows around, set lower than a line, of automatic width."""
    return F.coalesce(anchored & F.coalesce(offset_y > 11, F.lit(True)) & (width_type == "auto"), F.lit(False))
