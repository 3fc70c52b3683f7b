"""Citations in the text and the list of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The patterns of citations and list entries, what URLs start with, and their font.
CITATION = r"(?U)(?<!^)\[([\d ,-]+)\]"
LIST_ITEM = r"(?U)^\[(\d+)\]"
LIST_ITEM_TAB = r"(?U)^\[(\d+)\]\t"
URL_STARTS = ("doi:", "http://www.", "http://", "https://", "www.")
URL_FONT = ("Liberation Mono", 8.0)


def bracket_groups(text: Column) -> Column:
    """The insides of citations: brackets of digits, blanks, commas and hyphens, not at the start."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def expand_group(group: Column, highest: Column | None = None) -> Column:
    """array<int> of a bracket's numbers, or null if it is malformed.

    ``a-b`` is an inclusive range and ``a-b-c`` counts from a in steps of c + 2 below b + 1; blank
    parts of a comma list are skipped.  Ranges end at ``highest`` where it is given: what is checked
    goes by an entry's place in the list, and no number beyond the list's length bears on that, so a
    bound of at least that length changes no result and keeps absurd ranges short.
    """
    number = r"(?U)^\s*\d+\s*$"

    def part(p: Column) -> Column:
        ends = F.transform(F.split(p, "-", -1), lambda x: F.when(F.rlike(x, F.lit(number)), F.trim(x).try_cast("int")))
        low, high = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2))
        step = F.when(F.size(ends) == 3, F.try_element_at(ends, F.lit(3)) + 2).otherwise(F.lit(1))
        last = high if highest is None else F.least(high, highest)
        empty = F.array().cast("array<int>")
        series = F.when(low > last, empty).when(low <= last, F.sequence(F.least(low, last), last, step))
        return F.when(F.size(ends) == 1, F.when(low.isNotNull(), F.array(low))).when(F.size(ends) <= 3, F.when(F.exists(ends, lambda e: e.isNull()), None).otherwise(series))

    parts = F.transform(F.filter(F.split(group, ",", -1), lambda p: F.rlike(p, F.lit(r"(?U)\S"))), part)
    blank = ~F.contains(group, F.lit(",")) & ~F.rlike(group, F.lit(r"(?U)\S"))
    return F.when(~F.exists(parts, lambda p: p.isNull()) & ~blank, F.flatten(parts))


def out_of_order(groups: Column) -> Column:
    """array<int>: numbers cited before all smaller ones were, from array<array<int>> of groups in order.

    ``k`` is the largest number such that 1..k have been met; what is met too early waits in
    ``seen`` and is out of order if a group ends with it waiting.
    """
    ints = "array<int>"
    start = F.struct(F.lit(0).alias("k"), F.array().cast(ints).alias("seen"), F.array().cast(ints).alias("ooo"))

    def meet(acc, ref):
        grow = ref == acc["k"] + 1
        wait = (ref > acc["k"] + 1) & ~F.array_contains(acc["seen"], ref)
        return F.struct(
            F.when(grow, ref).otherwise(acc["k"]).alias("k"),
            F.when(wait, F.concat(acc["seen"], F.array(ref))).otherwise(acc["seen"]).alias("seen"),
            acc["ooo"].alias("ooo"),
        )

    def drain(acc, ref):
        grow = ref == acc["k"] + 1
        return F.struct(
            F.when(grow, ref).otherwise(acc["k"]).alias("k"),
            F.when(grow, F.array_remove(acc["seen"], ref)).otherwise(acc["seen"]).alias("seen"),
            acc["ooo"].alias("ooo"),
        )

    def group(acc, refs):
        met = F.aggregate(refs, acc, meet)
        drained = F.aggregate(met["seen"], met, drain)
        return F.struct(drained["k"].alias("k"), drained["seen"].alias("seen"), F.array_union(drained["ooo"], drained["seen"]).alias("ooo"))

    return F.aggregate(groups, start, group, lambda acc: acc["ooo"])


def list_items(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_no, id, numbered): the list's entries from (doc_id, para_no, text) after the abstract.

    An entry starts with its number in brackets.  Once number 1 has been met past the first
    paragraph, a paragraph whose first four characters hold the next number is an entry too, though
    not in the right form.  That depends on the entry before, so a document's paragraphs are folded
    in order, natively.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    first = F.regexp_extract(text, LIST_ITEM, 1).try_cast("int")
    row = F.struct("para_no", first.alias("id"), F.left(text, F.lit(4)).alias("head"))
    rows = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("para_no").alias("low"))
    kind = "array<struct<para_no:bigint,id:int,numbered:boolean>>"
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("last"), F.array().cast(kind).alias("out"))

    def step(acc, r):
        follows = acc["on"] & r["id"].isNull() & F.contains(r["head"], (acc["last"] + 1).cast("string"))
        new = F.coalesce(r["id"], F.when(follows, acc["last"] + 1))
        entry = F.struct(r["para_no"].cast("bigint").alias("para_no"), new.alias("id"), r["id"].isNotNull().alias("numbered"))
        begins = F.coalesce((r["id"] == 1) & (r["para_no"] > F.col("low")), F.lit(False))
        return F.struct(
            (acc["on"] | begins).alias("on"), F.coalesce(new, acc["last"]).alias("last"),
            F.when(new.isNotNull(), F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"),
        )

    return rows.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("e")).select("doc_id", "e.*")


def check_items(items: DataFrame, cited: DataFrame) -> DataFrame:
    """``items`` (doc_id, para_no, id) with place, unique_ok, order_ok and used_ok.

    ``cited`` is (doc_id, groups array<array<int>>).  Order and use go by the place in the list.
    """
    marks = cited.select("doc_id", F.array_distinct(F.flatten("groups")).alias("used"), out_of_order(F.col("groups")).alias("ooo"))
    by_doc = Window.partitionBy("doc_id")
    placed = items.withColumn("place", F.row_number().over(by_doc.orderBy("para_no")))
    placed = placed.withColumn("unique_ok", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("para_no")) == 1)
    joined = placed.join(marks, "doc_id", "left")
    late = F.coalesce(F.array_contains("ooo", F.col("place")), F.lit(False))
    return joined.select(
        *placed.columns, ((F.col("place") == F.col("id")) & ~late).alias("order_ok"), F.coalesce(F.array_contains("used", F.col("place")), F.lit(False)).alias("used_ok"),
        F.count("*").over(by_doc).alias("total"),
    )


def reference_rule(place: Column, total: Column) -> Column:
    """Which rule an entry's style follows: by the list's length and its place."""
    return F.when(total <= 9, "reference_few").when(place <= 9, "reference_first").otherwise("reference_later")


def url_font_ok(runs: Column) -> Column:
    """Whether the URLs among array<struct<text,font_name,size>> runs have a font of their own.

    A run that starts with a URL must have the URL font; one that holds a URL further on is wrong.
    Prefixes are tried in order and the first that a run starts with ends the search.
    """

    def wrong(r: Column) -> Column:
        text = F.regexp_replace(r["text"], r"(?U)^\s+|\s+$", "")
        font = F.coalesce((r["font_name"] == URL_FONT[0]) & (r["size"] == URL_FONT[1]), F.lit(False))
        case, inside = None, F.lit(False)
        for s in URL_STARTS:
            begins = F.startswith(text, F.lit(s))
            case = F.when(begins, ~font | inside) if case is None else case.when(begins, ~font | inside)
            inside = inside | F.contains(text, F.lit(s))
        return case.otherwise(inside)

    return ~F.exists(runs, wrong)
