"""Titles and authors against the catalogue.

The greedy one-to-one matching of two author lists is two rounds of pairing by rank: equal comparison
values pair off in order (k-th with k-th), and what is left by transliterated first initial and surname.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.functions.text import first_and_last, normal_name, same_title, transliterate


def match_authors(document: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, document, catalogue, verdict, ord) from two tables (doc_id, pos, name).

    ``verdict``: ok for equal names, unknown for a loose match, fail for a name left over.
    ``ord`` sorts exact pairs, loose pairs, the catalogue's left-overs, then the document's.
    Null names take no part.  Both lists are shuffled once, by doc_id; every rank and pairing is a
    window or group within that partitioning.
    """

    def compared(names: DataFrame, side: int) -> DataFrame:
        value = normal_name(F.col("name"))
        return names.where(F.col("name").isNotNull()).select("doc_id", F.lit(side).alias("side"), F.col("pos").cast("long").alias("pos"), "name", value.alias("value"), transliterate(first_and_last(value)).alias("loose"))

    by = Window.partitionBy
    # The k-th name of a side pairs off with the k-th of the other, and a pair is two rows of a class.
    both = compared(document, 0).unionByName(compared(catalogue, 1)).repartition("doc_id")
    ranked = both.withColumn("place", F.row_number().over(by("doc_id", "side").orderBy("pos")))
    ranked = ranked.withColumn("k", F.row_number().over(by("doc_id", "value", "side").orderBy("pos")))
    ranked = ranked.withColumn("exact", F.count("*").over(by("doc_id", "value", "k")) == 2)
    ranked = ranked.withColumn("j", F.when(~F.col("exact"), F.row_number().over(by("doc_id", "loose", "exact", "side").orderBy("pos"))))
    ranked = ranked.withColumn("near", ~F.col("exact") & (F.count("*").over(by("doc_id", "loose", "exact", "j")) == 2))
    class_of = lambda step, name, n: F.struct(step.alias("step"), name.alias("name"), n.alias("n"))
    alone = class_of(F.when(F.col("side") == 1, 3).otherwise(4), F.lit(""), F.col("place"))
    group = F.when(F.col("exact"), class_of(F.lit(1), F.col("value"), F.col("k"))).when(F.col("near"), class_of(F.lit(2), F.col("loose"), F.col("j"))).otherwise(alone)
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    pairs = ranked.groupBy("doc_id", group.alias("g")).agg(
        F.coalesce(side(0, "name"), F.lit("")).alias("document"), F.coalesce(side(1, "name"), F.lit("")).alias("catalogue"), F.coalesce(side(1, "pos"), side(0, "pos")).alias("pos")
    )
    verdict = F.when(F.col("g.step") == 1, "ok").when(F.col("g.step") == 2, "unknown").otherwise("fail")
    order = F.row_number().over(by("doc_id").orderBy("g.step", "pos"))
    return pairs.select("doc_id", "document", "catalogue", verdict.alias("verdict"), order.alias("ord"))


def bibliography(reference: DataFrame, author_reference: DataFrame, author: DataFrame, keys: tuple[str, ...] = ("paper_id", "conference_id")) -> DataFrame:
    """(keys, title, authors): the catalogue's papers by ``keys``; of rows that share a paper the last title counts.

    Papers without authors keep an empty list; null names drop out of it.
    """
    joined = reference.join(author_reference, reference.id == author_reference.reference_id, "left").join(author, author_reference.author_id == author.id, "left")
    rows = joined.select(*(reference[k] for k in keys), reference.id.alias("rid"), "title", author.id.alias("aid"), "name")
    names = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("rid", "aid", "name"))))
    return rows.groupBy(*keys).agg(F.max_by("title", "rid").alias("title"), F.transform(names, lambda x: x["name"]).alias("authors"))


def lookup(catalogue: DataFrame, paper_id: str, conference_id) -> DataFrame:
    """The one paper of a conference; both keys reach the scan where the catalogue is a table."""
    return catalogue.where((F.col("paper_id") == paper_id) & (F.col("conference_id") == conference_id))


def title_verdict(document: Column, catalogue: Column) -> Column:
    return F.when(same_title(document, catalogue), "ok").otherwise("fail")
