"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Per source, document rates r in [0, 2] solve: minimise the entropy of r and 2 - r against the
prior r = 1 subject to sum(r * size) = target.  Its convex dual has one multiplier per source, and
the rates are an exponential tilt of the odds: r / (2 - r) = exp(multiplier * size / mean size).
Newton's iterations on the dual (kept inside a bracket) are distributed aggregates over the table
of (source, size, documents), which is exact because a rate depends on source and size alone.

Rounding: the copies of each size class follow the running total of rates, largest sizes first,
to within half a copy; a fold over the classes, largest first, then spends what words are still
missing or over.  The classes' copies go to documents by hash order, ranked in salted parts so
that no class, however large, meets in one task.  Equal inputs give equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import at_places, fresh_names, materialise, numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A word, as ASCII white space parts them.
WORD = r"[^\x20\x09-\x0D]++"


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): words of each whole text, 0 for null."""
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count.alias("size"))


def targets(classes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, rounds: int = 100) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    Sources in code-point order, null last, take the weights in turn; their places come from a
    range-partitioned sort and the counts of its partitions, so no task sees all sources.  The level
    (words for each unit of weight) at which all excess has been reshared is raised until no further
    source is full; it never falls, and each round is one aggregate.
    """
    by_source = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sort = [F.col("source").isNull(), F.col("source")]
    lined = by_source.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id())
    lined = materialise(lined, "mix-sources").withColumn("part", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row for each partition of that sort, as many as the session's shuffle partitions at most.
    parts = lined.groupBy("part").agg(F.count("*").alias("m"))
    skip = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = (F.col("row") + F.col("skip")) % len(weights) + 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), k.cast("int"))
    ranked = lined.join(parts.select("part", skip.alias("skip")), "part").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit"))
    ranked = materialise(ranked, "mix-weights")
    level, full = 0.0, F.col("limit") <= F.lit(0.0) * F.col("weight")
    for _ in range(rounds):
        words, held, heavy = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not heavy or (share * words - (held or 0)) / heavy <= level:
            break
        level = (share * words - (held or 0)) / heavy
        full = F.col("limit") <= F.lit(level) * F.col("weight")
    else:
        raise RuntimeError("the level did not settle")
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _rate(multiplier, most: int = MOST):
    z = F.col("size") / F.col("mean")
    return most / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * z))))


def balance(classes: DataFrame, goal: DataFrame, rounds: int = 100, tolerance: float = 1e-6, most: int = MOST) -> DataFrame:
    """(source, multiplier): Newton's iterations on every source's dual at once.

    The state is a table with a row per source; only the number of sources still moving reaches
    the driver.  A source at its limit of ``most`` copies, or without words, needs no iteration.
    A RuntimeError says that sources were still moving after ``rounds``.
    """
    means = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goal.join(means, goal.source.eqNullSafe(means.source)).select(
        goal.source, "target", "mean", F.lit(0.0).alias("multiplier"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"),
        (F.col("source_size") == 0).alias("done"), (F.col("target") >= most * F.col("source_size")).alias("full"),
    )
    state = state.withColumn("multiplier", F.when(F.col("full"), F.lit(1e4)).otherwise(F.col("multiplier"))).withColumn("done", F.col("done") | F.col("full")).drop("full")
    state = materialise(state, "mix-state")
    for _ in range(rounds):
        moving = state.where("not done").select(F.col("source").alias("s"), F.col("mean"), "multiplier")
        each = classes.where("size > 0").join(moving, F.col("source").eqNullSafe(F.col("s"))).withColumn("r", _rate(F.col("multiplier"), most))
        words = F.col("r") * F.col("size") * F.col("n")
        slope = words * (1 - F.col("r") / most) * F.col("size") / F.col("mean")
        sums = each.groupBy("s").agg(F.sum(words).alias("f"), F.sum(slope).alias("g"))
        step = state.join(sums, state.source.eqNullSafe(sums.s), "left").drop("s").withColumn("gap", F.col("f") - F.col("target"))
        step = step.withColumn("lo", F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("hi")))
        newton = F.col("multiplier") - F.col("gap") / F.when(F.col("g") > 0, F.col("g"))
        inside = F.coalesce((newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        settled = F.col("done") | (F.abs(F.col("gap")) <= tolerance * F.col("target")) | (F.col("hi") - F.col("lo") < 1e-12)
        step = step.withColumn("done", F.coalesce(settled, F.lit(True))).withColumn(
            "multiplier", F.when(F.col("done"), F.col("multiplier")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        state = materialise(step.select(*state.columns), "mix-state")
        if state.where("not done").isEmpty():
            break
    else:
        raise RuntimeError("the rates did not settle")
    return state.select("source", "target", "mean", "multiplier")


def class_copies(classes: DataFrame, state: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, rate, copies): whole copies for each class of documents."""
    s = state.select(F.col("source").alias("s"), "target", "mean", "multiplier")
    rated = classes.join(s, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rate", F.when((F.col("size") == 0) | (F.col("mean") == 0), F.lit(1.0)).otherwise(_rate(F.col("multiplier"), most)))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    upto, before = (F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, x)) for x in (0, -1))
    whole = F.greatest(F.lit(0).cast("long"), F.least(F.floor(upto + 0.5) - F.floor(F.coalesce(before, F.lit(0.0)) + 0.5), F.col("n") * most))
    least = F.min(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy("source"))
    counted = rated.select("source", "size", "n", "rate", "target", least.alias("least"), whole.alias("copies"))
    # What is missing (or over) is spent class by class, largest size first, on whole copies.
    rows = F.array_sort(
        F.collect_list(F.when(F.col("size") > 0, F.struct("size", "n", "copies", "least"))),
        lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).otherwise(0),
    )
    per = counted.groupBy("source").agg(rows.alias("rows"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("now"))
    start = F.struct(
        F.round(F.col("target") - F.col("now")).cast("long").alias("rest"),
        F.array().cast("array<struct<size:bigint,more:bigint>>").alias("moves"),
    )

    def spend(acc, row):
        rest, size = acc["rest"], row["size"]
        # The smallest documents, which come last, round to the nearer side.
        near = F.when(size == row["least"], F.lit(0.5)).otherwise(F.lit(0.0))
        add, cut = F.floor(rest / size + near), F.floor(-rest / size + near)
        units = F.when(rest > 0, F.least(add, most * row["n"] - row["copies"])).otherwise(-F.least(cut, row["copies"])).cast("long")
        moves = F.when(units != 0, F.concat(acc["moves"], F.array(F.struct(size.alias("size"), units.alias("more"))))).otherwise(acc["moves"])
        return F.struct((rest - units * size).alias("rest"), moves.alias("moves"))

    moves = per.select(F.col("source").alias("s"), F.explode(F.aggregate("rows", start, spend, lambda acc: acc["moves"])).alias("m")).select("s", F.col("m.size").alias("z"), "m.more")
    joined = counted.join(moves, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    return joined.select("source", "size", "n", "rate", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies (0..most) and taken = copies * size.

    Null texts have size 0 and are copied once; null is a source of its own; repeated rows are
    documents like any other.  Documents of one class that share an id are told apart by nothing,
    so which of them is copied more is left open; the sums aren't.  Other columns aren't read.
    """
    return _mixed(materialise(sizes(docs, id_col, source_col, text_col), "mix-sizes"), (), weights, share, most)


def _mixed(listed: DataFrame, ties: tuple[str, ...], weights, share: float, most: int) -> DataFrame:
    """``mix`` of a table (doc_id, source, size); ``ties`` names columns that order rows of one id, and stay."""
    classes = materialise(listed.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    goal = materialise(targets(classes, weights, share, most), "mix-targets")
    plan = materialise(class_copies(classes, balance(classes, goal, most=most), most), "mix-copies")
    g = goal.select(F.col("source").alias("gs"), "source_size", "target")
    plan = plan.join(g, F.col("source").eqNullSafe(F.col("gs"))).select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "rate", "copies", "source_size", "target")
    plan = materialise(plan, "mix-plan")
    # Salted ranks: the order is by hash; a part is a range of hashes, so ranks continue across parts.
    key = F.xxhash64("doc_id")
    dealt = listed.withColumn("h", key).withColumn("part", F.shiftrightunsigned("h", 64 - 8).cast("int"))
    parts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("part").alias("pp"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("skip"))
    within = Window.partitionBy("source", "size", "part").orderBy("h", "doc_id", *ties)
    ranked = dealt.withColumn("rank", F.row_number().over(within))
    ranked = ranked.join(parts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("part") == F.col("pp")))
    both = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    each = F.floor(F.col("copies") / F.col("n"))
    copies = (each + (F.col("skip") + F.col("rank") <= F.col("copies") - each * F.col("n")).cast("long")).alias("copies")
    out = both.select("doc_id", "source", "size", "source_size", "target", "rate", copies, *ties)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to ``most`` times), all columns kept, whatever they are called.

    Copies are counted on a table without texts and come back by the rows' places in the input, so
    rows that share an id, or have none, each get their own.
    """
    rows, file, at = numbered(docs)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    listed = rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(file).alias("tie_file"), F.col(at).alias("tie_at"))
    counted = _mixed(materialise(listed, "mix-sizes"), ("tie_file", "tie_at"), weights, share, most).where("copies > 0")
    (times,) = fresh_names(rows, "_times")
    chosen = materialise(counted.select(F.col("tie_file").alias(file), F.col("tie_at").alias(at), F.col("copies").cast("int").alias(times)), "mix-chosen")
    taken = at_places(rows, chosen, file, at, times, planes=int(most).bit_length())
    (copy,) = fresh_names(taken, "_copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(file, at, times, copy)
