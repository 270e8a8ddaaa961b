"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, in code-point order with null last, weigh 1, 2, 3, 1, ...
and share the size of all documents; a target stops at ``max_epochs`` times its
source's size and the excess goes to the others by weight.

A source is first taken whole as often as its target allows.  What is left is
drawn without replacement: each document gets the key ``-ln(u) / quality``, u
being uniform from a hash of its id and text, and the documents of a source are
taken by ascending key until their sizes, summed, reach the budget; the one
that reaches it is taken in part.

The sum over a source is made in steps, so that no task holds a source: sizes
are summed by bins of the key, the sums of the bins are accumulated, the bin in
which the budget ends is cut into finer bins in the same way, and only the one
of those in which it ends is sorted.  Bins are even in the logarithm of the
key, so they fit any scale of weights.  DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.staging import stage

#: Cycle of source weights.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MAX_EPOCHS = 3
#: Bins for each doubling of the key, and finer bins in each. Any numbers give the same result; they bound what one window holds.
BINS, FINER = 256, 4096
#: Characters that prose has few of; their share of the words lowers a document's quality weight.
SYMBOLS = "#*$%&|<>{}[]=_~^\\"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for prose, lower the more of ``SYMBOLS`` there are to a word."""
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(marks, F.lit(0)).cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def source_targets(totals: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to those and target; one row for each source, which is a small table.

    The targets are ``min(level * weight, max_epochs * size)``, with the level
    at which they add up to the whole.  Sources reach their limit in the order
    of limit / weight, so the level is that of the first source, in that order,
    which does not reach it.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(in_order) - 1
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long"))
    limited = weighted.withColumn("most", F.col("source_size") * max_epochs)
    limit = F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("last"), "source")
    by_limit = Window.orderBy(limit)
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levels = limited.withColumn("level", left.cast("double") / F.sum("weight").over(rest).cast("double"))
    below = F.col("level") * F.col("weight") < F.col("most")
    first = levels.withColumn("level", F.coalesce(F.min_by("level", F.when(below, limit)).over(whole), F.lit(float("inf"))))
    return first.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def _edge(sums: DataFrame, budgets: DataFrame, level: str) -> DataFrame:
    """(of, edge_<level>, edge_<level>_before): the bin of each source in which its budget ends, and what the bins before it hold."""
    so_far = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("before", F.coalesce(F.sum("held").over(so_far), F.lit(0))).alias("s")
    ends = s.join(budgets.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).where("before < budget and before + held >= budget")
    first = ends.groupBy(F.col("s.source").alias("of")).agg(F.min(F.struct(level, "before")).alias("edge"))
    return first.select("of", F.col(f"edge.{level}").alias(f"edge_{level}"), F.col("edge.before").alias(f"edge_{level}_before"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken (words the mix takes, repeats counted) and epochs.

    Size is the number of runs outside ``[\\x20\\x09-\\x0D]`` in the text (null: 0).
    ``taken`` is the size times the source's complete epochs, plus the size
    once more if the document is drawn, or the part of it that meets the
    source's budget to the word.  No document passes ``max_epochs`` times its
    size.  ``weight`` is a column of quality weights above 0; without one
    ``quality_weight`` of the text is used, and documents of null, NaN or
    non-positive weights come last, in the order of -ln(u).  Documents of equal key are taken in the order of id and size;
    rows alike in id and text share a key, and which of them is taken in part
    is not told apart.  A null source is a source of its own.  Reruns agree.
    Other columns are ignored; an empty table gives an empty table.
    """
    text, size = F.col(text_col).cast("string"), F.col("size")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        text.alias("text"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        *([] if weight is None else [weight.cast("double").alias("weight")]),
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = quality_weight(F.col("text"), size) if weight is None else F.col("weight")
    weighed = F.coalesce((weight > 0) & ~F.isnan(weight), F.lit(False))
    key = -F.log(uniform) / F.when(weighed, weight).otherwise(1.0)
    # Bins ascend with the key; those of the unweighed come after all others (a double has 2,098 doublings).
    step = F.floor(F.log2(F.greatest(F.col("key"), F.lit(5e-324))) * BINS * FINER) + F.when(F.col("last"), F.lit((1 << 14) * BINS * FINER).cast("long")).otherwise(F.lit(0).cast("long"))
    keyed = sized.select("doc_id", "source", "size", key.alias("key"), (~weighed).alias("last")).withColumn("step", step.cast("long"))
    keyed = stage(keyed.withColumn("bin", F.floor(F.col("step") / FINER).cast("int")).withColumn("fine", F.pmod("step", F.lit(FINER)).cast("int")).drop("step"), "mix")

    bins = stage(keyed.groupBy("source", "bin").agg(F.sum("size").alias("held")), "bins")
    totals = bins.groupBy("source").agg(F.sum("held").alias("source_size"))
    targets = stage(source_targets(totals, max_epochs), "targets")
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = targets.withColumn("epochs", epochs).withColumn("budget", budget - F.col("epochs") * F.col("source_size"))

    bin_edge = _edge(bins, planned.select("source", "budget"), "bin")
    plan = planned.join(bin_edge, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    plan = stage(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "budget", "edge_bin", "edge_bin_before"), "plan")  # a row for each source

    at_edge = keyed.join(plan, keyed.source.eqNullSafe(plan.plan_source) & (keyed.bin == plan.edge_bin))
    fines = at_edge.groupBy("source", "fine").agg(F.sum("size").alias("held"))
    fine_edge = _edge(fines, plan.select(F.col("plan_source").alias("source"), (F.col("budget") - F.col("edge_bin_before")).alias("budget")), "fine")
    plan = stage(plan.join(fine_edge, F.col("plan_source").eqNullSafe(F.col("of")), "left").drop("of"), "plan")

    joined = keyed.join(plan, keyed.source.eqNullSafe(plan.plan_source)).drop("plan_source")
    out = lambda extra: ("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "epochs")
    # Without an edge nothing is drawn: the bin is null.
    before = F.coalesce((F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("fine") < F.col("edge_fine"))), F.lit(False))
    ends_here = F.coalesce((F.col("bin") == F.col("edge_bin")) & (F.col("fine") == F.col("edge_fine")), F.lit(False))
    settled = joined.where(~ends_here).select(*out(F.when(before, F.col("size")).otherwise(0)))
    within = Window.partitionBy("source").orderBy("last", "key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("edge_bin_before") - F.col("edge_fine_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    sorted_ = joined.where(ends_here).withColumn("left", left)
    return settled.unionByName(sorted_.select(*out(F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))))))
