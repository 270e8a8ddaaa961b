"""Keeping tables up to date: diffs, reuse, upserts, replay of logs, deduplication, sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def latest(log: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last record of each key; replaying a log so is idempotent."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(o).desc() if isinstance(o, str) else o for o in order)))
    return log.withColumn("_last", last).where(F.col("_last") == 1).drop("_last")


def first_by_key(rows: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key, in order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def duplicates(rows: DataFrame, key: Sequence[Column | str], order: Column | str) -> DataFrame:
    """Keys that occur more than once, with their count and first occurrence."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): new, changed, unchanged or removed, by comparing digests."""
    o = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(1).alias("_in_old"))
    n = new.select(F.col(key), F.col(digest).alias("_new"), F.lit(1).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, status.alias("status"))


def reconcile(registry: DataFrame, files: DataFrame, key: str, suffixes: Sequence[str] = (".md", ".markdown", ".txt", ".pdf", ".docx")) -> DataFrame:
    """(key, status): ok, missing (registered only), unregistered (on disk only) or unsupported."""
    r, f = registry.select(key, F.lit(1).alias("_r")), files.select(key, F.lit(1).alias("_f"))
    known = F.lower(F.regexp_extract(F.col(key), r"(\.[^./]+)$", 1)).isin(*suffixes)
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "unregistered").when(~known, "unsupported").otherwise("ok")
    return r.join(f, key, "full").select(key, status.alias("status"))


def reuse(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """New rows with the value of the old row of their key, and ``reused``; only the others need computing."""
    had = old.select(key, F.col(value).alias("_value"), F.lit(True).alias("_had"))
    return new.join(had, key, "left").withColumn(value, F.col("_value")).withColumn("reused", F.coalesce("_had", F.lit(False))).drop("_value", "_had")


def upsert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows keep their values and take only what they lack; unknown keys are added. ``added`` tells which."""
    columns = [c for c in existing.columns if c != key]
    e = existing.select(key, *(F.col(c).alias(f"_e_{c}") for c in columns), F.lit(1).alias("_had"))
    i = incoming.select(key, *(F.col(c).alias(f"_i_{c}") for c in columns))
    return e.join(i, key, "full").select(key, *(F.coalesce(f"_e_{c}", f"_i_{c}").alias(c) for c in columns), F.col("_had").isNull().alias("added"))


def update_by_key(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of the update of their key; keys that are not there are ignored."""
    changed = [c for c in updates.columns if c != key]
    u = updates.select(key, *(F.col(c).alias(f"_u_{c}") for c in changed))
    return rows.join(u, key, "left").select(*(F.coalesce(f"_u_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns))


def done_set(log: DataFrame, key: str, order: str, fingerprint: Column | None = None, truncated: str = "truncated") -> DataFrame:
    """(key, state) of the last record of each key under the wanted fingerprint: done or truncated."""
    wanted = log if fingerprint is None else log.where(fingerprint)
    return latest(wanted, [key], [order]).select(key, F.when(F.col(truncated), "truncated").otherwise("done").alias("state"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.where("state = 'done'").select(key), key, "left_anti")


def cap_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    return first_by_key(rows, group, order, most)


def systematic_sample(rows: DataFrame, group: str, unit: Sequence[str], seed: int, per_unit: int, per_group: int) -> DataFrame:
    """``per_unit`` rows of each (group, unit), then ``per_group`` of a group, in a seeded order of hashes."""
    order = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in (group, *unit)), F.col("ord").cast("string")))
    shuffled = rows.withColumn("_h", order)
    few = first_by_key(shuffled, [group, *unit], ["_h", "ord"], per_unit)
    return first_by_key(few, [group], ["_h", "ord"], per_group).drop("_h")


def prefix_within_budget(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """Rows of a group in order while their sizes add up to ``budget`` at most (stopping at the first that does not fit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    summed = rows.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    kept = summed.where((F.col("_sum") <= budget) & (F.lit(True) if most is None else F.col("_n") <= most))
    return kept.withColumn("total", F.col("_sum").cast("long")).drop("_sum", "_n")


def fit_within_budget(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], size: str, budget: int) -> DataFrame:
    """Rows of a group in order, each taken if it still fits in ``budget``; one that does not is passed over. ``total`` is what is taken so far.

    What fits depends on all that was taken before, so a group is read in one
    task, as a stream: nothing but the sum is held.  Give the rows as ids and sizes.
    """
    names = list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows
            kept, totals = [], []
            for i, (key, n) in enumerate(zip(keys, batch.column(size).to_pylist(), strict=True)):
                if key != now:
                    now, taken = key, 0
                if n is not None and taken + n <= budget:
                    taken += n
                    kept.append(i)
                    totals.append(taken)
            found = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(totals, pa.int64())], [*found.schema.names, "total"])

    dealt = rows.repartition(*names) if names else rows.coalesce(1)
    return dealt.sortWithinPartitions(*names, *order).mapInArrow(run, StructType([*rows.schema.fields, StructField("total", LongType())]))


def spread_sample(rows: DataFrame, key: Column | str, order: Sequence[str], most: int, parts: int = 4096) -> DataFrame:
    """``most`` rows at even steps, floor(i * n / most), of all ``n`` rows in the order of ``key`` (a hash in hexadecimal), then ``order``.

    Ranks are counts of the hash's leading bits before, added to the rank
    within them, so no task sorts more than its share.
    """
    bits = F.coalesce(F.expr("conv(substr(_k, 1, 6), 16, 10)").cast("long"), F.lit(0))
    keyed = rows.withColumn("_k", key if isinstance(key, Column) else F.col(key)).withColumn("_part", F.floor(bits * parts / (1 << 24)))
    counts = keyed.groupBy("_part").agg(F.count("*").alias("_in"))  # ``parts`` rows at most, so one task may add them up
    before = counts.select("_part", (F.sum("_in").over(Window.orderBy("_part")) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("_all"))
    ranked = keyed.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_k", *order)) - 1)
    step = f"((_rank * {most} + _all - 1) div _all)"  # the only one that can fall on the rank
    chosen = F.expr(f"_all <= {most} or ({step} < {most} and {step} * _all div {most} = _rank)")
    return ranked.where(chosen).select(*rows.columns)


def within_cap(k: Column, cap: int) -> Column:
    """How many results are asked for, from 1 to ``cap``; ``cap`` where nothing is asked."""
    return F.greatest(F.lit(1), F.least(F.coalesce(k, F.lit(cap)), F.lit(cap)))


def in_folder(path: Column, prefix: str, suffixes: Sequence[str]) -> Column:
    """Whether a path lies under ``prefix`` and has one of the suffixes, in any case."""
    low = F.lower(path)
    return path.startswith(prefix) & reduce(or_, (low.endswith(s) for s in suffixes), F.lit(False))


def with_chunk_ids(chunks: DataFrame, doc: str, text: str, ord_: str) -> DataFrame:
    """seq from 1 in a document, and an id from document and text; the n-th equal text of a document is told apart by n."""
    seq = F.row_number().over(Window.partitionBy(doc).orderBy(ord_))
    nth = F.row_number().over(Window.partitionBy(doc, F.md5(text)).orderBy(ord_))
    base = F.concat_ws("||", doc, text)
    digest = F.substring(F.md5(F.when(nth == 1, base).otherwise(F.concat_ws("||", base, F.concat(F.lit("#"), nth.cast("string"))))), 1, 12)
    return chunks.withColumn("seq", seq.cast("long")).withColumn("chunk_id", F.concat(F.lit("kb::"), F.col(doc), F.lit("::"), digest))


def fingerprint(text: Column, most: int = 1200, width: int = 200) -> Column:
    """MD5 of the first ``most`` word characters, and the length rounded (half to even) to widths: texts alike to both are copies."""
    words = F.regexp_replace(text, r"(?U)[^\w]+", "")
    return F.concat_ws("-", F.md5(F.substring(words, 1, most)), F.bround(F.length(text) / width).cast("long").cast("string"))
