"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

A document has five numbers, logarithms of plain statistics in fixed point.
Of the documents of a language and source (small groups are pooled) the
estimate looks for the ``COVERAGE`` share whose covariance has the least
determinant: from each of two starts (all documents; medians and median
deviations) it takes the documents nearest by Mahalanobis distance, estimates
anew from these, and so on ``STEPS`` times; the start that ends with the smaller
determinant wins.  The estimate is then made once more from all documents
within ``INNER``, and a document beyond ``CUTOFF`` is rejected.

The share is cut at a bin of the logarithm of the distance, so that no group is
sorted: a pass sums counts and moments by group and bin, map-side first.  The
sums are those of integers, exact in any order, so reruns agree.  A floor is
added to each variance: statistics that are 0 for nearly all documents would
else make every other value an outlier.  DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.staging import stage

SPACE, WORD_GAP = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rules that come first: least words, most words in repeated windows (in hundredths), words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Share of a group that the estimate is made from, passes from each start, and documents that a group needs to stand alone.
COVERAGE, STEPS, LEAST_GROUP = 0.75, 4, 50
#: Bins for each e-fold of the squared distance.
BINS = 16
#: The statistics in fixed point, the names of the numbers and what is added to their standard deviations (squared).
UNIT, D = 1024, 5
FLOORS = (0.25, 0.15, 0.35, 0.35, 0.5)
#: Chi-square with 5 degrees of freedom: quantiles at 0.975 and 0.999999, and what makes covariances of the nearest 0.75 and 0.975 those of a normal distribution: share / P(chi-square with 7 degrees <= quantile at share).
INNER, CUTOFF = 12.8325, 35.8882
CONSISTENT_RAW, CONSISTENT = 1.4121, 1.0555

PAIRS = [(i, j) for i in range(1, D + 1) for j in range(1, i + 1)]


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a run of ``window`` words that the array has twice or more; such runs are told apart by 64-bit hashes.

    Hashes are sorted with their places; those beside an equal one are repeated,
    and each covers the words up to the next repeated one.
    """
    whole = F.size(words) >= window
    hashes = F.when(whole, F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window)))))

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        beside = lambda p, s, k: F.get(p, k)["h"].eqNullSafe(s["h"])
        again = _let(placed, lambda p: F.filter(p, lambda s, k: beside(p, s, k - 1) | beside(p, s, k + 1)))
        at = F.array_sort(F.transform(again, lambda s: s["i"]))
        steps = _let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    return F.coalesce(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h))), F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), text.alias("t"))
    plain = rows.withColumn("plain", F.trim("t", F.lit(SPACE)))
    split = plain.withColumn("w", F.when(F.col("plain") != "", F.split("plain", WORD_GAP)).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    counted = split.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("joined"), lines.alias("lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    counted = counted.select(
        "doc_id", "lang", "source", "n_words", F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


#: The numbers, in both Spark's and DuckDB's SQL; they are taken of documents that pass the rules, so no divisor is 0.
NUMBERS = {
    f"x{k}": f"CAST(floor({UNIT} * ({x}) + 0.5) AS BIGINT)"
    for k, x in enumerate(
        (
            "ln(CAST(n_words AS DOUBLE))",
            "ln(CAST(word_chars AS DOUBLE) / CAST(n_words AS DOUBLE))",
            "ln(1.0e0 + 100 * CAST(n_symbols AS DOUBLE) / CAST(word_chars AS DOUBLE))",
            "ln(1.0e0 + 10 * CAST(n_repeat_words AS DOUBLE) / CAST(n_words AS DOUBLE))",
            "ln(1.0e0 + CAST(n_dup_lines AS DOUBLE))",
        ),
        1,
    )
}
MOMENTS = {"n": "count(*)"} | {f"s{i}": f"sum(x{i})" for i in range(1, D + 1)} | {f"s{i}{j}": f"sum(x{i} * x{j})" for i, j in PAIRS}
#: The key of a language and source, and a group's key at each size of pool.
KEY = "concat(coalesce(hex(lang), '-'), ':', coalesce(hex(source), '-'))"


def _levels(scale: float) -> list[dict[str, str]]:
    """Means, then the triangular root of the covariance (Cholesky), in steps that read the ones before."""
    out = [{f"m{i}": f"CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE)" for i in range(1, D + 1)}]
    out.append({f"c{i}{j}": f"{scale!r}e0 * (CAST(s{i}{j} AS DOUBLE) / CAST(n AS DOUBLE) - m{i} * m{j}) / {UNIT * UNIT}.0e0" + (f" + {FLOORS[i - 1] ** 2!r}e0" if i == j else "") for i, j in PAIRS})
    for j in range(1, D + 1):
        known = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        out.append({f"l{j}{j}": f"sqrt(greatest(c{j}{j}{known}, 1.0e-9))"})
        below = {f"l{i}{j}": f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j}" for i in range(j + 1, D + 1)}
        if below:
            out.append(below)
    return out


ESTIMATE = [f"m{i}" for i in range(1, D + 1)] + [f"l{i}{j}" for i, j in PAIRS]
DETERMINANT = " * ".join(f"l{j}{j}" for j in range(1, D + 1))
#: The squared distance of a row from an estimate, in steps.
DISTANCE = [{f"y{i}": f"((CAST(x{i} AS DOUBLE) - m{i}) / {UNIT}.0e0" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i}"} for i in range(1, D + 1)]
DISTANCE.append({"d2": " + ".join(f"y{i} * y{i}" for i in range(1, D + 1))})
BIN = f"CAST(floor({BINS} * ln(d2 + 1.0e-6)) AS INTEGER)"


def _with(df: DataFrame, levels: list[dict[str, str]]) -> DataFrame:
    for level in levels:
        df = df.withColumns({name: F.expr(sql) for name, sql in level.items()})
    return df


def _moments(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*(F.expr(sql).alias(name) for name, sql in MOMENTS.items()))


def _estimates(moments: DataFrame, scale: float, *by: str) -> DataFrame:
    return _with(moments, _levels(scale)).select(*by, *ESTIMATE)


def _groups(rows: DataFrame) -> DataFrame:
    """(k, g, size): the group of each language and source; those of few documents share one of their language, and the rest one of all."""
    counts = rows.groupBy("k", "lang").agg(F.count("*").alias("n"))
    pools = counts.where(F.col("n") < LEAST_GROUP).groupBy("lang").agg(F.sum("n").alias("pool"))
    lang = F.coalesce(F.hex("lang"), F.lit("-"))
    named = counts.join(pools.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "k", "n", F.when(F.col("n") >= LEAST_GROUP, F.concat(F.lit("1:"), "k")).when(F.col("pool") >= LEAST_GROUP, F.concat(F.lit("2:"), lang)).otherwise("3:").alias("g")
    )
    return named.join(named.groupBy("g").agg(F.sum("n").alias("size")), "g").select("k", "g", "size")


def _medians(values: DataFrame) -> DataFrame:
    """(g, j, v) to (g, j, median): the lower median of integers, from counts of equal ones. A window holds the values a number can have (below 20,000 for texts of a million words), however many rows there are."""
    counts = values.groupBy("g", "j", "v").agg(F.count("*").alias("c"))
    upto, whole = Window.partitionBy("g", "j").orderBy("v"), Window.partitionBy("g", "j")
    placed = counts.select("g", "j", "v", F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("all"))
    return placed.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "j").agg(F.min("v").alias("median"))


def _by_column(medians: DataFrame, prefix: str) -> DataFrame:
    return medians.groupBy("g").agg(*(F.max(F.when(F.col("j") == j, F.col("median"))).alias(f"{prefix}{j}") for j in range(1, D + 1)))


def fit_outliers(rows: DataFrame) -> DataFrame:
    """(g, means, triangular root): the final estimate of each group of (g, size, x1 to x5)."""
    # first start: all rows; second: medians and median deviations, without correlation
    every = _estimates(_moments(rows, "g"), 1.0, "g").withColumn("start", F.lit(0))
    unpivot = lambda columns: F.explode(F.array(*(F.struct(F.lit(j).alias("j"), c.alias("v")) for j, c in enumerate(columns, 1))))
    middle = stage(_by_column(_medians(rows.select("g", unpivot([F.col(f"x{j}") for j in range(1, D + 1)]).alias("e")).select("g", "e.*")), "a"), "medians")
    away = [F.abs(F.col(f"x{j}") - F.col(f"a{j}")) for j in range(1, D + 1)]
    spread = _by_column(_medians(rows.join(middle, "g").select("g", unpivot(away).alias("e")).select("g", "e.*")), "b")
    root = {f"l{i}{j}": F.expr(f"sqrt(pow(1.4826e0 * b{i} / {UNIT}.0e0, 2) + {FLOORS[i - 1] ** 2!r}e0)") if i == j else F.lit(0.0) for i, j in PAIRS}
    robust = middle.join(spread, "g").withColumns({f"m{j}": F.col(f"a{j}").cast("double") for j in range(1, D + 1)} | root).select("g", *ESTIMATE, F.lit(1).alias("start"))
    starts = stage(every.unionByName(robust), "starts")
    for _ in range(STEPS):
        near = _with(rows.join(starts, "g"), DISTANCE).withColumn("bin", F.expr(BIN))
        binned = _moments(near, "g", "start", "size", "bin")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = binned.withColumn("before", before).where(F.col("before") < F.ceil(F.lit(COVERAGE) * F.col("size")))
        sums = kept.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in MOMENTS))
        starts = stage(_estimates(sums, 1.0, "g", "start"), "starts")
    best = starts.withColumn("det", F.expr(DETERMINANT)).groupBy("g").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    # the chosen root grows with the square root of what makes its covariance consistent, so distances shrink by it
    chosen = starts.join(best, ["g", "start"]).drop("start")
    inner = _with(rows.join(chosen, "g"), DISTANCE).where(F.col("d2") <= INNER * CONSISTENT_RAW)
    return stage(_estimates(_moments(inner, "g"), CONSISTENT, "g"), "estimates")


def reject_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row.

    ``base_failed``: fewer than ten words, or over a fifth of them in repeated
    windows of five.  The others are kept unless their squared Mahalanobis
    distance from their group exceeds ``CUTOFF``; ``distance`` is null for those
    that fail, which the estimates do not see either.  Null texts have no words.
    A null language or source is a value like others.  Repeated rows and null
    ids count as rows; a group of one document is at distance 0; an empty table
    gives an empty one; other columns are not read.
    """
    stats = stage(text_statistics(docs, id_col, text_col, lang_col, source_col).withColumn("k", F.expr(KEY)), "statistics")
    passed = stats.where(~F.col("base_failed"))
    groups = stage(_groups(passed), "groups")
    rows = _with(passed.join(groups, "k"), [NUMBERS])
    rows = stage(rows.select("g", "size", *NUMBERS), "numbers")
    fit = groups.join(fit_outliers(rows), "g").drop("g", "size")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _with(passed.join(fit, "k"), [NUMBERS, *DISTANCE])
    kept = judged.select(*base, (F.col("d2") <= CUTOFF).alias("kept"), F.col("d2").alias("distance"))
    return kept.unionByName(stats.where("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


def oracle() -> str:
    """The same in DuckDB's SQL; windows are compared word by word."""
    nested = lambda source, levels: source if not levels else nested("(SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in levels[0].items()) + f" FROM {source})", levels[1:])
    moments = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in MOMENTS.items())
    again = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in MOMENTS)
    numbers, estimate = ", ".join(NUMBERS), ", ".join(ESTIMATE)
    stacked = lambda source, cells: " UNION ALL ".join(f"SELECT g, {j} AS j, {c} AS v FROM {source}" for j, c in enumerate(cells, 1))

    def medians(values: str, prefix: str) -> str:
        columns = ", ".join(f"max(v) FILTER (j = {j}) AS {prefix}{j}" for j in range(1, D + 1))
        return f"""SELECT g, {columns} FROM (
    SELECT g, j, v FROM ({values}) QUALIFY row_number() OVER (PARTITION BY g, j ORDER BY v) = (count(*) OVER (PARTITION BY g, j) + 1) // 2) GROUP BY g"""

    root = ", ".join(f"sqrt(pow(1.4826e0 * b{i} / {UNIT}.0e0, 2) + {FLOORS[i - 1] ** 2!r}e0) AS l{i}{j}" if i == j else f"0.0e0 AS l{i}{j}" for i, j in PAIRS)
    middle = ", ".join(f"CAST(a{i} AS DOUBLE) AS m{i}" for i in range(1, D + 1))
    sql = f"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS run FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
repeated AS (SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM repeated, (SELECT unnest(range(0, {WINDOW})) AS o) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
counted AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words JOIN lines USING (r) LEFT JOIN covered USING (r)),
stats AS MATERIALIZED (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {KEY} AS k FROM counted),
counts AS (SELECT k, lang, count(*) AS n FROM stats WHERE NOT base_failed GROUP BY k, lang),
pools AS (SELECT lang, sum(n) AS pool FROM counts WHERE n < {LEAST_GROUP} GROUP BY lang),
named AS (
  SELECT k, n, CASE WHEN n >= {LEAST_GROUP} THEN concat('1:', k) WHEN pool >= {LEAST_GROUP} THEN concat('2:', coalesce(hex(counts.lang), '-')) ELSE '3:' END AS g
  FROM counts LEFT JOIN pools ON counts.lang IS NOT DISTINCT FROM pools.lang),
groups AS MATERIALIZED (SELECT k, g, sum(n) OVER (PARTITION BY g) AS size FROM named),
rows AS MATERIALIZED (SELECT g, size, {", ".join(f"{sql} AS {name}" for name, sql in NUMBERS.items())} FROM stats JOIN groups USING (k) WHERE NOT base_failed),
middle AS MATERIALIZED ({medians(stacked("rows", NUMBERS), "a")}),
spread AS MATERIALIZED ({medians(stacked("rows JOIN middle USING (g)", [f"abs(x{j} - a{j})" for j in range(1, D + 1)]), "b")}),
e0 AS MATERIALIZED (
  SELECT g, 0 AS start, {estimate} FROM {nested(f"(SELECT g, {moments} FROM rows GROUP BY g)", _levels(1.0))}
  UNION ALL SELECT g, 1 AS start, {middle}, {root} FROM middle JOIN spread USING (g))"""
    for step in range(1, STEPS + 1):
        near = nested(f"(SELECT * FROM rows JOIN e{step - 1} USING (g))", DISTANCE)
        sql += f""",
b{step} AS MATERIALIZED (SELECT g, start, size, {BIN} AS bin, {moments} FROM {near} GROUP BY g, start, size, {BIN}),
e{step} AS MATERIALIZED (
  SELECT g, start, {estimate} FROM {nested(f"""(SELECT g, start, {again} FROM (
    SELECT * FROM b{step} QUALIFY coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil({COVERAGE} * size)) GROUP BY g, start)""", _levels(1.0))})"""
    inner = nested("(SELECT * FROM rows JOIN chosen USING (g))", DISTANCE)
    return sql + f""",
chosen AS MATERIALIZED (SELECT * FROM e{STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY {DETERMINANT}, start) = 1),
fit AS MATERIALIZED (SELECT g, {estimate} FROM {nested(f"(SELECT g, {moments} FROM {inner} WHERE d2 <= {INNER * CONSISTENT_RAW!r}e0 GROUP BY g)", _levels(CONSISTENT))}),
judged AS (SELECT r, d2 FROM {nested("(SELECT * FROM " + nested("(SELECT * FROM stats JOIN groups USING (k) WHERE NOT base_failed)", [NUMBERS]) + " JOIN fit USING (g))", DISTANCE)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {CUTOFF}e0, FALSE) AS kept
FROM stats LEFT JOIN judged USING (r)
"""
