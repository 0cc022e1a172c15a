"""Quality rules: base rules, then robust multivariate outliers. Built-in functions only.

Each text becomes a vector of transformed statistics. Per language and source the minimum covariance determinant
estimate of their centre and scatter is found by concentration steps: from a robust start, the half-and-a-bit of the
rows (``SUPPORT``) nearest by Mahalanobis distance give the next centre and scatter. A row farther from its group's
final estimate than the chi-square cut is rejected.

A group with fewer than ``MIN_GROUP`` rows uses its language's estimate, a language with fewer that of all rows. A
statistic that does not vary in a group has the floor ``FLOORS`` as its deviation, so the scatter always has an inverse.

Defined cases: a null text has no words; texts that fail the base rules are judged by them alone and are not in any
estimate; null language and source are groups of their own; rows that repeat get equal verdicts; an empty table
gives no row; extra columns are carried along, the operator's own replacing any of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrows.llm.common import lookup, materialize, text_of

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 200
SUPPORT = 0.75
STEPS = 3
#: Smallest deviation of each transformed statistic, in its own unit.
FLOORS = {"__x_length": 0.5, "__x_word": 0.25, "__x_symbols": 0.03, "__x_lines": 0.16, "__x_repeats": 0.16}
NAMES = list(FLOORS)
D = len(NAMES)
#: 0.999999 quantile of chi-square with 5 degrees of freedom; fixed value.
CUT = 35.888
#: Variance of a 5-variate normal within its central 75 %: P(chi2_7 <= q) / 0.75, q the 0.75 quantile of chi2_5; fixed value.
SHRINK = 0.7082


def statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of the whole text."""
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c not in own]
    text = docs.select(*kept, text_of(text_col).alias("__text"))
    split = text.select(
        *kept, "__text",
        F.filter(F.split("__text", SPACE + "+"), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda s: F.rlike(s, F.lit("[^\\x20\\x09-\\x0D]"))).alias("__lines"),
    )
    # Windows of three words as 64-bit hashes; only texts in which one repeats look at places.
    windows = split.withColumn("__n", F.size("__words")).withColumn(
        "__windows", F.when(F.col("__n") >= 4, F.transform(F.sequence(F.lit(0), F.col("__n") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    )
    repeats = windows.withColumn("__any", F.size(F.array_distinct("__windows")) < F.size("__windows"))
    ordered = repeats.withColumn("__sorted", F.when(F.col("__any"), F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, j: (x["h"] == F.get("__sorted", j + 1)["h"]) | ((j > 0) & (x["h"] == F.get("__sorted", F.greatest(j - 1, F.lit(0)))["h"]))
    placed = ordered.withColumn("__at", F.when(F.col("__any"), F.sort_array(F.transform(F.filter("__sorted", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"]))))
    # Each repeated window adds the words up to the next one, three at most.
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__at", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return placed.select(
        *kept,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__any"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """Statistics on scales where ordinary texts are near normal: logarithms of sizes, roots of shares."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "__x_length": F.log1p("n_words"), "__x_word": F.col("word_chars") / words, "__x_symbols": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "__x_lines": F.sqrt(F.col("n_dup_lines") / lines), "__x_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def _moments() -> list[Column]:
    mean = [F.avg(x).alias(f"m_{x}") for x in NAMES]
    cross = [F.covar_pop(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
    return [*mean, *cross]


def _whitened(estimates: DataFrame, scale: float) -> DataFrame:
    """``__group``, ``n``, the centre m_*, and w_*_*: the inverse of the scatter's Cholesky factor, written out for D statistics.

    One column a step, so no expression holds another twice.
    """
    out = estimates
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            s = F.col(f"s_{a}_{b}") / F.lit(scale)
            rest = lambda x: reduce(lambda y, k: y - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), x)  # noqa: B023, E731
            if i == j:
                # What the others leave of a statistic's variance keeps a share of its floor.
                value = F.sqrt(F.greatest(rest(F.greatest(s, F.lit(FLOORS[a] ** 2))), F.lit(FLOORS[a] ** 2 / 4)))
            else:
                value = rest(s) / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    for i in range(D):
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else -reduce(lambda x, y: x + y, [F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)])
            out = out.withColumn(f"w_{i}_{j}", value / F.col(f"l_{i}_{i}"))
    return out.select("__group", "n", *[f"m_{x}" for x in NAMES], *[f"w_{i}_{j}" for i in range(D) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance from a whitened estimate."""
    z = [reduce(lambda x, y: x + y, [F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{NAMES[j]}")) for j in range(i + 1)]) for i in range(D)]
    return reduce(lambda x, y: x + y, [F.pow(x, F.lit(2.0)) for x in z])


def _with_estimates(rows: DataFrame, estimates: DataFrame, total: int) -> DataFrame:
    return lookup(rows, estimates, ["__group"], "n", total, "inner")


def estimate(rows: DataFrame, total: int, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Whitened centre and scatter of each ``__group`` with its row count ``n``, by concentration steps."""
    centre = [F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in NAMES]
    quartiles = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), *centre, *[(F.percentile_approx(x, 0.75, 1000) - F.percentile_approx(x, 0.25, 1000)).alias(f"q_{x}") for x in NAMES])
    # Start: medians, and quartile distances as deviations (1.349 of them in a normal distribution).
    now = quartiles.select("__group", "n", *[f"m_{x}" for x in NAMES], *[(F.pow(F.col(f"q_{a}") / 1.349, 2) if a == b else F.lit(0.0)).alias(f"s_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[: i + 1]])
    scale = 1.0
    for _ in range(steps):
        now = materialize(_whitened(now, scale))
        far = _with_estimates(rows, now, total).select("__group", *NAMES, F.col("n").alias("__n"), _distance().alias("__d2"))
        # The cut is taken from counts of distance classes, 1/32 of a power of two wide: mergeable, and the same in any order.
        binned = far.withColumn("__bin", F.floor(32 * F.log2(F.col("__d2") + 1e-6)).cast("int"))
        classes = binned.groupBy("__group", "__bin").count()
        cuts = _cuts(classes, support)
        near = _with_estimates(binned.drop("__n"), cuts, total).where(F.col("__bin") <= F.col("__cut"))
        sizes = now.select("__group", "n")
        now = near.groupBy("__group").agg(*_moments()).join(sizes, "__group")
        scale = SHRINK
    return materialize(_whitened(now, scale))


def _cuts(classes: DataFrame, support: float) -> DataFrame:
    """The distance class up to which the nearest ``support`` share of each group lies."""
    w = Window.partitionBy("__group")
    run = classes.select("__group", "__bin", F.sum("count").over(w.orderBy("__bin")).alias("__below"), F.sum("count").over(w).alias("__all"))
    return run.where(F.col("__below") >= support * F.col("__all")).groupBy("__group").agg(F.min("__bin").alias("__cut"), F.max("__all").alias("n"))


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", cut: float = CUT, min_group: int = MIN_GROUP, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics, base_failed, distance2 (null where the base rules failed) and kept.

    ``carry``: the columns of ``docs`` to return (all of them by default); what is carried is written once.
    """
    need = [c for c in docs.columns if carry is None or c in carry or c in (lang_col, source_col)]
    rows = statistics(docs, text_col, need).withColumn("base_failed", base_failed())
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    lang, source = name(lang_col), name(source_col)
    rows = materialize(rows.withColumns({"__lang": F.concat(F.lit("lang "), lang), "__pair": F.concat(F.lit("pair "), lang, F.lit("\n"), source)} | transformed()))
    good = rows.where(~F.col("base_failed")).select("__lang", "__pair", *NAMES)
    total = good.count()
    levels = [good.select(c.alias("__group"), *NAMES) for c in (F.col("__pair"), F.col("__lang"), F.lit("all"))]
    every = reduce(DataFrame.unionByName, levels)
    found = estimate(every, 3 * total)
    sizes = found.where(F.col("n") >= min_group).select("__group", "n")
    # Which estimate each pair uses: its own, its language's, or that of all.
    pairs = good.groupBy("__pair", "__lang").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.select(F.col("__group").alias("__g"))
    use = (
        pairs.join(known.withColumnRenamed("__g", "__p"), F.col("__pair") == F.col("__p"), "left").join(known.withColumnRenamed("__g", "__l"), F.col("__lang") == F.col("__l"), "left")
        .select("__pair", F.col("n").alias("__rows"), F.coalesce("__p", "__l", F.lit("all")).alias("__group"))
    )
    values = found.drop("n")
    by_pair = use.join(values, "__group").drop("__group")
    with_values = lookup(rows, by_pair, ["__pair"], "__rows", total, wide=True)
    far = F.when(~F.col("base_failed"), _distance())
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = [c for c in docs.columns if (carry is None or c in carry) and c not in (*made, "distance2", "kept")] + made
    return with_values.select(*[F.col(f"`{c}`") for c in out], far.alias("distance2")).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut))
