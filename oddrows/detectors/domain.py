"""Rule-based detectors on the raw columns: flat-line, sudden change, freeze."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import finite, quoted
from oddrows.operators.ordered import drop_halo, ordering, with_halo
from oddrows.operators.ranks import quantiles, quantiles_with
from oddrows.session import keep

TINY = 1e-8
FREEZE_WINDOW = 4


def _mean(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))


def _medians(df: DataFrame, cols: Sequence[str], rows: int) -> dict[str, float]:
    found = quantiles(df, {c: finite(c) for c in cols}, [0.5], rows=rows)
    return {c: q[0] if q[0] is not None else 0.0 for c, q in found.items()}


def _filled(medians: dict[str, float]) -> dict[str, Column]:
    """Infinities and nulls replaced by the column's median."""
    return {c: F.coalesce(finite(c), F.lit(m)) for c, m in medians.items()}


def _robust_scale(df: DataFrame, exprs: dict[str, Column], medians: dict[str, float], rows: int) -> dict[str, float]:
    """1.4826 MAD, else population deviation, else 1 per column, from one aggregate."""
    names = list(exprs)
    gaps = {c: F.abs(exprs[c] - F.lit(medians[c])) for c in names}
    mad, std = quantiles_with(df, gaps, [0.5], {f"s{i}": F.stddev_pop(exprs[c]) for i, c in enumerate(names)}, rows=rows)
    out = {}
    for i, c in enumerate(names):
        m, s = mad[c][0], std[f"s{i}"]
        out[c] = 1.4826 * m if m > TINY else (s if s > TINY else 1.0)
    return out


def repeat_counts(df: DataFrame, exprs: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Add for each column how often its value, rounded to 10 places, occurs.

    Only values that occur at least twice are joined back: for measured data that list is
    short and adaptive execution broadcasts it; for a hot value it is a single row.
    """
    out, counts = df, {}
    for i, (c, e) in enumerate(exprs.items()):
        shared = (
            df.groupBy(F.round(e, 10).alias(f"__v{i}")).agg(F.count(F.lit(1)).alias(f"__n{i}")).filter(F.col(f"__n{i}") > 1)
        )
        out = out.withColumn(f"__v{i}", F.round(e, 10)).join(shared, f"__v{i}", "left").drop(f"__v{i}")
        counts[c] = F.coalesce(F.col(f"__n{i}"), F.lit(1))
    return out, counts


def with_flatline(df: DataFrame, cols: Sequence[str], rows: int, name: str = "flatline", medians: dict[str, float] | None = None) -> DataFrame:
    """Rows that sit implausibly close to every column's centre, or repeat a value."""
    if not cols or rows == 0:
        return df.withColumn(name, F.lit(0.0))
    medians = medians or _medians(df, cols, rows)
    x = _filled(medians)  # filling with the median leaves the median where it is
    scale = _robust_scale(df, x, medians, rows)
    z = {c: F.abs((x[c] - F.lit(medians[c])) / F.lit(scale[c])) for c in cols}
    out, counts = repeat_counts(df, x)
    central = _mean([F.exp(F.lit(-6.0) * z[c]) for c in cols])
    near = _mean([(z[c] <= 0.08).cast("double") for c in cols])
    repeated = _mean([(counts[c] - 1) / F.lit(float(max(rows - 1, 1))) for c in cols])
    out = out.withColumn(name, F.lit(0.65) * central + F.lit(0.25) * near + F.lit(0.10) * repeated)
    return out.drop(*[f"__n{i}" for i in range(len(cols))])


def with_ordered_scores(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], key: Sequence[str], rows: int, *,
    temporal: str | None = "temporal_change", freeze: str | None = "freeze", window: int = FREEZE_WINDOW,
    medians: dict[str, float] | None = None,
) -> DataFrame:
    """Sudden-change and freeze scores from one bucketed window pass over the order."""
    wanted = [n for n in (temporal, freeze) if n]
    if not cols or rows < 3:
        return df.withColumns({n: F.lit(0.0) for n in wanted})
    x = _filled(medians or _medians(df, cols, rows))
    own = list(df.columns)
    work = df.withColumns({f"__x{i}": x[c] for i, c in enumerate(cols)})
    o = with_halo(ordering(work, order_by, key, rows=rows), window if freeze else 1, 1 if temporal else 0)
    ids = range(len(cols))
    prev = {f"__d{i}": F.abs(F.col(f"__x{i}") - F.lag(f"__x{i}").over(o.window)) for i in ids}
    seen = o.df.withColumns(prev)
    if temporal:
        following = {i: F.abs(F.lead(f"__x{i}").over(o.window) - F.col(f"__x{i}")) for i in ids}
        seen = seen.withColumns({
            f"__c{i}": F.greatest(F.coalesce(F.col(f"__d{i}"), F.lit(0.0)), F.coalesce(following[i], F.lit(0.0))) for i in ids
        })
    seen = keep(seen)
    rows_only = seen.filter(~F.col("__halo"))
    out = seen
    # One aggregate gives the typical steps, changes and spreads of all columns.
    wanted_medians = {f"c{i}": F.col(f"__c{i}") for i in ids} if temporal else {}
    wanted_medians |= {f"d{i}": F.col(f"__d{i}") for i in ids} if freeze else {}
    typical, spread = quantiles_with(rows_only, wanted_medians, [0.5], {f"s{i}": F.stddev_pop(f"__x{i}") for i in ids}, rows=rows)
    if temporal:
        scale = _robust_scale(rows_only, {f"c{i}": F.col(f"__c{i}") for i in ids}, {f"c{i}": typical[f"c{i}"][0] for i in ids}, rows)
        out = out.withColumn(temporal, _mean([F.col(f"__c{i}") / F.lit(scale[f"c{i}"]) for i in ids]))
    if freeze:
        eps = {
            i: max(typical[f"d{i}"][0] * 0.05 if typical[f"d{i}"][0] > TINY else spread[f"s{i}"] * 0.01, TINY) for i in ids
        }
        out = out.withColumns({
            f"__f{i}": F.coalesce(F.col(f"__d{i}") <= F.lit(eps[i]), F.lit(False)).cast("double") for i in ids
        })
        frame = o.window.rowsBetween(-(window - 1), 0)
        out = out.withColumns({f"__r{i}": F.avg(f"__f{i}").over(frame) for i in ids})

        def run(i: int) -> Column:
            """Run of equal values ending here, counted up to the window (more is clipped anyway)."""
            total = F.lit(0.0)
            for step in range(window - 1, -1, -1):
                flag = F.coalesce(F.lag(f"__f{i}", step).over(o.window), F.lit(0.0)) if step else F.col(f"__f{i}")
                total = flag * (F.lit(1.0) + total)
            return total

        out = out.withColumns({f"__s{i}": run(i) for i in ids})
        longest = F.greatest(*[F.col(f"__s{i}") for i in ids]) if len(cols) > 1 else F.col("__s0")
        strength = F.least(longest / F.lit(float(max(window, 1))), F.lit(1.0))
        steady = _mean([(F.col(f"__r{i}") >= 0.75).cast("double") for i in ids])
        rolling = _mean([F.col(f"__r{i}") for i in ids])
        out = out.withColumn(freeze, F.lit(0.45) * rolling + F.lit(0.35) * strength + F.lit(0.20) * steady)
    return drop_halo(out).select(*[quoted(c) for c in own], *wanted)


def flatline(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return with_flatline(df, cols, df.count())


def temporal_change(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], key: Sequence[str]) -> DataFrame:
    return with_ordered_scores(df, cols, order_by, key, df.count(), freeze=None)


def freeze(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], key: Sequence[str], window: int = FREEZE_WINDOW) -> DataFrame:
    return with_ordered_scores(df, cols, order_by, key, df.count(), temporal=None, window=window)


def domain_scores(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """All three domain scores beside the table's own columns."""
    rows = df.count()
    medians = _medians(df, cols, rows) if cols else {}
    flat = with_flatline(df, cols, rows, medians=medians)
    return with_ordered_scores(flat, cols, order_by, key, rows, medians=medians)
