"""Measuring scores and flags against labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.ordered import bucketize, value_prefix
from oddrows.operators.ranks import quantiles


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn with precision, recall, f1, accuracy, specificity, per group if asked."""
    t, p = quoted(y).cast("int") == 1, quoted(prediction).cast("int") == 1
    aggs = [
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"),
    ]
    counts = df.groupBy(*[quoted(c) for c in by]).agg(*aggs)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumns({
        "f1": ratio(2 * pr * rc, pr + rc),
        "accuracy": (tp + tn) / F.greatest(F.lit(1), tp + fp + tn + fn),
        "specificity": ratio(tn, tn + fp),
    })


def ranking_metrics(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """(score_source, roc_auc, pr_auc), tie-aware and exact; 0 when only one class is present."""
    t = quoted(y).cast("int")
    totals = df.agg(F.count_if(t == 1).alias("p"), F.count_if(F.coalesce(t, F.lit(0)) != 1).alias("n")).first()
    p, n = float(totals["p"]), float(totals["n"])
    if p == 0 or n == 0:
        return df.sparkSession.createDataFrame([(s, 0.0, 0.0) for s in scores], "score_source string, roc_auc double, pr_auc double")
    prefix = value_prefix(
        df, {s: quoted(s) for s in scores},
        {"pos": F.when(t == 1, 1.0).otherwise(0.0), "neg": F.when(t == 1, 0.0).otherwise(1.0)}, rows=totals["p"] + totals["n"])
    above_pos, above_neg = F.lit(p) - F.col("pos__before"), F.lit(n) - F.col("neg__before")
    return prefix.groupBy(F.col("column").alias("score_source")).agg(
        (F.sum(F.col("pos") * (F.col("neg__before") + F.col("neg") / 2)) / F.lit(p * n)).alias("roc_auc"),
        F.sum(F.col("pos") / F.lit(p) * above_pos / (above_pos + above_neg)).alias("pr_auc"),
    )


def evaluation_report(df: DataFrame, y: str, prediction: str, score: str, *, provenance: str = "label") -> DataFrame:
    """One row: label counts, confusion counts, all metrics, where the labels came from."""
    c = confusion(df, y, prediction)
    r = ranking_metrics(df, y, [score]).select("roc_auc", "pr_auc")
    row = r.first()
    return c.select(
        F.lit(True).alias("available"),
        (F.col("tp") + F.col("fn")).alias("positive_label_count"),
        (F.col("tn") + F.col("fp")).alias("negative_label_count"),
        (F.col("tp") + F.col("fp")).alias("predicted_positive_count"),
        "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy", "specificity",
        F.lit(row["roc_auc"] if row else 0.0).alias("roc_auc"),
        F.lit(row["pr_auc"] if row else 0.0).alias("pr_auc"),
        F.lit(provenance).alias("label_provenance"),
    )


def f1_of(tp: float, fp: float, fn: float) -> tuple[float, float, float]:
    """(precision, recall, f1) with 0 for undefined values."""
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def percentile_counts(
    df: DataFrame, y: str, scores: Sequence[str], percentiles: Sequence[float], rows: int | None = None
) -> dict[str, list[dict]]:
    """Per source and percentile: threshold, tp, fp, fn of ``score > threshold``.

    All cuts come from one quantile pass. A row is counted once, in the bucket given by the
    number of cuts below its score; the few bucket totals are then added up from the top.
    """
    rows = df.count() if rows is None else rows
    cuts = quantiles(df, {s: quoted(s) for s in scores}, [p / 100.0 for p in percentiles], rows=rows)
    falling = {s: sorted({-c for c in cuts[s] if c is not None}) for s in scores}
    work = df.select(quoted(y).cast("int").alias("y"), *[(-quoted(s).cast("double")).alias(f"s{i}") for i, s in enumerate(scores)])
    # Bucket b holds scores with exactly b of the negated cuts at or below the negated score.
    work = bucketize(work, [f"s{i}" for i in range(len(scores))], [f"b{i}" for i in range(len(scores))], [falling[s] for s in scores])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").cast("int").alias("b")) for i in range(len(scores))])
    counted = work.select("y", F.explode(cells).alias("x")).groupBy("x.i", "x.b", "y").count().collect()
    tally: dict[int, dict[int, list[int]]] = {i: {} for i in range(len(scores))}
    for r in counted:
        cell = tally[r["i"]].setdefault(r["b"], [0, 0])
        cell[1 if r["y"] == 1 else 0] += r["count"]
    out: dict[str, list[dict]] = {}
    for i, s in enumerate(scores):
        positives = sum(c[1] for c in tally[i].values())
        out[s] = []
        for p, cut in zip(percentiles, cuts[s]):
            # score > cut  <=>  -score < -cut  <=>  bucket index at most the index of -cut
            limit = falling[s].index(-cut) if cut is not None else -1
            tp = sum(c[1] for b, c in tally[i].items() if b <= limit)
            fp = sum(c[0] for b, c in tally[i].items() if b <= limit)
            out[s].append({"percentile": float(p), "threshold": cut, "tp": tp, "fp": fp, "fn": positives - tp, "rows": rows})
    return out


def best_percentiles(
    df: DataFrame, y: str, scores: Sequence[str], percentiles: Sequence[float] = tuple(range(50, 100)), *,
    rows: int | None = None, start_f1: float = 0.0, digits: int | None = None,
) -> dict[str, dict]:
    """Per source the percentile with the best f1; the first of equals wins, 95 if none beats the start."""
    out = {}
    for s, entries in percentile_counts(df, y, scores, percentiles, rows).items():
        best = {"percentile": 95.0, "threshold": None, "precision": 0.0, "recall": 0.0, "f1": start_f1}
        for e in entries:
            precision, recall, f1 = f1_of(e["tp"], e["fp"], e["fn"])
            f1 = round(f1, digits) if digits is not None else f1
            if f1 > best["f1"]:
                best = {"percentile": e["percentile"], "threshold": e["threshold"], "precision": precision, "recall": recall, "f1": f1}
        best["f1"] = max(best["f1"], 0.0)
        out[s] = best
    return out


def percentile_metrics(df: DataFrame, y: str, score: str, percentile: float) -> dict:
    """Precision, recall and f1 at one percentile of the given rows."""
    e = percentile_counts(df, y, [score], [percentile])[score][0]
    precision, recall, f1 = f1_of(e["tp"], e["fp"], e["fn"])
    return {"percentile": float(percentile), "threshold": e["threshold"], "precision": precision, "recall": recall, "f1": f1}


def best_percentile_frame(df: DataFrame, y: str, scores: Sequence[str], percentiles: Sequence[float] = tuple(range(50, 100)), **kw) -> DataFrame:
    best = best_percentiles(df, y, scores, percentiles, **kw)
    rows = [(s, b["percentile"], b["threshold"], b["precision"], b["recall"], b["f1"]) for s, b in best.items()]
    schema = "score_source string, percentile double, threshold double, precision double, recall double, f1 double"
    return df.sparkSession.createDataFrame(rows, schema)


def is_number(x: float | None) -> bool:
    return x is not None and math.isfinite(x)
