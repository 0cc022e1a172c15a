"""Neighbour-based detectors on the exact k-nearest-neighbour edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.functions.schema import quoted
from oddrows.operators.knn import distinct_points, neighbour_edges
from oddrows.session import keep


def default_neighbours(rows: int) -> int:
    return min(100, max(5, math.isqrt(rows)))


class NeighbourGraph:
    """Edges between distinct vectors at the largest k asked for; smaller k reuse them."""

    def __init__(self, df: DataFrame, key: str, features: Sequence[str], k: int, rows: int | None = None, **tuning):
        self.df, self.key, self.features = df, key, list(features)
        self.rows = df.count() if rows is None else rows
        self.k = max(1, min(k, self.rows - 1))
        self.points = keep(distinct_points(df, key, features))
        self.edges = keep(neighbour_edges(self.points, self.k, len(self.features), **tuning))

    def weighted(self, k: int) -> DataFrame:
        """(gid, nbr, distance, take): ``take`` of the neighbour's rows are among the k nearest.

        A point's own copies come first, at distance 0.
        """
        k = max(1, min(k, self.rows - 1))
        w = self.points.select("gid", "w")
        own = w.filter(F.col("w") > 1).select("gid", F.col("gid").alias("nbr"), F.lit(0.0).alias("distance"), (F.col("w") - 1).alias("w"), F.lit(0).alias("rank"))
        other = self.edges.filter(F.col("rank") <= k).join(w.select(F.col("gid").alias("nbr"), "w"), "nbr")
        every = other.select("gid", "nbr", "distance", "w", "rank").unionByName(own)
        before = F.sum("w").over(Window.partitionBy("gid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        take = F.least(F.col("w"), F.lit(k) - F.coalesce(before, F.lit(0)))
        return every.withColumn("take", take).filter(F.col("take") > 0).select("gid", "nbr", "distance", "take")

    def lof_deviation(self, ks: Sequence[int]) -> list[float]:
        """Deviation of the local outlier factors of all rows for each k, all of them in the same joins."""
        ks = [max(1, min(k, self.rows - 1)) for k in ks]
        w = self.points.select("gid", "w")
        own = w.filter(F.col("w") > 1).select("gid", F.col("gid").alias("nbr"), F.lit(0.0).alias("distance"), (F.col("w") - 1).alias("w"), F.lit(0).alias("rank"))
        other = self.edges.filter(F.col("rank") <= max(ks)).join(w.select(F.col("gid").alias("nbr"), "w"), "nbr")
        every = other.select("gid", "nbr", "distance", "w", "rank").unionByName(own)
        before = F.coalesce(F.sum("w").over(Window.partitionBy("gid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        takes = [F.greatest(F.lit(0), F.least(F.col("w"), F.lit(k) - F.col("before"))).alias(f"t{i}") for i, k in enumerate(ks)]
        edges = keep(every.withColumn("before", before).filter(F.col("before") < max(ks)).select("gid", "nbr", "distance", *takes))
        each = range(len(ks))
        reach = edges.groupBy("gid").agg(*[F.max(F.when(F.col(f"t{i}") > 0, F.col("distance"))).alias(f"d{i}") for i in each]).withColumnRenamed("gid", "nbr")
        reached = [F.sum(F.col(f"t{i}") * F.greatest(f"d{i}", "distance")) / F.sum(f"t{i}") for i in each]
        density = keep(edges.join(reach, "nbr").groupBy("gid").agg(*[(F.lit(1.0) / (r + 1e-10)).alias(f"l{i}") for i, r in zip(each, reached)]))
        around = edges.join(density.withColumnRenamed("gid", "nbr"), "nbr").groupBy("gid").agg(*[(F.sum(F.col(f"t{i}") * F.col(f"l{i}")) / F.sum(f"t{i}")).alias(f"a{i}") for i in each])
        scores = around.join(density, "gid").join(w, "gid").select("w", *[(F.col(f"a{i}") / F.col(f"l{i}")).alias(f"s{i}") for i in each])
        total = scores.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(f"s{i}")) for i in each], *[F.sum(F.col("w") * F.col(f"s{i}") * F.col(f"s{i}")) for i in each]).first()
        n, first, second = total[0] or 1, total[1: 1 + len(ks)], total[1 + len(ks):]
        return [math.sqrt(max(0.0, (q or 0.0) / n - ((m or 0.0) / n) ** 2)) for m, q in zip(first, second)]

    def rows_with(self, scores: DataFrame) -> DataFrame:
        """Point scores back on the table's rows, joined on the vector."""
        vectors = F.array(*[quoted(f).cast("double") for f in self.features])
        by_vector = self.points.select("v", "gid").join(scores, "gid").drop("gid", "w")
        return self.df.withColumn("v", vectors).join(by_vector, "v").drop("v")

    def knn_distance(self, k: int | None = None, name: str = "knn_distance") -> DataFrame:
        """Mean distance to the k nearest other rows."""
        k = max(1, min(k or self.k, self.rows - 1))
        mean = F.sum(F.col("take") * F.col("distance")) / F.sum("take")
        return self.weighted(k).groupBy("gid").agg(mean.alias(name))

    def lof(self, k: int | None = None, name: str = "lof") -> DataFrame:
        """Local outlier factor with k neighbours."""
        k = max(1, min(k or self.k, self.rows - 1))
        edges = keep(self.weighted(k))
        reach = edges.groupBy("gid").agg(F.max("distance").alias("kdist"))
        of_nbr = reach.select(F.col("gid").alias("nbr"), F.col("kdist").alias("nbr_kdist"))
        reached = F.sum(F.col("take") * F.greatest("nbr_kdist", "distance")) / F.sum("take")
        density = keep(edges.join(of_nbr, "nbr").groupBy("gid").agg((F.lit(1.0) / (reached + 1e-10)).alias("lrd")))
        of_nbr = density.select(F.col("gid").alias("nbr"), F.col("lrd").alias("nbr_lrd"))
        around = edges.join(of_nbr, "nbr").groupBy("gid").agg((F.sum(F.col("take") * F.col("nbr_lrd")) / F.sum("take")).alias("around"))
        return around.join(density, "gid").select("gid", (F.col("around") / F.col("lrd")).alias(name))


def nearest_rows(df: DataFrame, key: str, features: Sequence[str], k: int, **tuning) -> DataFrame:
    """(key, nbr, distance, rank): each row's k nearest other rows.

    Rows are ordered by distance, then the neighbour vector's smallest key, then their own key.
    Only the first k + 1 rows of each vector can be anyone's neighbour, so a vector shared by
    very many rows contributes no more than that.
    """
    graph = NeighbourGraph(df, key, features, k, **tuning)
    vector = F.array(*[quoted(f).cast("double") for f in graph.features])
    rows = df.select(quoted(key).cast("long").alias("id"), vector.alias("v")).join(graph.points.select("v", "gid", "w"), "v").select("id", "gid", "w")
    # Two pruned top-k windows: per (vector, salt) first, so a hot vector is spread out.
    salted = Window.partitionBy("gid", "salt").orderBy("id")
    first = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= graph.k + 1)
    members = first.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy("id"))).filter(F.col("place") <= graph.k + 1)
    members = members.select(F.col("gid").alias("nbr_gid"), F.col("id").alias("nbr"), "place")
    edges = graph.weighted(graph.k)
    apart = edges.filter(F.col("gid") != F.col("nbr")).select("gid", F.col("nbr").alias("nbr_gid"), "distance", "take")
    apart = apart.join(members, "nbr_gid").filter(F.col("place") <= F.col("take")).select("gid", "nbr_gid", "nbr", "distance")
    of_rows = rows.select("id", "gid").join(apart, "gid")
    own = rows.filter(F.col("w") > 1).select("id", F.col("gid").alias("nbr_gid")).join(members, "nbr_gid").filter(F.col("id") != F.col("nbr"))
    every = of_rows.select("id", "nbr_gid", "nbr", "distance").unionByName(own.select("id", "nbr_gid", "nbr", F.lit(0.0).alias("distance")))
    best = Window.partitionBy("id").orderBy("distance", "nbr_gid", "nbr")
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= graph.k)
    return ranked.select(F.col("id").alias(key), "nbr", "distance", "rank")


def knn_distance(df: DataFrame, key: str, features: Sequence[str], k: int | None = None, name: str = "knn_distance", **tuning) -> DataFrame:
    rows = df.count()
    graph = NeighbourGraph(df, key, features, k or default_neighbours(rows), rows, **tuning)
    return graph.rows_with(graph.knn_distance(name=name))


def lof(df: DataFrame, key: str, features: Sequence[str], k: int = 20, name: str = "lof", **tuning) -> DataFrame:
    graph = NeighbourGraph(df, key, features, k, **tuning)
    return graph.rows_with(graph.lof(name=name))
