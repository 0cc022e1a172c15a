import numpy as np
import pytest
from pyspark.sql import functions as F

from oddrows.detectors.neighbours import NeighbourGraph, nearest_rows
from oddrows.operators.knn import distinct_points, neighbour_edges


def cloud(kind: str) -> np.ndarray:
    rng = np.random.default_rng(4)
    if kind == "clusters":
        return np.concatenate([rng.normal(c, 0.3, size=(80, 3)) for c in ((0, 0, 0), (5, 5, 5), (9, 0, 2))])
    if kind == "far_offset":
        return rng.normal(size=(200, 3)) + 1e6  # digits are lost unless distances are recomputed
    if kind == "grid":
        return rng.integers(0, 6, size=(240, 2)).astype(float)
    hot = np.zeros((90, 2))
    return np.concatenate([hot, rng.normal(size=(150, 2))])  # over a third of all rows are one vector


def frame(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


def brute(x: np.ndarray) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("kind", ["clusters", "far_offset", "grid", "copies"])
@pytest.mark.parametrize("tuning", [{"block": 16, "pivots": 12}, {"block": 500, "pivots": 1}])
def test_mean_distance_is_exact(spark, kind, tuning):
    x = cloud(kind)
    df, names = frame(spark, x)
    graph = NeighbourGraph(df.repartition(5), "id", names, 9, **tuning)
    got = graph.rows_with(graph.knn_distance()).select("id", "knn_distance").toPandas().sort_values("id")["knn_distance"]
    assert np.allclose(got, np.sort(brute(x), axis=1)[:, :9].mean(1), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("tuning", [{"block": 20, "pivots": 10}, {}])
def test_lof_is_exact(spark, tuning):
    x = cloud("clusters")
    d, k = brute(x), 7
    nbr = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, nbr, 1)
    lrd = 1 / (np.maximum(near[:, -1][nbr], near).mean(1) + 1e-10)
    df, names = frame(spark, x)
    graph = NeighbourGraph(df, "id", names, 12, **tuning)  # a smaller k reuses the larger search
    got = graph.rows_with(graph.lof(k)).select("id", "lof").toPandas().sort_values("id")["lof"]
    assert np.allclose(got, lrd[nbr].mean(1) / lrd)


def test_edges_survive_pruning(spark):
    x = cloud("clusters")
    df, names = frame(spark, x)
    points = distinct_points(df, "id", names)
    many = neighbour_edges(points, 5, 3, block=12, pivots=20).select("gid", "nbr", "rank").toPandas()
    one = neighbour_edges(points, 5, 3, block=1000, pivots=1).select("gid", "nbr", "rank").toPandas()
    order = ["gid", "rank"]
    assert many.sort_values(order)["nbr"].tolist() == one.sort_values(order)["nbr"].tolist()


def test_more_neighbours_than_rows(spark):
    df, names = frame(spark, cloud("grid")[:4])
    edges = nearest_rows(df, "id", names, 50)
    assert edges.groupBy("id").count().filter(F.col("count") != 3).count() == 0


def test_row_edges_with_copies(spark):
    x = cloud("copies")
    df, names = frame(spark, x)
    got = nearest_rows(df, "id", names, 6, block=30, pivots=6).toPandas().sort_values(["id", "rank"])
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 6), np.sort(brute(x), axis=1)[:, :6])
    assert (got["id"] != got["nbr"]).all()


@pytest.mark.parametrize("kind", ["clusters", "copies", "far_offset"])
def test_edges_are_k_a_point_and_are_not_shuffled(spark, kind):
    """Also in many dimensions, where nearly every block meets every other."""
    x = cloud(kind)
    wide = np.column_stack([x, np.random.default_rng(1).normal(size=(len(x), 37)) * (0 if kind == "copies" else 1)])
    df, names = frame(spark, wide)
    points = distinct_points(df, "id", names)
    n = points.count()
    edges = neighbour_edges(points, 6, wide.shape[1], block=16, pivots=9)
    assert edges._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # nothing follows the tasks that keep the best
    got = edges.toPandas().sort_values(["gid", "rank"])
    assert len(got) == 6 * n and (got["rank"].to_numpy().reshape(-1, 6) == np.arange(1, 7)).all()
    ids = points.select("gid").toPandas()["gid"].sort_values().to_numpy()
    d = brute(wide[ids])
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 6), np.sort(d, axis=1)[:, :6], rtol=1e-9, atol=1e-9)


def test_cells_out_of_reach_are_skipped(spark, monkeypatch):
    """The best distances so far decide which points still meet a cell."""
    from oddrows.operators import knn

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, size=(60, 2)) for c in ((0, 0), (50, 0), (0, 50), (50, 50))])
    df, names = frame(spark, x)
    points = distinct_points(df, "id", names)
    blocks = points.count() // 20
    seen = []
    real = knn._streamed
    monkeypatch.setattr(knn, "_streamed", lambda rows, *a: (seen.append(rows), real(rows, *a))[1])
    edges = neighbour_edges(points, 4, 2, block=20, pivots=12)
    assert edges.count() == 4 * len(x)
    sent = seen[0].filter("far >= 0").count()
    assert sent < blocks * (blocks - 1) / 2  # far from all pairs of blocks


def test_work_and_memory_of_a_task_do_not_grow_with_the_points(spark, monkeypatch):
    """There are at least as many tasks as blocks, and no step holds more than CELLS distances, with the same edges."""
    from oddrows.operators import knn

    x = np.random.default_rng(12).normal(size=(900, 5)).astype(np.float32).astype(float)
    df, names = frame(spark, x)
    points = distinct_points(df, "id", names)
    want = sorted(map(tuple, neighbour_edges(points, 7, 5, block=300, pivots=2).collect()))
    monkeypatch.setattr(knn, "CELLS", 1000)
    edges = neighbour_edges(points, 7, 5, block=15, pivots=6)
    assert edges.rdd.getNumPartitions() >= 900 / 15
    assert sorted(map(tuple, edges.collect())) == want


def test_vectors_are_sent_short_and_exact():
    from oddrows.operators import knn

    x = np.random.default_rng(1).normal(size=(50, 4))
    for m in (x, x.astype(np.float32).astype(float), x * 1e300, x[:0]):
        assert np.array_equal(knn.matrix(knn.packed(m), len(m), 4), m)
    assert len(knn.packed(x)) == 2 * len(knn.packed(x.astype(np.float32).astype(float)))


def test_blocks_measure_few_pairs_exactly(monkeypatch):
    """With a bound on each k-th distance no block pair is sorted: one product leaves the pairs to measure; ties and large offsets too."""
    from oddrows.operators import knn

    rng = np.random.default_rng(12)
    for x in (rng.normal(size=(900, 16)), np.round(rng.normal(size=(900, 2)), 1) + np.arange(900)[:, None] * 1e-9, rng.normal(size=(900, 3)) + 1e4):
        ids, k = rng.permutation(900), 7
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        d[np.arange(900), np.arange(900)] = np.inf
        best = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
        kth = np.take_along_axis(d, best, 1)
        home = np.arange(300)
        now = knn.Nearest(ids[:300], x[:300], k, kth[:300, -1] * 1.2)
        with monkeypatch.context() as m:
            if abs(x).max() < 1e3:
                m.setattr(knn, "nearest_in_block", None)
            for a in (0, 300, 600):
                now.meet(home, ids[a: a + 300], x[a: a + 300])
            now.merge()
        assert np.array_equal(now.distance, kth[:300]) and np.array_equal(now.neighbour, ids[best[:300]])
