import numpy as np
import pytest

from oddrows.detectors import autoencoder, forest, lstm, ocsvm, search
from oddrows.detectors.gradient import adam
from oddrows.detectors.registry import DETECTORS, select_detectors, train
from oddrows.operators.blocks import DIRECT_PARTS, block_sums, pack_rows


def planted(n=400, d=4, odd=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    x[:odd] = rng.normal(size=(odd, d)) * 8.0  # scattered in all directions
    x[:odd] += np.sign(x[:odd]) * 2.0
    return x, np.arange(n) < odd


def frame(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("name,params", [
    ("iforest", {"n_estimators": 60}), ("ocsvm", {"nu": 0.1}), ("lof", {"k": 20}), ("knn_distance", {"k": 15}),
    ("autoencoder", {"lr": 0.01}), ("lstm", {"lr": 0.01, "seq_len": 2, "hidden_size": 8})])
def test_planted_rows_score_high(spark, name, params):
    x, odd = planted()
    df, names = frame(spark, x)
    got = train(name, df, "id", names, len(x), order_by=["id"], **params).toPandas().sort_values("id")[name].to_numpy()
    assert len(got) == len(x) and np.isfinite(got).all()
    assert auc(odd, got) > 0.9


def test_unknown_detector(spark):
    with pytest.raises(ValueError):
        train("nope", spark.range(3), "id", ["id"], 3)


def test_scores_repeat_and_ignore_partitions(spark):
    x, _ = planted(200)
    df, names = frame(spark, x)
    for name, params in (("iforest", {"n_estimators": 20}), ("autoencoder", {})):
        a = train(name, df.repartition(1), "id", names, 200, **params).toPandas().sort_values("id")[name]
        b = train(name, df.repartition(6), "id", names, 200, **params).toPandas().sort_values("id")[name]
        assert np.allclose(a, b, rtol=1e-9)


def finite_difference(f, v, at, h=1e-6):
    e = np.zeros_like(v)
    e[at] = h
    return (f(v + e) - f(v - e)) / (2 * h)


def test_autoencoder_gradient():
    x = np.random.default_rng(0).normal(size=(7, 5))
    v = autoencoder.start_vector(5, 4)
    g = autoencoder.loss_and_gradient(x, v, 4, x.size)[1:]
    for at in range(0, len(v), 37):
        assert abs(g[at] - finite_difference(lambda p: autoencoder.loss_and_gradient(x, p, 4, x.size)[0], v, at)) < 1e-6


def test_lstm_gradient():
    w = np.random.default_rng(0).normal(size=(6, 5, 3))
    v = lstm.start_vector(3, 4)
    g = lstm.loss_and_gradient(w, v, 4, w.size)[1:]
    for at in range(0, len(v), 23):
        assert abs(g[at] - finite_difference(lambda p: lstm.loss_and_gradient(w, p, 4, w.size)[0], v, at)) < 1e-6


@pytest.mark.parametrize("buckets,rows", [(1, 2048), (4, 2048), (5, 13)])
def test_windows_cross_block_edges(spark, buckets, rows):
    x = np.random.default_rng(5).normal(size=(230, 2))
    df, names = frame(spark, x)
    length = 6
    blocks = lstm.pack_sequences(df.repartition(3), "id", names, ["id"], length - 1, rows=rows, buckets=buckets)
    got = lstm.score_windows(blocks, 2, length, lambda w: w.mean((1, 2)), "id", "m").toPandas().sort_values("id")["m"].to_numpy()
    means = np.array([x[i: i + length].mean() for i in range(len(x) - length + 1)])
    sums, count = np.zeros(len(x)), np.zeros(len(x))
    for i, m in enumerate(means):
        sums[i: i + length] += m
        count[i: i + length] += 1
    assert np.allclose(got, sums / count)
    windows = lstm.sequence_windows(df, "id", names, ["id"], length, rows=rows, buckets=buckets)
    assert windows.count() == len(means)


def test_short_table_is_one_window(spark):
    x = np.random.default_rng(5).normal(size=(4, 2))
    df, names = frame(spark, x)
    got = lstm.lstm_autoencoder(df, "id", names, ["id"], seq_len=10, hidden_size=3, epochs=2).toPandas()["lstm"]
    assert len(got) == 4 and np.allclose(got, got.iloc[0])


def test_trees_isolate_every_row():
    x = np.random.default_rng(1).normal(size=(64, 3))
    tree = forest.build_tree(x)
    inner = tree.feature >= 0
    assert (tree.left[inner] > 0).all() and (tree.path[~inner] > 0).all()
    assert (np.bincount(tree.place(x), minlength=len(inner))[~inner] > 0).all()
    constant = forest.build_tree(np.ones((9, 2)))
    assert len(constant.number) == 1 and constant.path[0] == pytest.approx(float(forest.average_path(9)))


def plain_forest(x, ids, trees, psi, seed=42):
    """The same forest grown in memory, one tree after the other."""
    total = np.zeros(len(x))
    for t in range(trees):
        drawn = np.argsort(forest.order_of_rows(seed, t, ids), kind="stable")[:psi]
        tree = forest.build_tree(x[drawn], seed, t)
        total += tree.path[tree.place(x)]
    return np.power(2.0, -total / (trees * forest.average_path(psi)))


@pytest.mark.parametrize("share,cells", [(1.0, 1 << 23), (0.7, 1 << 23), (1.0, 450), (0.7, 450), (0.02, 90)])
def test_forests_are_those_of_plain_trees_however_they_are_grown(spark, share, cells):
    """Copied rows, a coarse and a constant column; tables that fit a task and tables that are cut near the root."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 5.0
    x[:300] = x[0]
    df, names = frame(spark, x)
    got = forest.isolation_forest(df.repartition(5), "id", names, n_estimators=12, max_samples=share, node_cells=cells).toPandas().sort_values("id")["iforest"].to_numpy()
    assert np.allclose(got, plain_forest(x, np.arange(1500), 12, int(1500 * share)), rtol=1e-12)


@pytest.mark.parametrize("rows,trees", [(7200, 10), (500_000, 3)])
def test_every_drawn_row_is_used_at_any_size(spark, rows, trees):
    """No pool and no cap: as many rows as asked for reach the leaves of each tree."""
    df = spark.range(rows).selectExpr("id", "CAST(xxhash64(id) % 100000 AS DOUBLE) AS a", "CAST(id % 977 AS DOUBLE) AS b")
    table = forest.pack_table(df, "id", ["a", "b"], rows)
    specs = [forest.Spec(0, t, int(rows * 0.8)) for t in range(trees)]
    limits = forest.sample_limits(table, specs, 42)
    ids = np.arange(rows)
    assert [int((forest.order_of_rows(42, s.tree, ids) <= limits[s]).sum()) for s in specs] == [int(rows * 0.8)] * trees
    got = forest.isolation_forest(df, "id", ["a", "b"], rows, n_estimators=trees, max_samples=0.8, node_cells=200_000).toPandas().sort_values("id")["iforest"].to_numpy()
    x = df.toPandas().sort_values("id")[["a", "b"]].to_numpy()
    assert np.allclose(got, plain_forest(x, ids, trees, int(rows * 0.8)), rtol=1e-12)


def test_forest_with_text_keys_and_few_rows(spark):
    df = spark.createDataFrame([(f"k{i}", float(i == 7) * 9) for i in range(20)], "k string, a double")
    got = {r["k"]: r["iforest"] for r in forest.isolation_forest(df, "k", ["a"], n_estimators=30).collect()}
    assert max(got, key=got.get) == "k7" and len(got) == 20
    one = forest.isolation_forest(df.limit(1), "k", ["a"], n_estimators=3).collect()
    assert len(one) == 1 and np.isfinite(one[0]["iforest"])
    assert forest.isolation_forest(df.limit(0), "k", ["a"], 0, n_estimators=3).count() == 0


def test_svm_keeps_nu_share_outside():
    x, odd = planted()
    basis, w = ocsvm.fit_in_memory(x, 0.1, "scale")
    assert auc(odd, -(ocsvm.fourier(x, basis) @ w)) > 0.95


def test_partial_sums_are_grouped_when_there_are_many(spark):
    df = spark.range(0, 900, 1, 300).selectExpr("id", "CAST(id AS DOUBLE) AS v")
    blocks = pack_rows(df, ["v"])
    assert blocks.rdd.getNumPartitions() > DIRECT_PARTS

    def measure(batches):
        return np.array([sum(np.frombuffer(b).sum() for batch in batches for b in batch.column(1).to_pylist())])

    assert block_sums(blocks, measure, 1, 300)[0] == 899 * 450


def sequences(spark, df, names, rows):
    return lstm.pack_sequences(df, "id", names, ["id"], search.LSTM_REACH, rows=64, total=rows)


def test_search_uses_the_ranges(spark):
    x, _ = planted(150)
    df, names = frame(spark, x)
    found = search.search(df, "id", names, 150, list(DETECTORS), sequence_blocks=sequences(spark, df, names, 150))
    best = found.best
    assert 50 <= best["iforest"]["n_estimators"] <= 200 and 0.5 <= best["iforest"]["max_samples"] <= 1.0
    assert 0.001 <= best["ocsvm"]["nu"] <= 0.2 and best["ocsvm"]["gamma"] in ("scale", "auto")
    assert 2 <= best["lof"]["k"] <= 35 and best["knn_distance"] == {"k": 12}
    assert 4 <= best["autoencoder"]["hidden_dim"] <= 8 and 1e-4 <= best["autoencoder"]["lr"] <= 1e-2
    assert len(search.candidates("lstm", 500, 3)) == 6 and search.candidates("lof", 2, 3) == [{"k": 2}]
    rows = found.table(spark).collect()
    assert len(rows) == 8 * 4 + 6 + 1 and sum(r["chosen"] for r in rows) == 6
    for name in DETECTORS:
        mine = [t for t in found.trials if t.name == name]
        most = max(t.effort for t in mine)
        finalists = [t for t in mine if t.effort == most] if name not in ("lof", "iforest") else mine
        if len(finalists) > 1 and name != "iforest":
            assert next(t for t in mine if t.chosen).value == max(t.value for t in finalists)
    with pytest.raises(ValueError):
        search.search(df, "id", names, 150, ["lstm"])


def test_race_drops_the_worse_half():
    trials = [search.Trial("x", i, {"v": v}) for i, v in enumerate([3, 9, 9, 1, float("nan"), 4])]
    seen = []

    def run(left, effort):
        seen.append(([t.number for t in left], effort))
        for t in left:
            t.value, t.effort = t.params["v"] + (5 if t.number == 5 and effort > 1 else 0), effort

    search.race(trials, (1, 2, 3), run)
    assert seen == [([0, 1, 2, 3, 4, 5], 1), ([1, 2, 5], 2), ([1, 5], 3)] or seen[:2] == [([0, 1, 2, 3, 4, 5], 1), ([1, 2, 5], 2)]
    assert [t.number for t in trials if t.chosen] == [1]


def test_candidates_trained_together_are_those_trained_alone(spark):
    """Each value is the loss on the whole table of the candidate trained by itself."""
    x, _ = planted(300)
    df, names = frame(spark, x)
    found = search.search(df.repartition(3), "id", names, 300, ["autoencoder", "lstm"], sequence_blocks=sequences(spark, df, names, 300))
    for t in found.trials:
        if t.name == "autoencoder":
            start, h = autoencoder.start_vector(4, t.params["hidden_dim"]), t.params["hidden_dim"]
            both = lambda v: autoencoder.loss_and_gradient(x, v, h, x.size)  # noqa: B023, E731
        else:
            length, h = t.params["seq_len"], t.params["hidden_size"]
            w, start = lstm.windows_of(x, length, 0, len(x)), lstm.start_vector(4, h)
            both = lambda v: lstm.loss_and_gradient(w, v, h, w.size)  # noqa: B023, E731
        _, loss = adam(start, lambda v: ((o := both(v))[0], o[1:]), t.effort, t.params["lr"])  # noqa: B023
        assert t.value == pytest.approx(-loss, rel=1e-9)
    assert {t.effort for t in found.trials if t.name == "autoencoder"} == {3, 6, 10}


def test_a_search_s_training_goes_on_to_the_same_end(spark):
    x, _ = planted(200)
    df, names = frame(spark, x)
    blocks = sequences(spark, df, names, 200)
    found = search.search(df, "id", names, 200, ["ocsvm", "autoencoder", "lstm"], sequence_blocks=blocks)
    assert set(found.states) == {"ocsvm", "autoencoder", "lstm"}
    for name, run in (("ocsvm", ocsvm.svm_scorer), ("autoencoder", autoencoder.autoencoder_scorer)):
        anew, on = run(df, names, 200, **found.best[name])(x), run(df, names, 200, state=found.states[name], **found.best[name])(x)
        assert np.allclose(anew, on, rtol=1e-9)
    scored = [lstm.lstm_autoencoder(df, "id", names, ["id"], 200, blocks=blocks, state=s, **found.best["lstm"]).toPandas().sort_values("id")["lstm"] for s in (None, found.states["lstm"])]
    assert np.allclose(*scored, rtol=1e-9)


def test_values_of_forests_svms_and_neighbours_are_over_all_rows(spark):
    x, _ = planted(300)
    x[40:80] = x[40]  # copies
    df, names = frame(spark, x)
    found = search.search(df.repartition(3), "id", names, 300, ["iforest", "lof", "ocsvm"])
    from oddrows.detectors.neighbours import lof
    for t in found.trials:
        if t.name == "iforest":
            want = plain_forest(x, np.arange(300), t.effort, int(300 * t.params["max_samples"])).std()
        elif t.name == "lof":
            want = lof(df, "id", names, t.params["k"]).toPandas()["lof"].std(ddof=0)
        else:
            basis = ocsvm.fourier_basis(4, ocsvm.kernel_width(x.sum(), (x * x).sum(), x.size, 4, t.params["gamma"]))
            solver, edges = ocsvm.steps(300, t.params["nu"]), []
            asked = next(solver)
            while len(edges) < t.effort:
                edges.append(asked[0])
                try:
                    asked = solver.send(ocsvm.margin_sums(x, basis, *asked))
                except StopIteration:
                    break
            want = (ocsvm.fourier(x, basis) @ edges[-1]).std()
        assert t.value == pytest.approx(want, rel=1e-6)
    assert max(t.effort for t in found.trials if t.name == "iforest") > 24


def test_detector_choice():
    assert select_detectors(5, 1) == ["iforest", "ocsvm"]
    assert select_detectors(300, 6) == ["iforest", "ocsvm", "lof", "knn_distance", "autoencoder", "lstm"]


def test_search_grows_each_tree_once(spark, monkeypatch):
    """A rung of the forest search adds trees to the sums of the rung before and grows none of them again."""
    from oddrows.detectors import search as searching
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(400, 2)))], "id long, a double, b double")
    grown, sums = [], forest.path_sums
    monkeypatch.setattr(searching, "path_sums", lambda table, specs, groups, **kw: grown.append((groups, list(specs))) or sums(table, specs, groups, **kw))
    trials = searching.search(df, "id", ["a", "b"], 400, ["iforest"]).trials
    assert sum(len(s) for _, s in grown) == sum(t.effort for t in trials)
    for t in trials:
        one = forest.isolation_forest(df, "id", ["a", "b"], 400, n_estimators=t.effort, max_samples=t.params["max_samples"])
        assert t.value == pytest.approx(one.selectExpr("stddev_pop(iforest)").first()[0], abs=1e-9)
    by_nodes = searching.search(df, "id", ["a", "b"], 400, ["iforest"], node_cells=100).trials
    assert [(t.effort, t.chosen) for t in by_nodes] == [(t.effort, t.chosen) for t in trials]
    assert [t.value for t in by_nodes] == pytest.approx([t.value for t in trials], abs=1e-9)


def test_trees_grow_in_groups_of_bounded_rows(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), np.ones(3000)])
    whole = forest.build_tree(x, 42, 2, 1, 14)
    held = []
    monkeypatch.setattr(forest, "GROUP_ROWS", 100)
    monkeypatch.setattr(forest, "cut_of", lambda seed, tree, node, low, high, inner=forest.cut_of: held.append(len(node)) or inner(seed, tree, node, low, high))
    paths = np.full(3000, np.nan)
    parts = forest.build_tree(x, 42, 2, 1, 14, paths)
    assert max(held) <= 100 and len(parts.number) == len(whole.number)
    assert (paths == whole.path[whole.place(x)]).all() and (parts.path[parts.place(x)] == paths).all()


def test_fourier_map_is_the_cosine():
    rng = np.random.default_rng(8)
    basis = ocsvm.fourier_basis(3, 0.3, 64)
    for scale in (0.0, 1.0, 1e4, 1e9):
        x = rng.normal(size=(700, 3)) * scale
        assert np.abs(ocsvm.fourier(x, basis) - np.sqrt(2 / 64) * np.cos(x @ basis[0] + basis[1])).max() < 1e-11
    z, edges = ocsvm.fourier(rng.normal(size=(700, 3)), basis), np.linspace(0.0, 1.0, 9)
    w = z.mean(0)
    bins, got = np.searchsorted(edges, z @ w, side="right"), ocsvm.binned(z, w, edges).reshape(10, 65)
    for b in range(10):
        assert got[b, 0] == (bins == b).sum() and got[b, 1:] == pytest.approx(z[bins == b].sum(0))


def test_broadcast_tops_need_no_package(spark, monkeypatch):
    """Broadcasts are unpickled by reference, on executors that may lack the package: they hold no classes of it."""
    import pickle
    df = spark.createDataFrame([(i, float(i * 7 % 31), float(i % 5)) for i in range(200)], "id long, a double, b double")
    sent, context = [], type(spark.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or real(self, value))
    forest.isolation_forest(df, "id", ["a", "b"], 200, n_estimators=3, node_cells=60).collect()
    assert sent and not any(b"oddrows" in s for s in sent)


def test_forest_partitions_grow_with_rows_and_trees(spark, monkeypatch):
    """A partition holds about PART_BYTES of the rows that go to nodes, whatever spark.sql.shuffle.partitions is; scores stay."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 9, 3000), rng.integers(0, 400, 3000)])
    df, names = frame(spark, x)
    table = forest.pack_table(df, "id", names, len(x))
    trees = [forest.Spec(0, t, 2400) for t in range(6)]
    whole = {r["block"]: np.frombuffer(r["sums"]) for r in forest.path_sums(table, trees, 1).collect()}
    monkeypatch.setattr(forest, "PART_BYTES", 1 << 14)
    sums = forest.path_sums(table, trees, 1, node_cells=1500)
    assert sums.rdd.getNumPartitions() >= 3000 * 6 * 32 / (1 << 14)
    got = {r["block"]: np.frombuffer(r["sums"]) for r in sums.collect()}
    assert whole.keys() == got.keys() and all(np.allclose(whole[b], got[b], rtol=1e-12) for b in whole)


def test_forest_messages_are_short_and_exact():
    rng = np.random.default_rng(9)
    for n in (0, 1, 300, 70_000):
        x = np.column_stack([rng.normal(size=n), rng.integers(-3, 9, n) / 7, rng.integers(0, 300, n), np.arange(n), np.where(rng.random(n) < 0.5, -np.inf, 1e300)])
        data = b"".join(forest._packed(c) for c in x.T)
        assert np.array_equal(forest._unpacked(data, n, 5), x) and len(data) <= 20 + x.nbytes
        if n > 1000:
            assert len(data) < 0.6 * x.nbytes
        places = np.flatnonzero(rng.random(3 * n) < 0.3)
        assert np.array_equal(forest._places(forest._gaps(places)), places) and len(forest._gaps(places)) <= 1 + len(places)
    far = np.array([0, 3, 70_000, 70_001])
    assert np.array_equal(forest._places(forest._gaps(far)), far)


def test_large_tables_are_dealt_out_evenly(spark, monkeypatch, tmp_path):
    """One row group is one task of a scan; packing and scoring deal its rows to all cores, above the limit for small tables too."""
    from oddrows.operators import blocks as b

    monkeypatch.setattr(b, "SMALL_BLOCKS", 0)
    spark.range(8000).selectExpr("id", "CAST(id AS double) AS v").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    packed = [sum(np.frombuffer(p["x"]).size for p in part) for part in pack_rows(df, ["v"], total=8000).rdd.glom().collect()]
    scored = b.score_rows(df, ["id"], ["v"], {"s": lambda x: x[:, 0] * 2}, 8000)
    dealt = [len(part) for part in scored.rdd.glom().collect()]
    for sizes in (packed, dealt):
        assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 8000 and max(sizes) <= 2 * 8000 / len(sizes)
    assert scored.where("s <> 2 * id").count() == 0


def test_sequence_blocks_are_dealt_out_evenly(spark):
    """Buckets of the order fall together in tasks; the blocks made from them do not."""
    df = spark.range(20_000).selectExpr("id", "CAST(id AS double) AS v")
    blocks = lstm.pack_sequences(df, "id", ["v"], ["id"], 3, rows=100, buckets=12, total=20_000)
    own = [sum(r["own"] for r in part) for part in blocks.rdd.glom().collect()]
    assert sum(own) == 20_000 and len(own) >= spark.sparkContext.defaultParallelism and max(own) <= 2 * 20_000 / len(own)


def test_passes_near_the_root_look_at_open_nodes_only(spark, monkeypatch):
    """A level's pass draws the rows of its open nodes, not those of all rows again; blocks are not cut by Arrow's batches."""
    rng = np.random.default_rng(10)
    x = np.column_stack([rng.normal(size=6000), rng.integers(0, 9, 6000), rng.integers(0, 400, 6000)])
    df, names = frame(spark, x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        table = forest.pack_table(df, "id", names, len(x))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert table.blocks.count() == table.partitions < 12
    looked, real = [], forest.drawn_rows
    monkeypatch.setattr(forest, "drawn_rows", lambda seed, tree, ids, *rest: looked.append(len(ids)) or real(seed, tree, ids, *rest))
    monkeypatch.setattr(forest, "block_sums", lambda blocks, measure, size, partitions, combine=np.add: measure(iter(blocks.toArrow().to_batches())))
    specs = [forest.Spec(0, t, 4800) for t in range(5)]
    tops = forest.grow_tops(table, specs, forest.sample_limits(table, specs, 42), 42, 300)
    levels = [int(n).bit_length() for top in tops.values() for n in top.number[top.place(x)]]
    assert sum(looked) == sum(levels) and max(levels) > 3
