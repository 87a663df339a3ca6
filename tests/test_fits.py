"""Fits by sums over rows against dense computations on the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import fits, geometry, graphs


def arrays(spark, parts, columns="by string, cell long, z array<double>"):
    rows, n = [], 0
    for name, z in parts.items():
        for v in z:
            rows.append((name, n, [float(x) for x in v]))
            n += 1
    return spark.createDataFrame(rows, columns).repartition(3)


def test_propagation_equals_the_dense_solution(spark):
    rng = np.random.default_rng(0)
    p = rng.standard_normal((60, 3))
    df = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(p)], "state int, cell long, x double, y double, z double")
    edges, scale = graphs.neighbour_graph(df, 5, ["state"])
    edges = edges.cache()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    near = np.argsort(d + np.eye(60) * 1e9, 1)[:, :5]
    width = np.median(np.take_along_axis(d, near, 1))
    w = np.zeros((60, 60))
    for i in range(60):
        w[i, near[i]] = np.exp(-((d[i, near[i]] / width) ** 2))
    w = (w + w.T) / 2
    assert abs(scale.first()["scale"] - width) < 1e-12
    got = np.zeros((60, 60))
    for r in edges.collect():
        got[r["src"], r["dst"]] = r["w"]
    assert np.allclose(got, w)
    y = (np.arange(60) % 3 == 0).astype(float)
    nodes = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(99, 0.25)], "cell long, y double")
    f = graphs.propagated(nodes, edges, 0.8)
    want = np.linalg.solve(np.eye(60) - 0.8 * w / w.sum(1, keepdims=True), 0.2 * y)
    have = {r["cell"]: r["f"] for r in f.collect()}
    assert have[99] == 0.25 and np.allclose([have[i] for i in range(60)], want, atol=1e-9)
    assert graphs.residual(nodes, edges, f, 0.8) < 1e-8
    with pytest.raises(ValueError):
        graphs.propagated(nodes, edges, 0.8, rounds=1)


def test_propagation_without_edges_or_labels(spark):
    nodes = spark.createDataFrame([(1, 0.5), (2, 0.0)], "cell long, y double")
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert sorted(tuple(r) for r in graphs.propagated(nodes, none, 0.8).collect()) == [(1, 0.5), (2, 0.0)]
    pair = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, w double")
    assert all(r["f"] == 0 for r in graphs.propagated(nodes.withColumn("y", F.lit(0.0)), pair, 0.8).collect())


def test_tilted_means_are_the_targets(spark):
    rng = np.random.default_rng(1)
    z = {s: rng.standard_normal((n, 3)) * (1 + k) for k, (s, n) in enumerate((("a", 300), ("b", 80)))}
    f = {s: np.hstack([v, v * v]) for s, v in z.items()}
    rows = arrays(spark, f, "by string, cell long, f array<double>")
    goals = {s: v.mean(0) + 0.3 * v.std(0) * np.array([1, -1, 0.5, 0, 0.2, 0]) for s, v in f.items()}
    for ridge, bound in ((0.0, 50.0), (0.05, 50.0), (0.01, 0.1)):
        for s, (theta, mean, gradient) in fits.moment_tilt(rows, goals, ridge, bound).items():
            w = np.exp(f[s] @ theta)
            assert np.allclose(w @ f[s] / w.sum(), mean) and gradient < 1e-7 and np.abs(theta).max() <= bound
            open_ = np.abs(theta) < bound
            assert np.allclose((mean + ridge * theta)[open_], goals[s][open_], atol=1e-6)
            # What a bound holds would go further.
            assert (np.sign(theta[~open_]) == np.sign((goals[s] - mean - ridge * theta)[~open_])).all()
            if bound == 0.1:
                assert (~open_).any()


def test_tilts_of_large_logits_do_not_overflow(spark):
    f = {"a": np.array([[900.0], [1000.0], [1100.0]])}
    theta, mean, _ = fits.moment_tilt(arrays(spark, f, "by string, cell long, f array<double>"), {"a": np.array([1080.0])}, 0.0, 5.0)["a"]
    assert abs(mean[0] - 1080) < 1e-6 and theta[0] > 0


def test_mixtures_rise_and_equal_dense_steps(spark):
    rng = np.random.default_rng(5)
    z = {"a": np.concatenate([rng.standard_normal((90, 2)) - 3, rng.standard_normal((60, 2)) * 0.5 + 3]), "b": rng.standard_normal((41, 2)), "c": np.array([[1.0, 2.0]])}
    rows = arrays(spark, z)
    found = fits.diagonal_mixtures(rows, 4, 30, tolerance=1e-5)
    assert {s: len(m.weight) for s, (m, _, _) in found.items()} == {"a": 4, "b": 2, "c": 1}
    for s, (m, logs, done) in found.items():
        assert done and all(b >= a - 1e-2 for a, b in zip(logs, logs[1:], strict=False)) and abs(m.weight.sum() - 1) < 1e-9
        share, log = m.shares(z[s])
        mass = share.sum(0)
        mean = share.T @ z[s] / mass[:, None]
        var = share.T @ (z[s] ** 2) / mass[:, None] - mean**2 + 0.05
        assert abs(log.mean() - logs[-1]) < 1e-4  # a further dense step changes hardly anything
        assert np.abs(mean - m.mean).max() < 0.2 and np.abs(var - m.var).max() < 0.3
        dense = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (z[s] - u) ** 2 / v).sum(1) for w, u, v in zip(m.weight, m.mean, m.var, strict=True)], 1)
        assert np.allclose(dense, m.logs(z[s]))
    got = {r["cell"]: r["share"] for r in fits.mixture_shares(rows, found).collect()}
    assert len(got) == 192 and all(abs(sum(v) - 1) < 1e-9 for v in got.values())


def test_one_step_of_the_mixture_is_the_dense_one(spark):
    rng = np.random.default_rng(8)
    z = rng.standard_normal((120, 3))
    first, second = (fits.diagonal_mixtures(arrays(spark, {"a": z}), 3, 40, floor=0.05, tolerance=0, rounds=n)["a"][0] for n in (3, 4))
    share, _ = first.shares(z)
    mass = share.sum(0)
    mean = share.T @ z / mass[:, None]
    assert np.allclose(second.weight, mass / 120) and np.allclose(second.mean, mean)
    assert np.allclose(second.var, np.maximum(share.T @ (z * z) / mass[:, None] - mean**2, 0) + 0.05)


def test_rates_reach_their_target(spark):
    rng = np.random.default_rng(4)
    v = {g: rng.random(50) * (rng.random(50) > 0.4) for g in "abc"} | {"zero": np.zeros(5), "far": rng.random(9) + 0.1}
    targets = {g: x.mean() * f for (g, x), f in zip(v.items(), (1.2, 0.8, 1.0, 1.0, 99.0), strict=True)}
    df = spark.createDataFrame([(g, float(x), float(targets[g])) for g, xs in v.items() for x in xs], "g string, v double, t double").repartition(3)
    for wide in (1, 4):
        got = {r["g"]: r["rate"] for r in fits.calibrated_rates(df, ["g"], "v", "t", 2.0, wide=wide).collect()}
        for g in "abc":
            assert abs(np.log1p(np.expm1(v[g]) * np.exp(got[g])).mean() - targets[g]) < 1e-9
        assert got["zero"] == 0 and abs(got["far"] - 2) < 1e-9


def test_propensity_equals_a_refit_without_the_gene(spark):
    rng = np.random.default_rng(6)
    x = np.maximum(rng.standard_normal((70, 9)), 0)
    state = np.array([i % 2 for i in range(60)] + [2] * 10)
    cells = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(state, x, strict=True))], "cell long, state int, x array<double>").repartition(3)
    axes = fits.principal_axes(cells, "x", 9, 4)
    assert np.allclose(axes.T @ axes, np.eye(4))
    got = {r["cell"]: np.array(r["propensity"]) for r in fits.detection_propensity(cells, axes).collect()}
    for s in (0, 1):
        rows = np.flatnonzero(state == s)
        d, y = x[rows] - x[rows].mean(0), (x[rows] > 0) - (x[rows] > 0).mean(0)
        for j in range(9):
            z = d @ axes - np.outer(d[:, j], axes[j])
            beta = np.linalg.solve(z.T @ z + 0.1 * max(np.trace(z.T @ z) / 4, 1) * np.eye(4), z.T @ y[:, j])
            assert np.allclose([got[i][j] for i in rows], z @ beta)
    assert all((got[i] == 0).all() for i in np.flatnonzero(state == 2))


def test_kernel_predictor_is_kernel_ridge_where_all_rows_are_landmarks(spark):
    rng = np.random.default_rng(7)
    x, y, new = rng.standard_normal((40, 3)), rng.standard_normal((40, 5)), rng.standard_normal((6, 3))
    train = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>").repartition(3)
    ask = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(new)], "id long, x array<double>")
    u, v = ((a - x.mean(0)) / x.std(0) for a in (x, new))
    gap = lambda a, b: ((a[:, None] - b[None]) ** 2).mean(2)
    width = 2 * np.median(gap(u, u)[np.triu_indices(40, 1)])
    want = y.mean(0) + np.exp(-gap(v, u) / width) @ np.linalg.solve(np.exp(-gap(u, u) / width) + 0.7 * np.eye(40), y - y.mean(0))
    got = {r["id"]: r["prediction"] for r in fits.kernel_predictor(train, ask, 0.7, landmarks=100).collect()}
    assert np.allclose([got[i] for i in range(6)], want, atol=1e-6)
    factors = np.linalg.svd(y - y.mean(0))[2][:2]
    got = {r["id"]: r["prediction"] for r in fits.kernel_predictor(train, ask, 0.7, rank=2, landmarks=100).collect()}
    assert np.allclose([got[i] for i in range(6)], y.mean(0) + (want - y.mean(0)) @ factors.T @ factors, atol=1e-6)


def test_frames_are_those_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x = {"a": rng.standard_normal((30, 4)) * [3, 1, 2, 0.5], "b": rng.standard_normal((25, 4)) * [1, 4, 2, 0.5]}
    for s, (mean, axes) in fits.principal_frames(arrays(spark, x, "by string, cell long, x array<double>"), 2).items():
        want = np.linalg.svd(x[s] - x[s].mean(0))[2][:2]
        assert np.allclose(mean, x[s].mean(0)) and np.allclose(np.abs(np.diag(axes.T @ want.T)), 1)


def test_matching_is_the_greedy_one(spark):
    rng = np.random.default_rng(3)
    plan = [(int(i), int(j), float(rng.integers(1, 6))) for i in range(25) for j in rng.choice(18, 6, replace=False)]
    left, right, want = set(), set(), []
    for i, j, _ in sorted(plan, key=lambda p: (-p[2], p[0], p[1])):
        if i not in left and j not in right:
            want.append((i, j))
            left.add(i)
            right.add(j)
    df = spark.createDataFrame(plan, "src long, dst long, mass double").repartition(3)
    assert sorted(tuple(r) for r in geometry.matched(df).collect()) == sorted(want)
    assert geometry.matched(df.limit(0)).count() == 0


def test_position_ridge_and_spline_hurdle_solve_their_equations(spark, sf_dir):
    """The registered fits against normal equations over all cells."""
    from cairn.plans import catalog

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.maximum(np.array([r["embedding"] for r in rows], float), 0)
    at = np.array([r["embedding"][:3] for r in rows], float)
    state = np.array([r["label"] for r in rows])
    for r in catalog.QUERIES["a29_a30_position_ridge"](spark, sf_dir).where("gene <= 3").collect():
        mine = state == r["state"]
        b = np.column_stack([np.ones(mine.sum()), at[mine]])
        w = np.array([r["w0"], r["wx"], r["wy"], r["wz"]])
        assert np.abs(b.T @ (x[mine, r["gene"] - 1] - b @ w) - 0.1 * np.array([0, 1, 1, 1]) * w).max() < 1e-5
    a = x[:, 0]
    b = np.column_stack([np.ones(len(a)), a, *(np.maximum(a - k, 0) for k in (0.05, 0.1, 0.2))])
    for r in catalog.QUERIES["y27_spline_hurdle"](spark, sf_dir).where("gene <= 4").collect():
        v = x[:, r["gene"] - 1]
        on = v > 0
        for w, y, use in ((r["presence"], on.astype(float), np.ones(len(v), bool)), (r["mean"], v, on)):
            assert np.abs(b[use].T @ (y[use] - b[use] @ w) - w).max() < 1e-5


def test_interpolated_clouds_have_the_interpolated_mean(spark, sf_dir):
    from cairn.plans import catalog

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    at = {s: np.array([r["embedding"][:3] for r in rows if r["vec_id"] % 2 == s], float) for s in (0, 1)}
    got = np.array([[r["x"], r["y"], r["z"]] for r in catalog.QUERIES["g5_o10_bures_interpolation"](spark, sf_dir).collect()])
    assert np.allclose(got.mean(0), (at[0].mean(0) + at[1].mean(0)) / 2, atol=1e-5)
    a, b = (np.cov(at[s].T, bias=True) for s in (0, 1))
    power = lambda c, p: (np.linalg.eigh(c)[1] * np.linalg.eigh(c)[0] ** p) @ np.linalg.eigh(c)[1].T
    half = 0.5 * np.eye(3) + 0.5 * power(a, -0.5) @ power(power(a, 0.5) @ b @ power(a, 0.5), 0.5) @ power(a, -0.5)
    assert np.allclose(np.cov(got.T, bias=True), half @ a @ half.T, atol=1e-5)


def test_term_embedding_equals_the_singular_vectors(spark):
    rng = np.random.default_rng(10)
    m = (rng.random((18, 12)) < 0.5) * rng.integers(1, 4, (18, 12))
    entries = spark.createDataFrame([(f"r{i:02}", j, float(m[i, j])) for i in range(18) for j in range(12) if m[i, j]], "row string, term int, v double").repartition(3)
    got = {r["row"]: np.array(r["embedding"]) for r in fits.term_embedding(entries, 3).collect()}
    u, s, _ = np.linalg.svd(m)
    e = u[:, :3] * s[:3]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    out = np.array([got[f"r{i:02}"] for i in range(18)])
    assert np.allclose(np.abs(out), np.abs(e), atol=1e-4) and np.allclose(np.abs((out * e).sum(0)), (e * e).sum(0), atol=1e-3)


def test_paths_to_targets_are_those_of_all_paths(spark):
    from cairn.operators import evidence

    rng = np.random.default_rng(13)
    edges = [(f"N{i}", f"n{j}", int(rng.choice([-1, 1]))) for i in range(12) for j in rng.choice(12, 3, replace=False)]
    e = spark.createDataFrame(edges, "src string, dst string, sign int")
    s, t = spark.createDataFrame([("n0",), ("N3",)], "src string"), spark.createDataFrame([("N7",), ("n9",)], "dst string")
    every = evidence.signed_paths(e, s, 3).where("target in ('n7', 'n9')")
    assert sorted(map(tuple, evidence.signed_paths(e, s, 3, t).collect())) == sorted(map(tuple, every.collect())) != []


def test_tasks_without_rows(spark, tmp_path):
    """Tables read in more splits than they have row groups give tasks without rows, whose sums have no type of their own."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, rng.normal(size=4).tolist(), rng.normal(size=2).tolist()) for i in range(30)]
    t = spark.createDataFrame(rows, "id long, state int, x array<double>, y array<double>").coalesce(1)
    t.write.parquet(str(tmp_path / "t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "500")
    thin = spark.read.parquet(str(tmp_path / "t"))
    sizes = thin.rdd.glom().map(len).collect()
    assert sum(sizes) == 30 and 0 in sizes
    x = np.array([r[2] for r in rows])
    mean, axes = fits.principal_frames(thin.select(F.col("state").alias("by"), "x"), 2)[0]
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(axes), np.abs(np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :2]))
    same = lambda f: [sorted((tuple(np.round(v, 9)) for v in d.select(d.columns[-1]).toPandas().iloc[:, 0]), key=str) for d in (f(t), f(thin))]
    one, other = same(lambda d: fits.kernel_predictor(d.select("id", "x", "y"), d.select("id", "x"), 1.0, rank=1))
    assert np.allclose(one, other)
    one, other = same(lambda d: fits.detection_propensity(d.select(F.col("id").alias("cell"), "state", "x"), np.eye(4)[:, :2]))
    assert np.allclose(one, other) and np.abs(one).max() > 0
    goals = {0: np.full(4, 0.1)}
    (a, *_), (b, *_) = (fits.moment_tilt(d.select(F.col("state").alias("by"), F.col("x").alias("f")), goals, 0.1, 5.0)[0] for d in (t, thin))
    assert np.allclose(a, b)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rounds", [3, 30])
def test_propagation_by_rounds_stops_there(spark, rounds):
    rng = np.random.default_rng(5)
    w = np.triu(rng.random((12, 12)) * (rng.random((12, 12)) < 0.4), 1)
    w[:, 11] = 0
    w, y = w + w.T, rng.random(12)
    nodes = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "cell long, y double")
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w)], "src long, dst long, w double")
    f, d = y.copy(), w.sum(1)
    for _ in range(rounds):
        f = np.where(d > 0, 0.8 * (w @ f) / np.maximum(d, 1e-300) + 0.2 * y, y)
    got = {r["cell"]: r["f"] for r in graphs.propagated_rounds(nodes, edges, 0.8, rounds).collect()}
    assert np.abs(np.array([got[i] for i in range(12)]) - f).max() < 1e-13
