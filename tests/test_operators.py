"""Hand-computed cases of operators, and identities they must keep."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import alloc, couplings, evidence, geometry, joins, matrix, metrics, models, ranks, solvers, trends


def long(spark, rows):
    return spark.createDataFrame(rows, "cell long, state string, stage int, gene long, v double")


def test_stage_shift_by_hand(spark):
    rows = [(1, "A", 0, 1, 1.0), (1, "A", 0, 2, 2.0), (2, "A", 1, 1, 2.0), (2, "A", 1, 2, 1.0), (3, "B", 1, 1, 3.0), (3, "B", 1, 2, 5.0)]
    got = {(r["cell"], r["gene"]): r["v"] for r in trends.stage_shift(long(spark, rows)).collect()}
    assert got == {(2, 1): 3.0, (2, 2): 0.0, (3, 1): 3.0, (3, 2): 5.0}


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0])], "i int, v double").withColumn("g", F.lit(1))
    got = [r["u"] for r in df.select("i", ranks.normalised_rank("v", ["g"]).alias("u")).orderBy("i").collect()]
    assert got == [0.875, 0.25, 0.25, 0.625]


def test_largest_remainder_sums_and_ties(spark):
    df = spark.createDataFrame([("a", 0.25), ("b", 0.25), ("c", 0.5)], "s string, share double")
    up = {r["s"]: r["n"] for r in alloc.largest_remainder(df, "s", 3).collect()}
    down = {r["s"]: r["n"] for r in alloc.largest_remainder(df, "s", 3, descending=True).collect()}
    assert up == {"a": 1, "b": 1, "c": 1} or sum(up.values()) == 3
    assert sum(down.values()) == 3


def test_copula_restore_keeps_the_multiset(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(rng.integers(0, 5, (40, 2)))], "i int, a double, b double, g int")
    out = ranks.copula_restored(df, ["g"], "a", "b", 0.5, "i")
    want = sorted((r["g"], r["a"]) for r in df.collect())
    assert sorted((r["g"], r["restored"]) for r in out.collect()) == want
    same = ranks.copula_restored(df, ["g"], "a", "b", 0.0, "i").collect()
    assert all(r["a"] == r["restored"] for r in same)


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    assert matrix.digest(a, ["k", "s"]).first() == matrix.digest(a.orderBy(F.desc("k")), ["k", "s"]).first()


def test_committee_reasons(spark):
    rows = [
        ("t", "a", "f1", 1, 0.9, None, 0.1, True), ("t", "a", "f2", 1, 0.7, 0.5, 0.2, True),
        ("t", "b", "f1", 1, 0.9, 0.5, 0.1, True), ("t", "b", "f2", -1, 0.9, 0.5, 0.1, True),
        ("t", "c", "f1", 1, 0.9, 0.5, 0.1, True), ("t", "d", "f1", 0, 0.9, 0.5, 0.1, True),
        ("t", "e", "f1", 1, 0.2, 0.5, 0.1, False), ("t", "e", "f2", 1, 0.2, 0.5, 0.1, False),
        ("t", "g", "f1", 1, 0.2, 0.5, 0.1, True), ("t", "g", "f2", 1, 0.2, 0.5, 0.1, True),
    ]
    df = spark.createDataFrame(rows, "target string, response string, family string, sign int, rank_score double, confidence double, directness double, gate boolean")
    got = {r["response"]: r["reason"] for r in evidence.committee(df, ["target", "response"], 2, 1, "target").collect()}
    assert got == {"a": "PASS", "b": "SIGN_CONFLICT", "c": "TOO_FEW_FAMILIES", "d": "NO_SIGN", "e": "GATE_CLOSED", "g": "CAP_EXCLUDED"}


def test_paths_do_not_revisit(spark):
    edges = spark.createDataFrame([("A", "b", 1), ("B", "c", -1), ("c", "a", 1), ("c", "d", 1)], "src string, dst string, sign int")
    got = {(r["path"], r["sign"]) for r in evidence.signed_paths(edges, spark.createDataFrame([("a",)], "src string"), 3).collect()}
    assert got == {("a>b", 1), ("a>b>c", -1), ("a>b>c>d", -1)}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2), st.integers(0, 10_000))
def test_assignment_is_cheapest(n, extra, seed):
    cost = np.random.default_rng(seed).random((n, n + extra))
    at = geometry.assignment(cost)
    assert len(set(at.tolist())) == n
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + extra), n))
    assert abs(cost[np.arange(n), at].sum() - best) < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 8), st.integers(0, 1000))
def test_sinkhorn_marginals_and_bures(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.dirichlet(np.ones(n) * 3), rng.dirichlet(np.ones(n) * 3)
    plan = geometry.sinkhorn(rng.random((n, n)), a, b, 0.2, rounds=5000)
    assert np.abs(plan.sum(0) - b).max() < 1e-6
    assert np.abs(plan.sum(1) - a).max() < 1e-4
    x, y = rng.standard_normal((2, 3, 9))
    ca, cb = x @ x.T / 9 + np.eye(3) * 0.1, y @ y.T / 9 + np.eye(3) * 0.1
    m = geometry.bures_map(ca, cb)
    assert np.allclose(m @ ca @ m.T, cb, atol=1e-8)


def test_rigid_em_recovers_a_motion():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 3)) * [3, 2, 1]
    a = 0.2
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    got, shift = solvers.rigid_em(x, rng.permutation(x @ turn + [1, 2, 3]))
    assert np.abs(x @ got + shift - (x @ turn + [1, 2, 3])).max() < 0.05


def test_swaps_only_gain_and_stay_a_permutation():
    rng = np.random.default_rng(1)
    z, graph = rng.standard_normal((20, 3)), np.stack([rng.choice(20, 4, replace=False) for _ in range(20)])
    desired = rng.standard_normal((20, 3))
    loss = lambda at: ((z[at[graph]].mean(1) - desired[at]) ** 2).sum()
    at = solvers.swapped_pairing(z, desired, graph)
    assert sorted(at.tolist()) == list(range(20)) and loss(at) < loss(np.arange(20))


def test_fused_coupling_of_equal_structures():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 2)) * 3
    c = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.full(6, 1 / 6)
    plan = solvers.fused_coupling(c, c, c, p, p, 0.5, 0.2)
    assert np.abs(plan.sum(0) - p).max() < 1e-6 and (plan.argmax(1) == np.arange(6)).all()


def test_counterfactual_keeps_residuals(spark):
    df = spark.createDataFrame([(1.0, 5.0, 7.0)], "a double, b double, c double")
    out = solvers.counterfactual(df, "a", 0.0, {"b": {"a": 2.0}, "c": {"a": 1.0, "b": 0.5}}).first()
    assert tuple(out) == (0.0, 3.0, 5.0)


def test_nearest_are_k_however_far(spark):
    at = [(0, 0, 0.0), (1, 0, 0.05), (2, 0, 0.11), (3, 0, 3.0), (4, 0, 40.0), (5, 1, 0.0), (6, 1, 9.0), (7, 2, 1.0), (8, 0, float("nan"))]
    points = spark.createDataFrame([(c, g, x, 0.0, 0.0) for c, g, x in at], "cell long, state int, x double, y double, z double")
    want = set()
    for c, g, x in at[:-1]:
        others = sorted((round(abs(x - v), 9), d) for d, h, v in at[:-1] if h == g and d != c)
        want |= {(c, d, i + 1) for i, (_, d) in enumerate(others[:3])}
    assert {(r["src"], r["dst"], r["rank"]) for r in joins.neighbours(points, 3, ["state"]).collect()} == want
    assert joins.neighbours(points.limit(0), 3, ["state"]).count() == 0


def test_neighbours_are_the_nearest_however_far(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, *(rng.standard_normal(3) * (1000 if i % 17 == 0 else 0.01)).tolist()) for i in range(90)] + [(200, 3, 0.0, 0.0, 0.0), (201, 4, 1.0, 1.0, 1.0), (202, 4, 1.0, 1.0, 1.0), (203, 0, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "cell long, state int, x double, y double, z double")
    got = {}
    for p in joins.neighbours(points, 4, ["state"], keep_self=True).collect():
        got.setdefault(p["src"], {})[p["rank"]] = p["dst"]
    for i, state, *at in rows:
        if np.isfinite(at).all():
            others = sorted((round(float(np.linalg.norm(np.subtract(at, there))), 9), j) for j, s, *there in rows if s == state and j != i and np.isfinite(there).all())
            assert got[i] == dict(enumerate([i, *(j for _, j in others[:3])], 1))
    assert 203 not in got


@pytest.mark.parametrize(("n", "m"), [(5, 5), (4, 6), (6, 4), (1, 3)])
def test_exact_plan_is_the_cheapest(n, m):
    """Equal masses on either side: as cheap as the best one-to-one pairing of as many copies of each as make both sides even."""
    rng = np.random.default_rng(n * m)
    cost = rng.random((n, m))
    i, j, mass = geometry.exact_plan(cost, np.full(n, 1 / n), np.full(m, 1 / m))
    assert np.allclose(np.bincount(i, mass, n), 1 / n) and np.allclose(np.bincount(j, mass, m), 1 / m)
    size = np.lcm(n, m)
    copies = np.repeat(np.repeat(cost, size // n, 0), size // m, 1)
    at = geometry.assignment(copies)
    assert abs((cost[i, j] * mass).sum() - copies[np.arange(size), at].mean()) < 1e-9


def test_exact_plan_of_any_marginals():
    rng = np.random.default_rng(8)
    cost, a, b = rng.integers(0, 9, (4, 5)).astype(float), np.array([3, 1, 2, 4]) / 10, np.array([1, 1, 3, 2, 3]) / 10
    i, j, mass = geometry.exact_plan(cost, a, b)
    assert np.allclose(np.bincount(i, mass, 4), a) and np.allclose(np.bincount(j, mass, 5), b)
    copies = np.repeat(np.repeat(cost, [3, 1, 2, 4], 0), [1, 1, 3, 2, 3], 1)
    assert abs((cost[i, j] * mass).sum() - copies[np.arange(10), geometry.assignment(copies)].sum() / 10) < 1e-9


def test_greedy_pairs_use_each_once():
    plan = np.array([[0.2, 0.5, 0.1], [0.5, 0.5, 0.0]])
    i, j = geometry.greedy_pairs(plan)
    assert (i.tolist(), j.tolist()) == ([0, 1], [1, 0])
    assert [len(x) for x in geometry.greedy_pairs(np.zeros((0, 3)))] == [0, 0]


def test_kernel_and_energy_distance_equal_sums_over_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((7, 5)), rng.standard_normal((9, 5)) + 1
    axes = np.linalg.eigh(np.cov(b.T))[1][:, ::-1][:, :3]
    p, q = a @ axes, b @ axes
    square = lambda x, y: float(((x - y) ** 2).sum())
    pairs = [[square(x, y) for i, x in enumerate(u) for y in v[i + 1 :]] for u, v in ((p, p), (q, q))] + [[square(x, y) for x in p for y in q]]
    width = np.median(pairs[1]) + 1e-9
    want = np.mean([sum(w * np.mean(np.exp(-np.array(d) * s / width)) for w, d in zip((1, 1, -2), pairs, strict=True)) for s in (0.25, 0.5, 1, 2, 4)])
    assert abs(metrics.kernel_distance(a, b, b.mean(0), axes) - want) < 1e-9
    assert abs(metrics.kernel_distance(10 * a, b, b.mean(0), axes) - want) > 1e-3
    cells = spark.createDataFrame([(i, 1, int(i >= 7), x.tolist()) for i, x in enumerate([*a, *b])], "cell long, state int, stage int, x array<double>")
    root = [[square(x, y) ** 0.5 for i, x in enumerate(u) for y in v[i + 1 :]] for u, v in ((a, a), (b, b))] + [[square(x, y) ** 0.5 for x in a for y in b]]
    assert abs(metrics.energy_distance(cells, "state", 1500).first()["energy"] - (2 * np.mean(root[2]) - np.mean(root[0]) - np.mean(root[1]))) < 1e-9
    assert metrics.energy_distance(cells.where("stage = 0"), "state", 1500).first()["energy"] is None


def test_estimated_covariance_equals_its_definition(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((30, 6)) @ rng.standard_normal((6, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    c, share = models.estimated_covariance(rows, "x", 6)
    d = x - x.mean(0)
    want = d.T @ d / 30
    target = np.eye(6) * np.trace(want) / 6
    noise = sum(((np.outer(v, v) - want) ** 2).sum() for v in d) / 30**2
    assert np.allclose(c, want) and abs(share - min(1, noise / ((want - target) ** 2).sum())) < 1e-9
    assert 0 < share < 1 and models.estimated_covariance(rows.limit(0), "x", 6)[1] == 1.0


def test_weighted_draws_follow_their_weights(spark):
    rows = spark.createDataFrame([(g, i, w) for g in "ab" for i, w in enumerate((1, 0, 3, 6))], "g string, id long, w int")
    got = {(r["g"], r["id"]): r["times"] for r in alloc.weighted_draws(rows, ["g"], "id", "w", 2000, 1).collect()}
    assert all((g, 1) not in got and abs(got[g, i] - 200 * w) < 120 for g in "ab" for i, w in ((0, 1), (2, 3), (3, 6)))
    assert sum(got.values()) == 4000


def test_bootstrap_times_add_up(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(40)], "g int, id long")
    out = alloc.bootstrap_times(rows, ["g"], "id", 5, 2).groupBy("g", "round").agg(F.sum("times").alias("n")).collect()
    assert len(out) == 15 and {(r["g"], r["n"]) for r in out} == {(0, 14), (1, 13), (2, 13)}


def test_unbalanced_coupling_is_stationary():
    """The plan is where the objective's gradient vanishes; with a high price it is the balanced one."""
    rng = np.random.default_rng(5)
    cost, a, b = rng.random((4, 3)), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2])
    plan = geometry.unbalanced_coupling(cost, a, b, 0.2, 0.7, 1.3)
    gradient = cost + 0.2 * np.log(plan) + 0.7 * np.log(plan.sum(1) / a)[:, None] + 1.3 * np.log(plan.sum(0) / b)[None]
    assert np.abs(gradient).max() < 1e-6
    assert np.abs(geometry.unbalanced_coupling(cost, a, b, 0.2, 1e6, 1e6) - geometry.sinkhorn(cost, a, b, 0.2)).max() < 1e-4


def test_many_centres_and_anchors_pass_in_portions(spark, monkeypatch):
    rng = np.random.default_rng(11)
    c, x = rng.standard_normal((40, 3)), rng.standard_normal((25, 3))
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "state int, c array<double>")
    rows = spark.createDataFrame([(i, v.tolist(), *map(float, v)) for i, v in enumerate(x)], "cell int, x array<double>, px double, py double, pz double")
    near = {i: int(((c - v) ** 2).sum(1).argmin()) for i, v in enumerate(x)}
    points = rows.select("cell", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    anchors = spark.createDataFrame([(*map(float, v), float(i % 3)) for i, v in enumerate(c)], "x double, y double, z double, w double")
    field = [float(sum(i % 3 * np.exp(-((v - u) ** 2).sum() / 0.5) for i, u in enumerate(c))) for v in x]
    for size in (2048, 7):
        monkeypatch.setattr(joins, "CENTRES", size)
        got = joins.nearest(rows, centres, "x", "state", "c", lambda a, b: -joins.squared_distance(a, b), "cell").collect()
        assert {r["cell"]: r["nearest_state"] for r in got} == near
        out = {r["cell"]: r["field"] for r in geometry.gaussian_field(points, anchors, 0.5).collect()}
        assert np.allclose([out[i] for i in range(25)], field)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_couplings_of_tables_equal_dense_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(couplings, "IN_TASK", limit)
    rng = np.random.default_rng(12)
    cost, a, b = rng.random((4, 3)), rng.random(4), rng.random(3)
    a, b = a / a.sum(), b / b.sum()
    table = spark.createDataFrame([(g, i, j, float(cost[i, j])) for g in (0, 1) for i in range(4) for j in range(3)], "g int, i int, j int, c double").repartition(3)
    left, right = (spark.createDataFrame([(g, k, float(p)) for g in (0, 1) for k, p in enumerate(m)], f"g int, {n} int, p double") for n, m in (("i", a), ("j", b)))
    for rho, want in ((None, geometry.sinkhorn(cost, a, b, 0.5, 5000, 1e-12)), ((0.5, 2.0), geometry.unbalanced_coupling(cost, a, b, 0.5, 0.5, 2.0))):
        got = np.zeros((2, 4, 3))
        for r in couplings.coupled(table, left, right, 0.5, ["g"], rho).collect():
            got[r["g"], r["i"], r["j"]] = r["mass"]
        assert np.abs(got - want).max() < 1e-6
    if not limit:
        with pytest.raises(ValueError):
            couplings.coupled(table, left, right, 0.001, ["g"], rounds=2, together=2)


def test_digest_is_a_chain_of_all_hashes(spark):
    """All 256 bits of each row's hash enter, in order, however many batches a group passes in."""
    import hashlib

    rows = [(g, i % 17) for i in range(60) for g in ("a", "b", None)] + [("c", 1)]
    want = {}
    for g, k in rows:
        want.setdefault(g, []).append(hashlib.sha256(f"{k}|{g or '~'}".encode()).hexdigest())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r["g"]: (r["digest"], r["n_rows"]) for r in matrix.digest(spark.createDataFrame(rows, "g string, k int"), ["k", "g"], ["g"]).collect()}
    none = matrix.digest(spark.createDataFrame([], "g string, k int"), ["k"]).first()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {g: (hashlib.sha256("".join(sorted(v)).encode()).hexdigest(), len(v)) for g, v in want.items()}
    assert tuple(none) == (hashlib.sha256(b"").hexdigest(), 0)


def _held(f) -> float:
    """MB that a call holds at most."""
    import tracemalloc

    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def _clouds(n, m, d=3, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)), rng.standard_normal((m, d))


def test_rigid_em_holds_few_correspondences():
    x, y = _clouds(2000, 2000)
    assert _held(lambda: solvers.rigid_em(x, y, rounds=2)) < 40  # all squares would be 96
    (turn, shift), (again, there) = (solvers.rigid_em(x[:60], y[:50], held=h) for h in (1 << 20, 100))
    assert np.allclose(turn, again) and np.allclose(shift, there)
    assert np.isfinite(solvers.rigid_em(x[:1], y[:1])[1]).all()


def test_swaps_hold_few_distances():
    z, p = _clouds(1200, 1200, 8)
    graph = geometry.first_gaps(p, p, 4)
    assert _held(lambda: solvers.swapped_pairing(z, z[graph].mean(1)[::-1].copy(), graph)) < 45  # all squares would be 92
    gap = ((p[:90, None] - p[None, :90]) ** 2).sum(2)
    assert (geometry.first_gaps(p[:90], p[:90], 4, held=200) == np.argsort(gap, 1, kind="stable")[:, :4]).all()


def test_assignment_of_points_holds_no_matrix():
    a, b = _clouds(600, 640)
    assert _held(lambda: geometry.assignment(geometry.SquaredGaps(a, b))) < 1  # the matrix is 3
    a, b = a[:40].round(0), b[:45].round(0)
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    one, other = geometry.assignment(cost), geometry.assignment(geometry.SquaredGaps(a, b))
    assert abs(cost[np.arange(40), one].sum() - cost[np.arange(40), other].sum()) < 1e-9 and len(set(other.tolist())) == 40


def test_rewired_holds_no_matrix():
    a, b = _clouds(500, 500)
    assert _held(lambda: solvers.rewired(a, b, (a, b), (b, a), 0.5)) < 2  # all squares would be 6
    assert sorted(solvers.rewired(a, b, (a, b), (b, a), 0.5).tolist()) == list(range(500))


def test_exact_plan_of_points_holds_no_matrix():
    a, b = _clouds(150, 170)
    n, m = np.full(150, 1 / 150), np.full(170, 1 / 170)
    found = []
    assert _held(lambda: found.append(geometry.exact_plan(geometry.SquaredGaps(a, b), n, m))) < 0.35  # flow and cost would be 0.4
    i, j, mass = found[0]
    assert np.allclose(np.bincount(i, mass, 150), n) and np.allclose(np.bincount(j, mass, 170), m) and len(i) < 340
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    p, q, other = geometry.exact_plan(cost, n, m)
    assert abs((cost[i, j] * mass).sum() - (cost[p, q] * other).sum()) < 1e-12


class _Read:
    """A matrix that counts how often a row of it is read."""

    def __init__(self, cost):
        self.cost, self.shape, self.reads = cost, cost.shape, 0

    def __getitem__(self, i):
        self.reads += 1
        return self.cost[i]


def test_exact_plan_reads_few_rows():
    """A path looks at a row's nearest columns, not at the whole row again."""
    a, b = _clouds(150, 170)
    b[:20] = b[0]  # ties
    cost = _Read(((a[:, None] - b[None]) ** 2).sum(2))
    i, j, mass = geometry.exact_plan(cost, np.full(150, 1 / 150), np.full(170, 1 / 170))
    assert cost.reads < 30 * 150
    assert np.allclose(np.bincount(i, mass, 150), 1 / 150) and np.allclose(np.bincount(j, mass, 170), 1 / 170)
    for near in (1, 170):
        p, q, other = geometry.exact_plan(cost.cost, np.full(150, 1 / 150), np.full(170, 1 / 170), near)
        assert abs((cost.cost[i, j] * mass).sum() - (cost.cost[p, q] * other).sum()) < 1e-12
    u, v = _prices(cost.cost, i, j)
    assert (cost.cost - u[:, None] - v > -1e-9).all() and np.allclose(cost.cost[i, j], u[i] + v[j], atol=1e-9)  # no plan is cheaper


def _prices(cost, i, j):
    """Prices of rows and columns that make each entry of a plan tight, by shortest paths over its entries and all costs."""
    n, m = cost.shape
    u, v = np.zeros(n), cost.min(0)
    for _ in range(n + m):
        before = v.copy()
        np.maximum.at(u, i, cost[i, j] - v[j])
        v = np.minimum(v, (cost - u[:, None]).min(0))
        if (v == before).all():
            break
    return u, v
