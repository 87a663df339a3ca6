"""Neighbour joins by k-d leaves against brute force: dense spots, copies, ties, strays, few points; and what they send."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.operators import joins, knn, ranks

SCHEMA = "g int, cell long, x double, y double, z double"


def points(spark, p, group=0):
    return spark.createDataFrame([(group, i, *map(float, v)) for i, v in enumerate(p)], SCHEMA).repartition(3)


def brute(p, k):
    out = {}
    for i in range(len(p)):
        d = np.sqrt(((p - p[i]) ** 2).sum(1)).round(9)
        out[i] = [j for j in np.lexsort((np.arange(len(p)), d)) if j != i][:k]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["src"], r["rank"])):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


_rng = np.random.default_rng(3)
CLOUDS = {
    "normal": (_rng.standard_normal((500, 3)), 6),
    "dense_spot": (np.concatenate([_rng.standard_normal((700, 3)) * 1e-3, [[9, 9, 9], [-50, 3, 1], [4, -7, 1000.0]]]), 5),
    "copies": (np.repeat(_rng.standard_normal((12, 3)), 40, 0), 4),
    "grid": (_rng.integers(0, 5, (400, 3)).astype(float), 7),
    "line": (np.stack([np.arange(300.0) ** 3, np.zeros(300), np.zeros(300)], 1), 3),
    "few": (_rng.standard_normal((4, 3)), 7),
    "one": (np.zeros((1, 3)), 2),
}


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("leaf", [24, None])
def test_neighbours_equal_brute_force(spark, name, leaf):
    p, k = CLOUDS[name]
    df = points(spark, p)
    assert found(knn.neighbours_among(df, df, k, ["g"], leaf)) == {i: v for i, v in brute(p, k).items() if v}


def test_groups_sources_and_rows_without_a_place(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((150, 3)), rng.standard_normal((90, 3)) * 5
    both = points(spark, a).unionByName(points(spark, b, 1))
    odd = spark.createDataFrame([(0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 0.0, 0.0), (None, 902, 0.0, 0.0, 0.0), (1, 903, float("inf"), 0.0, 0.0)], SCHEMA)
    got = knn.neighbours_among(both.unionByName(odd), both.unionByName(odd), 4, ["g"], 16)
    for g, p in ((0, a), (1, b)):
        assert found(got.where(f"g = {g}")) == brute(p, 4)
    assert got.count() == 4 * 240
    some = spark.createDataFrame([(0, 1000 + i, *map(float, v)) for i, v in enumerate(a[:20] * 9)], SCHEMA)  # names of their own, partly far off
    got = found(knn.neighbours_among(some, both, 3, ["g"], 16))
    want = {1000 + i: np.lexsort((np.arange(150), np.sqrt(((a - v * 9) ** 2).sum(1)).round(9)))[:3].tolist() for i, v in enumerate(a[:20])}
    assert got == want
    assert knn.neighbours_among(both.limit(0), both, 3, ["g"]).count() == 0


def test_names_may_be_text(spark):
    rows = [("a", f"c{i}", float(i % 7), float(i % 3), 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, cell string, x double, y double, z double")
    p, names = np.array([r[2:] for r in rows]), [r[1] for r in rows]
    order = np.argsort(names)
    want = {names[order[i]]: [names[order[j]] for j in v] for i, v in brute(p[order], 5).items()}
    assert found(knn.neighbours_among(df, df, 5, ["g"], 16)) == want


def test_a_point_is_its_own_first_neighbour(spark):
    df = points(spark, CLOUDS["grid"][0][:50])
    got = joins.neighbours(df, 3, ["g"], keep_self=True).where("rank = 1").collect()
    assert len(got) == 50 and all(r["src"] == r["dst"] and r["dist"] == 0 for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=80), st.integers(1, 10), st.floats(0, 4))
def test_balls_touch_the_leaves_of_all_points_within(places, most, radius):
    p = np.array(places, float)
    tree = knn.Tree.of(p, most)
    leaf = tree.leaf_of(p)
    who, touched = tree.touched(p, np.full(len(p), radius))
    pairs = set(zip(who.tolist(), touched.tolist(), strict=True))
    assert len(pairs) == len(who) and set(zip(range(len(p)), leaf.tolist(), strict=True)) <= pairs
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= radius
    assert all((i, int(leaf[j])) in pairs for i, j in zip(*np.nonzero(near), strict=True))


def test_a_dense_spot_sends_no_more_than_a_uniform_cloud(spark):
    """Visits of leaves by point, whatever the density: the tree follows the points."""
    rng = np.random.default_rng(0)
    visits = []
    for n in (1000, 4000, 16000):
        p = np.concatenate([rng.standard_normal((n, 3)) * 1e-3, [[9, 9, 9], [-50, 3, 1], [4, -7, 1000.0]]])
        tree = knn.Tree.of(p[:: 512 // knn.SAMPLED], 3 * knn.SAMPLED // 2)
        leaf = tree.leaf_of(p)
        radius = np.zeros(len(p))
        for one in np.unique(leaf):
            q = p[leaf == one]
            d = np.sort(np.sqrt(((q[:, None] - q[None]) ** 2).sum(2)), 1)
            radius[leaf == one] = d[:, min(6, len(q) - 1)]
        visits.append(len(tree.touched(p, radius)[0]) / len(p))
        assert np.bincount(leaf).max() < 4 * 512
    assert max(visits) < 4


def test_medians_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.standard_normal(20_001), 1: rng.integers(0, 3, 30_000).astype(float), 2: np.array([5.0]), 3: np.array([1.0, 4.0]), 4: np.full(9_000, 7.0), 5: np.concatenate([np.zeros(10_000), np.ones(10_000)])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [(6, None)], "g int, v double")
    got = {r["g"]: r["median"] for r in ranks.medians(df, ["g"], "v").collect()}
    assert got == {g: float(np.median(x)) for g, x in groups.items()}
