"""Density clusters against a plain-Python condensed tree, layouts against numpy's singular vectors."""

import numpy as np
import pytest

from topicspark.operators import density, neighbours

RNG = np.random.default_rng(1)
THREE = np.concatenate([RNG.normal(0, 0.3, (200, 3)), RNG.normal(4, 1, (150, 3)), RNG.normal((8, 0, 0), 0.1, (150, 3))])
COPIES = np.concatenate([THREE[:100], THREE[:40], np.repeat(THREE[:1], 30, 0), RNG.uniform(-5, 9, (130, 3))])
EVEN = RNG.uniform(0, 1, (500, 2))


def condensed_leaves(x, least):
    """Labels by the whole graph: every edge in order of weight, then a walk down the tree of merges."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 12)
    core = np.sort(d, 1)[:, least - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    group, node, size, halves = list(range(n)), list(range(n)), [1] * n, {}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for _, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = top(i), top(j)
        if a != b:
            halves[len(size)] = (node[a], node[b])
            size.append(size[node[a]] + size[node[b]])
            group[b], node[a] = a, len(size) - 1

    def points(k):
        open_, out = [k], []
        while open_:
            k = open_.pop()
            open_ += halves.get(k, ())
            out += [k] if k < n else []
        return out

    leaves, born = [], [(len(size) - 1, True)]
    while born:
        first, root = born.pop()
        k = first
        while k in halves:
            big = [h for h in halves[k] if size[h] >= least]
            if len(big) == 2:
                born += [(h, False) for h in big]
                break
            k = big[0] if big else None
        else:
            leaves += [] if root else [points(first)]
    labels = np.full(n, -1)
    for c, leaf in enumerate(sorted(leaves, key=min)):
        labels[leaf] = c
    return labels


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


def labels(df):
    return np.array([r["cluster"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize(("x", "least"), [(THREE, 10), (COPIES, 8), (EVEN, 5)])
def test_clusters_equal_the_condensed_tree(spark, x, least):
    df, want = frame(spark, x), condensed_leaves(x, least)
    assert want.max() >= 1
    assert (labels(density.density_clusters(df, least)) == want).all()


def test_clusters_of_several_blocks_and_slices(spark):
    """Blocks' trees are joined by Boruvka rounds, and edges are taken in slices."""
    got = density.density_clusters(frame(spark, COPIES), 8, alone=100, block=180, most=150)
    assert (labels(got) == condensed_leaves(COPIES, 8)).all()


def test_clusters_by_boxes_and_few_runs(spark, monkeypatch):
    """A larger key's near rows come by boxes in space, and a row is sent to so many blocks at most."""
    sent, plain = [], density.earlier_edges
    monkeypatch.setattr(density, "earlier_edges", lambda rows, order, keys, run: sent.append(plain(rows, order, keys, run, runs=3)) or sent[-1])
    assert (labels(density.density_clusters(frame(spark, COPIES), 8, alone=100, run=40, cell=50)) == condensed_leaves(COPIES, 8)).all()
    # of 300 rows each block has 100, not the 40 that would make eight of them
    plan = sent[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 100.0" in plan and "/ 40.0" not in plan
    # nor do the few bytes of its pairs come to one task
    assert sent[0].rdd.getNumPartitions() > 4


def test_few_edges_need_no_rounds(spark, monkeypatch):
    pairs = sorted({(*sorted((int(a), int(b))), float(w)) for a, b, w in RNG.integers(0, 60, (400, 3)) if a != b})
    edges = spark.createDataFrame([(k, *p) for p in pairs for k in "ab"], "week string, lo long, hi long, w double").filter("week = 'a' OR lo % 3 = 0")
    edges = edges.dropDuplicates(["week", "lo", "hi"]).localCheckpoint()
    want = {tuple(r) for r in density.spanning_forest(edges, ["week"], few=0).collect()}
    made, plain = [], density.stored
    monkeypatch.setattr(density, "stored", lambda df: made.append(1) or plain(df))
    assert {tuple(r) for r in density.spanning_forest(edges, ["week"]).collect()} == want and len(made) == 2
    # after some rounds the rest are edges between components
    assert {tuple(r) for r in density.spanning_forest(edges, ["week"], few=60).collect()} == want and len(made) > 6
    assert density.spanning_forest(edges.limit(0), ["week"]).count() == 0


def test_gaussians_of_different_density_are_told_apart(spark):
    got = labels(density.density_clusters(frame(spark, THREE), 10))
    assert [len(set(got[a:b])) for a, b in ((0, 200), (200, 350), (350, 500))] == [1, 1, 1] and set(got) == {0, 1, 2}


def test_a_set_without_a_split_is_noise(spark):
    one = RNG.normal(0, 1, (300, 4))
    assert (condensed_leaves(one, 20) == -1).all()
    assert (labels(density.density_clusters(frame(spark, one), 20)) == -1).all()


def test_keys_are_clustered_apart(spark):
    rows = [("a", i, v) for i, v in enumerate(THREE)] + [("b", i, v) for i, v in enumerate(EVEN)] + [("c", i, THREE[i]) for i in range(15)] + [("d", 0, None)]
    df = spark.createDataFrame([(k, i, None if v is None else [float(c) for c in v]) for k, i, v in rows], "week string, id long, vec array<double>")
    got = density.density_clusters(df, 10, keys=("week",))
    assert (labels(got.filter("week = 'a'")) == condensed_leaves(THREE, 10)).all()
    assert (labels(got.filter("week = 'b'")) == condensed_leaves(EVEN, 10)).all()
    assert got.filter("week IN ('c', 'd') AND cluster = -1").count() == 16
    assert density.density_clusters(df.limit(0), 10, keys=("week",)).count() == 0


def test_layout_is_the_first_two_singular_vectors(spark):
    x = THREE / np.linalg.norm(THREE, axis=1, keepdims=True)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[0][:, :2]
    got = np.array([tuple(r) for r in density.layout(frame(spark, THREE)).orderBy("id").select("x", "y").collect()])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    # each axis has its largest entry on the positive side
    assert (got[np.abs(got).argmax(0), [0, 1]] > 0).all()


def test_reduction_keeps_principal_components(spark):
    x = THREE / np.linalg.norm(THREE, axis=1, keepdims=True)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    got = np.array([r["vec"] for r in density.reduced(frame(spark, THREE), 2).orderBy("id").collect()])
    assert np.abs(np.abs(got) - np.abs(x @ axes)).max() < 1e-8


def test_map_moves_points_half_way_to_their_neighbours(spark):
    df = frame(spark, THREE[:60])
    near = neighbours.nearest(df, df, 3)
    at = np.array([tuple(r) for r in density.layout(df).orderBy("id").select("x", "y").collect()])
    listed = np.array([r["near_ids"] for r in neighbours.neighbour_lists(near).orderBy("id").collect()])
    for _ in range(2):
        at = (at + at[listed].mean(axis=1)) / 2
    got = np.array([tuple(r) for r in density.plane_map(df, near, rounds=2).orderBy("id").select("x", "y").collect()])
    assert np.abs(got - at).max() < 1e-9


def spectrum(pairs, n):
    """Coordinates of all points by numpy: eigenvalues, largest first, and eigenvectors of the averaging over neighbours."""
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    w = a.sum(axis=0)
    value, u = np.linalg.eigh(a / np.sqrt(np.outer(w, w)))
    return value[::-1], u[:, ::-1] / np.sqrt(w)[:, None]


def test_spectral_map_equals_numpy(spark):
    rng = np.random.default_rng(5)
    place = rng.random((300, 2)) * [3, 1]
    apart = ((place[:, None] - place) ** 2).sum(axis=2)
    pairs = [(i, int(j)) for i in range(300) for j in np.argsort(apart[i])[1:13]]
    value, want = spectrum(pairs, 300)
    assert value[1] < 1 - 1e-6 and value[1] - value[2] > 1e-3 and value[2] - value[3] > 1e-3
    near, rows = spark.createDataFrame(pairs, "id long, near_id long"), spark.range(302)
    got = np.array([(r["x"], r["y"]) for r in density.spectral_map(rows, near, tolerance=1e-7).orderBy("id").collect()])
    for k in range(2):
        v = want[:, k + 1]
        np.testing.assert_allclose(got[:300, k], v * np.sign(v[np.abs(v).argmax()]), atol=2e-6)
    assert not got[300:].any()


def test_parts_of_a_graph_are_spots_of_a_spectral_map(spark):
    rng = np.random.default_rng(6)
    pairs = [(i, int(j)) for part in range(3) for i in range(part * 40, part * 40 + 40) for j in part * 40 + rng.permutation(40)[:8] if i != j]
    rows, near = spark.range(120), spark.createDataFrame(pairs, "id long, near_id long")
    got = np.array([(r["x"], r["y"]) for r in density.spectral_map(rows, near).orderBy("id").collect()]).reshape(3, 40, 2)
    middle, spread = got.mean(axis=1), np.abs(got - got.mean(axis=1, keepdims=True)).max()
    gaps = [np.linalg.norm(middle[a] - middle[b]) for a, b in ((0, 1), (0, 2), (1, 2))]
    assert min(gaps) > 50 * spread


def test_spectral_map_of_tiny_graphs(spark):
    rows, none = spark.range(3), spark.createDataFrame([(1, 1)], "id long, near_id long")
    assert [tuple(r) for r in density.spectral_map(rows, none).orderBy("id").collect()] == [(k, 0.0, 0.0) for k in range(3)]
    one = density.spectral_map(rows, spark.createDataFrame([(0, 1), (0, 1)], "id long, near_id long")).orderBy("id").collect()
    assert abs(one[0]["x"]) == pytest.approx(0.5**0.5) and one[0]["x"] == pytest.approx(-one[1]["x"]) and one[2]["x"] == 0 and not any(r["y"] for r in one)
    assert density.spectral_map(rows.limit(0), none.limit(0)).count() == 0


@pytest.mark.parametrize(("x", "least"), [(THREE, 10), (COPIES, 8), (EVEN, 5), (np.tile(EVEN[:60], (6, 1)), 4), (RNG.normal(0, 1, (400, 20)), 3)])
def test_large_keys_look_for_earlier_edges_alone(spark, x, least):
    """The tree of near rows and the edges that come before its own make the same clusters; no block's spanning tree is made."""
    got = density.density_clusters(frame(spark, x), least, alone=50, run=64)
    assert (labels(got) == condensed_leaves(x, least)).all()


def test_earlier_edges_are_few(spark):
    df = frame(spark, THREE)
    near = neighbours.nearest(df, df, 9, by="l2")
    core = near.groupBy("id").agg({"value": "max"}).toDF("id", "core")
    rows = df.join(core, "id").selectExpr("0 AS k", "id", "vec", "core")
    met = near.join(core, "id").join(core.toDF("near_id", "other"), "near_id").selectExpr("0 AS k", "least(id, near_id) AS lo", "greatest(id, near_id) AS hi", "greatest(value, core, other) AS w")
    tree, order = density.first_tree(met, rows, ["k"])
    assert tree.count() == 499 and order.filter("part = 0").count() == 500
    assert density.earlier_edges(rows, order, ["k"], 128).count() < 250


def test_passes_of_a_spectral_map_are_not_broadcast(spark, monkeypatch):
    plans, plain = [], density.stored
    monkeypatch.setattr(density, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or plain(df))
    near = spark.createDataFrame([(k, (k + d) % 30) for k in range(30) for d in (1, 2)], "id long, near_id long")
    density.spectral_map(spark.range(30), near, blocks=2)
    assert any("ShuffledHashJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
