"""Forests grown in groups: splits by brute force, quality against the mean, and the same answers again."""

import numpy as np
import pytest

from framelens.operators import grove
from framelens.plans.experiment import cross_validated


def by_hand(bins, stats, rows, classes):
    """(explained, feature, cut) of the best split of some rows."""

    def explained(some):
        s = stats[:, some].sum(1)
        return (s * s).sum() / s.sum() if classes else s[1] * s[1] / s[0]

    best = -np.inf
    for f in range(len(bins)):
        for cut in np.unique(bins[f, rows])[:-1]:
            left = rows[bins[f, rows] <= cut]
            best = max(best, explained(left) + explained(np.setdiff1d(rows, left)))
    return best - explained(rows)


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("n", [400, 40])
def test_splits_are_the_best_ones(classes, n):
    rng = np.random.default_rng(n + classes)
    bins = rng.integers(0, 8, (3, n)).astype(np.uint8)
    y = rng.integers(0, 3, n).astype(float) if classes else rng.normal(0, 5, n)
    stats = grove.channels(y, rng.integers(1, 4, n).astype(float), classes)
    node = rng.permutation(np.arange(n) % 10)
    gain, feature, cut, _ = grove.best_splits(node, bins, stats, 10, 8, classes, None)
    for i in range(10):
        rows = np.flatnonzero(node == i)
        assert gain[i] == pytest.approx(max(by_hand(bins, stats, rows, classes), 0), abs=1e-6)
        if gain[i] > 0:
            side = bins[feature[i], rows] <= cut[i]
            assert side.any() and not side.all()


def test_a_full_tree_knows_its_rows():
    rng = np.random.default_rng(1)
    bins = np.stack([np.arange(300) % 20, np.arange(300) // 20]).astype(np.uint8)
    y = rng.normal(0, 1, 300)
    said, _ = grove.grow(bins, y, np.ones((2, 300)), bins, 32, 0, 30, None, [1, 2])
    assert said[0] == pytest.approx(2 * y)


def test_weights_are_poisson_draws_by_key():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 200_000)
    w = grove.weights(keys, 17)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert (grove.weights(keys[::-1], 17) == w[::-1]).all()
    assert abs(np.corrcoef(w, grove.weights(keys, 18))[0, 1]) < 0.02


def table(spark, parts=3):
    rng = np.random.default_rng(5)
    rows = []
    for vca in ("meet", "teams"):
        for trace in range(10):
            for t in range(20):
                a, b = float(rng.integers(0, 30)), float(rng.normal())
                rows.append((vca, trace, t, trace % 5 + 1, a, b, [b, a], a * 100 + b, 180 if a < 15 else 360))
    return spark.createDataFrame(
        rows,
        "vca string, trace_id bigint, et bigint, fold int, l_a double, l_b double, size array<double>, "
        "bitrate double, frameHeight int",
    ).repartition(parts)


@pytest.mark.parametrize("metric", ["bitrate", "frameHeight"])
def test_every_row_is_predicted_once_and_well(spark, metric):
    rows = table(spark)
    found, scores = cross_validated(rows, metric, "m", trees=15)
    got = found.collect()
    assert len(got) == 400 and len({(r["vca"], r["trace_id"], r["ts"]) for r in got}) == 400
    gt = np.array([r["gt"] for r in got])
    off = np.abs(np.array([r["pred"] for r in got]) - gt)
    assert off.mean() < 0.1 * np.abs(gt - gt.mean()).mean()
    assert {r["fold"] for r in got} == {1, 2, 3, 4, 5}
    sums = {}
    for r in scores.collect():
        sums.setdefault((r["vca"], r["fold"]), {})[r["feature"]] = r["score"]
    assert len(sums) == 10
    for s in sums.values():
        assert set(s) == {"l_a", "l_b", "size_1", "size_2"} and sum(s.values()) == pytest.approx(1)
        assert s["l_a"] + s["size_2"] > 0.7
    # However rows are dealt out.
    again, _ = cross_validated(table(spark, 7), metric, "m", trees=15)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_no_model_reaches_the_driver(spark, monkeypatch):
    from pyspark.ml import Pipeline

    def refuse(*_):
        raise AssertionError("a model on the driver")

    monkeypatch.setattr(Pipeline, "fit", refuse)
    found, _ = cross_validated(table(spark), "bitrate", "m", trees=3)
    assert found.count() == 400


def test_one_fold_gives_no_model(spark):
    rows = table(spark).where("fold = 1")
    found, scores = cross_validated(rows, "bitrate", "m", trees=3)
    assert found.count() == 0 and scores.count() == 0


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("way", ["_dense", "_sparse"])
def test_both_ways_find_the_best_split_of_nodes_of_any_size(classes, way, monkeypatch):
    for name in ("_dense", "_sparse"):
        monkeypatch.setattr(grove, name, getattr(grove, way))
    rng = np.random.default_rng(classes)
    node = rng.permutation(np.repeat(np.arange(8), [1, 1, 2, 3, 50, 1, 7, 9]))
    bins = rng.integers(0, 8, (3, len(node))).astype(np.uint8)
    y = rng.integers(0, 3, len(node)).astype(float) if classes else rng.normal(0, 5, len(node))
    stats = grove.channels(y, rng.integers(1, 4, len(node)).astype(float), classes)
    gain, _, _, _ = grove.best_splits(node, bins, stats, 8, 8, classes, None)
    for i in range(8):
        rows = np.flatnonzero(node == i)
        best = by_hand(bins, stats, rows, classes) if (bins[:, rows] != bins[:, rows[:1]]).any() else 0
        assert gain[i] == pytest.approx(max(best, 0), abs=1e-6)


def test_rows_of_a_node_lie_side_by_side(monkeypatch):
    """Sums by node and bin of scattered rows miss the processor's cache once a tree has many nodes."""
    seen, best_splits = [], grove.best_splits

    def look(node, *rest):
        seen.append(node)
        return best_splits(node, *rest)

    monkeypatch.setattr(grove, "best_splits", look)
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 32, (4, 500)).astype(np.uint8), rng.normal(0, 1, 500)
    grove.grow(bins, y, np.ones((3, 500)), bins, 32, 0, 30, None, [1, 2, 3])
    assert len(seen) > 5 and all((np.diff(node) >= 0).all() for node in seen)
