"""Forests of many models at once, grown where their rows are: no tree passes through the driver.

Features become numbers of at most 32 bins, cut at quantiles of the training rows. Blocks of such rows meet
the trees of a model in groups of a few trees; a group grows them level by level, all nodes of a level
together, and answers with what its trees say of the model's test rows and with their importances.
Answers of groups are added up by Spark. In a group a row takes its bins and some 30 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.session import cut_lineage

# Trees of a group, and rows that several of its trees are grown over at once.
GROUP = 10
AT_ONCE = 200_000
BLOCKS = "vca string, model int, n int, ids binary, keys binary, ys binary, tests binary, bins binary"
ANSWERS = "vca string, model int, part int, id bigint, said array<double>, gains array<double>"


def weights(keys: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson(1) draw per row from a hash of its key and the tree, whatever order rows come in."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    shares = np.exp(-1) / np.cumprod([1, *range(1, 18)], dtype=float)
    return np.searchsorted(np.cumsum(shares), (z >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def score(stats: np.ndarray, classes: int) -> np.ndarray:
    """What a node's rows explain: the larger the sum over two parts, the better the split.

    ``stats`` has a channel per class, or weight and weighted target; its first axis is the channel's.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        total = stats.sum(0) if classes else stats[0]
        found = (stats * stats).sum(0) / total if classes else stats[1] * stats[1] / total
    return np.where(total > 0, found, 0.0)


def channels(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    return np.stack([w * (y == c) for c in range(classes)] if classes else [w, w * y])


def _explained(left: list[np.ndarray], rest: list[np.ndarray], classes: int) -> np.ndarray:
    """``score`` of both parts, added. Weights are whole numbers, so a part without rows weighs 0 and gives 0."""
    found = 0.0
    for side in (left, rest):
        total = sum(side[1:], side[0]) if classes else side[0]
        squares = sum((s * s for s in side[1:]), side[0] * side[0]) if classes else side[1] * side[1]
        found = found + squares / np.maximum(total, 1.0)
    return found


def _dense(node, bins, stats, n, width, whole, classes, top):
    """The best cut of one feature in every node, from sums per bin and node: (score of both sides, last bin on
    the left). Where it is no better than ``top``, the bin says nothing."""
    cell = bins * np.int64(n) + node
    left = [np.bincount(cell, s, n * width).reshape(width, n)[:-1].cumsum(0) for s in stats]
    rest = [t - s for t, s in zip(whole, left)]
    weigh = (lambda parts: sum(parts)) if classes else (lambda parts: parts[0])
    fits = (weigh(left) > 0.5) & (weigh(rest) > 0.5)
    found = np.where(fits, _explained(left, rest, classes), -np.inf)
    best, cut = found.max(0), np.zeros(n, dtype=np.int64)
    better = np.flatnonzero(best > top)
    cut[better] = found[:, better].argmax(0)
    return best, cut


def _sparse(node, bins, stats, n, width, whole, classes, top):
    """The same where most bins of most nodes are empty: only bins with rows are looked at."""
    low, high = len(node).bit_length(), (width - 1).bit_length()
    # Sorted by node and bin; the row itself in the lower bits.
    keys = np.sort((node << (high + low)) | (bins.astype(np.int64) << low) | np.arange(len(node)))
    order, cell = keys & ((1 << low) - 1), keys >> low
    at = cell >> high
    # The last row of a bin, unless it is the last of its node.
    last = np.flatnonzero((cell[1:] != cell[:-1]) & (at[1:] == at[:-1]))
    best, cut = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
    if not len(last):
        return best, cut
    begun = np.flatnonzero(at[1:] != at[:-1])
    own, ended = at[last], at[begun + 1]
    left, rest = [], []
    for s, t in zip(stats, whole):
        run, before = s.take(order).cumsum(), np.zeros(n)
        before[ended] = run[begun]
        left.append(run[last] - before[own])
        rest.append(t[own] - left[-1])
    found = _explained(left, rest, classes)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    best[own[first]] = np.maximum.reduceat(found, first)
    hit = np.flatnonzero((found == best[own]) & (best > top)[own])[::-1]
    cut[own[hit]] = cell[last[hit]] & ((1 << high) - 1)
    return best, cut


def best_splits(node, bins, stats, n, width, classes, allowed):
    """Per node: gain (0: none), feature and last bin on the left. ``bins`` is one row per feature."""
    whole = np.stack([np.bincount(node, s, n) for s in stats])
    top, feature, cut = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for f in range(len(bins)):
        a, b, s = node, bins[f], stats
        if allowed is not None:
            here = np.flatnonzero(allowed[:, f][node])
            a, b, s = a.take(here), b.take(here), [c.take(here) for c in s]
            if not len(a):
                continue
        way = _dense if n * width <= 2 * len(a) else _sparse
        got, at = way(a, b, s, n, width, whole, classes, top)
        better = np.flatnonzero(got > top)
        top[better], feature[better], cut[better] = got[better], f, at[better]
    old = score(whole, classes)
    gain = np.where(np.isfinite(top), top - old, 0.0)
    return np.where(gain > 1e-12 * (np.abs(old) + 1), gain, 0.0), feature, cut, whole


def chosen(number: np.ndarray, seeds: np.ndarray, n_features: int, subset: int | None) -> np.ndarray | None:
    """The features each node may split on, drawn from its tree's seed and its number in the tree."""
    if subset is None or subset >= n_features:
        return None
    with np.errstate(over="ignore"):
        grid = number[:, None] * np.uint64(n_features) + np.arange(n_features, dtype=np.uint64)
        z = (grid + seeds[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    mask = np.zeros(z.shape, dtype=bool)
    np.put_along_axis(mask, np.argsort(z, axis=1, kind="stable")[:, :subset], True, axis=1)
    return mask


def grow(bins, y, w, test, width, classes, depth, subset, seeds):
    """Trees over binned rows (features first), one per row of weights ``w``, all at once.

    Returns what they say of binned test rows, added up (a channel a class, or the one mean), and each
    tree's gains per feature. Node i of a tree has children 2i and 2i + 1, as far as 64 bits go.
    """
    tree, row = np.nonzero(w)
    node, stats, bins = tree, channels(y[row], w[tree, row], classes), bins[:, row]
    seeds = np.asarray(seeds, dtype=np.int64)
    owner, numbers = np.arange(len(w)), np.ones(len(w), dtype=np.uint64)
    said, gains = np.zeros((max(classes, 1), test.shape[1])), np.zeros((len(w), len(bins)))
    at, rows = np.repeat(np.arange(len(w)), test.shape[1]), np.tile(np.arange(test.shape[1]), len(w))
    for level in range(depth + 1):
        n = len(numbers)
        if level == depth:
            whole = np.stack([np.bincount(node, s, n) for s in stats])
            gain, feature, cut = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        else:
            allowed = chosen(numbers, seeds[owner], len(bins), subset)
            gain, feature, cut, whole = best_splits(node, bins, stats, n, width, classes, allowed)
        split = gain > 0
        np.add.at(gains, (owner[split], feature[split]), gain[split])
        with np.errstate(divide="ignore", invalid="ignore"):
            value = whole / whole.sum(0) if classes else whole[1:] / whole[0]
        leaf = ~split[at]
        for c, v in enumerate(value):
            said[c] += np.bincount(rows[leaf], v[at[leaf]], test.shape[1])
        if not split.any():
            break
        # Nodes that split get two children each; all other rows have arrived.
        child = 2 * (np.cumsum(split) - 1)
        at, rows = at[~leaf], rows[~leaf]
        at = child[at] + (test[feature[at], rows] > cut[at])
        go = np.flatnonzero(split[node])
        node = node[go]
        node = child[node] + (bins[feature[node], go] > cut[node])
        # Rows of a node side by side, in the order they had.
        low = len(go).bit_length()
        order = np.sort((node << low) | np.arange(len(go))) & ((1 << low) - 1)
        node, go = node[order], go[order]
        bins, stats = bins.take(go, axis=1), stats.take(go, axis=1)
        owner = np.repeat(owner[split], 2)
        with np.errstate(over="ignore"):
            twice = numbers[split] * np.uint64(2)
            numbers = np.stack([twice, twice + np.uint64(1)], 1).ravel()
    return said, gains


@dataclass
class Plan:
    """What all models share, and per model (application, fold) the cuts of its features and its mean."""

    cuts: dict[tuple[str, int], list[np.ndarray]]
    means: dict[tuple[str, int], float]
    classes: list[float]
    trees: int
    depth: int
    seed: int
    subset: bool

    @property
    def width(self) -> int:
        return 1 + max((len(c) for cuts in self.cuts.values() for c in cuts), default=0)


def planned(rows: DataFrame, classify: bool, bins: int, **options) -> Plan:
    """Cuts at quantiles of the model's training rows; at every value where an application has few.

    What reaches the driver are ``bins - 1`` numbers per model and feature, a mean per model, and the classes.
    """
    probs = [i / bins for i in range(1, bins)]
    folds = rows.select("vca", F.col("fold").cast("int").alias("model")).distinct()
    train = rows.join(F.broadcast(folds), "vca").where(F.col("fold") != F.col("model"))
    values = rows.select("vca", F.posexplode("x").alias("pos", "value")).distinct()
    few = values.groupBy("vca", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", probs).alias("every")
    )
    often = (
        train.select("vca", "model", F.posexplode("x").alias("pos", "value"))
        .groupBy("vca", "model", "pos")
        .agg(F.percentile_approx("value", probs).alias("often"))
    )
    chosen_cuts = often.join(few, ["vca", "pos"]).select(
        "vca", "model", "pos", F.array_distinct(F.when(F.col("n") <= bins, F.col("every")).otherwise(F.col("often")))
    )
    cuts: dict[tuple[str, int], list[np.ndarray]] = {}
    for vca, model, _, at in chosen_cuts.orderBy("vca", "model", "pos").collect():
        cuts.setdefault((vca, model), []).append(np.array(at, dtype=float))
    means, classes = {}, []
    if classify:
        seen = rows.groupBy("gt").count().collect()
        classes = [r["gt"] for r in sorted(seen, key=lambda r: (-r["count"], str(r["gt"])))]
    else:
        # A centre to count from; rounded, as the last digits of a mean depend on the order of rows.
        means = {(r[0], r[1]): float(np.float32(r[2])) for r in train.groupBy("vca", "model").agg(F.avg("gt")).collect()}
    return Plan(cuts, means, classes, subset=classify, **options)


def blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Binned rows as bytes, once per model of their application."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vca, part in batch.groupby("vca"):
                x = np.stack(part["x"].to_numpy()).astype(float)
                y = part["gt"].to_numpy(dtype=float)
                for (app, model), cuts in plan.cuts.items():
                    if app != vca:
                        continue
                    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)]).astype(np.uint8)
                    if plan.classes:
                        target = np.select([y == c for c in plan.classes], range(len(plan.classes)), -1.0)
                    else:
                        target = y - plan.means[app, model]
                    out.append((
                        vca, model, len(part),
                        part["id"].to_numpy(dtype=np.int64).tobytes(),
                        part["key"].to_numpy(dtype=np.int64).tobytes(),
                        target.tobytes(), (part["fold"].to_numpy() == model).tobytes(), binned.tobytes(),
                    ))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in BLOCKS.split(", ")])

    return rows.select("vca", "fold", "id", "key", "gt", "x").mapInPandas(cut, BLOCKS)


def _answer(plan: Plan):
    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        vca, model, group = key
        bins = np.concatenate(
            [np.frombuffer(b, np.uint8).reshape(-1, n) for b, n in zip(part["bins"], part["n"])], 1
        )
        kinds = {"ids": np.int64, "keys": np.int64, "ys": float, "tests": bool}
        ids, keys, y, test = (np.concatenate([np.frombuffer(b, t) for b in part[c]]) for c, t in kinds.items())
        # One order, so that sums repeat to the last digit.
        order = np.argsort(keys, kind="stable")
        ids, keys, y, test, bins = ids[order], keys[order], y[order], test[order], bins[:, order]
        learned, asked = np.ascontiguousarray(bins[:, ~test]), np.ascontiguousarray(bins[:, test])
        classes = len(plan.classes)
        said = np.zeros((max(classes, 1), asked.shape[1]))
        gains = np.zeros(len(bins))
        subset = int(np.ceil(np.sqrt(len(bins)))) if plan.subset else None
        mine = range(group * GROUP, min((group + 1) * GROUP, plan.trees))
        # Few rows: all trees in the same steps.
        step = max(1, min(GROUP, AT_ONCE // max(len(keys), 1)))
        for first in mine[::step]:
            seeds = [(plan.seed * 1_000 + model) * 10_000 + t for t in mine if first <= t < first + step]
            w = np.stack([weights(keys[~test], s) for s in seeds])
            w[~w.any(1)] = 1
            more, got = grow(learned, y[~test], w, asked, plan.width, classes, plan.depth, subset, seeds)
            said += more
            gains += (got / np.maximum(got.sum(1, keepdims=True), 1e-300)).sum(0)
        if not classes:
            said += plan.means[vca, model] * len(mine)
        asked_ids = ids[test]
        found = pd.DataFrame({"id": pd.array(asked_ids, dtype="Int64"), "said": list(said.T), "gains": None})
        total = pd.DataFrame({"id": pd.array([None], dtype="Int64"), "said": [None], "gains": [gains]})
        return pd.concat([found, total]).assign(vca=vca, model=model, part=group)[
            ["vca", "model", "part", "id", "said", "gains"]
        ]

    return answer


def answers(rows: DataFrame, plan: Plan) -> DataFrame:
    """Per group of trees: its sums for every test row, and its features' gains (``id`` null)."""
    groups = -(-plan.trees // GROUP)
    keys = ["vca", "model", "part"]
    dealt = blocks(rows, plan).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Bytes say little about the work: groups are dealt by number, not put together by size.
    dealt = dealt.repartition(max(1, 2 * len(plan.cuts) * groups), *keys)
    return dealt.groupBy(*keys).applyInPandas(_answer(plan), ANSWERS)


def _summed(of: str):
    """Arrays of all groups added element by element, in the order of the groups."""
    some = F.transform(F.array_sort(F.collect_list(F.struct("part", of))), lambda s: s[of])
    return F.aggregate(F.slice(some, 2, 1 << 30), some[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))


def cross_predicted(rows: DataFrame, classify: bool, trees: int, depth: int, bins: int, seed: int):
    """(rows with ``pred`` by the model that was not given their fold, gains per model and feature position).

    ``rows`` has vca, fold, gt and features ``x``; an application's are equally wide.
    """
    keyed = rows.withColumn("key", F.xxhash64(*rows.columns)).withColumn("id", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed)
    plan = planned(keyed, classify, bins, trees=trees, depth=depth, seed=seed)
    found = answers(keyed, plan)
    said = found.where(F.col("id").isNotNull()).groupBy("id").agg(_summed("said").alias("said"))
    if classify:
        names = F.array(*[F.lit(float(c)) for c in plan.classes]) if plan.classes else F.array().cast("array<double>")
        pred = F.get(names, (F.array_position("said", F.array_max("said")) - 1).cast("int"))
    else:
        pred = F.col("said")[0] / trees
    predictions = keyed.join(said, "id").withColumn("pred", pred).drop("id", "key", "x", "said")
    gains = found.where(F.col("id").isNull()).groupBy("vca", "model").agg(_summed("gains").alias("gains"))
    gains = gains.select("vca", F.col("model").alias("fold"), F.posexplode("gains").alias("pos", "gain"))
    total = F.sum("gain").over(Window.partitionBy("vca", "fold"))
    return predictions, gains.select("vca", "fold", "pos", F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("score"))
