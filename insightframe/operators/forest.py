"""Random forest on histograms (ML4).

Features are cut into at most 32 bins, and rows of equal bins, label and weight are merged and counted:
the sum of n rows' Poisson(1) draws is Poisson(n), so a tree's bootstrap weights come from the counts.
Rows are dealt by their bins, so a task adds a tree's rows of one cell (equal bins) before any shuffle.

Trees grow level by level. While a node holds more than ``LOCAL_CELLS`` cells, a pass sums weight, rows
and targets per (tree, node, chosen feature, bin), Spark adds them and picks each node's split. Smaller
nodes are dealt whole, a group per (tree, node), and grown to the end there, so a tree of any size
takes as many passes as it has levels of large nodes, and one more. A node's features are chosen by a
hash of tree and node: the same forest for the same rows, weights and seed.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Tree

MAX_BINS = 32
LOCAL_CELLS = 1 << 15
NODES_AT_ONCE = 1 << 11
GAIN_NOISE = 1e-10   # of a node's sum of squares: what rounding alone can gain
ROWS_A_PART = 1 << 17
SPREAD_ROWS = 1 << 13  # fewer rows than this a core are not worth dealing
NODE_DDL = "tree int, node long, feature int, bin int, value double, cells long, left_cells long"


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def chosen(seed: int, tree: int, nodes: np.ndarray, n_features: int, take: int) -> np.ndarray:
    """(nodes, take) ascending features that each node may split on."""
    base = _mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    key = _mixed(nodes.astype(np.uint64) + base)[:, None] + _mixed(np.arange(1, n_features + 1, dtype=np.uint64))[None]
    return np.sort(np.argsort(_mixed(key), axis=1, kind="stable")[:, :take], axis=1)


def draw_tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first draw, place in the table, table) for Poisson draws with the given means: the distribution
    functions of the distinct means, out to 12 deviations, one after the other and each 1 higher."""
    means, which = np.unique(counts, return_inverse=True)
    first, parts, at = [], [], [0]
    for i, n in enumerate(means.tolist()):
        lo, hi = max(0, int(n - 12 * n ** 0.5 - 20)), int(n + 12 * n ** 0.5 + 30)
        log = np.concatenate([[0.0], np.cumsum(np.log(n / np.arange(lo + 1, hi + 1)))])
        share = np.cumsum(np.exp(log - log.max()))
        first.append(lo)
        parts.append(i + share / share[-1])
        at.append(at[-1] + len(share))
    return np.stack([np.array(first)[which], np.array(at[:-1])[which]]), which.astype(float), np.concatenate(parts)


def drawn(tables, hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Bootstrap draws of a tree: a row's hang on its hash alone, however rows are dealt."""
    (first, at), which, table = tables
    u = (_mixed(hashes ^ _mixed(np.array([seed * 2_000_003 + tree + 1], np.uint64))) >> np.uint64(11)) * 2.0 ** -53
    return first + np.maximum(np.searchsorted(table, which + u, side="right") - at, 0)


def positions(bins: np.ndarray, place: np.ndarray, picked: np.ndarray, width: int) -> np.ndarray:
    """(cells, take) places of the cells in sums laid out as (node, chosen feature, bin)."""
    take = picked.shape[1]
    return (place[:, None] * take + np.arange(take)[None]) * width + bins[np.arange(len(bins))[:, None], picked[place]]


def split_gains(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain of every node's (feature, bin) splits, each node's sum of squares) from (node, feature, bin,
    statistic) sums of weight, cells and targets; 0 where a side is empty. On class indicators what a
    split gains is the Gini impurity, on values the variance."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    whole = (total[:, 2:] ** 2).sum(axis=1) / total[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 2:] ** 2).sum(axis=3) / left[..., 0] + (right[..., 2:] ** 2).sum(axis=3) / right[..., 0] - whole[:, None, None]
    return np.where((left[..., 1] >= 1) & (right[..., 1] >= 1), gain, 0.0).reshape(len(sums), -1), whole


def best_splits(sums: np.ndarray, tie: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, place of the chosen feature, bin) of every node; gain 0 if no split gains anything, ties (to
    within ``tie`` of the gain) to the first."""
    gain, whole = split_gains(sums)
    top = gain.max(axis=1)
    at = (gain >= top[:, None] - tie * np.abs(top[:, None])).argmax(axis=1)
    borders = sums.shape[2] - 1
    return np.where(top > GAIN_NOISE * whole, top, 0.0), at // borders, at % borders


def grown(tree: int, root: int, bins: np.ndarray, stats: np.ndarray, width: int, s: ForestSettings, take: int) -> list[tuple]:
    """(node, feature, bin, value, cells) of a node's whole subtree, feature -1 at leaves; children of
    node i are 2 i and 2 i + 1."""
    out = []
    place, nodes = np.zeros(len(bins), np.int64), np.array([root])
    while len(nodes):
        order = np.argsort(place, kind="stable")
        bins, stats, place = bins[order], stats[order], place[order]
        below, kids, kept = np.zeros(len(bins), np.int64), [], np.zeros(len(bins), bool)
        for lo in range(0, len(nodes), NODES_AT_ONCE):  # bounds the sums
            part = nodes[lo:lo + NODES_AT_ONCE]
            a, b = np.searchsorted(place, [lo, lo + len(part)])
            mine, at = bins[a:b], place[a:b] - lo
            total = np.stack([np.bincount(at, stats[a:b, k], len(part)) for k in range(stats.shape[1])], axis=1)
            if int(part[0]).bit_length() <= s.depth:
                picked = chosen(s.seed, tree, part, bins.shape[1], take)
                where = positions(mine, at, picked, width).ravel()
                sums = np.stack([np.bincount(where, np.repeat(stats[a:b, k], take), len(part) * take * width)
                                 for k in range(stats.shape[1])], axis=1).reshape(len(part), take, width, -1)
                gain, j, cut = best_splits(sums)
                feature = np.where(gain > 0, picked[np.arange(len(part)), j], -1)
            else:
                feature, cut = np.full(len(part), -1), np.zeros(len(part), np.int64)
            value = total[:, 2 + s.scored] / total[:, 0]
            out += zip(part.tolist(), feature.tolist(), cut.tolist(), value.tolist(), total[:, 1].astype(np.int64).tolist(), strict=True)
            number = np.cumsum(feature >= 0) - 1 + len(kids) // 2
            going = feature[at] >= 0
            down = mine[np.arange(len(at)), np.maximum(feature[at], 0)] > cut[at]
            below[a:b] = np.where(going, 2 * number[at] + down, 0)
            kept[a:b] = going
            kids += [k for n in part[feature >= 0].tolist() for k in (2 * n, 2 * n + 1)]
        bins, stats, place, nodes = bins[kept], stats[kept], below[kept], np.array(kids, np.int64)
    return out


@dataclass
class ForestSettings:
    task: str = "classification"
    trees: int = 200
    depth: int = 30
    seed: int = 42
    classes: int = 2

    @property
    def targets(self) -> int:
        """Target columns: the value, the second class's indicator of two, or all classes'."""
        return 1 if self.task == "regression" or self.classes <= 2 else self.classes

    @property
    def scored(self) -> int:
        return 1 if self.targets > 1 else 0


def bin_borders(df: DataFrame, n_features: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending borders of every feature of the array column ``x``: half-way between the values of a
    feature of at most ``max_bins`` values, quantiles of the others."""

    def few(batches):
        seen = [np.zeros(0)] * n_features
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            seen = [v if len(v) > max_bins else np.unique(np.concatenate([v, np.unique(x[:, i])]))[:max_bins + 1]
                    for i, v in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n_features, dtype=np.int32), [len(v) for v in seen])),
                                          pa.array(np.concatenate(seen))], ["i", "v"])

    values = {r["i"]: r["vs"] for r in df.select("x").mapInArrow(few, "i int, v double").groupBy("i").agg(F.collect_set("v").alias("vs"))
              .select("i", F.when(F.size("vs") <= max_bins, F.col("vs")).alias("vs")).collect()}
    many = [i for i in range(n_features) if values.get(i, []) is None]
    probs = [i / max_bins for i in range(1, max_bins)]
    cuts = df.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"p{i}") for i in many]).first() if many else None
    out = []
    for i in range(n_features):
        v = np.unique(np.array(cuts[f"p{i}"] if i in many else values.get(i, []), float))
        out.append(v if i in many else (v[1:] + v[:-1]) / 2)
    return out


def binned(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)], axis=1).astype(np.uint8)


class HistogramForest:
    """Estimator over (features vector, label, weight) rows."""

    def __init__(self, settings: ForestSettings, label: str, weight: str | None = None):
        self.settings, self.label, self.weight = settings, label, weight

    def fit(self, train: DataFrame) -> ForestModel:
        from ..session import written

        s = self.settings
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        df = train.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w")).where("w > 0")
        one = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max("y").alias("top"), F.avg("y").alias("mean"),
                     F.min(((F.col("y") >= 0) & (F.col("y") == F.floor("y"))).cast("int")).alias("classes")).first()
        if not one.n:
            raise ValueError("no rows to fit")
        if s.task != "regression":
            if not one.classes:
                raise ValueError("labels are not class numbers")
            s = ForestSettings(s.task, s.trees, s.depth, s.seed, max(2, int(one.top) + 1))
        # sums of centred values keep their digits; a short number, so that the mean's own rounding moves nothing
        base = float(np.float32(one.mean)) if s.task == "regression" else 0.0
        d = one.d
        take = -(-d // 3) if s.task == "regression" else int(np.ceil(np.sqrt(d)))
        borders = bin_borders(df, d)
        width = max(len(b) for b in borders) + 1

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    cells = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), borders)
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary()), batch.column(1), batch.column(2)],
                                                     ["bins", "y", "w"])

        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, -(-one.n // ROWS_A_PART))
        # a table written once comes back in as few parts as it has files, and would be packed by as few cores
        dealt = df.repartition(max(min(cores, one.n // SPREAD_ROWS), -(-one.n // ROWS_A_PART))) if one.n >= 2 * SPREAD_ROWS else df
        rows = dealt.mapInArrow(pack, "bins binary, y double, w double").groupBy("bins", "y", "w").agg(F.count(F.lit(1)).alias("n")) \
            .withColumn("h", F.xxhash64("bins", "y", "w"))
        rows = written(rows.repartition(parts, "bins").sortWithinPartitions("bins", "y", "w"), "forest-rows")
        return ForestModel(s, base, borders, self._grow(rows, s, base, d, take, width))

    @staticmethod
    def _grow(rows: DataFrame, s: ForestSettings, base: float, d: int, take: int, width: int) -> list[Tree]:
        k = 2 + s.targets
        stat_names = [f"s{i}" for i in range(k)]
        trees = list(range(s.trees))
        n_cells = rows.select("bins").distinct().count()
        done: dict[int, dict[int, tuple]] = {t: {} for t in trees}   # tree -> node -> (feature, bin, value, cells)
        large = {t: [1] for t in trees} if n_cells > LOCAL_CELLS else {t: [] for t in trees}
        small = {t: [] if large[t] else [1] for t in trees}

        def so_far() -> dict[int, tuple[Tree, np.ndarray]]:
            """Each tree as split until now, and its nodes' numbers."""
            out = {}
            for t in trees:
                nodes = done[t] | {n: (-1, 0, 0.0, 0) for n in large[t] + small[t]}
                out[t] = _flat(nodes), np.array(sorted(nodes))
            return out

        def samples(batch, wanted: dict[int, list[int]], known: dict[int, tuple[Tree, np.ndarray]]):
            """(tree, nodes, place, bins, stats) of the batch's cells in each tree's wanted nodes."""
            raw = batch.column("bins").to_pylist()
            y, w, n, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "n", "h"))
            all_bins = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), d)
            starts = np.flatnonzero(np.r_[True, (all_bins[1:] != all_bins[:-1]).any(axis=1)])  # rows lie by bins
            cell, bins = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(raw)])), all_bins[starts]
            target = (y - base)[None] if s.task == "regression" else \
                (y == 1.0)[None] if s.targets == 1 else y[None] == np.arange(s.classes)[:, None]
            tables, h = draw_tables(n), h.view(np.uint64)
            for t, nodes in wanted.items():
                if not nodes:
                    continue
                draw = drawn(tables, h, s.seed, t)
                weight = draw * w
                so_far, numbers = known[t]
                node = numbers[so_far.leaf_of(bins, so_far.bin)]
                got = np.bincount(cell, draw, len(bins)) > 0
                keep = got & np.isin(node, nodes)
                if keep.any():
                    stats = np.stack([np.bincount(cell, weight, len(bins)), np.ones(len(bins)),
                                      *[np.bincount(cell, weight * x, len(bins)) for x in target]], axis=1)
                    number = np.array(sorted(nodes))
                    yield t, number, np.searchsorted(number, node[keep]), bins[keep], stats[keep]

        while any(large.values()):
            wanted, known = dict(large), so_far()

            def partial(batches):
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    for t, number, place, bins, stats in samples(batch, wanted, known):
                        where = positions(bins, place, chosen(s.seed, t, number, d, take), width).ravel()
                        at, inverse = np.unique(where, return_inverse=True)
                        sums = [np.bincount(inverse, np.repeat(stats[:, i], take), len(at)) for i in range(k)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), t, np.int32)), pa.array(number[at // (take * width)]),
                             pa.array((at % (take * width)).astype(np.int32)), *[pa.array(x) for x in sums]], ["tree", "node", "at", *stat_names])

            def pick(key, table):
                t, node = key[0].as_py(), key[1].as_py()
                sums = np.zeros((take * width, k))
                sums[table.column("at").to_numpy()] = np.stack([table.column(c).to_numpy() for c in stat_names], axis=1)
                sums = sums.reshape(1, take, width, k)
                gain, j, cut = best_splits(sums)
                total = sums[0, 0].sum(axis=0)
                split = gain[0] > 0 and node.bit_length() <= s.depth
                feature = int(chosen(s.seed, t, np.array([node]), d, take)[0, j[0]]) if split else -1
                left = int(sums[0, j[0], :cut[0] + 1, 1].sum())
                out = (t, node, feature, int(cut[0]), float(total[2 + s.scored] / total[0]), int(total[1]), left)
                return pa.table([pa.array([v]) for v in out], names=["tree", "node", "feature", "bin", "value", "cells", "left_cells"]).cast(NODE_SCHEMA)

            ddl = "tree int, node long, at int, " + ", ".join(f"{c} double" for c in stat_names)
            found = rows.mapInArrow(partial, ddl).groupBy("tree", "node", "at").agg(*[F.sum(c).alias(c) for c in stat_names]) \
                .groupBy("tree", "node").applyInArrow(pick, NODE_DDL).collect()  # a row per large node
            large = {t: [] for t in trees}
            for r in found:
                done[r.tree][r.node] = (r.feature, r.bin, r.value, r.cells)
                if r.feature >= 0:
                    for kid, held in ((2 * r.node, r.left_cells), (2 * r.node + 1, r.cells - r.left_cells)):
                        (large if held > LOCAL_CELLS else small)[r.tree].append(kid)

        wanted, known = dict(small), so_far()

        def deal(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                for t, number, place, bins, stats in samples(batch, wanted, known):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bins), t, np.int32)), pa.array(number[place]), pa.array([b.tobytes() for b in bins], pa.binary()),
                         *[pa.array(stats[:, i]) for i in range(k)]], ["tree", "node", "bins", *stat_names])

        def finish(key, table):
            t, node = key[0].as_py(), key[1].as_py()
            raw = table.column("bins").to_pylist()
            # a cell lies in one task, in more than one batch at most at their borders: one order, one sum
            order = sorted(range(len(raw)), key=raw.__getitem__)
            bins = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).reshape(len(raw), d)
            stats = np.stack([table.column(c).to_numpy() for c in stat_names], axis=1)[order]
            starts = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)])
            stats = np.add.reduceat(stats, starts, axis=0)
            stats[:, 1] = 1.0
            sub = grown(t, node, bins[starts], stats, width, s, take)
            node_, feature, cut, value, cells = zip(*sub, strict=True)
            return pa.table([pa.array([t] * len(sub)), pa.array(node_), pa.array(feature), pa.array(cut), pa.array(value), pa.array(cells),
                             pa.array([0] * len(sub))], names=["tree", "node", "feature", "bin", "value", "cells", "left_cells"]).cast(NODE_SCHEMA)

        ddl = "tree int, node long, bins binary, " + ", ".join(f"{c} double" for c in stat_names)
        if groups := sum(len(nodes) for nodes in small.values()):
            # groups are work, not bytes: as many tasks as cores and groups ask for
            spread = min(groups, max(64, 4 * rows.sparkSession.sparkContext.defaultParallelism, groups // 16))
            for r in rows.mapInArrow(deal, ddl).repartition(spread, "tree", "node").groupBy("tree", "node") \
                    .applyInArrow(finish, NODE_DDL).collect():  # the model itself
                done[r.tree][r.node] = (r.feature, r.bin, r.value, r.cells)
        return [_flat(done[t]) for t in trees if done[t]]


NODE_SCHEMA = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("value", pa.float64()),
                         ("cells", pa.int64()), ("left_cells", pa.int64())])


def _flat(nodes: dict[int, tuple]) -> Tree:
    order = sorted(nodes)
    number = {n: i for i, n in enumerate(order)}
    kids = [[number[2 * n + side] if nodes[n][0] >= 0 else -1 for n in order] for side in (0, 1)]
    feature, cut, value, cells = (np.array(x) for x in zip(*[nodes[n] for n in order], strict=True))
    return Tree(np.maximum(feature, 0).astype(np.int32), np.zeros(len(order)), *(np.array(x, np.int32) for x in kids), value,
                cells.astype(float), cut.astype(np.int32))


class ForestModel:
    def __init__(self, settings: ForestSettings, base: float, borders: list[np.ndarray], trees: list[Tree]):
        self.settings, self.base, self.borders, self.trees = settings, base, borders, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaf's share of the scored class, or of its value."""
        cells, back = np.unique(binned(x, self.borders), axis=0, return_inverse=True)
        out = np.zeros(len(cells))
        for t in self.trees:
            out += t.value[t.leaf_of(cells, t.bin)]
        return self.base + (out / len(self.trees))[back.reshape(-1)]

    def _column(self) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(x):
            import pandas as pd
            return pd.Series(model.raw(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return score(vector_to_array("features"))

    def score(self, feat: DataFrame, out: str) -> DataFrame:
        """Probability of class 1, or the predicted value, of every row."""
        return feat.withColumn(out, self._column())
