"""Leaf-wise gradient boosting on histograms (ML5).

Features are cut into at most 255 bins by one aggregate of quantiles, and rows are packed once into
blocks of binned features that stay persisted. A pass sums gradient, curvature and rows per
(leaf, feature, bin) inside each block; blocks of a task are added up before tasks are, and only
those histograms (leaves x bins, whatever the rows) reach the driver, which finds the splits.

A tree grows best-first to ``leaves`` leaves. The two children of every leaf that may still be
split are asked for in one pass, the smaller child's rows only: the larger's histogram is the
parent's less the smaller's. So a tree takes as many passes as it has levels, not splits, and is
the same tree that growing one split at a time gives.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BINS = 255
BLOCK_ROWS = 1 << 16
CHECKPOINT_EVERY = 10
MIN_CURVATURE = 1e-3


@dataclass
class Tree:
    """Flattened tree: node 0 is the root, ``left`` < 0 marks a leaf. Rows with x <= threshold go left."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray      # weighted rows that reached the node
    bin: np.ndarray        # threshold as a bin number

    def leaf_of(self, x: np.ndarray, cut: np.ndarray | None = None) -> np.ndarray:
        """Leaf of every row of ``x`` (values, or bins with ``cut`` = self.bin)."""
        cut = self.threshold if cut is None else cut
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            going = self.left[node] >= 0
            if not going.any():
                return node
            at = node[going]
            down = x[rows[going], self.feature[at]] <= cut[at]
            node[going] = np.where(down, self.left[at], self.right[at])


@dataclass
class Block:
    bins: np.ndarray    # rows x features, uint8
    y: np.ndarray
    w: np.ndarray
    score: np.ndarray


@dataclass
class BoostSettings:
    task: str = "classification"
    iterations: int = 100
    leaves: int = 31
    rate: float = 0.1
    min_rows: int = 20
    l2: float = 0.0
    max_bins: int = MAX_BINS


def _slopes(block: Block, task: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss per row."""
    if task == "regression":
        return block.w * (block.score - block.y), block.w
    p = 1.0 / (1.0 + np.exp(-block.score))
    return block.w * (p - block.y), block.w * p * (1.0 - p)


def _histograms(block: Block, task: str, tree: Tree, slot: np.ndarray, start: np.ndarray, width: int, wanted: int) -> np.ndarray:
    """(wanted leaves, bins of all features, 4) sums of gradient, curvature, rows and weight;
    ``slot`` numbers the wanted nodes (-1: not asked for)."""
    place = slot[tree.leaf_of(block.bins, tree.bin)]
    mine = np.flatnonzero(place >= 0)
    g, h = _slopes(block, task)
    out = np.zeros((wanted * width, 4))
    n_features = block.bins.shape[1]
    for lo in range(0, len(mine), 8192):  # bounds the index arrays
        rows = mine[lo:lo + 8192]
        at = (place[rows][:, None] * width + start[None, :] + block.bins[rows]).ravel()
        for k, v in enumerate((g, h, None, block.w)):
            weights = None if v is None else np.repeat(v[rows], n_features)
            out[:, k] += np.bincount(at, weights, wanted * width)
    return out.reshape(wanted, width, 4)


def best_split(hist: np.ndarray, start: np.ndarray, stop: np.ndarray, s: BoostSettings) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's best split, ties to the first feature and bin; gain 0 if none."""
    total = hist[start[0]:stop[0]].sum(axis=0)
    whole = total[0] ** 2 / (total[1] + s.l2) if total[1] + s.l2 > 0 else 0.0
    best = (0.0, -1, -1)
    for f, (a, b) in enumerate(zip(start, stop, strict=True)):
        left = np.cumsum(hist[a:b], axis=0)[:-1]
        right = total - left
        ok = (left[:, 2] >= s.min_rows) & (right[:, 2] >= s.min_rows) & (left[:, 1] >= MIN_CURVATURE) & (right[:, 1] >= MIN_CURVATURE)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[:, 0] ** 2 / (left[:, 1] + s.l2) + right[:, 0] ** 2 / (right[:, 1] + s.l2) - whole, 0.0)
        k = int(gain.argmax())
        if gain[k] > best[0] * (1 + 1e-12) + 1e-12:
            best = (float(gain[k]), f, k)
    return best


class _Grower:
    """The nodes expanded so far; the final tree is what best-first growth picks of them."""

    def __init__(self, root: np.ndarray, start, stop, cuts, s: BoostSettings):
        self.start, self.stop, self.cuts, self.s = start, stop, cuts, s
        self.hist, self.split, self.kids = [root], [best_split(root, start, stop, s)], {}
        self.total = [root[start[0]:stop[0]].sum(axis=0)]  # any feature's bins hold all of a node's rows

    def growth(self) -> tuple[list[int], list[int]]:
        """(nodes split, best-first; nodes to expand before more can be said)."""
        heap, done, leaves = [(-self.split[0][0], 0)], [], 1
        while heap and leaves < self.s.leaves:
            gain, node = heap[0]
            if gain >= 0:
                break
            if node not in self.kids:
                return done, [n for g, n in sorted(heap) if g < 0 and n not in self.kids][:self.s.leaves - leaves]
            heapq.heappop(heap)
            done.append(node)
            leaves += 1
            for kid in self.kids[node]:
                heapq.heappush(heap, (-self.split[kid][0], kid))
        return done, []

    def expand(self, nodes: list[int]) -> list[int]:
        """Give ``nodes`` children; the smaller one of each, whose rows are to be summed."""
        small = []
        for n in nodes:
            _, f, k = self.split[n]
            left, total = self.hist[n][self.start[f]:self.start[f] + k + 1].sum(axis=0)[2], self.total[n][2]
            self.kids[n] = (len(self.hist), len(self.hist) + 1)
            for kept in (self.hist, self.split, self.total):
                kept += [None, None]
            small.append(self.kids[n][0 if left <= total - left else 1])
        return small

    def fill(self, nodes: list[int], small: list[int], summed: np.ndarray) -> None:
        for n, child, hist in zip(nodes, small, summed, strict=True):
            left, right = self.kids[n]
            other = right if child == left else left
            self.hist[child], self.hist[other] = hist, self.hist[n] - hist
            for kid in (left, right):
                self.split[kid] = best_split(self.hist[kid], self.start, self.stop, self.s)
                self.total[kid] = self.hist[kid][self.start[0]:self.stop[0]].sum(axis=0)
            self.hist[n] = None

    def tree(self, only: list[int] | None = None) -> tuple[Tree, np.ndarray]:
        """The tree of all expanded nodes, or of the ``only`` split ones; and each node's number here."""
        split = set(self.kids) if only is None else set(only)
        order, at = [0], 0
        while at < len(order):
            if order[at] in split:
                order += self.kids[order[at]]
            at += 1
        number = {n: i for i, n in enumerate(order)}
        size = len(order)
        t = Tree(np.zeros(size, np.int32), np.zeros(size), np.full(size, -1, np.int32), np.full(size, -1, np.int32),
                 np.zeros(size), np.zeros(size), np.zeros(size, np.int32))
        for i, n in enumerate(order):
            if n in split:
                _, f, k = self.split[n]
                t.feature[i], t.bin[i], t.threshold[i] = f, k, self.cuts[f][k]
                t.left[i], t.right[i] = (number[x] for x in self.kids[n])
        return t, np.array(order)


def cut_points(df: DataFrame, n_features: int, max_bins: int) -> list[np.ndarray]:
    """Ascending bin borders of every feature of the array column ``x``; a bin holds (border before, border]."""
    probs = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"p{i}") for i in range(n_features)]).first()
    return [np.unique(np.array(row[i] or [0.0])) for i in range(n_features)]


class HistogramBoosting:
    """Estimator over (features vector, label, weight) rows."""

    def __init__(self, settings: BoostSettings, label: str, weight: str | None = None):
        self.settings, self.label, self.weight = settings, label, weight

    def blocks(self, df: DataFrame, cuts: list[np.ndarray], base: float, rows: int):
        def pack(batches):
            for batch in batches:
                n = batch.num_rows
                if n:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bins.tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                         pa.array([batch.column(2).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["bins", "y", "w"])

        def block(r):
            y = np.frombuffer(r.y)
            return Block(np.frombuffer(r.bins, np.uint8).reshape(len(y), -1), y, np.frombuffer(r.w), np.full(len(y), base))

        packed = df.mapInArrow(pack, "bins binary, y binary, w binary").rdd
        parts = max(1, -(-rows // BLOCK_ROWS))
        return (packed.coalesce(parts) if parts < packed.getNumPartitions() else packed).map(block)

    def fit(self, train: DataFrame) -> HistogramBoostingModel:
        s = self.settings
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        df = train.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w"))
        one = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.sum(F.col("y") * F.col("w")).alias("yw"),
                     F.sum("w").alias("w")).first()
        if not one.n:
            raise ValueError("no rows to fit")
        mean = one.yw / one.w
        if s.task == "regression":
            base = mean
        elif 0 < mean < 1:
            base = float(np.log(mean / (1 - mean)))
        else:
            raise ValueError("one class only")
        cuts = cut_points(df, one.d, s.max_bins)
        sizes = np.array([len(c) + 1 for c in cuts])
        stop = np.cumsum(sizes)
        start, width = stop - sizes, int(stop[-1])
        rdd = self.blocks(df, cuts, base, one.n).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[Tree] = []

        def summed(tree: Tree, slot: np.ndarray, wanted: int) -> np.ndarray:
            task = s.task

            def run(blocks):
                total = None
                for b in blocks:
                    h = _histograms(b, task, tree, slot, start, width, wanted)
                    total = h if total is None else total + h
                return [] if total is None else [total]

            return rdd.mapPartitions(run).treeReduce(np.add) if rdd.getNumPartitions() > 64 else rdd.mapPartitions(run).reduce(np.add)

        leaf = Tree(*(np.array([v]) for v in (0, 0.0, -1, -1, 0.0, 0.0, 0)))
        for i in range(s.iterations):
            grower = _Grower(summed(leaf, np.zeros(1, np.int64), 1)[0], start, stop, cuts, s)
            done, ask = grower.growth()
            while ask:
                small = grower.expand(ask)
                tree, order = grower.tree()
                slot = np.full(len(order), -1)
                where = {n: k for k, n in enumerate(order.tolist())}
                for k, n in enumerate(small):
                    slot[where[n]] = k
                grower.fill(ask, small, summed(tree, slot, len(small)))
                done, ask = grower.growth()
            tree, order = grower.tree(done)
            for k, n in enumerate(order):
                g, h, _, tree.cover[k] = grower.total[n]
                tree.value[k] = -s.rate * g / (h + s.l2) if tree.left[k] < 0 and h + s.l2 > 0 else 0.0
            if not done:
                break  # no split gains anything any more
            trees.append(tree)
            if i + 1 < s.iterations:
                before = rdd
                rdd = before.map(_step(tree)).persist(StorageLevel.MEMORY_AND_DISK)
                if (i + 1) % CHECKPOINT_EVERY == 0:
                    rdd.checkpoint()
                rdd.count()
                before.unpersist()
        rdd.unpersist()
        return HistogramBoostingModel(s, base, trees)


def _step(tree: Tree):
    return lambda b: Block(b.bins, b.y, b.w, b.score + tree.value[tree.leaf_of(b.bins, tree.bin)])


class HistogramBoostingModel:
    def __init__(self, settings: BoostSettings, base: float, trees: list[Tree]):
        self.settings, self.base, self.trees = settings, base, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of base and leaf values of rows of plain features."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(x)]
        return out

    def _column(self) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype="float64")
            raw = model.raw(np.stack(x.to_numpy()))
            return pd.Series(raw if model.settings.task == "regression" else 1.0 / (1.0 + np.exp(-raw)))

        return score(vector_to_array("features"))

    def score(self, feat: DataFrame, out: str) -> DataFrame:
        """Probability of the positive class, or the predicted value, of every row."""
        return feat.withColumn(out, self._column())
