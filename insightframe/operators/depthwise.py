"""Depth-wise gradient boosting on merged rows (ML5).

What a tree learns of rows of equal bins hangs on their sums alone: their scores are equal, so are the
residuals of equal labels. So features are cut into at most 32 bins, rows of equal bins (and, of classes,
equal labels) are merged once into cells, and boosting runs on cells. Trees, residuals and rate are
MLlib's: variance splits level by level, a first tree on the labels with weight 1, then trees on the
residuals 2 (y - F), or 4 y / (1 + exp(2 y F)) for labels of -1 and 1.

At most ``LOCAL_CELLS`` cells are boosted in one task. More are dealt in blocks that stay persisted with
their scores; a pass a level sums weight, cells and residuals per (node, feature, bin), and only these
sums (2 to the level x features x bins, whatever the rows) reach the driver.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import CHECKPOINT_EVERY, Tree
from .forest import LOCAL_CELLS, MAX_BINS, best_splits, bin_borders, binned

BLOCK_CELLS = 1 << 16
CELLS_AT_ONCE = 1 << 13
SAME_GAIN = 1e-9      # gains this near are equal: rounding picks no split
TREE_DDL = "tree int, node int, feature int, bin int, left int, right int, value double, cover double"


@dataclass
class DepthwiseSettings:
    task: str = "classification"
    iterations: int = 100
    depth: int = 5
    rate: float = 0.1
    max_bins: int = MAX_BINS


@dataclass
class Cells:
    bins: np.ndarray     # cells x features, uint8
    w: np.ndarray        # weight of a cell's rows
    y: np.ndarray        # their mean label; of classes -1 or 1
    score: np.ndarray


def residual_sums(c: Cells, task: str, first: bool) -> np.ndarray:
    """Weighted sum of each cell's residuals; the first tree's are the labels."""
    if first:
        return c.w * c.y
    if task == "regression":
        return 2.0 * c.w * (c.y - c.score)
    return 4.0 * c.w * c.y / (1.0 + np.exp(np.minimum(2.0 * c.y * c.score, 700.0)))


def level_sums(c: Cells, s: DepthwiseSettings, first: bool, tree: Tree, slot: np.ndarray, wanted: int, width: int) -> np.ndarray:
    """(wanted nodes, features, bins, 3) sums of weight, cells and residuals; ``slot`` numbers the tree's
    wanted nodes (-1: not asked for)."""
    place = slot[tree.leaf_of(c.bins, tree.bin)]
    target = residual_sums(c, s.task, first)
    mine = np.flatnonzero(place >= 0)
    d = c.bins.shape[1]
    out = np.zeros((3, wanted * d * width))
    for lo in range(0, len(mine), CELLS_AT_ONCE):  # bounds the index arrays
        at = mine[lo:lo + CELLS_AT_ONCE]
        where = ((place[at][:, None] * d + np.arange(d)[None]) * width + c.bins[at]).ravel()
        for k, v in enumerate((c.w, None, target)):
            out[k] += np.bincount(where, None if v is None else np.repeat(v[at], d), wanted * d * width)
    return out.T.reshape(wanted, d, width, 3)


def grown(sums: Callable[[Tree, np.ndarray, int], np.ndarray], s: DepthwiseSettings) -> Tree:
    """One tree: ``sums(tree so far, slot, wanted)`` gives a level's sums of all rows."""
    feature, cut, left, right, value, cover = [0], [0], [-1], [-1], [0.0], [0.0]

    def tree() -> Tree:
        return Tree(np.array(feature, np.int32), np.zeros(len(feature)), np.array(left, np.int32), np.array(right, np.int32),
                    np.array(value), np.array(cover), np.array(cut, np.int32))

    level = [0]
    for _ in range(s.depth):
        slot = np.full(len(feature), -1)
        slot[level] = np.arange(len(level))
        found = sums(tree(), slot, len(level))
        gain, place, border = best_splits(found, SAME_GAIN)
        kids = []
        for i, node in enumerate(level):
            total = found[i, 0].sum(axis=0)
            value[node], cover[node] = total[2] / total[0], total[0]
            if gain[i] <= 0:
                continue
            feature[node], cut[node] = int(place[i]), int(border[i])
            below = found[i, place[i], :border[i] + 1].sum(axis=0)
            left[node], right[node] = len(feature), len(feature) + 1
            for part in (below, total - below):
                kids.append(len(feature))
                for column, v in ((feature, 0), (cut, 0), (left, -1), (right, -1), (value, part[2] / part[0]), (cover, part[0])):
                    column.append(v)
        level = kids
        if not level:
            break
    return tree()


def _weight(i: int, s: DepthwiseSettings) -> float:
    return s.rate if i else 1.0


def boosted_here(c: Cells, s: DepthwiseSettings, width: int) -> list[Tree]:
    trees = []
    for i in range(s.iterations):
        tree = grown(lambda t, slot, wanted, i=i: level_sums(c, s, i == 0, t, slot, wanted, width), s)
        trees.append(tree)
        c.score = c.score + _weight(i, s) * tree.value[tree.leaf_of(c.bins, tree.bin)]
    return trees


class DepthwiseBoosting:
    """Estimator over (features vector, label, weight) rows."""

    def __init__(self, settings: DepthwiseSettings, label: str, weight: str | None = None):
        self.settings, self.label, self.weight = settings, label, weight

    def fit(self, train: DataFrame) -> DepthwiseModel:
        from ..session import written

        s = self.settings
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        df = train.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w")).where("w > 0")
        one = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"),
                     F.min(F.col("y").isin(0.0, 1.0).cast("int")).alias("two")).first()
        if not one.n:
            raise ValueError("no rows to fit")
        if s.task != "regression" and not one.two:
            raise ValueError("boosting takes the labels 0 and 1")
        # sums of centred values keep their digits
        base = float(np.float32(one.mean)) if s.task == "regression" else 0.0
        label = F.col("y") - F.lit(base) if s.task == "regression" else F.col("y") * 2 - 1
        d = one.d
        borders = bin_borders(df, d, s.max_bins)
        width = max(1, *(len(b) for b in borders)) + 1  # a border at least, also where every feature is constant

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    cells = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), borders)
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cells], pa.binary()), batch.column(1), batch.column(2)],
                                                     ["bins", "y", "w"])

        packed = df.withColumn("y", label).mapInArrow(pack, "bins binary, y double, w double")
        same = ["bins"] if s.task == "regression" else ["bins", "y"]
        cells = packed.groupBy(*same).agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")) \
            .select("bins", "w", F.col("mean").alias("y"))
        cells = written(cells, "boost-cells")
        n = cells.count()
        trees = self._in_one_task(cells, s, d, width) if n <= LOCAL_CELLS else self._in_passes(cells, s, d, width, n)
        return DepthwiseModel(s, base, borders, trees)

    @staticmethod
    def _in_one_task(cells: DataFrame, s: DepthwiseSettings, d: int, width: int) -> list[Tree]:
        def run(batches):
            table = pa.Table.from_batches(list(batches))
            if not table.num_rows:
                return
            raw = table.column("bins").to_pylist()
            y, w = (table.column(c).to_numpy() for c in ("y", "w"))
            order = sorted(range(len(raw)), key=lambda i: (raw[i], y[i]))  # one order, one sum
            c = Cells(np.frombuffer(b"".join(raw[i] for i in order), np.uint8).reshape(len(raw), d), w[order], y[order], np.zeros(len(raw)))
            for i, t in enumerate(boosted_here(c, s, width)):
                k = len(t.left)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, i, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(t.feature),
                                                  pa.array(t.bin), pa.array(t.left), pa.array(t.right), pa.array(t.value), pa.array(t.cover)],
                                                 [x.split()[0] for x in TREE_DDL.split(", ")])

        per: dict[int, list] = {}
        for r in cells.coalesce(1).mapInArrow(run, TREE_DDL).collect():  # the model itself
            per.setdefault(r.tree, []).append(r)
        out = []
        for i in sorted(per):
            nodes = sorted(per[i], key=lambda r: r.node)
            ints = [np.array([r[c] for r in nodes], np.int32) for c in ("feature", "left", "right", "bin")]
            out.append(Tree(ints[0], np.zeros(len(nodes)), ints[1], ints[2], *(np.array([r[c] for r in nodes]) for c in ("value", "cover")), ints[3]))
        return out

    @staticmethod
    def _in_passes(cells: DataFrame, s: DepthwiseSettings, d: int, width: int, n: int) -> list[Tree]:
        def block(batches):
            for batch in batches:
                if batch.num_rows:
                    columns = (b"".join(batch.column("bins").to_pylist()), *(batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("y", "w")))
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], ["bins", "y", "w"])

        def opened(r):
            y = np.frombuffer(r.y)
            return Cells(np.frombuffer(r.bins, np.uint8).reshape(len(y), d), np.frombuffer(r.w), y, np.zeros(len(y)))

        parts = max(1, -(-n // BLOCK_CELLS))
        rdd = cells.repartition(parts, "bins").mapInArrow(block, "bins binary, y binary, w binary").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[Tree] = []
        for i in range(s.iterations):

            def sums(tree: Tree, slot: np.ndarray, wanted: int, first: bool = i == 0, rdd=rdd) -> np.ndarray:
                def run(blocks):
                    total = None
                    for c in blocks:
                        found = level_sums(c, s, first, tree, slot, wanted, width)
                        total = found if total is None else total + found
                    return [] if total is None else [total]

                each = rdd.mapPartitions(run)
                return each.treeReduce(np.add) if rdd.getNumPartitions() > 64 else each.reduce(np.add)

            tree = grown(sums, s)
            trees.append(tree)
            if i + 1 < s.iterations:
                before = rdd
                rdd = before.map(_step(tree, _weight(i, s))).persist(StorageLevel.MEMORY_AND_DISK)
                if (i + 1) % CHECKPOINT_EVERY == 0:
                    rdd.checkpoint()
                rdd.count()
                before.unpersist()
        rdd.unpersist()
        return trees


def _step(tree: Tree, weight: float):
    return lambda c: Cells(c.bins, c.w, c.y, c.score + weight * tree.value[tree.leaf_of(c.bins, tree.bin)])


class DepthwiseModel:
    def __init__(self, settings: DepthwiseSettings, base: float, borders: list[np.ndarray], trees: list[Tree]):
        self.settings, self.base, self.borders, self.trees = settings, base, borders, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Base and weighted leaf values of rows of plain features, added up."""
        cells, back = np.unique(binned(x, self.borders), axis=0, return_inverse=True)
        out = np.full(len(cells), self.base)
        for i, t in enumerate(self.trees):
            out += _weight(i, self.settings) * t.value[t.leaf_of(cells, t.bin)]
        return out[back.reshape(-1)]

    def _column(self) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype="float64")
            raw = model.raw(np.stack(x.to_numpy()))
            return pd.Series(raw if model.settings.task == "regression" else 1.0 / (1.0 + np.exp(-2.0 * raw)))

        return score(vector_to_array("features"))

    def score(self, feat: DataFrame, out: str) -> DataFrame:
        """Probability of class 1, or the predicted value, of every row."""
        return feat.withColumn(out, self._column())
