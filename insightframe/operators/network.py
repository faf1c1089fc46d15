"""Multi-layer perceptron of one hidden layer (ML14).

The network, its start and its search are MLlib's: a sigmoid layer and a softmax, the mean cross entropy of
stacks of 128 rows, L-BFGS with ten corrections and a strong Wolfe line search, to the same tolerance.

The fits of all folds are searched side by side: their rows are packed once into blocks that stay persisted, dealt
over all cores, and a pass answers every search at once, so its cost beside the sums is paid once for all
fits. A task sums loss and gradient over whole blocks by matrix products, and only these sums (a number a weight)
leave it, from four tasks a core at most. The weights found are put into MLlib's models, which score rows.
"""
from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STACK = 128           # rows whose mean loss counts as one
BLOCK_ROWS = 1 << 10  # rows of a block, whole stacks
PART_ROWS = 1 << 19   # rows of a part at most, on average
ROWS_AT_ONCE = 1 << 10  # their hidden values stay in a core's cache
TASKS_A_CORE = 4
FEW_ROWS = 1 << 12    # fewer rows are fitted by MLlib, whose passes begin sooner
# of the search
CORRECTIONS = 10
VALUES_KEPT = 20
DECREASE, CURVATURE = 1e-4, 0.9
TRIES = 10


@dataclass
class NetworkSettings:
    layers: list[int]     # features, hidden, classes
    iterations: int = 500
    seed: int = 42
    tolerance: float = 1e-6


class SearchFailed(Exception):
    """No step can be taken in the direction asked for."""


def loss_sums(w: np.ndarray, layers: list[int], block: np.ndarray, room: np.ndarray) -> tuple[float, np.ndarray, int]:
    """(sum of the stacks' mean losses, its gradient, stacks) of a block's features, constant 1 and label;
    ``room`` is for two values a hidden unit of ``ROWS_AT_ONCE`` rows."""
    d, h, k = layers
    cut = (d + 1) * h
    first = -w[:cut].reshape(d + 1, h)  # the last row is the constant's
    second, constant = w[cut:-k].reshape(h, k), w[-k:]
    loss, n = 0.0, len(block)
    g1, g2, gk = np.zeros((d + 1, h)), np.zeros((h, k)), np.zeros(k)
    share = np.full(n, 1.0 / STACK)
    if n % STACK:
        share[n - n % STACK:] = 1.0 / (n % STACK)
    rows, label = np.ascontiguousarray(block[:, :-1]), block[:, -1].astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for lo in range(0, n, ROWS_AT_ONCE):
            x, y, part = rows[lo:lo + ROWS_AT_ONCE], label[lo:lo + ROWS_AT_ONCE], share[lo:lo + ROWS_AT_ONCE]
            hidden, back = room[0, :len(x), :h], room[1, :len(x), :h]
            np.matmul(x, first, out=hidden)
            np.exp(hidden, out=hidden)
            hidden += 1.0
            np.divide(1.0, hidden, out=hidden)
            out = hidden @ second
            out += constant
            out -= out.max(axis=1, keepdims=True)
            at = np.arange(len(x)), y
            mine = out[at]
            np.exp(out, out=out)
            total = out.sum(axis=1)
            loss += float(part @ (np.log(total) - mine))
            out /= total[:, None]
            out[at] -= 1.0
            out *= part[:, None]
            g2 += hidden.T @ out
            gk += out.sum(axis=0)
            np.matmul(out, second.T, out=back)
            back *= hidden
            np.subtract(1.0, hidden, out=hidden)
            back *= hidden
            g1 += x.T @ back
    return loss, np.concatenate([g1.ravel(), g2.ravel(), gk]), -(-n // STACK)


def direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Less the gradient times the inverse curvature that the last steps (latest first) tell of."""
    out = grad.copy()
    scale = 1.0
    if steps:
        curved = float(steps[0] @ changes[0])
        if curved < 0 or np.isnan(curved):
            raise SearchFailed("curvature is lost")
        scale = curved / float(changes[0] @ changes[0])
    moved = []
    for s, c in zip(steps, changes, strict=True):
        moved.append(float(s @ out) / float(s @ c))
        if np.isnan(moved[-1]):
            raise SearchFailed("curvature is lost")
        out -= moved[-1] * c
    out *= scale
    for s, c, a in zip(reversed(steps), reversed(changes), reversed(moved), strict=True):
        out += (a - float(c @ out) / float(s @ c)) * s
    return -out


@dataclass
class Point:
    """The loss along a direction at step t, with its slope there."""
    t: float
    value: float
    slope: float
    x: np.ndarray
    grad: np.ndarray


def between(left: Point, right: Point) -> float:
    """The least point of the cubic through both, a tenth of their distance off either at least."""
    d1 = left.slope + right.slope - 3 * (left.value - right.value) / (left.t - right.t)
    d2 = np.sqrt(d1 * d1 - left.slope * right.slope)
    wide = right.t - left.t
    t = right.t - wide * (right.slope + d2 - d1) / (right.slope - left.slope + 2 * d2)
    if t < left.t + 0.1 * wide:
        return left.t + 0.1 * wide
    return left.t + 0.9 * wide if t > left.t + 0.9 * wide else t


# what a search asks for (weights) and is told (loss and gradient there)
Asking = Generator[np.ndarray, tuple[float, np.ndarray]]


def wolfe_step(at: Callable[[float], Asking], start: Point, t: float) -> Asking:
    """A point of enough decrease and small enough slope (strong Wolfe conditions)."""
    if start.slope > 0:
        raise SearchFailed("not a descent")

    def zoom(low: Point, high: Point) -> Asking:
        for _ in range(TRIES):
            c = yield from at(between(high, low) if low.t > high.t else between(low, high))
            if c.value > start.value + DECREASE * c.t * start.slope or c.value >= low.value:
                high = c
                continue
            if abs(c.slope) <= CURVATURE * abs(start.slope):
                return c
            if c.slope * (high.t - low.t) >= 0:
                high = low
            low = c
        raise SearchFailed("no step found between two")

    low = start
    for i in range(TRIES):
        c = yield from at(t)
        if not np.isfinite(c.value):
            t /= 2.0
            continue
        if c.value > start.value + DECREASE * t * start.slope or (c.value >= low.value and i > 0):
            return (yield from zoom(low, c))
        if abs(c.slope) <= CURVATURE * abs(start.slope):
            return c
        if c.slope >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise SearchFailed("no step found")


def search(x: np.ndarray, iterations: int, tolerance: float) -> Asking:
    """(weights, loss after every iteration) of L-BFGS: ends after ``iterations``, when the loss is within
    ``tolerance`` of the first loss of the largest of the last 20, when the gradient is as good as 0, or
    when no step is found twice in a row, the second time without what was learnt of the curvature."""
    value, grad = yield x
    begun, kept, losses = value, [np.inf], [value]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed = False
    while len(losses) <= iterations:
        if len(kept) > 1 and abs(value - max(kept)) <= tolerance * begun:
            break
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            way = direction(grad, steps, changes)

            def at(t: float, x=x, way=way) -> Asking:
                there = x + way * t
                v, g = yield there
                return Point(t, v, float(g @ way), there, g)

            t = 1.0 if len(losses) > 1 else 1.0 / np.linalg.norm(way)
            found = yield from wolfe_step(at, Point(0.0, value, float(grad @ way), x, grad), t)
            if found.t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed("the step is lost in rounding")
        except SearchFailed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        failed = False
        steps, changes = [found.x - x, *steps][:CORRECTIONS], [found.grad - grad, *changes][:CORRECTIONS]
        x, value, grad = found.x, found.value, found.grad
        kept = [*kept, value][-VALUES_KEPT:]
        losses.append(value)
    return x, losses


class SigmoidNetwork:
    """Estimator over (features vector, label) rows; labels are 0 to classes - 1."""

    def __init__(self, settings: NetworkSettings, label: str):
        self.settings, self.label = settings, label

    def fit(self, train: DataFrame) -> MultilayerPerceptronClassificationModel:
        return finished([self.begin(train)])[0]

    def begin(self, train: DataFrame) -> Begun | MultilayerPerceptronClassificationModel:
        """A fit to be finished beside others; few rows are fitted at once."""
        n = train.count()
        return self._mllib(train, self.settings.iterations) if n < FEW_ROWS else Begun(self, train, n)

    def _mllib(self, rows: DataFrame, iterations: int, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
        """MLlib's fit, from the given weights or those it draws."""
        s = self.settings
        given = {} if weights is None else {"initialWeights": Vectors.dense(weights)}
        return MultilayerPerceptronClassifier(layers=s.layers, maxIter=iterations, tol=s.tolerance, seed=s.seed, featuresCol="features",
                                              labelCol=self.label, **given).fit(rows)

    def holding(self, train: DataFrame, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
        """MLlib's model with the given weights, or those a fit starts from: no iteration, on one made-up row."""
        row = train.sparkSession.createDataFrame([(Vectors.dense([0.0] * self.settings.layers[0]), 0.0)], ["features", self.label])
        return self._mllib(row, 0, weights)

    def blocks(self, train: DataFrame, fit: int) -> DataFrame:
        """(fit, rows) blocks of whole stacks, the last of a part aside."""
        d, _, classes = self.settings.layers

        def block(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["fit", "rows"])

        def pack(batches):
            held = np.empty((0, d + 2))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                if not np.isin(y, np.arange(classes)).all():
                    raise ValueError(f"labels must be 0 to {classes - 1}")
                held = np.concatenate([held, np.column_stack([x, np.ones(len(x)), y])])
                whole = len(held) - len(held) % BLOCK_ROWS
                yield from (block(held[lo:lo + BLOCK_ROWS]) for lo in range(0, whole, BLOCK_ROWS))
                held = held[whole:]
            if len(held):
                yield block(held)

        rows = train.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"))
        return rows.mapInArrow(pack, "fit int, rows binary")


@dataclass
class Begun:
    network: SigmoidNetwork
    train: DataFrame
    n: int


def searched(begun: list[Begun]) -> list[tuple[np.ndarray, list[float]]]:
    """(weights, loss after every iteration) of every fit, each pass over the rows for all of them."""
    spark = begun[0].train.sparkSession
    cores = spark.sparkContext.defaultParallelism
    layers = [list(b.network.settings.layers) for b in begun]
    widest = max(hidden for _, hidden, _ in layers)
    parts = max(cores, -(-sum(b.n for b in begun) // PART_ROWS))
    packed = reduce(DataFrame.union, [b.network.blocks(b.train, i) for i, b in enumerate(begun)]).repartition(parts)
    blocks = packed.rdd.map(lambda r: (r["fit"], np.frombuffer(r["rows"]).reshape(-1, layers[r["fit"]][0] + 2))) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    dealt = blocks.coalesce(TASKS_A_CORE * cores) if parts > TASKS_A_CORE * cores else blocks

    def told(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def sums(part):
            out, room = {}, np.empty((2, ROWS_AT_ONCE, widest))
            for i, block in part:
                if i in asked:
                    new = loss_sums(asked[i], layers[i], block, room)
                    out[i] = tuple(a + b for a, b in zip(out[i], new, strict=True)) if i in out else new
            return out.items()

        total: dict[int, tuple[float, np.ndarray, int]] = {}
        for i, new in dealt.mapPartitions(sums).collect():
            total[i] = tuple(a + b for a, b in zip(total[i], new, strict=True)) if i in total else new
        return {i: (loss / stacks, grad / stacks) for i, (loss, grad, stacks) in total.items()}

    starts: dict[tuple, np.ndarray] = {}
    for b, sizes in zip(begun, layers, strict=True):
        if (*sizes, b.network.settings.seed) not in starts:
            starts[*sizes, b.network.settings.seed] = b.network.holding(b.train).weights.toArray()
    searches = [search(starts[*sizes, b.network.settings.seed], b.network.settings.iterations, b.network.settings.tolerance)
                for b, sizes in zip(begun, layers, strict=True)]
    out: dict[int, tuple[np.ndarray, list[float]]] = {}
    asked = {i: next(s) for i, s in enumerate(searches)}
    try:
        while asked:
            answers = told(asked)
            for i in list(asked):
                try:
                    asked[i] = searches[i].send(answers[i])
                except StopIteration as end:
                    out[i] = end.value
                    del asked[i]
    finally:
        blocks.unpersist()
    return [out[i] for i in range(len(begun))]


def finished(fits: list[Begun | MultilayerPerceptronClassificationModel]) -> list[MultilayerPerceptronClassificationModel]:
    """The models of begun fits, searched side by side, in their order; those already fitted stay."""
    begun = [x for x in fits if isinstance(x, Begun)]
    found = iter(searched(begun) if begun else [])
    return [x.network.holding(x.train, next(found)[0]) if isinstance(x, Begun) else x for x in fits]
