"""Linear, ridge and lasso regression on all cross-validation folds from one scan (ML3, ML9, ML19).

One pass sums, per fold, the products of all pairs of columns: a constant, each numeric column with
NULL as 0, its NULL flag, one flag per category, and the target. A training set's sums are the
whole's less the held-out fold's. Imputed, scaled and one-hot features are linear in these columns,
so each training fold's own medians, means and deviations enter as a small matrix, and the
held-out squared error comes from the held-out fold's sums: no row is read again to fit or score.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.quantiles import exact_quantiles

LASSO_ROUNDS = 10_000
LASSO_TOLERANCE = 1e-12


def fold_products(df: DataFrame, columns: list, fold: str) -> dict[int, np.ndarray]:
    """Fold -> sums of products of all pairs of ``columns`` (double expressions), in one scan."""
    size = len(columns)
    work = df.select(F.col(quoted(fold)).cast("int").alias("fold"), F.array(*columns).alias("z"))

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for f in np.unique(which).tolist():
                mine = z[which == f]
                total[f] = total.get(f, 0) + mine.T @ mine
        rows = [(f, i, t[i].tobytes()) for f, t in total.items() for i in range(size)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                         ["fold", "line", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "line": pa.array([key[1].as_py()], pa.int32()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    ddl = "fold int, line int, sums binary"
    out: dict[int, np.ndarray] = {}
    for r in work.where("fold is not null").mapInArrow(run, ddl).groupBy("fold", "line").applyInArrow(add, ddl).collect():
        out.setdefault(r["fold"], np.zeros((size, size)))[r["line"]] = np.frombuffer(r["sums"])
    return out


@dataclass
class LinearFit:
    """score = intercept + sum(coefficient * feature) over standardised and one-hot ``names``."""
    kind: str
    fold: int | None       # the fold held out; None: fitted on all rows
    names: list[str]
    coefficients: np.ndarray
    intercept: float
    rmse: float | None     # on the held-out fold
    columns: np.ndarray    # the same score as weights of the raw columns


def solve(gram: np.ndarray, target: np.ndarray, n: float, kind: str, alpha: float) -> np.ndarray:
    """Coefficients from centred sums: least squares (least norm), ridge (squared error + alpha *
    squared norm) or lasso (half the mean squared error + alpha * absolute sum)."""
    if kind == "linear":
        return np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ target
    if kind == "ridge":
        return np.linalg.solve(gram + alpha * np.eye(len(gram)), target)
    w, g, t = np.zeros(len(gram)), gram / n, target / n
    for _ in range(LASSO_ROUNDS):
        moved = 0.0
        for j in range(len(w)):
            if g[j, j] <= 0:
                continue
            rest = t[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / g[j, j]
            moved = max(moved, abs(new - w[j]) * np.sqrt(g[j, j]))
            w[j] = new
        if moved < LASSO_TOLERANCE * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def fold_fits(df: DataFrame, target: str, numeric: list[str], categorical: list[str], fold: str,
              kinds: dict[str, tuple[str, float]] | None = None, standardise: bool = True) -> list[LinearFit]:
    """Fits of every kind on all rows but one fold, for every fold, and on all rows.

    ``kinds`` names (method, penalty) pairs: method linear, ridge or lasso. Rows without target or
    fold take no part. Numeric NULLs take the training rows' median, categorical NULLs their most
    frequent value (ties to the smallest), categories not seen in training no feature.
    """
    kinds = kinds or {"linear": ("linear", 0.0), "ridge": ("ridge", 1.0), "lasso": ("lasso", 1.0)}
    df = df.where(F.col(quoted(target)).isNotNull() & F.col(quoted(fold)).isNotNull())
    folds = sorted(r[0] for r in df.select(F.col(quoted(fold)).cast("int")).distinct().collect())
    trained = [*folds, None]
    medians = exact_quantiles(df, {f"{i}|{f}": F.when(F.lit(True) if f is None else F.col(quoted(fold)) != f, F.col(quoted(c)))
                                   for i, c in enumerate(numeric) for f in trained}, [0.5])
    seen = [sorted(r[0] for r in df.select(F.col(quoted(c)).cast("string")).distinct().collect() if r[0] is not None) for c in categorical]
    columns = [F.lit(1.0)]
    for c in numeric:
        x = F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double"))
        columns += [F.coalesce(x, F.lit(0.0)), x.isNull().cast("double")]
    for c, values in zip(categorical, seen, strict=True):
        x = F.col(quoted(c)).cast("string")
        columns += [F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0)) for v in values] + [x.isNull().cast("double")]
    columns.append(F.col(quoted(target)).cast("double"))
    sums = fold_products(df, columns, fold)
    whole = sum(sums.values())
    out = []
    for f in trained:
        g = whole if f is None else whole - sums[f]
        n = g[0, 0]
        names, rows = [], []
        at = 1
        for i, c in enumerate(numeric):
            row = np.zeros(len(g))
            row[at], row[at + 1] = 1.0, medians[f"{i}|{f}"][0] or 0.0
            if standardise:
                mean = row @ g[:, 0] / n
                sd = np.sqrt(max(row @ g @ row / n - mean * mean, 0.0))
                row[0] = -mean
                row /= sd if sd > 1e-12 * max(1.0, abs(mean)) else 1.0
            names.append(f"num__{c}")
            rows.append(row)
            at += 2
        for c, values in zip(categorical, seen, strict=True):
            held = [(v, at + k) for k, v in enumerate(values) if g[0, at + k] > 0.5]
            mode = min(held, key=lambda x: (-round(g[0, x[1]]), x[0]))[1] if held else None
            for v, k in held:
                row = np.zeros(len(g))
                row[k] = 1.0
                row[at + len(values)] = float(k == mode)
                names.append(f"cat__{c}={v}")
                rows.append(row)
            at += len(values) + 1
        a = np.array(rows).reshape(len(rows), len(g))
        mean, y_mean = a @ g[:, 0] / n, g[0, -1] / n
        gram = a @ g @ a.T - n * np.outer(mean, mean)
        cross = a @ g[:, -1] - n * mean * y_mean
        for name, (method, alpha) in kinds.items():
            w = solve(gram, cross, n, method, alpha) if len(a) else np.zeros(0)
            intercept = float(y_mean - w @ mean)
            weights = w @ a if len(a) else np.zeros(len(g))
            weights[0] += intercept
            error = weights.copy()
            error[-1] -= 1.0
            rmse = None if f is None else float(np.sqrt(max(error @ sums[f] @ error, 0.0) / sums[f][0, 0]))
            out.append(LinearFit(name, f, names, w, intercept, rmse, weights))
    return out


def cv_table(spark, fits: list[LinearFit]) -> DataFrame:
    """(kind, cv_rmse): mean held-out RMSE over the folds."""
    by: dict[str, list[float]] = {}
    for x in fits:
        if x.rmse is not None:
            by.setdefault(x.kind, []).append(x.rmse)
    return spark.createDataFrame([(k, float(np.mean(v))) for k, v in by.items()], "kind string, cv_rmse double")
