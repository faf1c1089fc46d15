"""Preparation for modelling.

Splits and folds rank rows by a hash of their key inside each class: identical on every run and
after executor loss, the same in any engine that has md5, and even to within a row. Preprocessing statistics are fitted on training rows with ONE aggregate and applied
as a projection, so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import quoted, stable_bucket, stable_unit
from ..functions.quantiles import exact_quantiles

MIN_POSITIVES = 15
FOLDS = 5
RANK_ROWS = 200_000  # rows a window sorts when ranking inside a class


def _medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of the columns at any size."""
    return {c: q[0] for c, q in exact_quantiles(df, {c: F.col(quoted(c)) for c in cols}, [0.5]).items()}


def class_rank(df: DataFrame, y: str | None, key: list[str], seed: int, out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row inside its class ``y`` (all rows where it is
    None) by a hash of its key, and ``out_n``: the rows of the class.

    Hashes are cut into equal ranges; ranges are ranked on their own and set off by the counts
    of the ranges before, so no class is sorted in one task. Rows of equal keys take their
    ranks in any order.
    """
    u = stable_unit([F.col(quoted(c)) for c in key], seed)
    ranges = max(1, -(-df.count() // RANK_ROWS))
    work = df.withColumn("_if_class", F.col(quoted(y)).cast("string") if y else F.lit("")).withColumn("_if_u", u) \
        .withColumn("_if_range", F.floor(F.col("_if_u") * ranges).cast("long"))
    counts = work.groupBy("_if_class", "_if_range").agg(F.count(F.lit(1)).alias("_if_k"))
    before = Window.partitionBy("_if_class").orderBy("_if_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_if_class").alias("_if_c"), F.col("_if_range").alias("_if_r"),
        F.coalesce(F.sum("_if_k").over(before), F.lit(0)).alias("_if_before"),
        F.sum("_if_k").over(Window.partitionBy("_if_class")).alias(f"{out}_n"))
    within = Window.partitionBy("_if_class", "_if_range").orderBy("_if_u", *[F.col(quoted(c)) for c in key])
    return (work.withColumn("_if_place", F.row_number().over(within) - 1)
            .join(offsets, F.col("_if_class").eqNullSafe(F.col("_if_c")) & (F.col("_if_range") == F.col("_if_r")))
            .withColumn(out, F.col("_if_before") + F.col("_if_place"))
            .drop("_if_class", "_if_u", "_if_range", "_if_c", "_if_r", "_if_before", "_if_place"))


def has_enough_positives(df: DataFrame, y: str = "y", minimum: int = MIN_POSITIVES) -> bool:
    """M2: the positive-count guard (one tiny aggregate)."""
    return (df.agg(F.coalesce(F.sum(y), F.lit(0))).first()[0] or 0) >= minimum


def stratified_sample(df: DataFrame, y: str, key: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """M3: about ``max_rows`` rows (all, if fewer), the same share of every class to within a row:
    the first of each class by a hash of the key."""
    share = max_rows / max(1, df.count())
    ranked = class_rank(df, y, key, seed, "_if_rank")
    return ranked.where(F.col("_if_rank") < F.round(F.col("_if_rank_n") * F.lit(min(1.0, share)))).drop("_if_rank", "_if_rank_n")


def stratified_split(df: DataFrame, y: str | None, key: list[str], test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """M4: 'test' for round(test_frac * n) rows of every class, the first by a hash of the key."""
    ranked = class_rank(df, y, key, seed, "_if_rank")
    test = F.col("_if_rank") < F.round(F.col("_if_rank_n") * F.lit(test_frac))
    return ranked.withColumn(out, F.when(test, "test").otherwise("train")).drop("_if_rank", "_if_rank_n")


def stratified_folds(df: DataFrame, y: str | None, key: list[str], k: int = FOLDS, seed: int = 43,
                     out: str = "fold") -> DataFrame:
    """M5: fold in [0, k); rows of a class are dealt in turn, so its counts differ by one at most."""
    ranked = class_rank(df, y, key, seed, "_if_rank")
    return ranked.withColumn(out, (F.col("_if_rank") % k).cast("int")).drop("_if_rank", "_if_rank_n")


def split_column(key: list[str], test_frac: float = 0.2, seed: int = 42) -> Column:
    """A plain split by key hash: 'test' for about ``test_frac`` of the rows; no shuffle, no classes."""
    return F.when(stable_bucket(key, 100, seed) < int(round(test_frac * 100)), F.lit("test")) \
        .otherwise(F.lit("train"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weights n / (n_classes * n_c) per class (one row per class)."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return c.withColumn("weight", tot["n"].cast("double") / (tot["k"] * F.col("n_c")))


def with_class_weight(df: DataFrame, y: str = "y", out: str = "w") -> DataFrame:
    """Attach the balanced weight. The weight table has one row per class, so it is broadcast."""
    return df.join(F.broadcast(class_weights(df, y).select(y, F.col("weight").alias(out))), y, "left")


@dataclass
class Preprocessor:
    """Fitted preprocessing: medians + population mean/std for numeric columns, mode and
    category lists for categorical columns. Applied as a projection."""
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.numeric]
        for c in self.categorical:
            names += [f"cat__{c}={v}" for v in self.categories.get(c, [])]
        return names

    def transform_columns(self, numbered: bool = False) -> list[Column]:
        """One column per feature; ``numbered`` names them f0, f1, ... in that order, so that no
        character of a column name or a category reaches a feature's name."""
        out = []
        for c in self.numeric:
            x = F.coalesce(F.col(quoted(c)).cast("double"), F.lit(self.medians.get(c)))
            sd = self.stds.get(c) or 1.0  # zero variance -> unit scale
            out.append((x - F.lit(self.means.get(c, 0.0))) / F.lit(sd))
        for c in self.categorical:
            v = F.coalesce(F.col(quoted(c)).cast("string"), F.lit(self.modes.get(c)))
            out += [(v == F.lit(cat)).cast("double") for cat in self.categories.get(c, [])]
        names = [f"f{i}" for i in range(len(out))] if numbered else self.feature_names()
        return [x.alias(n) for x, n in zip(out, names, strict=True)]

    def transform(self, df: DataFrame, keep: list[str], numbered: bool = False) -> DataFrame:
        """Keep ``keep`` columns and add the prepared feature columns (unseen category -> 0s)."""
        return df.select(*[F.col(quoted(c)) for c in keep], *self.transform_columns(numbered))


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
    """M6-M9 fitted on ``train`` only (see :func:`fit_preprocessors`)."""
    return fit_preprocessors(train, numeric, categorical)[None]


def fit_preprocessors(train: DataFrame, numeric: list[str], categorical: list[str], fold: str | None = None,
                      folds: int = 0) -> dict[int | None, Preprocessor]:
    """One preprocessor per fold f, fitted on the rows of all other folds, and one (None)
    fitted on all rows; all from the same passes.

    Numeric: exact median (for the imputer) + mean and population std of the imputed column.
    Categorical: most frequent value (ties -> smallest) and the sorted category list.
    Every category of a column given here becomes a feature. Which columns are given is the
    feature-eligibility rule's choice; the list of features is the model's own size.
    """
    trained: list[int | None] = [*range(folds), None]
    out = {f: Preprocessor(numeric, categorical) for f in trained}

    def mine(f: int | None, x: Column) -> Column:
        return x if f is None else F.when(F.col(quoted(fold)) != f, x)

    if numeric:
        wanted = {f"{i}|{f}": mine(f, F.col(quoted(c)).cast("double")) for i, c in enumerate(numeric) for f in trained}
        medians = {name: q[0] for name, q in exact_quantiles(train, wanted, [0.5]).items()}
        stats = []
        for f in trained:
            out[f].medians = {c: medians[f"{i}|{f}"] for i, c in enumerate(numeric)}
            for i, c in enumerate(numeric):
                x = mine(f, F.coalesce(F.col(quoted(c)).cast("double"), F.lit(out[f].medians[c])))
                stats += [F.avg(x).alias(f"a{i}|{f}"), F.stddev_pop(x).alias(f"s{i}|{f}")]
        row = train.agg(*stats).first()
        for f in trained:
            out[f].means = {c: row[f"a{i}|{f}"] for i, c in enumerate(numeric)}
            out[f].stds = {c: row[f"s{i}|{f}"] for i, c in enumerate(numeric)}
    if categorical:
        held = F.col(quoted(fold)).cast("int") if fold else F.lit(0)
        wide = train.select(held.alias("fold"), *[F.col(quoted(c)).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)])
        counts = (wide.unpivot(["fold"], [f"c{i}" for i in range(len(categorical))], "col_name", "value")
                  .where(F.col("value").isNotNull()).groupBy("col_name", "value", "fold").agg(F.count(F.lit(1)).alias("n"))).collect()
        for f in trained:
            for i, c in enumerate(categorical):
                total: dict[str, int] = {}
                for r in counts:  # a row per category and fold
                    if r.col_name == f"c{i}" and (f is None or r.fold != f):
                        total[r.value] = total.get(r.value, 0) + r.n
                if total:
                    out[f].modes[c] = min(total, key=lambda v: (-total[v], v))
                    out[f].categories[c] = sorted(total)
    return out


def median_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """M6 as a table: (col_name, median) with linear interpolation."""
    return train.sparkSession.createDataFrame(list(_medians(train, cols).items()), "col_name string, median double")


def mode_table(train: DataFrame, cols: list[str]) -> DataFrame:
    """M7 as a table: (col_name, mode, n) most frequent non-NULL value, ties -> smallest."""
    wide = train.select(*[F.col(c).cast("string").alias(c) for c in cols])
    vc = (wide.unpivot([], cols, "col_name", "value").where(F.col("value").isNotNull())
          .groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n")))
    return vc.groupBy("col_name").agg(
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("m")) \
        .select("col_name", F.col("m.value").alias("mode"), F.col("m.n").alias("n"))
