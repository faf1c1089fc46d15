"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed with numpy, a slice of documents at a time. Trees
are fitted on a bounded sample of labelled rows (``fit_rows``) and flattened into arrays of
complete binary trees, so that scoring walks all rows of a slice one level at a time.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, fold_of, slices, utf8

FIT_ROWS = 20_000  # labelled rows the trees are fitted on, the first by a hash of their id
TREES, DEPTH, BINS, RATE, LAMBDA, MIN_ROWS = 80, 5, 64, 0.12, 1.0, 8

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13),
    "line": (10,), "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "symbol": b"#$%&*+=<>@\\^_~`",
    "bracket": b"()[]{}\"'", "slash": b"/-", "high": range(128, 256), "control": (*range(9), *range(14, 32), 127),
}
_CLASS = np.zeros(256, np.int64)
for _n, _members in enumerate(_GROUPS.values()):
    _CLASS[list(_members)] = _n
FEATURES = (*(f"share_{k}" for k in _GROUPS), "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word",
            "distinct_words", "top_word", "same_as_before", "distinct_pairs", "log_lines", "line_bytes",
            "repeated_lines", "short_words", "byte_entropy")


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, features) float64; an empty text has zeros throughout."""
    docs = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(docs), size)
    per = np.maximum(size, 1)[:, None]
    classes = np.bincount(doc * len(_GROUPS) + _CLASS[raw], minlength=docs * len(_GROUPS)).reshape(docs, -1)
    start, end, h, first = ascii_words(raw, off)
    n = np.diff(first)
    wdoc = np.repeat(np.arange(docs), n)
    length = (end - start).astype(np.float64)
    some = np.maximum(n, 1)

    def total(values, where=wdoc):
        return np.bincount(where, weights=values, minlength=docs)

    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length ** 2) / some - mean ** 2, 0))
    longest = np.zeros(docs)
    np.maximum.at(longest, wdoc, length)

    def distinct(keys, where):
        """Distinct keys and the count of the commonest one, per document."""
        if not len(keys):
            return np.zeros(docs), np.zeros(docs)
        order = np.lexsort((keys, where))
        k, w = keys[order], where[order]
        new = np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))
        at = np.flatnonzero(new)
        top = np.zeros(docs)
        np.maximum.at(top, w[at], np.diff(np.append(at, len(k))))
        return np.bincount(w[at], minlength=docs).astype(float), top

    words, top = distinct(h, wdoc)
    joined = np.append(wdoc[1:] == wdoc[:-1], False) if len(wdoc) else np.zeros(0, bool)
    after = np.append(h[1:], np.uint64(0)) if len(h) else h
    pairs, _ = distinct((h * np.uint64(31) + after)[joined], wdoc[joined])
    same = total(((h == after) & joined).astype(float))
    # lines: runs between line feeds, hashed by what words they hold
    feed = np.flatnonzero(raw == 10)
    lines = np.bincount(doc[feed], minlength=docs) + (size > 0)
    line_no = np.searchsorted(feed, start) if len(start) else np.zeros(0, np.int64)
    repeated = np.zeros(docs)
    if len(start):
        key = wdoc.astype(np.int64) * (len(feed) + 1) + line_no
        edge = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(edge)
        within = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
        sums = np.add.reduceat(h * (within.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at)
        held = np.bincount(wdoc[at], minlength=docs)
        repeated = (held - distinct(sums, wdoc[at])[0]) / np.maximum(held, 1)
    bytes_ = np.zeros(docs)
    for lo in range(0, docs, 256):  # byte histograms of a few documents at a time
        hi = min(docs, lo + 256)
        a, b = off[lo], off[hi]
        hist = np.bincount((doc[a:b] - lo) * 256 + raw[a:b], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
        p = hist / np.maximum(size[lo:hi], 1)[:, None]
        bytes_[lo:hi] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    return np.column_stack([classes / per, np.log1p(size), np.log1p(n), mean, spread, longest, words / some, top / some,
                            same / some, pairs / np.maximum(n - 1, 1), np.log1p(lines), size / np.maximum(lines, 1),
                            repeated, total((length <= 2).astype(float)) / some, bytes_])


@dataclass
class Trees:
    """Complete binary trees: node i has children 2i+1 and 2i+2; the last level holds values.
    A row goes right where its feature is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = RATE, least: int = MIN_ROWS) -> Trees:
    """Second-order boosting of the logistic loss; split candidates are quantiles of ``x``.

    Without rows the score is 0.5 everywhere, with one class the (smoothed) share of it.
    """
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if len(y) < 2 * least or y.min() == y.max():
        return model
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), model.base)
    parts = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            at = np.full(width, -1)
            at_cut = np.zeros(width, np.int64)
            local = node - base
            sums = [np.bincount(local, weights=w, minlength=width) for w in (g, h)]
            parent = sums[0] ** 2 / (sums[1] + LAMBDA)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * bins + binned[:, j]
                gl, hl, nl = (np.cumsum(np.bincount(key, weights=w, minlength=width * bins).reshape(width, bins), axis=1)
                              for w in (g, h, np.ones(len(y))))
                gr, hr, nr = sums[0][:, None] - gl, sums[1][:, None] - hl, nl[:, -1:] - nl
                gain = gl ** 2 / (hl + LAMBDA) + gr ** 2 / (hr + LAMBDA) - parent[:, None]
                gain[(nl < least) | (nr < least)] = -1
                gain = gain[:, :len(cuts[j])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                at[better], at_cut[better] = j, top[better]
            for k in np.flatnonzero(at >= 0):
                feature[base + k], threshold[base + k] = at[k], cuts[at[k]][at_cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=w, minlength=leaves) for w in (g, h))
        value = -rate * gs / (hs + LAMBDA)
        margin += value[leaf]
        parts.append((feature, threshold, value))
    f, t, v = (np.array(a) for a in zip(*parts, strict=True))
    return Trees(f, t, v, model.base)


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, label and the statistics as one array column."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(*utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2).cast(pa.float64()),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                    ["doc_id", "label", "x"])

    return docs.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, training, fit_rows: int = FIT_ROWS, **options) -> Trees:
    """Fit on at most ``fit_rows`` labelled ids for which the column ``training`` holds.

    An id with several labels takes their mean, rounded half up; NULL ids and labels are left out.
    Where ids repeat in ``docs``, at most twice as many rows as ids are fitted on, chosen by hash.
    Without labelled rows every text scores alike.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & training)
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # at most fit_rows ids: bounded, so the join needs no shuffle of the texts
    rows = document_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).orderBy(
        F.xxhash64("doc_id"), F.hash("x")).limit(2 * fit_rows).toArrow()
    y = rows.column("label").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    return fit_trees(x, y, **options)


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score and predicted of every row; no shuffle.

    NULL and empty texts are scored as texts without bytes; NULL ids stay NULL; repeated rows are
    each scored; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                score = model.score(features(*utf8(part.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns, whatever these
    are called.

    NULL and empty texts are scored as texts without bytes; rows with a NULL id are judged like
    others; repeated rows stay or go together; an empty table gives an empty result.
    """
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.score(features(*utf8(part.column(at)))) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, **options) -> DataFrame:
    """Fit on ids whose crc32 modulo ``mod`` isn't ``held``, score every row of ``docs``."""
    model = fit_quality(docs, labels, fold_of("doc_id", mod) != held, **options)
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(fold_of("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", "predicted")
