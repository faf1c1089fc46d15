"""Language identification by interpolated Kneser-Ney character models.

Symbols are letters in lower case and one mark for every run of other characters. Counts cover
all training texts: tasks count 4-grams per language, Spark sums them and derives from the
distinct 4-grams the continuation counts of the lower orders, the contexts' totals and, order by
order, the probabilities. A model is a sorted array of all n-grams with one log-probability per
language beside it. Keys are mixed one to one, so n-grams of letters of 16 bits or less never share
an entry; rarer letters do (see ``symbols``). The arrays grow with the distinct n-grams and are
gathered and broadcast whole. A text goes to the language of lowest cross-entropy per symbol, if
that is not beyond what the language's own texts show.
"""
from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, mix64, slices

ORDER = 4
DISCOUNT = 0.75
ALPHABET = 1 << 16
MAX_LANGUAGES = 1000  # a label column with more values is refused
LIMIT_ACCURACY = 100_000  # rank error of a rejection limit: one in so many texts of the language
TAIL = 0.001  # share of a language's own texts that the limit may reject
LEARNING_FLUSH = 1 << 21


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram of every symbol as a 64-bit key, document of it).

    A key packs the symbol (low 16 bits) and the three before it; nothing stands before a text.
    Letters beyond 16 bits share the 6,144 codes of the private-use range, so that their n-grams
    may share entries; whether a code point is a letter is always its own property.
    """
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), size)
    high = codes >= ALPHABET
    low = np.where(high, 0xE000 + codes % 0x1800, codes).astype(np.uint64)
    z = np.where(_letters()[codes], low, 0)
    keep = np.ones(len(z), bool)
    keep[1:] = (z[1:] != 0) | (z[:-1] != 0) | (doc[1:] != doc[:-1])
    z, doc = z[keep], doc[keep]
    if not len(z):
        return np.zeros(0, np.uint64), doc
    key = z.copy()
    for back in (1, 2, 3):
        shifted = np.zeros_like(z)
        shifted[back:] = np.where(doc[back:] == doc[:-back], z[:-back], 0)
        key |= shifted << np.uint64(16 * back)
    return key, doc


def mixed(key: np.ndarray, symbols_in: int) -> np.ndarray:
    """The last ``symbols_in`` symbols of 64-bit keys, mixed one to one: no two n-grams are equal."""
    if symbols_in < ORDER:
        key = key & np.uint64((1 << 16 * symbols_in) - 1)
    return mix64(key)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): 4-gram counts of all rows with a language."""

    def run(batches):
        held: dict[str, list] = {}
        rows = 0

        def summed(lang):
            keys = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[at], np.add.reduceat(n, at)

        def out():
            for lang in held:
                keys, n = summed(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)],
                                                 ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                texts, langs = part.column(1).to_pylist(), part.column(0).to_pylist()
                for lang in set(langs):
                    key, _ = symbols([t or "" for t, x in zip(texts, langs, strict=True) if x == lang])
                    if len(key):
                        key, n = np.unique(key, return_counts=True)
                        held.setdefault(lang, []).append((key, n))
                        rows += len(key)
                if rows > LEARNING_FLUSH:
                    for lang in held:
                        held[lang] = [summed(lang)]
                    rows = sum(len(v[0][0]) for v in held.values())
                    if rows > LEARNING_FLUSH // 2:
                        yield from out()
                        rows = 0
        yield from out()

    return (docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class LanguageModel:
    """``grams[n]``: sorted mixed keys of seen n-grams and their log-probability per language.
    ``backoff[n]``: sorted mixed keys of n-symbol contexts and the log-weight of the next shorter."""

    languages: list[str]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    backoff: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limit: np.ndarray | None = None

    def log_probs(self, key: np.ndarray) -> np.ndarray:
        """(symbols, languages) natural log-probabilities."""
        out = np.tile(self.floor, (len(key), 1))
        todo = np.arange(len(key))
        gained = np.zeros((len(key), len(self.languages)), np.float32) if len(key) else None
        for n in range(ORDER, 0, -1):
            if not len(todo):
                break
            hashes, table = self.grams[n]
            b = mixed(key[todo], n)
            at = self._find(("g", n), hashes, b)
            hit = at >= 0
            out[todo[hit]] = table[at[hit]] + gained[todo[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                hashes, table = self.backoff[n - 1]
                at = self._find(("b", n - 1), hashes, mixed(key[todo] >> np.uint64(16), n - 1))
                seen = at >= 0
                gained[todo[seen]] += table[at[seen]]
        out[todo] += gained[todo]
        return out

    def _find(self, name, hashes: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each key in its sorted array, or -1; by an index over the leading bits."""
        index = self.__dict__.setdefault("_index", {})
        if name not in index:
            shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
            first = np.searchsorted(hashes, np.arange(1 << (64 - int(shift)), dtype=np.uint64) << shift)
            first = np.append(first, len(hashes)).astype(np.int32)
            index[name] = shift, first, int(np.diff(first).max())
        shift, first, longest = index[name]
        lead = (b >> shift).astype(np.int64)
        at, end = first[lead], first[lead + 1]
        out = np.full(len(b), -1, np.int32)
        todo = np.flatnonzero(at < end)
        for _ in range(longest):
            spot = at[todo]
            hit = hashes[spot] == b[todo]
            out[todo[hit]] = spot[hit]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, languages) nats per symbol, symbols with a letter) of each text."""
        key, doc = symbols(texts)
        n = np.bincount(doc, minlength=len(texts))
        letters = np.bincount(doc, weights=(key & np.uint64(0xFFFF)) != 0, minlength=len(texts)).astype(np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(key), 1 << 19):
            lp = self.log_probs(key[lo:lo + (1 << 19)])
            d = doc[lo:lo + (1 << 19)]
            for j in range(len(self.languages)):
                total[:, j] -= np.bincount(d, weights=lp[:, j], minlength=len(texts))
        return total / np.maximum(n, 1)[:, None], letters


def _dense(column: pa.Array, fields: int, languages: int) -> list[np.ndarray]:
    """(rows, languages) array of each field of lists of (language number, field, ...)."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    parts = column.flatten().flatten()
    out = []
    for f in range(fields):
        x = np.zeros((len(column), languages))
        x[row, parts[0].to_numpy()] = parts[f + 1].to_numpy()
        out.append(x)
    return out


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _finished(table: DataFrame, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted mixed keys, float32 row per key) of a table (key, value)."""
    t = table.select("key", "value").toArrow()
    key = mix64(t.column("key").to_numpy().view(np.uint64))
    value = np.frombuffer(b"".join(t.column("value").to_pylist()), np.float32).reshape(len(key), languages)
    order = np.argsort(key)
    return key[order], value[order]


def learn(training: DataFrame) -> LanguageModel:
    """Model from all rows of ``training`` (lang, text); rows without a language are left out.

    Counts, discounts, back-off weights and probabilities are tables by exact n-gram; only the
    finished arrays are gathered, one row per distinct n-gram and context.
    """
    from .common import materialise

    counts = materialise(gram_counts(training.where(F.col("lang").isNotNull())), "grams")
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = len(languages)
    if not size:
        none = np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)
        return LanguageModel([], dict.fromkeys(range(1, ORDER + 1), none), dict.fromkeys(range(1, ORDER), none), np.zeros(0, np.float32))
    numbers = counts.sparkSession.createDataFrame(list(enumerate(languages)), "j int, lang string")
    counted = {ORDER: counts.join(F.broadcast(numbers), "lang").select("j", F.col("gram").alias("key"), F.col("n").alias("total"))}
    for n in range(ORDER - 1, 0, -1):
        counted[n] = (counted[n + 1].groupBy("j", F.col("key").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("key"))
                      .agg(F.count(F.lit(1)).alias("total")))
    single = materialise(counted[1], "singles")
    alphabet = max(2, single.select("key").distinct().count() + 1)
    whole, kinds = np.ones(size), np.zeros(size)
    for r in single.groupBy("j").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("types")).collect():
        whole[r["j"]], kinds[r["j"]] = max(r["total"], 1), r["types"]
    least = np.minimum(np.maximum(DISCOUNT * kinds / whole, 1e-9), 1) / alphabet

    def rows_of(batch):
        step = max(1, (1 << 20) // size)
        return (batch.slice(lo, step) for lo in range(0, batch.num_rows, step))

    def out(key, p):
        lp = np.log(np.maximum(p, 1e-12)).astype(np.float32)
        return pa.RecordBatch.from_arrays([key, _binary(p), _binary(lp)], ["key", "p", "value"])

    def first_order(batches):
        for batch in batches:
            for part in rows_of(batch):
                count, = _dense(part.column(1), 1, size)
                yield out(part.column(0), np.maximum(count - DISCOUNT, 0) / whole + least)

    def next_order(batches):
        for batch in batches:
            for part in rows_of(batch):
                count, = _dense(part.column(1), 1, size)
                total, types = _dense(part.column(2), 2, size)
                below = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(-1, size)
                weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
                yield out(part.column(0), np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + np.minimum(weight, 1) * below)

    def weights(batches):
        for batch in batches:
            for part in rows_of(batch):
                total, types = _dense(part.column(1), 2, size)
                w = DISCOUNT * types / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(np.log(np.where(w > 0, np.minimum(w, 1), 1.0)).astype(np.float32))],
                                                 ["key", "value"])

    def by_key(table, *fields):
        return table.groupBy("key").agg(F.collect_list(F.struct("j", *fields)).alias("x"))  # a row per language at most

    grams: dict = {}
    backoff: dict = {}
    ddl = "key long, p binary, value binary"
    lower = materialise(by_key(single, "total").mapInArrow(first_order, ddl), "order1")
    grams[1] = _finished(lower, size)
    for n in range(2, ORDER + 1):
        context = F.shiftrightunsigned("key", 16)
        after = by_key(counted[n].groupBy("j", context.alias("key")).agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("types")),
                       "total", "types")
        after = materialise(after, f"contexts{n}")
        backoff[n - 1] = _finished(after.mapInArrow(weights, "key long, value binary"), size)
        whole_ = after.select(F.col("key").alias("context"), F.col("x").alias("c"))
        below = lower.select(F.col("key").alias("shorter"), "p")
        lower = materialise(by_key(counted[n], "total").withColumn("context", context)
                            .withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1)))
                            .join(whole_, "context").join(below, "shorter")
                            .select("key", "x", "c", "p").mapInArrow(next_order, ddl), f"order{n}")
        grams[n] = _finished(lower, size)
    return LanguageModel(languages, grams, backoff, np.full(size, np.log(1 / alphabet), np.float32))


def _scored(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, label, lang_pred, score, nats, symbols); lang_pred is ``und`` without letters."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = handle.value
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if m.languages:
                    nats, letters = m.cross_entropy(texts)
                    best = nats.argmin(axis=1)
                    low = nats[np.arange(len(texts)), best]
                    # posterior over languages, as if the text had at most 30 independent symbols
                    gap = np.exp(-(nats - low[:, None]) * np.minimum(letters, 30)[:, None])
                    score = 1 / gap.sum(axis=1)
                    names = [m.languages[k] if n else "und" for k, n in zip(best, letters, strict=True)]
                    odd = np.zeros(len(texts), bool) if m.limit is None else low > m.limit[best]
                else:
                    letters, low = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                    score, names, odd = low.copy(), ["und"] * len(texts), np.ones(len(texts), bool)
                none = np.array([x == "und" for x in names])
                score = np.where(none, 0.0, np.where(odd, score / 2, score))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(names), pa.array(score),
                     pa.array(low), pa.array(letters), pa.array(odd | none)],
                    ["doc_id", "lang", "lang_pred", "score", "nats", "letters", "rejected"])

    return docs.select("doc_id", "text", "lang").mapInArrow(
        run, "doc_id long, lang string, lang_pred string, score double, nats double, letters long, rejected boolean")


def calibrate(model: LanguageModel, training: DataFrame, tail: float = TAIL) -> LanguageModel:
    """Set each language's rejection limit: the cross-entropy that a share ``tail`` of its own
    texts exceeds, over all its training texts with 20 letters or more that it wins, plus half a
    nat for what texts it has not seen may miss. With under 1 / ``tail`` such texts the limit is
    their maximum plus that; a language without any has no limit."""
    own = _scored(training.where(F.col("lang").isNotNull()), model).where("letters >= 20 and lang = lang_pred")
    limits = own.groupBy("lang").agg(F.percentile_approx("nats", 1 - tail, LIMIT_ACCURACY).alias("limit")).collect()
    found = {r["lang"]: r["limit"] + 0.5 for r in limits}
    model.limit = np.array([found.get(x, np.inf) for x in model.languages])
    return model


def identify(docs: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Learn from rows whose crc32(doc_id) modulo ``mod`` isn't ``held`` and whose lang is set;
    predict every row: doc_id, held_out, lang_pred, score (0 to 1), rejected.

    NULL texts and texts without letters are ``und`` with score 0. ``rejected`` marks texts beyond
    their best language's limit; their score is halved. Rows with NULL ids are predicted, never
    learned from; repeated rows count each; without training rows everything is ``und``; an empty
    table gives an empty result; other columns are ignored.
    """
    training = docs.where(fold_of("doc_id", mod) != held)
    model = calibrate(learn(training), training)
    return _scored(docs, model).select("doc_id", F.coalesce(fold_of("doc_id", mod) == held, F.lit(False)).alias("held_out"),
                                       "lang_pred", "score", "rejected")
