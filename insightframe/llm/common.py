"""Shared helpers of the text operators: shared-folder tables, Arrow text views, word hashing."""
from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes of text that one numpy pass works on; bounds a worker's arrays, not the input.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared checkpoint folder and read it back.

    Cuts the lineage with a durable copy: lost executors only lose running tasks.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete copies made by ``materialise`` that nothing will read any more."""
    for table in tables:
        hadoop = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("llm-"):
                path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(hadoop).delete(path, True)


def fold_of(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (NULL ids give NULL)."""
    return F.crc32(F.col(col).cast("string")) % mod


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets are int64 into bytes, NULL is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=len(arr) + arr.offset + 1)
    o = o[arr.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a record batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public-domain murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1 << 10, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2^64."""
    global _POW
    if len(_POW) < n or _POW[1] == 1:
        size = 1 << max(10, int(n - 1).bit_length())
        _POW = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _POW


def segment_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hash of each run symbols[start:end); runs are disjoint, ordered, non-empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    idx = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
    return _hashes(symbols[idx], length)


def _hashes(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Content hashes of runs of the given lengths that lie one after the other."""
    first = np.cumsum(length) - length
    terms = powers(int(length.max())).take(np.arange(len(symbols)) - np.repeat(first, length))
    terms *= symbols
    return mix64(np.add.reduceat(terms, first) + length.astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_SYMBOL = _SYMBOL[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# for words without punctuation: every ASCII character but letters and digits separates
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def ascii_words(raw: np.ndarray, off: np.ndarray, space: np.ndarray = _IS_SPACE):
    """Words ``[^\\x20\\x09-\\x0D]+`` (or between other ASCII separators) of each document
    after lower-casing A-Z.

    Returns (start, end, hash, first) where first[i]:first[i+1] are document i's words.
    Separators are ASCII, so byte runs of UTF-8 are the same words as code-point runs.
    """
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    word = ~space[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = off[:-1][(off[:-1] < n)]
    begin[edges] = word[edges]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    last = off[1:][off[1:] > 0] - 1
    stop[last] |= word[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    # every byte of a word stands in one word: the words' bytes in order are the runs one after the other
    h = _hashes(_LOWER_SYMBOL.take(raw[word]), end - start) if len(start) else np.zeros(0, np.uint64)
    return start, end, h, np.searchsorted(start, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; with fewer words (but one at
    least) the whole sequence is the only shingle; without words the set is empty."""
    _, _, h, first = ascii_words(raw, off)
    out = []
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            rolled = mix64(rolled * np.uint64(3) + h[i:len(h) - k + 1 + i] + np.uint64(i + 1))
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        n = hi - lo
        if n >= k:
            s = np.sort(rolled[lo:hi - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            x = np.array([n], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for w in h[lo:hi]:
                x = mix64(x * np.uint64(5) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
