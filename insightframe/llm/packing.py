"""Best-fit packing of documents into fixed-length sequences under several capacities.

Every sequence (bin) has three residual capacities: tokens, pieces, and attention cost (sum of
squared piece lengths). Pieces are placed longest first; among the bins with room in every
capacity the one with the smallest weighted residual norm after the placement takes the piece.
At the defaults only tokens can bind: pieces have a token at least, and squared lengths that sum
to ``MAX_TOKENS`` at most cost no more than its square. The others only settle near-ties.

Pieces are dealt to groups by a checksum, so a group's size is set by ``group_tokens`` and no
key gathers more; each group packs alone;
a group leaves one sequence or so less full than a single packing of all rows would.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .word_ids import word_ids

MAX_TOKENS = 2048
MAX_PIECES = MAX_TOKENS  # a piece has a token at least: only tokens limit the count of sequences
GROUP_TOKENS = 1 << 23
WEIGHTS = (1.0, 1e-4, 1e-4)  # tokens first: fewest sequences; the others settle near-ties
SEPARATOR = 0

PIECES = pa.schema([("doc_id", pa.int64()), ("row_crc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, row_crc long, piece int, start long, length long, ids_crc32 long"
PACKED_DDL = PIECES_DDL + ", sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of each document's ids with the separator behind them; only documents
    longer than ``max_tokens`` are cut, into pieces of that length (the last may be shorter)."""

    def run(batches):
        words = word_ids(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for n, ids in enumerate(words.encode(texts)):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    whole = zlib.crc32(ids.tobytes())
                    for k, at in enumerate(range(0, len(ids), max_tokens)):
                        cut = ids[at:at + max_tokens]
                        crc = whole if len(cut) == len(ids) else zlib.crc32(cut.tobytes())
                        rows.append((n, whole, k, at, len(cut), crc))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())).cast(pa.int64()),
                     *(pa.array(c, f.type) for c, f in zip(cols[1:], list(PIECES)[1:], strict=True))], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_DDL)


def vector_best_fit(length: np.ndarray, max_tokens: int, max_pieces: int, max_attention: int,
                    weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are in descending order, none above max_tokens."""
    cap = np.array([max_tokens, max_pieces, max_attention], np.float64)
    w = np.array(weights) / cap ** 2
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    left = np.zeros((3, max(16, len(length))))
    used = opened = 0
    alive = np.zeros(0, np.int64)  # bins that could still take the shortest piece
    least = int(length[-1]) if len(length) else 0
    for i, n in enumerate(length.tolist()):
        need = np.array([n, 1, n * n], np.float64)
        take = -1
        if len(alive):
            rest = left[:, alive] - need[:, None]
            ok = np.flatnonzero(rest.min(axis=0) >= 0)
            if len(ok):
                norm = w @ (rest[:, ok] ** 2)
                take = int(alive[ok[np.argmin(norm)]])
        if take < 0:
            take, opened = opened, opened + 1
            left[:, take] = cap
            alive = np.append(alive, take)
        offset[i] = max_tokens - left[0, take]
        bins[i] = take
        left[:, take] -= need
        used += 1
        if left[0, take] < least or left[1, take] < 1 or left[2, take] < least * least:
            alive = alive[alive != take]
    return bins, offset


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_pieces: int = MAX_PIECES,
         max_attention: int | None = None, group_tokens: int = GROUP_TOKENS, weights=WEIGHTS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (see ``pieces_of``).

    ``pieces`` is read twice: pass a written table. A piece that alone exceeds a capacity other
    than tokens would never fit, so ``max_attention`` below max_tokens^2 is refused.
    """
    max_attention = max_tokens ** 2 if max_attention is None else max_attention
    if max_attention < max_tokens ** 2 or max_pieces < 1:
        raise ValueError("every single piece must fit into an empty sequence")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))

    def run(key, table):
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("row_crc").to_numpy(),
                            table.column("doc_id").fill_null(-1).to_numpy(), -length))
        bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[order], offset[order] = vector_best_fit(length[order], max_tokens, max_pieces, max_attention, weights)
        group = int(key[0].as_py())
        return (table.drop(["pack_group"]).append_column("sequence_id", pa.array(bins * groups + group))
                .append_column("offset", pa.array(offset)))

    # a uniform checksum of the piece: equal documents and hot sources spread over all groups
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "row_crc"), F.lit(groups)).cast("long")
    return pieces.withColumn("pack_group", dealt).groupBy("pack_group").applyInArrow(run, PACKED_DDL)


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Pack every document of ``docs``; one row per piece.

    NULL and empty texts are one piece, the separator alone. Repeated rows are each packed
    (rows that agree in every column are interchangeable). NULL ids stay NULL. An empty table
    gives an empty result. Other columns are ignored. ``tokenizer_path`` must exist on every
    executor.
    """
    size = options.get("max_tokens", MAX_TOKENS)
    pieces = materialise(pieces_of(docs, tokenizer_path, size), "pieces")
    return pack(pieces, **options)
