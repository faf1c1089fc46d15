"""Token counts by overlap resynchronisation.

Huge texts are encoded in overlapping chunks. Neighbouring chunks are spliced at a boundary in
their overlap that is proven stable: a place between two characters that no vocabulary piece
holds side by side. No merge can cross such a place, whatever stands around it, so the ids on
each side are the same in every encoding that contains both characters. If an overlap has no
such place the overlap is widened, in the end to the rest of the text, so counts stay exact.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8

SPACE = "▁"  # the piece alphabet's mark for a space
TOKEN_LIMIT = 4096
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256

RESULT_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                    ("over_limit", pa.bool_()), ("n_chunks", pa.int32())])


class PieceCounter:
    """Counts the pieces of a model without begin or end marks."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        joined = set()
        for i in range(self.model.vocab_size()):
            if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i)):
                piece = self.model.id_to_piece(i)
                joined.update(zip(piece, piece[1:], strict=False))
        self.joined = joined
        self.prefix = len(self.model.encode("a", out_type=str)[0]) > 1 or self.model.encode("a", out_type=str)[0] == SPACE

    def stable(self, left: str, right: str) -> bool:
        """Proven: no piece holds the two characters side by side. Right is a space, so that
        a chunk may start there: the encoder's own leading space then takes its place."""
        return right == " " and self.prefix and left != " " and (left, SPACE) not in self.joined

    def splice(self, text: str, lo: int, hi: int) -> int:
        """First proven boundary in text[lo:hi), or -1."""
        at = text.find(" ", max(lo, 1), hi)
        while at >= 0:
            if self.stable(text[at - 1], " "):
                return at
            at = text.find(" ", at + 1, hi)
        return -1

    def _offsets(self, part: str) -> np.ndarray:
        """Byte offsets in ``part`` at which its pieces end, in order."""
        pieces = self.model.encode(part, return_type="proto").pieces
        return np.array([p.end for p in pieces], np.int64)

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, chunks) of one text."""
        if len(text) <= self.chunk + self.overlap:
            return len(self.model.encode(text)), 1
        total = chunks = 0
        start = 0
        while start < len(text):
            overlap, end = self.overlap, start + self.chunk
            while True:
                stop = min(len(text), end + overlap)
                if stop == len(text):
                    cut = stop
                    break
                cut = self.splice(text, end, stop)
                if cut >= 0:
                    break
                overlap *= 4  # no boundary that both chunks are proven to share: widen
            total += self._upto(text, start, cut, stop)
            chunks += 1
            start = cut
        return total, chunks

    def _upto(self, text: str, start: int, cut: int, stop: int) -> int:
        """Tokens of the chunk text[start:stop) that end at or before the splice ``cut``.

        A later chunk starts with a space, which the encoder's leading space stands for.
        """
        skip = 1 if start else 0
        part = text[start + skip:stop]
        if cut == stop:
            return len(self.model.encode(part))
        at = len(part[:cut - start - skip].encode())
        return int(np.searchsorted(self._offsets(part), at, side="right"))


@functools.lru_cache(maxsize=4)
def _counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Count the tokens of every whole text; one row per input row, no shuffle.

    NULL and empty texts have 0 bytes and 0 tokens; NULL ids stay NULL; repeated rows are each
    counted; an empty table gives an empty result; other columns are ignored. ``n_chunks``
    tells how many chunks were spliced. ``model_path`` must exist on every executor.
    """

    def run(batches):
        counter = _counter(model_path, chunk, overlap)
        for batch in batches:
            for part in slices(batch):
                _, off = utf8(part.column(1))
                texts = [t or "" for t in part.column(1).to_pylist()]
                small = [i for i, t in enumerate(texts) if len(t) <= chunk + overlap]
                tokens, chunks = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int32)
                for i, ids in zip(small, counter.model.encode([texts[i] for i in small], num_threads=1), strict=True):
                    tokens[i] = len(ids)
                for i in sorted(set(range(len(texts))) - set(small)):
                    tokens[i], chunks[i] = counter.count(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(tokens),
                     pa.array(tokens > limit), pa.array(chunks)], schema=RESULT)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT_DDL)
