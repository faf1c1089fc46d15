"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give TF-IDF weights.
2. A randomised SVD (a random start and power iterations, each one Spark job that adds up
   A^T (A X) from passages) gives a latent space of ``RANK`` dimensions. It is fitted on the
   passages of all documents and of all benchmark items.
3. Every window of every document is projected (prefix sums of word vectors) and compared by
   cosine with the benchmark passages of its size class: windows at ``LEAST_COSINE`` or more are
   the candidates, and nothing else is.
4. Candidates are checked on words: the longest common subsequence of the item and the text
   around the window, and for paraphrases also the item's answer (its last sentence).
5. Items of under ``WINDOW_WORDS`` words say too little for a cosine; their candidates are the
   documents that hold enough of their words, by an inverted index.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ascii_words, forget, materialise, slices, utf8

TERM_BITS = 16
RANK = 32
POWER_STEPS = 2
FIT_WINDOW = 64
PASSAGE_WORDS = 48  # longer items are searched by passages of this many words
LEAST_COSINE = 0.55
ITEM_BLOCK = 20_000  # items searched for at once: bounds what a task holds of the benchmark
SURE_SHARE = 0.8  # of an item's words in order: contaminated
LIKELY_SHARE = 0.6  # contaminated if the answer is there too
ANSWER_SHARE = 0.8
SHORT_WORDS = 6  # items below need all their words, side by side
WINDOW_WORDS = 12  # items below are looked up by their words
BLOCK_TERMS = 512

FIT_BYTES = 1 << 19  # bytes of terms that one numpy pass of the fit works on
RUN_ROWS = 64  # rows that one small matrix product adds up
CACHED_ROWS = 1 << 13  # vectors gathered at once: they stay in the cache
SEARCH_BYTES = 1 << 20  # text bytes whose prefix sums are held at once
SCAN_ROWS = 16  # vectors that one triangular product sums up
PAIR_CELLS = 1 << 22  # (document, item) postings or sums held at once

RESULT_DDL = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"


def _words(column: pa.Array):
    """Words without punctuation, in lower case (of any script)."""
    return ascii_words(*utf8(pc.utf8_lower(column)), NOT_ALNUM)


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _word_terms(texts: DataFrame) -> DataFrame:
    """``texts`` with the hashed terms of each text's words (two bytes a word) in its place, as ``terms``."""
    at = texts.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                _, _, h, first = _words(part.column(at))
                terms = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * first).astype(np.int32)),
                                                                           pa.py_buffer(_terms(h).astype("<u2"))])
                yield pa.RecordBatch.from_arrays([terms if i == at else c for i, c in enumerate(part.columns)], names)

    names = ["terms" if c == "text" else c for c in texts.columns]
    return texts.mapInArrow(run, ", ".join("terms binary" if f.name == "text" else f"`{f.name}` {f.dataType.simpleString()}"
                                           for f in texts.schema))


def _terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all words, first word of each text) of a ``terms`` column."""
    raw, off = utf8(column)
    return np.frombuffer(raw.tobytes(), "<u2"), off // 2


def _sorted_pairs(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Ascending keys ``high << bits | low``; half-width keys sort faster, where they hold them."""
    narrow = not len(high) or int(high.max()) < 1 << (32 - bits)
    key = (high.astype(np.uint32 if narrow else np.uint64) << np.array(bits, np.uint32 if narrow else np.uint64)[()]) | low.astype(
        np.uint32 if narrow else np.uint64)
    key.sort()
    return key


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def document_frequencies(terms: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each hashed term, documents), over all rows of ``terms``."""

    def run(batches):
        count, rows = np.zeros(1 << TERM_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "terms", FIT_BYTES):
                term, first = _terms_of(part.column(0))
                pair = _sorted_pairs(np.repeat(np.arange(len(first) - 1), np.diff(first)), term, TERM_BITS)
                count += np.bincount((pair[_starts(pair)] & ((1 << TERM_BITS) - 1)).astype(np.int64), minlength=1 << TERM_BITS)
                rows += part.num_rows
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(count[held], rows))], ["term", "n"])

    # at most 2^TERM_BITS + 1 rows reach the driver
    table = (terms.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))).toArrow()
    term, n = table.column("term").to_numpy(), table.column("n").to_numpy()
    out = np.zeros(1 << TERM_BITS, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def run_sums(source: np.ndarray, index: np.ndarray, start: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """weight-ed sums of source[index[start:start + length]] of runs. Runs are cut at RUN_ROWS rows, and as small matrix
    products they are padded to a power of two, so at most twice their rows are read."""
    parts = -(-length // RUN_ROWS)
    cut = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN_ROWS
    begin, n = np.repeat(start, parts) + cut, np.minimum(np.repeat(length, parts) - cut, RUN_ROWS)
    out = np.empty((len(begin), source.shape[1]), np.float32)
    size = 1
    while size <= RUN_ROWS:
        mine = np.flatnonzero((n <= size) & (n > size // 2))
        place, step = np.arange(size), max(1, CACHED_ROWS // size)
        for lo in range(0, len(mine), step):
            some = mine[lo:lo + step]
            at = np.minimum(begin[some][:, None] + place, len(index) - 1)
            w = np.where(place < n[some][:, None], weight[at], np.float32(0))
            out[some] = np.matmul(w[:, None, :], source.take(index[at], axis=0))[:, 0]
        size *= 2
    if len(out) == len(start):
        return out
    return run_sums(out, np.arange(len(out)), np.cumsum(parts) - parts, parts, np.ones(len(out), np.float32))


def _gram_product(passages: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A^T (A x), where A's rows are the normalised TF-IDF vectors of ``passages`` (terms, weight)
    in windows of FIT_WINDOW words. Tasks send their part by blocks of terms."""
    spark = passages.sparkSession
    held = spark.sparkContext.broadcast((idf, (x * idf[:, None]).astype(np.float32)))
    rank = x.shape[1]

    def run(batches):
        idf_, x_ = held.value
        total = np.zeros((1 << TERM_BITS, rank))
        for batch in batches:
            for part in slices(batch, "terms", FIT_BYTES):
                term, first = _terms_of(part.column(0))
                n = np.diff(first)
                if not len(term):
                    continue
                count = -(-n // FIT_WINDOW)  # windows of each text
                doc = np.repeat(np.arange(len(n)), count)
                begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * FIT_WINDOW
                size = np.minimum(n[doc] - begin, FIT_WINDOW)
                y = run_sums(x_, term.astype(np.int64), first[doc] + begin, size, np.ones(len(term), np.float32))
                # cells (term, window) with their counts; a window's norm is of its distinct terms
                bits = max(1, int(len(doc) - 1).bit_length())
                cell = _sorted_pairs(term, np.repeat(np.arange(len(doc)), size), bits)
                at = _starts(cell)
                tf, cell = np.diff(np.append(at, len(cell))), cell[at].astype(np.int64)
                t, window = cell >> bits, cell & ((1 << bits) - 1)
                norm = np.bincount(window, weights=(tf * idf_[t]) ** 2, minlength=len(doc))
                y *= (part.column(1).to_numpy()[doc] / np.maximum(norm, 1e-12)).astype(np.float32)[:, None]
                at = _starts(t)
                total[t[at]] += run_sums(y, window, at, np.diff(np.append(at, len(t))), tf.astype(np.float32))
        total = (total * idf_[:, None]).astype(np.float32)
        held_terms = np.flatnonzero(total.any(axis=1))
        block = held_terms // BLOCK_TERMS
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else block
        parts = [(int(block[i]), held_terms[i:j].astype(np.int32).tobytes(), total[held_terms[i:j]].tobytes())
                 for i, j in zip(edges, [*edges[1:], len(block)], strict=False)]
        yield _block_rows(parts)

    def add(batches):
        last, total = None, None
        for batch in batches:
            for block, terms, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != last:
                    if last is not None:
                        yield _block_rows([(last, b"", total.astype(np.float32).tobytes())])
                    last, total = block, np.zeros((BLOCK_TERMS, rank))
                at = np.frombuffer(terms, np.int32)
                total[at - block * BLOCK_TERMS] += np.frombuffer(part, np.float32).reshape(len(at), rank)
        if last is not None:
            yield _block_rows([(last, b"", total.astype(np.float32).tobytes())])

    sums = (passages.select("terms", "weight").mapInArrow(run, "block long, terms binary, part binary").repartition("block")
            .sortWithinPartitions("block").mapInArrow(add, "block long, terms binary, part binary"))
    out = np.zeros((1 << TERM_BITS, rank), np.float32)
    # one row a block of terms: 2^TERM_BITS * rank numbers in all, whatever the input
    table = sums.toArrow()
    for block, part in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), strict=True):
        out[block * BLOCK_TERMS:(block + 1) * BLOCK_TERMS] = np.frombuffer(part, np.float32).reshape(BLOCK_TERMS, rank)
    held.destroy()
    return out


def _block_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                      ["block", "terms", "part"])


def latent_space(docs: DataFrame, items: DataFrame, rank: int = RANK, power_steps: int = POWER_STEPS,
                 fit_documents: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(term vectors scaled by idf, singular values): word w's latent vector is row term(w).

    Idf and the fit take all documents, unless ``fit_documents`` asks for a trial on fewer.
    Benchmark passages weigh as much as the documents all together, so the space holds what sets
    items apart from each other and from the corpus.
    """
    # words are told apart and hashed once; each pass of the fit reads their terms
    terms = materialise(_word_terms(docs.select("text")), "terms")
    df, rows = document_frequencies(terms)
    idf = np.log((1 + rows) / (1 + df)) + 0.1
    fitted = terms
    if fit_documents is not None:
        chosen = (docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
                  .limit(fit_documents).distinct())
        fitted, rows = _word_terms(docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")), fit_documents
    n_items = max(1, items.count())
    passages = fitted.select("terms", F.lit(1.0).alias("weight")).unionByName(
        _word_terms(items.select("text")).select("terms", F.lit(max(1.0, 4.0 * rows / n_items)).alias("weight")))
    x = np.random.default_rng(5).standard_normal((1 << TERM_BITS, rank), np.float32)
    for _ in range(1 + power_steps):
        product = _gram_product(passages, idf, x)
        x, r = np.linalg.qr(product)
    forget(terms)
    values = np.sqrt(np.maximum(np.abs(np.diag(r)), 0))
    return (x * idf[:, None]).astype(np.float32), values


def window_size(words: int) -> int:
    """Window of the size class of a passage, in steps of eight words: three quarters of it hold
    the passage, so that one of the windows a quarter apart holds it whole."""
    return max(8, -(-4 * words // 3) + 7 & ~7)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence of two word sequences (bit-parallel rows)."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


_SENTENCE = re.compile(r"(?<=[.?!:])\s+|\n+")


class Items:
    """Benchmark items of a block: words, answers, and latent vectors of their passages."""

    def __init__(self, rows, vectors: np.ndarray):
        self.ids, self.words, self.arrays, self.answers = [], [], [], []
        passages: dict[int, list] = {}
        for item_id, text in rows:
            h = self._hashes(text or "")
            if not len(h):
                continue
            sentences = [s for s in _SENTENCE.split(text) if len(self._hashes(s))]
            answer = self._hashes(sentences[-1]) if len(sentences) > 1 else h[-max(1, len(h) // 3):]
            number = len(self.ids)
            self.ids.append(item_id)
            self.words.append(h.tolist())
            self.arrays.append(h)
            self.answers.append(answer.tolist())
            if len(h) < WINDOW_WORDS:
                continue
            parts = -(-len(h) // PASSAGE_WORDS)
            for p in np.array_split(h, parts):
                z = vectors[_terms(p)].sum(axis=0)
                norm = np.linalg.norm(z)
                if norm > 0:
                    passages.setdefault(window_size(len(p)), []).append((number, z / norm))
        self.classes = {w: (np.array([n for n, _ in p]), np.array([z for _, z in p], np.float32)) for w, p in passages.items()}
        distinct = [np.unique(x, return_counts=True) for x in self.arrays]
        self.least = np.array([len(x) if len(x) < SHORT_WORDS else LIKELY_SHARE * len(x) for x in self.arrays])
        self.vocabulary = np.unique(np.concatenate(self.arrays or [np.zeros(0, np.uint64)]))
        self.first = np.searchsorted(_terms(self.vocabulary), np.arange((1 << TERM_BITS) + 1))
        self.spots = [np.searchsorted(self.vocabulary, x) for x, _ in distinct]  # places of an item's distinct words
        self.long, self.short = (self._postings([n for n, x in enumerate(self.arrays) if (len(x) < WINDOW_WORDS) == short], distinct)
                                 for short in (False, True))

    def _postings(self, numbers: list[int], distinct: list):
        """Inverted index of some items: (first posting of each word of the vocabulary, item and count of postings)."""
        word = np.concatenate([self.spots[n] for n in numbers] or [np.zeros(0, np.int64)])
        count = np.concatenate([distinct[n][1] for n in numbers] or [np.zeros(0, np.int64)])
        item = np.repeat(np.array(numbers, np.int64), [len(self.spots[n]) for n in numbers])
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1)), item[order], count[order]

    def known(self, h: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or the vocabulary's length: words of one term stand side by side there."""
        out = np.full(len(h), len(self.vocabulary))
        where = np.flatnonzero(self.first[term] < self.first[term + 1])
        at = self.first[term[where]]
        while len(where):
            same = self.vocabulary[at] == h[where]
            out[where[same]] = at[same]
            go = ~same & (at + 1 < self.first[term[where] + 1])
            where, at = where[go], at[go] + 1
        return out

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        return _words(pa.array([text], pa.string()))[2]

    def holding(self, known: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Keys document * items + item, ascending, of the ``pairs`` (ascending keys; None: all pairs with
        a short item) where the document holds enough of the item's words for ``check``: the words in
        order can't be more than those."""
        starts, items, counts = self.short if pairs is None else self.long
        if not len(items) or (pairs is not None and not len(pairs)):
            return np.zeros(0, np.int64)
        n_items, size, out = len(self.ids), len(self.vocabulary), [np.zeros(0, np.int64)]
        step = max(1, PAIR_CELLS // n_items)  # documents whose sums are held at once
        for d in range(0, len(first) - 1, step):
            e = min(d + step, len(first) - 1)
            wanted = None if pairs is None else pairs[slice(*np.searchsorted(pairs, [d * n_items, e * n_items]))]
            if wanted is not None and not len(wanted):
                continue
            word = known[first[d]:first[e]]
            there = np.flatnonzero(word < size)
            doc = np.repeat(np.arange(e - d), np.diff(first[d:e + 1]))[there]
            cell = np.sort(doc * size + word[there])
            cell = cell[_starts(cell)]
            doc, at = cell // size, cell % size
            n = starts[at + 1] - starts[at]
            total, sums = np.append(0, np.cumsum(n)), np.zeros((e - d) * n_items)
            cut = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], PAIR_CELLS)), len(at)))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                post = np.arange(n[a:b].sum()) + np.repeat(starts[at[a:b]] - np.cumsum(n[a:b]) + n[a:b], n[a:b])
                sums += np.bincount(np.repeat(doc[a:b] * n_items, n[a:b]) + items[post], weights=counts[post], minlength=len(sums))
            if wanted is None:
                out.append(d * n_items + np.flatnonzero((sums.reshape(-1, n_items) >= self.least).ravel()))
            else:
                out.append(wanted[sums[wanted - d * n_items] >= self.least[wanted % n_items]])
        return np.concatenate(out)

    def places(self, number: int, words: np.ndarray) -> list[tuple[int, int]]:
        """Stretches (start, end) of words (places in the vocabulary) that hold enough of the item's words for ``check``."""
        m = len(self.arrays[number])
        stretch = m if m < SHORT_WORDS else m + m // 2
        mine = np.zeros(len(self.vocabulary) + 1, bool)
        mine[self.spots[number]] = True
        total = np.append(0, np.cumsum(mine[words]))
        start = np.arange(max(1, len(words) - stretch + 1))
        good = start[total[np.minimum(start + stretch, len(words))] - total[start] >= self.least[number]]
        if not len(good):
            return []
        # neighbouring starts are one place, of a stretch at most
        runs = np.flatnonzero(np.append(True, (good[1:] - good[:-1] > 1)))
        out = []
        for a, b in zip(good[runs].tolist(), good[np.append(runs[1:], len(good)) - 1].tolist(), strict=True):
            out += [(s, min(min(s + stretch, b + 1) + stretch - 1, len(words))) for s in range(a, b + 1, stretch)]
        return out

    def may_hold(self, number: int, held: np.ndarray) -> bool:
        """Whether enough of the item's words are among ``held`` (sorted, not empty): the words in
        order can't be more than those."""
        item = self.arrays[number]
        there = held[np.minimum(np.searchsorted(held, item), len(held) - 1)] == item
        return there.sum() >= LIKELY_SHARE * len(item)

    def check(self, number: int, words: np.ndarray, lo: int, hi: int):
        """(lcs share, answer share) if the item stands in or about words[lo:hi), else None."""
        item = self.words[number]
        m = len(item)
        near = words[max(0, lo - m):hi + m]
        if not self.may_hold(number, np.unique(near)):
            return None
        around = near.tolist()
        if m < SHORT_WORDS:
            whole = any(around[i:i + m] == item for i in range(len(around) - m + 1))
            return (1.0, 1.0) if whole else None
        # words in order within a stretch of the item's length and a half
        held = set(item)
        step, stretch = max(1, m // 4), m + m // 2
        best = answer = 0.0
        for at in range(0, max(1, len(around) - stretch + step), step):
            part = around[at:at + stretch]
            if sum(w in held for w in part) < LIKELY_SHARE * m:
                continue
            share = lcs_length(item, part) / m
            if share > best:
                best, answer = share, lcs_length(self.answers[number], part) / len(self.answers[number])
        if best >= SURE_SHARE or (best >= LIKELY_SHARE and answer >= ANSWER_SHARE):
            return best, answer
        return None


class _Prefix:
    """Prefix sums of the words' vectors, every two words: windows start and end at even words of their
    text, but for its last one."""

    def __init__(self, term: np.ndarray, first: np.ndarray, vectors: np.ndarray):
        n, rank = np.diff(first), vectors.shape[1]
        pairs = (n + 1) // 2
        self.shift = 2 * (np.cumsum(pairs) - pairs) - first[:-1]  # from a word to its row, texts padded to even lengths
        rows = -(-int(2 * pairs.sum()) // (2 * SCAN_ROWS)) * 2 * SCAN_ROWS
        held = np.zeros(rows, bool)
        held[np.arange(len(term)) + np.repeat(self.shift, n)] = True
        padded = np.zeros(rows, np.int64)
        padded[held] = term
        self.each = vectors.take(padded, axis=0)
        self.each[~held] = 0
        inner = np.matmul(np.tril(np.ones((SCAN_ROWS, SCAN_ROWS), np.float32)),
                          (self.each[::2] + self.each[1::2]).reshape(-1, SCAN_ROWS, rank))
        before = np.zeros((len(inner), 1, rank))
        np.cumsum(inner[:-1, -1], axis=0, dtype=np.float64, out=before[1:, 0])
        self.total = np.zeros((rows // 2 + 1, rank))
        np.add(inner, before, out=self.total[1:].reshape(inner.shape))

    def between(self, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sums of the words lo to hi of the documents."""
        lo, hi = lo + self.shift[doc], hi + self.shift[doc]
        x = (self.total.take((hi + 1) >> 1, axis=0) - self.total.take((lo + 1) >> 1, axis=0)).astype(np.float32)
        odd = np.flatnonzero(lo & 1)
        x[odd] += self.each[lo[odd]]
        return x


def _hits(texts: pa.Array, items: Items, vectors: np.ndarray, least: float) -> list[tuple]:
    """(row, item_id, cosine, lcs share, answer share, first word) of every text and item found."""
    _, _, h, first = _words(texts)
    rows: list[tuple] = []
    if not len(h) or not items.ids:
        return rows
    term = _terms(h)
    near = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),) + (np.zeros(0, np.int64),) * 2]
    sums = _Prefix(term, first, vectors)
    for size, (numbers, z) in items.classes.items():
        doc, lo, hi = windows(first, size)
        step = max(1, CACHED_ROWS // 8)
        for a in range(0, len(lo), step):
            x = sums.between(doc[a:a + step], lo[a:a + step], hi[a:a + step])
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-12))
            cosine = x @ z.T
            at = np.flatnonzero((cosine >= (least * norm)[:, None]).ravel())
            i, j = at // len(z), at % len(z)
            near.append((doc[a + i], numbers[j], cosine[i, j] / norm[i], lo[a + i], hi[a + i]))
    doc, number, cosine, lo, hi = (np.concatenate(x) for x in zip(*near, strict=True))
    pair, known = doc * len(items.ids) + number, items.known(h, term)
    held = items.holding(known, first, np.unique(pair))
    keep = np.append(held, -1)[np.searchsorted(held, pair)] == pair
    pair, cosine, lo, hi = (x[keep] for x in (pair, cosine, lo, hi))
    order = np.lexsort((lo, -cosine, pair))
    pair, cosine, lo, hi = (x[order] for x in (pair, cosine, lo, hi))
    edge = _starts(pair)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(pair)], strict=False):
        d, k = divmod(int(pair[a]), len(items.ids))
        words, m = h[first[d]:first[d + 1]], len(items.words[k])
        start, end = lo[a:b] - first[d], hi[a:b] - first[d]
        # a window without a place of enough of the item's words about it has nothing to check
        about = np.zeros(b - a, bool)
        for x, y in items.places(k, known[first[d]:first[d + 1]]):
            about |= (x < end + m) & (y > start - m)
        for i in np.flatnonzero(about).tolist():
            ok = items.check(k, words, int(start[i]), int(end[i]))
            if ok:
                rows.append((d, items.ids[k], float(cosine[a + i]), *ok, int(start[i])))
                break
    for key in items.holding(known, first).tolist():
        d, k = divmod(key, len(items.ids))
        words = h[first[d]:first[d + 1]]
        for start, end in items.places(k, known[first[d]:first[d + 1]]):
            ok = items.check(k, words, start, end)
            if ok:
                rows.append((d, items.ids[k], None, *ok, start))
                break
    return rows


def _search(docs: DataFrame, items: Items, vectors: np.ndarray, least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((items, vectors))

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SEARCH_BYTES):
                cols = list(zip(*_hits(part.column(1), *held.value, least), strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())).cast(pa.int64()), pa.array(cols[1], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT_DDL)


def _without(docs: DataFrame, items: Items, vectors: np.ndarray, least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((items, vectors))
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=SEARCH_BYTES):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in _hits(part.column(at), *held.value, least)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of windows of ``size`` words, a quarter apart; each document's last
    window ends with it, and a shorter document is one window."""
    n = np.diff(first)
    step = size // 4
    count = np.where(n > 0, np.maximum(0, -(-(n - size) // step)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(np.minimum(number * step, n[doc] - size), 0)
    return doc, first[doc] + start, first[doc] + np.minimum(start + size, n[doc])


def _item_blocks(docs: DataFrame, benchmark: DataFrame, item_block: int, **options):
    """Blocks of about ``item_block`` items with the term vectors: a pass over the documents each."""
    items = benchmark.select("item_id", "text").where("item_id is not null and octet_length(text) > 0").distinct()
    vectors, _ = latent_space(docs, items, **options)
    blocks = max(1, -(-items.count() // item_block))
    numbered = items.withColumn("item_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = numbered.where(F.col("item_block") == b).orderBy("item_id", "text").toLocalIterator()
        yield Items([(r["item_id"], r["text"]) for r in rows], vectors), vectors


def contaminated(docs: DataFrame, benchmark: DataFrame, least_cosine: float = LEAST_COSINE, item_block: int = ITEM_BLOCK,
                 **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word): items found in documents.

    An item is found where ``SURE_SHARE`` of its words stand in order within one and a half times
    its length, or ``LIKELY_SHARE`` of them and ``ANSWER_SHARE`` of its answer's words, in a window
    that the latent search names (see the README for its measured recall), or, for items of under
    ``WINDOW_WORDS`` words, anywhere (their ``cosine`` is NULL). One row per document and item: the
    best window by cosine that passes the check. NULL and empty texts hold
    nothing, NULL and empty items are in nothing; NULL doc_ids are reported as NULL; repeated rows
    give one row, items with equal text one row each; an empty table gives an empty result.
    Other columns are ignored.
    """
    out = None
    for items, vectors in _item_blocks(docs, benchmark, item_block, **options):
        found = _search(docs, items, vectors, least_cosine)
        out = found if out is None else out.unionByName(found)
    return (out.groupBy("doc_id", "item_id").agg(F.max(F.struct("cosine", "lcs_share", "answer_share", "first_word")).alias("x"))
            .select("doc_id", "item_id", "x.*"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_cosine: float = LEAST_COSINE, item_block: int = ITEM_BLOCK,
               **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever these are
    called; no shuffle of texts.

    NULL and empty texts hold nothing and stay, rows with a NULL id are judged like others, repeated
    rows stay or go together; NULL and empty items are in nothing; an empty table gives an empty
    result.
    """
    out = docs
    for items, vectors in _item_blocks(docs, benchmark, item_block, **options):
        out = _without(out, items, vectors, least_cosine)
    return out
