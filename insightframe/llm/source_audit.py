"""How far the sources of a language differ in their words, by chunk factorisation.

White space never stands in a term, so texts are first cut into white-space chunks and counted
chunk by chunk within each document. Tasks add the counts up by (chunk, language, source) and deal
them by chunk: a chunk that occurs anywhere is tokenised once, where all its counts are, and its
terms are joined back to them on the spot. The (language, source, term) counts are then dealt by
language and term.

Which terms stand in enough documents of their language is decided without moving documents. A
count carries the rows that it stems from as long as these are fewer than ``MIN_DOCUMENTS``, and
beyond that only the fact. Where counts meet (a document may hold a term in several chunks) the rows
are united, so the number of distinct documents is exact up to the bound. A document has one
source, so numbers of sources add up.
"""
from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MIN_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
BLOCK_TERMS = 4096   # terms of one cell of the pair sums
BLOCK_SOURCES = 128  # sources of one side of a cell, on average
HELD_WORDS = 4_000_000  # words, or counts, that a task adds up at once
HELD_CHUNKS = 1_000_000

# A-Z, a-z and the bytes of all characters beyond ASCII
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_NONE = np.iinfo(np.int64).max  # no row


def terms_of(chunk: str) -> list[str]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return [t.lower().decode() for t in _TERM.findall(chunk.encode())]


def merged(key: np.ndarray, n: np.ndarray, many: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Counts of equal ``key`` made one: (key, n, many, a, b) with ``many`` distinct rows, at most
    ``MIN_DOCUMENTS``; the rows are a (and b) as long as there are fewer."""
    names, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, at, n)
    enough = np.zeros(len(names), bool)
    enough[at[many >= MIN_DOCUMENTS]] = True
    rows = np.concatenate([a[many < MIN_DOCUMENTS], b[many < MIN_DOCUMENTS]])
    owner = np.concatenate([at[many < MIN_DOCUMENTS]] * 2)
    real = rows != _NONE
    rows, owner = rows[real], owner[real]
    order = np.lexsort((rows, owner))
    rows, owner = rows[order], owner[order]
    once = np.append(True, (rows[1:] != rows[:-1]) | (owner[1:] != owner[:-1])) if len(rows) else np.zeros(0, bool)
    rows, owner = rows[once], owner[once]
    found = np.bincount(owner, minlength=len(names))
    first = np.cumsum(found) - found
    out_many = np.where(enough, MIN_DOCUMENTS, np.minimum(found, MIN_DOCUMENTS))
    few = out_many < MIN_DOCUMENTS
    out_a, out_b = np.full(len(names), _NONE), np.full(len(names), _NONE)
    has = few & (found > 0)
    out_a[has] = rows[first[has]]
    has = few & (found > 1)
    out_b[has] = rows[first[has] + 1]
    return names, total, out_many, out_a, out_b


def _counted(names: list, group: list[tuple[str, str]], which: np.ndarray, grp: np.ndarray, n, many, a, b) -> pa.RecordBatch:
    """A batch of counts; ``which`` and ``grp`` number names and groups."""
    part = pa.array(grp.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(which)), pa.array([g[0] for g in group], pa.string()).take(part),
         pa.array([g[1] for g in group], pa.string()).take(part), pa.array(n.astype(np.int64)), pa.array(many.astype(np.int32)),
         pa.array(a, mask=a == _NONE), pa.array(b, mask=b == _NONE)], ["name", "lang", "source", "n", "many", "a", "b"])


COUNTS = "name string, lang string, source string, n long, many int, a long, b long"


def chunk_counts(docs: DataFrame, held_words: int = HELD_WORDS, held_chunks: int = HELD_CHUNKS) -> DataFrame:
    """Counts (name, lang, source, n, many, a, b) of the white-space chunks in each group, added up
    within tasks."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        held = _Words()
        for batch in batches:
            for lang, source, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add(lang, source, text, row)
                if held.words >= held_words or len(held.number) >= held_chunks:
                    yield from held.counts()
                    held = _Words()
        yield from held.counts()

    return named.mapInArrow(run, COUNTS)


class _Words:
    """Chunks of some documents, by number."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.group: dict[tuple[str, str], int] = {}
        self.ids, self.size, self.row, self.grp, self.words = [], [], [], [], 0

    def add(self, lang: str, source: str, text: str, row: int):
        chunks = text.encode().split()  # bytes split at ASCII white space only
        if chunks:
            self.ids.append(np.fromiter(map(self.number.__getitem__, chunks), np.int32, len(chunks)))
            self.size.append(len(chunks))
            self.row.append(row)
            self.grp.append(self.group.setdefault((lang, source), len(self.group)))
            self.words += len(chunks)

    def counts(self):
        if not self.words:
            return
        # chunks in byte order: equal and similar ones travel side by side
        names = pa.array(list(self.number), pa.binary())
        order = pc.sort_indices(names).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row, grp = np.array(self.row, np.int64), np.array(self.grp, np.int64)
        by = np.lexsort((row, grp))  # a group's documents side by side
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        pair = np.sort((rank[np.concatenate(self.ids)] << 32) | np.repeat(place, self.size))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        times = np.diff(np.append(first, len(pair)))
        which, doc = pair[first] >> 32, by[pair[first] & 0xFFFFFFFF]
        cell = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (grp[doc[1:]] != grp[doc[:-1]])))
        many = np.diff(np.append(cell, len(which)))
        a = np.where(many < MIN_DOCUMENTS, row[doc[cell]], _NONE)
        b = np.where((many < MIN_DOCUMENTS) & (many > 1), row[doc[np.minimum(cell + 1, len(doc) - 1)]], _NONE)
        n = np.add.reduceat(times, cell)
        names = names.take(pa.array(order)).cast(pa.string())
        groups = list(self.group)
        for lo in range(0, len(cell), 100_000):
            at = slice(lo, lo + 100_000)
            yield _counted(names, groups, which[cell[at]], grp[doc[cell[at]]], n[at], np.minimum(many[at], MIN_DOCUMENTS), a[at], b[at])


class _Counts:
    """Counts of some names and groups, to be merged."""

    def __init__(self):
        self.name: dict[str, int] = {}
        self.group: dict[tuple[str, str], int] = {}
        self.parts: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, which, grp, n, many, a, b):
        self.parts.append([which, grp, n, many, a, b])
        self.rows += len(n)

    def merge(self):
        """(names, groups) numbers and merged columns, by name and group."""
        which, grp, n, many, a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key, n, many, a, b = merged(which * (len(self.group) + 1) + grp, n, many, a, b)
        return key // (len(self.group) + 1), key % (len(self.group) + 1), n, many, a, b


def _columns(batch):
    """n, many, a, b of a batch as arrays."""
    n, many = batch.column(3).to_numpy(), batch.column(4).to_numpy().astype(np.int64)
    a, b = (pc.fill_null(batch.column(i), _NONE).to_numpy() for i in (5, 6))
    return n, many, a, b


def _grouped(batch, group: dict) -> np.ndarray:
    lang, source = (batch.column(i).dictionary_encode() for i in (1, 2))
    li, si = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    pair, at = np.unique(li * len(sources) + si, return_inverse=True)
    known = np.array([group.setdefault((langs[p // len(sources)], sources[p % len(sources)]), len(group)) for p in pair.tolist()], np.int64)
    return known[at]


def term_counts(docs: DataFrame, held_words: int = HELD_WORDS, held_chunks: int = HELD_CHUNKS) -> DataFrame:
    """(lang, source, term, n): occurrences in each group of the terms that at least
    ``MIN_DOCUMENTS`` documents of the language hold."""

    def tokenised(batches):
        held = _Counts()
        last, cut = None, []  # the chunk read last and its terms: a chunk's counts come side by side
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(0).dictionary_encode()
            numbers = []
            for c in chunk.dictionary.to_pylist():
                if c != last:
                    found: dict[int, int] = {}
                    for t in terms_of(c):
                        k = held.name.setdefault(t, len(held.name))
                        found[k] = found.get(k, 0) + 1
                    last, cut = c, found
                numbers.append(cut)
            size = np.array([len(x) for x in numbers], np.int64)
            flat = np.array([k for x in numbers for k in x], np.int64)
            times = np.array([k for x in numbers for k in x.values()], np.int64)
            start = np.cumsum(size) - size
            at = chunk.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size[at])
            spot = np.arange(len(row)) - np.repeat(np.cumsum(size[at]) - size[at], size[at]) + start[at][row]
            n, many, a, b = _columns(batch)
            held.add(flat[spot], _grouped(batch, held.group)[row], n[row] * times[spot], many[row], a[row], b[row])
            if held.rows >= held_words or len(held.name) >= held_chunks:
                yield from _merged_batches(held)
                held, last = _Counts(), None
        yield from _merged_batches(held)

    def kept(batches):
        held = _Counts()
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0).dictionary_encode()
            known = np.array([held.name.setdefault(t, len(held.name)) for t in name.dictionary.to_pylist()], np.int64)
            held.add(known[name.indices.to_numpy()], _grouped(batch, held.group), *_columns(batch))
            if held.rows >= held_words:  # all but the term read last are complete
                out, held = _kept_batch(held, batch.column(0)[batch.num_rows - 1].as_py())
                yield out
        yield _kept_batch(held, None)[0]

    chunks = chunk_counts(docs, held_words, held_chunks).repartition("name").sortWithinPartitions("name")
    terms = chunks.mapInArrow(tokenised, COUNTS).repartition("lang", "name").sortWithinPartitions("name")
    return terms.mapInArrow(kept, "lang string, source string, term string, n long")


def _merged_batches(held: _Counts):
    if not held.rows:
        return
    which, grp, n, many, a, b = held.merge()
    names, groups = pa.array(list(held.name), pa.string()), list(held.group)
    for lo in range(0, len(n), 100_000):
        at = slice(lo, lo + 100_000)
        yield _counted(names, groups, which[at], grp[at], n[at], many[at], a[at], b[at])


def _kept_batch(held: _Counts, going: str | None) -> tuple[pa.RecordBatch, _Counts]:
    """Counts of the terms with enough documents in their language; and what is held of the term
    ``going`` that may go on."""
    left = _Counts()
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
    if not held.rows:
        return pa.RecordBatch.from_pylist([], schema=schema), left
    which, grp, n, many, a, b = held.merge()
    names, groups = pa.array(list(held.name), pa.string()), list(held.group)
    if going is not None:
        open_ = which == held.name[going]
        left.name[going] = 0
        left.group = dict(held.group)
        left.add(np.zeros(int(open_.sum()), np.int64), grp[open_], n[open_], many[open_], a[open_], b[open_])
        which, grp, n, many = which[~open_], grp[~open_], n[~open_], many[~open_]
    langs = {g[0]: i for i, g in enumerate(groups)}
    lang = np.array([langs[g[0]] for g in groups], np.int64)[grp] if len(grp) else grp
    key, at = np.unique(which * (len(groups) + 1) + lang, return_inverse=True)
    enough = np.bincount(at, weights=many, minlength=len(key))[at] >= MIN_DOCUMENTS if len(key) else np.zeros(0, bool)
    out = _counted(names, groups, which[enough], grp[enough], n[enough], many[enough], n[enough], n[enough])
    return pa.RecordBatch.from_arrays([out.column(1), out.column(2), out.column(0), out.column(3)], schema=schema), left


def shares(n: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / (total + size)), exact for totals up to 9 * 10^15."""
    below = total + size
    out, rest = np.divmod(n + 1, below)
    for _ in range(3):  # 10^9 in three steps, so that nothing passes 64 bits
        step, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + step
    return out + 1


def _share(n, total, size):
    """``shares`` as a Column."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * ({n} + 1)) div cast(greatest({total} + {size}, 1) as decimal(20,0))")


def _pair_cell(key, table):
    """Partial sums of one cell: (lang, source, item, value, seen) for all ordered pairs of its two
    blocks of sources, over the terms that any of them holds."""
    lang, _, left, right = (k.as_py() for k in key)
    mark = pa.compute.is_null(table.column("term"))
    # markers name every source of the cell, also those that hold none of its terms
    marks = table.filter(mark).sort_by([("source", "ascending")])
    rows = table.filter(pa.compute.invert(mark))
    names = marks.column("source").to_pylist()
    number = {s: i for i, s in enumerate(names)}
    total = np.array(marks.column("n").to_pylist(), np.int64)
    side = np.array(marks.column("side").to_pylist(), np.int64)
    size = marks.column("size")[0].as_py()
    terms = pa.compute.dictionary_encode(rows.column("term").combine_chunks())
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    at = np.array(terms.indices.to_pylist(), np.int64)
    who = np.array([number[s] for s in rows.column("source").to_pylist()], np.int64)
    count = np.zeros((len(names), int(at.max()) + 1 if len(at) else 0), np.int64)
    count[who, at] = np.array(rows.column("n").to_pylist(), np.int64)
    share = shares(count, total[:, None], size)
    source, item, value = [], [], []
    for i, name in enumerate(names):
        other = np.flatnonzero((side != side[i]) if left != right else (np.arange(len(names)) != i))
        apart = share[i] - share[other]
        source += [name] * len(other)
        item += [names[j] for j in other]
        value += (apart * apart // share[other]).sum(axis=1).tolist()
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": pa.array(source, pa.string()),
                     "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()),
                     "seen": pa.array([count.shape[1]] * len(value), pa.int64())})


def _pairs(counts: DataFrame, groups: DataFrame, block_terms: int, block_sources: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    Cells of a block of terms and two blocks of sources hold dense counts; terms that stand nowhere
    in a cell add one constant each, multiplied at the end.
    """
    blocks = F.greatest(F.ceil(F.col("size") / block_terms), F.lit(1))
    sides = F.ceil(F.col("sources") / block_sources)
    group = groups.select("lang", "source", "total", "size", blocks.alias("blocks"), sides.alias("sides"),
                          F.pmod(F.xxhash64("source"), sides).alias("side"))
    marks = group.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang", "source", "block", "side", "sides", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "size")
    rows = counts.join(group, ["lang", "source"]).select(
        "lang", "source", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "side", "sides", "term", "n", "size")
    cells = (marks.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
             .withColumn("left", F.least("side", "other")).withColumn("right", F.greatest("side", "other")))
    parts = cells.select("lang", "block", "left", "right", "source", "side", "term", "n", "size").groupBy(
        "lang", "block", "left", "right").applyInArrow(_pair_cell, "lang string, source string, item string, value long, seen long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    own = groups.select("lang", "source", F.col("total").alias("t1"), "size")
    its = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("t2"))
    none = F.expr("(p - q) * (p - q) div q")
    return (summed.join(own, ["lang", "source"]).join(its, ["lang", "item"])
            .withColumn("p", _share("0", "t1", "size")).withColumn("q", _share("0", "t2", "size"))
            .select("lang", "source", "item", F.when(F.col("size") > 0, F.col("value") + (F.col("size") - F.col("seen")) * none)
                    .otherwise(0).alias("value")))


def divergence(docs: DataFrame, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
               block_sources: int = BLOCK_SOURCES, held_words: int = HELD_WORDS, held_chunks: int = HELD_CHUNKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: how far the group's term shares lie from each other source's of the language.
    Part ``term``: the ``top_terms`` kept terms whose share in the group exceeds the language's.
    NULL text, lang and source are read as ''; every group that occurs is reported, also one
    without terms; a language with one source has no pairs. A document is a row: repeated rows and
    rows of one doc_id or none each count. Ranks start at 1 with the greatest value, ties by the
    item's bytes. An empty table gives an empty result; other columns are ignored.
    """
    counts = materialise(term_counts(docs, held_words, held_chunks), "kept")
    size = counts.groupBy("lang").agg(F.count_distinct("term").alias("size"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    many = every.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = materialise(every.join(many, "lang").join(size, "lang", "left").join(held, ["lang", "source"], "left").select(
        "lang", "source", "sources", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("held", F.lit(0)).alias("total")), "groups")
    pair = _pairs(counts, groups, block_terms, block_sources).select("lang", "source", "item", "value", F.lit("pair").alias("part"))

    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    term = (counts.join(groups.select("lang", "source", "total", "size"), ["lang", "source"]).join(whole, ["lang", "term"]).join(lang_total, "lang")
            .withColumn("p", _share("n", "total", "size")).withColumn("q", _share("lang_n", "lang_total", "size"))
            .where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return (pair.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank")
            .unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))
