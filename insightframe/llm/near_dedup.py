"""Near-duplicate groups by chosen-path set similarity join.

Documents are sets of k-word shingles. Equal sets are one class first. In each of several
independent trees a class starts at the root and goes, at every node, to the children named by
the node's chosen minhash coordinates and the class's minwise tokens there: 1 / similarity
children on average, so a linked pair meets at any depth with a chance that falls slowly. Nodes
at ``DEPTH`` with few classes are compared exhaustively. Larger ones that are one group but for
a few classes are compared in blocks, those few with everything; the rest is branched on until
it is small (or compared block by block at ``MAX_DEPTH``). ``TREES`` is set for the wanted recall.

Links are always confirmed on the whole shingle sets. As only groups are asked for, a first
pass compares each class with the least class of its node; afterwards only pairs that are not
in one group yet are compared, so a large group of near copies costs no pairs within.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise, mix64, shingle_sets, slices, utf8
from .components import components

WORDS = 4
SIMILARITY = 80  # per cent, compared exactly in integers
COORDINATES = 128
TREES = 16  # miss chance of a pair at 0.8: (1 - 0.64)^16 < 1e-7, and still below 1e-4 at sketch value 0.7
DEPTH = 3
MAX_DEPTH = 16
SMALL_NODE = 2048
FEW_OTHERS = 256
BLOCK = 1024

_MULT = np.random.default_rng(23).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(s: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minhashes of a non-empty shingle set."""
    out = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(s), 2048):
        out = np.minimum(out, (_MULT[:, None] * s[None, lo:lo + 2048]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, d1, d2, sketch, small): set size, 128-bit digest, minhashes and the low byte of
    each of them (for the cheap test before whole sets are fetched); an empty set has n 0."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*utf8(part.column(1)), words)
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                sketch = [minhashes(s) if len(s) else None for s in sets]
                small = [None if x is None else x.astype(np.uint8).tobytes() for x in sketch]
                sketch = [None if x is None else x.tobytes() for x in sketch]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(n), pa.array(d1), pa.array(d2), pa.array(sketch, pa.binary()),
                     pa.array(small, pa.binary())], ["doc_id", "n", "d1", "d2", "sketch", "small"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary, small binary")


def branch(node: np.ndarray, row: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, sketch row) pairs: the node's hash chooses one coordinate, and with
    chance 1/4 a second, so 1 / 0.8 on average; the class's minhash there names the child."""
    first = mix64(node ^ np.uint64(0xA0761D6478BD642F))
    two = (mix64(node ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(3)) == 0
    second = mix64(node ^ np.uint64(0x8EBC6AF09C88C6E3))
    parent, who = np.concatenate([node, node[two]]), np.concatenate([row, row[two]])
    at = (np.concatenate([first, second[two]]) % np.uint64(COORDINATES)).astype(np.int64)
    token = sketch[who, at].astype(np.uint64)
    return mix64(parent ^ mix64((at.astype(np.uint64) << np.uint64(32)) | token)), who


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def tree_nodes(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, rep) of every class in every tree at ``depth``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, rep = _sketch_rows(batch.column(1)), batch.column(0).to_numpy()
            for tree in range(trees):
                node = np.full(len(rep), mix64(np.array([tree + 1], np.uint64))[0])
                row = np.arange(len(rep))
                for _ in range(depth):
                    node, row = branch(node, row, sketch)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rep[row])], ["node", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "node long, rep long")


def _deeper(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Children (node, rep, label) of rows (node, rep, label)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, row = branch(batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows), _sketch_rows(batch.column(3)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(1).take(pa.array(row)),
                                              batch.column(2).take(pa.array(row))], ["node", "rep", "label"])

    return (rows.join(classes.select("rep", "sketch"), "rep").select("node", "rep", "label", "sketch")
            .mapInArrow(run, "node long, rep long, label long").distinct())


def _least(per_cent: int) -> float:
    """Agreeing coordinates that a linked pair falls short of once in 10^6 (5 deviations)."""
    p = per_cent / 100
    return (p - 5 * np.sqrt(p * (1 - p) / COORDINATES)) * COORDINATES


def _alike(small: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, per_cent: int) -> np.ndarray:
    """(rows, rows) mask, above the diagonal: pairs of different labels (and, of two sides, of
    different sides) whose sizes allow a link and whose byte sketches agree often enough."""
    m = len(n)
    out = np.zeros((m, m), bool)
    for lo in range(0, m, 32):
        hi = min(m, lo + 32)
        ok = (small[lo:hi, None, :] == small[None, :, :]).sum(axis=2, dtype=np.int16) >= _least(per_cent)
        ok &= 100 * np.minimum(n[lo:hi, None], n[None]) >= per_cent * np.maximum(n[lo:hi, None], n[None])
        out[lo:hi] = ok & (label[lo:hi, None] != label[None])
    if len(np.unique(side)) > 1:
        out &= side[:, None] != side[None]
    return np.triu(out, 1)


def _with_small(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select("rep", "n", "small"), "rep")


def _by_node(rows: DataFrame, columns: list[str], solve, ddl: str) -> DataFrame:
    """``solve(columns of one node)`` for every node, in sorted tasks; nodes are bounded before."""

    def run(batches):
        held: list[list] = [[] for _ in columns]

        def cut():
            out = solve(held) if len(held[0]) > 1 else None
            for h in held:
                h.clear()
            return out

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(len(columns))]
            node = np.array(cols[0], np.int64)
            edges = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
            for lo, hi in zip(edges, [*edges[1:], len(node)], strict=True):
                if held[0] and held[0][-1] != node[lo]:
                    made = cut()
                    if made is not None:
                        yield made
                for h, c in zip(held, cols, strict=True):
                    h += c[lo:hi]
        made = cut()
        if made is not None:
            yield made

    return rows.select(*columns).repartition("node").sortWithinPartitions("node").mapInArrow(run, ddl)


def _likely_rows(rows: DataFrame, per_cent: int) -> DataFrame:
    """Rows (node, rep, label, n, side) with a likely partner in their node: as many as rows at most,
    where pairs would grow with the square of a node."""
    ddl = "node long, rep long, label long, n long, side int"

    def solve(cols):
        node, rep, label, n, side = (np.array(c) for c in cols[:5])
        small = np.frombuffer(b"".join(cols[5]), np.uint8).reshape(-1, COORDINATES)
        pair = _alike(small, n, label, side, per_cent)
        keep = pair.any(axis=0) | pair.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, rep, label, n, side.astype(np.int32))],
                                          ["node", "rep", "label", "n", "side"])

    return _by_node(rows, ["node", "rep", "label", "n", "side", "small"], solve, ddl)


def _overlaps(sets: list[np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Intersection size of the sets of every marked pair, exactly: over the shingles that stand in
    two sets or more, as a product of 0/1 matrices, or pair by pair if that is less work."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    every, where = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, where = every[order], where[order]
    new = np.append(True, every[1:] != every[:-1])
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1
    number, where = number[twice], where[twice]
    names = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    width = int(names[-1]) + 1 if len(names) else 0
    if 2.0 * m * m * width / 2e10 < 2.5e-5 * pair.sum():
        for lo in range(0, width, 4096):
            a, b = np.searchsorted(names, lo), np.searchsorted(names, lo + 4096)
            x = np.zeros((m, 4096), np.float32)
            x[where[a:b], names[a:b] - lo] = 1
            out += np.rint(x @ x.T).astype(np.int64)
    else:
        for i, j in zip(*np.nonzero(pair), strict=True):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return out


def _linked_rows(rows: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """(u, v): links between the labels of a node's rows, confirmed on whole shingle sets; of the
    links between two labels one is given for every node they meet in."""

    def solve(cols):
        _, rep, label, n, side = (np.array(c) for c in cols[:5])
        sets = shingle_sets(*utf8(pa.array(cols[5], pa.large_string())), words)
        small = np.array([minhashes(s).astype(np.uint8) if len(s) else np.zeros(COORDINATES, np.uint8) for s in sets])
        size = np.array([len(s) for s in sets])
        pair = _alike(small, size, label, side, per_cent)
        if not pair.any():
            return None
        both = _overlaps(sets, pair)
        i, j = np.nonzero(pair & (100 * both >= per_cent * (size[:, None] + size[None] - both)))
        ends = np.unique(np.column_stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["u", "v"])

    full = rows.join(texts, rows["rep"] == texts["doc_id"])
    return _by_node(full, ["node", "rep", "label", "n", "side", "text"], solve, "u long, v long")


def _others(rows: DataFrame) -> DataFrame:
    """Cells for nodes (with their ``size`` and largest label ``top``) that are one group but for
    a few rows: those few with every block of the group, and with each other."""
    parts = F.ceil(F.col("size") / BLOCK)
    other = F.col("label") != F.col("top")
    part = F.explode(F.when(other, F.sequence(F.lit(-1).cast("long"), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("rep"), parts))))
    side = F.when(~other, 1).when(F.col("part") < 0, 0).otherwise(-1)
    return rows.withColumn("part", part).select(F.xxhash64("node", "part").alias("node"), "rep", "label", "n", "small", side.alias("side"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Cells of two blocks of BLOCK rows for nodes that stay large: every pair of blocks once."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    cut = rows.join(counts, "node").withColumn("parts", F.ceil(F.col("size") / BLOCK)).withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = cut.withColumn("other", other)
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") == lo, -1).otherwise(1)
    return cells.select(F.xxhash64("node", lo, hi).alias("node"), "rep", "label", "n", "small", side.alias("side"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are linked."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                known: dict = {}
                for ids_, column in ((a, part.column(2)), (b, part.column(3))):
                    new = [i for i, x in enumerate(zip(ids_.tolist(), column.to_pylist(), strict=True)) if x not in known]
                    texts_ = column.take(pa.array(new, pa.int64()))
                    for i, s, t in zip(new, shingle_sets(*utf8(texts_), words), texts_.to_pylist(), strict=True):
                        known[(int(ids_[i]), t)] = s
                ok = []
                for x, y, s, t in zip(a.tolist(), b.tolist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    p, q = known[(x, s)], known[(y, t)]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= per_cent * (len(p) + len(q) - both))
                ok = np.array(ok, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["u", "v"])

    side = [texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    return (pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(run, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, per_cent: int = SIMILARITY, trees: int = TREES,
                    depth: int = DEPTH, max_depth: int = MAX_DEPTH, small_node: int = SMALL_NODE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * intersection >= per_cent * union of their shingle sets;
    ``component_id`` is the least doc_id reachable over links, ``kept`` whether that is the row's own.
    NULL texts and texts without words have no shingles and are linked with nothing. Rows with
    NULL doc_id take no part: their component_id is NULL and they are kept. Repeated rows have one
    component and each come back; rows of one doc_id with different texts are judged each by
    its own text, links of one id confirmed on any of its texts. An empty table gives an empty
    result. Other columns are ignored.
    """
    wide = materialise(sketches(docs, words), "sketches")
    sets = wide.where("n > 0 and doc_id is not null")
    grouped = sets.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("small").alias("small"))
    classes = materialise(grouped, "classes")
    each = materialise(wide.select("doc_id", "n", "d1", "d2"), "each")
    forget(wide)

    nodes = tree_nodes(classes, trees, depth)
    heads = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("head")).where("size > 1")
    shared = materialise(nodes.join(heads, "node").select("node", "rep", "head"), "nodes")

    # the texts of all classes that meet another, moved once; ids grow with the corpus, so they are
    # merged and not broadcast
    met = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.select("doc_id", "text").hint("merge").join(met, "doc_id", "left_semi"), "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("small").alias(f"s_{c}")) for c in "ab")

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (4, 5)]
                n = [batch.column(k).to_numpy() for k in (2, 3)]
                ok = ((s[0] == s[1]).sum(axis=1) >= _least(per_cent)) & (100 * np.minimum(*n) >= per_cent * np.maximum(*n))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], ["a", "b"])

        return (pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long"))

    stars = materialise(likely(shared.where("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()), "stars")
    # one pair a class first; of the others only those that join two groups move texts
    first = components(confirmed(stars.groupBy("b").agg(F.min("a").alias("a")), texts, words, per_cent))
    found_first = materialise(first, "first")
    side = [found_first.select(F.col("vertex").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab"]
    apart = stars.join(side[0], "a", "left").join(side[1], "b", "left").where(
        F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    links = confirmed(apart, texts, words, per_cent).unionByName(
        found_first.where("vertex != component").select(F.col("vertex").alias("u"), F.col("component").alias("v")))
    labels = materialise(components(links), "labels")
    forget(stars, found_first)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, rows["rep"] == labels["vertex"], "left").select(
            "node", "rep", F.coalesce("component", "rep").alias("label"))

    rows, found, level = labelled(shared.select("node", "rep").distinct()), [], depth
    while True:
        kinds = (rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("node")
                 .agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("most"))
                 .where("size > most.k").select("node", "size", "most.k", F.col("most.label").alias("top")))
        mixed = materialise(rows.join(kinds, "node").select("node", "rep", "label", "size", "k", "top"), "mixed")
        small = F.col("size") <= small_node
        few = F.col("size") - F.col("k") <= FEW_OTHERS
        found.append(_with_small(mixed.where(small), classes).select("node", "rep", "label", "n", "small", F.lit(0).alias("side")))
        large = mixed.where(~small)
        if large.isEmpty():
            break
        found.append(_others(_with_small(large.where(few), classes)))
        large = large.where(~few).select("node", "rep", "label")
        if level >= max_depth:
            found.append(_blocks(_with_small(large, classes)))
            break
        rows, level = materialise(_deeper(large, classes), "deeper"), level + 1
    cells = found[0]
    for more in found[1:]:
        cells = cells.unionByName(more)
    # labels are groups of the first pass: the links found join them
    merged = materialise(components(_linked_rows(_likely_rows(cells, per_cent), texts, words, per_cent)), "merged")
    forget(texts, shared)
    final = (classes.select("n", "d1", "d2", "rep").join(labels, F.col("rep") == labels["vertex"], "left")
             .select("n", "d1", "d2", F.coalesce("component", "rep").alias("group"))
             .join(merged, F.col("group") == merged["vertex"], "left")
             .select("n", "d1", "d2", F.coalesce("component", "group").alias("component_id")))
    return each.select("doc_id", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("n") == 0) | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever these are called: of each
    group of near duplicates the rows of its least doc_id, of rows that repeat a doc_id with equal
    shingles one (the least by checksum of the text). Rows of one doc_id with unlike texts are
    judged each by its own; rows without shingles, with a NULL text or without doc_id all stay, but
    for rows equal in doc_id and text. An empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    kept, body, place = free("llm_kept_id"), free("llm_body"), free("llm_place")
    judged = near_duplicates(docs.where("doc_id is not null"), **options).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    # the same shingles under one id: the words of the text, lower-cased and single-spaced
    words = F.translate(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = Window.partitionBy("doc_id", body).orderBy(F.xxhash64("text"))
    named = (docs.where("doc_id is not null").join(judged, F.col("doc_id") == F.col(kept), "left_semi")
             .withColumn(body, F.sha2(words, 256)).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(body, place))
    return named.unionByName(docs.where("doc_id is null"))
