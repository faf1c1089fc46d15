"""N-gram Jaccard self-join by token-combination prefixes.

Documents are sets of k-word shingles ("tokens"), ordered by how many distinct sets hold a token,
rarest first. Two sets x, y with J >= p share their first common token within the first
n - ceil(p n) + 1 tokens of either. If that token is rare, the single token is the signature. If
it is frequent, all later common tokens are frequent too, and a combination of two is indexed
instead: at most D = n (1 - p) / p tokens stand in one of the sets only, each can part one pair of
neighbouring common tokens, so of the first D + 2 common tokens two are neighbours in both orders.
Those lie in the prefix extended by D + 1, whose neighbouring frequent tokens are the k = 2
combinations; there are as many as prefix tokens, where all pairs would be their square.

Frequencies are exact. Tasks cut their documents' tokens by hash range into packed rows, so that a
token costs about eight bytes on the way; a range counts its tokens and returns, per set, those
that another set holds. Tokens in so many sets that a range could not hold them are found by
summing what slices of the corpus see repeatedly; there are at most 2^18, and they bypass the
ranges with their counts. Only sets whose shared tokens make up p of them can have a link.

Candidates are verified exactly on the shared tokens. As only groups are asked for, every set is first
compared with two sets of each of its buckets, one of them the bucket's most central (its tokens
stand in most other sets: the template of a group of near copies), then, in buckets of several
groups, with the ``HEADS`` most central ones; then all pairs of a bucket that are not in one group
yet are compared, in blocks, buckets of equal content once. Blocks hold a parity sketch of each set:
bits that differ are at most the tokens that differ, so they bound the overlap from above, and only
pairs whose bound allows a link leave the block.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise, mix64, shingle_sets, slices, utf8
from .components import components

WORDS = 5
SIMILARITY = 80       # per cent, compared exactly in integers
RARE = 16             # a token of up to so many sets is indexed alone
RANGE_TOKENS = 1 << 20  # tokens that one range task sorts, on average
HOT_SHARE = 1 << 18   # a token above this part of all tokens is handled without a range
CELL = 512            # sets on one side of a block of a large bucket
SKETCH_BITS = 1 << 10  # of a set's parity sketch; a power of two
HEADS = 8             # central sets of a bucket that all others are compared with

_ONE, _TWO = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _key(s: np.ndarray) -> int:
    """64-bit class of a set: equal sets, equal classes (0 is the empty set's)."""
    if not len(s):
        return 0
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) ^ (s * _TWO).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: each document's (doc_id, n, cls), and (token, seen) of tokens that a slice
    of the corpus holds in two sets or more."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*utf8(part.column(1)), words)
                key = [_key(s) for s in sets]
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.int64()),
                     pa.nulls(m, pa.int64())], ["doc_id", "n", "cls", "token"])
                every = np.sort(np.concatenate([sets[i] for i in dict(zip(key, range(m), strict=True)).values()]))
                first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
                seen = np.diff(np.append(first, len(every)))
                often = seen > max(1, len(every) // HOT_SHARE)
                token, seen = every[first[often]].view(np.int64), seen[often]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(token), pa.int64()), pa.array(seen, pa.int64()), pa.nulls(len(token), pa.int64()), pa.array(token)],
                    ["doc_id", "n", "cls", "token"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, token long")


def _packed(docs: DataFrame, words: int, bits: int, hot: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(part, cls, n, count, token, often): for each hash range the sets' tokens in it, packed; and,
    in parts beyond the ranges, the hot tokens of each set with their counts (``often``)."""
    ranges = 1 << bits

    def run(batches):
        met: set[int] = set()  # classes of this task, a number a row: copies are sent once
        for batch in batches:
            for part in slices(batch):
                sets, key = [], []
                for s in shingle_sets(*utf8(part.column(0)), words):
                    k = _key(s)
                    if len(s) and k not in met:
                        met.add(k)
                        sets.append(s)
                        key.append(k)
                if not sets:
                    continue
                size = np.array([len(s) for s in sets])
                token, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                at = np.searchsorted(hot, token)
                known = hot[np.minimum(at, len(hot) - 1)] == token if len(hot) else np.zeros(len(token), bool)
                place = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
                place[known] = ranges + (np.array(key)[who[known]] & (ranges - 1))  # a class's in one part, whichever task
                order = np.lexsort((who, place))  # stable: a set's tokens stay sorted
                token, who, place, at, known = token[order], who[order], place[order], at[order], known[order]
                cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                rows = []
                for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
                    w, count = np.unique(who[lo:hi], return_counts=True)
                    often = seen[at[lo:hi]].astype(np.int64).tobytes() if known[lo] else None
                    rows.append((int(place[lo]), np.array(key)[w].tobytes(), size[w].astype(np.int64).tobytes(),
                                 count.astype(np.int64).tobytes(), token[lo:hi].tobytes(), often))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                                                 ["part", "cls", "n", "count", "token", "often"])

    return docs.select("text").mapInArrow(run, "part long, cls binary, n binary, count binary, token binary, often binary")


def _numbers(column, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of equal values."""
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return cut, np.append(cut[1:], len(x)) if len(x) else cut


def _shared(key, table, bits: int):
    """One range: its tokens that two sets or more hold, packed by 2^bits parts of the classes:
    (dealt, cls, n, count, token, often)."""
    cls, n, count = (_numbers(table.column(c)) for c in ("cls", "n", "count"))
    token = _numbers(table.column("token"), np.uint64)
    own, size = np.repeat(cls, count), np.repeat(n, count)
    plain = table.column("often").null_count > 0
    often = np.zeros(len(token), np.int64) if plain else _numbers(table.column("often"))
    order = np.lexsort((own, token))
    token, own, size, often = token[order], own[order], size[order], often[order]
    once = np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])) if len(token) else np.zeros(0, bool)
    token, own, size, often = token[once], own[once], size[once], often[once]  # without copies of other tasks
    if plain:
        first, end = _groups(token)
        often = np.repeat(end - first, end - first)
    keep = often > 1
    token, own, size, often = token[keep], own[keep], size[keep], often[keep]
    dealt = own & np.int64((1 << bits) - 1)
    order = np.lexsort((token, own, dealt))
    token, own, size, often, dealt = token[order], own[order], size[order], often[order], dealt[order]
    first, end = _groups(own)
    part, last = _groups(dealt[first])
    at = np.append(first, len(own))
    return pa.table({
        "dealt": pa.array(dealt[first][part], pa.int64()),
        "cls": pa.array([own[first[a:b]].tobytes() for a, b in zip(part, last, strict=True)], pa.binary()),
        "n": pa.array([size[first[a:b]].tobytes() for a, b in zip(part, last, strict=True)], pa.binary()),
        "count": pa.array([(end - first)[a:b].tobytes() for a, b in zip(part, last, strict=True)], pa.binary()),
        "token": pa.array([token[at[a]:at[b]].tobytes() for a, b in zip(part, last, strict=True)], pa.binary()),
        "often": pa.array([often[at[a]:at[b]].astype(np.int32).tobytes() for a, b in zip(part, last, strict=True)], pa.binary())})


def signatures(n: int, token: np.ndarray, often: np.ndarray, per_cent: int = SIMILARITY, rare: int = RARE) -> np.ndarray:
    """Distinct signatures of a set of ``n`` tokens whose shared ones are given in order.

    Tokens of no other set come first in the order and have no signature.
    """
    least = -(-per_cent * n // 100)
    prefix = max(0, len(token) - least + 1)
    single = token[:prefix][often[:prefix] <= rare]
    longer = max(0, len(token) - least + n * (100 - per_cent) // per_cent + 2)
    tail = token[:longer][often[:longer] > rare]
    two = mix64(tail[:-1] ^ _TWO) + tail[1:]
    return np.unique(np.concatenate([mix64(single ^ _ONE), mix64(two)])) if prefix else np.zeros(0, np.uint64)


def sketch(token: np.ndarray) -> bytes:
    """Parity of the number of tokens that fall to each bit."""
    odd = np.bincount((token & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _sets(key, table, per_cent: int, rare: int):
    """One part of the classes: (cls, n, k, core, token, sketch, sigs) of the sets whose shared tokens allow a
    link; ``core`` is how often their tokens stand in other sets, on average."""
    cls, n, count = (_numbers(table.column(c)) for c in ("cls", "n", "count"))
    token, often = _numbers(table.column("token"), np.uint64), _numbers(table.column("often"), np.int32).astype(np.int64)
    own, size = np.repeat(cls, count), np.repeat(n, count)
    order = np.lexsort((token, often, own))
    token, often, own, size = token[order], often[order], own[order], size[order]
    out = []
    for a, b in zip(*_groups(own), strict=True):
        if (b - a) * 100 >= size[a] * per_cent:
            out.append((own[a], size[a], b - a, float(often[a:b].sum() / size[a]), np.sort(token[a:b]).tobytes(), sketch(token[a:b]),
                        signatures(int(size[a]), token[a:b], often[a:b], per_cent, rare).view(np.int64).tolist()))
    cols = list(zip(*out, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["cls", "n", "k", "core", "token", "sketch", "sigs"])


def _admissible(n_a, k_a, n_b, k_b, per_cent: int):  # numbers, arrays or Columns
    """Whether sizes and numbers of shared tokens allow a link: 100 o >= p (n + m - o) for an
    overlap o of at most either set's shared tokens."""
    least = (100 + per_cent)
    fits = lambda k: k * least >= (n_a + n_b) * per_cent
    return fits(k_a) & fits(k_b)


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of classes that are linked, by their whole overlap."""
    a, b = (sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("token").alias(f"t_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(100 * both >= per_cent * (n + m - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(run, "u long, v long")


def _cells(buckets: DataFrame, sets: DataFrame, per_cent: int, cell: int) -> DataFrame:
    """Pairs (a, b) of sets of different labels in one bucket whose sizes and sketches allow a link, once;
    large buckets in blocks, every pair of blocks once. Only numbers and sketches travel."""
    sized = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    cut = buckets.join(sized, "sig").withColumn("parts", F.ceil(F.col("size") / cell)).withColumn(
        "part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = met.select("sig", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cls", "n", "k", "label").join(sets.select("cls", "sketch"), "cls").select(
        "sig", "lo", "hi", "part", "cls", "n", "k", "label", "sketch")

    def run(batches):
        held: list[np.ndarray] = []
        drawn: list[np.ndarray] = []

        def solve():
            c, bits = np.concatenate(held, axis=1), np.concatenate(drawn)
            held.clear()
            drawn.clear()
            out = [np.zeros((2, 0), np.int64)]
            for i in range(c.shape[1] - 1):
                x, rest = c[:, i], c[:, i + 1:]
                fit = (rest[7] != x[7]) & _admissible(x[5], x[6], rest[5], rest[6], per_cent)
                if x[1] != x[2]:
                    fit &= rest[3] != x[3]
                fit = np.flatnonzero(fit)
                # twice the overlap is at most the tokens of both less those that differ
                differ = np.bitwise_count(bits[i + 1 + fit] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = (x[6] + rest[6][fit] - differ) // 2
                fit = fit[both * (100 + per_cent) >= (x[5] + rest[5][fit]) * per_cent]
                out.append(np.stack([np.minimum(x[4], rest[4][fit]), np.maximum(x[4], rest[4][fit])]))
            pairs = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([batch.column(i).to_numpy() for i in range(8)])
            d = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            edge = np.flatnonzero(np.append(True, (c[:3, 1:] != c[:3, :-1]).any(axis=0)))
            for lo, hi in zip(edge, np.append(edge[1:], c.shape[1]), strict=True):
                if held and (held[0][:3, 0] != c[:3, lo]).any():
                    yield solve()
                held.append(c[:, lo:hi])
                drawn.append(d[lo:hi])
        if held:
            yield solve()

    return rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, words: int = WORDS, per_cent: int = SIMILARITY, rare: int = RARE,
                   range_tokens: int = RANGE_TOKENS, cell: int = CELL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked where 100 * intersection >= per_cent * union of their sets;
    ``component_id`` is the least doc_id reachable over links, itself included. NULL texts and
    texts without words have no shingles and are linked with nothing. Rows with NULL doc_id take
    no part: their component_id is NULL. Repeated rows come back each; rows of one doc_id with
    different texts are judged each by its own text. An empty table gives an empty result; other
    columns are ignored. Shingles and sets are told apart by 64-bit hashes. The combinations need
    a threshold of 67 per cent or more.
    """
    if not 67 <= per_cent <= 100:
        raise ValueError("per_cent must be from 67 to 100")
    sized = materialise(set_sizes(docs, words), "sizes")
    each = sized.where("token is null").select("doc_id", "n", "cls")
    classes = each.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    # sums of at most ``total``, so no more than HOT_SHARE tokens reach the driver
    seen = (sized.where("token is not null").groupBy("token").agg(F.sum("n").alias("seen"))
            .where(F.col("seen") > max(rare, total // HOT_SHARE)).toArrow())
    hot, often = seen.column("token").to_numpy().view(np.uint64), seen.column("seen").to_numpy()
    order = np.argsort(hot)
    bits = max(0, int(np.ceil(np.log2(max(1, total / range_tokens)))))
    packed = _packed(docs.where("doc_id is not null"), words, bits, hot[order], often[order])
    shared = packed.groupBy("part").applyInArrow(lambda key, table: _shared(key, table, bits),
                                                 "dealt long, cls binary, n binary, count binary, token binary, often binary")
    sets = materialise(shared.groupBy("dealt").applyInArrow(lambda key, table: _sets(key, table, per_cent, rare),
                                                            "cls long, n long, k long, core double, token binary, sketch binary, sigs array<long>"), "sets")

    index = sets.select("cls", "n", "k", "core", F.explode("sigs").alias("sig"))
    counts = index.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("content"),
                                      F.max_by("cls", F.struct("core", "cls")).alias("head"), F.min("cls").alias("foot")).where("size > 1")
    # buckets of equal content are one bucket
    alone = counts.groupBy("size", "content", "head", "foot").agg(F.min("sig").alias("sig"))
    buckets = materialise(index.join(alone.select("sig", "head", "foot"), "sig"), "buckets")
    stars = buckets.where("cls != head").select(F.col("head").alias("a"), F.col("cls").alias("b")).unionByName(
        buckets.where("cls != foot").select(F.col("cls").alias("a"), F.col("foot").alias("b"))).distinct()
    labels = materialise(components(_linked(stars, sets, per_cent)), "labels")

    def mixed(labels: DataFrame) -> DataFrame:
        """Rows of the buckets that hold several groups, with their group."""
        named = buckets.join(labels, buckets["cls"] == labels["vertex"], "left").select(
            "sig", "cls", "n", "k", "core", F.coalesce("component", "cls").alias("label"))
        several = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("sig")
        return named.join(several, "sig")

    def with_groups(links: DataFrame, labels: DataFrame) -> DataFrame:
        return links.unionByName(labels.where("vertex != component").select(F.col("vertex").alias("u"), F.col("component").alias("v")))

    # a second pass, for what the first has left apart: sets outside a bucket's largest group with the
    # most central sets of those groups, HEADS for each
    open_ = materialise(mixed(labels), "open")
    largest = open_.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("sig").agg(
        F.max_by("label", F.struct("size", "label")).alias("largest"))
    told = open_.join(largest, "sig")
    central = Window.partitionBy("sig").orderBy(F.col("core").desc(), "cls")
    tops = told.where("label = largest").withColumn("rank", F.row_number().over(central)).where(F.col("rank") <= HEADS).select(
        "sig", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "k", "core")])
    met = told.where("label != largest").join(tops, "sig").where(_admissible(*map(F.col, ("n", "k", "n_b", "k_b")), per_cent))
    best = Window.partitionBy("cls").orderBy(F.col("core_b").desc(), "cls_b")
    pairs = met.select("cls", "cls_b", "core_b").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HEADS).select(
        F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct()
    second = materialise(components(with_groups(_linked(pairs, sets, per_cent), labels)), "second")
    # and every pair that is not in one group yet
    rest = materialise(_linked(_cells(mixed(second), sets, per_cent, cell), sets, per_cent), "rest")
    merged = materialise(components(with_groups(rest, second)), "merged")
    grouped = classes.join(merged, classes["cls"] == merged["vertex"], "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("group"))
    least = materialise(grouped, "groups")
    forget(sets, buckets, labels, open_, second, rest, merged)
    final = least.join(least.groupBy("group").agg(F.min("rep").alias("component_id")), "group").select("cls", "component_id")
    return each.join(final, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
