"""Removal of repeated byte strings through a sparse suffix array, sorted deep-shallow.

A ``length``-byte string is removed where the same string starts earlier. Suffixes are kept
only at the strings' anchors (see ``winnow``): equal strings have equal anchors at equal
places, so every repeat shows up between suffixes at equal anchors and nothing is lost.

1. Runs of strings that own one anchor occurrence are dealt by the anchor's hash. Within a task
   runs of equal digest hold equal strings: all but the earliest are repeats. Only runs whose
   anchor also occurs with other surroundings need their bytes.
2. Those runs' bytes are sorted twice, from the anchor to the right and from the anchor to the
   left: multikey quicksort on 8-byte symbols to a shallow depth, then a blind trie for every
   group that still shares its prefix. The orders and their common-prefix lengths give classes
   of equal strings for every place of the anchor in the string.
3. An anchor with over ``GROUP_BLOCKS`` different surroundings (a line that stands in a third
   of all documents) isn't gathered: its runs are ordered by the more varied of their two sides
   and cut into ranges of ``GROUP_BLOCKS``, each sorted the same way in a task. A string that
   another range may hold shares that side with the range's first or last run; the earliest of
   such strings, of which a range has few, are compared across ranges.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, slices, utf8
from .winnow import GRAM, rolling, runs

LENGTH = 100
GROUP_BLOCKS = 2000
SHALLOW_WORDS = 2  # 8-byte symbols behind the anchor that multikey quicksort looks at
BATCH_BLOCKS = 20000

RUNS_DDL = "anchor long, digest long, doc_id long, place long, known boolean"
RUNS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()),
                  ("known", pa.bool_())])
# a place packs 16 bits of the text's checksum, 40 bits of start and 7 bits of count
_COUNT_BITS, _START_BITS = 7, 40


def _pack(tag, start, count):
    return (tag << (_START_BITS + _COUNT_BITS)) | (start << _COUNT_BITS) | count


def _unpack(place):
    return (place >> (_START_BITS + _COUNT_BITS), (place >> _COUNT_BITS) & ((1 << _START_BITS) - 1),
            place & ((1 << _COUNT_BITS) - 1))


def _tags(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    import zlib

    data = memoryview(raw)
    return np.array([zlib.crc32(data[a:b]) & 0x7FFF for a, b in zip(off[:-1], off[1:], strict=True)], np.int64)


def _earliest(anchor, digest, doc, place):
    """Mask of rows that hold the least (doc, place) of their (anchor, digest)."""
    order = np.lexsort((place, doc, digest, anchor))
    a, d = anchor[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.zeros(len(order), bool)
    first[order] = (doc[order] == doc[lead]) & (place[order] == place[lead])
    return first


def document_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all documents; repeats within one slice of input are already known as such and
    are dealt by their own place, so that a passage in very many documents isn't one hot key."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column(1))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                tags = _tags(raw, off)
                found = list(runs(raw, off, length))
                if not found:
                    continue
                start, count, anchor, digest = (np.concatenate(x) for x in zip(*found, strict=True))
                row = np.searchsorted(off[1:], start, side="right")
                doc, place = ids[row].astype(np.int64), _pack(tags[row], start - off[row], count)
                anchor, digest = anchor.view(np.int64), digest.view(np.int64)
                known = ~_earliest(anchor, digest, doc, place)
                anchor = np.where(known, doc * 1000003 + place, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, digest, doc, place, known)], schema=RUNS)

    return docs.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= %d" % length
                                               ).mapInArrow(run, RUNS_DDL)


def repeated_runs(found: DataFrame) -> DataFrame:
    """Rows (doc_id, place, anchor): anchor is NULL where all the run's strings are repeats, and
    set where the run is the earliest of its kind but its anchor occurs in other surroundings.

    The task's rows come sorted and stream; one row waits at most.
    """

    def run(batches):
        waiting = None  # the first run of the anchor read last, as long as one kind is known
        last = (None, None, None, None)  # anchor, digest, and the earliest doc and place of them
        for batch in batches:
            anchor, digest, doc, place = (batch.column(i).to_numpy() for i in range(4))
            known = batch.column(4).to_numpy(zero_copy_only=False)
            n = len(anchor)
            if not n:
                continue
            newa = np.ones(n, bool)
            newa[1:] = anchor[1:] != anchor[:-1]
            newa[0] = anchor[0] != last[0]
            newd = newa.copy()
            newd[1:] |= digest[1:] != digest[:-1]
            newd[0] = newd[0] or digest[0] != last[1]
            lead = np.maximum.accumulate(np.where(newd, np.arange(n), -1))
            ldoc = np.where(lead >= 0, doc[lead], last[2] if last[2] is not None else 0)
            lplace = np.where(lead >= 0, place[lead], last[3] if last[3] is not None else 0)
            repeat = known | ((doc != ldoc) | (place != lplace))
            group = np.cumsum(newa)  # 0: the anchor that was read last
            kinds = np.bincount(group, weights=newd & ~known, minlength=group[-1] + 1)
            out_doc, out_place, out_anchor = [doc[repeat]], [place[repeat]], [np.full(int(repeat.sum()), -1)]
            none = [np.ones(int(repeat.sum()), bool)]
            tail_kinds = kinds[0] + (1 if waiting is not None else 0) if group[-1] == 0 else kinds[-1]
            multi = kinds >= 2
            if group[0] == 0 and last[0] is not None:
                multi[0] = kinds[0] >= 1  # a further kind of an anchor that had one before
                if kinds[0] and waiting is not None:
                    out_doc.append(np.array([waiting[0]])), out_place.append(np.array([waiting[1]]))
                    out_anchor.append(np.array([last[0]])), none.append(np.zeros(1, bool))
                    waiting = None
            if group[-1] > 0:
                waiting = None
            rep = newd & ~known & multi[group]
            out_doc.append(doc[rep]), out_place.append(place[rep]), out_anchor.append(anchor[rep])
            none.append(np.zeros(int(rep.sum()), bool))
            tail = np.flatnonzero((group == group[-1]) & newd & ~known)
            if group[-1] > 0 and tail_kinds == 1 and len(tail):
                waiting = (doc[tail[0]], place[tail[0]])
            last = (anchor[-1], digest[-1], ldoc[-1], lplace[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_place)),
                 pa.array(np.concatenate(out_anchor), mask=np.concatenate(none))], ["doc_id", "place", "anchor"])

    return (found.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc_id", "place")
            .mapInArrow(run, "doc_id long, place long, anchor long"))


# ---- deep-shallow sorting -------------------------------------------------------------------


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """(order, lcp) of byte strings that agree below ``depth``; lcp[i] is the common prefix of
    the i-th and the one before it (the full length for equal strings, lcp[0] is 0).

    Inner nodes keep only a position and the branching bytes; an insertion walks them blindly to
    a leaf, compares once with its string, and branches where the two part.
    """
    root = [0]  # a leaf is a list of equal strings' numbers; an inner node is (position, branches)
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is tuple:
            branches = node[1]
            node = branches.get(s[node[0]]) or next(iter(branches.values()))
        other = strings[node[0]]
        if s == other:
            node.append(i)
            continue
        at = depth
        step = 64
        while step:  # first byte that differs, by slices
            if s[at:at + step] == other[at:at + step]:
                at += step
            else:
                step //= 2
        above, key, node = None, None, root
        while type(node) is tuple and node[0] < at:
            above, key = node, s[node[0]]
            if key not in node[1]:
                node = None
                break
            node = node[1][key]
        if node is None:
            above[1][key] = [i]
        elif type(node) is tuple and node[0] == at:
            node[1][s[at]] = [i]
        else:
            made = (at, {other[at]: node, s[at]: [i]})
            if above is None:
                root = made
            else:
                above[1][key] = made
    order: list[int] = []
    lcp: list[int] = []
    stack: list = [(root, 0)]
    size = len(strings[0])
    while stack:
        node, common = stack.pop()
        if type(node) is tuple:
            keys = sorted(node[1])
            stack.extend((node[1][k], node[0]) for k in reversed(keys[1:]))
            stack.append((node[1][keys[0]], common))
        else:
            order += node
            lcp += [common] + [size] * (len(node) - 1)
    return order, lcp


def deep_shallow(rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp in bytes) of equally long byte rows, a (n, 8 * words) uint8 array.

    Multikey quicksort looks at 8-byte symbols down to ``shallow`` symbols; only groups that are
    still equal go on, and at that depth each goes to a blind trie.
    """
    n, width = rows.shape
    words = rows.reshape(n, width // 8, 8).view(">u8")[:, :, 0].astype(np.uint64)
    order = np.arange(n)
    lcp = np.zeros(n, np.int64)
    open_, group = np.arange(n), np.zeros(n, np.int64)  # places still to sort, and their groups
    for w in range(min(shallow, words.shape[1])):
        if not len(open_):
            break
        value = words[order[open_], w]
        by = np.lexsort((value, group))
        order[open_] = order[open_][by]
        value, group = value[by], group[by]
        same = np.zeros(len(open_), bool)
        same[1:] = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
        split = np.zeros(len(open_), bool)
        split[1:] = (group[1:] == group[:-1]) & ~same[1:]
        at = np.flatnonzero(split)
        differ = value[at] ^ value[at - 1]
        lcp[open_[at]] = 8 * w + (63 - np.floor(np.log2(differ.astype(np.float64) + 0.5)).astype(np.int64).clip(0, 63)) // 8
        fresh = np.cumsum(~same)
        many = same.copy()
        many[:-1] |= same[1:]
        open_, group = open_[many], fresh[many]
    depth = 8 * min(shallow, words.shape[1])
    if len(open_):
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(group)), strict=True):
            spots = open_[a:b]
            members = order[spots]
            o, common = blind_trie([rows[i].tobytes() for i in members], depth)
            order[spots] = members[o]
            lcp[spots[1:]] = common[1:]
    return order, lcp


def repeats_in_blocks(blocks: list[bytes], anchor_at: np.ndarray, count: np.ndarray, doc: np.ndarray,
                      place: np.ndarray, length: int) -> np.ndarray:
    """(blocks, count) mask of string starts with an equal string at an earlier (doc, place).

    Block i holds the strings block[j:j+length), j < count[i], which all own the anchor at
    anchor_at[i]. Strings are equal where the bytes right of the anchor agree to one depth and
    the bytes left of it to another: both are read off the sorted orders.
    """
    n, reach = len(blocks), length - GRAM
    right, left = np.zeros((n, -(-length // 8) * 8), np.uint8), np.zeros((n, -(-max(reach, 1) // 8) * 8), np.uint8)
    for i, (b, a) in enumerate(zip(blocks, anchor_at.tolist(), strict=True)):
        r = np.frombuffer(b, np.uint8)
        x = r[a:a + length]
        right[i, :len(x)] = x
        x = r[:a][::-1]
        left[i, :len(x)] = x
    classes = []
    for rows, shallow in ((right, GRAM // 8 + SHALLOW_WORDS), (left, SHALLOW_WORDS)):
        order, lcp = deep_shallow(rows, shallow)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        classes.append((rank, lcp))
    out = np.zeros((n, int(count.max())), bool)
    age = np.empty(n, np.int64)  # equal for rows that are the same place of the same document
    by = np.lexsort((place, doc))
    step = np.ones(n, bool)
    step[1:] = (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])
    age[by] = np.cumsum(step)
    for before in range(reach + 1):  # bytes of the string left of its anchor
        j = anchor_at - before
        own = np.flatnonzero((j >= 0) & (j < count))
        if len(own) < 2:
            continue
        cls = [np.cumsum(lcp < d)[rank[own]] for (rank, lcp), d in zip(classes, (length - before, before), strict=True)]
        key = cls[0] * np.int64(n + 2) + cls[1]
        o = np.lexsort((age[own], key))
        k = key[o]
        lead = np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), np.arange(len(o)), 0))
        late = age[own][o] > age[own][o[lead]]
        rows = own[o[late]]
        out[rows, j[rows]] = True
    return out


# ---- assembly ---------------------------------------------------------------------------------


def _by_document(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Documents beside the list of their places; a list is bounded by its document."""
    lists = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list("extra").alias("extras"))
    return docs.select("doc_id", "text").join(lists, "doc_id", how)


def _blocks(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Bytes of each run: (anchor, doc_id, place, anchor_at, block)."""
    ddl = "anchor long, doc_id long, place long, block binary"

    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            rows = []
            for doc, text, places, anchors in zip(*cols, strict=True):
                raw = text.encode()
                tag = int(_tags(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
                for place, anchor in zip(places, anchors, strict=True):
                    t, start, count = _unpack(place)
                    if t == tag:
                        rows.append((anchor, doc, place, raw[start:start + count + length - 1]))
            out = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                             ["anchor", "doc_id", "place", "block"])

    source = _by_document(docs, reps.withColumnRenamed("anchor", "extra"), "inner")
    return source.select("doc_id", "text", "places", "extras").mapInArrow(run, ddl)


def _anchor_places(blocks: list[bytes], anchors: np.ndarray) -> np.ndarray:
    """Where in each block its anchor stands: the first gram whose hash is the anchor's."""
    size = np.array([len(b) for b in blocks], np.int64)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    gram = mix64(rolling(raw, GRAM)).view(np.int64)
    hit = np.flatnonzero(gram == np.repeat(anchors, size)[:len(gram)])
    return hit[np.searchsorted(hit, begin)] - begin


def _repeats_of_groups(blocks: DataFrame, length: int) -> DataFrame:
    """Removed places of runs whose anchor has few kinds, by sorted groups of whole anchors."""
    ddl = "doc_id long, place long"

    def solve(rows):
        anchor, doc, place, block = rows
        _, _, count = _unpack(place)
        at = _anchor_places(block, anchor)
        mask = repeats_in_blocks(block, at, count, doc, place, length)
        return _mask_places(mask, doc, place)

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(),
                    batch.column(3).to_pylist()]
            if not len(rows[0]):
                continue
            held = rows if held is None else [*(np.concatenate([a, b]) for a, b in zip(held[:3], rows[:3], strict=True)),
                                              held[3] + rows[3]]
            if len(held[0]) >= BATCH_BLOCKS:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
                if cut:
                    yield solve([held[0][:cut], held[1][:cut], held[2][:cut], held[3][:cut]])
                    held = [held[0][cut:], held[1][cut:], held[2][cut:], held[3][cut:]]
        if held is not None:
            yield solve(held)

    return blocks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, ddl)


def _mask_places(mask: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of marked starts as packed places."""
    tag, start, _ = _unpack(place)
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    r0, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[r0]), pa.array(_pack(tag[r0], start[r0] + a, b - a))],
                                      ["doc_id", "place"])


def _common(rows: list[bytes], one: bytes, width: int) -> np.ndarray:
    """Bytes that each row has in common with ``one`` at its front, ``width`` at most."""
    table = np.zeros((len(rows) + 1, width), np.uint8)
    for i, r in enumerate([*rows, one]):
        table[i, :len(r)] = np.frombuffer(r, np.uint8)
    return np.cumprod(table[:-1] == table[-1], axis=1, dtype=np.int64).sum(axis=1)


def _range_repeats(rows, by_left: bool, length: int) -> pa.RecordBatch:
    """One range of a hot anchor's runs, in the order of one side: its repeats, and (with their
    digest) the earliest of those strings that other ranges may hold too."""
    anchor, doc, place, block, at, key = rows
    tag, start, count = _unpack(place)
    mask = repeats_in_blocks(block, at, count, doc, place, length)
    told = _mask_places(mask, doc, place)
    shared = np.maximum(_common(key, key[0], length), _common(key, key[-1], length))
    out_string, out_doc, out_place = [], [], []
    for i, b in enumerate(block):
        # string j has anchor_at - j bytes left of the anchor, and length less those right of it
        before = at[i] - np.arange(count[i])
        fits = (before if by_left else length - before) <= shared[i]
        for j in np.flatnonzero(fits & ~mask[i, :count[i]]).tolist():
            out_string.append(hashlib.blake2b(b[j:j + length], digest_size=16).digest())
            out_doc.append(int(doc[i]))
            out_place.append(int(_pack(tag[i], start[i] + j, 1)))
    return pa.RecordBatch.from_arrays(
        [pa.array([None] * told.num_rows + out_string, pa.binary()), pa.array(told.column(0).to_pylist() + out_doc, pa.int64()),
         pa.array(told.column(1).to_pylist() + out_place, pa.int64())], ["string", "doc_id", "place"])


def _repeats_of_hot(blocks: DataFrame, rows: int, length: int, group_blocks: int) -> DataFrame:
    """Removed places of runs whose anchor has very many kinds; ``rows`` runs in all."""

    def sided(batches):
        for batch in batches:
            anchor, block = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            at = _anchor_places(block, anchor) if len(block) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(at, pa.int64()),
                 pa.array([b[:a][::-1] for b, a in zip(block, at.tolist(), strict=True)], pa.binary()),
                 pa.array([b[a:a + length] for b, a in zip(block, at.tolist(), strict=True)], pa.binary())],
                ["anchor", "doc_id", "place", "block", "at", "left", "right"])

    ddl = "anchor long, doc_id long, place long, block binary, at long, left binary, right binary"
    sides = materialise(blocks.mapInArrow(sided, ddl), "sides")
    half = length // 3  # bytes by which a side's variety is judged
    kinds = sides.groupBy("anchor").agg((F.approx_count_distinct(F.xxhash64(F.substring("left", 1, half)))
                                         >= F.approx_count_distinct(F.xxhash64(F.substring("right", 1, half)))).alias("by_left"))
    keyed = sides.join(kinds, "anchor").select(
        "anchor", "by_left", F.when(F.col("by_left"), F.col("left")).otherwise(F.col("right")).alias("key"),
        F.when(F.col("by_left"), F.col("right")).otherwise(F.col("left")).alias("rest"), "doc_id", "place", "block", "at")

    def run(batches):
        held = None

        def solve():
            by_left = held[6][0]
            return _range_repeats((*(np.array(held[i]) for i in (0, 1, 2)), held[3], np.array(held[4]), held[5]), by_left, length)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*cols, strict=True):
                if held is not None and (held[0][-1] != row[0] or len(held[0]) >= group_blocks):
                    yield solve()
                    held = None
                held = held or [[] for _ in range(7)]
                for h, v in zip(held, row, strict=True):
                    h.append(v)
        if held is not None:
            yield solve()

    order = ["anchor", "key", "rest"]
    ranged = (keyed.repartitionByRange(max(1, -(-rows // group_blocks)), *order).sortWithinPartitions(*order)
              .select("anchor", "doc_id", "place", "block", "at", "key", "by_left"))
    found = materialise(ranged.mapInArrow(run, "string binary, doc_id long, place long"), "ranges")
    each = found.where("string is not null")
    first = each.groupBy("string").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    later = each.join(first, "string").where("doc_id != first.doc_id or place != first.place")
    return found.where("string is null").select("doc_id", "place").unionByName(later.select("doc_id", "place"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A byte goes if a ``length``-byte string that covers it also starts earlier (smaller doc_id, or
    earlier in the same document); strings are judged on the input. NULL and empty texts have no
    bytes; texts shorter than ``length`` stay whole. Rows that repeat a doc_id and text are one
    document (each loses the same bytes); rows of one doc_id with other texts are ordered by
    the texts' checksums. Rows with NULL doc_id take no part and stay whole. An empty table
    gives an empty result. Other columns are ignored.
    """
    found = materialise(repeated_runs(document_runs(docs, length)), "runs")
    removed = found.where("anchor is null").select("doc_id", "place")
    reps = found.where("anchor is not null")
    kinds = reps.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    blocks = materialise(_blocks(docs, reps, length).join(kinds, "anchor"), "blocks")
    few = _repeats_of_groups(blocks.where(F.col("kinds") <= group_blocks).drop("kinds"), length)
    places = removed.unionByName(few)
    hot = kinds.where(F.col("kinds") > group_blocks).agg(F.sum("kinds")).first()[0]
    if hot:
        places = places.unionByName(_repeats_of_hot(blocks.where(F.col("kinds") > group_blocks).drop("kinds"), hot, length, group_blocks))
    places = places.withColumn("extra", F.lit(None).cast("long"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                if marks:
                    tag, start, count = _unpack(np.array(marks, np.int64))
                    own = tag == _tags(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
                    np.add.at(gone, start[own], 1)
                    np.add.at(gone, start[own] + count[own] + length - 1, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = raw if not gone.any() else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            out = list(zip(*rows, strict=True)) or [[]] * 6
            kinds_ = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_, strict=True)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _by_document(docs, places, "left").select("doc_id", "text", "places").mapInArrow(cut, ddl)
