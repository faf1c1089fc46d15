"""Sharding by Hilbert-curve order (DataFrame functions only).

Several metadata dimensions are quantised to ``bits`` bits each, their Hilbert index orders the
rows, and the ordered rows are cut into shards of equal row count. Neighbours on the curve are
neighbours in every dimension, so each shard covers a small box and readers can prune by it.

The curve is walked from the top bit down with the Gray-code state of each cell (entry corner
and direction), as in Hamilton's description of Hilbert indices for any dimension.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DIMS = 3
BITS = 8


def _gray_tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Per n-bit value: inverse Gray code; per cell number: entry corner and direction."""
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    inverse = [gray.index(g) for g in range(size)]
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]

    def ones(i: int) -> int:
        return ((i + 1) & ~i).bit_length() - 1

    direction = [0] + [(ones(i - 1) if i % 2 == 0 else ones(i)) % n for i in range(1, size)]
    return inverse, entry, direction


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of non-negative integer columns below 2^bits, as a long."""
    n = len(coords)
    mask = (1 << n) - 1
    inverse, entry, direction = (F.array(*[F.lit(v) for v in t]) for t in _gray_tables(n))
    state = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))

    def rotl(x, by):
        return (F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - by))
                ).bitwiseAND(F.lit(mask))

    def step(acc, i):
        corner = F.lit(0)
        for j, c in enumerate(coords):
            bit = F.call_function("shiftright", c.cast("int"), i).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.call_function("shiftleft", bit, F.lit(j)))
        turn = acc["d"] + 1
        moved = corner.bitwiseXOR(acc["e"])
        seen = (F.call_function("shiftright", moved, turn)
                .bitwiseOR(F.call_function("shiftleft", moved, F.lit(n) - turn))).bitwiseAND(F.lit(mask))
        cell = F.get(inverse, seen)
        return F.struct(acc["e"].bitwiseXOR(rotl(F.get(entry, cell), turn)).alias("e"),
                        ((turn + F.get(direction, cell)) % n).alias("d"),
                        F.call_function("shiftleft", acc["h"], F.lit(n)).bitwiseOR(cell.cast("long")).alias("h"))

    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(levels, state, step, lambda acc: acc["h"])


def document_dimensions(bits: int = BITS) -> list[Column]:
    """Quantised source, language and size (half-octaves would waste bits: 8 steps an octave).

    NULLs count as the empty value. Names are dealt to cells by crc32, equal names to equal cells.
    """
    top = (1 << bits) - 1
    size = F.least(F.lit(top), F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int"))
    return [F.crc32(F.coalesce(F.col("source"), F.lit(""))).bitwiseAND(F.lit(top)).cast("int"),
            F.crc32(F.coalesce(F.col("lang"), F.lit(""))).bitwiseAND(F.lit(top)).cast("int"),
            size]


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, lang, source) to a shard.

    Law ``rows``: row counts of shards differ by one at most; the first N mod shards hold one
    more. ``slot`` is the row's place in its shard. A hot cell (say a third of all rows in one
    source) is spread by the id's checksum behind the curve index, so no task holds a whole
    cell. NULL texts are empty texts; NULL ids are dealt like others; repeated rows keep one
    place each; an empty table gives an empty result. Other columns are ignored.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    rows = (docs.select("doc_id", "lang", "source", size.alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"))
            .withColumn("curve", hilbert_index(document_dimensions(bits), bits))
            .withColumn("spread", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)).cast("long"))
            .drop("lang", "source"))
    order = ["curve", "spread", "doc_id", "size", "text_crc32"]
    # the range partitions are written once, so that their numbers stay the same in both uses
    runs = materialise(rows.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "hilbert")
    # one row a range partition: bounded by the number of partitions, not by the rows
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"),
                            F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order)).cast("long") - 1
    wide, base = F.col("total") % shards, F.floor(F.col("total") / shards).cast("long")
    edge = wide * (base + 1)
    low = F.col("rank") < edge
    shard = F.when(low, F.floor(F.col("rank") / (base + 1))).otherwise(
        wide + F.floor((F.col("rank") - edge) / F.greatest(base, F.lit(1))))
    slot = F.when(low, F.col("rank") % (base + 1)).otherwise((F.col("rank") - edge) % F.greatest(base, F.lit(1)))
    return (runs.withColumn("place", place).join(F.broadcast(offsets), "run")
            .withColumn("rank", F.col("before") + F.col("place"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
                    slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    F.col("curve").alias("curve_index")))
