"""Filling containers of one capacity with items, by rounds of best fit over ever fewer partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut


class BestFit:
    """Open bins by the room left. The fullest bin that still takes an item is found in the bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.bins = capacity, 0, [[] for _ in range(capacity + 1)]

    def put(self, size: int, new: callable):
        """The bin for an item of this size; new() names a bin if none has room."""
        above = self.free >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            name = self.bins[room].pop()
            if not self.bins[room]:
                self.free ^= 1 << room
        else:
            room, name = self.capacity, new()
        room -= size
        if not self.bins[room]:
            self.free |= 1 << room
        self.bins[room].append(name)
        return name


#: Items that a task sorts at once.
SORTED = 1_000_000


def _round(df: DataFrame, capacity: int, level: int) -> DataFrame:
    """(item, piece, size, bin): best fit, largest first, within each partition; every item has a size above 0.

    A bin's number is made of the round, the partition and a running number, so no two bins share one, and the same
    partitions give the same numbers. Of a large partition, SORTED items at a time are sorted; bins stay open.
    """
    schema = T.StructType([*(df.schema[x] for x in ("item", "piece", "size")), T.StructField("bin", T.LongType())])

    def run(batches):
        fit = BestFit(capacity)
        first = level << 49 | TaskContext.get().partitionId() << 28  # below 2**53, so that doubles hold it too
        made = iter(range(first, first + (1 << 28)))

        def packed(held):
            table = pa.Table.from_batches(held).sort_by([("size", "descending"), ("item", "ascending"), ("piece", "ascending")]).combine_chunks()
            bins = [fit.put(n, made.__next__) for n in table.column("size").to_pylist()]
            return table.append_column("bin", pa.array(bins, pa.int64())).to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SORTED:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return df.select("item", "piece", "size").mapInArrow(run, schema)


def pack(df: DataFrame, key: str, size: str, capacity: int, nearly: float = 0.99, fan_in: int = 8, per_task: int = 500_000) -> DataFrame:
    """(key, piece, size, container): every item of a size above 0 in a container whose sizes add up to capacity at most.

    An item larger than capacity is cut into pieces, full ones and a rest; others stay whole. Items of size 0 or null
    have piece 0, size 0 and a null container. Each row is an item, so repeated rows are separate items.

    Each partition packs its own items by best fit, largest first. Containers filled to the share `nearly` are done.
    The others become items of the next round, in fan_in times fewer partitions, to which their numbers send them; the
    last round has one task, or as many as are needed for per_task containers each, so no task grows with the data. What
    such a task leaves open is at most one container that is less than half full, so more than one of them costs less
    than one container in per_task. Only underfull containers move, by number and size.
    """
    own = cut(df.select(F.col(key).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")))
    pieces = own.select("item", F.posexplode(F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("long")), lambda k: F.least(F.lit(capacity), F.col("n") - k * capacity))).otherwise(F.array(F.lit(0).cast("long")))).alias("piece", "size"))
    packed = cut(_round(pieces.filter("size > 0"), capacity, 0))
    level = packed.groupBy("bin").agg(F.sum("size").alias("size"))
    tasks = max(1, packed.rdd.getNumPartitions())
    links = packed.select("item", "piece", "size", "bin")
    round_ = 0
    while True:
        round_ += 1
        open_ = level.filter(F.col("size") < int(capacity * nearly)).select(F.col("bin").alias("item"), F.lit(0).alias("piece"), "size")
        left = open_.count()
        fewer = max(1, tasks // fan_in, -(-left // per_task))
        if left < 2 or fewer >= tasks and tasks > 1:
            break
        moved = cut(_round(open_.repartition(fewer, "item"), capacity, round_))
        links = links.join(moved.select(F.col("item").alias("bin"), F.col("bin").alias("into")), "bin", "left").select("item", "piece", "size", F.coalesce("into", "bin").alias("bin"))
        level = moved.groupBy("bin").agg(F.sum("size").alias("size"))
        if fewer == 1 or fewer >= tasks:
            break
        tasks = fewer
    named = links.select(F.col("item").alias(key), "piece", "size", F.col("bin").alias("container"))
    none = own.filter("n = 0").select(F.col("item").alias(key), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    return named.unionByName(none)
