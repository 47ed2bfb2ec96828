"""A table of bits that tells, without a join, which rows can't have a key of a given set."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.spans import U, mix
from millrace.session import broadcast_value

#: Bits for each key of the set, and the most bits of a table, 64 MB; with more keys it tells less and stays right.
PER_KEY, MOST = 16, 1 << 29
_BLOCK = 1 << 16


class Marks:
    """hit(keys): False where a key certainly isn't in the set."""

    def __init__(self, log2: int):
        self.shift, self.bits = U(64 - log2), np.zeros(1 << (log2 - 3), np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        m = self._places(keys)
        np.bitwise_or.at(self.bits, m >> 3, (1 << (m & 7)).astype(np.uint8))

    def hit(self, keys: np.ndarray) -> np.ndarray:
        m = self._places(keys)
        return (self.bits[m >> 3] >> (m & 7)) & 1 == 1


def marks_of(keys: DataFrame):
    """A broadcast table of the marks of a column of 64-bit keys; its size follows their number up to a fixed most.

    Each task sets its keys' bits in blocks; blocks are joined before they reach the driver, which gets the table once.
    """
    name = keys.columns[0]
    n = keys.count()
    log2 = min(int(math.log2(MOST)), max(16, math.ceil(math.log2(max(1, n) * PER_KEY))))

    def set_(batches):
        own = Marks(log2)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(U))
        some = [(k // _BLOCK, own.bits[k : k + _BLOCK].tobytes()) for k in range(0, len(own.bits), _BLOCK) if own.bits[k : k + _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], ["block", "bits"])

    def join(batches):
        all_: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                all_[k] = np.frombuffer(b, np.uint8) | all_.get(k, np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.int32()), pa.array([x.tobytes() for x in all_.values()], pa.binary())], ["block", "bits"])

    rows = keys.select(F.col(name).cast("long")).mapInArrow(set_, "block int, bits binary").repartition("block").mapInArrow(join, "block int, bits binary").toArrow()
    out = Marks(log2)
    for k, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        out.bits[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(b, np.uint8)
    return broadcast_value(keys.sparkSession, out)
