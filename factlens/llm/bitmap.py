"""A fixed-size bitmap of keys, built in Spark and broadcast: a pre-filter with false positives only.

Its size is ``1 << bits`` bits whatever the input, so broadcasting it is bounded
(8 MB by default).  With very many keys it fills up and lets everything pass,
which costs speed and never results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BITS = 26
_CHUNK = 20


def build(keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Of a column of longs.  Positions are made distinct in Spark; one task packs at most 2**20 of them."""
    spark = keys.sparkSession

    def positions(batches):
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"pos": np.unique(_positions(k, bits)).astype(np.int64)})

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(1 << min(_CHUNK, bits), bool)
        out[table.column("pos").to_numpy() & ((1 << _CHUNK) - 1)] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(out).tobytes()], pa.binary())})

    pos = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(positions, "pos long").distinct()
    rows = pos.withColumn("chunk", F.shiftright("pos", _CHUNK)).groupBy("chunk").applyInArrow(packed, "chunk long, data binary").collect()
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        at = r.chunk << (_CHUNK - 3)
        part = np.frombuffer(r.data, np.uint8)
        whole[at : at + len(part)] = part
    return spark.sparkContext.broadcast(whole)


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys) >> np.uint64(64 - bits)


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in it."""
    pos = _positions(keys, int(len(bitmap) * 8).bit_length() - 1)
    return (bitmap[(pos >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (pos & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
