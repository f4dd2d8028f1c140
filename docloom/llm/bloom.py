"""A Bloom filter of fixed size over a hashed column: a semi-join reducer.

It is an upper bound only: what passes is judged exactly by a later join, so a
full filter costs work and never a result. Its size doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import parts
from .words import U, mix

CHUNKS = 64


def _bits(x: np.ndarray, log2: int) -> list[np.ndarray]:
    return [mix(x.view(U) ^ U(c)) >> U(64 - log2) for c in (0x51ED27, 0x2F0B4C)]


FAN = 64  # arrays that one task combines on the way up, about


def add_up(df: DataFrame, numpy_type: str, op, wide: str | None = None, last=None) -> dict[int, bytes]:
    """(chunk, data) rows, chunk by chunk combined by ``op``, as arrays of type ``wide`` (by default as they are).

    ``last`` is applied to each chunk's total in its task, so the driver gets what it makes of it.

    They go up a tree: the tasks that made them are in groups, each group's arrays of a chunk meet in one
    task, then the groups' do, so no task reads more than about ``FAN`` arrays of a chunk however many there are.
    """
    wide = wide or numpy_type

    def combine(kind: str, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, g, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    a = np.frombuffer(d, kind)
                    held[k, g] = op(held[k, g], a) if (k, g) in held else a.astype(wide)
            for (k, g), a in held.items():
                a = a if last is None else last(a)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["chunk", "group", "data"])

        return run

    n = parts(df.sparkSession)
    # As many levels as the cluster's own number of partitions asks for, as that of the tasks isn't known yet.
    groups = [g for g in (n, n // FAN, n // FAN**2) if g > FAN] + [1]
    rows, kind = df.select("chunk", F.spark_partition_id().alias("group"), "data"), numpy_type
    for g in groups:
        rows = rows.withColumn("group", F.pmod("group", F.lit(g))).repartition(min(n, CHUNKS * g), "chunk", "group")
        rows, kind = rows.mapInArrow(combine(kind, last if g == 1 else None), "chunk int, group int, data binary"), wide
    return {r.chunk: r.data for r in rows.collect()}


def build(df: DataFrame, column: str, log2: int = 26) -> np.ndarray:
    """The filter over a column of longs, as a bit array of 2**log2 bits; at most that size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        some = False
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for b in _bits(x, log2):
                some = True
                np.bitwise_or.at(bits, (b >> U(3)).astype(np.int64), np.uint8(1) << (b & U(7)).astype(np.uint8))
        if some:
            size = len(bits) // CHUNKS
            for k in range(CHUNKS):
                if (part := bits[k * size : (k + 1) * size]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])

    got = add_up(df.select(column).mapInArrow(run, "chunk int, data binary"), "uint8", np.bitwise_or)
    size = (1 << (log2 - 3)) // CHUNKS
    return np.frombuffer(b"".join(got.get(k, bytes(size)) for k in range(CHUNKS)), np.uint8)


def passes(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    log2 = int(len(bits)).bit_length() + 2
    ok = np.ones(len(x), bool)
    for b in _bits(x, log2):
        ok &= (bits[(b >> U(3)).astype(np.int64)] >> (b & U(7)).astype(np.uint8)) & 1 == 1
    return ok
