"""What the operators share: bounded samples, checkpoints, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir, written  # noqa: F401
from .textkernel import mix


def lean(run):
    """A batch function that gives free memory back to the system when its task ends: workers live on between tasks."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Limits the Arrow batches that workers get by bytes too, unless the session has a limit of its own.

    Rows of text differ in length by orders of magnitude; ten thousand long ones would not fit a worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).rstrip("b")) >= 256 << 20:
        spark.conf.set(name, str(size))


def rehashed(col: Column, seed: int) -> Column:
    """A pseudo-random order of a key that doesn't depend on how rows are laid out."""
    return F.xxhash64(col, F.lit(seed))


def bounded_sample(keys: DataFrame, by: str, key: str, per: int, seed: int = 11) -> DataFrame:
    """At most ``per`` rows of each value of ``by``, the same ones however rows are laid out."""
    w = Window.partitionBy(by).orderBy(rehashed(F.col(key), seed), F.col(key))
    return keys.where(F.col(by).isNotNull() & F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).drop("_rn")


def key_filter(keys: DataFrame, bits: int = 24):
    """A broadcast bitmap of a long column's values: a filter without false negatives whose size is bounded.

    Two probes into 2**bits bits.  With more keys than the map can tell apart it lets more rows
    through, which costs time but changes no result, so it never has to grow with the data.
    """
    size = 1 << bits

    def run(batches):
        m = np.zeros(size // 8, np.uint8)
        some = False
        for b in batches:
            if len(b):
                some = True
                for p in _probes(b.column(0).to_numpy(zero_copy_only=False), bits):
                    np.bitwise_or.at(m, p >> 3, (1 << (p & 7)).astype(np.uint8))
        if some:
            step = 1 << 18
            for i in range(0, len(m), step):
                if m[i : i + step].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pa.compress(m[i : i + step].tobytes(), "zstd", asbytes=True)], pa.binary())], names=["at", "part"])

    step = min(1 << 18, size // 8)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(part, step, "zstd", asbytes=True), np.uint8)
                held[at] = held[at] | got if at in held else got
        for at, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pa.compress(m.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["at", "part"])

    parts = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(run, "at long, part binary").repartition("at").mapInArrow(merge, "at long, part binary").toArrow()
    bitmap = np.zeros(size // 8, np.uint8)
    for at, part in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
        bitmap[at : at + step] = np.frombuffer(pa.decompress(part, step, "zstd", asbytes=True), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bitmap), bits


def _probes(values, bits: int):
    h = mix(values.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)]


def passes(bitmap, bits: int, values):
    """Which of these keys may be in the filter."""
    ok = np.ones(len(values), bool)
    for p in _probes(values, bits):
        ok &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def may_be_in(col: Column, filt) -> Column:
    """Whether a long column's value may be one of the filter's keys; false for null."""
    held, bits = filt

    def test(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        return pd.Series(known & passes(held.value, bits, v.fillna(0).to_numpy().astype("int64")))

    return F.pandas_udf(test, "boolean")(col)
