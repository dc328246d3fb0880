"""Arrow batches of array columns as numpy matrices, and back, without a Python object for each value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARRAY = T.ArrayType(T.DoubleType(), False)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix that shares the column's memory."""
    if not len(col):
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(col), -1)


def lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=np.float64)
    rows, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(m.ravel()))


def ragged(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0)]).astype(float)))


def per_frame(df: DataFrame, inputs: list[str], fields: dict[str, T.DataType], kernel: Callable[..., list[np.ndarray]], keep: list[str]) -> DataFrame:
    """Adds columns that ``kernel(matrix of each input)`` gives for a batch of frames; a matrix becomes an array column.

    Rows stay where they are. Array inputs have the same length in every row; scalar inputs come as vectors.
    """
    kept = [c for c in keep if c not in fields and c in df.columns]  # whole-signal front ends have no frame energy
    cols = list(dict.fromkeys([*kept, *inputs]))
    wide = df.select(*cols)
    schema = T.StructType([*(wide.schema[c] for c in kept), *(T.StructField(k, v) for k, v in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = {c: b.column(i) for i, c in enumerate(cols)}
            args = [matrix(at[c]) if pa.types.is_list(at[c].type) or pa.types.is_large_list(at[c].type) else at[c].to_numpy(zero_copy_only=False) for c in inputs]
            made = [lists(v) if v.ndim == 2 else pa.array(v) for v in map(np.asarray, kernel(*args))]
            yield pa.RecordBatch.from_arrays([*(at[c] for c in kept), *made], names=[*kept, *fields])

    return wide.mapInArrow(run, schema)


def per_signal(df: DataFrame, fields: dict[str, T.DataType], kernel: Callable[[np.ndarray, dict], Iterator[tuple]], key: str = "signal_id", samples: str = "samples", carry: list[str] | None = None) -> DataFrame:
    """Rows that ``kernel(samples, row)`` yields for each signal; values of array fields are numpy vectors.

    A signal is a row, so signals spread over tasks as rows do and one is in memory at a time.
    """
    carry = carry or []
    cols = [key, samples, *[c for c in carry if c not in (key, samples)]]
    wide = df.select(*cols)
    schema = T.StructType([wide.schema[key], *(T.StructField(k, v) for k, v in fields.items())])
    kinds = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(1)[i].values
                x = np.zeros(0) if x is None else np.asarray(x.to_numpy(zero_copy_only=False), float)
                row = {c: b.column(j)[i].as_py() for j, c in enumerate(cols) if j != 1}
                for some in _some(kernel(x, row)):
                    part = list(zip(*some, strict=True))
                    arrays = [ragged([np.asarray(v, float) for v in p]) if isinstance(t, T.ArrayType) else pa.array([v.item() if isinstance(v, np.generic) else v for v in p], _plain(t)) for p, t in zip(part, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row[key]] * len(part[0]), b.column(0).type), *arrays], names=[key, *fields])

    return wide.mapInArrow(run, schema)


def _some(rows: Iterable[tuple], most: int = 4096, values: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows some at a time: ``most`` of them, or fewer with long arrays."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += sum(v.size for v in r if isinstance(v, np.ndarray))
        if len(out) >= most or size >= values:
            yield out
            out, size = [], 0
    if out:
        yield out


def _plain(t: T.DataType) -> pa.DataType:
    return {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}[t]


#: Frames of a signal that go through a window over neighbours together.
BLOCK = 4096


def neighbours(df: DataFrame, most: int) -> tuple[DataFrame, WindowSpec]:
    """``df`` and a window in which each frame sees the ``most`` frames before it, so that ``lag`` needs no whole signal.

    Signals are cut in blocks of frames; the last frames of a block go to the next block too. ``own_block`` drops these.
    """
    to = F.sequence(F.floor(F.col("frame") / BLOCK), F.floor((F.col("frame") + most) / BLOCK))
    return df.withColumn("__block", F.explode(to)), Window.partitionBy("signal_id", "__block").orderBy("frame")


def own_block(df: DataFrame) -> DataFrame:
    return df.where(F.col("__block") == F.floor(F.col("frame") / BLOCK)).drop("__block")


def with_top(df: DataFrame, column: str = "spec") -> DataFrame:
    """Adds ``__top``, the largest value in a signal's arrays: a partial aggregate and a join, so spectra are not gathered."""
    return df.join(df.groupBy("signal_id").agg(F.max(F.array_max(column)).alias("__top")), "signal_id")


def grouped(df: DataFrame, key: str, order: str, value: str, name: str = "samples") -> DataFrame:
    """One row for each key with its values in order: for kernels that need a whole signal. One array is one row, so this
    is for signals that fit in a task; frame-local work on longer ones starts from ``framing.frame_long``.

    Values are sorted outside of memory and leave as plain numbers; a list of structs takes ten times their memory.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.col(value).alias("__v"))
    rows = rows.repartition("__k").sortWithinPartitions("__k", "__o", "__v").select(F.col("__k").alias(key), F.col("__v").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def row() -> pa.RecordBatch:
            v = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays([last, pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)], names=[key, name])

        for b in batches:
            if not b.num_rows:
                continue
            keys, v = b.column(0), b.column(1)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
            if held and not keys.slice(0, 1).equals(last):
                yield row()
                held = []
            if held:  # the signal goes on
                stop = int(edge[1]) if len(edge) > 1 else b.num_rows
                held.append(v.slice(0, stop))
                if stop == b.num_rows:
                    continue
                yield row()
                edge = edge[1:]
            if len(edge) > 1:  # signals that begin and end here
                lo, hi = int(edge[0]), int(edge[-1])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(edge[:-1])), pa.ListArray.from_arrays(pa.array((edge - lo).astype(np.int32)), v.slice(lo, hi - lo))], names=[key, name])
            last, held = keys.slice(int(edge[-1]), 1), [v.slice(int(edge[-1]))]
        if held:
            yield row()

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, name)]
    return rows.mapInArrow(run, f"`{key}` {kinds[0]}, `{name}` array<{kinds[1]}>")
