"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is empty (tests on one machine) is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sigspark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sigspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            spark.sparkContext.setCheckpointDir(base)
        else:
            shared_dir(spark)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run made, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Gives freed memory back to the system where the C library can; between small objects it keeps what arrays leave."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the faster ``lower``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a column that is used inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_columns_replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns; a column of ``df`` whose name is taken (in any case) gives way."""
    taken = {n.lower() for n in new}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in new.items()])


def map_text(df: DataFrame, text: str, fields: list[T.StructField], kernel, keep: list[str] | None = None, block: int = 1 << 20) -> DataFrame:
    """Adds ``fields``, computed from the column ``text`` by ``kernel(list of str or None) -> list of lists``.

    ``kernel`` is called with blocks of about ``block`` characters, so memory holds one block and the Arrow batch it is
    from, whatever the size of the table. A column of ``df`` with the name of a new field gives way to it.
    """
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = "__text" + uuid.uuid4().hex[:8]
    wide = df.select(F.col(f"`{text}`").alias(source), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*wide.schema.fields[1:], *fields])
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for at, n in blocks(texts, block):
                cols = kernel(texts.slice(at, n).to_pylist())
                made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                rest = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], *made], names=[*kept, *(f.name for f in fields)])

    return wide.mapInArrow(run, schema)


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with about ``size`` bytes each; at least a row."""
    lengths = [x or 0 for x in pc.binary_length(texts).to_pylist()]
    at = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield at, i + 1 - at
            at, total = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths) - at


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
