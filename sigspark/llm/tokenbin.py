"""Binary token files: blocks of ids, transposed into bit or byte planes, each plane compressed with zstandard.

A file is: the magic ``SGTP``, version (u1), plane kind (u1: 1 bits, 8 bytes), two unused bytes, ids of a block (u4); the
blocks; the chunk index; the offset of the index (u8), number of blocks (u4) and the magic again. The chunk index has for
each block: offset (u8), ids (u4), number of planes (u1), and the compressed bytes of each plane (u4). All little-endian.
Planes above the highest bit in use are not stored. Any range of ids is read from the index and the blocks it touches.
"""

from __future__ import annotations

import os
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, shared_dir

MAGIC, BITS, BYTES = b"SGTP", 1, 8


def planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    used = max(1, (top.bit_length() + 7) // 8)
    if kind == BYTES:
        return [raw[:, j].tobytes() for j in range(used)]
    out = []
    for j in range(used):
        column = np.ascontiguousarray(raw[:, j])
        out += [np.packbits((column >> b) & 1, bitorder="little").tobytes() for b in range(8) if 8 * j + b < max(1, top.bit_length())]
    return out


def join_planes(parts: list[bytes], n: int, kind: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for j, p in enumerate(parts):
        if kind == BYTES:
            raw[:, j] = np.frombuffer(p, np.uint8)
        else:
            raw[:, j // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << (j % 8)
    return raw.reshape(-1).view("<u4")


class Writer:
    """Appends ids to an open binary file; memory holds one block."""

    def __init__(self, f, block: int = 1 << 16, kind: int = BYTES, level: int = 1) -> None:
        self.f, self.block, self.kind, self.z = f, block, kind, zstandard.ZstdCompressor(level)
        self.wait: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.at = f.write(head := struct.pack("<4sBBHI", MAGIC, 1, kind, 0, block)) or len(head)

    def add(self, ids: np.ndarray) -> None:
        self.wait.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block:
            full = np.concatenate(self.wait)
            n = len(full) // self.block * self.block
            for i in range(0, n, self.block):
                self._put(full[i : i + self.block])
            self.wait, self.waiting = [full[n:].copy()], len(full) - n

    def _put(self, ids: np.ndarray) -> None:
        parts = [self.z.compress(p) for p in planes(ids, self.kind)]
        self.index.append((self.at, len(ids), [len(p) for p in parts]))
        for p in parts:
            self.f.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.wait))
        for at, n, sizes in self.index:
            self.f.write(struct.pack(f"<QIB{len(sizes)}I", at, n, len(sizes), *sizes))
        self.f.write(struct.pack("<QI4s", self.at, len(self.index), MAGIC))
        self.f.close()


class Reader:
    """Reads ranges of ids; ``f`` can seek. Memory holds the index and one block."""

    def __init__(self, f) -> None:
        self.f, self.z = f, zstandard.ZstdDecompressor()
        magic, version, self.kind, _, self.block = struct.unpack("<4sBBHI", f.read(12))
        end = f.seek(0, os.SEEK_END)
        end = f.tell() if end is None else end
        f.seek(end - 16)
        at, n, tail = struct.unpack("<QI4s", f.read(16))
        if (magic, version, tail) != (MAGIC, 1, MAGIC):
            raise ValueError("not a whole token file")
        f.seek(at)
        raw, p = f.read(end - 16 - at), 0
        self.index = []
        for _ in range(n):
            offset, ids, k = struct.unpack_from("<QIB", raw, p)
            self.index.append((offset, ids, struct.unpack_from(f"<{k}I", raw, p + 13)))
            p += 13 + 4 * k
        self.last: tuple[int, np.ndarray] | None = None

    def chunk(self, i: int) -> np.ndarray:
        if not self.last or self.last[0] != i:
            offset, n, sizes = self.index[i]
            self.f.seek(offset)
            raw, parts, p = self.f.read(sum(sizes)), [], 0
            width = n if self.kind == BYTES else (n + 7) // 8
            for s in sizes:
                parts.append(self.z.decompress(raw[p : p + s], max_output_size=width))
                p += s
            self.last = (i, join_planes(parts, n, self.kind))
        return self.last[1]

    def ranges(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n > 0:
            i, off = divmod(start, self.block)
            got = self.chunk(i)[off : off + n]
            if not len(got):
                raise ValueError("the file ends before the range does")
            yield got
            start, n = start + len(got), n - len(got)


def opened(uri: str, mode: str):
    """A file of any store: local paths and file: by the system, others by Arrow's file systems."""
    u = urllib.parse.urlsplit(uri)
    if u.scheme in ("", "file"):
        path = urllib.parse.unquote(u.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_file(path)


def write_files(df: DataFrame, encode: Callable[[list[str | None]], list[np.ndarray]], folder: str, order: str = "doc_id", text: str = "text", end_id: int | None = None, block: int = 1 << 16, kind: int = BYTES, level: int = 1, partitions: int | None = None) -> DataFrame:
    """Writes token files in ascending order of ``order`` and returns the manifest: a row for each row of ``df``.

    ``encode`` gives the ids of texts as little-endian u4; ``end_id`` is put behind each. Rows are dealt by ranges of
    (order, hash of text), so rows with one id spread by their texts, and copies of a text by their ids; only rows equal in both stay together; nulls come first, ties are in the order of
    the hash of the text. Each task streams its range into one file of its own name, and only files of tasks that ended
    well are in the manifest, so a task that is lost and run again does no harm. Manifest columns: ``order``, ``file``,
    ``file_start`` (ids before the row in its file), ``start`` (ids before it in all files), ``n_tokens``. An empty table
    has an empty manifest. Only counts by file, not ids or rows, meet in one task for the running sum.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = df.schema[order].dataType
    rows = df.select(F.col(f"`{order}`").alias("__id"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{text}`")).alias("__h"))
    rows = rows.repartitionByRange(n, F.col("__id").asc_nulls_first(), F.col("__h")).sortWithinPartitions(F.col("__id").asc_nulls_first(), "__h", "__text")

    def run(batches):
        from pyspark import TaskContext

        part, out, name = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for at, k in blocks(batch.column(1), 1 << 22):
                if out is None:
                    name = f"{folder}/{part:08d}-{uuid.uuid4().hex}.sgtp"
                    out = Writer(opened(name, "wb"), block, kind, level)
                starts, sizes = [], []
                for ids in encode(batch.column(1).slice(at, k).to_pylist()):
                    starts.append(out.total)
                    out.add(ids)
                    if end_id is not None:
                        out.add(np.array([end_id], "<u4"))
                    sizes.append(out.total - starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), pa.array([part] * k, pa.int32()), pa.array([name] * k), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["__id", "part", "file", "file_start", "n_tokens"]
                )
        if out is not None:
            out.close()

    made = cut(rows.mapInArrow(run, f"__id {id_type.simpleString()}, part int, file string, file_start bigint, n_tokens bigint"))
    files = made.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    joined = made.join(before, "file")
    return joined.select(F.col("__id").alias(order), "file", "file_start", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens")


def read_files(manifest: DataFrame, fields: str, kernel: Callable[[list[Iterator[np.ndarray]]], list[list]], keep: list[str]) -> DataFrame:
    """Reads the ids of each row of a manifest from its file; ``kernel`` turns the ids of a row, which come as runs, into
    the values of ``fields``. Rows are dealt by file and read in order, so each block is read once in a task."""
    spark = manifest.sparkSession
    cols = list(dict.fromkeys(["file", "file_start", "n_tokens", *keep]))
    rows = manifest.select(*cols).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "file_start")
    schema = ", ".join([*(f"`{c}` {manifest.schema[c].dataType.simpleString()}" for c in keep), fields])
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        name, f = None, None
        for batch in batches:
            b = {c: batch.column(batch.schema.get_field_index(c)) for c in cols}
            made = []
            for file, start, n in zip(b["file"].to_pylist(), b["file_start"].to_pylist(), b["n_tokens"].to_pylist(), strict=True):
                if file != name:
                    if f is not None:
                        f.f.close()
                    name, f = file, Reader(opened(file, "rb"))
                made.append(kernel(f.ranges(start, n)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array([m[i] for m in made], pa.int64()) for i in range(len(names)))], names=[*keep, *names])
        if f is not None:
            f.f.close()

    return rows.mapInArrow(run, schema)


def crc_of_runs(runs: Iterator[np.ndarray]) -> list[int]:
    """The number of ids and the unsigned crc32 of their little-endian bytes."""
    n = crc = 0
    for ids in runs:
        n += len(ids)
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), crc)
    return [n, crc]


def new_folder(spark) -> str:
    """A folder for token files under spark.checkpoint.dir."""
    return shared_dir(spark)
