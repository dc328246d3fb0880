"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``frame`` bytes that decompress on their own. Behind the frames stand two
skippable frames: the record index, which maps each record's identifier to (frame, offset within the decompressed frame,
length), and the seek table of the public seekable format, with the compressed size, the size and the checksum of every
frame. Any Zstandard tool reads the whole file as one WARC; :class:`Reader` gets one record by reading one frame.

Index entry: the 16 bytes of the record's UUID, then frame, offset and length as little-endian u4.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir  # noqa: F401
from .tokenbin import opened

INDEX_FRAME, SEEK_FRAME, SEEK_END = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, SEEK_ENTRY, HEAD, FOOT = struct.Struct("<16sIII"), struct.Struct("<III"), struct.Struct("<II"), struct.Struct("<IBI")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, by RFC 4122


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(key: str | None, url: str, digest: str, copy: int) -> uuid.UUID:
    """The same for each attempt at a record, so that revisits name a response without asking for it."""
    return uuid.uuid5(SPACE, f"{'' if key is None else f'={key}'}\n{url}\n{digest}\n{copy}")


def header(fields: list[tuple[str, str | None]]) -> bytes:
    """Named fields; line ends and other control characters of a value are percent-encoded, None is left out."""
    safe = lambda v: "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in v)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode("utf-8", "replace")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields, with lower-case names, and the block of one record."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what it says")
    return fields, rest[:n]


def payload_of(block: bytes) -> bytes:
    """What follows the header of a HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


class Writer:
    """Appends records to an open binary file; memory holds a frame and the index."""

    def __init__(self, f, frame: int = 1 << 20, level: int = 3) -> None:
        self.f, self.frame, self.z = f, frame, zstandard.ZstdCompressor(level)
        self.wait: list[bytes] = []
        self.waiting = self.written = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []

    def add(self, ident: bytes, *parts: bytes) -> tuple[int, int, int]:
        """(frame, offset within it, length) of the record that ``parts`` make."""
        n, at = sum(map(len, parts)), (len(self.frames), self.waiting)
        self.wait += parts
        self.waiting += n
        self.index.append(ENTRY.pack(ident, *at, n))
        if self.waiting >= self.frame:
            self._flush()
        return (*at, n)

    def _flush(self) -> None:
        raw = b"".join(self.wait)
        small = self.z.compress(raw)
        self.f.write(small)
        self.written += len(small)
        self.frames.append((len(small), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.wait, self.waiting = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = b"".join(self.index)
        self.f.write(HEAD.pack(INDEX_FRAME, len(index)) + index)
        self.frames.append((len(index) + HEAD.size, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(SEEK_ENTRY.pack(*x) for x in self.frames) + FOOT.pack(len(self.frames), CHECKSUMS, SEEK_END)
        self.f.write(HEAD.pack(SEEK_FRAME, len(table)) + table)
        self.f.close()


class Reader:
    """Reads records of a bundle; ``f`` can seek. Memory holds the seek table and one frame."""

    def __init__(self, f) -> None:
        self.f, self.z = f, zstandard.ZstdDecompressor()
        f.seek(0, os.SEEK_END)
        self.end = f.tell()
        if self.end < FOOT.size:
            raise ValueError("not a whole bundle")
        n, flags, magic = FOOT.unpack(self._read(self.end - FOOT.size, FOOT.size))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError("not a whole bundle")
        size = n * SEEK_ENTRY.size + FOOT.size
        start = self.end - size - HEAD.size
        if start < 0 or HEAD.unpack(self._read(start, HEAD.size)) != (SEEK_FRAME, size):
            raise ValueError("the seek table is damaged")
        self.frames, at = [], 0
        for small, raw, check in SEEK_ENTRY.iter_unpack(self._read(start + HEAD.size, n * SEEK_ENTRY.size)):
            self.frames.append((at, small, raw, check))
            at += small
        if at != start:
            raise ValueError("the seek table is damaged")
        self.last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def index(self) -> Iterator[tuple[bytes, int, int, int]]:
        """(identifier, frame, offset, length) of each record, in order."""
        at, small, _, _ = self.frames[-1]
        if HEAD.unpack(self._read(at, HEAD.size)) != (INDEX_FRAME, small - HEAD.size):
            raise ValueError("the record index is damaged")
        return ENTRY.iter_unpack(self.f.read(small - HEAD.size))

    def decompressed(self, i: int) -> bytes:
        if self.last[0] != i:
            at, small, raw, check = self.frames[i]
            got = self.z.decompress(self._read(at, small), max_output_size=max(raw, 1))
            if len(got) != raw or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
                raise ValueError("a frame is damaged")
            self.last = (i, got)
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.decompressed(frame)[offset : offset + length]


def write_archives(
    df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", body: str = "html", least: int = 0, frame: int = 1 << 20, file_bytes: int = 1 << 30, level: int = 3, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record for each row and returns the manifest: record_id, file, frame, offset, length.

    A payload is the column ``body`` in UTF-8, or its bytes; null is empty. Of records with equal payloads of at least
    ``least`` bytes, the one with the smallest id (then url) is a response, and the others are revisits without a payload
    that name it; shorter ones are all responses. A null id counts as the largest and a null url as empty. Of rows equal
    in id, url and payload, one is the response and each other one a revisit of it.

    Payloads are equal where SHA-1, a second hash and length are. Each distinct payload is shuffled once from each task
    that has it; its copies pass on as narrow rows, which find their response by a join in which at most a thousand
    frequent payloads are broadcast, and numbered in chunks where one row repeats often. Files are named anew by each
    attempt, and only those of tasks that ended well stand in the manifest, which is checkpointed. A file begins with a
    warcinfo record and ends at about ``file_bytes``. An empty table gives an empty manifest and no file.
    """
    raw = F.coalesce(F.col(f"`{body}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), raw.alias("body"))
    rows = rows.select("*", F.sha1("body").alias("sha"), F.xxhash64("body").alias("twin"), F.octet_length("body").cast("bigint").alias("size"))
    same = ["sha", "twin", "size"]
    who = F.struct(F.col("id").isNull().alias("none"), "id", "key", "url")
    wide = "key string, url string, sha string, size bigint, copy bigint, body binary, first_key string, first_url string"
    # narrow rows: who has which payload, how often
    narrow = cut(rows.where(F.col("size") >= least).groupBy("key", "id", "url", *same).agg(F.count("*").alias("copies")))
    shared = narrow.groupBy(*same).agg(F.min(who).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    shared = cut(shared.select(*same, F.col("first.key").alias("first_key"), F.col("first.url").alias("first_url"), "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * 1000 > total  # of fewer than 1,000 payloads
    met = narrow.join(F.broadcast(shared.where(frequent)), same).unionByName(narrow.join(shared.where(~frequent), same))
    is_first = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("url") == F.col("first_url"))
    chunk = 1000
    spread = met.select("*", F.when(is_first, 1).otherwise(0).cast("bigint").alias("from")).where("from < copies")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / chunk))))
    spread = spread.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "url", "sha", "part")
    copy = F.explode(F.sequence(F.greatest("from", F.col("part") * chunk), F.least("copies", (F.col("part") + 1) * chunk) - 1))
    spread = spread.where(F.greatest("from", F.col("part") * chunk) < F.least("copies", (F.col("part") + 1) * chunk))
    revisits = spread.select("key", "url", "sha", "size", copy.alias("copy"), F.lit(None).cast("binary").alias("body"), "first_key", "first_url")
    none = [F.lit(None).cast("string").alias("first_key"), F.lit(None).cast("string").alias("first_url")]
    bodies = rows.where(F.col("size") >= least).groupBy(*same).agg(F.min(who).alias("first"), F.any_value("body").alias("body"))
    out = bodies.select("first.key", "first.url", "sha", "size", F.lit(0).cast("bigint").alias("copy"), "body", *none).union(revisits)
    if least > 0:  # of short payloads each row has its own number
        out = out.union(rows.where(F.col("size") < least).select("key", "url", "sha", "size", F.monotonically_increasing_id().alias("copy"), "body", *none))

    def run(batches):
        from pyspark import TaskContext

        part, w, name = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            got = []
            names = [f.split()[0] for f in wide.split(", ")]
            for key, link, sha, size, n, body, first, first_url in zip(*(batch.column(batch.schema.get_field_index(c)) for c in names), strict=True):
                if w is None:
                    name = f"{folder}/{part:08d}-{uuid.uuid4().hex}.warc.zst"
                    w = Writer(opened(name, "wb"), frame, level)
                    info = f"software: sigspark\r\nformat: WARC File Format 1.1\r\npart: {part}\r\n".encode()
                    own = uuid.uuid4()
                    head = header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own.urn}>"), ("WARC-Date", date), ("WARC-Filename", name.rpartition("/")[2]), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))])
                    w.add(own.bytes, head, info, b"\r\n\r\n")
                ident, parts = record(key.as_py(), link.as_py(), sha.as_py(), size.as_py(), n.as_py(), body.as_py(), first.as_py(), first_url.as_py(), date)
                got.append((ident.urn, name, *w.add(ident.bytes, *parts)))
                if w.written >= file_bytes:
                    w.close()
                    w = None
            cols = list(zip(*got, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "file", "frame", "offset", "length"])
        if w is not None:
            w.close()

    return cut(out.mapInArrow(run, "record_id string, file string, frame bigint, offset bigint, length bigint"))


def record(key: str | None, url: str, sha: str, size: int, copy: int, body: bytes | None, first: str | None, first_url: str | None, date: str) -> tuple[uuid.UUID, list[bytes]]:
    """Identifier and bytes of a response, or without ``body`` of a revisit of the record of ``first`` and ``first_url``."""
    digest = base32_of_hex(sha)
    ident = record_id(key, url, digest, copy)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = body is None
    quoted = lambda v: None if v is None else urllib.parse.quote(v)
    head = header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{ident.urn}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{record_id(first, first_url or '', digest, 0).urn}>" if revisit else None),
            ("WARC-Refers-To-Target-URI", first_url if revisit else None),
            ("X-Row-Id", quoted(key)),
            ("X-Refers-To-Row-Id", quoted(first) if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(http) + (0 if revisit else len(body)))),
        ]
    )
    return ident, [head, http, *([] if revisit else [body]), b"\r\n\r\n"]


def index_of(files: DataFrame) -> DataFrame:
    """record_id, file, frame, offset and length of all records, from the indexes of the files in the column ``file``."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name, "rb") as f:
                    found = Reader(f).index()
                    while rows := [x for _, x in zip(range(10_000), found, strict=False)]:
                        cols = [[uuid.UUID(bytes=r[0]).urn for r in rows], [name] * len(rows), *([r[i] for r in rows] for i in (1, 2, 3))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "file", "frame", "offset", "length"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").distinct().repartition(n, "file").mapInArrow(run, "record_id string, file string, frame bigint, offset bigint, length bigint")


FIELDS = "record_id string, record_type string, row_id string, target_uri string, payload_bytes bigint, payload_digest string, refers_to_id string, refers_to_row string"


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of an index or a manifest, or of any rows chosen from one, read from their files.

    Frames are dealt to tasks and each is read and decompressed once in a task. Columns: record_id, record_type (also
    ``warcinfo``), row_id (null where the row had none), target_uri, payload_bytes and payload_digest (of a response
    computed from its payload, and held against its header; of a revisit from its header), refers_to_id and refers_to_row
    (null but for revisits), and with ``payload`` the bytes (null but for responses). A damaged frame or record raises
    ValueError.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "frame", "offset", "length").repartition(n, "file", "frame").sortWithinPartitions("file", "frame", "offset")
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payload
    kinds = [pa.int64() if x == "payload_bytes" else pa.binary() if x == "payload" else pa.string() for x in names]

    def run(batches):
        name, f = None, None
        for batch in batches:
            got, held = [], 0
            for file, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.f.close()
                    name, f = file, Reader(opened(file, "rb"))
                got.append(described(f.record(frame, offset, length), payload))
                held += length * payload
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
                    got, held = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
        if f is not None:
            f.f.close()

    return rows.mapInArrow(run, FIELDS + ", payload binary" * payload)


def described(raw: bytes, payload: bool) -> tuple:
    h, block = parse(raw)
    kind, body, digest, size = h["warc-type"], None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
    row = lambda k: urllib.parse.unquote(h[k]) if k in h else None
    if kind == "response":
        body = payload_of(block)
        size = len(body)
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError("a payload is not what its digest says")
    elif kind == "revisit":
        size = int(next(x.partition(b":")[2] for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    got = (h["warc-record-id"].strip("<>"), kind, row("x-row-id"), h.get("warc-target-uri"), size, digest, h.get("warc-refers-to", "").strip("<>") or None, row("x-refers-to-row-id"))
    return (*got, body if kind == "response" else None) if payload else got


def by_row(records: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Responses and revisits with the ids as they were written."""
    as_id = lambda c: F.col(c).cast(kind).alias(id_col if c == "row_id" else "refers_to")
    found: Column = F.col("record_type").isin("response", "revisit")
    return records.where(found).select(as_id("row_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to_row"), "record_id", "refers_to_id", "target_uri")
