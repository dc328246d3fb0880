"""Audio files as tables of signals: format detection in SQL, PCM WAV decoding in Arrow batches, a WAV sink.

FLAC, OGG and MP3 are recognised; their codecs are not part of Python, so ``load`` takes decoders for them.
"""

from __future__ import annotations

import io
import os
import struct
import urllib.parse
import uuid
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp

FORMATS = ("wav", "flac", "ogg", "mp3")
SIGNALS = "signal_id string, sr int, origin_sr int, norm boolean, path string, samples array<double>"


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def format_of_extension(path: Column) -> Column:
    """wav, flac, ogg or mp3, else null."""
    e = file_extension(path)
    return F.when(e.isin(*FORMATS), e)


def format_of_magic(content: Column) -> Column:
    """What the first twelve bytes say: a RIFF with WAVE, fLaC, OggS, an ID3 tag or an MPEG layer's sync; else null."""
    head = F.hex(F.substring(content, 1, 12))
    four = F.substring(head, 1, 8)
    second = F.conv(F.substring(head, 3, 2), 16, 10).cast("int")
    sync = (F.substring(head, 1, 2) == "FF") & (second >= 224) & (second.bitwiseAND(F.lit(24)) != 8) & (second.bitwiseAND(F.lit(6)) != 0)
    is_wave = four.isin("52494646", "52463634", "52494658") & (F.substring(head, 17, 8) == "57415645")
    return F.when(is_wave, "wav").when(four == "664C6143", "flac").when(four == "4F676753", "ogg").when((F.substring(head, 1, 6) == "494433") | F.coalesce(sync, F.lit(False)), "mp3")


def detect_format(path: Column, content: Column) -> Column:
    """The format on which name and content agree; a row where they do not fails with its path."""
    by_name, by_bytes = format_of_extension(path), format_of_magic(content)
    wrong = F.raise_error(F.concat(F.lit("not an audio file of a known format: "), path))
    return F.when(by_name.isNotNull() & by_name.eqNullSafe(by_bytes), by_name).otherwise(wrong.cast("string"))


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and channels x samples in [-1, 1): PCM of 8, 16, 24 and 32 bits and 32- and 64-bit floats.

    Numbers are little-endian, in a RIFX file big-endian. An RF64 file has the true size of its data ahead of it; what
    stands there is read to the end of the file.
    """
    if raw[:4] not in (b"RIFF", b"RF64", b"RIFX") or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    e = ">" if raw[:4] == b"RIFX" else "<"
    at, fmt = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from(f"{e}I", raw, at + 4)[0]
        if name == b"fmt ":
            kind, channels, sr, _, _, bits = struct.unpack_from(f"{e}HHIIHH", raw, at + 8)
            if kind == 0xFFFE:
                kind = struct.unpack_from(f"{e}H", raw, at + 32)[0]
            fmt = (kind, channels, sr, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("a WAV file without a format")
            kind, channels, sr, bits = fmt
            body = raw[at + 8 : at + 8 + size]
            width = bits // 8
            body = body[: len(body) // (width * channels) * width * channels]
            if kind == 3:
                x = np.frombuffer(body, f"{e}f{width}").astype(float)
            elif kind != 1 or bits not in (8, 16, 24, 32):
                raise ValueError(f"WAV encoding {kind} with {bits} bits is not supported")
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(body, np.uint8).reshape(-1, 3)[:, :: -1 if e == ">" else 1].astype(np.int32)
                x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
            else:
                x = np.frombuffer(body, f"{e}i{width}") / 2.0 ** (bits - 1)
            return sr, x.reshape(-1, channels).T
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def load(spark: SparkSession, path: str, sr: int = 0, norm: bool = False, decoders: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] | None = None) -> DataFrame:
    """A signal for each audio file under ``path``: checked, decoded, mixed to mono, resampled if ``sr``, normalised.

    Files spread over tasks as ``binaryFile`` deals them; each is decoded where it is read. WAV is decoded here; for flac,
    ogg and mp3 ``decoders`` takes a function each, from the bytes of a file to its sample rate and channels x samples.
    """
    known = {"wav": decode_wav} | (decoders or {})
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    checked = files.select("path", detect_format(F.col("path"), F.col("content")).alias("format"), "content")

    def run(batches):
        for b in batches:
            rows = []
            for p, f, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if f not in known:
                    raise NotImplementedError(f"give load() a decoder of {f}: {p}")
                rate, x = known[f](raw)
                x = x.mean(0)
                if sr and sr != rate:
                    x = dsp.resample(x, rate, sr)
                rows.append((p, sr or rate, rate, norm, p, dsp.normalize_peak(x) if norm else x))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["signal_id", "sr", "origin_sr", "norm", "path", "samples"])

    return checked.mapInArrow(run, SIGNALS)


def samplerates(spark: SparkSession, path: str) -> DataFrame:
    """(path, sr) of WAV files, from their headers."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 4096).alias("head"))
    four = F.expr("substring(hex(head), instr(hex(head), '666D7420') + 24, 8)")
    swapped = F.concat(*[F.substring(four, i, 2) for i in (7, 5, 3, 1)])
    return files.select("path", F.conv(swapped, 16, 10).cast("int").alias("sr"))


def to_mono(channels: Column) -> Column:
    """The mean over an array of channels."""
    first = F.transform(F.element_at(channels, 1), lambda v: v * 0.0)
    total = F.aggregate(channels, first, lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda v: v / F.size(channels))


def normalize_peak(samples: Column) -> Column:
    top = F.array_max(F.transform(samples, lambda v: F.abs(v)))
    return F.when(top > 0, F.transform(samples, lambda v: v / top)).otherwise(samples)


def encode_wav(x: np.ndarray, sr: int) -> bytes:
    """Mono 16-bit PCM."""
    if sr <= 0:
        raise ValueError("the sample rate must be positive")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.clip(np.rint(np.asarray(x) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def save(signals: DataFrame, folder: str) -> DataFrame:
    """(signal_id, path): a WAV file for each signal in a folder that all executors share. Files have names of their own
    and are moved into place whole, so a task that runs twice leaves a spare file and no broken one."""

    def run(batches):
        for b in batches:
            paths = []
            for i in range(b.num_rows):
                raw = encode_wav(b.column(2)[i].values.to_numpy(zero_copy_only=False), b.column(1)[i].as_py())
                name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wav"
                local = urllib.parse.urlsplit(name)
                if local.scheme in ("", "file"):
                    os.makedirs(os.path.dirname(local.path), exist_ok=True)
                    with open(local.path + ".part", "wb") as f:
                        f.write(raw)
                    os.replace(local.path + ".part", local.path)
                else:
                    from pyarrow import fs

                    store, p = fs.FileSystem.from_uri(name)
                    with store.open_output_stream(p) as f:
                        f.write(raw)
                paths.append(name)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths)], names=["signal_id", "path"])

    return signals.select("signal_id", "sr", "samples").mapInArrow(run, "signal_id string, path string")
