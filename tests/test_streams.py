"""Streams of frames in any order, against the batch results."""

import numpy as np
import pandas as pd


from sigspark.meta import SpecMeta, Stage
from sigspark.operators import spectral
from sigspark.streaming import frames as streaming

T0 = pd.Timestamp("2024-01-01")


def streamed(spark, tmp_path, batches, schema, f, name):
    """The rows that ``f`` of a stream of files, a batch each, gives."""
    folder = tmp_path / name
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{folder}/raw-{i}")
        part = next((folder / f"raw-{i}").glob("part-*.parquet"))
        (folder / "in").mkdir(exist_ok=True)
        part.rename(folder / "in" / f"{i:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).toPandas()


def arrivals(rows, key="frame"):
    """Two signals whose frames come out of order, again, and too late; then time goes on, twice."""
    second = lambda s: (T0 + pd.Timedelta(seconds=s)).to_pydatetime()
    at = {(k, f): (k, f, second(f), *v) for k, f, *v in rows}
    order = [[("a", 1), ("a", 0), ("b", 0)], [("a", 3), ("a", 5), ("b", 2)], [("a", 2), ("a", 3), ("b", 1)], [("a", 4), ("a", 0), ("b", 3)], [("a", 6), ("a", 7), ("b", 5)]]
    batches = [[at[x] for x in b] for b in order]
    end = lambda s: [("end", 0, second(s), *next(iter(at.values()))[3:])]
    return [*batches, end(400), end(401), [at["b", 4], *end(402)], end(800), end(801)]


def test_inverse_of_a_stream(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(k, f, (c := np.fft.rfft(r.normal(size=16))).real.tolist(), c.imag.tolist()) for k, n in (("a", 8), ("b", 6)) for f in range(n)]
    schema = "signal_id string, frame long, ts timestamp, re array<double>, im array<double>"
    got = streamed(spark, tmp_path, arrivals(rows), schema, lambda s: streaming.stream_istft(s, 16, 4), "inverse")
    batch = spark.createDataFrame([(k, f, 0.0, a, b) for k, f, a, b in rows if (k, f) != ("b", 4)], "signal_id string, frame int, t double, re array<double>, im array<double>")
    expected = spectral.istft(Stage(batch, SpecMeta("stft", 16, 16, 4, nfft=16, freq=tuple(range(9))), "re")).toPandas()
    for k in ("a", "b"):
        a, b = got[got.signal_id == k].sort_values("n"), expected[expected.signal_id == k].sort_values("n")
        assert a["n"].tolist() == b["n"].tolist()  # each sample once
        np.testing.assert_allclose(a["x"], b["x"], atol=1e-12)


def test_onsets_of_a_stream(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(k, f, r.random(9).tolist()) for k, n in (("a", 8), ("b", 6)) for f in range(n)]
    got = streamed(spark, tmp_path, arrivals(rows), "signal_id string, frame long, ts timestamp, spec array<double>", streaming.stream_onset, "onsets")
    for k, frames in (("a", range(8)), ("b", [0, 1, 2, 3, 5])):
        db = np.array([10 * np.log10(v) for s, f, v in rows if s == k and f in frames])
        own = got[got.signal_id == k].sort_values("frame")
        assert own["frame"].tolist() == list(frames)
        np.testing.assert_allclose(own["value"], np.r_[0, np.maximum(np.diff(db, axis=0), 0).mean(1)])

