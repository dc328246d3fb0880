"""Registered queries of accessors, options and sources that the main catalog leaves out, each with its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog, oracles
from .catalog import ONSET, PICK, SR, V_ROWS, H, W, cells, frames_e, frames_sql, signals_e, signals_v, spec_e, spec_sql, table, values, values_sql
from .functions import discrete, filterbanks, pitch, transforms
from .functions.windows import window
from .operators import descriptors, framing, rhythm, spectral, wholes
from .plans import presets
from .sources import audio

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CELLS = "SELECT sig AS signal_id, frame::INT AS frame, {}::INT AS bin, round({}, 4) AS value FROM {}"


def register(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def listed(f):
    """Orders, each with the number ``f`` has at the order's place (its key modulo the length)."""

    def q(spark, sf):
        values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(f())], "i int, v double")
        return at_places(spark, sf, values)

    return q


def at_places(spark: SparkSession, sf: str, values) -> DataFrame:
    """Orders joined with rows (i, ...) of a short list, by key modulo its length."""
    n = values.count()
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n).cast("int").alias("i"))
    return rows.join(F.broadcast(values), "i").select("id", *[F.round(c, 6) + 0.0 if t == "double" else F.col(c) for c, t in values.dtypes]).toDF("id", *values.columns)


def places_sql(values: str, n: int) -> str:
    return f"SELECT o_orderkey AS id, q.* FROM orders JOIN ({values}) q ON q.i = o_orderkey % {n}"


def list_sql(n: int, value: str) -> str:
    return places_sql(f"SELECT i::INT AS i, round(({value})::DOUBLE, 6) + 0.0::DOUBLE AS v FROM (SELECT unnest(range({n})) AS i)", n)


def _sources() -> None:
    paths = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s3://b/dir."), F.col("o_orderkey") % 7, F.lit("/clip "), F.col("o_orderkey"), F.element_at(F.array(*map(F.lit, [".wav", ".FLAC", ".Ogg", ".mp3", ".txt", "", ".tar.wav"])), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("p"))
    made = "(SELECT o_orderkey AS id, 's3://b/dir.' || (o_orderkey % 7) || '/clip ' || o_orderkey || (['.wav', '.FLAC', '.Ogg', '.mp3', '.txt', '', '.tar.wav'])[(o_orderkey % 7 + 1)::INT] AS p FROM orders)"
    tail = "string_split(p, '/')[-1]"
    ext = f"CASE WHEN contains({tail}, '.') THEN lower(string_split({tail}, '.')[-1]) ELSE '' END"
    register("filename", lambda s, d: paths(s, d).select("id", audio.filename(F.col("p")).alias("v")), f"SELECT id, {tail} AS v FROM {made}")
    register("file_extension", lambda s, d: paths(s, d).select("id", audio.file_extension(F.col("p")).alias("v")), f"SELECT id, {ext} AS v FROM {made}")
    register("format_of_extension", lambda s, d: paths(s, d).select("id", audio.format_of_extension(F.col("p")).alias("v")), f"SELECT id, CASE WHEN {ext} IN ('wav', 'flac', 'ogg', 'mp3') THEN {ext} END AS v FROM {made}")
    heads = {
        "52494646000000005741564500": "wav", "5249465800000000574156450A": "wav", "524636340000000057415645": "wav", "524946460000000041564920": None, "664C614300000022": "flac", "4F67675300020000": "ogg", "494433040000": "mp3",
        "FFFB9000": "mp3", "FFF38400": "mp3", "FFE8C400": None, "FFF1508000": None, "FFFF": "mp3", "00FFFB90": None, "": None,
    }
    head = lambda k: F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col(k) % len(heads) + 1).cast("int")))
    known = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(heads.values()) if v)
    register("format_of_magic", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), audio.format_of_magic(head("o_orderkey")).alias("v")), f"SELECT o_orderkey AS id, CASE o_orderkey % {len(heads)} {known} END AS v FROM orders")
    good = {".wav": "524946460000000057415645", ".flac": "664C6143000000220000", ".ogg": "4F676753000200000000", ".mp3": "494433040000000000"}
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col(k) % 4 + 1).cast("int"))
    register("detect_format", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), audio.detect_format(F.concat(F.lit("a"), pick(good, "o_orderkey")), F.unhex(pick(good.values(), "o_orderkey"))).alias("v")), "SELECT o_orderkey AS id, (['wav', 'flac', 'ogg', 'mp3'])[(o_orderkey % 4 + 1)::INT] AS v FROM orders")

    def mono(spark, sf):
        v = signals_v(spark, sf).select("signal_id", audio.to_mono(F.array("samples", F.reverse("samples"), F.transform("samples", lambda x: x * x))).alias("m"))
        return v.select("signal_id", F.posexplode("m").alias("n", "x")).select("signal_id", "n", (F.round("x", 6) + 0.0).alias("x"))

    register("to_mono", mono, f"WITH {V_ROWS} SELECT a.sig AS signal_id, a.n::INT AS n, round((a.x + b.x + a.x * a.x) / 3, 6) + 0.0 AS x FROM es a JOIN es b ON a.sig = b.sig AND b.n = 63 - a.n")

    def saved(spark: SparkSession, sf: str) -> str:
        """A folder of WAV files of the embeddings, a quarter as loud, with their names in the files' paths."""
        import tempfile
        import uuid

        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{(base or tempfile.mkdtemp(prefix='sigspark-wav-')).removeprefix('file:')}/wav-{uuid.uuid4().hex}"
        loud = signals_v(spark, sf).select("signal_id", F.lit(8000).alias("sr"), F.transform("samples", lambda v: v / 4).alias("samples"))
        audio.save(loud, folder).count()
        return folder

    def loaded(spark, sf):
        got = audio.load(spark, saved(spark, sf))
        return got.select("sr", "origin_sr", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v), 4).alias("power"))

    register("wav_saved_and_loaded", loaded, f"WITH {V_ROWS}, q AS (SELECT sig, greatest(least(round_even(x / 4 * 32768, 0), 32767), -32768) / 32768 AS x FROM es) SELECT 8000 AS sr, 8000 AS origin_sr, count(*)::INT AS n, round(sum(x * x), 4) AS power FROM q GROUP BY sig")
    register("wav_normalised", lambda s, d: audio.load(s, saved(s, d), norm=True).select("norm", F.array_max(F.transform("samples", lambda v: F.abs(v))).alias("top")), "SELECT true AS norm, 1.0::DOUBLE AS top FROM embeddings")
    register("get_samplerate", lambda s, d: audio.samplerates(s, saved(s, d)).select("sr"), "SELECT 8000 AS sr FROM embeddings")


def _frames_and_spectra() -> None:
    base = "SELECT sig AS signal_id, frame::INT AS frame, j::INT AS j, round(x, 6) AS x FROM ef"
    register("movingwindow", lambda s, d: framing.frames(signals_e(s, d), SR, **framing.movingwindow(W)).df.select("signal_id", "frame", F.posexplode("x").alias("j", "x")).select("signal_id", "frame", "j", F.round("x", 6).alias("x")), f"WITH {frames_sql()} {base}")
    z = "(2 * n / 64.0::DOUBLE - 1)"
    bessel = lambda x: " + ".join(f"pow(({x}) / 2, {2 * k}) / {float(math.factorial(k)) ** 2!r}::DOUBLE" for k in range(1, 30))
    formulas = {
        "povey": "pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64), 0.85::DOUBLE)", "bohman": f"(1 - abs{z}) * cos(pi() * abs{z}) + sin(pi() * abs{z}) / pi()", "gauss": f"exp(-0.5::DOUBLE * pow(2.5::DOUBLE * {z}, 2))",
        "kaiser": f"(1 + {bessel(f'5 * sqrt(greatest(1 - pow({z}, 2), 0))')}) / (1 + {bessel('5')})", "point": "CASE WHEN n = 32 THEN 1 ELSE 0 END", "triangular": f"1 - abs{z}", "etsi": "1 - abs(n + 1 - 33) / 33.0::DOUBLE",
        "triang": "1 - abs(n + 1 - 33) / 33.0::DOUBLE", "cosine": "sin(pi() * (n + 0.5::DOUBLE) / 65)", "lanczos": f"CASE WHEN n = 32 THEN 1 ELSE sin(pi() * {z}) / (pi() * {z}) END", "bartlett_hann": "0.62::DOUBLE - 0.48::DOUBLE * abs(n / 64.0::DOUBLE - 0.5::DOUBLE) + 0.38::DOUBLE * cos(2 * pi() * (n / 64.0::DOUBLE - 0.5::DOUBLE))",
    }
    for name, sql in formulas.items():
        register(f"window_{name}", listed(lambda n=name: window(n, 64)), places_sql(f"SELECT n::INT AS i, round(({sql})::DOUBLE, 6) + 0.0::DOUBLE AS v FROM (SELECT unnest(range(64)) AS n)", 64))
    register("window_symmetric", listed(lambda: window("hamming", 33, periodic=False)), list_sql(33, "0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 32)"))

    def phases(spark, sf):  # the first and the last bin are real: their phase is 0 or pi by rounding
        rows = spectral.phase(spectral.stft_complex(frames_e(spark, sf))).select("signal_id", "frame", F.posexplode("phase").alias("bin", "v"))
        return rows.where("bin between 1 and 31").select("signal_id", "frame", "bin", F.round("v", 4).alias("value"))

    register("get_phase", phases, f"WITH {spec_sql()} {CELLS.format('bin', 'atan2(im, re)', 'spec')} WHERE bin BETWEEN 1 AND 31")

    def bins(spark, sf):
        m = spec_e(spark, sf).meta
        odd = m.child("mel_spec", [1.0, 2.5, 4.0, 8.0, 16.0, 31.0])
        cases = [(k, lo, hi, *s.bins(lo, hi)) for k, s in (("fft", m), ("bands", odd)) for lo, hi in ((0, 32), (3, 9), (4, 4), (30, 32), (5, 20))]
        numbered = [(i, *c) for i, c in enumerate(sorted(cases))]
        return at_places(spark, sf, spark.createDataFrame(numbered, "i int, grid string, low int, high int, first int, behind int"))

    grids = "g AS (SELECT 'fft' AS grid, i, i::DOUBLE AS f FROM (SELECT unnest(range(33)) AS i) UNION ALL SELECT 'bands', i, ([1.0, 2.5, 4.0, 8.0, 16.0, 31.0])[i + 1] FROM (SELECT unnest(range(6)) AS i)), r(low, high) AS (VALUES (0, 32), (3, 9), (4, 4), (30, 32), (5, 20))"
    register("bin_ranges", bins, places_sql(f"WITH {grids} SELECT (row_number() OVER (ORDER BY grid, low, high) - 1)::INT AS i, grid, low, high, coalesce(min(CASE WHEN f BETWEEN low AND high THEN i END), 0)::INT AS first, coalesce(max(CASE WHEN f BETWEEN low AND high THEN i + 1 END), 0)::INT AS behind FROM g, r GROUP BY grid, low, high", 10))
    register("mag_view", lambda s, d: values(descriptors.describe(spec_e(s, d, "magnitude"), ["centroid"]), "centroid"), f"WITH {spec_sql()} {PICK.format('sum(f * sqrt(v)) / sum(sqrt(v))')} FROM spec GROUP BY sig, frame")
    register("several_descriptors", lambda s, d: descriptors.describe(spec_e(s, d), ["energy", "max", "mean"]).select("signal_id", "frame", *[F.round(c, 4).alias(c) for c in ("energy", "max", "mean")]), f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, round(avg(v), 4) AS energy, round(max(v), 4) AS max, round(avg(v), 4) AS mean FROM spec GROUP BY sig, frame")
    register("stage_times", listed(lambda: framing.SpecMeta("frames", SR, W, H, offset=-32).times(20)), list_sql(20, f"(-32 + i * {H} + {W} / 2.0::DOUBLE) / {SR}"))
    register("stage_duration", listed(lambda: [framing.SpecMeta("frames", SR, W, H).duration(n) for n in range(1, 9)]), list_sql(8, f"(i * {H} + {W}) / {SR}.0::DOUBLE"))
    register("ms_to_samples", listed(lambda: [presets.ms(sr, m) for sr in (8000, 11025, 16000, 22050) for m in (10, 25, 30)]), places_sql("WITH c AS (SELECT row_number() OVER (ORDER BY sr, m) - 1 AS i, sr, m FROM (SELECT unnest([8000, 11025, 16000, 22050]) AS sr), (SELECT unnest([10, 25, 30]) AS m)) SELECT i::INT AS i, round(round_even(sr * m / 1000.0::DOUBLE, 0), 6) + 0.0 AS v FROM c", 12))


def _bands() -> None:
    norm = float(1 / window("hanning", W).sum() ** 2)
    tail = "bands AS (SELECT unnest(range({n})) AS band), b AS (SELECT f.sig, f.frame, c.band, coalesce(sum(fb.w * spec.v), 0) AS v FROM (SELECT DISTINCT sig, frame FROM spec) f CROSS JOIN bands c LEFT JOIN fb ON fb.band = c.band LEFT JOIN spec ON spec.sig = f.sig AND spec.frame = f.frame AND spec.bin = fb.bin GROUP BY f.sig, f.frame, c.band)"
    narrow = oracles.triangles("htk", 0, 32, 40, "none", gain=norm).replace("AS (SELECT band, bin, w *", "AS (SELECT band, bin, w / CASE WHEN sum(w) OVER (PARTITION BY band) = 0 THEN 1 ELSE sum(w) OVER (PARTITION BY band) END *")
    register("bands_without_bins", lambda s, d: cells(spectral.mel_spec(spec_e(s, d), nbands=40, norm="area")), f"WITH {spec_sql()}, {narrow}, {tail.format(n=40)} {CELLS.format('band', 'v', 'b')}")
    mel = filterbanks.auditory(SR, grid=filterbanks.fft_grid(SR, W), nbands=8)
    edge = "700 * (pow(10.0::DOUBLE, ({}) * 2595 * log10(1 + 32.0::DOUBLE / 700) / 9 / 2595) - 1)"
    register("fbank_centres", listed(lambda: mel.freq), list_sql(8, edge.format("i + 1")))
    register("fbank_bandwidths", listed(lambda: mel.bandwidth), list_sql(8, f"({edge.format('i + 2')}) - ({edge.format('i')})"))
    register("dct_orthonormal", listed(lambda: (filterbanks.dct_matrix(8) @ filterbanks.dct_matrix(8).T).ravel()), list_sql(64, "CASE WHEN i // 8 = i % 8 THEN 1 ELSE 0 END"))
    cep = lambda s, d, **o: spectral.mfcc(spectral.mel_spec(spec_e(s, d), nbands=8), 5, **o)
    low = f"{spectral.FLOATMIN!r}::DOUBLE"
    chain = lambda rect, floor=low, kind="ortho", n=8, coefs=5: f"{oracles.triangles('htk', 0, 32, n, gain=norm)}, {tail.format(n=n)}, {oracles.cosines(n, kind, coefs)}, cep AS (SELECT sig, frame, c, sum(w * {rect.format(f'greatest(v, {floor})')}) AS v FROM b JOIN dct USING (band) GROUP BY sig, frame, c)"
    plus = "SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round({}, 4) + 0.0 AS value FROM {}"
    zero = lambda df: df.withColumn("value", F.col("value") + 0.0)
    register("mfcc_callable_rectifier", lambda s, d: zero(cells(cep(s, d, rect=np.sqrt))), f"WITH {spec_sql()}, {chain('sqrt({})')} {plus.format('v', 'cep')}")
    energy = f"en AS (SELECT sig, frame, ln(greatest(sum(v), {catalog.EP!r}::DOUBLE)) AS e FROM b GROUP BY sig, frame)"
    register("mfcc_spectrum_energy", lambda s, d: zero(cells(cep(s, d, energy="spectrum", energy_mode="prepend"))), f"WITH {spec_sql()}, {chain('log10({})')}, {energy} {plus.format('v', '(SELECT sig, frame, c + 1 AS c, v FROM cep UNION ALL SELECT sig, frame, 0, e FROM en)')}")
    once = f"d1 AS (SELECT sig, frame, c, {oracles.lagged(5)} AS v FROM cep)"
    register("delta_delta", lambda s, d: zero(cells(spectral.delta_delta(cep(s, d), delta_length=5)[1])), f"WITH {spec_sql()}, {chain('log10({})')}, {once} {plus.format(oracles.lagged(5), 'd1')}")
    raw = f"en AS (SELECT sig, frame, ln(greatest(sum(x * x), {catalog.EP!r}::DOUBLE)) AS e FROM ef GROUP BY sig, frame), ce AS (SELECT sig, frame, c, CASE WHEN c = 0 THEN e ELSE v END AS v FROM cep JOIN en USING (sig, frame))"
    across = oracles.lagged(9, order="PARTITION BY sig, frame ORDER BY c")
    ORACLE_SQL["xxcc_standard"] = f"WITH {spec_sql()}, {chain('log10({})', '1e-8::DOUBLE', n=26, coefs=13)}, {raw} SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round({across}, 4) AS value FROM ce"


def _rhythm_and_pitch() -> None:
    db, env = ONSET.split("env AS", 1)
    near = f"{db}nb AS (SELECT sig, frame, bin, d, max(d) OVER (PARTITION BY sig, frame ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM db), env AS (SELECT a.sig, a.frame, CASE WHEN a.frame = 0 THEN 0.0::DOUBLE ELSE avg(greatest(a.d - b.top, 0)) END AS v FROM nb a LEFT JOIN nb b ON a.sig = b.sig AND a.frame = b.frame + 1 AND a.bin = b.bin GROUP BY a.sig, a.frame)"
    register("onset_running_max", lambda s, d: values(rhythm.onset_strength(spec_e(s, d), max_size=3).df), f"WITH {spec_sql()}, {near} {PICK.format('v')} FROM env")
    register("onset_aggregate_max", lambda s, d: values(rhythm.onset_strength(spec_e(s, d), aggregate="max").df), f"WITH {spec_sql()}, {db}env AS{env.replace('avg(greatest', 'max(greatest')} {PICK.format('v')} FROM env")
    register("onset_aggregate_callable", lambda s, d: values(rhythm.onset_strength(spec_e(s, d), aggregate=lambda v: (v > 3).sum(1).astype(float)).df), f"WITH {spec_sql()}, {db}env AS{env.replace('avg(greatest(a.d - b.d, 0))', 'count(*) FILTER (WHERE a.d - b.d > 3)::DOUBLE')} {PICK.format('v')} FROM env")
    register("onset_lag_2", lambda s, d: values(rhythm.onset_strength(spec_e(s, d), lag=2).df), f"WITH {spec_sql()}, {db}env AS{env.replace('WHEN a.frame = 0', 'WHEN a.frame < 2').replace('b.frame + 1', 'b.frame + 2')} {PICK.format('v')} FROM env")
    frames_v = lambda s, d: framing.frames(signals_v(s, d), SR, winsize=W, winstep=W, window="rect")
    register("pitch_callable", lambda s, d: values(wholes.pitch_frames(frames_v(s, d), lambda x, sr, bounds, threshold: sr * x[:, 0] + bounds[1] * x[:, -1], (2, 16))), f"WITH {V_ROWS} SELECT sig AS signal_id, 0 AS frame, round(64 * sum(CASE WHEN n = 0 THEN x END) + 16 * sum(CASE WHEN n = 63 THEN x END), 4) AS value FROM es GROUP BY sig")
    ranges = [(64, (2, 16), 64), (16000, (50, 400), 512), (8000, (60, 333), 256), (44100, (70, 500), 2048)]
    register("lag_ranges", lambda s, d: at_places(s, d, s.createDataFrame([(i, sr, lo, hi, n, *pitch.lag_range(sr, (lo, hi), n)) for i, (sr, (lo, hi), n) in enumerate(ranges)], "i int, sr int, low int, high int, n int, first int, last int")),
             places_sql(f"WITH {values_sql('r', 'i, sr, low, high, n', [(i, sr, lo, hi, n) for i, (sr, (lo, hi), n) in enumerate(ranges)])} SELECT i, sr, low, high, n, greatest(1, floor(sr / high::DOUBLE))::INT AS first, least(n - 1, ceil(sr / low::DOUBLE))::INT AS last FROM r", len(ranges)))


def _transforms() -> None:
    register("cwt_grid", listed(lambda: transforms.cwt_grid((2, 30), None, voices=4)), list_sql(math.floor(math.log2(15) * 4) + 1, "2 * pow(2.0::DOUBLE, i / 4.0::DOUBLE)"))
    register("wavelet_centres", listed(lambda: [transforms.centre_of(w)[1] for w in ("morlet", "morse", "bump", "dog", "ricker")]), list_sql(5, "([6.0, pow(20 / 3.0::DOUBLE, 1 / 3.0::DOUBLE), 5.0, sqrt(2.5::DOUBLE), 4.0])[i + 1]"))
    register("wavelet_centre_of_callable", listed(lambda: [transforms.centre_of(lambda v: np.exp(-((v - 3.25) ** 2)))[1]]), places_sql("SELECT 0 AS i, 3.25::DOUBLE AS v", 1))
    db2 = "([1 + sqrt(3.0::DOUBLE), 3 + sqrt(3.0::DOUBLE), 3 - sqrt(3.0::DOUBLE), 1 - sqrt(3.0::DOUBLE)])[i + 1] / (4 * sqrt(2.0::DOUBLE))"
    register("wavelet_filter_db2", listed(lambda: np.sort(discrete.wavelet_filters("db2")[0])), places_sql(f"SELECT (row_number() OVER (ORDER BY v) - 1)::INT AS i, round(v, 6) + 0.0 AS v FROM (SELECT {db2} AS v FROM (SELECT unnest(range(4)) AS i))", 4))
    names = ["haar", "db2", "db5", "db10", "sym4", "sym8", "coif1"]
    register("wavelet_filter_sums", listed(lambda: [discrete.wavelet_filters(n)[0].sum() for n in names]), list_sql(len(names), "sqrt(2.0::DOUBLE)"))
    register("wavelet_filter_norms", listed(lambda: [(discrete.wavelet_filters(n)[0] ** 2).sum() for n in names]), list_sql(len(names), "1"))


    def crossings(spark, sf):
        w = Window.partitionBy("signal_id").orderBy("n")
        rows = table(spark, sf, "events").select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("n"), (F.col("value") / 100 - 0.5).alias("x"))
        return rows.withColumn("before", F.lag("x").over(w)).where("(x < 0) <> (before < 0)").groupBy("signal_id").agg(F.count("*").alias("crossings"))

    register("crossings_of_rows", crossings, "SELECT signal_id, count(*) AS crossings FROM (SELECT event_type AS signal_id, (value / 100 - 0.5 < 0) <> (lag(value / 100 - 0.5) OVER (PARTITION BY event_type ORDER BY event_id) < 0) AS c FROM events) WHERE c GROUP BY signal_id")


for part in (_sources, _frames_and_spectra, _bands, _rhythm_and_pitch, _transforms):
    part()

__all__ = ["ORACLE_SQL", "QUERIES"]
