"""The registered queries over the driver's tables, and their SQL.

Signals: E (events of each type, value / 100 in order of event_id), U (events of each user), V (one 64-sample embedding for
each signal), O (orders as one long signal). Frames are 64 / 32 and periodic Hann unless a query says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles
from .functions import discrete, dsp, filterbanks, models, scales, transforms, units
from .functions.windows import WINDOWS, window
from .meta import SpecMeta, Stage
from .operators import descriptors, framing, rhythm, spectral, wholes
from .operators.arrays import per_signal
from .plans import presets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SR, W, H = 64, 64, 32


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signals_e(spark: SparkSession, sf: str) -> DataFrame:
    return framing.signals_from(table(spark, sf, "events").select("event_type", "event_id", (F.col("value") / 100).alias("x")), "event_type", "event_id", "x", SR)


def signals_u(spark: SparkSession, sf: str) -> DataFrame:
    return framing.signals_from(table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 100).alias("x")), "user_id", "event_id", "x", SR)


def signals_o(spark: SparkSession, sf: str) -> DataFrame:
    return framing.signals_from(table(spark, sf, "orders").select(F.lit("orders").alias("k"), "o_orderkey", (F.col("o_totalprice") / 100000).alias("x")), "k", "o_orderkey", "x", SR)


def signals_v(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("signal_id"), F.lit(SR).alias("sr"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


def frames_e(spark: SparkSession, sf: str, **options) -> Stage:
    return framing.frames(signals_e(spark, sf), SR, **({"winsize": W, "winstep": H} | options))


def spec_e(spark: SparkSession, sf: str, spectrum: str = "power", **options) -> Stage:
    return spectral.spectrogram(signals_e(spark, sf), SR, **({"winsize": W, "winstep": H} | options), spectrum=spectrum)


def spec_v(spark: SparkSession, sf: str, spectrum: str = "power") -> Stage:
    return spectral.stft(framing.frames(signals_v(spark, sf), SR, winsize=W, winstep=W, window="rect"), spectrum=spectrum)


def listed(f: Callable, place: str, name: str = "v", digits: int = 4) -> Callable[[SparkSession, str], DataFrame]:
    """Orders, each with the number that ``f()`` has at the order's place: its key modulo the length."""

    def q(spark: SparkSession, sf: str) -> DataFrame:
        numbers = np.asarray(f(), float)
        rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % len(numbers)).cast("bigint").alias(place))
        known = spark.createDataFrame(list(enumerate(numbers.tolist())), f"{place} bigint, {name} double")
        return rows.join(F.broadcast(known), place).select("id", place, (F.round(name, digits) + 0.0).alias(name))

    return q


def at_orders(sql: str, place: str, n: int) -> str:
    return f"SELECT o_orderkey AS id, q.* FROM orders JOIN ({sql}) q ON q.{place} = o_orderkey % {n}"


def values(df: DataFrame, name: str = "value", digits: int = 4) -> DataFrame:
    return df.select("signal_id", "frame", F.round(F.col(name), digits).alias("value"))


def cells(stage: Stage, digits: int = 4, column: str = "spec") -> DataFrame:
    rows = stage.df.select("signal_id", "frame", F.posexplode(column).alias("bin", "v"))
    return rows.select("signal_id", "frame", "bin", F.round("v", digits).alias("value"))


# ---- SQL that several oracles share ----

E_ROWS = "es AS (SELECT event_type AS sig, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, value / 100 AS x FROM events)"
U_ROWS = "es AS (SELECT user_id::VARCHAR AS sig, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, value / 100 AS x FROM events)"
V_ROWS = "es AS (SELECT vec_id::VARCHAR AS sig, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def frames_sql(rows: str = E_ROWS, w: int = W, h: int = H) -> str:
    """Common tables up to ef(sig, frame, j, x)."""
    return f"""{rows}, el AS (SELECT sig, max(n) + 1 AS len FROM es GROUP BY sig HAVING max(n) + 1 >= {w}),
        ef AS (SELECT sig, frame, (n - frame * {h})::INT AS j, x FROM (
            SELECT sig, n, x, len, unnest(range(greatest(0, -((({w} - 1) - n) // {h}) + CASE WHEN n > {w} - 1 AND (n - {w} + 1) % {h} > 0 THEN 1 ELSE 0 END), least(n // {h}, (len - {w}) // {h}) + 1)) AS frame FROM es JOIN el USING (sig))
            WHERE n - frame * {h} BETWEEN 0 AND {w} - 1)"""


def spec_sql(rows: str = E_ROWS, w: int = W, h: int = H, win: str = "hanning") -> str:
    """Common tables up to spec(sig, frame, bin, f, v) of power, with coefficients re and im."""
    taper = {"hanning": f"(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {w}))", "rect": "1::DOUBLE"}[win]
    return f"""{frames_sql(rows, w, h)},
        basis AS (SELECT k AS bin, j, {taper} * cos(2 * pi() * ((k * j) % {w}) / {w}) AS c, -{taper} * sin(2 * pi() * ((k * j) % {w}) / {w}) AS s FROM (SELECT unnest(range({w // 2 + 1})) AS k), (SELECT unnest(range({w})) AS j)),
        spec AS (SELECT sig, frame, bin, bin * {SR / w}::DOUBLE AS f, re * re + im * im AS v, re, im FROM (
            SELECT sig, frame, bin, sum(x * c) AS re, sum(x * s) AS im FROM ef JOIN basis USING (j) GROUP BY sig, frame, bin))"""


ONSET = """db AS (SELECT sig, frame, bin, greatest(d, max(d) OVER (PARTITION BY sig) - 80) AS d FROM (SELECT *, 10 * log10(greatest(v, 1e-10)) AS d FROM spec)),
        env AS (SELECT a.sig, a.frame, CASE WHEN a.frame = 0 THEN 0.0::DOUBLE ELSE avg(greatest(a.d - b.d, 0)) END AS v FROM db a LEFT JOIN db b ON a.sig = b.sig AND a.frame = b.frame + 1 AND a.bin = b.bin GROUP BY a.sig, a.frame)"""


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(f'{float(v)!r}::DOUBLE' if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)})"


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries named {name}")
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


PICK = "SELECT sig AS signal_id, frame::INT AS frame, round({}, 4) AS value"
EP = 2.220446049250313e-16


# ---- framing ----


def _framing() -> None:
    base = "SELECT sig AS signal_id, frame::INT AS frame, j::INT AS j, round(x, 6) AS x FROM ef"

    def long(digits: int = 6, **options):
        def q(spark, sf):
            df = frames_e(spark, sf, **options).df
            return df.select("signal_id", "frame", F.posexplode("x").alias("j", "x")).select("signal_id", "frame", "j", F.round("x", digits).alias("x"))

        return q

    register("frames_basic", long(), f"WITH {frames_sql()} {base}")
    sizes = "(SELECT sig, max(n) + 1 AS len FROM es GROUP BY sig)"
    source = {
        "constant": "CASE WHEN p < 0 OR p >= len THEN NULL ELSE p END",
        "reflect": "CASE WHEN p < 0 THEN -p WHEN p >= len THEN 2 * (len - 1) - p ELSE p END",
        "edge": "CASE WHEN p < 0 THEN 0 WHEN p >= len THEN len - 1 ELSE p END",
    }
    for mode, pick in source.items():
        padded = f"raw AS (SELECT event_type AS sig, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, value / 100 AS x FROM events), es AS (SELECT q.sig, q.n, coalesce(raw.x, 0) AS x FROM (SELECT sig, p + {W // 2} AS n, {pick} AS src FROM (SELECT sig, len, unnest(range(-{W // 2}, len + {W // 2})) AS p FROM (SELECT sig, max(n) + 1 AS len FROM raw GROUP BY sig))) q LEFT JOIN raw ON raw.sig = q.sig AND raw.n = q.src)"
        register(f"frames_center_{mode}", long(center=True, pad_mode=mode), f"WITH {frames_sql(padded)} {base}")
    tail = f"raw AS (SELECT event_type AS sig, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, value / 100 AS x FROM events), es AS (SELECT q.sig, q.n, coalesce(raw.x, 0) AS x FROM (SELECT sig, unnest(range(CASE WHEN len <= {W} THEN {W} ELSE ((len - {W} + {H} - 1) // {H}) * {H} + {W} END)) AS n FROM (SELECT sig, max(n) + 1 AS len FROM raw GROUP BY sig)) q LEFT JOIN raw USING (sig, n))"
    register("frames_pad_end", long(pad_end=True), f"WITH {frames_sql(tail)} {base}")
    register("frames_dc_preemph", long(12, dc_removal=True, preemph=0.97), f"""WITH {frames_sql()}, dc AS (SELECT sig, frame, j, x - avg(x) OVER (PARTITION BY sig, frame) AS x FROM ef)
        SELECT sig AS signal_id, frame::INT AS frame, j::INT AS j, round(x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY sig, frame ORDER BY j), x), 12) AS x FROM dc""")
    register("frame_energy", lambda s, d: values(frames_e(s, d, dc_removal=True).df, "energy"), f"WITH {frames_sql()} {PICK.format('sum(x * x) - count(*) * avg(x) * avg(x)')} FROM ef GROUP BY sig, frame")
    register("frame_times", lambda s, d: frames_e(s, d, center=True).df.select("signal_id", "frame", F.round("t", 6).alias("t")), f"WITH {E_ROWS} SELECT sig AS signal_id, frame::INT AS frame, round((-{W // 2} + frame * {H} + {W / 2}::DOUBLE) / {SR}, 6) AS t FROM (SELECT sig, unnest(range(((len + {W} - {W}) // {H}) + 1)) AS frame FROM {sizes})")
    register("frames_windowed", lambda s, d: framing.winframes(frames_e(s, d)).select("signal_id", "frame", F.posexplode("x").alias("j", "x")).select("signal_id", "frame", "j", F.round("x", 6).alias("x")), f"WITH {frames_sql()} SELECT sig AS signal_id, frame::INT AS frame, j::INT AS j, round(x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {W})), 6) AS x FROM ef")

    def frames_in_rows(spark, sf):
        w = Window.partitionBy("signal_id")
        rows = table(spark, sf, "events").withColumn("signal_id", F.col("event_type")).select("signal_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("bigint").alias("n"), (F.col("value") / 100).alias("x"))
        rows = rows.withColumn("last_frame", F.floor((F.count("*").over(w) - W) / H).cast("bigint"))
        long_rows = framing.frame_long(rows, W, H)
        return long_rows.groupBy("signal_id", "frame").agg(F.round(F.sum("x"), 4).alias("value")).select("signal_id", F.col("frame").cast("int").alias("frame"), "value")

    register("frames_long", frames_in_rows, f"WITH {frames_sql()} {PICK.format('sum(x)')} FROM ef GROUP BY sig, frame")

    def pre(spark, sf):
        rows = table(spark, sf, "events").select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("n"), (F.col("value") / 100).alias("x"))
        return framing.preemphasis_rows(rows).select("signal_id", "n", F.round("y", 6).alias("y"))

    register("preemphasis", pre, "SELECT event_type AS signal_id, event_id AS n, round(x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY event_type ORDER BY event_id), x), 6) AS y FROM (SELECT event_type, event_id, value / 100 AS x FROM events)")

    def rows_of(f):
        def q(spark, sf):
            got = wholes.map_signal(signals_u(spark, sf), f)
            return got.select("signal_id", F.posexplode("samples").alias("n", "x")).select("signal_id", "n", F.round("x", 4).alias("x"))

        return q

    recur = "WITH RECURSIVE {rows}, y AS (SELECT sig, n, {first} AS y, x AS xp FROM es WHERE n = 0 UNION ALL SELECT es.sig, es.n, {step} AS y, es.x AS xp FROM y JOIN es ON es.sig = y.sig AND es.n = y.n + 1) SELECT sig AS signal_id, n::INT AS n, round(y, 4) AS x FROM y"
    register("deemphasis", rows_of(dsp.deemphasis), recur.format(rows=U_ROWS, first="x", step="es.x + 0.97::DOUBLE * y.y"))
    register("offset_compensation", rows_of(dsp.offset_compensation), recur.format(rows=U_ROWS, first="x", step="es.x - y.xp + 0.999::DOUBLE * y.y"))
    register("normalize_peak", rows_of(dsp.normalize_peak), f"WITH {U_ROWS} SELECT sig AS signal_id, n::INT AS n, round(x / max(abs(x)) OVER (PARTITION BY sig), 4) AS x FROM es")
    formulas = {"rect": "1.0::DOUBLE", "hanning": "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64)", "hamming": "0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * n / 64)", "blackman": "0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64) + 0.08::DOUBLE * cos(4 * pi() * n / 64)", "bartlett": "1 - abs(2 * n / 64.0::DOUBLE - 1)", "gauss": "exp(-0.5::DOUBLE * pow(2.5::DOUBLE * (n - 32) / 32, 2))", "bohman": "(1 - abs(2 * n / 64.0::DOUBLE - 1)) * cos(pi() * abs(2 * n / 64.0::DOUBLE - 1)) + sin(pi() * abs(2 * n / 64.0::DOUBLE - 1)) / pi()", "povey": "pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 64), 0.85::DOUBLE)"}

    def windowed(spark, sf):
        w = spark.createDataFrame([(k, window(k, 64).tolist()) for k in WINDOWS if k in formulas], "name string, w array<double>")
        made = signals_v(spark, sf).join(F.broadcast(w)).select("signal_id", "name", F.posexplode(F.zip_with("samples", "w", lambda a, b: a * b)).alias("n", "x"))  # each embedding under each window
        return made.select("signal_id", "name", "n", (F.round("x", 6) + 0.0).alias("x"))

    register("windows", windowed, f"WITH {V_ROWS} " + " UNION ALL ".join(f"SELECT sig AS signal_id, '{k}' AS name, n::INT AS n, round(x * ({v}), 6) + 0.0 AS x FROM es" for k, v in formulas.items()))


# ---- Fourier ----


def _fourier() -> None:
    pick = "SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round({}, 4) AS value FROM spec"
    register("stft_power", lambda s, d: cells(spec_e(s, d)), f"WITH {spec_sql()} {pick.format('v')}")
    register("stft_of_frames", lambda s, d: cells(spectral.stft(frames_e(s, d))), f"WITH {spec_sql()} {pick.format('v')}")

    def of_rows(spark, sf):
        w = Window.partitionBy("event_type").orderBy("event_id")
        rows = table(spark, sf, "events").select(F.col("event_type").alias("signal_id"), (F.row_number().over(w) - 1).alias("n"), (F.col("value") / 100).alias("x"))
        return cells(spectral.stft(framing.frames_of_rows(rows, SR, W, H)))

    register("stft_of_rows", of_rows, f"WITH {spec_sql()} {pick.format('v')}")
    register("stft_magnitude", lambda s, d: cells(spec_v(s, d, "magnitude")), f"WITH {spec_sql(V_ROWS, W, W, 'rect')} {pick.format('sqrt(v)')}")

    def coefficients(spark, sf):
        c = spectral.stft_complex(frames_e(spark, sf))
        rows = c.df.select("signal_id", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
        return rows.select("signal_id", "frame", "bin", (F.round("c.re", 4) + 0.0).alias("re"), (F.round("c.im", 4) + 0.0).alias("im"))

    register("stft_complex", coefficients, f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM spec")
    register("lin_spec", lambda s, d: cells(spectral.lin_spec(spec_e(s, d), (4, 30), True)), f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, (bin - 4)::INT AS bin, round(2 * v / {float(window('hanning', W).sum() ** 2)!r}::DOUBLE, 4) AS value FROM spec WHERE bin BETWEEN 4 AND 30")
    back = f"""WITH {frames_sql()}, w AS (SELECT j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {W}) AS w FROM (SELECT unnest(range({W})) AS j)),
        o AS (SELECT sig, frame * {H} + j AS n, {{num}} AS num, {{den}} AS den FROM ef JOIN w USING (j))
        SELECT sig AS signal_id, n::BIGINT AS n, round(CASE WHEN sum(den) >= 1e-6 THEN sum(num) / sum(den) ELSE sum(num) END, 4) + 0.0 AS x FROM o GROUP BY sig, n"""
    for method, num, den in (("wola", "x * w * w", "w * w"), ("ola", "x * w", "w")):
        register(f"istft_{method}", lambda s, d, m=method: spectral.istft(spectral.stft_complex(frames_e(s, d)), m).select("signal_id", F.col("n").cast("bigint").alias("n"), (F.round("x", 4) + 0.0).alias("x")), back.format(num=num, den=den))


# ---- bands ----


def _bands() -> None:
    grid = filterbanks.fft_grid(SR, W)
    norm = float(1 / window("hanning", W).sum() ** 2)

    # designs made in SQL, where there is one; styles and chroma take the weights themselves
    tri = lambda *a, gain=norm, **o: oracles.triangles(*a, gain=gain, **o)
    designs = {
        "mel_spec": tri("htk", 0, 32, 8), "mel_spec_slaney": tri("slaney", 0, 32, 8, "area"), "bark_spec": tri("bark", 2, 32, 6, "none"), "erb_spec": oracles.gammatones(0, 32, 8, norm),
        "spec_linspace": tri("linspace", 4, 28, 6), "spec_erb_scale": tri("erb", 0, 32, 6), "spec_octave": tri("octave", 8, 32, 10, step=6), "spec_logspace": tri("logspace", 4, 24, 6), "mel_spec_warped": tri("htk", 0, 32, 8, "none", True),
        "etsi_spec": oracles.bin_triangles(2, 32, 6, "etsi"), "psf_spec": oracles.bin_triangles(0, 32, 6, "psf"),
    }

    def bank_sql(bank, scale: float = 1.0, name: str = "") -> str:
        fb = designs.get(name) or values_sql("fb", "band, bin, w", [(b, k, w * scale) for b, k, w in wholes.bank_rows(bank)])
        return f"WITH {spec_sql()}, {fb}, bands AS (SELECT unnest(range({bank.nbands})) AS band), got AS (SELECT sig, frame, band, sum(w * v) AS v FROM spec JOIN fb USING (bin) GROUP BY sig, frame, band), fr AS (SELECT DISTINCT sig, frame FROM spec), b AS (SELECT sig, frame, band, coalesce(v, 0) AS v FROM fr CROSS JOIN bands LEFT JOIN got USING (sig, frame, band))"

    out = " SELECT sig AS signal_id, frame::INT AS frame, band::INT AS bin, round(v, 4) AS value FROM b"
    banks = {
        "mel_spec": (spectral.mel_spec, {"nbands": 8}, filterbanks.auditory(SR, grid=grid, nbands=8)),
        "mel_spec_slaney": (spectral.mel_spec, {"nbands": 8, "scale": "slaney", "norm": "area"}, filterbanks.auditory(SR, grid=grid, nbands=8, scale="slaney", norm="area")),
        "bark_spec": (spectral.bark_spec, {"nbands": 6, "norm": "none", "freqrange": (2, 32)}, filterbanks.auditory(SR, grid=grid, nbands=6, scale="bark", norm="none", freqrange=(2, 32))),
        "erb_spec": (spectral.erb_spec, {"nbands": 8}, filterbanks.gammatone(SR, grid=grid, nbands=8)),
        "spec_linspace": (spectral.mel_spec, {"nbands": 6, "scale": "linspace", "freqrange": (4, 28)}, filterbanks.auditory(SR, grid=grid, nbands=6, scale="linspace", freqrange=(4, 28))),
        "spec_erb_scale": (spectral.mel_spec, {"nbands": 6, "scale": "erb"}, filterbanks.auditory(SR, grid=grid, nbands=6, scale="erb")),
        "spec_octave": (spectral.mel_spec, {"nbands": 10, "scale": "octave", "freqrange": (8, 32), "bins_per_octave": 6}, filterbanks.auditory(SR, grid=grid, nbands=10, scale="octave", freqrange=(8, 32), bins_per_octave=6)),
        "spec_logspace": (spectral.mel_spec, {"nbands": 6, "scale": "logspace", "freqrange": (4, 24)}, filterbanks.auditory(SR, grid=grid, nbands=6, scale="logspace", freqrange=(4, 24))),
        "mel_spec_warped": (spectral.mel_spec, {"nbands": 8, "domain": "warped", "norm": "none"}, filterbanks.auditory(SR, grid=grid, nbands=8, domain="warped", norm="none")),
    }
    for style in filterbanks.STYLES[1:]:
        banks[f"spec_style_{style}"] = (spectral.mel_spec, {"nbands": 6, "style": style}, filterbanks.auditory(SR, grid=grid, nbands=6, style=style))
    for name, (make, options, bank) in banks.items():
        register(name, lambda s, d, make=make, options=options: cells(make(spec_e(s, d), **options)), bank_sql(bank, norm, name) + out)
    for name, bank in (("etsi_spec", filterbanks.etsi(SR, W, 6, (2, 32))), ("psf_spec", filterbanks.psf(SR, W, 6))):
        register(name, lambda s, d, bank=bank: cells(spectral.band_spec(spec_e(s, d), bank)), bank_sql(bank, name=name) + out)
    joined = filterbanks.auditory(SR, grid=grid, nbands=8)
    register("mel_spec_join", lambda s, d: spectral.band_spec_join(spec_e(s, d), joined).select("signal_id", "frame", F.col("band").alias("bin"), F.round("value", 4).alias("value")), f"WITH {spec_sql()}, {values_sql('fb', 'band, bin, w', wholes.bank_rows(joined))} SELECT sig AS signal_id, frame::INT AS frame, band::INT AS bin, round(sum(w * v), 4) AS value FROM spec JOIN fb USING (bin) GROUP BY sig, frame, band")
    chroma = filterbanks.chroma(SR, grid)
    register("chroma", lambda s, d: cells(spectral.chroma(spec_e(s, d))), bank_sql(chroma) + " SELECT sig AS signal_id, frame::INT AS frame, band::INT AS bin, round(v / max(abs(v)) OVER (PARTITION BY sig, frame), 4) AS value FROM b")
    basis = values_sql("tn", "row, band, w", [(i, k, float(v)) for i, r in enumerate(filterbanks.tonnetz_basis()) for k, v in enumerate(r)])
    register("tonnetz", lambda s, d: cells(spectral.tonnetz(spectral.chroma(spec_e(s, d)))), bank_sql(chroma) + f", {basis}, n AS (SELECT sig, frame, band, v / sum(abs(v)) OVER (PARTITION BY sig, frame) AS v FROM b) SELECT sig AS signal_id, frame::INT AS frame, row::INT AS bin, round(sum(w * v), 4) + 0.0 AS value FROM n JOIN tn USING (band) GROUP BY sig, frame, row")
    QUERIES["tonnetz"] = lambda s, d: cells(spectral.tonnetz(spectral.chroma(spec_e(s, d)))).withColumn("value", F.col("value") + 0.0)
    register("poly_features", lambda s, d: cells(spectral.poly_features(spec_e(s, d))), f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, unnest([0, 1])::INT AS bin, round(unnest([regr_slope(v, f), regr_intercept(v, f)]), 4) AS value FROM spec GROUP BY sig, frame")

    # cepstra on eight mel bands
    mel = banks["mel_spec"][2]
    low = spectral.FLOATMIN

    dct_sql = lambda kind, n, first=0, lifter=0: oracles.cosines(8, kind, n, first, lifter)

    def cepstrum_sql(rect: str, floor: float = low, kind: str = "ortho", n: int = 5, first: int = 0, lifter: int = 0, clip: str = "r") -> str:
        return bank_sql(mel, norm, "mel_spec") + f", r0 AS (SELECT sig, frame, band, {rect.format(f'greatest(v, {floor!r}::DOUBLE)')} AS r FROM b), r AS (SELECT sig, frame, band, {clip} AS r FROM r0), {dct_sql(kind, n, first, lifter)}, cep AS (SELECT sig, frame, c, sum(w * r) AS v FROM r JOIN dct USING (band) GROUP BY sig, frame, c)"

    out = " SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round(v, 4) + 0.0 AS value FROM cep"

    def cep(**options):
        return lambda s, d: cells(spectral.mfcc(spectral.mel_spec(spec_e(s, d), nbands=8), 5, **options)).withColumn("value", F.col("value") + 0.0)

    register("mfcc", cep(), cepstrum_sql("log10({})") + out)
    register("mfcc_nlog_htk", cep(rect="nlog", dct="htk"), cepstrum_sql("ln({})", kind="htk") + out)
    register("mfcc_cubic_plain", cep(rect="cubic_root", dct="plain"), cepstrum_sql("pow({}, 1.0::DOUBLE / 3)", kind="plain") + out)
    register("mfcc_db_floor", cep(rect="db", floor=1e-3), cepstrum_sql("10 * log10({})", 1e-3) + out)
    register("mfcc_top_db", cep(rect="db", floor=1e-10, top_db=12), cepstrum_sql("10 * log10({})", 1e-10, clip="greatest(r, max(r) OVER (PARTITION BY sig) - 12)") + out)
    register("mfcc_lifter", cep(lifter=22, first=1), cepstrum_sql("log10({})", first=1, lifter=22) + out)
    energy = f"en AS (SELECT sig, frame, ln(greatest(sum(x * x), {EP!r}::DOUBLE)) AS e FROM ef GROUP BY sig, frame)"
    register("mfcc_energy_replace", cep(energy="raw"), cepstrum_sql("log10({})") + f", {energy} SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round(CASE WHEN c = 0 THEN e ELSE v END, 4) + 0.0 AS value FROM cep JOIN en USING (sig, frame)")
    register("mfcc_energy_append", cep(energy="raw", energy_mode="append"), cepstrum_sql("log10({})") + f", {energy} SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round(v, 4) + 0.0 AS value FROM cep UNION ALL SELECT sig, frame::INT, 5, round(e, 4) + 0.0 FROM en")
    gt = banks["erb_spec"][2]
    register("gtcc", lambda s, d: cells(spectral.gtcc(spectral.erb_spec(spec_e(s, d), nbands=8), ncoeffs=5)).withColumn("value", F.col("value") + 0.0), bank_sql(gt, norm, "erb_spec") + f", r AS (SELECT sig, frame, band, log10(greatest(v, {low!r}::DOUBLE)) AS r FROM b), {dct_sql('ortho', 5)}, cep AS (SELECT sig, frame, c, sum(w * r) AS v FROM r JOIN dct USING (band) GROUP BY sig, frame, c)" + out)
    lagged = oracles.lagged(5)
    register("delta", lambda s, d: cells(spectral.delta(spectral.mfcc(spectral.mel_spec(spec_e(s, d), nbands=8), 5), 5)).withColumn("value", F.col("value") + 0.0), cepstrum_sql("log10({})") + f" SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round({lagged}, 4) + 0.0 AS value FROM cep")
    across = lagged.replace("PARTITION BY sig, c ORDER BY frame", "PARTITION BY sig, frame ORDER BY c")
    register("delta_transposed", lambda s, d: cells(spectral.delta(spectral.mfcc(spectral.mel_spec(spec_e(s, d), nbands=8), 5), 5, "transposed")).withColumn("value", F.col("value") + 0.0), cepstrum_sql("log10({})") + f" SELECT sig AS signal_id, frame::INT AS frame, c::INT AS bin, round({across}, 4) + 0.0 AS value FROM cep")


# ---- descriptors ----


def _descriptors() -> None:
    z = f"z AS (SELECT sig, frame, bin, f, v, sum(f * v) OVER p / sum(v) OVER p AS c, sum(v) OVER p AS tot, 33 AS nb FROM spec WINDOW p AS (PARTITION BY sig, frame))"
    h = "(-sum(CASE WHEN v > 0 THEN (v / tot) * log2(v / tot) ELSE 0 END))"
    local = {
        "centroid": "any_value(c)", "spread": "sqrt(sum(pow(f - c, 2) * v) / any_value(tot))",
        "skewness": "(sum(pow(f - c, 3) * v) / any_value(tot)) / pow(sum(pow(f - c, 2) * v) / any_value(tot), 1.5::DOUBLE)",
        "kurtosis": "(sum(pow(f - c, 4) * v) / any_value(tot)) / pow(sum(pow(f - c, 2) * v) / any_value(tot), 2)",
        "crest": "max(v) / avg(v)",
        "decrease": "(sum(CASE WHEN bin > 0 THEN v / bin END) - arg_min(v, bin) * sum(CASE WHEN bin > 0 THEN 1.0::DOUBLE / bin END)) / sum(CASE WHEN bin > 0 THEN v END)",
        "entropy": f"{h} / log2(33.0::DOUBLE)", "flatness": f"exp(avg(ln(v + {EP!r}::DOUBLE))) / avg(v)", "slope": "regr_slope(v, f)",
        "bandwidth": "sqrt(sum(v / tot * pow(abs(f - c), 2)))", "energy": "avg(v)", "rms": "sqrt(2 * sum(v * CASE WHEN bin = 0 THEN 0.5::DOUBLE ELSE 1 END) / (33 * 33))",
        "hfc": "sum(bin * v)", "eef": f"sqrt(1 + abs(avg(v) * {h}))", "eer": f"sqrt(1 + abs(ln(1 + avg(v)) / {h}))", "max": "max(v)", "peak": "arg_max(f, (v, -bin))", "mean": "avg(v)", "var": "var_samp(v)",
    }
    for name, sql in local.items():
        register(f"spectral_{name}", lambda s, d, n=name: values(descriptors.describe(spec_e(s, d), [n]), n), f"WITH {spec_sql()}, {z} {PICK.format(sql)} FROM z GROUP BY sig, frame")
    register("spectral_rolloff", lambda s, d: values(descriptors.describe(spec_e(s, d), ["rolloff"]), "rolloff"), f"WITH {spec_sql()}, q AS (SELECT sig, frame, f, sum(v) OVER (PARTITION BY sig, frame ORDER BY bin) AS run, sum(v) OVER (PARTITION BY sig, frame) AS tot FROM spec) {PICK.format('min(f)')} FROM q WHERE run >= 0.95::DOUBLE * tot GROUP BY sig, frame")
    pairs = "d AS (SELECT a.sig, a.frame, a.bin, a.v, b.v AS u FROM spec a LEFT JOIN spec b ON a.sig = b.sig AND a.frame = b.frame + 1 AND a.bin = b.bin)"
    change = {
        "flux": ({}, "sqrt(sum(pow(v - u, 2)))"), "flux_positive_l1": ({"p": 1, "positive": True}, "sum(greatest(v - u, 0))"), "flux_mean": ({"mean": True, "root": False}, "avg(pow(v - u, 2))"),
        "sd": ({}, "sum(abs(v - u))"), "sf": ({}, "sum(pow(v - u, 2))"), "mkl": ({"mean": True}, "avg(ln(1 + v / (u + 1e-16)))"), "broadband": ({"threshold": 3}, "count(*) FILTER (WHERE 10 * log10(v / u) > 3)::DOUBLE"),
        "novelty_sub": ({}, "sum(CASE WHEN v - u > 0 THEN v - u ELSE 0 END)"),
        "novelty_entropy": ({"method": "entropy"}, "sum(greatest(ln(v / (u + 1e-16) + 1e-16), 0))"),
        "novelty_kl": ({"method": "kl"}, "sum(greatest(v * ln(v / (u + 1e-16) + 1e-16), 0))"),
        "novelty_is": ({"method": "is", "data": "number", "threshold": 1}, "count(*) FILTER (WHERE v / (u + 1e-16) - ln(v / (u + 1e-16) + 1e-16) - 1 > 1)::DOUBLE"),
    }
    for name, (options, sql) in change.items():
        kind = name.split("_")[0]
        register(f"spectral_{name}", lambda s, d, k=kind, o=options: values(descriptors.describe_change(spec_e(s, d), k, **o)), f"WITH {spec_sql()}, {pairs} {PICK.format(f'CASE WHEN count(u) = 0 THEN 0.0::DOUBLE ELSE {sql} END')} FROM d GROUP BY sig, frame")
    three = "p AS (SELECT sig, frame, bin, sqrt(v) AS m, atan2(im, re) AS a, lag(sqrt(v)) OVER w AS m1, lag(atan2(im, re)) OVER w AS a1, lag(atan2(im, re), 2) OVER w AS a2, row_number() OVER w AS nth FROM spec WHERE bin BETWEEN 1 AND 31 WINDOW w AS (PARTITION BY sig, bin ORDER BY frame))"
    phase_sql = {
        "wpd": "CASE WHEN any_value(nth) <= 2 THEN 0.0::DOUBLE ELSE avg(m * abs(a - 2 * a1 + a2)) END",
        "nwpd": "CASE WHEN any_value(nth) <= 2 THEN 0.0::DOUBLE ELSE avg(m * abs(a - 2 * a1 + a2)) / avg(m) END",
        "pd": "CASE WHEN any_value(nth) <= 2 THEN 0.0::DOUBLE ELSE avg(abs(a - 2 * a1 + a2)) END",
        "cd": "CASE WHEN any_value(nth) = 1 THEN 0.0::DOUBLE WHEN any_value(nth) = 2 THEN sum(m) ELSE sum(sqrt(pow(m * cos(a) - m1 * cos(2 * a1 - a2), 2) + pow(m * sin(a) - m1 * sin(2 * a1 - a2), 2))) END",
        "rcd": "CASE WHEN any_value(nth) = 1 THEN 0.0::DOUBLE WHEN any_value(nth) = 2 THEN sum(CASE WHEN m > m1 THEN m ELSE 0 END) ELSE sum(CASE WHEN m > m1 THEN sqrt(pow(m * cos(a) - m1 * cos(2 * a1 - a2), 2) + pow(m * sin(a) - m1 * sin(2 * a1 - a2), 2)) ELSE 0 END) END",
    }

    def inner(stage: Stage) -> Stage:  # the first and last bin are real: their phase is 0 or pi by rounding
        cut = lambda c: F.slice(c, 2, W // 2 - 1)
        return Stage(stage.df.withColumn("re", cut("re")).withColumn("im", cut("im")), stage.meta.child("stft", stage.meta.freq[1:-1]), "re")

    for name, sql in phase_sql.items():
        register(f"spectral_{name}", lambda s, d, n=name: values(descriptors.describe_phase(inner(spectral.stft_complex(frames_e(s, d))), n)), f"WITH {spec_sql()}, {three} {PICK.format(sql)} FROM p GROUP BY sig, frame")
    register("spectral_centroid_long", lambda s, d: values(descriptors.centroid_long(descriptors.long_view(spec_v(s, d))), "centroid"), f"WITH {spec_sql(V_ROWS, W, W, 'rect')} {PICK.format('sum(f * v) / sum(v)')} FROM spec GROUP BY sig, frame")
    register("spectral_slope_long", lambda s, d: values(descriptors.slope_long(descriptors.long_view(spec_v(s, d))), "slope"), f"WITH {spec_sql(V_ROWS, W, W, 'rect')} {PICK.format('regr_slope(v, f)')} FROM spec GROUP BY sig, frame")

    # time features
    fr = f"WITH {frames_sql()}, w AS (SELECT j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {W}) AS w FROM (SELECT unnest(range({W})) AS j)), c AS (SELECT sig, frame, j, x - 0.5::DOUBLE AS x, (x - 0.5::DOUBLE) * w AS y FROM ef JOIN w USING (j)), s AS (SELECT *, CASE WHEN abs(x) <= 1e-10 THEN 0 ELSE x END AS a, CASE WHEN abs(y) <= 1e-10 THEN 0 ELSE y END AS b FROM c), l AS (SELECT *, lag(a) OVER q AS pa, lag(b) OVER q AS pb FROM s WINDOW q AS (PARTITION BY sig, frame ORDER BY j))"

    def timed(f):
        def q(spark, sf):
            stage = frames_e(spark, sf)
            moved = Stage(stage.df.withColumn("x", F.transform("x", lambda v: v - 0.5)), stage.meta, "x")
            return moved.df.select("signal_id", "frame", F.round(f(moved), 4).alias("value"))

        return q

    crossing, strict = "count(*) FILTER (WHERE (a < 0) <> (pa < 0))", "count(*) FILTER (WHERE b * pb < 0)"
    for name, f, sql in (
        ("rms", descriptors.rms, "sqrt(avg(x * x))"), ("rms_windowed", lambda s: descriptors.rms(s, True), "sqrt(avg(y * y))"), ("energy", descriptors.energy, "sum(y * y)"), ("zcr", descriptors.zcr, f"{crossing} / {float(W)}::DOUBLE"),
        ("zcr_strict", lambda s: descriptors.zcr(s, rate=False, windowed=True, strict=True), f"{strict}::DOUBLE"), ("ezr", descriptors.ezr, f"log10(1 + sum(y * y)) / ({strict} + 1)"),
    ):
        register(name, timed(f), f"{fr} {PICK.format(sql)} FROM l GROUP BY sig, frame")
    register("rms_spec", lambda s, d: (st := spec_e(s, d)).df.select("signal_id", "frame", F.round(descriptors.rms_spec(st), 4).alias("value")), f"WITH {spec_sql()} {PICK.format('sqrt(sum(CASE WHEN bin IN (0, 32) THEN v ELSE 2 * v END)) / 64')} FROM spec GROUP BY sig, frame")
    register("zero_crossings", lambda s, d: signals_v(s, d).select("signal_id", F.posexplode(descriptors.zero_crossings(F.col("samples"))).alias("n", "crossed")), f"WITH {V_ROWS} SELECT sig AS signal_id, n::INT AS n, coalesce((x < 0) <> (lag(x) OVER (PARTITION BY sig ORDER BY n) < 0), false) AS crossed FROM (SELECT sig, n, CASE WHEN abs(x) <= 1e-10 THEN 0 ELSE x END AS x FROM es)")

    def lags(f):
        def q(spark, sf):
            got = wholes.map_signal(signals_v(spark, sf), f)
            return got.select("signal_id", F.posexplode("samples").alias("k", "v")).select("signal_id", "k", (F.round("v", 4) + 0.0).alias("v"))

        return q

    register("autocorrelate", lags(dsp.autocorrelate), f"WITH {V_ROWS} SELECT a.sig AS signal_id, (b.n - a.n)::INT AS k, round(sum(a.x * b.x), 4) + 0.0 AS v FROM es a JOIN es b ON a.sig = b.sig AND b.n >= a.n GROUP BY ALL")
    register("xcorr", lags(lambda x: dsp.xcorr(x, normalize=True)), f"WITH {V_ROWS}, p AS (SELECT sig, sum(x * x) AS p FROM es GROUP BY sig) SELECT a.sig AS signal_id, (b.n - a.n + 63)::INT AS k, round(sum(a.x * b.x) / any_value(p), 4) + 0.0 AS v FROM es a JOIN es b ON a.sig = b.sig JOIN p ON p.sig = a.sig GROUP BY a.sig, b.n - a.n")
    taps = [0.5, -0.25, 0.125]
    tap_sql = values_sql("h", "i, h", [(i, v) for i, v in enumerate(taps)])
    for mode, lo, hi in (("full", 0, 65), ("same", 1, 64), ("valid", 2, 63)):
        register(f"convolve_{mode}", lags(lambda x, m=mode: dsp.convolve(x, np.array(taps), m)), f"WITH {V_ROWS}, {tap_sql} SELECT sig AS signal_id, (n + i - {lo})::INT AS k, round(sum(x * h), 4) + 0.0 AS v FROM es CROSS JOIN h WHERE n + i BETWEEN {lo} AND {hi} GROUP BY sig, n + i")
    register("harmonic_ratio", lambda s, d: values(wholes.harmonic_ratio(framing.frames(signals_v(s, d), SR, winsize=W, winstep=W, window="rect"), (2, 16))), f"""WITH {V_ROWS}, r AS (SELECT a.sig, b.n - a.n AS k, sum(a.x * b.x) AS r, sum(b.x * b.x) AS tail FROM es a JOIN es b ON a.sig = b.sig AND b.n >= a.n WHERE b.n - a.n BETWEEN 4 AND 32 OR b.n = a.n GROUP BY a.sig, b.n - a.n)
        SELECT sig AS signal_id, 0 AS frame, round(greatest(max(CASE WHEN k > 0 THEN r / sqrt(e * tail) END), 0), 4) AS value FROM r JOIN (SELECT sig, r AS e FROM r WHERE k = 0) USING (sig) GROUP BY sig""")
    register("pitch_ncf", lambda s, d: values(wholes.pitch_frames(framing.frames(signals_v(s, d), SR, winsize=W, winstep=W, window="rect"), "ncf", (2, 16))), f"""WITH {V_ROWS}, r AS (SELECT a.sig, b.n - a.n AS k, sum(a.x * b.x) AS r, sum(b.x * b.x) AS tail FROM es a JOIN es b ON a.sig = b.sig AND b.n >= a.n WHERE b.n - a.n <= 32 GROUP BY a.sig, b.n - a.n),
        q AS (SELECT sig, k, r, r / sqrt(e * tail) AS q, lag(r) OVER w AS below, lead(r) OVER w AS above FROM r JOIN (SELECT sig, r AS e FROM r WHERE k = 0) USING (sig) WINDOW w AS (PARTITION BY sig ORDER BY k)),
        best AS (SELECT sig, arg_max(k, (q, -k)) AS k FROM q WHERE k >= 4 GROUP BY sig)
        SELECT sig AS signal_id, 0 AS frame, round(CASE WHEN q < 0 THEN 0 ELSE 64 / (CASE WHEN above IS NULL OR below - 2 * r + above = 0 THEN k ELSE k + (below - above) / (2 * (below - 2 * r + above)) END) END, 4) AS value FROM q JOIN best USING (sig, k)""")


# ---- decibels, scaling, units ----


def _units() -> None:
    price = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_totalprice") / 1e6 - 0.25).alias("y"))
    src = "(SELECT o_orderkey AS id, o_totalprice / 1000 AS x, o_totalprice / 1e6::DOUBLE - 0.25::DOUBLE AS y FROM orders)"

    def both(name: str, column, sql: str, digits: int = 4, cast: str = "") -> None:
        def q(spark, sf):
            v = column(F.col("x"))
            return price(spark, sf).select("id", (v if cast else F.round(v, digits)).alias("v"))

        register(name, q, f"SELECT id, {sql if cast else f'round({sql}, {digits})'} AS v FROM {src}")

    slaney = "CASE WHEN x < 1000 THEN x / (200.0::DOUBLE / 3) ELSE 15 + ln(x / 1000) / (ln(6.4::DOUBLE) / 27) END"
    both("hz_to_mel", lambda x: units.hz_to_mel(x * 10) * math.pi, "pi() * " + slaney.replace("CASE", "(CASE").replace("END", "END)").replace("x", "(x * 10)"))
    both("hz_to_mel_htk", lambda x: units.hz_to_mel(x, True), "2595 * log10(1 + x / 700)")
    both("mel_to_hz", lambda x: units.mel_to_hz(x / 20), "CASE WHEN x / 20 < 15 THEN x / 20 * (200.0::DOUBLE / 3) ELSE 1000 * exp((ln(6.4::DOUBLE) / 27) * (x / 20 - 15)) END")
    both("mel_to_hz_htk", lambda x: units.mel_to_hz(x, True), "700 * (pow(10.0::DOUBLE, x / 2595) - 1)")
    both("hz_to_midi", units.hz_to_midi, "12 * (log2(x) - log2(440.0::DOUBLE)) + 69")
    both("midi_to_hz", lambda x: units.midi_to_hz(x / 5), "440 * pow(2.0::DOUBLE, (x / 5 - 69) / 12)")
    names = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
    both("midi_to_note", lambda x: units.midi_to_note(x / 5), f"{names}[(round_even(x / 5, 0)::INT % 12) + 1] || (round_even(x / 5, 0)::INT // 12 - 1)::VARCHAR", cast="string")
    both("hz_to_note", units.hz_to_note, f"{names}[((round_even(12 * (log2(x) - log2(440.0::DOUBLE)) + 69, 0)::INT % 12) + 12) % 12 + 1] || (trunc(round_even(12 * (log2(x) - log2(440.0::DOUBLE)) + 69, 0) / 12)::INT - 1)::VARCHAR", cast="string")

    def notes(spark, sf):
        return price(spark, sf).select("id", units.note_to_midi(units.midi_to_note(F.col("x") / 5)).cast("bigint").alias("v"))

    register("note_to_midi", notes, f"SELECT id, round_even(x / 5, 0)::BIGINT AS v FROM {src}")
    register("note_to_hz", lambda s, d: price(s, d).select("id", F.round(units.note_to_hz(units.midi_to_note(F.col("x") / 5)), 4).alias("v")), f"SELECT id, round(440 * pow(2.0::DOUBLE, (round_even(x / 5, 0) - 69) / 12), 4) AS v FROM {src}")
    both("hz_to_octs", units.hz_to_octs, "log2(x / 27.5::DOUBLE)")
    both("power_to_db", lambda x: units.power_to_db(x, amin=100.0), "10 * log10(greatest(x, 100)) - 10 * log10(100.0::DOUBLE)")
    both("amplitude_to_db", units.amplitude_to_db, "10 * log10(greatest(x * x, 1e-10)) - 10 * log10(1.0::DOUBLE)")
    both("db_to_power", lambda x: units.db_to_power(x / 20, 2.0), "2 * pow(10.0::DOUBLE, x / 20 / 10)")
    both("db_to_amplitude", lambda x: units.db_to_amplitude(x / 20), "pow(10.0::DOUBLE, x / 20 / 20)")

    def top_db(spark, sf):
        w = Window.partitionBy("signal_id")
        rows = table(spark, sf, "events").select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("n"), F.col("value").alias("x"))
        db = rows.withColumn("d", units.power_to_db("x", F.max("x").over(w)))
        return db.select("signal_id", "n", F.round(units.clip_db(F.col("d"), w, 20, -15), 4).alias("v"))

    register("power_to_db_top", top_db, "SELECT event_type AS signal_id, event_id AS n, round(greatest(d, max(d) OVER (PARTITION BY event_type) - 20, -15), 4) AS v FROM (SELECT *, 10 * log10(greatest(value, 1e-10)) - 10 * log10(max(value) OVER (PARTITION BY event_type)) AS d FROM events)")
    sq = "(x * x)"
    weight = {
        "A": f"20 * log10(pow(12194.0::DOUBLE, 2) * {sq} * {sq} / (({sq} + pow(20.6::DOUBLE, 2)) * sqrt(({sq} + pow(107.7::DOUBLE, 2)) * ({sq} + pow(737.9::DOUBLE, 2))) * ({sq} + pow(12194.0::DOUBLE, 2)))) + 2",
        "B": f"0.17::DOUBLE + 20 * (log10(pow(12194.0::DOUBLE, 2)) + 1.5::DOUBLE * log10({sq}) - log10({sq} + pow(12194.0::DOUBLE, 2)) - log10({sq} + pow(20.6::DOUBLE, 2)) - 0.5::DOUBLE * log10({sq} + pow(158.5::DOUBLE, 2)))",
        "C": f"20 * log10(pow(12194.0::DOUBLE, 2) * {sq} / (({sq} + pow(20.6::DOUBLE, 2)) * ({sq} + pow(12194.0::DOUBLE, 2)))) + 0.06::DOUBLE",
        "D": f"20 * (0.5::DOUBLE * log10({sq}) - log10(pow(8.3046305e-3::DOUBLE, 2)) + 0.5::DOUBLE * (log10(pow(pow(1018.7::DOUBLE, 2) - {sq}, 2) + pow(1039.6::DOUBLE, 2) * {sq}) - log10(pow(pow(3136.5::DOUBLE, 2) - {sq}, 2) + pow(3424.0::DOUBLE, 2) * {sq}) - log10(pow(282.7::DOUBLE, 2) + {sq}) - log10(pow(1160.0::DOUBLE, 2) + {sq})))",
    }
    for k, sql in weight.items():
        both(f"weighting_{k.lower()}", units.WEIGHTINGS[k], f"greatest({sql}, -80)")
    both("perceptual_weighting", lambda x: units.perceptual_weighting(x, x), f"10 * log10(greatest(x, 1e-10)) + greatest({weight['A']}, -80)")
    register("mu_compress", lambda s, d: price(s, d).select("id", units.mu_compress(F.col("y")).cast("bigint").alias("v")), f"SELECT id, (floor((sign(y) * ln(1 + 255 * abs(y)) / ln(256.0::DOUBLE) + 1) / 2 * 255 + 0.5::DOUBLE) - 128)::BIGINT AS v FROM {src}")
    register("mu_expand", lambda s, d: price(s, d).select("id", F.round(units.mu_expand(F.col("y"), quantize=False), 4).alias("v")), f"SELECT id, round(sign(y) * (pow(256.0::DOUBLE, abs(y)) - 1) / 255, 4) AS v FROM {src}")

    rows = "(SELECT event_type AS signal_id, event_id AS n, value / 100 AS x FROM events)"
    q4 = lambda k: f"(CASE WHEN ((c + 1) * {k}) % 4 = 0 THEN s[greatest((c + 1) * {k} // 4, 1)] ELSE (s[greatest((c + 1) * {k} // 4, 1)] + s[least((c + 1) * {k} // 4 + 1, c)]) / 2 END)"
    scale = {
        "minmax": "(x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p)", "standard": "(x - avg(x) OVER p) / stddev_pop(x) OVER p", "maxabs": "x / max(abs(x)) OVER p", "center": "x - avg(x) OVER p",
        "mean": "(x - avg(x) OVER p) / (max(x) OVER p - min(x) OVER p)", "arctan": "atan(x) / (pi() / 2)",
    }

    def scaled(f):
        def q(spark, sf):
            r = table(spark, sf, "events").select(F.col("event_type").alias("signal_id"), F.col("event_id").alias("n"), (F.col("value") / 100).alias("x"))
            return r.select("signal_id", "n", (F.round(f(F.col("x"), Window.partitionBy("signal_id")), 4) + 0.0).alias("v"))

        return q

    for m, sql in scale.items():
        register(f"feature_scale_{m}", scaled(lambda x, w, m=m: units.feature_scale(x, w, m)), f"SELECT signal_id, n, round({sql}, 4) + 0.0 AS v FROM {rows} WINDOW p AS (PARTITION BY signal_id)")

    def robust(spark, sf):  # quartiles by one sorted array for each signal, then a join
        r = table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("n"), (F.col("value") / 100).alias("x"))
        s = r.groupBy("signal_id").agg(F.array_sort(F.collect_list("x")).alias("s")).select("signal_id", *[units.quartile(F.col("s"), k).alias(f"q{k}") for k in (1, 2, 3)])
        v = F.when(F.col("q3") > F.col("q1"), (F.col("x") - F.col("q2")) / F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1"))).otherwise(0.0)
        return r.join(s, "signal_id").select("signal_id", "n", (F.round(v, 4) + 0.0).alias("v"))

    register("feature_scale_robust", robust, f"WITH r AS (SELECT user_id AS signal_id, event_id AS n, value / 100 AS x FROM events), o AS (SELECT signal_id, list_sort(list(x)) AS s, count(*) AS c FROM r GROUP BY 1), q AS (SELECT signal_id, {q4(1)} AS q1, {q4(2)} AS q2, {q4(3)} AS q3 FROM o) SELECT signal_id, n, round(CASE WHEN q3 > q1 THEN (x - q2) / (q3 - q1) ELSE 0 END, 4) + 0.0 AS v FROM r JOIN q USING (signal_id)")
    register("normalize_signal", scaled(units.normalize_signal), f"SELECT signal_id, n, round(x / max(abs(x)) OVER (PARTITION BY signal_id), 4) + 0.0 AS v FROM {rows}")
    register("normalize_signal_l2", scaled(lambda x, w: units.normalize_signal(x * 100, w, 2) * 100), f"SELECT signal_id, n, round(x * 100 / sqrt(sum(x * x * 10000) OVER (PARTITION BY signal_id)) * 100, 4) + 0.0 AS v FROM {rows}")
    register("temporal_db", lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("signal_id")).agg(*units.temporal_db(F.col("value") / 500)).select("signal_id", *[F.round(c, 4).alias(c) for c in ("max_db", "mean_db", "below")]), "SELECT event_type AS signal_id, round(max(v), 4) AS max_db, round(avg(v), 4) AS mean_db, round(avg((v <= -18)::INT::DOUBLE), 4) AS below FROM (SELECT event_type, greatest(20 * log10(abs(value / 500) + 1e-8), -36) AS v FROM events) GROUP BY 1")

    ids = "(SELECT o_orderkey AS i FROM orders)"
    grid = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("i"))
    conv = {
        "frames_to_samples": (lambda: units.frames_to_samples("i", 160, 7).cast("bigint"), "(i - 1) * 160 + 8"),
        "samples_to_frames": (lambda: units.samples_to_frames("i", 160, -80).cast("bigint"), "floor((i - 1 + 80) / 160.0::DOUBLE)::BIGINT + 1"),
        "frames_to_time": (lambda: F.round(units.frames_to_time("i", 160, 16000), 6), "round((i - 1) * 160 / 16000.0::DOUBLE, 6)"),
        "time_to_frames": (lambda: units.time_to_frames(F.col("i") / 100, 160, 16000).cast("bigint"), "i + 1"),
        "samples_to_time": (lambda: F.round(units.samples_to_time("i", 16000), 7), "round((i - 1) / 16000.0::DOUBLE, 7)"),
        "time_to_samples": (lambda: units.time_to_samples(F.col("i") / 100, 16000).cast("bigint"), "i * 160 + 1"),
    }
    for name, (column, sql) in conv.items():
        register(name, lambda s, d, c=column: grid(s, d).select("i", c().alias("v")), f"SELECT i, {sql} AS v FROM {ids}")
    for name, freq, sql in (
        ("fft_frequencies", units.fft_frequencies(16000, 512), "i * 31.25::DOUBLE FROM (SELECT unnest(range(257)) AS i)"),
        ("mel_frequencies", units.mel_frequencies(40, 0, 8000, True), "700 * (pow(10.0::DOUBLE, i * (2595 * log10(1 + 8000.0::DOUBLE / 700)) / 39 / 2595) - 1) FROM (SELECT unnest(range(40)) AS i)"),
        ("cqt_frequencies", transforms.cqt_frequencies(84), "32.703::DOUBLE * pow(2.0::DOUBLE, i / 12.0::DOUBLE) FROM (SELECT unnest(range(84)) AS i)"),
        ("tempo_frequencies", rhythm.tempo_frequencies(200, 512, 22050)[1:], "60 * 22050.0::DOUBLE / (512 * (i + 1)) FROM (SELECT unnest(range(199)) AS i)"),
        ("erb_edges", scales.band_edges("erb", 0, 8000, 20), "(pow(10.0::DOUBLE, i * 21.3654::DOUBLE * log10(1 + 8000 * 0.004368::DOUBLE) / 21 / 21.3654::DOUBLE) - 1) / 0.004368::DOUBLE FROM (SELECT unnest(range(22)) AS i)"),
    ):
        body, tail = sql.split(" FROM ", 1)
        register(name, listed(lambda f=freq: f, "i"), at_orders(f"SELECT i, round({body}, 4) AS v FROM {tail}", "i", len(freq)))

    generated = lambda f: listed(f, "n", "x")
    register("tone", generated(lambda: dsp.tone(220, 8000, 0.1)), at_orders("SELECT n, round(cos(2 * pi() * 220.0::DOUBLE * n / 8000 - pi() / 2), 4) + 0.0 AS x FROM (SELECT unnest(range(800)) AS n)", "n", 800))
    register("chirp", generated(lambda: dsp.chirp(100, 1000, 8000, 0.1)), at_orders("SELECT n, round(cos(2 * pi() * 100 * 0.1::DOUBLE / ln(10.0::DOUBLE) * (pow(10.0::DOUBLE, n / 8000.0::DOUBLE / 0.1::DOUBLE) - 1) - pi() / 2), 4) + 0.0 AS x FROM (SELECT unnest(range(800)) AS n)", "n", 800))
    register("clicks", generated(lambda: dsp.clicks([0.1, 0.3], 8000, click_duration=0.01, length=4000)), at_orders("SELECT n, round(coalesce((SELECT sum(sin(2 * pi() * 1000.0::DOUBLE * (n - s) / 8000) * exp(-10.0::DOUBLE * (n - s) / 80)) FROM (VALUES (800), (2400)) t(s) WHERE n - s BETWEEN 0 AND 79), 0), 4) + 0.0 AS x FROM (SELECT unnest(range(4000)) AS n)", "n", 4000))
    register("synth_f0", generated(lambda: dsp.synth_f0([0, 0.05], [200, 300], 8000)), at_orders("SELECT n, round(sin(2 * pi() * (CASE WHEN n <= 400 THEN n * 200.0::DOUBLE ELSE 400 * 200.0::DOUBLE + (n - 400) * 300.0::DOUBLE END) / 8000), 4) + 0.0 AS x FROM (SELECT unnest(range(800)) AS n)", "n", 800))


# ---- rhythm and separation ----


def _rhythm() -> None:
    onset = ONSET
    register("onset_strength", lambda s, d: values(rhythm.onset_strength(spec_e(s, d)).df), f"WITH {spec_sql()}, {onset} {PICK.format('v')} FROM env")
    register("novelty", lambda s, d: values(rhythm.novelty(spec_e(s, d), "sf")), f"WITH {spec_sql()}, q AS (SELECT a.sig, a.frame, coalesce(sum(pow(a.v - b.v, 2)), 0) AS v FROM spec a LEFT JOIN spec b ON a.sig = b.sig AND a.frame = b.frame + 1 AND a.bin = b.bin GROUP BY a.sig, a.frame) {PICK.format('(v - min(v) OVER (PARTITION BY sig)) / (max(v) OVER (PARTITION BY sig) - min(v) OVER (PARTITION BY sig))')} FROM q")
    register("peak_pick", lambda s, d: values(rhythm.peak_pick(rhythm.onset_strength(spec_e(s, d)).df, 3, 4, 5, 6, 0.2, 0)), f"WITH {spec_sql()}, {onset}, p AS (SELECT *, max(v) OVER (PARTITION BY sig ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top, avg(v) OVER (PARTITION BY sig ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mean FROM env) {PICK.format('v')} FROM p WHERE v = top AND v >= mean + 0.2::DOUBLE")
    register("onset_detect", lambda s, d: rhythm.onset_detect(rhythm.onset_strength(spec_e(s, d)), pre_max=2, post_max=2, pre_avg=4, post_avg=5, wait=2).select("signal_id", "frame", F.round("t", 4).alias("t")))
    register("tempogram", lambda s, d: cells(rhythm.tempogram(rhythm.onset_strength(spec_e(s, d)), 16)))
    register("tempo", lambda s, d: rhythm.tempo(rhythm.onset_strength(spec_e(s, d))))

    def beats(spark, sf):
        """A click every half a second, whose beats are known, from a different sample on for each supplier."""
        sources = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("signal_id"), F.array((F.col("s_suppkey") % 97).cast("double")).alias("samples"))
        sources = sources.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "signal_id")  # a small file makes long signals
        train = lambda x, row: [(8000, dsp.clicks(np.arange(0.5, 8, 0.5) + x[0] / 8000, 8000, length=8 * 8000))]
        clicks = per_signal(sources, {"sr": wholes.T.IntegerType(), "samples": wholes.ARRAY}, train)
        return rhythm.beat_track_signals(clicks, 8000, winsize=512, winstep=256)

    register("beat_track", beats)
    soft = lambda a, b: f"CASE WHEN greatest({a}, {b}) <= 0 THEN 0.5::DOUBLE ELSE pow({a} / greatest({a}, {b}), 2) / (pow({a} / greatest({a}, {b}), 2) + pow({b} / greatest({a}, {b}), 2)) END"
    med = "m AS (SELECT sig, frame, bin, v, quantile_cont(sqrt(v), 0.5) OVER (PARTITION BY sig, bin ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS h, quantile_cont(sqrt(v), 0.5) OVER (PARTITION BY sig, frame ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS p FROM spec)"
    register("hpss_masks", lambda s, d: rhythm.hpss_long(descriptors.long_view(spec_e(s, d)), (15, 9), magnitude=False).select("signal_id", "frame", "bin", F.round("mask_h", 4).alias("mask_h"), F.round("mask_p", 4).alias("mask_p")), f"WITH {spec_sql()}, {med} SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round({soft('h', 'p')}, 4) AS mask_h, round({soft('p', 'h')}, 4) AS mask_p FROM m")

    def parts(spark, sf):
        both = rhythm.hpss_parts(spec_e(spark, sf), kernel=(15, 9))
        rows = both.select("signal_id", "frame", F.posexplode(F.arrays_zip("harmonic", "percussive")).alias("bin", "v"))
        return rows.select("signal_id", "frame", "bin", F.round("v.harmonic", 4).alias("harmonic"), F.round("v.percussive", 4).alias("percussive"))

    register("hpss_components", parts, f"WITH {spec_sql()}, {med} SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round(v * {soft('h', 'p')}, 4) AS harmonic, round(v * {soft('p', 'h')}, 4) AS percussive FROM m")
    t = 0.4 * SR / H
    b = (math.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    register("pcen", lambda s, d: cells(rhythm.pcen(spec_e(s, d))), f"WITH RECURSIVE {spec_sql()}, m AS (SELECT sig, bin, frame, v, v AS m FROM spec WHERE frame = 0 UNION ALL SELECT s.sig, s.bin, s.frame, s.v, (1 - {b!r}::DOUBLE) * m.m + {b!r}::DOUBLE * s.v FROM m JOIN spec s ON s.sig = m.sig AND s.bin = m.bin AND s.frame = m.frame + 1) SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round(sqrt(v / pow(1e-6 + m, 0.98::DOUBLE) + 2) - sqrt(2.0::DOUBLE), 4) AS value FROM m")
    register("to_db", lambda s, d: cells(spectral.to_db(spec_e(s, d), top_db=30)), f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round(greatest(10 * log10(greatest(v, 1e-10)) - 10 * log10(max(v) OVER (PARTITION BY sig)), -30), 4) AS value FROM spec")

    def separated(spark, sf):
        got = rhythm.hpss_signals(signals_u(spark, sf), 16, 8, kernel=(5, 5))
        rows = got.select("signal_id", F.posexplode(F.arrays_zip("harmonic", "percussive")).alias("n", "v"))
        return rows.select("signal_id", "n", *[(F.round(f"v.{c}", 4) + 0.0).alias(c) for c in ("harmonic", "percussive")])

    register("hpss_signals", separated)
    register("spectral_gate", lambda s, d: cells(rhythm.spectral_gate(spec_e(s, d), -20, release=1)), f"WITH {spec_sql()} SELECT sig AS signal_id, frame::INT AS frame, bin::INT AS bin, round(CASE WHEN 10 * log10(greatest(v, 1e-10)) - 10 * log10(max(v) OVER (PARTITION BY sig)) >= -20 THEN v ELSE 0 END, 4) AS value FROM spec")

    def signal_rows(f):
        def q(spark, sf):
            got = wholes.map_signal(signals_u(spark, sf), f)
            return got.select("signal_id", F.posexplode("samples").alias("n", "x")).select("signal_id", "n", (F.round("x", 4) + 0.0).alias("x"))

        return q

    register("noisegate", signal_rows(lambda x: dsp.noisegate(x, SR, -6)))
    runs = lambda f: lambda s, d: per_signal(signals_e(s, d), {"first": wholes.T.LongType(), "last": wholes.T.LongType()}, f)
    register("split_silence", runs(lambda x, row: dsp.split_silence(x, 6, 64, 16)))
    register("trim_silence", runs(lambda x, row: [dsp.trim_silence(x, 3, 64, 16)]))


# ---- whole signals, pitch, models ----


def _wholes() -> None:
    opts = {"winsize": 128, "winstep": 64}
    fronts = {
        "cqt": lambda x: wholes.cqt(x, SR, fmin=2.0, nbins=24, bins_per_octave=6, **opts),
        "cwt": lambda x: wholes.cwt(x, SR, voices=4, freqrange=(2, 30), **opts),
        "synsq": lambda x: wholes.synsq(x, SR, voices=4, freqrange=(2, 30), **opts),
        "wsst": lambda x: wholes.wsst(x, SR, scale=None, voices=4, freqrange=(2, 30), **opts),
        "pwt": lambda x: wholes.pwt(x, SR, nbands=12, freqrange=(4, 30), bins_per_octave=6, **opts),
        "nsgt": lambda x: wholes.nsgt(x, SR, nbands=12, freqrange=(4, 30), bins_per_octave=6, **opts),
        "st": lambda x: wholes.st(x, SR, **opts),
        "fst": lambda x: wholes.fst(x, SR, **opts),
        "dwt": lambda x: wholes.discrete_wavelet(x, SR, "dwt", level=4, **opts),
        "wpt": lambda x: wholes.discrete_wavelet(x, SR, "wpt", level=3, **opts),
        "swt": lambda x: wholes.discrete_wavelet(x, SR, "swt", level=3, **opts),
        "wvd": lambda x: wholes.cohen(x, SR, "wvd", **opts),
        "cwd": lambda x: wholes.cohen(x, SR, "cwd", **opts),
        "hht": lambda x: wholes.hht(x, SR, nbins=33, **opts),
        "ewt": lambda x: wholes.ewt(x, SR, 4, **opts),
    }
    for name, f in fronts.items():
        register(f"front_{name}", lambda s, d, f=f: cells(f(signals_e(s, d))))
    fold = filterbanks.cqt_chroma(transforms.cqt_frequencies(24, 2.0, 12), 12)
    register("cqt_chroma", lambda s, d: cells(spectral.chroma(wholes.cqt(signals_e(s, d), SR, fmin=2.0, nbins=24, bins_per_octave=12, **opts), bank=fold)))
    register("reassign_targets", lambda s, d: wholes.reassign(frames_e(s, d), targets=True))
    register("cwt_centroid", lambda s, d: values(descriptors.describe(fronts["cwt"](signals_e(s, d)), ["centroid"]), "centroid"))
    register("emd", lambda s, d: wholes.imfs(signals_u(s, d)))
    register("nsgt_cells", lambda s, d: wholes.nsgt_cells(signals_u(s, d), SR, nbands=6, freqrange=(4, 30), bins_per_octave=6))
    register("reassign", lambda s, d: wholes.reassign(frames_e(s, d)).select("signal_id", "frame", "bin", F.round("value", 4).alias("value")))
    long_frames = lambda s, d: framing.frames(signals_v(s, d), SR, winsize=W, winstep=W, window="rect")
    for m in ("yin", "cep", "hps", "lhs", "stft"):
        register(f"pitch_{m}", lambda s, d, m=m: values(wholes.pitch_frames(long_frames(s, d), m, (4, 16))))
    register("pitch_pef", lambda s, d: values(wholes.pitch_frames(framing.frames(signals_v(s, d), 640, winsize=W, winstep=W, window="rect"), "pef", (40, 160))))
    register("harmonic_ratio_tracked", lambda s, d: values(wholes.harmonic_ratio_tracked(frames_e(s, d), 2)))
    register("harmonic_count", lambda s, d: wholes.harmonic_count(spec_v(s, d), (2, 30)).select("signal_id", "frame", "value"))
    register("cepstrogram", lambda s, d: cells(spectral.cepstrogram(frames_e(s, d)), column="envelope"))
    register("deconv", lambda s, d: cells(spectral.deconv(spec_e(s, d)), column="timbre"))
    register("spectral_contrast", lambda s, d: cells(spectral.spectral_contrast(spec_e(s, d), 3, 4, 0.2)))
    register("xxcc_standard", lambda s, d: cells(presets.xxcc_standard(spectral.mel_spec(spec_e(s, d), nbands=26, freqrange=(0, 32)), 13)[1]))
    for name in ("matlab", "htk", "kaldi", "librosa", "etsi", "psf"):
        options = {"librosa": {"nfft": 512, "nbands": 20, "ncoeffs": 10}}.get(name, {})
        register(f"mfcc_{name}", lambda s, d, n=name, o=options: cells(getattr(presets, f"mfcc_{n}")(signals_o(s, d), 8000, **o), 3))

    def haar(kind: str, level: int):
        f = {"dwt": lambda x: discrete.dwt(x, "haar", level)[0], "wpt": lambda x: discrete.wpt(x, "haar", level)[0], "swt": lambda x: discrete.swt(x, "haar", level)[1][0]}[kind]

        def q(spark, sf):
            got = wholes.map_signal(signals_v(spark, sf), f)
            return got.select("signal_id", F.posexplode("samples").alias("k", "v")).select("signal_id", "k", (F.round("v", 4) + 0.0).alias("v"))

        return q

    pair = "SELECT sig, n // 2 AS n, sum(x) / sqrt(2.0::DOUBLE) AS a, sum(CASE WHEN n % 2 = 0 THEN x ELSE -x END) / sqrt(2.0::DOUBLE) AS d FROM {} GROUP BY sig, n // 2"
    first = f"WITH {V_ROWS}, l1 AS ({pair.format('es')}), b1 AS (SELECT sig, n, a AS x FROM l1), l2 AS ({pair.format('b1')}), b2 AS (SELECT sig, n, a AS x FROM l2), l3 AS ({pair.format('b2')})"
    out = " SELECT sig AS signal_id, k::INT AS k, round(v, 4) + 0.0 AS v FROM ({})"
    for level in (1, 2, 3):
        parts = [f"SELECT sig, n AS k, a AS v FROM l{level}"] + [f"SELECT sig, n + {64 >> j} AS k, d AS v FROM l{j}" for j in range(level, 0, -1)]
        register(f"dwt_haar_{level}", haar("dwt", level), first + out.format(" UNION ALL ".join(parts)))
    register("swt_haar", haar("swt", 1), f"WITH {V_ROWS} SELECT a.sig AS signal_id, a.n::INT AS k, round((a.x - b.x) / sqrt(2.0::DOUBLE), 4) + 0.0 AS v FROM es a JOIN es b ON a.sig = b.sig AND b.n = (a.n + 1) % 64")
    register("wpt_haar", haar("wpt", 1), first + out.format("SELECT sig, n AS k, a AS v FROM l1 UNION ALL SELECT sig, n + 32, d FROM l1"))
    register("wpt_haar_2", haar("wpt", 2))

    def lines(f):
        def q(spark, sf):
            got = wholes.map_signal(signals_u(spark, sf), f)
            return got.select("signal_id", F.posexplode("samples").alias("k", "v")).select("signal_id", "k", (F.round("v", 4) + 0.0).alias("v"))

        return q

    register("lpc", lines(lambda x: dsp.lpc(x, 2)))
    register("hilbert", lines(lambda x: np.abs(dsp.hilbert(x))))
    register("czt", lines(lambda x: np.abs(dsp.czt_band(x, (0.05, 0.25), 16))), f"WITH {U_ROWS} SELECT sig AS signal_id, k::INT AS k, round(sqrt(pow(sum(x * cos(2 * pi() * f * n)), 2) + pow(sum(x * sin(2 * pi() * f * n)), 2)), 4) + 0.0 AS v FROM es, (SELECT k, 0.05::DOUBLE + k * 0.2::DOUBLE / 16 AS f FROM (SELECT unnest(range(16)) AS k)) GROUP BY sig, k")
    register("resample_sinc", lines(lambda x: dsp.resample(x, 64, 48, "sinc")))
    register("resample_polyphase", lines(lambda x: dsp.resample(x, 64, 48)))
    register("time_stretch", lines(lambda x: dsp.time_stretch(np.r_[x, np.zeros(64)], 1.25, 32)))
    register("pitch_shift", lines(lambda x: dsp.pitch_shift(np.r_[x, np.zeros(64)], 2, 32)))

    kinds = ["click", "error", "purchase", "signup", "view"]
    p0, a = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]]
    b = [[0.3, 0.1, 0.1, 0.1, 0.4], [0.1, 0.4, 0.2, 0.2, 0.1]]
    model = models.Hmm(np.array(p0), np.array(a), np.array(b))

    def symbols(spark, sf):
        code = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(0))
        return framing.signals_from(table(spark, sf, "events").withColumn("code", code), "user_id", "event_id", "code", SR)

    code_sql = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds)) + " ELSE 0 END"
    emit = lambda s: "CASE o " + " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(b[s])) + " END"
    obs = f"ob AS (SELECT user_id::VARCHAR AS sig, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, {code_sql} AS o FROM events), e AS (SELECT sig, n, {emit(0)} AS e0, {emit(1)} AS e1 FROM ob)"
    register("hmm_predict", lambda s, d: wholes.hmm_predict(symbols(s, d), model).select("signal_id", F.round("logp", 4).alias("logp")), f"""WITH RECURSIVE {obs}, f AS (SELECT sig, n, 0.6::DOUBLE * e0 / (0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS a0, 0.4::DOUBLE * e1 / (0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS a1, ln(0.6::DOUBLE * e0 + 0.4::DOUBLE * e1) AS l FROM e WHERE n = 0
        UNION ALL SELECT g.sig, g.n, x0 / (x0 + x1), x1 / (x0 + x1), l + ln(x0 + x1) FROM (SELECT e.sig, e.n, (a0 * 0.9::DOUBLE + a1 * 0.2::DOUBLE) * e0 AS x0, (a0 * 0.1::DOUBLE + a1 * 0.8::DOUBLE) * e1 AS x1, l FROM f JOIN e ON e.sig = f.sig AND e.n = f.n + 1) g)
        SELECT sig AS signal_id, round(arg_max(l, n), 4) AS logp FROM f GROUP BY sig""")
    register("hmm_decode", lambda s, d: wholes.hmm_decode(symbols(s, d), model).select("signal_id", F.round("logp", 4).alias("logp")), f"""WITH RECURSIVE {obs}, f AS (SELECT sig, n, ln(0.6::DOUBLE) + ln(e0) AS a0, ln(0.4::DOUBLE) + ln(e1) AS a1 FROM e WHERE n = 0
        UNION ALL SELECT e.sig, e.n, greatest(a0 + ln(0.9::DOUBLE), a1 + ln(0.2::DOUBLE)) + ln(e0), greatest(a0 + ln(0.1::DOUBLE), a1 + ln(0.8::DOUBLE)) + ln(e1) FROM f JOIN e ON e.sig = f.sig AND e.n = f.n + 1)
        SELECT sig AS signal_id, round(arg_max(greatest(a0, a1), n), 4) AS logp FROM f GROUP BY sig""")

    register("viterbi", lambda s, d: wholes.viterbi(symbols(s, d), np.array(b), np.array(a), np.array(p0)).select("signal_id", F.round("logp", 4).alias("logp")), ORACLE_SQL["hmm_decode"])
    register("hmm_generate", lambda s, d: wholes.hmm_generate(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("signal_id"), F.col("c_custkey").alias("seed_offset")), model, 50))

    def trained(spark, sf):
        stay = F.col("a")
        return wholes.hmm_train(symbols(spark, sf), model).select("signal_id", stay[0].alias("stay0"), stay[3].alias("stay1"))

    register("hmm_train", trained)
    register("nmf", lambda s, d: wholes.nmf(spec_e(s, d), 2))


for part in (_framing, _fourier, _bands, _descriptors, _units, _rhythm, _wholes):
    part()
ORACLE_SQL |= oracles.presets() | oracles.signals(U_ROWS, V_ROWS, E_ROWS) | oracles.spectra(spec_sql(), frames_sql(), ONSET)
ORACLE_SQL |= oracles.whole(U_ROWS, frames_sql())
ORACLE_SQL |= {"pitch_hps": oracles.harmonics(V_ROWS, "product(m)"), "pitch_lhs": oracles.harmonics(V_ROWS, "sum(ln(m))")}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Mean spectral centroid and rolloff of each event type, from one pass over the spectra."""
    d = descriptors.describe(spec_e(spark, sf), ["centroid", "rolloff"])
    return d.groupBy("signal_id").agg(F.count("*").alias("frames"), F.round(F.avg("centroid"), 6).alias("centroid"), F.round(F.avg("rolloff"), 6).alias("rolloff"))


register("flagship", flagship, f"""WITH {spec_sql()}, q AS (SELECT *, sum(v) OVER (PARTITION BY sig, frame ORDER BY bin) AS run, sum(v) OVER (PARTITION BY sig, frame) AS tot FROM spec),
    d AS (SELECT sig, frame, sum(f * v) / sum(v) AS centroid, min(CASE WHEN run >= 0.95::DOUBLE * tot THEN f END) AS rolloff FROM q GROUP BY sig, frame)
    SELECT sig AS signal_id, count(*) AS frames, round(avg(centroid), 6) AS centroid, round(avg(rolloff), 6) AS rolloff FROM d GROUP BY sig""")

__all__ = ["ORACLE_SQL", "QUERIES", "SpecMeta", "flagship"]
