"""Registered queries over signals whose samples are rows, each with SQL where there is some.

Blocks are much smaller here than by default, so that the small tables have many of them and trees of several levels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .catalog import E_ROWS, SR, H, W, cells, spec_e, table
from .operators import blocks, factors, fourier

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BLOCK, FAN = 128, 4
#: Values a group of the Fourier transforms may hold: less than a signal of the tables, so that they take two steps.
LIMIT = 256


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def rows_e(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.numbered(table(spark, sf, "events"), "event_type", "event_id", F.col("value") / 100)


def rows_u(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.numbered(table(spark, sf, "events"), "user_id", "event_id", F.col("value") / 100)


def rounded(df: DataFrame, column: str = "y", digits: int = 4, name: str = "x", n: str = "n") -> DataFrame:
    return df.select("signal_id", F.col(n).cast("int").alias("n"), (F.round(column, digits) + 0.0).alias(name))


def _recurrences() -> None:
    out = "SELECT sig AS signal_id, n::INT AS n, round({}, 4) + 0.0 AS x FROM {}"
    register("samples_numbered", lambda s, d: rows_e(s, d).select("signal_id", "n", F.round("x", 6).alias("x")), f"WITH {E_ROWS} SELECT sig AS signal_id, n::BIGINT AS n, round(x, 6) AS x FROM es")
    sums = "(SELECT a.sig, a.n, sum(pow({c}::DOUBLE, a.n - b.n) * b.x) AS y FROM {rows} a JOIN {rows} b ON a.sig = b.sig AND b.n <= a.n GROUP BY a.sig, a.n)"
    options = {"size": BLOCK, "fan": FAN}
    register("deemphasis_rows", lambda s, d: rounded(blocks.deemphasis(rows_e(s, d), **options)), f"WITH {E_ROWS} {out.format('y', sums.format(c=0.97, rows='es'))}")
    steps = "dx AS (SELECT sig, n, x - coalesce(lag(x) OVER (PARTITION BY sig ORDER BY n), 0) AS x FROM es)"
    register("offset_compensation_rows", lambda s, d: rounded(blocks.offset_compensation(rows_e(s, d), **options)), f"WITH {E_ROWS}, {steps} {out.format('y', sums.format(c=0.999, rows='dx'))}")
    register("noisegate_rows", lambda s, d: rounded(blocks.noisegate(rows_u(s, d), SR, -6, size=16, fan=FAN)), catalog.ORACLE_SQL["noisegate"])
    register("pcen_rows", lambda s, d: cells(blocks.pcen(spec_e(s, d), size=8, fan=FAN)), catalog.ORACLE_SQL["pcen"])
    register("spectral_gate_rows", lambda s, d: cells(blocks.spectral_gate(spec_e(s, d), -20, release=1, size=8, fan=FAN)), catalog.ORACLE_SQL["spectral_gate"])


def _separation() -> None:
    def parts(spark: SparkSession, sf: str) -> DataFrame:
        both = blocks.hpss(spec_e(spark, sf), (15, 9), size=8)
        rows = both.select("signal_id", "frame", F.posexplode(F.arrays_zip("mask_h", "mask_p")).alias("bin", "m"))
        return rows.select("signal_id", "frame", "bin", F.round("m.mask_h", 4).alias("mask_h"), F.round("m.mask_p", 4).alias("mask_p"))

    register("hpss_rows", parts, catalog.ORACLE_SQL["hpss_masks"])
    register("time_stretch_rows", lambda s, d: rounded(fourier.time_stretch(rows_e(s, d), 1.25, SR, 32, frames=16, fan=FAN), "x"))


def _models() -> None:
    kinds = ["click", "error", "purchase", "signup", "view"]
    p0, a = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
    b = np.array([[0.3, 0.1, 0.1, 0.1, 0.4], [0.1, 0.4, 0.2, 0.2, 0.1]])

    def symbols(spark: SparkSession, sf: str) -> DataFrame:
        code = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(float(i))) for i, k in enumerate(kinds)], F.lit(0.0))
        return blocks.numbered(table(spark, sf, "events"), "user_id", "event_id", code)

    log = lambda v: f"ln({float(v)!r}::DOUBLE)"
    emit = lambda s: "CASE event_type " + " ".join(f"WHEN '{k}' THEN {float(b[s, i])!r}::DOUBLE" for i, k in enumerate(kinds)) + f" ELSE {float(b[s, 0])!r}::DOUBLE END"
    seen = f"e AS (SELECT user_id::VARCHAR AS sig, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, {emit(0)} AS e0, {emit(1)} AS e1 FROM events)"
    to = lambda j: (f"a0 + {log(a[0, j])}", f"a1 + {log(a[1, j])}")
    best = ", ".join(f"greatest({x}, {y}) + ln(e{j}) AS a{j}" for j, (x, y) in enumerate((to(0), to(1))))
    back = ", ".join(f"CASE WHEN {x} >= {y} THEN 0 ELSE 1 END AS b{j}" for j, (x, y) in enumerate((to(0), to(1))))
    register("viterbi_path", lambda s, d: blocks.viterbi(symbols(s, d), b, a, p0, size=16, fan=FAN)[0].select("signal_id", "n", "state"), f"""WITH RECURSIVE {seen},
        f AS (SELECT sig, n, {log(p0[0])} + ln(e0) AS a0, {log(p0[1])} + ln(e1) AS a1, 0 AS b0, 0 AS b1 FROM e WHERE n = 0
            UNION ALL SELECT e.sig, e.n, {best}, {back} FROM f JOIN e ON e.sig = f.sig AND e.n = f.n + 1),
        p AS (SELECT sig, n, CASE WHEN a0 >= a1 THEN 0 ELSE 1 END AS s FROM f WHERE (sig, n) IN (SELECT sig, max(n) FROM e GROUP BY sig)
            UNION ALL SELECT p.sig, p.n - 1, CASE WHEN p.s = 0 THEN f.b0 ELSE f.b1 END FROM p JOIN f ON f.sig = p.sig AND f.n = p.n WHERE p.n > 0)
        SELECT sig AS signal_id, n::BIGINT AS n, s::INT AS state FROM p""")  # fmt: skip
    alpha = lambda s, d: blocks.forward(symbols(s, d), b, a, p0, size=16, fan=FAN)
    mixed = lambda j: f"(q0 * {float(a[0, j])!r}::DOUBLE + q1 * {float(a[1, j])!r}::DOUBLE) * e{j}"
    one = f"{float(p0[0])!r}::DOUBLE * e0", f"{float(p0[1])!r}::DOUBLE * e1"
    register("hmm_forward", lambda s, d: alpha(s, d).select("signal_id", "n", F.round(F.col("alpha")[0], 4).alias("p0"), F.round("logp", 4).alias("logp")), f"""WITH RECURSIVE {seen},
        f AS (SELECT sig, n, x0 / (x0 + x1) AS q0, x1 / (x0 + x1) AS q1, ln(x0 + x1) AS l FROM (SELECT sig, n, {one[0]} AS x0, {one[1]} AS x1 FROM e WHERE n = 0)
            UNION ALL SELECT sig, n, x0 / (x0 + x1), x1 / (x0 + x1), l + ln(x0 + x1) FROM (SELECT e.sig, e.n, {mixed(0)} AS x0, {mixed(1)} AS x1, l FROM f JOIN e ON e.sig = f.sig AND e.n = f.n + 1))
        SELECT sig AS signal_id, n::BIGINT AS n, round(q0, 4) AS p0, round(l, 4) AS logp FROM f""")  # fmt: skip
    def gains(spark: SparkSession, sf: str) -> DataFrame:
        # gains here are of the order of a thousand, so the end is at a move by a hundredth
        return factors.nmf(spec_e(spark, sf), 2, thresh=10.0)[0].select("signal_id", "frame", F.posexplode("gains").alias("component", "gain"))

    register("nmf_rows", gains)


def _fourier() -> None:
    sized = f"{E_ROWS}, el AS (SELECT sig, count(*) AS len FROM es GROUP BY sig)"
    turn = "2 * pi() * ((k * n) % len) / len"
    spectrum = f"ft AS (SELECT sig, len, k, sum(x * cos({turn})) AS re, -sum(x * sin({turn})) AS im FROM (SELECT sig, len, unnest(range({{first}}, {{last}})) AS k FROM el) JOIN es USING (sig) GROUP BY sig, len, k)"

    def there(spark: SparkSession, sf: str) -> DataFrame:
        rows = rows_e(spark, sf)
        got = fourier.rows_of(fourier.fft(fourier.pieces_of(rows, 100), fourier.sizes_of(rows), limit=LIMIT).drop("size"), "k")
        return got.select("signal_id", "k", *[(F.round(c, 3) + 0.0).alias(c) for c in ("re", "im")])

    register("fft_rows", there, f"WITH {sized}, {spectrum.format(first=0, last='len')} SELECT sig AS signal_id, k::BIGINT AS k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM ft")
    lag = "((a.n - b.n + len) % len)"
    kernel = f"CASE WHEN {lag} = 0 THEN 0 WHEN len % 2 = 0 THEN CASE WHEN {lag} % 2 = 1 THEN 2 * cos(pi() * {lag} / len) / sin(pi() * {lag} / len) / len ELSE 0 END ELSE (cos(pi() * {lag} / len) - CASE WHEN {lag} % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * {lag} / len) / len END"
    register("hilbert_rows", lambda s, d: rounded(fourier.analytic(rows_e(s, d), LIMIT), "im"), f"WITH {sized} SELECT a.sig AS signal_id, a.n::INT AS n, round(sum(b.x * ({kernel})), 4) + 0.0 AS x FROM es a JOIN es b ON a.sig = b.sig JOIN el ON el.sig = a.sig GROUP BY a.sig, a.n")
    near = spectrum.format(first="-40", last="41")
    width = "exp(-2 * pi() * pi() * (k - band) * (k - band) / (band * band))"
    voice = f"y AS (SELECT sig, band, n, sum(({{a}}) * {width}) / any_value(len) AS v FROM ft, (SELECT unnest([2, 3, 5]) AS band), (SELECT sig AS s, n FROM es) t WHERE t.s = sig GROUP BY sig, band, n)"
    at = "2 * pi() * (((k - band) * n) % len) / len"
    both = voice.format(a=f"re * cos({at}) - im * sin({at})"), voice.format(a=f"re * sin({at}) + im * cos({at})").replace("y AS", "z AS", 1)
    register("stockwell_rows", lambda s, d: fourier.stockwell(rows_e(s, d), 2, 5, limit=LIMIT).where("band <> 4").select("signal_id", "band", F.col("n").cast("int").alias("n"), (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im")),
             f"WITH {sized}, {near}, {both[0]}, {both[1]} SELECT sig AS signal_id, band::INT AS band, n::INT AS n, round(y.v, 4) + 0.0 AS re, round(z.v, 4) + 0.0 AS im FROM y JOIN z USING (sig, band, n)")
    taps = [1 / math.sqrt(2), -1 / math.pi, 1 / math.sqrt(37), 1 / math.sqrt(199)]
    register("convolve_rows", lambda s, d: rounded(fourier.convolve(rows_e(s, d), np.array(taps), size=BLOCK)), f"WITH {E_ROWS} SELECT sig AS signal_id, n::INT AS n, round({' + '.join(f'{h!r}::DOUBLE * coalesce(lag(x, {i}) OVER w, 0)' for i, h in enumerate(taps))}, 4) + 0.0 AS x FROM es WINDOW w AS (PARTITION BY sig ORDER BY n)")
    register("front_cqt_rows", lambda s, d: cells(fourier.cqt(rows_e(s, d), SR, W, H, fmin=4.0, nbins=12, bins_per_octave=6, frames=8)))
    # the Morlet wavelet in time: a Gaussian of one scale, turned by six radians for each
    freq = [3 * 2 ** (i / 2) for i in range(5)]
    scale = 6 * SR / (2 * math.pi)
    pad, reach = 58, 190
    place = "CASE WHEN r < 0 THEN -r WHEN r >= len THEN 2 * (len - 1) - r ELSE r END"
    ext = f"ext AS (SELECT p.sig, p.p, es.x FROM (SELECT sig, p, {place} AS n FROM (SELECT sig, len, p, (p + {pad} + 2 * (len + {2 * pad})) % (len + {2 * pad}) - {pad} AS r FROM (SELECT sig, len, unnest(range(-{reach}, len + {reach})) AS p FROM el))) p JOIN es ON es.sig = p.sig AND es.n = p.n)"
    taps_sql = f"g AS (SELECT band, t, pow(pi(), -0.25::DOUBLE) / (s * sqrt(2 * pi())) * exp(-t * t / (2 * s * s)) * cos(6 * t / s) AS c, pow(pi(), -0.25::DOUBLE) / (s * sqrt(2 * pi())) * exp(-t * t / (2 * s * s)) * sin(6 * t / s) AS d FROM (SELECT unnest(range(5)) AS band, unnest([{', '.join(f'{scale / f!r}::DOUBLE' for f in freq)}]) AS s), (SELECT unnest(range(-{reach}, {reach + 1})) AS t) WHERE abs(t) <= 9 * s)"
    y = "y AS (SELECT sig, band, p + t AS n, pow(sum(x * c), 2) + pow(sum(x * d), 2) AS v FROM ext, g GROUP BY sig, band, p + t)"
    framed = f"SELECT sig AS signal_id, frame::INT AS frame, band::INT AS bin, round(avg(v), 4) AS value FROM (SELECT sig, len, unnest(range((len - {W}) // {H} + 1)) AS frame FROM el WHERE len >= {W}) f JOIN y USING (sig) WHERE n BETWEEN frame * {H} AND frame * {H} + {W} - 1 GROUP BY sig, frame, band"
    register("front_cwt_rows", lambda s, d: cells(fourier.cwt(rows_e(s, d), SR, W, H, voices=2, freqrange=(3, 12), frames=8)), f"WITH {sized}, {ext}, {taps_sql}, {y} {framed}")


for part in (_recurrences, _separation, _models, _fourier):
    part()

__all__ = ["ORACLE_SQL", "QUERIES"]
