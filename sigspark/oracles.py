"""SQL for registered queries, derived from formulas alone: filter designs, cosine transforms and taps are made in the
database, so these do not share code with what they check."""

from __future__ import annotations

import math

SR, W, H = 64, 64, 32

# ---- filter designs: tables fb(band, bin, w) ----


def _edges(scale: str, low: float, high: float, n: int, step: int = 12) -> str:
    """The expression of edge ``i`` of n bands (n + 2 edges)."""
    at = lambda to: f"({to(low)} + i * ({to(high)} - {to(low)}) / {n + 1})"
    d = lambda v: f"{float(v)!r}::DOUBLE"
    if scale == "htk":
        m = at(lambda f: f"2595 * log10(1 + {d(f)} / 700)")
        return f"700 * (pow(10.0::DOUBLE, {m} / 2595) - 1)"
    if scale == "slaney":
        m = at(lambda f: f"(CASE WHEN {d(f)} < 1000 THEN {d(f)} * 3 / 200 ELSE 15 + 27 * ln(greatest({d(f)}, 1e-300) / 1000) / ln(6.4::DOUBLE) END)")
        return f"(CASE WHEN {m} < 15 THEN {m} * 200 / 3 ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * ({m} - 15)) END)"
    if scale == "bark":
        raw = lambda f: f"(26.81::DOUBLE * {d(f)} / (1960 + {d(f)}) - 0.53::DOUBLE)"
        m = at(lambda f: f"(CASE WHEN {raw(f)} < 2 THEN {raw(f)} + 0.15::DOUBLE * (2 - {raw(f)}) ELSE {raw(f)} END)")
        z = f"(CASE WHEN {m} < 2 THEN ({m} - 0.3::DOUBLE) / 0.85::DOUBLE ELSE {m} END)"
        return f"1960 * ({z} + 0.53::DOUBLE) / (26.28::DOUBLE - {z})"
    if scale == "erb":
        m = at(lambda f: f"log10(1 + {d(f)} * 0.004368::DOUBLE)")
        return f"(pow(10.0::DOUBLE, {m}) - 1) / 0.004368::DOUBLE"
    if scale == "linspace":
        return f"{d(low)} + (i - 1) * {d((high - low) / (n - 1))}"
    if scale == "logspace":
        return f"{d(low)} * pow({d(high / low)}, (i - 1) / {d(n - 1)})"
    return f"440 * pow(2.0::DOUBLE, (round({step} * log2({d(low / 440)})) - 1 + i) / {d(step)})"


def triangles(scale: str, low: float, high: float, n: int, norm: str = "bandwidth", warped: bool = False, sr: int = SR, nfft: int = W, gain: float = 1.0, step: int = 12) -> str:
    y = (lambda f: f"(2595 * log10(1 + {f} / 700))") if warped else (lambda f: f)
    weight = f"CASE WHEN f > a.e AND f <= b.e THEN ({y('f')} - {y('a.e')}) / ({y('b.e')} - {y('a.e')}) WHEN f > b.e AND f <= c.e AND NOT (a.i = {n - 1} AND k = {nfft // 2}) THEN ({y('c.e')} - {y('f')}) / ({y('c.e')} - {y('b.e')}) ELSE 0 END"
    by = {"bandwidth": "w / ((hi - lo) / 2)", "none": "w", "area": "w / sum(w) OVER (PARTITION BY band)"}[norm]
    return f"""ed AS (SELECT i, {_edges(scale, low, high, n, step)} AS e FROM (SELECT unnest(range({n + 2})) AS i)),
        tri AS (SELECT a.i AS band, k AS bin, a.e AS lo, c.e AS hi, {weight} AS w FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed c ON c.i = a.i + 2, (SELECT k, k * {sr / nfft!r}::DOUBLE AS f FROM (SELECT unnest(range({nfft // 2 + 1})) AS k))),
        fb AS (SELECT band, bin, {by} * {gain!r}::DOUBLE AS w FROM tri)"""


def gammatones(low: float, high: float, n: int, gain: float = 1.0) -> str:
    """Magnitudes of four sections with Slaney's zeros and one pair of poles, by |1 - c z|^2 = 1 - 2 c cos + c^2."""
    roots = [s * math.sqrt(3 + q * 2**1.5) for q in (1, -1) for s in (1, -1)]
    size = lambda at: " * ".join(f"sqrt(1 - 2 * d * (cos(w0) + {r!r}::DOUBLE * sin(w0)) * cos({at}) + pow(d * (cos(w0) + {r!r}::DOUBLE * sin(w0)), 2))" for r in roots)
    poles = lambda at: f"pow(pow(1 - 2 * d * cos(w0) * cos({at}) + d * d * cos(2 * {at}), 2) + pow(2 * d * cos(w0) * sin({at}) - d * d * sin(2 * {at}), 2), 2)"
    return f"""cf AS (SELECT i AS band, (pow(10.0::DOUBLE, log10(1 + {float(low)!r}::DOUBLE * 0.004368::DOUBLE) + i * (log10(1 + {float(high)!r}::DOUBLE * 0.004368::DOUBLE) - log10(1 + {float(low)!r}::DOUBLE * 0.004368::DOUBLE)) / {n - 1}) - 1) / 0.004368::DOUBLE AS cf FROM (SELECT unnest(range({n})) AS i)),
        gp AS (SELECT band, cf, 2 * pi() * cf / {SR} AS w0, exp(-2 * pi() * 1.019::DOUBLE * (cf / 9.26449::DOUBLE + 24.7::DOUBLE) / {SR}) AS d FROM cf),
        fb AS (SELECT band, k AS bin, ({size('w')}) / {poles('w')} / (({size('w0')}) / {poles('w0')}) * (CASE WHEN k BETWEEN 1 AND {W // 2 - 1} THEN 2 ELSE 1 END) / (1.019::DOUBLE * 24.7::DOUBLE * (0.00437::DOUBLE * cf + 1) / 2) * {gain!r}::DOUBLE AS w
          FROM gp, (SELECT k, 2 * pi() * k / {W} AS w FROM (SELECT unnest(range({W // 2 + 1})) AS k)))"""


def bin_triangles(low: float, high: float, n: int, kind: str, sr: int = SR, nfft: int = W) -> str:
    """Triangles between whole bins: ``etsi`` (rounded, from a step above zero) or ``psf`` (floored, plain)."""
    place = f"round_even(e * {nfft} / {sr}, 0)::INT" if kind == "etsi" else f"floor({nfft + 1} * e / {sr})::INT"
    weight = {
        "etsi": "CASE WHEN k BETWEEN a AND c THEN (k - a + 1) / (c - a + 1)::DOUBLE WHEN k > c AND k <= z THEN 1 - (k - c) / (z - c + 1)::DOUBLE ELSE 0 END",
        "psf": "CASE WHEN k >= a AND k < c THEN (k - a) / greatest(c - a, 1)::DOUBLE WHEN k >= c AND k < z THEN (z - k) / greatest(z - c, 1)::DOUBLE ELSE 0 END",
    }[kind]
    return f"""ed AS (SELECT i, {place} AS b FROM (SELECT i, {_edges('htk', low, high, n)} AS e FROM (SELECT unnest(range({n + 2})) AS i))),
        fb AS (SELECT band, k AS bin, {weight} AS w FROM (SELECT x.i AS band, x.b AS a, y.b AS c, v.b AS z FROM ed x JOIN ed y ON y.i = x.i + 1 JOIN ed v ON v.i = x.i + 2), (SELECT unnest(range({nfft // 2 + 1})) AS k))"""


def cosines(n: int, kind: str, coefficients: int, first: int = 0, lifter: int = 0) -> str:
    """A table dct(c, band, w)."""
    size = {"plain": "1", "htk": f"sqrt(2.0::DOUBLE / {n})", "ortho": f"sqrt(2.0::DOUBLE / {n}) / CASE WHEN q = 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END"}[kind]
    gain = f"* (1 + {lifter / 2!r}::DOUBLE * sin(pi() * q / {lifter}))" if lifter else ""
    return f"dct AS (SELECT q - {first} AS c, band, {size} * cos(pi() * q * (band + 0.5::DOUBLE) / {n}) {gain} AS w FROM (SELECT unnest(range({first}, {first + coefficients})) AS q), (SELECT unnest(range({n})) AS band))"


def lagged(length: int, value: str = "v", order: str = "PARTITION BY sig, c ORDER BY frame") -> str:
    """The least-squares slope over the last frames."""
    m = length // 2
    total = sum(i * i for i in range(1, m + 1))
    return " + ".join(f"{(m - i) / total!r}::DOUBLE * coalesce(lag({value}, {i}) OVER ({order}), 0)" for i in range(length))


# ---- presets: one long signal at 8,000 Hz ----


def _preset(w: int, h: int, nfft: int, taper: str, fb: str, nbands: int, rect: str, floor: float, cos: str, *, rows: str = "", pre: bool = False, dc: bool = False, center: bool = False, pad_end: bool = False, power: bool = True, scale: float = 1.0, energy: str = "", clip: str = "r", append: int = 0) -> str:
    rows = rows or "s0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_totalprice / 100000 AS x FROM orders)"
    start = -(w // 2) if center else 0
    size = f"(len + {2 * (w // 2) if center else 0})"
    count = f"(CASE WHEN {size} <= {w} THEN 1 ELSE ({size} - {w} + {h - 1}) // {h} + 1 END)" if pad_end else f"(({size} - {w}) // {h} + 1)"
    clean = "x - avg(x) OVER (PARTITION BY frame)" if dc else "x"
    sharp = "x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY frame ORDER BY j), x)" if pre else "x"
    made = "v" if power else "sqrt(v)"
    picked = {"": "v", "raw": "CASE WHEN c = 0 THEN e ELSE v END"}[energy]
    more = f" UNION ALL SELECT 'orders', frame::INT, {append}, round(e, 3) + 0.0 FROM en" if append else ""
    return f"""WITH {rows}, sz AS (SELECT count(*) AS len FROM s0),
        f0 AS (SELECT frame, j, coalesce(x, 0) AS x FROM (SELECT frame, j, {start} + frame * {h} + j AS n FROM (SELECT unnest(range({count})) AS frame FROM sz), (SELECT unnest(range({w})) AS j)) LEFT JOIN s0 USING (n)),
        f1 AS (SELECT frame, j, {clean} AS x FROM f0), f2 AS (SELECT frame, j, ({sharp}) * ({taper}) AS x FROM f1),
        sp AS (SELECT frame, bin, {scale!r}::DOUBLE * {made} AS v FROM (SELECT frame, k AS bin, pow(sum(x * cos(2 * pi() * ((k * j) % {nfft}) / {nfft})), 2) + pow(sum(x * sin(2 * pi() * ((k * j) % {nfft}) / {nfft})), 2) AS v FROM f2, (SELECT unnest(range({nfft // 2 + 1})) AS k) GROUP BY frame, k)),
        {fb}, b AS (SELECT frame, band, sum(w * v) AS v FROM sp JOIN fb USING (bin) GROUP BY frame, band),
        r0 AS (SELECT frame, band, {rect.format(f'greatest(v, {floor!r}::DOUBLE)')} AS r FROM b), r AS (SELECT frame, band, {clip} AS r FROM r0), {cos},
        en AS ({{energy}}), cep AS (SELECT frame, c, sum(w * r) AS v FROM r JOIN dct USING (band) GROUP BY frame, c)
        SELECT 'orders' AS signal_id, frame::INT AS frame, c::INT AS bin, round({picked}, 3) + 0.0 AS value FROM cep JOIN en USING (frame){more}"""


def presets() -> dict[str, str]:
    hamming = lambda n: f"0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * j / {n})"
    tri = lambda *a, **o: triangles(*a, sr=8000, **o)
    raw = "SELECT frame, ln(greatest(sum(x * x), {}::DOUBLE)) AS e FROM f1 GROUP BY frame"
    none = "SELECT DISTINCT frame, 0 AS e FROM f1"
    order = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_totalprice / 100000 AS x FROM orders"
    # y = x - x before + 0.999 y before, as a running sum
    level = f"q0 AS ({order}), s0 AS (SELECT n, 32768 * pow(0.999::DOUBLE, n) * sum(d * pow(0.999::DOUBLE, -n)) OVER (ORDER BY n) AS x FROM (SELECT n, x - coalesce(lag(x) OVER (ORDER BY n), 0) AS d FROM q0))"
    sharp = f"q0 AS ({order}), s0 AS (SELECT n, x - 0.97::DOUBLE * coalesce(lag(x) OVER (ORDER BY n), 0) AS x FROM q0)"
    hann = "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 199)"
    return {
        "mfcc_matlab": _preset(240, 80, 240, hamming(240), tri("htk", 0, 4000, 32, nfft=240), 32, "log10({})", 2.2250738585072014e-308, cosines(32, "ortho", 13)).format(energy=none),
        "mfcc_htk": _preset(200, 80, 256, hamming(199), tri("htk", 0, 4000, 20, "none", True, nfft=256), 20, "ln({})", 1.0, cosines(20, "htk", 12, 1, 22), pre=True, power=False, scale=32768.0).format(energy=none),
        "mfcc_kaldi": _preset(200, 80, 256, f"pow({hann}, 0.85::DOUBLE)", tri("htk", 20, 4000, 23, "none", True, nfft=256), 23, "ln({})", 1.1920928955078125e-07, cosines(23, "ortho", 13, 0, 22), pre=True, dc=True, energy="raw").format(energy=raw.format(2.220446049250313e-16)),
        "mfcc_librosa": _preset(512, 128, 512, "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 512)", tri("slaney", 0, 4000, 20, nfft=512), 20, "10 * log10({})", 1e-10, cosines(20, "ortho", 10), center=True, clip="greatest(r, max(r) OVER () - 80)").format(energy=none),
        "mfcc_etsi": _preset(200, 80, 256, hamming(199), bin_triangles(64, 4000, 23, "etsi", 8000, 256), 23, "ln({})", 2e-22, cosines(23, "plain", 13), rows=level, pre=True, power=False, append=13).format(energy=raw.format(1.9287498479639178e-22)),
        "mfcc_psf": _preset(200, 80, 512, "1", bin_triangles(0, 4000, 26, "psf", 8000, 512), 26, "ln({})", 2.220446049250313e-16, cosines(26, "ortho", 13, 0, 22), rows=sharp, pad_end=True, scale=1 / 512, energy="raw").format(energy="SELECT frame, ln(greatest(sum(v), 2.220446049250313e-16::DOUBLE)) AS e FROM sp GROUP BY frame"),
    }


# ---- signals ----


def signals(u_rows: str, v_rows: str, e_rows: str) -> dict[str, str]:
    attack, release = (math.exp(-math.log(9) / (SR * s)) for s in (0.05, 0.2))
    step = f"CASE WHEN t > g THEN {attack!r}::DOUBLE * g + {1 - attack!r}::DOUBLE * t ELSE {release!r}::DOUBLE * g + {1 - release!r}::DOUBLE * t END"
    levels = f"""{e_rows}, sz AS (SELECT sig, max(n) + 1 AS len FROM es GROUP BY sig),
        fr AS (SELECT sig, len, unnest(range(len // 16 + 1)) AS i FROM sz),
        lv AS (SELECT sig, len, i, coalesce(sum(x * x), 0) / 64 AS p FROM fr LEFT JOIN es USING (sig) WHERE n BETWEEN 16 * i - 32 AND 16 * i + 31 GROUP BY sig, len, i),
        db AS (SELECT *, 10 * log10(greatest(p, 1e-10)) - 10 * log10(greatest(max(p) OVER (PARTITION BY sig), 1e-10)) AS d FROM lv),
        ru AS (SELECT sig, len, i, i - row_number() OVER (PARTITION BY sig ORDER BY i) AS run FROM db WHERE d > -{{db}}),
        iv AS (SELECT sig, min(i) * 16 + 1 AS a, least(any_value(len), (max(i) + 1) * 16) AS z FROM ru GROUP BY sig, run)"""
    pair = "SELECT sig, n // 2 AS n, sum(x) / sqrt(2.0::DOUBLE) AS a, sum(CASE WHEN n % 2 = 0 THEN x ELSE -x END) / sqrt(2.0::DOUBLE) AS d FROM {} GROUP BY sig, n // 2"
    return {
        "lpc": f"""WITH {u_rows}, p AS (SELECT sig, x AS b, lead(x) OVER w AS m, lead(x, 2) OVER w AS f FROM es WINDOW w AS (PARTITION BY sig ORDER BY n)),
            one AS (SELECT sig, coalesce(-2 * sum(m * b) / nullif(sum(m * m + b * b), 0), 0) AS k FROM p WHERE m IS NOT NULL GROUP BY sig),
            two AS (SELECT sig, any_value(k) AS k, coalesce(-2 * sum((f + k * m) * (b + k * m)) / nullif(sum(pow(f + k * m, 2) + pow(b + k * m, 2)), 0), 0) AS q FROM p JOIN one USING (sig) WHERE f IS NOT NULL GROUP BY sig)
            SELECT sig AS signal_id, i::INT AS k, round(CASE i WHEN 0 THEN 1 WHEN 1 THEN k + q * k ELSE q END, 4) + 0.0 AS v FROM two, (SELECT unnest([0, 1, 2]) AS i)""",
        "hilbert": f"""WITH {u_rows}, sz AS (SELECT sig, count(*) AS m FROM es GROUP BY sig),
            ft AS (SELECT sig, m, k, CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END AS g, sum(x * cos(2 * pi() * ((k * n) % m) / m)) AS re, -sum(x * sin(2 * pi() * ((k * n) % m) / m)) AS im FROM es JOIN (SELECT sig, m, unnest(range(m // 2 + 1)) AS k FROM sz) USING (sig) GROUP BY sig, m, k)
            SELECT sig AS signal_id, n::INT AS k, round(sqrt(pow(sum(g * (re * cos(2 * pi() * ((k * n) % m) / m) - im * sin(2 * pi() * ((k * n) % m) / m))), 2) + pow(sum(g * (re * sin(2 * pi() * ((k * n) % m) / m) + im * cos(2 * pi() * ((k * n) % m) / m))), 2)) / any_value(m), 4) + 0.0 AS v
            FROM es JOIN ft USING (sig) GROUP BY sig, n""",
        "noisegate": f"""WITH RECURSIVE {u_rows}, t AS (SELECT sig, n, x, CASE WHEN n - max(CASE WHEN abs(x) >= {10 ** (-6 / 20)!r}::DOUBLE THEN n END) OVER (PARTITION BY sig ORDER BY n) <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM es),
            y AS (SELECT sig, n, x, (SELECT {step} FROM (SELECT 0.0::DOUBLE AS g)) AS g FROM t WHERE n = 0
              UNION ALL SELECT sig, n, x, {step} AS g FROM (SELECT t.sig, t.n, t.x, t.t, y.g FROM y JOIN t ON t.sig = y.sig AND t.n = y.n + 1))
            SELECT sig AS signal_id, n::INT AS n, round(x * g, 4) + 0.0 AS x FROM y""",
        "split_silence": f"WITH {levels.format(db=6)} SELECT sig AS signal_id, a::BIGINT AS first, z::BIGINT AS last FROM iv",
        "trim_silence": f"WITH {levels.format(db=3)} SELECT sig AS signal_id, min(a)::BIGINT AS first, max(z)::BIGINT AS last FROM iv GROUP BY sig",
        "wpt_haar_2": f"""WITH {v_rows}, l1 AS ({pair.format('es')}), lo AS (SELECT sig, n, a AS x FROM l1), hi AS (SELECT sig, n, d AS x FROM l1), l2 AS ({pair.format('lo')}), h2 AS ({pair.format('hi')})
            SELECT sig AS signal_id, k::INT AS k, round(v, 4) + 0.0 AS v FROM (SELECT sig, n AS k, a AS v FROM l2 UNION ALL SELECT sig, n + 16, d FROM l2 UNION ALL SELECT sig, n + 32, d FROM h2 UNION ALL SELECT sig, n + 48, a FROM h2)""",
        "pitch_yin": f"""WITH {v_rows}, d AS (SELECT a.sig, k, sum(pow(a.x - b.x, 2)) AS d FROM es a, (SELECT unnest(range(17)) AS k) JOIN es b ON b.sig = a.sig AND b.n = a.n + k WHERE a.n < 48 GROUP BY a.sig, k),
            c AS (SELECT sig, k, CASE WHEN k = 0 OR run = 0 THEN 1 ELSE d * k / run END AS c FROM (SELECT sig, k, d, sum(CASE WHEN k > 0 THEN d ELSE 0 END) OVER (PARTITION BY sig ORDER BY k) AS run FROM d)),
            s AS (SELECT sig, k, c, lag(c) OVER w AS below, lead(c) OVER w AS above FROM c WINDOW w AS (PARTITION BY sig ORDER BY k)),
            f AS (SELECT sig, min(k) AS first FROM s WHERE k >= 4 AND c < 0.1::DOUBLE GROUP BY sig),
            p AS (SELECT sig, coalesce(min(CASE WHEN k >= first AND (above IS NULL OR above >= c) THEN k END), arg_min(k, (c, k))) AS k FROM s LEFT JOIN f USING (sig) WHERE k >= 4 GROUP BY sig)
            SELECT sig AS signal_id, 0 AS frame, round(64 / (CASE WHEN above IS NULL OR below - 2 * c + above = 0 THEN k ELSE k + (below - above) / (2 * (below - 2 * c + above)) END), 4) AS value FROM s JOIN p USING (sig, k)""",
        "pitch_cep": f"""WITH {v_rows}, l AS (SELECT sig, k, ln(sqrt(pow(sum(x * cos(2 * pi() * ((k * n) % 128) / 128)), 2) + pow(sum(x * sin(2 * pi() * ((k * n) % 128) / 128)), 2)) + 2.220446049250313e-16::DOUBLE) AS l FROM es, (SELECT unnest(range(65)) AS k) GROUP BY sig, k),
            c AS (SELECT sig, q, sum(l * CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * cos(2 * pi() * ((k * q) % 128) / 128)) / 128 AS c FROM l, (SELECT unnest(range(3, 18)) AS q) GROUP BY sig, q),
            s AS (SELECT sig, q AS k, c, lag(c) OVER w AS below, lead(c) OVER w AS above FROM c WINDOW w AS (PARTITION BY sig ORDER BY q)),
            p AS (SELECT sig, arg_max(k, (c, -k)) AS k FROM s WHERE k BETWEEN 4 AND 16 GROUP BY sig)
            SELECT sig AS signal_id, 0 AS frame, round(CASE WHEN c <= 0 THEN 0 ELSE 64 / (CASE WHEN below - 2 * c + above = 0 THEN k ELSE k + (below - above) / (2 * (below - 2 * c + above)) END) END, 4) AS value FROM s JOIN p USING (sig, k)""",
    }


def harmonics(v_rows: str, score: str) -> str:
    """The bin from 4 to 16 whose harmonics score best, three of them, under a periodic Hamming window."""
    return f"""WITH {v_rows}, m AS (SELECT sig, k, sqrt(pow(sum(y * cos(2 * pi() * ((k * n) % 64) / 64)), 2) + pow(sum(y * sin(2 * pi() * ((k * n) % 64) / 64)), 2)) AS m FROM (SELECT sig, n, x * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * n / 64)) AS y FROM es), (SELECT unnest(range(64)) AS k) GROUP BY sig, k),
        s AS (SELECT sig, j, {score} AS s FROM m, (SELECT unnest(range(4, 17)) AS j), (SELECT unnest(range(1, 4)) AS h) WHERE k = (j * h) % 64 GROUP BY sig, j)
        SELECT sig AS signal_id, 0 AS frame, round(arg_max(j, (s, -j))::DOUBLE, 4) AS value FROM s GROUP BY sig"""


# ---- envelopes and spectra: over the common tables of the catalog ----


def spectra(spec: str, frames: str, onset: str) -> dict[str, str]:
    local = """ev AS (SELECT sig, frame, v, count(*) OVER (PARTITION BY sig) AS len FROM env),
        ty AS (SELECT e.sig, e.frame AS i, j, coalesce(x.v, 0) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 15)) AS y FROM ev e CROSS JOIN (SELECT unnest(range(16)) AS j) LEFT JOIN env x ON x.sig = e.sig AND x.frame = e.frame + j - 8),
        ta AS (SELECT a.sig, a.i, b.j - a.j AS k, sum(a.y * b.y) AS r FROM ty a JOIN ty b ON a.sig = b.sig AND a.i = b.i AND b.j >= a.j GROUP BY a.sig, a.i, b.j - a.j),
        tg AS (SELECT sig, i, k, r / CASE WHEN top > 0 THEN top ELSE 1 END AS r FROM (SELECT *, max(abs(r)) OVER (PARTITION BY sig, i) AS top FROM ta))"""
    return {
        "tempogram": f"WITH {spec}, {onset}, {local} SELECT sig AS signal_id, i::INT AS frame, k::INT AS bin, round(r, 4) AS value FROM tg",
        "tempo": f"""WITH {spec}, {onset}, {local}, ac AS (SELECT sig, k, avg(r) * CASE WHEN k = 0 OR 120.0::DOUBLE / k > 320 THEN 0 ELSE exp(-0.5::DOUBLE * pow(log2(120.0::DOUBLE / greatest(k, 1)) - log2(120.0::DOUBLE), 2)) END AS s FROM tg GROUP BY sig, k)
            SELECT sig AS signal_id, 120.0::DOUBLE / arg_max(k, (s, -k)) AS bpm FROM ac GROUP BY sig""",
        "onset_detect": f"""WITH RECURSIVE {spec}, {onset}, nv AS (SELECT sig, frame, v / CASE WHEN top > 0 THEN top ELSE 1 END AS v FROM (SELECT *, max(v) OVER (PARTITION BY sig) AS top FROM env)),
            ca AS (SELECT sig, frame FROM (SELECT *, max(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS wide FROM nv WINDOW w AS (PARTITION BY sig ORDER BY frame)) WHERE v = near AND v >= wide + 0.07::DOUBLE),
            ta AS (SELECT sig, min(frame) AS frame FROM ca GROUP BY sig UNION ALL SELECT ca.sig, min(ca.frame) AS frame FROM ta JOIN ca ON ca.sig = ta.sig AND ca.frame > ta.frame + 2 GROUP BY ca.sig)
            SELECT sig AS signal_id, frame::INT AS frame, round((frame * {H} + {W / 2}::DOUBLE) / {SR}, 4) AS t FROM ta""",
        "cepstrogram": f"""WITH {spec}, l AS (SELECT sig, frame, k, ln(greatest(v, 1e-16)) AS l FROM (SELECT sig, frame, bin AS k, v FROM spec UNION ALL SELECT sig, frame, {W} - bin, v FROM spec WHERE bin BETWEEN 1 AND {W // 2 - 1})),
            c AS (SELECT sig, frame, q, sum(l * cos(2 * pi() * ((k * q) % {W}) / {W})) / {W} AS c FROM l, (SELECT unnest(range({W})) AS q) WHERE q <= 4 OR q >= {W - 4} GROUP BY sig, frame, q)
            SELECT sig AS signal_id, frame::INT AS frame, k::INT AS bin, round(sum(c * cos(2 * pi() * ((k * q) % {W}) / {W})), 4) AS value FROM c, (SELECT unnest(range({W // 2 + 1})) AS k) GROUP BY sig, frame, k""",
        "spectral_contrast": f"""WITH {spec}, ra(band, lo, hi, q) AS (VALUES (0, 0, 3, 1), (1, 3, 7, 1), (2, 7, 15, 2), (3, 15, 32, 4)),
            o AS (SELECT sig, frame, band, sqrt(v) AS m, row_number() OVER (PARTITION BY sig, frame, band ORDER BY v) AS up, row_number() OVER (PARTITION BY sig, frame, band ORDER BY v DESC) AS down, q FROM spec JOIN ra ON bin BETWEEN lo AND hi)
            SELECT sig AS signal_id, frame::INT AS frame, band::INT AS bin, round(ln(avg(m) FILTER (WHERE down <= q) + 1e-6) - ln(avg(m) FILTER (WHERE up <= q) + 1e-6), 4) AS value FROM o GROUP BY sig, frame, band""",
        "deconv": f"""WITH {spec}, f AS (SELECT sig, frame, k, sqrt(pow(sum(v * cos(2 * pi() * ((k * bin) % 128) / 128)), 2) + pow(sum(v * sin(2 * pi() * ((k * bin) % 128) / 128)), 2)) AS a FROM spec, (SELECT unnest(range(65)) AS k) GROUP BY sig, frame, k)
            SELECT sig AS signal_id, frame::INT AS frame, n::INT AS bin, round(sum(a * CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * cos(2 * pi() * ((k * n) % 128) / 128)) / 128, 4) AS value FROM f, (SELECT unnest(range(33)) AS n) GROUP BY sig, frame, n""",
    }


def whole(u_rows: str, frames: str) -> dict[str, str]:
    bessel = lambda x: "(1 + " + " + ".join(f"pow(({x}) / 2, {2 * k}) / {float(math.factorial(k)) ** 2!r}::DOUBLE" for k in range(1, 40)) + ")"
    half = 128  # 64 to 48 samples a second: three up, four down, 32 zeros of the slower rate
    hann = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16))"
    soft = lambda a, b: f"CASE WHEN greatest({a}, {b}) <= 0 THEN 0.5::DOUBLE ELSE {a} * {a} / ({a} * {a} + {b} * {b}) END"
    back = lambda m: f"sum(CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * {m} * (re * cos(2 * pi() * ((k * j) % 16) / 16) - im * sin(2 * pi() * ((k * j) % 16) / 16))) / 16"
    return {
        "resample_polyphase": f"""WITH {u_rows}, tp AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 4) / (pi() * k / 4) END * {bessel(f'8 * sqrt(greatest(1 - pow(k / {half}.0::DOUBLE, 2), 0))')} / {bessel('8')} * 0.75::DOUBLE AS h FROM (SELECT unnest(range(-{half}, {half + 1})) AS k)),
            o AS (SELECT sig, unnest(range(CAST(ceil(count(*) * 3 / 4.0::DOUBLE) AS BIGINT))) AS m FROM es GROUP BY sig)
            SELECT sig AS signal_id, m::INT AS k, round(sum(h * x), 4) + 0.0 AS v FROM o JOIN es USING (sig) JOIN tp ON tp.k = m * 4 - n * 3 GROUP BY sig, m""",
        "harmonic_ratio_tracked": f"""WITH {frames}, b AS (SELECT sig, frame, j, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {W})) AS x FROM ef),
            r AS (SELECT a.sig, a.frame, c.j - a.j AS k, sum(a.x * c.x) AS r FROM b a JOIN b c ON a.sig = c.sig AND a.frame = c.frame AND c.j >= a.j AND c.j - a.j <= 32 GROUP BY a.sig, a.frame, c.j - a.j),
            en AS (SELECT sig, frame, j, sum(x * x) OVER (PARTITION BY sig, frame ORDER BY j) AS e FROM b),
            cr AS (SELECT sig, frame, min(CASE WHEN k BETWEEN 1 AND 31 AND sign(r) * sign(nx) <= 0 THEN k END) AS c FROM (SELECT *, lead(r) OVER (PARTITION BY sig, frame ORDER BY k) AS nx FROM r) GROUP BY sig, frame),
            lo AS (SELECT sig, frame, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY sig ORDER BY frame), 0) AS low FROM cr),
            g AS (SELECT r.sig, r.frame, r.k, r.r / sqrt(z.r * en.e + 1e-16) AS g FROM r JOIN lo ON lo.sig = r.sig AND lo.frame = r.frame AND r.k BETWEEN lo.low + 1 AND 31 JOIN r z ON z.sig = r.sig AND z.frame = r.frame AND z.k = 0 JOIN en ON en.sig = r.sig AND en.frame = r.frame AND en.j = {W} - 2 - r.k),
            q AS (SELECT *, lag(g) OVER w AS below, lead(g) OVER w AS above, first_value(k) OVER (PARTITION BY sig, frame ORDER BY g DESC, k) AS top FROM g WINDOW w AS (PARTITION BY sig, frame ORDER BY k))
            SELECT lo.sig AS signal_id, lo.frame::INT AS frame, round(coalesce(CASE WHEN below IS NULL OR above IS NULL THEN g ELSE g - 0.25::DOUBLE * (below - above) * (above - below) / (2 * (2 * g - above - below) + 1e-16) END, 0), 4) AS value FROM lo LEFT JOIN q ON q.sig = lo.sig AND q.frame = lo.frame AND q.k = q.top""",
        "hpss_signals": f"""WITH {u_rows}, sz AS (SELECT sig, count(*) AS len FROM es GROUP BY sig),
            fr AS (SELECT sig, frame, j, x * {hann} AS x FROM (SELECT sig, frame, (n - frame * 8) AS j, x FROM es JOIN (SELECT sig, unnest(range((len - 16) // 8 + 1)) AS frame FROM sz WHERE len >= 16) USING (sig) WHERE n BETWEEN frame * 8 AND frame * 8 + 15)),
            c AS (SELECT sig, frame, k, sum(x * cos(2 * pi() * ((k * j) % 16) / 16)) AS re, -sum(x * sin(2 * pi() * ((k * j) % 16) / 16)) AS im FROM fr, (SELECT unnest(range(9)) AS k) GROUP BY sig, frame, k),
            m AS (SELECT *, quantile_cont(sqrt(re * re + im * im), 0.5) OVER (PARTITION BY sig, k ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h, quantile_cont(sqrt(re * re + im * im), 0.5) OVER (PARTITION BY sig, frame ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p FROM c),
            y AS (SELECT sig, frame * 8 + j AS n, {hann} AS w, {back(soft('h', 'p'))} AS h, {back(soft('p', 'h'))} AS p FROM m, (SELECT unnest(range(16)) AS j) GROUP BY sig, frame, j),
            o AS (SELECT sig, n, sum(h * w) AS h, sum(p * w) AS p, sum(w * w) AS d FROM y GROUP BY sig, n)
            SELECT es.sig AS signal_id, es.n::INT AS n, round(coalesce(CASE WHEN d >= 1e-6 THEN h / d ELSE h END, 0), 4) + 0.0 AS harmonic, round(coalesce(CASE WHEN d >= 1e-6 THEN p / d ELSE p END, 0), 4) + 0.0 AS percussive FROM es LEFT JOIN o USING (sig, n)""",
    }
