"""Factors of frames in rows, against the factorisation of one matrix."""

import time

import numpy as np
import pytest

from sigspark.functions import models
from sigspark.meta import SpecMeta, Stage
from sigspark.operators import factors


def stage(spark, parts):
    data = [(k, f, f / 10, row.tolist()) for k, v in parts.items() for f, row in enumerate(v)]
    df = spark.createDataFrame(data, "signal_id string, frame int, t double, spec array<double>").repartition(5)
    nb = len(next(iter(parts.values()))[0]) if parts else 9
    return Stage(df, SpecMeta("stft", 16, 16, 8, nfft=16, freq=tuple(range(nb))))


@pytest.fixture(scope="module")
def parts():
    r = np.random.default_rng(3)
    return {k: r.random((n, 2)) @ r.random((2, 9)) + 0.01 * r.random((n, 9)) for k, n in (("a", 90), ("b", 12))}


@pytest.mark.parametrize(("divergence", "init", "norm"), [("kl", "ramps", "max"), ("kl", "nndsvd", "l1"), ("euclidean", "nndsvd", "l2"), ("is", "ramps", "max")])
def test_same_as_one_matrix(spark, parts, divergence, init, norm):
    gains, spectra, history = factors.nmf(stage(spark, parts), 2, divergence, max_iter=12, thresh=0, norm=norm, init=init, every=5)
    got = {(r["signal_id"], r["component"]): r["spectrum"] for r in spectra.collect()}
    rows = gains.orderBy("signal_id", "frame").collect()
    for k, v in parts.items():
        w, h = models.nmf(v.T, 2, divergence, 12, 0, norm, init)
        np.testing.assert_allclose(np.array([got[k, c] for c in range(2)]).T, w, rtol=1e-6, atol=1e-8)
        own = [r for r in rows if r["signal_id"] == k]
        assert [r["frame"] for r in own] == list(range(len(v)))
        np.testing.assert_allclose(np.array([r["gains"] for r in own]), h.T, rtol=1e-6, atol=1e-8)
    assert len(history) == 12


def test_the_divergence_falls_and_each_signal_ends(spark, parts):
    began = time.time()
    gains, spectra, history = factors.nmf(stage(spark, parts), 2, thresh=0.02)
    for k in parts:
        cost = [h[k] for h in history if k in h]
        assert all(b <= a * (1 + 1e-9) for a, b in zip(cost[1:], cost[2:], strict=False)) and cost[-1] < cost[0]
        assert len(cost) < 300
    assert len({len([h for h in history if k in h]) for k in parts}) == 2  # not in the same round
    assert gains.count() == 102 and spectra.count() == 4
    assert time.time() - began < 300


def test_odd_factors(spark, parts):
    with pytest.raises(ValueError, match="no factors"):
        factors.nmf(stage(spark, parts), 10)
    with pytest.raises(ValueError, match="below 0"):
        factors.nmf(stage(spark, {"a": -parts["a"]}), 2)
    with pytest.raises(ValueError, match="divergence"):
        factors.nmf(stage(spark, parts), 2, "other")
    gains, spectra, history = factors.nmf(stage(spark, {}), 2, max_iter=3)
    assert gains.count() == 0 and spectra.count() == 0 and len(history) == 1
    silent = factors.nmf(stage(spark, {"z": np.zeros((6, 9))}), 2, max_iter=3)
    assert np.isfinite([r["gains"] for r in silent[0].collect()]).all()
