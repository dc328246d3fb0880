"""What fitting on the driver takes of its memory, and that it gives it back."""

from __future__ import annotations

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from sigspark.llm import toxicity
from sigspark.llm.common import release

SMAPS = Path("/proc/self/smaps_rollup")


def corpus(n: int = 1000, words: int = 550) -> tuple[list[str], list[int]]:
    """Texts of made words, of which every third holds an insult."""
    rng = np.random.default_rng(5)
    made = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k)) for k in rng.integers(3, 10, 20_000)])
    insults = ["blorgface", "snivelrat", "gruntmaw", "tofflewit"]
    texts = [" ".join(made[rng.integers(0, len(made), words)]) for _ in range(n)]
    label = [int(i % 3 == 0) for i in range(n)]
    return [f"{t} {insults[i % 4]}" if y else t for i, (t, y) in enumerate(zip(texts, label, strict=True))], label


def private_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", SMAPS.read_text()))) / 1024


def test_fit_holds_little_for_each_letter():
    texts, label = corpus()
    tracemalloc.start()
    try:
        toxicity.fit(texts, label, rounds=1, clean_windows=500, clean_words=500, landmarks=32)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 13 * sum(map(len, texts)), most / sum(map(len, texts))


@pytest.mark.skipif(not SMAPS.exists(), reason="memory is read from /proc")
def test_fit_gives_back_its_memory(spark):
    texts, label = corpus(1500)
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, strict=True)), "doc_id long, text string").cache()
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int").cache()
    toxicity.fit_on(docs.where("doc_id < 60"), labels, most_toxic=20, most_clean=40)  # so that libraries are loaded
    del texts
    release()
    before = private_mb()
    model = toxicity.fit_on(docs, labels)
    after = private_mb()
    docs.unpersist(), labels.unpersist()
    assert model.info["grams"] >= 4
    assert after - before < 30, (before, after)
