"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what the next one works on.

Toxic documents go; lines that repeat an earlier line go, and with them documents of which nothing is left; of each group
of near-duplicates one document stays; documents that hold enough of a benchmark item go; the rest is encoded, and its ids
are decoded to prove them. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe, decontam, linededup, simhash, toxicity
from sigspark.llm.common import remove, shared_dir
from sigspark.llm.queries import tokenizer_path, tokenizer_pattern


def small_batches(spark: SparkSession) -> None:
    """Whole texts pass through the Python stages: fewer rows at a time keep an executor's buffers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from labelled rows of this input."""
    small_batches(spark)
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, and n_chars of what is left; a document that loses all it had goes."""
    out = linededup.dedup(docs).where("n_dropped = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words."""
    small_batches(spark)
    return simhash.keep_one(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), keep=["doc_id"], prove=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: The first stage is a trained model, which SQL cannot express; the tests hold the others against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again.

    What a stage wrote is deleted once the next one is written, and the session's size of batches is as before; the last
    stage's files stay, since the result is read from them.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    folder, before, old = shared_dir(spark), spark.conf.get(setting), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            if old:
                remove(spark, old)
            docs, old = spark.read.parquet(path), path
    finally:
        spark.conf.set(setting, before)
    return docs
