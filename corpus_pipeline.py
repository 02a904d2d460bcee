"""From raw documents to token files: toxicity, near duplicates, benchmark passages, source mix, token IDs.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``documents``. A document with a null or empty text passes every filter (it is neither toxic nor a copy nor
contaminated) and takes no part in the mix's extra repetitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, mixing, neardup, tokens, toxicity
from lumenfold.llm.scratch import Workspace, drop, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the classifier is trained on their labels."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by similarity 0.8 of five-word shingles."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix of their sources asks."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold, read back from them: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_tokens(spark, tokens.write_tokens(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_token_files),
]

#: A trained classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Workspace(spark) as work:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            work.keep(docs)
        if before is not None:
            drop(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # the token files are written by now
    drop(docs)
    return out
