"""From raw documents to token digests: language, near duplicates, source mix, BPE.

``run`` applies the stages to ``documents``; what a stage returns is written to
the shared folder and read again by the next one, so a lost executor costs at
most one stage. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.llm import bpe, language, mixing, near_duplicates
from jobtrail.llm.queries import tokenizer_path
from jobtrail.llm.shared import fresh_folder

# A document stays if one language has at least this share of its words.
LEAST_SHARE = 0.4
# Sources are weighted by this power of their bytes; the output is as large as the input.
MIX_POWER, MIX_EPOCHS, MIX_SEED = 0.5, 1.0, 7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled ones; texts without letters or of no main language go."""
    found = language.with_language(docs, language.fit(docs), lang_column="_lang", score_column="_share")
    kept = (F.col("_lang") != language.UNKNOWN) & (F.col("_share") >= LEAST_SHARE)
    return found.where(kept).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that of the smallest id."""
    dropped = near_duplicates.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, globally shuffled."""
    return mixing.poisson_mix(docs, power=MIX_POWER, epochs=MIX_EPOCHS, seed=MIX_SEED).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row per document of the mix."""
    return bpe.encode_and_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("bpe", bpe_stage),
]

# Fields, gradients and BPE merges are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
