"""A corpus made ready for training, stage by stage: rules, near-duplicates, benchmark passages, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of docs. Null, empty, very long and repeated texts, and columns of any name, have the results that the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, mixing, quality, simhash, tokens
from tillroll.llm._common import discard, materialise
from tillroll.session import ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy does not reject; one pass, no shuffle."""
    ship(spark)
    kept = F.col("failures").bitwiseAND(F.lit(quality.bits(quality.BASE) | quality.bits(quality.POLICIES[quality.CURRENT]))) == 0
    return quality.ledger(docs, keep="row").where(kept).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row with the smallest doc_id, of equal ones the first by hash.

    A group of rows that all lack an id keeps one of them.
    """
    ship(spark)
    return simhash.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; one pass, no shuffle."""
    found = decontaminate.find_contamination(docs, table(ship(spark), sf_dir, "benchmark"), keep="row")
    return decontaminate.contaminated(found).where(~F.col("contaminated")).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights, shuffled over all partitions by hash."""
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards written and read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token shards", token_shards),
]

#: XXH64, connected components and byte-level BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes when the next is
    written, that of the last but one when the shards are."""
    docs, held = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            discard(held)
        held = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
