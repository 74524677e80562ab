"""From raw documents to tokens: quality, near-duplicates, test items, personal data, BPE.

Each stage takes the documents its predecessor kept and returns those it keeps, with the columns
of documents; the last returns their tokens. Between stages the rows are written as Parquet and
read again, so that no stage depends on the executors of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glasspane.llm import bpe, decontaminate, pii, quality, simhash
from glasspane.llm.common import release, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest-neighbour voting scores at least 0.5."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), quality.remainder(3) != 1)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates; unlike texts of one
    doc_id are different documents."""
    return simhash.deduplicated(docs)


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in text replaced."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text they decode to, and the ids."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_first_of_group),
    ("benchmark_decontamination", keep_untested),
    ("pii_redaction", hide_personal_data),
    ("byte_bpe", tokens),
]

#: SQL has no such classifier, fingerprint or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
