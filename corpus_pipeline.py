"""The corpus pipeline: five stages over documents, each written and read again before the next.

Language ID drops texts whose language isn't recognised; exact dedup keeps
the row with the largest doc_id of equal texts; the n-gram Jaccard join keeps
the smallest doc_id of each group of near-duplicates; decontamination drops
texts that hold passages of the benchmark; the last stage encodes what is
left, decodes the tokens again, and raises if a byte differs.

Defined cases, stage by stage: a null, empty or letterless text has no
recognised language and goes; equal texts of one doc_id are one row, chosen by
the content of its other columns, as are near copies of one doc_id; rows with a
null doc_id lose to others with the same text, and have no near copies; ties in
size or share don't matter, since doc_ids decide; texts of any length are read
whole; an empty table gives an empty result; columns beyond those of documents
are kept up to the last stage.

Its rows can't be stated in SQL (stages 1, 3, 4 and 5), so ORACLE_SQL is None
and tests hold them against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftspark.llm.bpe import encode_documents
from liftspark.llm.decontaminate import decontaminated
from liftspark.llm.exact_dedup import deduplicated
from liftspark.llm.language_id import accepted
from liftspark.llm.ngram_join import near_deduplicated
from liftspark.llm.queries import ranks_path
from liftspark.llm.storage import fresh, removed, scratch
from liftspark.llm.workers import shrink_heaps


STATES = 30_000  # of the encoder's table: by this stage the executors' heaps are full


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, keep="max")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return near_deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids (little-endian unsigned 32-bit integers)."""
    shrink_heaps(spark)
    return encode_documents(docs, ranks_path(), with_ids=True, states=STATES)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage has written goes once the next one's rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            after = fresh(spark, name, lasting=True)
            stage(spark, docs, sf_dir).write.parquet(after)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(after), after
    return STAGES[-1][1](spark, docs, sf_dir)
