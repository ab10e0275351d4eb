"""A corpus pipeline of five stages over ``documents``: language ID, near-duplicate removal, benchmark
decontamination, mixing to target weights and sharding.

Each stage takes all rows that its predecessor wrote.

=================  ==============================================================================================
language_id        texts without a letter go (null and empty ones too); a null ``lang`` becomes the identified language, and
                   stays null only if none could be learned; a ``lang`` that is given stays
ngram_jaccard      of each group of near duplicates the smallest doc_id stays; texts without a word are no duplicates;
                   of rows of one doc_id one stays, of rows without doc_id one for each text
decontamination    documents that hold a benchmark item go; a null or blank item, and an empty benchmark, remove none
source_mix         every row is taken 0 to 2 times, whole, to the nearest; a null source is a source; rows without words go
shards             rows are laid out by shard, which is added beside the columns of documents (``n_bytes``, ``shard``,
                   ``depth``, ``shard_bytes``, ``oversize``; columns of these names give way)
=================  ==============================================================================================

Ties are settled by doc_id and by hashes, so a rerun gives the same rows; equal rows are interchangeable.  An empty table
passes through all stages.  Extra columns pass through, whatever their names.

Stages whose functions run in Python limit the session's Arrow batches to ``BATCH`` bytes (one row at least), whatever rows
they hold.  The rows that a stage returns are still to be read, so the limit stays; ``through`` restores the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialbook.llm import decontaminate, jaccard, language, mixing, sharding
from trialbook.llm.common import discard, scratch_dir

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Every task holds its batch in the JVM and in a Python worker, some times over while buffers double, and neither gives all of it back.
BATCH = 1 << 20


def _bounded(spark: SparkSession) -> None:
    own = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(BATCH_BYTES, min(own, BATCH) if own > 0 else BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    model = language.fit(docs, ~language.held_out())
    return language.lettered(docs) if model is None else language.recognized(docs, model, into="lang")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.laid_out(sharding.shard(docs, keep=docs.columns))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Kernel regression and fuzzy matching have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again, and then the one before it is removed."""
    folder, before, own = scratch_dir(spark, "pipeline"), None, spark.conf.get(BATCH_BYTES)
    try:
        for k, (name, stage) in enumerate(STAGES):
            at = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(at)
            docs = spark.read.parquet(at)
            if before is not None:
                discard(spark, before)
            before = at
    finally:
        spark.conf.set(BATCH_BYTES, own)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole table ``documents``."""
    return through(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
