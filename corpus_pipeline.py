"""From raw documents to token ids: filter, deduplicate, mix and encode, one written table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import bpe, mixing, quality, simhash, toxicity
from notewell.llm.common import discard, prepare, scratch, table
from notewell.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic (score below 0.5), all their columns.

    Trained on the stage's own documents that have labels and whose crc32(doc_id) mod 5 is not 0. Null and empty texts stay. Repeated rows
    stay or go together. An empty table, or one without labels, gives what the fixed lexicon leaves of it.
    """
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are predicted good (score 0.3 or more), all their columns.

    Trained like the stage before. Null and empty texts are judged as one empty passage. Without labels every score is one half and all
    documents stay.
    """
    prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, all its columns; null ids come last, ties go by the text.

    Null and empty texts are one group. Of rows that repeat, one stays.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, all its columns.

    Null is a source of its own; texts without words are taken at their source's rate; repeated rows draw alike.
    """
    prepare(spark)
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the decoded text, for each mixed copy.

    Null and empty texts have no ids, and digests of the empty string.
    """
    prepare(spark)
    return bpe.encode(docs, vocabulary_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash near-dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models, 64-bit hashes and the vocabulary are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one is the result and stays.
    """
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
