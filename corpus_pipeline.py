"""From raw documents to packed sequences: toxic documents go, of near-duplicates one stays, secrets
are replaced, sources are mixed to their targets, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm import mixing, packing, secrets, simhash, toxicity
from rolesieve.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labels, scores below one half.

    Null and empty texts score as the bias says, which is near 0, and stay; equal texts fare alike,
    repeated rows stay repeated, other columns may have any name, an empty table gives an empty one.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("__doc"), toxicity.score(F.col("text"), model).alias("__score"))
    return rows.where("__score < 0.5").select("__doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that fingerprints of three-word shingles link at two differing bits or fewer,
    the row with the smallest id stays.

    Null ids come last, equal ids go by content, so of repeated rows one stays. Null texts and texts
    without words form one group. Other columns may have any name; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span that a rule finds replaced by the rule's name.

    Null texts stay null, repeated rows stay repeated, other columns may have any name.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none more than three times.

    Texts without words are never taken; a null source is a source of its own; repeated rows count
    one by one; other columns may have any name; an empty table gives an empty one.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that hold them.

    A null text is an empty one and gives its closing id alone; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", replace_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Scores, fingerprints and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
