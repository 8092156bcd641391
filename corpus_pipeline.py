"""A corpus run: toxicity, near-dedup, repeated strings, mixing, packing.

Each stage works on all that the one before it kept; between stages the rows are written as
Parquet and read again. The last stage returns the bins, the others rows with the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import minhash_dedup, mixing, packing, suffix_dedup, toxicity
from cohortwise.llm.queries import SOURCE_WEIGHTS, TOXIC_FROM, likely_of
from cohortwise.llm.texts import word_count
from cohortwise.session import shared_path

#: Neither learned lexicons nor run-length indexes are SQL; tests compare with brute force.
ORACLE_SQL = None

#: Shortest repeated string that is cut out: less than any passage of over 50 words has.
REPEAT_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels, does not reject."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, lexicon, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of REPEAT_BYTES bytes that occur elsewhere."""
    return suffix_dedup.drop_repeats(docs, length=REPEAT_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    size = word_count(F.col("text"))
    return mixing.mixed(docs, size, likely=likely_of(size), weights=SOURCE_WEIGHTS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words; copies of a text lie in different bins."""
    return packing.pack(docs, word_count(F.col("text")), F.md5("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
