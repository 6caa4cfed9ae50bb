"""A corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  Toxic documents go; one
document of each near-duplicate group stays; of a passage that repeats across
documents only the first stays in the texts; sources are mixed to their target
weights; the mixed texts are packed.  All but the last return the columns of
documents.

Near duplicates are those of similarity 0.8 or more on five-word shingles; at
0.8, 30 bands of five miss a link with a probability of 7e-6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelens.llm import chunk_dedup, mixing, near_dedup, packing, toxicity
from lurelens.llm.common import materialize, table
from lurelens.llm.queries import vocabulary

NEAR_THRESHOLD, NEAR_BANDS = (80, 100), 30


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.  The lexicon is
    learned from the labelled rows of ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return near_dedup.drop_near_duplicates(docs, threshold=NEAR_THRESHOLD, bands=NEAR_BANDS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated passages."""
    return chunk_dedup.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each source up to its target."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths.  The mix repeats documents, so pieces of
    one document occur as often as it does."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned lexicon nor the merges of the tokenizer;
#: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

