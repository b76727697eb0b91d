"""A training-data pipeline over documents: toxicity, exact dedup, n-gram Jaccard join, mixing, piece sampling.

Every stage takes (spark, docs, sf_dir) and returns a frame that the next one rereads from Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import exact_dedup, jaccard_join, mixing, piece_sampling, toxicity
from sluice.llm.common import shared_folder, ship
from sluice.llm.queries import TOKENIZERS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; learnt from all labelled rows outside the held-out third.

    Null, empty and blank texts have no evidence and stay; null ids are scored and never learnt from; repeated rows share their fate;
    other columns go; an empty table gives an empty result.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.expr(f"not ({toxicity.HELD_OUT})"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, A-Z folded: the one with the largest id.

    Null and empty texts equal each other; null ids lose to any other; of rows that agree in both one stays; an empty table gives an
    empty result.
    """
    ship(spark)
    return exact_dedup.survivors(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest id.

    Rows are told apart by id and text; null ids come last. Documents without words have no component and stay; an empty table gives an
    empty result.
    """
    ship(spark)
    return jaccard_join.survivors(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same expected share; a row for each copy.

    A null source counts as the empty one; rows without an id share a draw, as rows that repeat an id do; an empty table gives an
    empty result.
    """
    ship(spark)
    return mixing.mix(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, pieces, n_pieces, decoded_sha256, lossless of every document.

    A null or empty text has no pieces; draws are seeded by the id, without one by the text; repeated rows repeat their pieces; an
    empty table gives an empty result.
    """
    ship(spark)
    found = piece_sampling.sample_pieces(docs.select("doc_id", "source", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", "source", "pieces", "n_pieces", "decoded_sha256", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The models of the first stage and the sampled pieces of the last have no SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
