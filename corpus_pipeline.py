"""A training corpus from raw documents: toxic ones go, near copies go, sources are mixed, the rest is packed.

Each stage takes all that the one before it kept. run() writes what a stage returns to the shared folder and reads it
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, near_dedup, packing, toxicity
from loomgraph.llm.common import materialize, read
from loomgraph.llm.queries import tokenizer


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity grammar doesn't reject; it is fitted on the labels of these documents.

    Null and empty texts stay, repeated rows stay as they are, other columns are kept whatever their names; an empty table stays empty.
    """
    grammar = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).filter("predicted = 0").select(docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group. Texts without words stay, and so do rows without an id; of rows that repeat an id one stays."""
    return near_dedup.dedupe(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands as often as it is drawn, cut to the words drawn; n_chars follows. Texts without words are never drawn; a null source is one of its own."""
    mixed = mixing.mix(docs).select(docs.columns)
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens. Null texts are packed as empty ones, repeated rows each."""
    pieces = packing.pieces(docs, tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash near-dedup", remove_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages' scores, hashes and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
