"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:
toxic documents go, exact copies go, one document of each near-duplicate group
stays, sources are mixed to target weights (documents are left out or repeated),
and what is left is encoded. All stages but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.

Defined results: null texts count as empty; empty texts are scored like others, are
copies of each other, and resemble nothing; of equal texts the longest row with the
smallest id stays, null ids last, one row even where rows repeat each other; near
copies leave the row with the smallest id; a null source is a source; columns
named like a column of a later stage stay until the last stage, which returns its own; an
empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import exact_dedup, mix, sentencepieces, simhash, toxicity
from hearthlake.session import write_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3; the network is fitted on the labelled ones."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net, threshold=0.3)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, blanks aside."""
    return exact_dedup.drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that resembles in 0.8 of its shingles of five words."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources (weights 1, 2, 3 in turn) takes them."""
    return mix.take_mix(docs, weights=(1, 2, 3), max_repeats=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its three best segmentations."""
    rows = sentencepieces.encode(docs.select("doc_id", "source", "lang", "text"), n=3)
    return rows.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Toxicity, SimHash and the lattice cannot be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs)
    return docs
