"""Training corpus from raw documents: classify, drop near copies, drop repeated passages, mix, tokenise.

Every stage is written as Parquet below the shared folder and read again by
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import classifier, jaccard, mixing, passages, pieces
from quire.llm.queries import tokenizer
from quire.llm.store import read_table, save


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (10) predicts to be good, by the threshold of its query."""
    model = classifier.train(docs, read_table(spark, sf_dir, "labels"))
    scored = classifier.with_score(docs, model, "_quality_score")
    return scored.where(scored["_quality_score"] >= classifier.THRESHOLD).drop("_quality_score")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join (3): that of the smallest id."""
    return jaccard.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages (6); a document that consists of them alone goes."""
    cleaned = passages.remove_passages(docs)
    return cleaned.where((cleaned["removed_words"] == 0) | cleaned["text"].rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix (7) takes them: repeats are rows of their own."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the encoded and decoded texts (2), a row per document and repeat."""
    return pieces.round_trip_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_encoding),
]

# Classifier and tokens have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
