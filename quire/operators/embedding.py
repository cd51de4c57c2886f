"""Vectors for chunks and questions: hashed n-grams with tf-idf weights, or a caller's model.

Counts are made once per text, as a sparse column (`buckets`, `counts`) that is
stored with the text; document frequencies, weights and vectors come from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quire import fixed
from quire.functions import ngrams
from quire.functions import vectors as V
from quire.session import scratch_path

Embedder = Callable[[list[str]], list[list[float]]]


def with_counts(texts: DataFrame, text_col: str, dim: int = fixed.EMBEDDING_DIM, whole: bool = False) -> DataFrame:
    """The rows with `buckets` (ascending) and `counts` of each text's hashed words and word pairs; null for a null text.

    With ``whole`` every pair is hashed as a text of its own, else its number comes from its words' numbers; vectors compare within one kind.
    """
    if "buckets" in texts.columns and "counts" in texts.columns:
        return texts
    kind = ST.ArrayType(ST.IntegerType())
    schema = ST.StructType([*texts.schema.fields, ST.StructField("buckets", kind), ST.StructField("counts", kind)])
    return texts.mapInArrow(lambda batches: ngrams.sparse_batches(batches, text_col, dim, whole), schema)


def _stored(counted: DataFrame) -> DataFrame:
    """Counts as a table in the shared folder: read for the frequencies and again for the weights."""
    path = scratch_path(counted.sparkSession, "counts")
    counted.write.parquet(path)
    return counted.sparkSession.read.schema(counted.schema).parquet(path)


def hash_ngrams(texts: DataFrame, id_col: str, text_col: str, dim: int = fixed.EMBEDDING_DIM, whole: bool = False) -> DataFrame:
    """(id, bucket, count) rows of each text's hashed words and word pairs."""
    counted = with_counts(texts.select(id_col, text_col), text_col, dim, whole)
    return counted.select(id_col, F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select(
        id_col, F.col("p.buckets").alias("bucket"), F.col("p.counts").alias("count")
    )


def bucket_frequencies(counted: DataFrame) -> DataFrame:
    """(bucket, df): in how many counted texts each bucket occurs; bucket -1 counts the texts. Tables of several batches add up."""
    rows = counted.where("buckets is not null").select(F.explode(F.concat(F.array(F.lit(-1)), "buckets")).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("df"))


def inverse_frequencies(frequencies: DataFrame, dim: int = fixed.EMBEDDING_DIM) -> np.ndarray:
    """The smoothed idf of every bucket. The sums have one row a bucket, so they may pass through the driver."""
    df = np.zeros(dim + 1)
    for r in frequencies.where(F.col("bucket").between(-1, dim - 1)).groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r.bucket] = r.df  # -1 is the last place
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def _weighted(counted: DataFrame, idf: np.ndarray | None, name: str, dim: int | None) -> DataFrame:
    schema = ST.StructType([*counted.schema.fields, ST.StructField(name, ST.ArrayType(ST.DoubleType()))])
    return counted.mapInArrow(lambda batches: ngrams.weight_batches(batches, idf, name, dim), schema)


def tfidf_vectors(
    texts: DataFrame,
    text_col: str,
    frequencies: DataFrame | None = None,
    dim: int = fixed.EMBEDDING_DIM,
    name: str = "embedding",
    whole: bool = False,
) -> DataFrame:
    """Add unit-length tf-idf vectors (zero for a text without words, null for a null one).

    Document frequencies come from these texts, or from ``frequencies`` kept from
    others so that vectors of several batches can be compared. Texts that carry
    their counts already are not hashed again.
    """
    counted = with_counts(texts, text_col, dim, whole)
    if frequencies is None:
        counted = counted if "buckets" in texts.columns else _stored(counted)
        frequencies = bucket_frequencies(counted)
    dense = _weighted(counted, inverse_frequencies(frequencies, dim), name, dim)
    return dense.select(*texts.columns, name)


def tfidf(texts: DataFrame, id_col: str, text_col: str, dim: int = fixed.EMBEDDING_DIM) -> DataFrame:
    """Non-zero weights as (id, bucket, weight)."""
    counted = _stored(with_counts(texts.select(id_col, text_col), text_col, dim).select(id_col, "buckets", "counts"))
    weights = _weighted(counted, inverse_frequencies(bucket_frequencies(counted), dim), "weights", None)
    return weights.select(id_col, F.explode(F.arrays_zip("buckets", "weights")).alias("p")).select(
        id_col, F.col("p.buckets").alias("bucket"), F.col("p.weights").alias("weight")
    )


def embed_queries(queries: DataFrame, text_col: str = "query", dim: int = fixed.EMBEDDING_DIM, whole: bool = False) -> DataFrame:
    """Question vectors: a batch of one has idf 1 everywhere, so these are unit counts; empty text is zero."""
    rows = queries.drop("embedding", "buckets", "counts")
    return _weighted(with_counts(rows, text_col, dim, whole), None, "embedding", dim).drop("buckets", "counts")


def l2_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, V.unit(F.col(column)))


def embed_chunks(
    chunks: DataFrame,
    embedder: Embedder | None = None,
    frequencies: DataFrame | None = None,
    text_col: str = "content",
    batch_size: int = 32,
    whole: bool = False,
) -> DataFrame:
    """Chunks with vectors from a caller's model, in batches, or tf-idf when none is given."""
    if embedder is None:
        return tfidf_vectors(chunks, text_col, frequencies, whole=whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(frame), batch_size):
                part = frame[text_col].iloc[at : at + batch_size].tolist()
                vectors.extend([float(x) for x in v] for v in embedder(part))
            frame["embedding"] = vectors
            yield frame

    schema = ST.StructType([*chunks.schema.fields, ST.StructField("embedding", ST.ArrayType(ST.DoubleType()))])
    return chunks.mapInPandas(run, schema)
