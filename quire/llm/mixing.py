"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import running, save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order (null last) take the weights in turn and divide
    `share` of all words; a target stops at `cap` times its source and the
    excess goes to the others by weight until none is above. The end of that
    resharing is one level: target = min(cap * size, weight * level). With
    sources in ascending order of cap * size / weight, the level follows from
    running sums: it is that of the first source which the level leaves below its cap.
    """
    totals = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "sources")
    ranked = running(totals, [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    weighed = save(weighed.withColumn("ratio", F.col("most") / F.col("weight")), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, weight_sum = (whole["size"] or 0) * share, whole["weight"] or 0
    below = running(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], ["most", "weight"])
    level = (F.lit(float(budget)) - F.col("most_before")) / (F.lit(weight_sum) - F.col("weight_before"))
    first = below.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "weight_before")).alias("level")).first()
    target = F.col("most").cast("double")
    if first["level"] is not None:
        target = F.least(target, F.col("weight") * F.lit(first["level"]))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Every document gets a hash-random key; within its source the documents
    follow in key order, and a prefix sum of their sizes says where the budget
    (the rounded target) ends. Whole epochs are taken first; in the last one the
    document at the cut gives exactly the words that are left. Null texts have
    size 0, null sources are one source, null ids and repeated rows are
    documents like others, extra columns are ignored. An empty table gives an empty result.
    """
    sizes = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key")), "sizes")
    ordered = running(sizes, [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")], ["size"], ["source"])
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return ordered.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken")
    )


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, in their own columns.

    A document taken n whole times and then for k words gives n copies and one
    more whose text ends with its k-th word. Documents of no words are kept once.
    `taken` is the result of mix(); ids are expected to be unique and not null,
    rows of repeated ids are matched once each through their size.
    """
    plan = taken.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.max("taken").alias("_taken"))
    sized = docs.withColumn("_words", word_count(F.col("text")))
    rows = sized.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")))
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(1).cast("int")
    rows = rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    units = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(units, F.lit(1), left.cast("int")), "")
    text = F.when((F.col("_size") > 0) & (left < F.col("_size")), cut).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
