"""Quality rules whose cutoffs are chosen on labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import save
from quire.llm.words import mixed, slices, windows

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A rule compares one share in 0..1 with its cutoff; higher is worse.
RULES = ("symbols", "dup_lines", "repeats", "same_words", "capitals", "marks")
STEPS = 200
#: Cutoffs are tightened together in so many rungs, from 1 to these shares, which no data set.
RUNGS = 200
STRICTEST = {"symbols": 0.01, "dup_lines": 0.05, "repeats": 0.05, "same_words": 0.3, "capitals": 0.03, "marks": 0.01}
#: The cutoff of each rule in steps on rung 0 (rejects nothing) to RUNGS.
LADDER = {rule: [math.floor(STEPS * STRICTEST[rule] ** (j / RUNGS) + 1e-9) for j in range(RUNGS + 1)] for rule in RULES}
#: At most this share of good documents may fall to all rules together, in every stratum,
FALSE_REJECTION = 0.05
#: except with this probability over the labelled rows.
RISK = 0.05

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_marks")


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of _COUNTS."""
    words = text.split()
    n = len(words)
    inner = b"".join(words)
    letters = np.frombuffer(inner, np.uint8)
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    order = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    found = windows(mixed(np.arange(len(seen), dtype=np.uint64) + np.uint64(1))[order], WINDOW)
    repeated = 0
    if len(found):
        _, back, times = np.unique(found, return_inverse=True, return_counts=True)
        start = np.flatnonzero(times[back] > 1)
        edges = np.zeros(n + 1, np.int64)
        edges[start] += 1
        edges[start + WINDOW] -= 1
        repeated = int(np.count_nonzero(np.cumsum(edges)))
    return (
        n, len(inner.decode()), sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(seen),
        int(np.count_nonzero((letters >= 65) & (letters <= 90))), text.count(b"!"),
    )


def count_texts(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, text_key (a hash of the text) and the counts of every whole text (null: all 0)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts = zip(*map(text_counts, texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(c, pa.int64()) for c in counts]], ["doc_id", "stratum", "text_key", *_COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    return columns.mapInArrow(rows, f"doc_id {kind}, stratum string, text_key long, " + ", ".join(f"{c} long" for c in _COUNTS))


def _steps(rule: str) -> Column:
    """The rule's share in whole steps, rounded up: it exceeds cutoff j exactly if the step is above j."""
    over, under = {
        "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
        "same_words": ("n_words - n_distinct", "n_words"), "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "n_words"),
    }[rule]
    share = F.expr(f"({over}) * {STEPS} / greatest({under}, 1)")
    return F.least(F.ceil(share), F.lit(STEPS)).cast("int")


def allowed_failures(n: int, rate: float, risk: float) -> int:
    """Largest k with P(Binomial(n, rate) <= k) <= risk; -1 if there is none.

    With k rejections or fewer among n good rows, the exact binomial test
    refuses, at level `risk`, that the true rejection rate is `rate` or more.
    """

    def tail(k: int) -> float:
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
        total, term = 1.0, 1.0
        while k and term > 1e-18 * total:
            term *= k * (1 - rate) / ((n - k + 1) * rate)
            total, k = total + term, k - 1
        return math.exp(log) * total

    low, high = -1, int(n * rate)
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if tail(k) <= risk else (low, k - 1)
    return low


def choose_rungs(good: DataFrame, false_rejection: float = FALSE_REJECTION, risk: float = RISK) -> DataFrame:
    """(stratum, n_good, rung, the cutoff of each rule in steps) from the good holdout rows with a step per rule.

    In every stratum the rungs of LADDER are tested in order from the loosest on. A
    rung counts the good rows that any of its cutoffs rejects; it passes if an exact
    binomial test shows a rejection rate below the whole `false_rejection`. The last
    that passes is taken: a fixed order needs no correction along the rungs or over the
    rules; across strata `risk` is divided by their number (Bonferroni). A null
    rung means that even no rejected row would not pass: all rules are off there.
    """
    totals = save(good.groupBy("stratum").agg(F.count("*").alias("n_good")), "strata")
    level = risk / max(1, totals.count())

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(most=[allowed_failures(int(n), false_rejection, level) for n in frame["n_good"]])

    limits = totals.mapInPandas(bounds, "stratum string, n_good long, most long")
    limits = limits.withColumnRenamed("stratum", "_stratum")
    # the first rung that rejects each number of steps; RUNGS + 1 if none does
    first = {r: [sum(cut >= step for cut in LADDER[r]) for step in range(STEPS + 1)] for r in RULES}
    rung = F.least(*[F.element_at(F.lit(first[r]), F.col(r) + 1) for r in RULES])
    found = good.select("stratum", rung.alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))
    below = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tails = found.withColumn("rejected", F.sum("n").over(below)).join(limits, F.col("stratum").eqNullSafe(F.col("_stratum")))
    blocked = F.min(F.when((F.col("rejected") > F.col("most")) & (F.col("step") <= RUNGS), F.col("step")))
    chosen = F.when(F.max("most") >= 0, F.coalesce(blocked - 1, F.lit(RUNGS)))
    chosen = tails.groupBy("stratum").agg(F.max("n_good").alias("n_good"), chosen.cast("int").alias("rung"))
    return chosen.select("*", *[F.when(F.col("rung").isNotNull(), F.element_at(F.lit(LADDER[r]), F.col("rung") + 1)).alias(r) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", false_rejection: float = FALSE_REJECTION, risk: float = RISK) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the stratum and the rules that rejected, one row per input row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. Other documents are kept if no rule of their stratum exceeds
    its cutoff (choose_rungs). The holdout is every labelled row, equal texts of a stratum once
    (the bound is for independent ones): a document is good if all its
    labels say quality 1; null labels and ids count for nothing. Null texts have no words
    (base_failed), a null stratum is one of its own, extra columns are ignored.
    """
    counted = save(count_texts(docs, stratum), "counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = counted.select("*", failed.alias("base_failed"), *[_steps(r).alias(r) for r in RULES])
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    holdout = rows.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id", "left_semi")
    holdout = holdout.dropDuplicates(["stratum", "text_key"]).select("stratum", *RULES)
    cutoffs = save(choose_rungs(holdout, false_rejection, risk), "cutoffs")
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"{r}_cut") for r in RULES])
    both = rows.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    broken = F.filter(F.array(*[F.when(F.col(r) > F.col(f"{r}_cut"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return both.select(
        "doc_id", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), "stratum", broken.alias("broken_rules")
    )
