"""Running values along a document, split into blocks so that no document has to fit in one task.

A plain window over ``partitionBy(doc_id)`` sends a whole document to one task.
Here every document is cut into blocks of consecutive positions, the window
runs inside (document, block), and a second, tiny window over one summary row
per block brings in what earlier blocks left behind. The summary of documents
that fit in a single block is dropped before the join, so for ordinary
documents the join side is (nearly) empty and turns into a broadcast or
disappears at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def pos_block(pos: str = "pos", size: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / size)


def reading_block(size: int = BLOCK) -> Column:
    """Blocks along (page_number, reading_order): one or more per page."""
    return F.struct(
        F.col("page_number").alias("page"), F.floor(F.col("reading_order") / size).alias("part")
    )


def running_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    block: Column | str | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add, for each named value, the latest non-null one at (or strictly before) each row.

    ``block`` may name a column of the rows; grouping the result by it and the keys then takes no further shuffle.
    """
    names = list(values)
    at_block = block if isinstance(block, str) else "_block"
    own = [] if isinstance(block, str) else [(pos_block(order[0]) if block is None else block).alias("_block")]
    marked = df.select("*", *own, *[v.alias(f"_v_{n}") for n, v in values.items()])
    upto = (Window.partitionBy(*keys, at_block).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    at = F.struct(*[F.col(c) for c in order])
    tails = marked.groupBy(*keys, at_block).agg(
        *[F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(at.alias("at"), F.col(f"_v_{n}").alias("v")))).alias(n)
          for n in names]
    )
    earlier = Window.partitionBy(*keys).orderBy(at_block).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.select(*keys, at_block, *[F.last(F.col(f"{n}.v"), ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names])
        .where(F.coalesce(*[F.col(f"_c_{n}").cast("string") for n in names]).isNotNull())
    )
    local = marked.select(
        *df.columns, *(["_block"] if own else []),
        *[F.last(F.col(f"_v_{n}"), ignorenulls=True).over(upto).alias(f"_l_{n}") for n in names],
    )
    return local.join(carried, [*keys, at_block], "left").select(
        *[local[c] for c in df.columns],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in names],
    )


def next_row(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: Column) -> DataFrame:
    """Add the value of the following row; the last row of a block looks at the next block's first."""
    marked = df.select("*", block.alias("_block"), value.alias("_v"))
    heads = marked.groupBy(*keys, "_block").agg(
        F.min(F.struct(*[F.col(c) for c in order], F.col("_v"))).alias("head")
    )
    following = heads.select(
        *keys, "_block", F.lead("head._v").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next_head")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = marked.withColumn("_next", F.lead("_v").over(inside))
    return local.join(following, [*keys, "_block"], "left").select(
        *[local[c] for c in df.columns], F.coalesce("_next", "_next_head").alias(name)
    )
