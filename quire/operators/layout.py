"""Page regions, and captions of figures and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import classify, geometry
from quire.functions import text as T
from quire.operators.folds import ordered_fold
from quire.session import prepared, stored

BOX = ["x0", "y0", "x1", "y1"]


def classify_regions(elements: DataFrame) -> DataFrame:
    return elements.withColumn(
        "region_type",
        geometry.region_type(F.col("element_type"), F.col("content"), F.col("y0"), F.col("y1"), F.col("font_size")),
    )


def _merging(gap: float):
    """Marks the rows that begin a merged region; the state is its type and its bottom edge so far."""

    def step(state, types, tops, bottoms):
        kind, bottom = state or (None, None)
        marks = []
        for t, top, low in zip(types, tops, bottoms):
            boxed = top is not None and low is not None
            joins = boxed and bottom is not None and t == kind and abs(top - bottom) <= gap
            marks.append(int(not joins))
            kind, bottom = t, (max(bottom, low) if joins else low if boxed else None)
        return marks, [kind, bottom]

    return step


def merge_regions(regions: DataFrame, gap: float = fixed.REGION_GAP, pieces: int | None = None) -> DataFrame:
    """Join vertically adjacent regions of one type on a page.

    Regions are taken by (y0, list position); one joins the merged region in
    front when both have boxes and its top is within ``gap`` of that one's bottom edge.
    A page may lie in any number of tasks (see folds).
    """
    if "confidence" not in regions.columns:
        regions = regions.withColumn("confidence", F.lit(1.0))
    placed = regions.withColumn("_top", F.coalesce("y0", F.lit(0.0)))
    started = ordered_fold(placed, ["doc_id", "page_number"], ["_top", "pos"], ["region_type", "y0", "y1"], _merging(gap), pieces)
    return started.groupBy("doc_id", "page_number", F.col("ord").alias("region_ord")).agg(
        F.first("region_type").alias("region_type"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min("confidence").alias("confidence"),
        F.count("*").alias("n_elements"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_top", "pos"))), lambda e: F.concat_ws(":", F.col("doc_id"), e["pos"])
        ).alias("element_ids"),
    )


def _nearest(things: DataFrame, captions: DataFrame, thing_id: str) -> DataFrame:
    """Nearest caption of each thing on its page by vertical distance, ties to list order.

    The distance is the smaller of |caption top - thing bottom| and |thing top -
    caption bottom|, so the winner is among four neighbours: the closest caption
    edge above and below each of the two thing edges. Edges of one page are put
    on a line once and read with running values; caption-thing pairs are never
    formed. Captions sharing an edge collapse to the first one beforehand.
    """
    page = ["doc_id", "page_number"]

    def edges(caption_edge: str, thing_edge: str) -> DataFrame:
        marks = captions.groupBy(*page, F.col(caption_edge).alias("at")).agg(F.min("pos").alias("pos")).select(
            *page, "at", F.struct(F.col("at").alias("edge"), "pos").alias("mark"), F.lit(None).cast("string").alias("thing")
        )
        asks = things.select(
            *page, F.col(thing_edge).alias("at"), F.lit(None).cast("struct<edge:double,pos:bigint>").alias("mark"),
            F.col(thing_id).alias("thing"),
        )
        line = marks.withColumn("mark", F.col("mark").cast("struct<edge:double,pos:bigint>")).unionByName(asks)
        # marks sort before questions at the same place, so an exact hit is seen from above
        above = Window.partitionBy(*page).orderBy("at", F.col("thing").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        below = Window.partitionBy(*page).orderBy(F.desc("at"), F.col("thing").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        seen = line.select(
            "*", F.last("mark", ignorenulls=True).over(above).alias("up"), F.last("mark", ignorenulls=True).over(below).alias("down")
        ).where("thing is not null")
        option = lambda m: F.when(F.col(m).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{m}.edge")).alias("distance"), F.col(f"{m}.pos").alias("pos")))
        return seen.select(*page, F.col("thing").alias(thing_id), F.least(option("up"), option("down")).alias("best"))

    both = edges("y0", "y1").unionByName(edges("y1", "y0"))
    return both.groupBy(*page, thing_id).agg(F.min("best").alias("best")).where("best is not null").select(
        *page, thing_id, "best.distance", F.col("best.pos").alias("caption_pos")
    )


def _names_figure() -> Column:
    content = F.col("content")
    return (F.col("element_type") == "caption") | (
        F.contains(F.lower(F.substring(content, 1, 15)), F.lit("fig")) & F.substring(content, 1, 20).rlike(r"\p{Nd}")
    )


def _names_table() -> Column:
    return (F.col("element_type") == "caption") | F.col("content").rlike(fixed.TABLE_START)


def caption_candidates(elements: DataFrame) -> DataFrame:
    """All elements that figures and tables are paired with. Stored, they stand for the elements there, whose texts are then read once."""
    return elements.where(_names_figure() | _names_table())


@prepared
def pair_figure_captions(figures: DataFrame, elements: DataFrame, limit: float = 0.15) -> DataFrame:
    """Figures with the caption nearest to them on their page, closer than ``limit`` of its height."""
    captions = elements.where(_names_figure()).where("y0 is not null")
    best = _nearest(figures.where("y0 is not null"), captions, "figure_id").where(F.col("distance") < limit)
    texts = captions.select("doc_id", "page_number", F.col("pos").alias("caption_pos"), F.col("content").alias("_found"))
    found = best.join(texts, ["doc_id", "page_number", "caption_pos"]).select("figure_id", "doc_id", "_found")
    return (
        figures.join(found, ["doc_id", "figure_id"], "left")
        .withColumn("caption", F.coalesce("_found", "caption"))
        .withColumn("figure_type", F.coalesce(classify.figure_type(F.col("caption")), F.col("figure_type")))
        .drop("_found")
    )


@prepared
def pair_table_captions(tables: DataFrame, elements: DataFrame) -> DataFrame:
    """Tables with the nearest caption of their page, at any distance; their own when there is none.

    A caption or table without a box counts as 0.05 away.
    """
    captions = elements.where(_names_table())
    page = ["doc_id", "page_number"]
    boxed = _nearest(tables.where("y0 is not null"), captions.where("y0 is not null"), "table_id")
    unboxed_caption = captions.where("y0 is null").groupBy(*page).agg(F.min("pos").alias("caption_pos"))
    first_caption = captions.groupBy(*page).agg(F.min("pos").alias("caption_pos"))
    flat = F.lit(0.05).alias("distance")
    options = (
        boxed.unionByName(tables.where("y0 is not null").join(unboxed_caption, page).select(*page, "table_id", flat, "caption_pos"))
        .unionByName(tables.where("y0 is null").join(first_caption, page).select(*page, "table_id", flat, "caption_pos"))
    )
    best = options.groupBy(*page, "table_id").agg(F.min(F.struct("distance", "caption_pos")).alias("b")).select(
        *page, "table_id", "b.caption_pos"
    )
    texts = captions.select(*page, F.col("pos").alias("caption_pos"), F.col("content").alias("_found"))
    found = best.join(texts, [*page, "caption_pos"]).select("doc_id", "table_id", "_found")
    return tables.join(found, ["doc_id", "table_id"], "left").withColumn("caption", F.coalesce("_found", "caption")).drop("_found")


def table_captions(blocks: DataFrame) -> DataFrame:
    """Blocks that are table captions, as one line of text."""
    text = T.strip(F.col("content"))
    return blocks.where(classify.is_table_caption(text)).withColumn("caption", F.replace(text, F.lit("\n"), F.lit(" ")))


def filter_figures(images: DataFrame, min_width: int = 100, min_height: int = 100, min_area_ratio: float = 0.01) -> DataFrame:
    """Images large enough to be figures, numbered per page, with boxes scaled to the page."""
    area = F.col("page_width") * F.col("page_height")
    ratio = ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))) / area
    kept = images.where(
        (area > 0) & (F.col("img_width") >= min_width) & (F.col("img_height") >= min_height)
        & F.col("bx0").isNotNull() & (ratio >= min_area_ratio)
    )
    k = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("img_pos"))
    box = geometry.scale_region_box(
        F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), F.col("page_width"), F.col("page_height")
    )
    return kept.withColumn("k", k).withColumn("b", box).select(
        "doc_id", "page_number", "img_pos", F.concat(F.lit("fig_p"), "page_number", F.lit("_"), "k").alias("name"),
        "b.x0", "b.y0", "b.x1", "b.y1",
    )


@prepared
def crop_table_regions(captions: DataFrame, rules: DataFrame, reach: float = 350.0) -> DataFrame:
    """Page area of each captioned table from the horizontal rules near its caption.

    A rule counts when it is at least 80 wide, at most 5 high and its top is less
    than ``reach`` points from the caption's top or bottom. Without rules the area is 240 points below.

    The page is cut into bands of height ``reach``. A range of ``reach`` on both
    sides of an edge is the end of the band above, the edge's own band and the
    beginning of the band below, so its extremes come from running ones within
    bands: linear work, no caption-rule pairs, and a page in as many tasks as it has bands.
    Rules at the same height collapse to their extent first.
    """
    page = ["doc_id", "page_number"]
    # narrow and stored: captions are recognised once, not for the questions and again for the areas
    captions = stored(captions.select(*page, "pos", "y0", "y1", "page_width", "page_height"), "captions")
    extent = rules.where((F.col("x1") - F.col("x0") >= 80) & (F.col("y1") - F.col("y0") <= 5)).groupBy(
        *page, F.col("y0").alias("at")
    ).agg(F.min("x0").alias("rx0"), F.max("x1").alias("rx1"), F.max("y1").alias("ry1"))
    band = F.floor(F.col("at") / reach)
    mark = F.struct(F.col("at").alias("ry0"), "ry1", "rx0", "rx1")
    marks = extent.select(*page, band.alias("band"), "at", F.lit(1).alias("turn"), mark.alias("m"), F.lit(None).cast("bigint").alias("caption_pos"), F.lit(0).alias("part"))
    edges = captions.select(*page, F.explode(F.array("y0", "y1")).alias("at"), F.col("pos").cast("bigint").alias("caption_pos"))
    # an edge asks three bands: what lies behind (edge - reach), all of its own, what lies before (edge + reach)
    asked = [(-1, F.col("at") - reach, 1), (0, F.lit(float("-inf")), 1), (1, F.col("at") + reach, 2)]
    none = F.lit(None).cast("struct<ry0:double,ry1:double,rx0:double,rx1:double>").alias("m")
    questions = F.explode(F.array(*[F.struct((band + shift).alias("band"), place.alias("at"), F.lit(part).alias("part")) for shift, place, part in asked]))
    # a rule at the very place does not count: questions come first in either direction
    asks = edges.select(*page, "caption_pos", questions.alias("q")).select(*page, "q.band", "q.at", F.lit(0).alias("turn"), none, "caption_pos", "q.part")
    line = marks.unionByName(asks)
    own = Window.partitionBy(*page, "band")
    behind = own.orderBy(F.desc("at"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    ahead = own.orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)

    def extremes(window):
        return F.struct(F.min("m.ry0").over(window).alias("ry0"), F.max("m.ry1").over(window).alias("ry1"), F.min("m.rx0").over(window).alias("rx0"), F.max("m.rx1").over(window).alias("rx1"))

    seen = line.withColumn("b", extremes(behind)).withColumn("a", extremes(ahead)).where("caption_pos is not null")
    seen = seen.select(*page, "caption_pos", F.when(F.col("part") == 1, F.col("b")).otherwise(F.col("a")).alias("e")).select(*page, "caption_pos", "e.*")
    nearby = seen.groupBy(*page, "caption_pos").agg(
        F.min("ry0").alias("ry0"), F.max("ry1").alias("ry1"), F.min("rx0").alias("rx0"), F.max("rx1").alias("rx1")
    )
    joined = captions.withColumn("caption_pos", F.col("pos").cast("bigint")).join(nearby, [*page, "caption_pos"])
    ruled = F.col("ry0").isNotNull()
    w, h = F.col("page_width"), F.col("page_height")
    zero = F.lit(0.0)
    plain_top = F.greatest(zero, F.col("y0") - 5)
    return (
        joined.withColumn("ty0", F.when(ruled, F.col("ry0") - 20).otherwise(plain_top))
        .withColumn("ty1", F.when(ruled, F.col("ry1") + 15).otherwise(F.least(h, plain_top + 240)))
        .select(
            *page, "caption_pos",
            F.when(ruled, F.greatest(zero, F.col("rx0") - 10)).otherwise(zero).alias("x0"),
            F.greatest(zero, F.least(F.col("y0") - 10, F.col("ty0"))).alias("y0"),
            F.when(ruled, F.least(w, F.col("rx1") + 10)).otherwise(w).alias("x1"),
            F.least(h, F.greatest(F.col("ty1"), F.col("y1") + 40)).alias("y1"),
        )
    )


def _keeping(tolerance: float):
    """Marks the regions that no kept one covers; the state is the extents kept, at most a page's height apart."""

    def step(state, tops, bottoms):
        kept, marks = list(state or []), []
        for top, bottom in zip(tops, bottoms):
            new = not any(abs(a - top) < tolerance and abs(b - bottom) < tolerance for a, b in kept)
            marks.append(int(new))
            if new:
                kept.append([top, bottom])
        return marks, kept

    return step


def dedupe_crops(regions: DataFrame, tolerance: float = 40.0, pieces: int | None = None) -> DataFrame:
    """Drop a region whose top and bottom are both within ``tolerance`` of an earlier kept one on its page.

    Repeats of the same extent are dropped up front (they share their first
    one's fate or are covered by it), which aggregates map-side. What remains of
    a page is folded in list order, in any number of tasks (see folds); kept
    regions differ by the tolerance, so the state is bounded by the page height.
    """
    regions = stored(regions, "regions")  # folded, and then read again for those kept
    distinct = regions.groupBy("doc_id", "page_number", "y0", "y1").agg(F.min("caption_pos").alias("caption_pos"))
    folded = ordered_fold(distinct, ["doc_id", "page_number"], ["caption_pos", "y0", "y1"], ["y0", "y1"], _keeping(tolerance), pieces)
    kept = folded.where("mark = 1").select("doc_id", "page_number", "caption_pos")
    return regions.join(kept, ["doc_id", "page_number", "caption_pos"], "left_semi")


def page_elements(elements: DataFrame, page: int | None = None) -> DataFrame:
    """Elements with a box (of one page or all), with position and size in percent."""
    shown = elements.where("y0 is not null")
    if page is not None:
        shown = shown.where(F.col("page_number") == page)
    return shown.withColumn(
        "g", geometry.percent_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    ).select("doc_id", "pos", "page_number", "g.*")
