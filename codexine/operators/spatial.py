"""Joins of boxes (x0, y0, x1, y1) on pages by grids of cells: equal joins on a page and a cell, never all pairs.

Sides whose boxes are dealt to cells are never broadcast: Spark knows the size of the boxes, not how many cells they touch.

A box without one of its numbers has no neighbours; numbers may be whole or broken. Ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

BOX = ("x0", "y0", "x1", "y1")


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _whole(boxes: DataFrame) -> DataFrame:
    fine = F.lit(True)
    for c in BOX:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return boxes.filter(fine)


def _named(boxes: DataFrame, letter: str, by: list[str]) -> DataFrame:
    """by, and id and the box's numbers under names that begin with the letter."""
    return _whole(boxes).select(*by, F.col("id").alias(f"{letter}_id"), *[F.col(c).cast("double").alias(f"{letter}_{c}") for c in BOX])


def _gap(a: str, b: str, low: str, high: str) -> Column:
    """The distance of two intervals; 0 where they meet."""
    return F.greatest(F.lit(0.0), F.col(f"{b}_{low}") - F.col(f"{a}_{high}"), F.col(f"{a}_{low}") - F.col(f"{b}_{high}"))


def _shared(a: str, b: str, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}_{high}"), F.col(f"{b}_{high}")) - F.greatest(F.col(f"{a}_{low}"), F.col(f"{b}_{low}")))


def beside(left: DataFrame, right: DataFrame, by: list[str], down: float, across: float) -> DataFrame:
    """by, l_id, r_id, distance and both boxes: right boxes whose lower or upper edge is less than down from the left one's upper or
    lower edge, and which share a column with it or begin less than across from where it begins.

    Edges meet in rows of down, columns in cells of across: two boxes that share a column, or begin that near, share a cell."""
    own, other = _named(left, "l", by), _named(right, "r", by)
    edges = lambda a, b: F.array(F.struct(F.lit("above").alias("edge"), F.col(a).alias("at")), F.struct(F.lit("below").alias("edge"), F.col(b).alias("at")))
    own = own.withColumn("e", F.explode(edges("l_y0", "l_y1"))).withColumn("row", F.explode(_cells(F.col("e.at") - down, F.col("e.at") + down, down)))
    own = own.withColumn("cell", F.explode(_cells(F.col("l_x0") - across, F.greatest("l_x1", F.col("l_x0") + across), across))).withColumn("edge", F.col("e.edge")).drop("e")
    other = other.withColumn("e", F.explode(edges("r_y1", "r_y0"))).withColumn("row", F.floor(F.col("e.at") / down))
    other = other.withColumn("cell", F.explode(_cells(F.least("r_x0", "r_x1"), F.greatest("r_x0", "r_x1"), across))).withColumn("edge", F.col("e.edge")).drop("e")
    met = own.join(other.hint("merge"), [*by, "edge", "row", "cell"])
    distance = F.least(F.abs(F.col("l_y0") - F.col("r_y1")), F.abs(F.col("l_y1") - F.col("r_y0")))
    near = (F.col("distance") < down) & ((_shared("l", "r", "x0", "x1") > 0) | (F.abs(F.col("l_x0") - F.col("r_x0")) < across))
    columns = [f"{x}_{c}" for x in "lr" for c in ("id", *BOX)]
    return met.withColumn("distance", distance).filter(near).select(*by, *columns, "distance").distinct()


def nearest_caption(boxes: DataFrame, spans: DataFrame, by: list[str], down: float = 50, across: float = 100) -> DataFrame:
    """by, id, caption_id, distance of every box that has a caption beside it: the nearest span, ties by id."""
    met = beside(boxes, spans, by, down, across)
    best = met.groupBy(*by, "l_id").agg(F.min(F.struct("distance", "r_id")).alias("b"))
    return best.select(*by, F.col("l_id").alias("id"), F.col("b.r_id").alias("caption_id"), F.col("b.distance").alias("distance"))


def best_region(captions: DataFrame, regions: DataFrame, pages: DataFrame, by: list[str], down: float = 250, across: float = 150, merge: float = 40) -> DataFrame:
    """by, id, x0, y0, x1, y1, n_regions of every caption: the first region beside it, by id, with each next one that is less than
    merge from what is gathered so far; a band above the caption (n_regions 0) where there is none. pages: by, and the page's box."""
    met = beside(captions, regions, by, down, across)
    ordered = F.array_sort(F.collect_list(F.struct("r_id", *[F.col(f"r_{c}").alias(c) for c in BOX])))
    found = met.groupBy(*by, F.col("l_id").alias("id")).agg(ordered.alias("l"))
    start = F.get("l", F.lit(0))
    begin = F.struct(*[start[c].alias(c) for c in BOX], F.lit(1).alias("n"))

    def joined(a: Column, r: Column) -> Column:
        near = F.least(F.abs(a["y0"] - r["y1"]), F.abs(a["y1"] - r["y0"])) < merge
        both = F.struct(F.least(a["x0"], r["x0"]).alias("x0"), F.least(a["y0"], r["y0"]).alias("y0"), F.greatest(a["x1"], r["x1"]).alias("x1"), F.greatest(a["y1"], r["y1"]).alias("y1"), (a["n"] + 1).alias("n"))
        return F.when(near, both).otherwise(a)

    found = found.select(*by, "id", F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), begin, joined).alias("r"))
    own = _named(captions, "c", by).join(pages.select(*by, *[F.col(c).cast("double").alias(f"p_{c}") for c in BOX]), by, "left")
    band = F.struct((F.col("p_x0") + 20).alias("x0"), F.greatest(F.lit(0.0), F.col("c_y0") - 220).alias("y0"), (F.col("p_x1") - 20).alias("x1"), (F.col("c_y0") - 5).alias("y1"), F.lit(0).alias("n"))
    out = own.withColumnRenamed("c_id", "id").join(found, [*by, "id"], "left").withColumn("r", F.coalesce("r", band))
    return out.select(*by, "id", *[F.col(f"r.{c}").alias(c) for c in BOX], F.col("r.n").alias("n_regions"))


def best_overlap(left: DataFrame, right: DataFrame, by: list[str], size: float) -> DataFrame:
    """by, id, other_id, area of every left box that shares an area with a right one: the greatest, ties by the smaller box, then id.

    Each shared area is taken in the one cell that holds its upper left corner, so cells bring no pair twice."""
    own, other = _named(left, "l", by), _named(right, "r", by)
    gridded = lambda df, a: df.withColumn("cx", F.explode(_cells(F.col(f"{a}_x0"), F.greatest(f"{a}_x0", f"{a}_x1"), size))).withColumn("cy", F.explode(_cells(F.col(f"{a}_y0"), F.greatest(f"{a}_y0", f"{a}_y1"), size)))
    met = gridded(own, "l").join(gridded(other, "r").hint("merge"), [*by, "cx", "cy"])
    here = (F.floor(F.greatest("l_x0", "r_x0") / size) == F.col("cx")) & (F.floor(F.greatest("l_y0", "r_y0") / size) == F.col("cy"))
    area = _shared("l", "r", "x0", "x1") * _shared("l", "r", "y0", "y1")
    own_area = (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0"))
    scored = met.filter(here).withColumn("area", area).filter("area > 0")
    best = scored.groupBy(*by, "l_id").agg(F.min(F.struct((-F.col("area")).alias("less"), own_area.alias("own"), "r_id")).alias("b"))
    return best.select(*by, F.col("l_id").alias("id"), F.col("b.r_id").alias("other_id"), (-F.col("b.less")).alias("area"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], cell: float) -> DataFrame:
    """by, id, other_id, distance of every left box whose page has a right one: the least distance between the boxes, 0 where they
    meet; ties by the smaller box, then id.

    Rings of cells: boxes meet in the cells around the left one; what has a neighbour within a cell's size can't be beaten by
    what stands further off, and is done; the others look again in cells of twice the size. So few look far."""
    own, other = cut(_named(left, "l", by), "left"), cut(_named(right, "r", by), "right")
    # Boxes of pages without any on the other side would look for ever.
    open_ = cut(own.join(other.select(*by).distinct(), by, "left_semi"), "open")
    out, size = None, float(cell)
    while open_.take(1):
        around = open_.withColumn("cx", F.explode(_cells(F.col("l_x0") - size, F.greatest("l_x0", "l_x1") + size, size))).withColumn("cy", F.explode(_cells(F.col("l_y0") - size, F.greatest("l_y0", "l_y1") + size, size)))
        held = other.withColumn("cx", F.explode(_cells(F.col("r_x0"), F.greatest("r_x0", "r_x1"), size))).withColumn("cy", F.explode(_cells(F.col("r_y0"), F.greatest("r_y0", "r_y1"), size)))
        distance = F.sqrt(F.pow(_gap("l", "r", "x0", "x1"), 2) + F.pow(_gap("l", "r", "y0", "y1"), 2))
        area = (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0"))
        met = around.join(held.hint("merge"), [*by, "cx", "cy"]).withColumn("distance", distance).filter(F.col("distance") <= size)
        best = met.groupBy(*by, "l_id").agg(F.min(F.struct("distance", area.alias("own"), "r_id")).alias("b"))
        done = cut(best.select(*by, "l_id", F.col("b.r_id").alias("other_id"), F.col("b.distance").alias("distance")), "done")
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(done.select(*by, "l_id").hint("merge"), [*by, "l_id"], "left_anti"), "open")
        size *= 2
    if out is None:
        out = own.select(*by, "l_id", F.col("l_id").alias("other_id"), F.lit(0.0).alias("distance")).limit(0)
    return out.withColumnRenamed("l_id", "id")
