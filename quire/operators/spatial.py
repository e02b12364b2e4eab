"""Spatial joins of boxes on one page, as DataFrame operators.

Boxes carry page_id, box_id, x, y, w, h and what else is needed. All joins meet on page_id first, so that a page's boxes
are compared with that page's only; the overlap is a condition of the join. Ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import intersection, page_pairs


def _percent(part: Column, whole: Column, percent: int) -> Column:
    """part >= percent of whole, in whole numbers."""
    return 100 * part >= percent * whole


def _area(side: str) -> Column:
    return F.col(f"{side}_w") * F.col(f"{side}_h")


def without(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The boxes that are not the first side of any pair."""
    return boxes.join(pairs.select(F.col("page_id"), F.col("a_box_id").alias("box_id")).distinct(), ["page_id", "box_id"], "left_anti")


def best_panel(boxes: DataFrame, panels: DataFrame, percent: int = 50) -> DataFrame:
    """J1. Each box's panel with the largest share of it, if that is enough. panels: page_id, panel, x, y, w, h."""
    b, p = boxes.alias("b"), panels.select("page_id", "panel", *[F.col(c).alias("p" + c) for c in "xywh"]).alias("p")
    both = b.join(p, "page_id").withColumn("inter", intersection("x", "y", "w", "h", "px", "py", "pw", "ph"))
    first = F.row_number().over(Window.partitionBy("page_id", "box_id").orderBy(F.desc("inter"), "panel"))
    return both.withColumn("r", first).where((F.col("r") == 1) & _percent(F.col("inter"), F.col("w") * F.col("h"), percent)).select("box_id", "panel")


def transferred_labels(boxes: DataFrame, percent: int = 50) -> DataFrame:
    """J3. Each box's kind, or that of the box that covers most of it, if that is enough."""
    share = F.col("inter") / _area("a")
    best = F.row_number().over(Window.partitionBy("page_id", "a_box_id").orderBy(F.desc(share), "b_box_id"))
    found = page_pairs(boxes).withColumn("r", best).where((F.col("r") == 1) & _percent(F.col("inter"), _area("a"), percent))
    found = found.select("page_id", F.col("a_box_id").alias("box_id"), F.col("b_kind").alias("label"))
    return boxes.join(found, ["page_id", "box_id"], "left").select("box_id", F.coalesce("label", "kind").alias("kind"))


def uncovered(boxes: DataFrame, covers: Column, percent: int = 35) -> DataFrame:
    """J4. Boxes of which no covering box (a condition on b_*) holds that share."""
    return without(boxes, page_pairs(boxes).where(covers & _percent(F.col("inter"), _area("a"), percent)))


def covering_pairs(boxes: DataFrame, percent: int = 80) -> DataFrame:
    """J6. Pairs of which either covers that share of the smaller."""
    pairs = page_pairs(boxes).where((F.col("a_box_id") < F.col("b_box_id")) & _percent(F.col("inter"), F.least(_area("a"), _area("b")), percent))
    return pairs.select("page_id", F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


def without_parents(boxes: DataFrame, least: int = 2) -> DataFrame:
    """J8. Boxes but for those that hold `least` or more smaller ones."""
    a, b, inter = _area("a"), _area("b"), F.col("inter")
    child = (100 * inter > 85 * a) & ((100 * a < 75 * b) | ((a < b) & (100 * inter > 70 * a)))
    parents = page_pairs(boxes).where(child).groupBy("page_id", "b_box_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return boxes.join(parents.select("page_id", F.col("b_box_id").alias("box_id")), ["page_id", "box_id"], "left_anti")


def without_absorbed(boxes: DataFrame, percent: int = 95, times: int = 5) -> DataFrame:
    """J9. Boxes but for those inside a larger one of at most that many times their area."""
    a, b = _area("a"), _area("b")
    return without(boxes, page_pairs(boxes).where((b > a) & (b <= times * a) & _percent(F.col("inter"), a, percent)))


def without_crumbs(boxes: DataFrame, eaters: Column, percent: int = 85, times: int = 3) -> DataFrame:
    """J10. Boxes but for those inside an eater (a condition on b_*) that many times as large."""
    a, b = _area("a"), _area("b")
    return without(boxes, page_pairs(boxes).where(eaters & (b >= times * a) & _percent(F.col("inter"), a, percent)))


def boxes_under(boxes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """J24. Boxes that an open rectangle meets."""
    return boxes.where((F.col("x") < x1) & (F.col("x") + F.col("w") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("h") > y0))


def neighbours(boxes: DataFrame, pad: int = 20) -> DataFrame:
    """J28. How many boxes each box's crop, grown by pad, meets, itself included."""
    o = boxes.select("page_id", *[F.col(c).alias("o" + c) for c in "xywh"])
    meets = (F.col("ox") < F.col("x") + F.col("w") + pad) & (F.col("ox") + F.col("ow") > F.col("x") - pad) & (F.col("oy") < F.col("y") + F.col("h") + pad) & (F.col("oy") + F.col("oh") > F.col("y") - pad)
    return boxes.join(o, "page_id").where(meets).groupBy("box_id").agg(F.count("*").alias("neighbours"))


def grid(boxes: DataFrame, cell: int = 160, cells: int = 3) -> DataFrame:
    """J27. Boxes by the grid cell of their centre; a cell grows to hold its boxes whole."""
    at = lambda p, s: F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((F.col(p) + F.floor(F.col(s) / 2)) / cell)))
    ends = {"x1": F.max(F.col("x") + F.col("w")), "y1": F.max(F.col("y") + F.col("h"))}
    out = boxes.groupBy("page_id", at("x", "w").alias("col"), at("y", "h").alias("row_"))
    return out.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), *[v.alias(k) for k, v in ends.items()])


def run_angles(boxes: DataFrame, least: int = 3) -> DataFrame:
    """G13. Pages with `least` boxes or more: how many, and in which direction their centres spread most, in degrees above -90 to 90; 0 if none stands out.

    Boxes have whole numbers. Twice the centres are summed, so the moments are exact whatever the order of the boxes; as doubles, a covariance
    of 0 got the sign of what rounding left and turned 90 into -90. A page's sums fit a long up to 10^8 boxes on 100,000 pixels; beyond, ANSI
    mode raises an error. Boxes without a place are counted, but have no direction.
    """
    x, y = (2 * F.col(at).cast("long") + F.col(size) for at, size in ("xw", "yh"))
    placed = boxes.select("page_id", F.when(y.isNotNull(), x).alias("x"), F.when(x.isNotNull(), y).alias("y"))
    whole = lambda c: c.cast("decimal(20,0)")
    sums = {"n": F.count("x"), "x": F.sum("x"), "y": F.sum("y")} | {a + b: F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "yy")}
    moments = placed.groupBy("page_id").agg(F.count("*").alias("marks"), *[whole(v).alias(k) for k, v in sums.items()])
    spread = lambda a, b: F.col("n") * F.col(a + b) - F.col(a) * F.col(b)
    turn = F.atan2((2 * spread("x", "y")).cast("double"), (spread("x", "x") - spread("y", "y")).cast("double"))
    return moments.where(F.col("marks") >= least).select("page_id", "marks", F.round(F.degrees(0.5 * turn), 4).alias("angle"))
