"""Targets split over two images: overlap test, pairs, stitched boxes and composites.

``targets`` has ``bin, targetNumber, trigger, left, bottom, width, height``; rows of a bin are in ``targetNumber`` order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.operators import ordered

BOX = ["trigger", "left", "bottom", "width", "height"]


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Same trigger and open rectangles that meet; touching edges do not overlap."""
    meets = F.lit(True)
    for low, size in (("left", "width"), ("bottom", "height")):
        meets = meets & (a[low] < b[low] + b[size]) & (a[low] + a[size] > b[low])
    return F.coalesce((a["trigger"] == b["trigger"]) & meets, F.lit(False))


def _cols(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in BOX}


def stitched_box(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Union box of two targets."""
    left, bottom = F.least(a["left"], b["left"]), F.least(a["bottom"], b["bottom"])
    return {"left": left, "bottom": bottom,
            "width": F.greatest(a["left"] + a["width"], b["left"] + b["width"]) - left,
            "height": F.greatest(a["bottom"] + a["height"], b["bottom"] + b["height"]) - bottom}


def group_box(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Union box of each group of targets."""
    left, bottom = F.min("left"), F.min("bottom")
    return targets.groupBy(*keys).agg(left.alias("left"), bottom.alias("bottom"),
                                      (F.max(F.col("left") + F.col("width")) - left).alias("width"),
                                      (F.max(F.col("bottom") + F.col("height")) - bottom).alias("height"))


def _with_sides(targets: DataFrame) -> DataFrame:
    names = BOX + ["targetNumber"]
    return ordered.neighbours(targets, ["bin"], ["targetNumber"], ordered.block_slice("targetNumber"),
                              prev={c: f"p_{c}" for c in names}, next={c: f"n_{c}" for c in names})


def find_pairs(targets: DataFrame) -> DataFrame:
    """(bin, first, second) of consecutive overlapping targets; the previous row counts even when it is paired."""
    rows = _with_sides(targets).where(box_overlap(_cols(""), _cols("p_")))
    return rows.select("bin", F.col("p_targetNumber").alias("first"), F.col("targetNumber").alias("second"))


def list_stitched_targets(targets: DataFrame) -> DataFrame:
    """First of a pair takes the union box and ``stitched = 1``, the second is dropped. Of a chain a-b-c only a is left,
    with the box of a and b."""
    rows = _with_sides(targets)
    opens, closes = box_overlap(_cols("n_"), _cols("")), box_overlap(_cols(""), _cols("p_"))
    box = stitched_box(_cols(""), _cols("n_"))
    sized = {c: F.when(F.col("_opens"), v).otherwise(F.col(c)) for c, v in box.items()}
    kept = rows.withColumns({"_opens": opens, "_closes": closes}).where(~F.col("_closes")).withColumns(sized)
    return kept.withColumn("stitched", F.col("_opens").cast("int")).select(*targets.columns, "stitched")


def stitch_composite(pixels: DataFrame, targets: DataFrame, keys: list[str], order: str, background: int = 0) -> DataFrame:
    """Pixels of the union box of a group: later targets win, gaps take the background.

    ``pixels`` has ``keys, order, x, y, v`` with x along the width. The canvas is the box itself, as large as the result.
    """
    corner = targets.select(*keys, order, F.col("left").alias("_l"), F.col("bottom").alias("_b"))
    placed = pixels.join(corner, [*keys, order]).select(
        *keys, (F.col("_l") + F.col("x")).alias("x"), (F.col("_b") + F.col("y")).alias("y"), order, "v")
    top = placed.groupBy(*keys, "x", "y").agg(F.max_by("v", order).alias("v"))
    boxes = group_box(targets, keys)
    columns = boxes.select(*keys, "bottom", "height", F.explode(
        F.sequence(F.col("left"), F.col("left") + F.col("width") - 1)).alias("x"))
    canvas = columns.select(*keys, "x", F.explode(
        F.sequence(F.col("bottom"), F.col("bottom") + F.col("height") - 1)).alias("y"))
    return canvas.join(top, [*keys, "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(background)))
