"""Grouping of detected boxes into lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.numeric import upper_median

MIN_GAP, GAP_SHARE, MARGIN = 15.0, 0.6, 8


def boxes_of(polygons: DataFrame) -> DataFrame:
    """page, box_index, y_center, height, x_min, x_max, y_min, y_max from page, box_index, bbox (array of [x, y])."""
    xs, ys = F.transform("bbox", lambda p: F.get(p, F.lit(0))), F.transform("bbox", lambda p: F.get(p, F.lit(1)))
    flat = polygons.withColumn("__xs", xs).withColumn("__ys", ys)
    total = F.aggregate("__ys", F.lit(0.0), lambda a, y: a + y)
    return flat.select(
        *[c for c in polygons.columns if c != "bbox"], (total / F.size("__ys")).alias("y_center"),
        (F.array_max("__ys") - F.array_min("__ys")).alias("height"), F.array_min("__xs").alias("x_min"), F.array_max("__xs").alias("x_max"),
        F.array_min("__ys").alias("y_min"), F.array_max("__ys").alias("y_max"),
    )


def line_clusters(boxes: DataFrame) -> DataFrame:
    """``boxes`` with line_index (from 0) and position (from 1) in the line.

    A line ends where the gap to the previous box's centre exceeds max(15, 0.6 * upper median height) of the page. Ties of
    centre or left edge go by box_index. A page's boxes are windowed together; pages are spread over all tasks.
    """
    gaps = boxes.groupBy(F.col("page").alias("__page")).agg(
        F.greatest(F.lit(MIN_GAP), GAP_SHARE * upper_median(F.collect_list("height"))).alias("__gap"))
    down = Window.partitionBy("page").orderBy("y_center", "box_index")
    rows = boxes.join(gaps, F.col("page").eqNullSafe(F.col("__page"))).drop("__page")
    rows = rows.withColumn("__before", F.lag("y_center").over(down))
    new = F.when(F.abs(F.col("y_center") - F.col("__before")) > F.col("__gap"), 1).otherwise(0)
    rows = rows.withColumn("line_index", F.sum(new).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    # Stable: boxes of one left edge stay in order of their centres.
    across = Window.partitionBy("page", "line_index").orderBy("x_min", "y_center", "box_index")
    return rows.withColumn("position", F.row_number().over(across)).drop("__before", "__gap")


def line_boxes(lined: DataFrame, *, margin: int = MARGIN) -> DataFrame:
    """page, line_index, n_boxes and the union box with a margin, clamped to page_width and page_height where given."""
    have = set(lined.columns)
    limit = lambda v, side: F.least(F.min(side), v) if side in have else v
    return lined.groupBy("page", "line_index").agg(
        F.count("*").alias("n_boxes"),
        F.greatest(F.lit(0), F.min("x_min") - margin).alias("x_min"), F.greatest(F.lit(0), F.min("y_min") - margin).alias("y_min"),
        limit(F.max("x_max") + margin, "page_width").alias("x_max"), limit(F.max("y_max") + margin, "page_height").alias("y_max"),
    )


def joined_text(segments: DataFrame, key: str, order: str, text: str, *, separator: str = " ") -> DataFrame:
    """key, text: the non-blank segments of each key in order."""
    said = F.transform(F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(order).alias("o"), F.trim(text).alias("t"))))), lambda s: s["t"])
    return segments.groupBy(key).agg(F.array_join(said, separator).alias("text"))
