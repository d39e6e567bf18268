"""Fitting images onto a page or machine area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.config import WorkArea


def fit(w_px: Column, h_px: Column, area: WorkArea) -> Column:
    """The transform as a struct of 13 fields: millimetres a pixel, used size, offsets, and what they come from."""
    drawable_w, drawable_h = area.width_mm - 2 * area.margin_mm, area.height_mm - 2 * area.margin_mm
    if drawable_w <= 0 or drawable_h <= 0:
        raise ValueError("Margins leave no drawable area")
    scale = F.least(F.lit(drawable_w) / w_px, F.lit(drawable_h) / h_px)
    used_w, used_h = w_px * scale, h_px * scale
    x0 = area.margin_mm + (F.lit(drawable_w) - used_w) / 2 if area.centred else F.lit(area.margin_mm)
    y0 = area.margin_mm + (F.lit(drawable_h) - used_h) / 2 if area.centred else F.lit(area.margin_mm)
    names = ("page_w_mm", "page_h_mm") if area.flip_y else ("work_w_mm", "work_h_mm")
    return F.struct(
        F.lit(area.width_mm).alias(names[0]), F.lit(area.height_mm).alias(names[1]), F.lit(area.margin_mm).alias("margin_mm"),
        F.lit(drawable_w).alias("drawable_w_mm"), F.lit(drawable_h).alias("drawable_h_mm"), w_px.alias("img_w_px"), h_px.alias("img_h_px"),
        scale.alias("scale_mm_per_px"), used_w.alias("used_w_mm"), used_h.alias("used_h_mm"), x0.alias("x_offset_mm"), y0.alias("y_offset_mm"), F.lit(area.centred).alias("centre_on_page"),
    )


def map_points(points: DataFrame, sizes: DataFrame, area: WorkArea) -> DataFrame:
    """``points`` with ``x_mm, y_mm`` for x, y; ``sizes(image_id, w, h)``.  Pages have their origin bottom-left, machines top-left."""
    t = sizes.select("image_id", fit(F.col("w"), F.col("h"), area).alias("__t"))
    x = F.col("x") * F.col("__t.scale_mm_per_px") + F.col("__t.x_offset_mm")
    y = F.col("y") * F.col("__t.scale_mm_per_px") + F.col("__t.y_offset_mm")
    return points.join(t, "image_id").withColumn("x_mm", x).withColumn("y_mm", F.lit(area.height_mm) - y if area.flip_y else y).drop("x", "y", "__t")


def transforms(sizes: DataFrame, area: WorkArea) -> DataFrame:
    """``(image_id, transform)`` for each image."""
    return sizes.select("image_id", fit(F.col("w"), F.col("h"), area).alias("transform"))
