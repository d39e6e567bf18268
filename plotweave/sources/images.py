"""Raster sources: one row an image, then one row a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def luma(blue: Column, green: Column, red: Column) -> Column:
    """BT.601 gray level in fixed point, the documented integer form."""
    return F.shiftright(red * 19595 + green * 38470 + blue * 7471 + 32768, 16)


def read_images(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """``(image_id, h, w, n_channels, data)`` for each readable image below ``path``; an error if there is none."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    images = found.select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))
    if required and images.limit(1).count() == 0:
        raise FileNotFoundError(f"Could not load image: {path}")
    return images


def pixels(images: DataFrame) -> DataFrame:
    """``(image_id, h, w, y, x, gray)``; colour data is BGR and becomes gray, one channel stays as it is."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("p", "k")
    rows = images.where("h > 0 and w > 0").select("image_id", "h", "w", "n_channels", "data", at)

    def byte(channel: int) -> Column:
        return F.expr(f"cast(conv(hex(substring(data, p * n_channels + {channel + 1}, 1)), 16, 10) as int)")

    gray = F.when(F.col("n_channels") == 1, byte(0)).otherwise(luma(byte(0), byte(1), byte(2)).cast("int"))
    return rows.select("image_id", "h", "w", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), gray.alias("gray"))
