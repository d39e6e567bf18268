"""Motion commands: ``(image_id, cmd_idx, x_mm, y_mm, mode)``, mode 0 travels and 1 draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.numbers import two_places


def emit(paths: DataFrame) -> DataFrame:
    """Commands of the paths of each image in order of ``path_id`` and ``seq``: travel to a path's first point, draw to the others."""
    first = F.col("seq") == F.min("seq").over(Window.partitionBy("image_id", "path_id"))
    order = Window.partitionBy("image_id").orderBy("path_id", "seq")
    return paths.select("image_id", (F.row_number().over(order) - 1).cast("long").alias("cmd_idx"), "x_mm", "y_mm", F.when(first, 0).otherwise(1).alias("mode"))


def _number(value: float) -> str:
    return repr(float(value))


def first_fault(commands: DataFrame, width_mm: float, height_mm: float) -> DataFrame:
    """``(image_id, error)``: the first fault of each image, null if there is none.

    A command's mode is looked at first, then the closed bounds; NaN and null are out of bounds.  Only the first faulty command of an
    image is put into words, its numbers rounded as Python rounds them.
    """
    inside = (F.col("x_mm") >= 0) & (F.col("x_mm") <= width_mm) & (F.col("y_mm") >= 0) & (F.col("y_mm") <= height_mm)
    known, inside = F.coalesce(F.col("mode").isin(0, 1), F.lit(False)), F.coalesce(inside, F.lit(False))
    found = commands.groupBy("image_id").agg(F.min(F.when(~(known & inside), F.struct("cmd_idx", (~known).alias("bad_mode"), "x_mm", "y_mm", "mode"))).alias("f"))
    found = found.select("image_id", "f", two_places("f.x_mm").alias("x"), two_places("f.y_mm").alias("y"))
    number, none = F.concat(F.lit("Command "), F.col("f.cmd_idx").cast("string")), F.lit("None")
    bad_mode = F.concat(number, F.lit(" has invalid mode: "), F.coalesce(F.col("f.mode").cast("string"), none))
    bounds = F.concat(number, F.lit(" outside gantry bounds: x="), F.coalesce("x", none), F.lit(", y="), F.coalesce("y", none), F.lit(f", allowed X=0..{_number(width_mm)}, Y=0..{_number(height_mm)}"))
    return found.select("image_id", F.when(F.col("f").isNotNull(), F.when(F.col("f.bad_mode"), bad_mode).otherwise(bounds)).alias("error"))


def validate(commands: DataFrame, width_mm: float, height_mm: float) -> None:
    """Raise the first fault, if any; an action, to be run before anything is written."""
    found = first_fault(commands, width_mm, height_mm).where("error is not null").orderBy("image_id").limit(1).collect()
    if found:
        raise ValueError(found[0].error)


def with_moves(commands: DataFrame) -> DataFrame:
    """Commands with ``dist``, the way from the command before (0 for the first), and ``changed``, whether the mode is another."""
    w = Window.partitionBy("image_id").orderBy("cmd_idx")
    dx, dy = F.col("x_mm") - F.lag("x_mm").over(w), F.col("y_mm") - F.lag("y_mm").over(w)
    before = F.lag("mode").over(w)
    return commands.withColumn("dist", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("changed", before.isNull() | (before != F.col("mode")))
