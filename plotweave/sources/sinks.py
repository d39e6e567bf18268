"""Text and JSON sinks.  Lines are made by Spark in order; numbers are rounded as Python rounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.numbers import three_places, two_places


def command_text(x: Column | str = "x_mm", y: Column | str = "y_mm", mode: Column | str = "mode") -> Column:
    """A command as it is sent: two decimals and the mode."""
    return F.concat_ws(",", two_places(x), two_places(y), F.col(mode).cast("string") if isinstance(mode, str) else mode.cast("string"))


#: Heads of the files.
COMMAND_HEAD = ["# x_mm,y_mm,mode", "# mode 0 = travel / pen up", "# mode 1 = draw / pen down"]
PIXEL_HEAD = "# Sampled contour points in pixel coordinates (x_px, y_px)"
PAGE_HEAD = "# Sampled contour points mapped to A4 coordinates (x_mm, y_mm)"
GANTRY_HEAD = "# Sampled contour points mapped to gantry coordinates (x_mm, y_mm)"
PAGE_ORIGIN = "# Origin convention: bottom-left of A4 page is (0,0)"
GANTRY_ORIGIN = "# Origin convention: top-left of gantry work area is (0,0), +Y is down"


def _headed(spark, head: list[str], body: DataFrame) -> DataFrame:  # noqa: ANN001
    """``(line)`` in order: the head, then ``body(k, line)`` by its struct ``k``."""
    lines = body.withColumn("part", F.lit(1))
    k = body.schema["k"].dataType.simpleString()
    top = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "i int, line string").select(F.lit(None).cast(k).alias("k"), "line", F.lit(0).alias("part"), "i")
    return top.unionByName(lines.withColumn("i", F.lit(0))).orderBy("part", "i", "k").select("line")


def command_lines(commands: DataFrame) -> DataFrame:
    """The command file of one image."""
    body = commands.select(F.struct("cmd_idx").alias("k"), command_text().alias("line"))
    return _headed(commands.sparkSession, COMMAND_HEAD, body)


def point_lines(points: DataFrame, head: list[str], x: str, y: str) -> DataFrame:
    """A file of contour points of one image: an empty line and a heading before each contour."""
    rows = points.select(F.struct("path_id", F.lit(1).alias("a"), "seq").alias("k"), F.concat_ws(", ", three_places(x), three_places(y)).alias("line"))
    tops = points.select("path_id").distinct()
    heads = tops.select(F.struct("path_id", F.lit(0).alias("a"), F.lit(1).cast(points.schema["seq"].dataType).alias("seq")).alias("k"), F.concat(F.lit("# Contour "), F.col("path_id").cast("string")).alias("line"))
    gaps = tops.select(F.struct("path_id", F.lit(0).alias("a"), F.lit(0).cast(points.schema["seq"].dataType).alias("seq")).alias("k"), F.lit("").alias("line"))
    return _headed(points.sparkSession, head, rows.unionByName(heads).unionByName(gaps))


def pixel_head(spacing: float) -> list[str]:
    return [PIXEL_HEAD, f"# point_spacing_px = {spacing}"]


def area_head(t: dict, page: bool) -> list[str]:
    """Head of a file in millimetres from a transform record."""
    names = ("page_w_mm", "page_h_mm") if page else ("work_w_mm", "work_h_mm")
    return [
        PAGE_HEAD if page else GANTRY_HEAD,
        *[f"# {n} = {t[n]}" for n in (*names, "margin_mm")],
        *[f"# {n} = {t[n]:.8f}" for n in ("scale_mm_per_px", "x_offset_mm", "y_offset_mm")],
        f"# image_size_px = ({t['img_w_px']}, {t['img_h_px']})",
        f"# used_size_mm = ({t['used_w_mm']:.8f}, {t['used_h_mm']:.8f})",
        PAGE_ORIGIN if page else GANTRY_ORIGIN,
    ]


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ordered lines as one text file below ``path``."""
    lines.coalesce(1).write.mode("overwrite").text(path)
