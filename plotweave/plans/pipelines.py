"""Whole runs: images to contour files or to strokes, commands and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.config import A4_PAGE, GANTRY_AREA, ContourConfig, StrokeConfig, WorkArea
from plotweave.functions.pixels import dark_or_equal, line_pair
from plotweave.operators import commands as cmd
from plotweave.operators import contours as ct
from plotweave.operators import metrics, morphology
from plotweave.operators.mapping import map_points, transforms
from plotweave.operators.polyline import close_path, corners, merge_corners, resample
from plotweave.operators.skeleton import build_graph, nodes
from plotweave.segment import Segmentation, segment
from plotweave.sources import sinks
from plotweave.storage import materialise, unsent


@dataclass
class ContourRun:
    raw: DataFrame
    sampled: DataFrame
    corners: DataFrame
    merged: DataFrame
    mapped: DataFrame
    stats: DataFrame
    commands: DataFrame | None


def contour_run(pixels: DataFrame, config: ContourConfig | None = None, area: WorkArea = GANTRY_AREA) -> ContourRun:
    """Pixels of many images to sampled contours on a page or machine area; machine areas get validated commands."""
    c = config or ContourConfig()
    mask = pixels.where(dark_or_equal(F.col("gray"), c.threshold)).select(*morphology.PIXEL)
    found = materialise(ct.find_contours(mask, c.mode), "contours")
    ranked = ct.by_area(ct.large(ct.measures(found), c.min_area, c.min_perimeter))
    ids = ranked.select("image_id", "path_id", F.col("rank").cast("int").alias("rank"))
    raw = found.join(ids, ["image_id", "path_id"]).select("image_id", F.col("rank").alias("path_id"), "seq", "x", "y")
    raw = materialise(close_path(raw), "raw")
    sampled = materialise(resample(raw, c.spacing_px), "sampled")
    sharp = materialise(corners(raw, c.corner_angle_deg, c.corner_window, c.corner_separation), "corners")
    merged = materialise(merge_corners(sampled, raw, sharp), "merged")
    sizes = pixels.select("image_id", "w", "h").distinct()
    mapped = map_points(merged, sizes, area)
    commands = None
    if not area.flip_y:
        commands = materialise(cmd.emit(mapped), "commands")
        cmd.validate(commands, area.width_mm, area.height_mm)
    return ContourRun(raw, sampled, sharp, merged, mapped, ct.stats(raw, merged, sharp), commands)


@dataclass
class StrokeRun:
    segmentation: Segmentation
    graph: dict[str, DataFrame]
    mapped: DataFrame
    commands: DataFrame
    transforms: DataFrame


def stroke_run(pixels: DataFrame, config: StrokeConfig | None = None, area: WorkArea = GANTRY_AREA, model_path: str | None = None, load=None) -> StrokeRun:  # noqa: ANN001
    """Pixels of many images to skeleton graphs, strokes and validated commands."""
    c = config or StrokeConfig()
    found = segment(pixels, c, model_path, load)
    graph = build_graph(found.lines, found.nodes, c.vertex_radius, c.simplify_px)
    graph |= {k: materialise(graph[k], k) for k in ("vertices", "strokes")}
    sizes = pixels.select("image_id", "w", "h").distinct()
    mapped = map_points(unsent(graph["strokes"]), sizes, area)
    commands = materialise(cmd.emit(mapped), "commands")
    cmd.validate(commands, area.width_mm, area.height_mm)
    return StrokeRun(found, graph, mapped, commands, transforms(sizes, area))


def stroke_metrics(spark: SparkSession, run: StrokeRun, image_id: str, constants: dict[str, object], area: WorkArea = GANTRY_AREA) -> DataFrame:
    """The metrics document of one image of a run."""
    strokes = run.graph["edges"].where(F.col("image_id") == image_id).count()
    counts = metrics.graph_counts(run.graph).where(F.col("image_id") == image_id).first()
    zero = {n: 0 for n in ("vertex_count", "edge_count", "skeleton_pixel_count", "endpoint_count", "junction_pixel_count", "corner_pixel_count")}
    t = run.transforms.where(F.col("image_id") == image_id).first().transform.asDict()
    return metrics.document(spark, image_id, run.commands, strokes, area.width_mm, area.height_mm, constants, run.segmentation.mode_used, run.segmentation.model_path, run.segmentation.notes, t, counts.graph.asDict() if counts else zero)


def study_run(pixels: DataFrame, threshold: int = 127, close_size: int = 3, min_area: int = 20) -> dict[str, DataFrame]:
    """The segmentation study: line and background masks, the cleaned mask, its morphological skeleton and end and junction nodes."""
    black, white = line_pair(F.col("gray"), threshold)
    lines = pixels.where(white == 255).select(*morphology.PIXEL)
    cleaned = morphology.drop_small(morphology.close_open(lines, close_size), min_area)
    skeleton = materialise(morphology.skeleton_by_opening(cleaned), "skeleton")
    found = nodes(skeleton).where("kind in ('endpoint', 'junction')")
    return {"background": pixels.where(black == 255).select(*morphology.PIXEL), "lines": lines, "cleaned": cleaned, "skeleton": skeleton, "nodes": found}


def write_contour_run(run: ContourRun, image_id: str, path: str, transform: dict, spacing: float, page: bool) -> None:
    """The text files of one image of a contour run, below ``path``."""
    own = lambda df: df.where(F.col("image_id") == image_id)
    sinks.write_lines(sinks.point_lines(own(run.merged), sinks.pixel_head(spacing), "x", "y"), f"{path}/sampled_points_px")
    name = "sampled_points_a4_mm" if page else "sampled_points_gantry_mm"
    sinks.write_lines(sinks.point_lines(own(run.mapped), sinks.area_head(transform, page), "x_mm", "y_mm"), f"{path}/{name}")
    if run.commands is not None:
        sinks.write_lines(sinks.command_lines(own(run.commands)), f"{path}/arduino_commands")


AREAS = {"a4": A4_PAGE, "gantry": GANTRY_AREA}
