"""Distances, times and the metrics document of command lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.operators.commands import first_fault, with_moves
from plotweave.sources.firmware import DEFAULTS

#: Texts of the metrics document.
SCHEMA = "stroke_pipeline_metrics_v1"
ASSUMPTIONS = {
    "speed_units": "DRAW_SPEED and TRAVEL_SPEED are treated as AccelStepper steps/s.",
    "steps_per_mm_formula": "(FULL_STEPS_PER_REV * MICROSTEPS) / (PULLEY_TEETH * BELT_PITCH_MM)",
    "pen_change_estimate": "Each mode change adds PEN_SETTLE_MS plus an approximate servo sweep time.",
    "acceleration": "Acceleration and cornering dynamics are not modelled.",
}


def distances(commands: DataFrame) -> DataFrame:
    """``(image_id, command_count, draw_mm, travel_mm, mode_changes, min_x_mm, max_x_mm, min_y_mm, max_y_mm)``.

    A move counts for the mode of the command it leads to; the first command moves nowhere but changes the mode.
    """
    return with_moves(commands).groupBy("image_id").agg(
        F.count("*").alias("command_count"),
        F.coalesce(F.sum(F.when(F.col("mode") == 1, F.col("dist"))), F.lit(0.0)).alias("draw_mm"),
        F.coalesce(F.sum(F.when(F.col("mode") != 1, F.col("dist"))), F.lit(0.0)).alias("travel_mm"),
        F.count_if("changed").alias("mode_changes"),
        F.min("x_mm").alias("min_x_mm"), F.max("x_mm").alias("max_x_mm"), F.min("y_mm").alias("min_y_mm"), F.max("y_mm").alias("max_y_mm"),
    )


def times(measured: DataFrame, constants: dict[str, float]) -> DataFrame:
    """``measured`` with ``draw_s, travel_s, pen_s, total_s``; a speed that isn't positive gives null, which adds nothing."""
    steps = constants["FULL_STEPS_PER_REV"] * constants["MICROSTEPS"] / (constants["PULLEY_TEETH"] * constants["BELT_PITCH_MM"])

    def needed(distance: str, speed: str) -> Column:
        v = constants[speed] / steps
        return F.col(distance) / F.lit(v) if v > 0 else F.lit(None).cast("double")

    pause = constants["PEN_SETTLE_MS"] + abs(constants["PEN_UP_ANGLE"] - constants["PEN_DOWN_ANGLE"]) * constants["SERVO_DELAY_MS"]
    out = measured.withColumn("draw_s", needed("draw_mm", "DRAW_SPEED")).withColumn("travel_s", needed("travel_mm", "TRAVEL_SPEED"))
    out = out.withColumn("pen_s", F.col("mode_changes") * F.lit(pause) / F.lit(1000.0))
    return out.withColumn("total_s", F.coalesce("draw_s", F.lit(0.0)) + F.coalesce("travel_s", F.lit(0.0)) + F.col("pen_s"))


def graph_counts(graph: dict[str, DataFrame]) -> DataFrame:
    """``(image_id, graph)``: numbers of vertices, edges, skeleton pixels and nodes of each kind."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    parts = [
        graph["skeleton"].groupBy("image_id").agg(F.count("*").alias("skeleton_pixel_count")),
        graph["vertices"].groupBy("image_id").agg(F.count("*").alias("vertex_count")),
        graph["edges"].groupBy("image_id").agg(F.count("*").alias("edge_count")),
        graph["nodes"].groupBy("image_id").agg(kind("endpoint").alias("endpoint_count"), kind("junction").alias("junction_pixel_count"), kind("corner").alias("corner_pixel_count")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.join(p, "image_id", "left")
    names = ["vertex_count", "edge_count", "skeleton_pixel_count", "endpoint_count", "junction_pixel_count", "corner_pixel_count"]
    return rows.fillna(0, names).select("image_id", F.struct(*names).alias("graph"))


def _record(value: object) -> Column:
    if isinstance(value, dict):
        return F.struct(*[_record(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value]).cast("array<string>")
    return F.lit(value) if value is not None else F.lit(None).cast("string")


def documents(commands: DataFrame, images: DataFrame, width_mm: float, height_mm: float, constants: dict[str, object], mode_used: str, model_path: str | None, notes: list[str]) -> DataFrame:
    """``(image_id, metrics)`` for each row of ``images(image_id, strokes, transform, graph)``, with commands or without."""
    values = {k: float(constants[k]) for k in DEFAULTS}
    m = times(images.join(distances(commands), "image_id", "left").fillna(0, ["command_count", "mode_changes"]).fillna(0.0, ["draw_mm", "travel_mm"]), values)
    m = m.join(first_fault(commands, width_mm, height_mm), "image_id", "left")
    steps = values["FULL_STEPS_PER_REV"] * values["MICROSTEPS"] / (values["PULLEY_TEETH"] * values["BELT_PITCH_MM"])

    assumptions = {
        "speed_units": ASSUMPTIONS["speed_units"], "steps_per_mm_formula": ASSUMPTIONS["steps_per_mm_formula"], "steps_per_mm": steps,
        "draw_speed_mm_s": values["DRAW_SPEED"] / steps, "travel_speed_mm_s": values["TRAVEL_SPEED"] / steps,
        "pen_change_estimate": ASSUMPTIONS["pen_change_estimate"], "acceleration": ASSUMPTIONS["acceleration"],
    }
    return m.select(
        "image_id",
        F.struct(
            F.lit(SCHEMA).alias("schema"), F.col("command_count"), F.col("strokes").alias("stroke_count"),
            F.col("draw_mm").alias("pen_down_drawing_distance_mm"), F.col("travel_mm").alias("pen_up_travel_distance_mm"), (F.col("draw_mm") + F.col("travel_mm")).alias("total_movement_distance_mm"),
            F.col("draw_s").alias("estimated_draw_movement_time_s"), F.col("travel_s").alias("estimated_travel_movement_time_s"),
            F.col("pen_s").alias("estimated_pen_mode_change_settle_time_s"), F.col("total_s").alias("estimated_total_plotting_time_s"), F.col("mode_changes").alias("mode_change_count"),
            F.struct("min_x_mm", "max_x_mm", "min_y_mm", "max_y_mm").alias("command_bounds_mm"),
            F.col("error").isNull().alias("bounds_validation_passed"), F.col("error").alias("bounds_validation_error"),
            F.lit(mode_used).alias("segmentation_mode_used"), _record(model_path).alias("model_path_used"), _record(notes).alias("segmentation_notes"),
            F.col("graph"), F.col("transform").alias("gantry_mapping"), _record(dict(constants)).alias("firmware_constants"), _record(assumptions).alias("time_estimation_assumptions"),
        ).alias("metrics")
    )


def document(spark: SparkSession, image_id: str, commands: DataFrame, strokes: int, width_mm: float, height_mm: float, constants: dict[str, object], mode_used: str, model_path: str | None, notes: list[str], transform: dict, graph: dict[str, int]) -> DataFrame:
    """One row ``(metrics)``: the whole document of one image as a nested struct with its nulls kept."""
    one = spark.range(1).select(F.lit(image_id).alias("image_id"), F.lit(strokes).alias("strokes"), _record(transform).alias("transform"), _record(graph).alias("graph"))
    own = commands.where(F.col("image_id") == image_id)
    return documents(own, one, width_mm, height_mm, constants, mode_used, model_path, notes).select("metrics")


def stroke_counts(commands: DataFrame) -> DataFrame:
    """``(image_id, strokes)``: runs of drawing commands of each image."""
    return with_moves(commands).groupBy("image_id").agg(F.count_if(F.col("changed") & (F.col("mode") == 1)).alias("strokes"))


def as_json(metrics: DataFrame) -> str:
    """The document of a one-row table as JSON, two spaces deep, nulls kept."""
    return json.dumps(metrics.first().metrics.asDict(recursive=True), indent=2)
