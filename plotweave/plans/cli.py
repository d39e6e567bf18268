"""Command line: images to strokes, commands and metrics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plotweave.config import StrokeConfig, WorkArea
from plotweave.operators.metrics import as_json
from plotweave.plans.pipelines import stroke_metrics, stroke_run
from plotweave.sources import firmware, models, sinks
from plotweave.sources.images import pixels, read_images


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--image", required=True, help="an image, or a folder of images")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--model-path")
    p.add_argument("--segmentation-mode", choices=("ml", "heuristic", "auto"), default="auto")
    p.add_argument("--threshold", type=int, default=127)
    p.add_argument("--work-width-mm", type=float, default=150.0)
    p.add_argument("--work-height-mm", type=float, default=270.0)
    p.add_argument("--margin-mm", type=float, default=5.0)
    p.add_argument("--model-root", help="folder searched for a model if none is named")
    p.add_argument("--firmware", default="firmware.ino")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    area = WorkArea(args.work_width_mm, args.work_height_mm, args.margin_mm)
    model = args.model_path or (models.find_model(spark, args.model_root) if args.model_root else None)
    run = stroke_run(pixels(read_images(spark, args.image)), StrokeConfig(threshold=args.threshold, segmentation_mode=args.segmentation_mode), area, model)
    constants = firmware.read_constants(spark, args.firmware)
    for k, row in enumerate(run.transforms.select("image_id").orderBy("image_id").toLocalIterator()):
        own = run.commands.where(F.col("image_id") == row.image_id)
        base = f"{args.output_dir}/{k:05d}"
        sinks.write_lines(sinks.command_lines(own), f"{base}/arduino_commands")
        text = as_json(stroke_metrics(spark, run, row.image_id, constants, area))
        sinks.write_lines(spark.createDataFrame([(text,)], "line string"), f"{base}/stroke_metrics")


if __name__ == "__main__":
    main()
