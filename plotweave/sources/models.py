"""Finding a model file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: suffixes of model files.
SUFFIXES = (".pt", ".pth", ".ckpt", ".h5", ".keras", ".pb")


def is_model(path: Column) -> Column:
    """Whether a path names a model file outside any ``.venv`` folder."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return suffix.isin(*SUFFIXES) & ~F.array_contains(F.split(path, "/"), ".venv")


def first_model(paths: DataFrame, col: str = "path") -> DataFrame:
    """``(model_path)``: one row, the least path of a model file, or null."""
    return paths.where(is_model(F.col(col))).agg(F.min(col).alias("model_path"))


def find_model(spark: SparkSession, root: str) -> str | None:
    """The first model file below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return first_model(files).first().model_path
