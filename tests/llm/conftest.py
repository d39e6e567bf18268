from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "vo", "shi", "pe"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def table(spark: SparkSession, rows: list[tuple[int | None, str | None]], source: str | None = "s0") -> DataFrame:
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, prose(5, 80)), (6, prose(5, 80)), (6, prose(5, 80)), (7, long), (None, prose(8, 40)), (None, None), (9, "one"), (10, "É a b\n\nc  d\x1ce")]


@pytest.fixture(scope="session")
def odd(spark: SparkSession, odd_rows: list) -> DataFrame:
    """The odd rows with columns whose names operators use for their own."""
    from pyspark.sql import functions as F

    docs = table(spark, odd_rows)
    for name in ("fp", "rid", "copy", "shard", "slot", "y", "x", "a", "b", "n", "k", "h", "words", "removed", "component_id", "score"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
