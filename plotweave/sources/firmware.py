"""Firmware constants out of source text, with typed defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and defaults of the machine's constants.
DEFAULTS = {
    "BELT_PITCH_MM": 2.0,
    "PULLEY_TEETH": 20.0,
    "FULL_STEPS_PER_REV": 200.0,
    "MICROSTEPS": 16.0,
    "DRAW_SPEED": 1100.0,
    "TRAVEL_SPEED": 1800.0,
    "SERVO_DELAY_MS": 15.0,
    "PEN_SETTLE_MS": 1000.0,
    "PEN_UP_ANGLE": 95.0,
    "PEN_DOWN_ANGLE": 80.0,
}
#: Fixed value: how a constant is declared.
DECLARATION = r"const\s+(?:float|int)\s+([A-Z0-9_]+)\s*=\s*([-+]?\d+(?:\.\d+)?)\s*;"


def declared(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """``(name, value)`` of every declaration in the texts; the last of a name wins, by ``ord`` (if there) and place."""
    t = f"`{text_col}`"
    order = "ord" if "ord" in texts.columns else "0"
    pairs = f"arrays_zip(regexp_extract_all({t}, r'{DECLARATION}', 1), regexp_extract_all({t}, r'{DECLARATION}', 2))"
    rows = texts.select(F.expr(f"cast({order} as bigint)").alias("o"), F.posexplode(F.expr(pairs)).alias("p", "m"))
    rows = rows.select(F.struct("o", "p").alias("at"), F.col("m.0").alias("name"), F.col("m.1").cast("double").alias("value"))
    return rows.groupBy("name").agg(F.max_by("value", "at").alias("value"))


def constants(spark: SparkSession, texts: DataFrame | None, missing: str | None = None) -> DataFrame:
    """``(name, value, warning)``, a row for each default; unknown names are ignored, no texts gives the defaults and a warning."""
    base = spark.createDataFrame(list(DEFAULTS.items()), "name string, fallback double")
    if texts is None:
        return base.select("name", F.col("fallback").alias("value"), F.lit(f"Firmware not found: {missing}").alias("warning"))
    found = declared(texts)
    return base.join(F.broadcast(found.where(F.col("name").isin(*DEFAULTS))), "name", "left").select("name", F.coalesce("value", "fallback").alias("value"), F.lit(None).cast("string").alias("warning"))


def read_constants(spark: SparkSession, path: str) -> dict[str, object]:
    """The constants in a file as a dict in the order of the defaults; a missing file gives the defaults and a warning."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    rows = constants(spark, spark.read.text(path, wholetext=True) if there else None, path).collect()
    values = {r.name: r.value for r in rows}
    out: dict[str, object] = {n: values[n] for n in DEFAULTS}
    if not there:
        out["firmware_parse_warning"] = rows[0].warning
    return out
