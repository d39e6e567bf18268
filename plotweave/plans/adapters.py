"""The driver's tables as pixel, path and command tables, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plotweave.storage import dealt

SIDE = 8
#: Drawings a task: each has some 110 pixels.
TASK_DRAWINGS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an image of 8 by 8 pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128) + F.lit(400) * F.col("e").cast("double")))).cast("int")
    return rows.select("image_id", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), gray.alias("gray"))


def mask8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels8(spark, sf_dir).where("gray < 127").drop("gray")


def drawings(spark: SparkSession, sf_dir: str, of: str = "part") -> DataFrame:
    """Each part, or supplier, as a drawing of 32 by 32 pixels, of which the ink is given: two rows and two columns, placed by its numbers."""
    key, size = {"part": (F.col("p_partkey"), F.col("p_size")), "supplier": (F.col("s_suppkey"), F.col("s_nationkey"))}[of]
    places = F.explode(F.sequence(F.lit(1), F.lit(30))).alias("t")
    rows = table(spark, sf_dir, of).select(key.alias("image_id"), (size % 9 + 3).alias("y1"), (size % 7 + 19).alias("y2"), (key % 8 + 4).cast("int").alias("x1"), (key % 9 + 18).cast("int").alias("x2"))
    rows = dealt(rows, "image_id", TASK_DRAWINGS).select("*", places)
    at = F.array(*[F.struct(y.alias("y"), x.alias("x")) for y, x in ((F.col("y1"), F.col("t")), (F.col("y2"), F.col("t")), (F.col("t"), F.col("x1")), (F.col("t"), F.col("x2")))])
    ink = rows.select("image_id", F.explode(at).alias("p")).distinct()
    return ink.select("image_id", F.lit(32).alias("h"), F.lit(32).alias("w"), "p.y", "p.x", F.lit(0).alias("gray"))


def logits3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as 21 pixels of three channels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda e: e.cast("double") * 10).alias("e"))
    rows = rows.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"), "e")
    return rows.select("image_id", F.lit(1).alias("h"), F.lit(21).alias("w"), F.lit(0).alias("y"), "x", F.slice("e", F.col("x") * 3 + 1, 3).alias("z"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time as a polyline; four users' remainders make the images."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("image_id"), F.col("user_id").alias("path_id"), seq.alias("seq"), F.col("value").alias("x"), k.alias("y"), "event_type")


def sizes(points: DataFrame) -> DataFrame:
    """Image sizes that hold all points of a path table."""
    return points.groupBy("image_id").agg((F.ceil(F.max("x")) + 1).cast("int").alias("w"), (F.ceil(F.max("y")) + 1).cast("int").alias("h"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of an image as commands: clicks, views and purchases draw."""
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("path_id", "seq")) - 1
    mode = F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0)
    return paths(spark, sf_dir).select("image_id", idx.cast("long").alias("cmd_idx"), F.col("x").alias("x_mm"), F.col("y").alias("y_mm"), mode.alias("mode"))


#: The same carriers in SQL, as parts of a WITH clause.
PX = """px AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
  CAST(greatest(0, least(255, floor(128 + 400 * CAST(embedding[i] AS DOUBLE)))) AS INTEGER) AS gray
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) n)"""
MASK = PX + ", mask AS (SELECT image_id, y, x FROM px WHERE gray < 127)"
DRAWN = """ink AS (SELECT p_partkey AS image_id, CAST(p_size % 9 + 3 AS INTEGER) AS y1, CAST(p_size % 7 + 19 AS INTEGER) AS y2, CAST(p_partkey % 8 + 4 AS INTEGER) AS x1, CAST(p_partkey % 9 + 18 AS INTEGER) AS x2, CAST(t AS INTEGER) AS t
  FROM part, (SELECT unnest(range(1, 31)) AS t) n),
mask AS (SELECT image_id, y1 AS y, t AS x FROM ink UNION SELECT image_id, y2, t FROM ink UNION SELECT image_id, t, x1 FROM ink UNION SELECT image_id, t, x2 FROM ink)"""
BOX = "box AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)"
RING = "ring AS (SELECT unnest([-1, -1, 0, 1, 1, 1, 0, -1]) AS dy, unnest([0, 1, 1, 1, 0, -1, -1, -1]) AS dx, unnest(range(0, 8)) AS k)"
CODE = RING + """, code AS (SELECT m.image_id, m.y, m.x, CAST(coalesce(bit_or(CASE WHEN n.x IS NULL THEN 0 ELSE 1 << k END), 0) AS INTEGER) AS code
  FROM mask m CROSS JOIN ring LEFT JOIN mask n ON n.image_id = m.image_id AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY m.image_id, m.y, m.x)"""
POLY = """poly AS (SELECT user_id % 4 AS image_id, user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS seq,
  value AS x, CAST(regexp_extract(props, '"k": *([-0-9.]+)', 1) AS DOUBLE) AS y, event_type FROM events)"""
CMDS = POLY + """, cmds AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY path_id, seq) - 1 AS cmd_idx, x AS x_mm, y AS y_mm,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS mode FROM poly)"""
SIZES = "sizes AS (SELECT image_id, CAST(ceil(max(x)) + 1 AS INTEGER) AS w, CAST(ceil(max(y)) + 1 AS INTEGER) AS h FROM poly GROUP BY image_id)"
CLOSED = """ends AS (SELECT image_id, path_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS b_y, max(seq) + 1 AS seq, count(*) AS n FROM poly GROUP BY image_id, path_id),
closed AS (SELECT image_id, path_id, seq, x, y FROM poly UNION ALL SELECT image_id, path_id, CAST(seq AS INTEGER), ax, ay FROM ends WHERE n > 1 AND NOT (ax = bx AND ay = b_y))"""
