"""Sharding by a two-pass external shuffle (operator 10), DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets of about BUCKET_BYTES, as the files of a Spark shuffle.  Pass two
reads each bucket, puts it in a canonical order, permutes it by Fisher-Yates (Spark's ``shuffle`` is the
inside-out form) and numbers the records: place in bucket plus the sizes of the buckets before it.  Number
r goes to shard ``r mod shards`` at slot ``r div shards``, so shard sizes differ by one record at most
(law ``rows``) and slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm.common import if_small, read
from plotweave.storage import materialise, new_path

#: Bytes and records in a bucket on average at most, the least number of buckets, and buckets in a task.
BUCKET_BYTES, BUCKET_ROWS, LEAST_BUCKETS, TASK_BUCKETS = 16 << 20, 65_536, 64, 4


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; null counts as no bytes."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _row_bytes(records: DataFrame) -> Column:
    """Bytes of a row, about: the length of texts and binaries, of the JSON of nested values, 8 for others."""
    parts = [F.lit(8)]
    for f in records.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(F.struct(c))
        elif not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.lit(8))
            continue
        parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
    return sum(parts[1:], parts[0]).cast("long")


def shuffle_shards(records: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``records`` with ``shard`` (int) and ``slot`` (long), shuffled globally.

    The bucket is a hash of the seed and of the whole row, so a null or repeated id fills no bucket of its own.
    Equal rows all stay and get different slots; where they are more than a quarter of a bucket in bytes, their places in
    the input go into the hash too, and ``records`` must then give its rows in the same order each time, as files do.
    Input columns named ``shard`` or ``slot`` are replaced.  An empty table gives an empty result.  ``shards`` must be positive.
    Rows are carried whole through both passes; columns of map type can't be hashed by Spark and are refused.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = records.drop("shard", "slot")
    cols = rows.columns
    whole = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in cols])
    sizes = materialise(rows.select(whole.alias("h"), _row_bytes(rows).alias("size")).groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "sizes")
    n, size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, math.ceil(n / bucket_rows), math.ceil(size / bucket_bytes))
    # At most four a bucket, so the list is short.
    heavy = [r.h for r in sizes.where((F.col("n") > 1) & ((F.col("size") > bucket_bytes // 4) | (F.col("n") > bucket_rows // 4))).select("h").collect()]

    def bucket(h: Column, place: Column | None = None) -> Column:
        salted = h if place is None else F.when(h.isin(heavy), F.xxhash64(h, place)).otherwise(h)
        return F.pmod(salted, F.lit(buckets)).cast("int").alias("__bucket")

    place = F.monotonically_increasing_id() if heavy else None
    scattered = rows.select(
        bucket(whole, place),
        F.struct(F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`")).alias("__h"), *[F.col(f"`{c}`") for c in cols]).alias("__rec"),
    )
    counted = rows.select(bucket(whole, place), F.lit(1).alias("n")) if heavy else sizes.select(bucket(F.col("h")), "n")
    counts = counted.groupBy("__bucket").agg(F.sum("n").alias("__n"))
    # One small row a bucket: the number of buckets grows by one in BUCKET_BYTES.
    offsets = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    offsets = offsets.fillna(0, ["__before"])

    # The order of groups and of records within them is fixed before the seeded generator runs: a task that
    # is run again draws the same permutation.
    gathered = scattered.repartition(math.ceil(buckets / TASK_BUCKETS), "__bucket").groupBy("__bucket").agg(F.sort_array(F.collect_list("__rec")).alias("__recs"))
    shuffled = gathered.sortWithinPartitions("__bucket").select("__bucket", F.shuffle("__recs", seed).alias("__recs"))
    placed = shuffled.join(if_small(materialise(offsets, "offsets")), "__bucket").select("__before", F.posexplode("__recs").alias("__pos", "__rec"))
    rank = F.col("__before") + F.col("__pos")
    return placed.select("__rec.*", (rank % shards).cast("int").alias("shard"), F.floor(rank / shards).cast("long").alias("slot")).drop("__h")


def write_shards(records: DataFrame, path: str, shards: int, seed: int = 42, id_col: str = "doc_id") -> None:
    """Write the records as Parquet below ``path``, a folder ``shard=N`` each; each task adds a file in slot order to each."""
    out = shuffle_shards(records, shards, seed, id_col)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def sharded(records: DataFrame, shards: int) -> DataFrame:
    """Write whole records as shards and read the files: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    path = new_path(records.sparkSession, "shards")
    write_shards(records, path, shards)
    written = T.StructType([*records.drop("shard", "slot").schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return records.sparkSession.read.schema(written).parquet(path).select("doc_id", text_bytes(F.col("text")).alias("size"), crc, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document, written whole to one of 16 shards; the columns are computed from the files."""
    out = sharded(read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
