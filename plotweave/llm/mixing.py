"""Mixing sources to target weights by Poisson replication (operator 2).

A source of size s with target share w gets the mean repetition rate w * total / s.  Each document draws its
number of copies by inverting the Poisson distribution of its source's rate at a point in [0, 1) that is a
hash of seed and id: nothing depends on partitions or on the order of rows.  Documents are exploded
by their counts and dealt out by a hash of (id, copy): a global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import BROADCAST_ROWS, read
from plotweave.storage import materialise

SEED = 42
#: Without given weights a source's target is its size to this power: 1 leaves the mix, 0 makes all sources equal.
POWER = 0.7
#: Copies of the rate table, if it is too large to broadcast, to split a source that holds much of the rows.
SALTS = 64


def _unit(text: Column) -> Column:
    """A point in [0, 1): the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, n_bytes, rate, first, cdf)`` for each source; ``cdf`` holds the Poisson distribution function from ``first`` on.

    Sizes are UTF-8 bytes plus one a document, over all documents.  With ``weights``, sources not named there
    have weight zero; a null source is a source of its own, named None in ``weights``.  Weights must not be
    negative.  The shares of sources present are scaled to one, so the expected size of the mix is that of the input.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.octet_length(F.coalesce(text_col, F.lit(""))) + 1).cast("long").alias("n_bytes"))
    if weights is None:
        weight = F.pow(F.col("n_bytes").cast("double"), power)
        sizes = sizes.withColumn("weight", weight)
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        rows = [(k, float(w)) for k, w in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "wsource string, weight double")
        sizes = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("wsource")), "left").drop("wsource").fillna(0.0, ["weight"])
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.sum("n_bytes").alias("n"), F.sum("weight").alias("w")).first()
    n, w = float(total.n or 0), float(total.w or 0) or 1.0
    rate = F.col("weight") / w * n / F.col("n_bytes")
    made = materialise(sizes.withColumn("rate", rate).drop("weight"), "rates")
    # A source's terms, from its least likely count worth a term to the last: some 24 times the root of the rate.  They are made from
    # logarithms of ratios and scaled to one; what is left out is below 2^-52.
    reach = "12 * sqrt(rate) + 20"
    first, last = f"cast(greatest(0, floor(rate - ({reach}))) as int)", f"cast(ceil(rate + {reach}) as int)"
    terms = made.where("rate > 0").select("source", "rate", F.expr(first).alias("first"), F.explode(F.expr(f"sequence({first}, {last})")).alias("j"))
    upto = Window.partitionBy("source").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("l", F.sum(F.when(F.col("j") == F.col("first"), 0.0).otherwise(F.log(F.col("rate") / F.col("j")))).over(upto))
    terms = terms.withColumn("p", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("source"))))
    terms = terms.withColumn("c", F.sum("p").over(upto) / F.sum("p").over(Window.partitionBy("source")))
    listed = terms.groupBy(F.col("source").alias("lsource")).agg(F.min("first").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("cdf"))
    out = made.join(listed, F.col("source").eqNullSafe(F.col("lsource")), "left")
    return materialise(out.select("source", "n_bytes", "rate", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("cdf", F.array(F.lit(1.0))).alias("cdf")), "cdfs")


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, with ``copy`` (from 1), ``copies`` and ``mix_key``.

    ``mix_key`` (16 hex digits) orders the mix at random; partitions and the rows in them follow it.  Rows with
    equal ids draw the same count; a null id draws as the word "null".  Columns that bear one of the three new
    names are replaced; other columns stay.  An empty table gives an empty mix.
    """
    docs = docs.drop("copy", "copies", "mix_key")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    table = rates(docs, weights, power, source_col, text_col).select(F.col("source").alias("s"), "first", "cdf")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("own"), name.alias("name"))
    size = table.agg(F.coalesce(F.sum(F.size("cdf") + 10), F.lit(0)).alias("n")).first().n
    if size <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(table), F.col("own").eqNullSafe(F.col("s")))
    else:
        salted = table.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", mine).join(salted, F.col("own").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("k")))
    u = _unit(F.concat(F.lit(f"{seed}:"), F.col("name")))
    # The arrays don't go further than this; those of a source are as long as the root of its copies.
    counted = joined.withColumn("u", u).select("row", "name", (F.col("first") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).alias("copies"))
    out = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("name"), F.lit(":"), F.col("copy").cast("string")).cast("binary")), 1, 16)
    out = out.select(*[F.col("row")[c].alias(c) for c in docs.columns], "copies", "copy", key.alias("mix_key"))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the mix of all documents, whole texts included."""
    mixed = poisson_mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copies", "copy", "mix_key", F.octet_length("text").cast("long").alias("n_bytes"), "text")


SQL = f"""
WITH sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) AS n_bytes FROM documents GROUP BY source),
shares AS (
  SELECT source, pow(n_bytes, {POWER}) / (SELECT sum(pow(n_bytes, {POWER})) FROM sizes) * (SELECT sum(n_bytes) FROM sizes) / n_bytes AS rate FROM sizes),
terms AS (
  SELECT source, j, exp(j * ln(rate) - rate - lgamma(j + 1)) AS p
  FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS j FROM shares) t),
cdf AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM terms),
points AS (
  SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
drawn AS (
  SELECT p.doc_id, p.source, p.text, CAST(count(*) AS INTEGER) AS copies
  FROM points p JOIN cdf ON p.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= p.u GROUP BY p.doc_id, p.source, p.text),
each AS (
  SELECT doc_id, source, text, copies, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM drawn)
SELECT doc_id, source, copies, copy, substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 16) AS mix_key,
  CAST(strlen(text) AS BIGINT) AS n_bytes, text
FROM each
"""
