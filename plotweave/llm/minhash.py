"""Document fingerprints by one-permutation MinHash (operator 6), SQL functions only.

Each shingle of five words is hashed once; the top bits of the hash name one of ``BINS`` bins, each bin keeps
its least hash.  An empty bin copies a bin that is not: bins are tried by a hash of (bin, attempt), the same for
all documents (optimal densification).  Of each bin the ``BITS`` lowest bits are stored, sixteen bins to a long.
The likeness of two fingerprints is the share of equal bins, corrected for the 2^-BITS that agree by chance.
All of it happens inside the row: there is no explode and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import WORD_SPACE, read
from plotweave.storage import materialise

BINS, BITS, SHINGLE_WORDS = 256, 4, 5
#: Attempts of densification written out; beyond them the bin of least hash among the full ones is taken.
ATTEMPTS = 12
#: Documents that one window task orders, and the most such tasks' ranges.
RANGE_ROWS, MOST_RANGES = 8_192, 4_096


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fingerprint_sql(text: str) -> str:
    space = WORD_SPACE.replace("\\", "\\\\")
    n, words = SHINGLE_WORDS, BINS // 64
    shingle = ", ".join(f"get(wh, i + {k})" for k in range(n))
    bin_of = "(cast(shiftrightunsigned({0}, 56) as int) ^ 128)"  # so that the order of longs is that of bins
    full = "(shiftrightunsigned(get(mask, {0} div 64), {0} % 64) & 1L) = 1L"
    # Place of a full bin among the full ones: bits set below it.
    place = "get(below, {0} div 64) + bit_count(get(mask, {0} div 64) & ~shiftleft(-1L, {0} % 64))"
    value = f"cast(get(least, cast({place} as int)) & {(1 << BITS) - 1}L as long)"
    tries = [f"cast(xxhash64({t}, j) & {BINS - 1}L as int)" for t in range(ATTEMPTS)]
    # least hash of (bin, full bin): where the first full one in a random order of all bins would be
    last = f"array_min(transform(least, x -> struct(xxhash64(-1, j, {bin_of.format('x')}) as h, x & {(1 << BITS) - 1}L as v))).v"
    chosen = [f"case when {full.format('j')} then {value.format('j')} end"]
    chosen += [_let(c, f"c{t}", f"case when {full.format(f'c{t}')} then {value.format(f'c{t}')} end") for t, c in enumerate(tries)]
    bins = f"transform(sequence(0, {BINS - 1}), j -> coalesce({', '.join(chosen)}, {last}))"
    packed = f"transform(sequence(0, {BINS // 16 - 1}), w -> aggregate(slice(bins, w * 16 + 1, 16), 0L, (a, v) -> shiftleft(a, {BITS}) | v))"
    mask = f"transform(sequence(0, {words - 1}), w -> aggregate(least, 0L, (a, x) -> case when {bin_of.format('x')} div 64 = w then a | shiftleft(1L, {bin_of.format('x')} % 64) else a end))"
    below = f"transform(sequence(0, {words - 1}), w -> aggregate(slice(mask, 1, w), 0, (a, m) -> a + bit_count(m)))"
    least = f"filter(sorted, (x, i) -> i = 0 or {bin_of.format('x')} <> {bin_of.format('get(sorted, i - 1)')})"
    shingles = f"case when size(wh) > {n - 1} then transform(sequence(0, size(wh) - {n}), i -> xxhash64({shingle})) else array(xxhash64(wh)) end"
    bare = f"btrim({text}, ' \\t\\n\\u000b\\f\\r')"
    wh = f"transform(filter(split({bare}, '{space}'), w -> w <> ''), w -> xxhash64(w))"
    body = _let(bins, "bins", packed)
    for value_, name in ((below, "below"), (mask, "mask"), (least, "least"), (f"sort_array({shingles})", "sorted"), (wh, "wh")):
        body = _let(value_, name, body)
    return body


def fingerprint(text: str) -> Column:
    """The packed fingerprint of the text column named, an array of longs.

    Words lie between ASCII white space, case counts.  A text with fewer than five words has one shingle, all its
    words; texts without words (empty, blank) have one fingerprint in common.  The column must not be null.
    """
    return F.expr(_fingerprint_sql(f"`{text}`"))


def as_text(fp: str) -> Column:
    return F.expr(f"array_join(transform({fp}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two fingerprints, 0 to 1."""
    differ = "bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L)"
    equal = f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), {BINS}, (n, x) -> n - {differ})"
    chance = 2.0**-BITS
    return F.expr(f"greatest(0D, ({equal} / {float(BINS)}D - {chance}D) / {1 - chance}D)")


def id_ranges(docs: DataFrame, id_col: str) -> Column:
    """Number of the range of ids a row lies in, larger for larger ids, -1 for null: about equal row counts."""
    n = docs.count()
    count = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    cuts: list[int] = []
    if count > 1:
        at = ", ".join(f"{i / count!r}D" for i in range(1, count))
        cuts = sorted(set(docs.agg(F.expr(f"percentile_approx(`{id_col}`, array({at}), {20 * count})").alias("q")).first().q or []))
    if not cuts:
        return F.when(F.col(id_col).isNull(), -1).otherwise(0)
    # Two steps of about the square root of the number of cuts each.
    step = math.ceil(math.sqrt(len(cuts)))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = "array(" + ", ".join(f"{p[0]}L" for p in parts) + ")"
    inner = "array(" + ", ".join("array(" + ", ".join(f"{c}L" for c in p) + ")" for p in parts) + ")"
    outer = f"size(filter({heads}, c -> c < `{id_col}`))"
    fine = _let(outer, "o", f"case when o = 0 then 0 else (o - 1) * {step} + size(filter(get({inner}, o - 1), c -> c < `{id_col}`)) end")
    return F.expr(f"case when `{id_col}` is null then -1 else {fine} end")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, fp, next_text, next_fp)``: each text beside the next one's by descending id, the first's after the last.

    Null texts count as empty, null ids come last, equal ids are ordered by a hash of the text.  Ids are cut into
    ranges of about equal size, each ordered by one task; a copy of the following range's first row is put at
    the end of each range, so that no task sees more than its range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket = id_ranges(rows, "doc_id")
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), bucket.alias("r"))
    # One row a range: its first id and the range that comes before it.
    tops = rows.select("doc_id", bucket.alias("r")).groupBy("r").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("r"))
    before = F.coalesce(F.lag("r").over(order), F.min("r").over(Window.partitionBy(F.lit(1))))
    tops = materialise(tops.select("r", "top", before.alias("before")), "tops")
    heads = keyed.join(F.broadcast(tops.withColumnRenamed("r", "tr")), (F.col("r") == F.col("tr")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("before").agg(F.min_by("text", "tie").alias("text"))
    marked = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), F.col("before").alias("r"), F.lit(1).alias("copy"))
    every = keyed.withColumn("copy", F.lit(0)).unionByName(marked).withColumn("fp", fingerprint("text"))
    w = Window.partitionBy("r").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    out = every.select("doc_id", "text", "fp", "copy", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp"))
    return out.where("copy = 0").drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of all documents and of their edited texts."""
    rows = with_next(read(spark, sf_dir, "documents"))
    half = "length(text) div 2"
    edited = F.expr(f"concat(left(text, cast(length(text) - {half} as int)), left(next_text, cast({half} as int)))")
    rows = rows.withColumn("edited", edited).withColumn("efp", fingerprint("edited"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
