"""Benchmark decontamination by SimHash of item-sized windows (operator 1), DataFrame functions only.

A window of a document has as many words as a benchmark item and is placed where the two share a word shingle:
a window that reaches the similarity asked for shares most shingles, so no such place is missed, and texts that
share none have no window.  Windows and items get a 64-bit SimHash of their shingles, each weighted
by how often it occurs.  Fingerprints are cut into blocks; the items' blocks, each with the Hamming ball that makes every
pair within the radius meet in some block, form the index in which windows look up theirs.  Pairs within the
radius are verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import BROADCAST_ROWS, if_small, read, row_key, without_ids
from plotweave.storage import materialise

SIMILARITY, SHINGLE_WORDS, BLOCKS = 0.8, 5, 7
#: Standard deviations over the mean distance at the least similarity that the radius allows.
SLACK = 3.5
#: Items up to which their index, about 340 rows of 50 bytes each, is broadcast; beyond, the look-up shuffles.
INDEX_ITEMS = 2_000


def radius_for(similarity: float) -> int:
    """Hamming radius that pairs of this weighted Jaccard similarity stay within, but for one in thousands.

    Sets of similarity s have cosine 2s / (1 + s); each of 64 bits differs with probability angle / pi.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(64 * p + SLACK * math.sqrt(64 * p * (1 - p)))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words (runs of letters and digits) of a text; null gives none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    found = F.transform(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(found)


def shingles(wh: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order."""
    one = lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(width)])
    return F.when(F.size(wh) >= width, F.transform(F.sequence(F.lit(0), F.size(wh) - width), one)).otherwise(F.array().cast("array<bigint>"))


def _all_shingles(text: Column, widths: list[int]) -> Column:
    """Number of words of a text, and its shingles of all ``widths``, one width after the other; words are hashed once."""
    return _let(word_hashes(text), lambda wh: F.struct(F.size(wh).alias("len"), F.concat(*[shingles(wh, w) for w in widths]).alias("sh")))


def simhash(hashes: str) -> Column:
    """Bitwise majority of an array of long hashes; equal hashes count each time, ties give zero bits."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(getbit(h, b) as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (a, b) -> case when 2 * {ones} > size({hashes}) then a | shiftleft(1L, b) else a end)")


def _blocks(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE_WORDS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words)``: each document and item of which a window is similar enough.

    The best window counts, the first of equally good ones among those placed.  An item shorter than a shingle is one shingle; an item or a
    document without words matches nothing; a document shorter than the item is one window.  Rows with
    equal id give one row an item; a null id is reported as null.  Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("wh")).where("size(wh) > 0")
    items = items.select("item_id", F.size("wh").alias("n"), F.least(F.size("wh"), F.lit(shingle)).alias("width"), "wh")
    by_width = F.coalesce(*[F.when(F.col("width") == w, shingles(F.col("wh"), w)) for w in range(1, shingle + 1)])
    items = materialise(items.select("item_id", "n", "width", by_width.alias("ish")).withColumn("ifp", simhash("ish")), "items")
    known = items.agg(F.collect_set("width").alias("widths"), F.count("*").alias("n"), F.coalesce(F.sum(F.size("ish")), F.lit(0)).alias("places")).first()
    widths = sorted(known.widths, reverse=True) or [shingle]

    # Where text and item share a shingle.  The shingles of the widths before in the list are skipped to get the place.
    keyed = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    places = items.select("n", "width", F.posexplode("ish").alias("off", "h")).distinct()
    at = keyed.select("r1", "r2", _all_shingles(F.col("text"), widths).alias("w")).select("r1", "r2", F.col("w.len").alias("len"), F.posexplode("w.sh").alias("pos", "sh"))
    at = at.join(F.broadcast(places) if known.places <= BROADCAST_ROWS else places, F.col("sh") == F.col("h"))
    skipped = F.lit(0)
    for k, w in enumerate(widths):
        before = sum((F.greatest(F.col("len") - v + 1, F.lit(0)) for v in widths[:k]), F.lit(0))
        skipped = F.when(F.col("width") == w, before).otherwise(skipped)
    start = F.greatest(F.lit(0), F.least(F.col("pos") - skipped - F.col("off"), F.col("len") - F.col("n")))
    windows = materialise(at.select("r1", "r2", "n", "width", start.alias("start")).distinct(), "windows")

    wanted = if_small(windows.select("r1", "r2").distinct())
    found = keyed.join(wanted, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    found = found.select("doc_id", F.col("r1").alias("d1"), F.col("r2").alias("d2"), word_hashes(F.col("text")).alias("wh"))
    cut = windows.join(found, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2"))).select("doc_id", "n", "width", "start", F.slice("wh", F.col("start") + 1, F.col("n")).alias("part"))
    own = F.coalesce(*[F.when(F.col("width") == w, shingles(F.col("part"), w)) for w in widths])
    cut = cut.select("doc_id", "n", "start", own.alias("wsh")).where("size(wsh) > 0")
    # The windows of a passage that many documents share are computed and looked up once; 128 bits name them.
    texts = materialise(cut.withColumns({"w1": F.xxhash64(F.lit(1), "n", "wsh"), "w2": F.xxhash64(F.lit(2), "n", "wsh")}), "cut")
    prints = materialise(texts.select("w1", "w2", "n", "wsh").dropDuplicates(["w1", "w2"]).withColumn("fp", simhash("wsh")), "prints")

    radius = radius_for(similarity)
    ball = radius // blocks
    shifts, widths_ = zip(*_blocks(blocks))
    block = f"struct(k, cast(shiftrightunsigned({{0}}, array({', '.join(map(str, shifts))})[k]) & (shiftleft(1, array({', '.join(map(str, widths_))})[k]) - 1) as int)"
    asked = F.expr(f"inline(transform(sequence(0, {blocks - 1}), k -> {block.format('fp')} as key)))")
    masks = f"filter(sequence(0, shiftleft(1, array({', '.join(map(str, widths_))})[k]) - 1), m -> bit_count(m) <= {ball})"
    index = items.select("item_id", "ifp", F.col("n").alias("n2"), F.expr(f"inline(transform(sequence(0, {blocks - 1}), k -> {block.format('ifp')} as key, {masks} as masks)))"))
    index = index.select("item_id", "ifp", "n2", F.col("k").alias("k2"), F.explode(F.transform("masks", lambda m: F.col("key").bitwiseXOR(m))).alias("key2"))
    asked = prints.select("w1", "w2", "n", "fp", "wsh", asked).toDF("w1", "w2", "n", "fp", "wsh", "k", "key")
    near = (F.col("n") == F.col("n2")) & (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    small = known.n <= INDEX_ITEMS and known.places <= BROADCAST_ROWS
    own = items.select(F.col("item_id").alias("iid"), "ish")
    pairs = asked.join(F.broadcast(index) if small else index, near).select("w1", "w2", "wsh", "item_id")
    pairs = pairs.join(F.broadcast(own) if small else own, F.col("item_id").eqNullSafe(F.col("iid")))
    common = "aggregate(array_distinct(ish), 0, (a, x) -> a + least(size(filter(ish, y -> y = x)), size(filter(wsh, y -> y = x))))"
    scored = pairs.withColumn("m", F.expr(common)).withColumn("similarity", F.col("m") / (F.size("wsh") + F.size("ish") - F.col("m")))
    good = materialise(scored.where(F.col("similarity") >= similarity).select("w1", "w2", "item_id", "similarity").distinct(), "good")
    named = texts.select("doc_id", "w1", "w2", "start", "n").join(if_small(good), ["w1", "w2"])
    best = named.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, rows with null ids too."""
    found = leaks(docs, benchmark, id_col=id_col).select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return without_ids(docs, materialise(found, "leaked"), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents against all benchmark items."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
