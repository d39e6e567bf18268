"""Near copies for the pipeline: SimHash classes over five-word shingles, and sets of these of Jaccard similarity 0.8 or more.

Rows with equal sets are one node.  First operator 5 links them: texts whose SimHash fingerprints differ in RADIUS bits or
fewer, found by multi-index hashing.  As texts of similarity 0.8 differ in more bits, those are looked for as well, and both kinds of links make the
classes.  Nodes that agree in a band of a MinHash signature are candidates; every candidate
pair is verified by the sizes of the sets (of 64-bit shingle hashes), and verified pairs are linked to classes.  At similarity
0.8 a pair has no band in common with probability (1 - 0.8**ROWS)**BANDS, about 3 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm.common import give_back, if_small, slices, small_batches
from plotweave.llm import simhash
from plotweave.llm.simhash import SEED, shingle_hashes
from plotweave.operators.components import connected_components
from plotweave.storage import materialise, unsent

SHINGLE_WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; none for one without words."""
    return np.unique(np.frombuffer(shingle_hashes(text, SHINGLE_WORDS)[0], np.uint64))


def node(shingles: np.ndarray) -> int:
    """What texts with equal sets share, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band of the signature, the band's number in it; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):  # bounded memory for very long texts
        low = np.minimum(low, (shingles[i : i + 2048] * _A[:, None] + _B[:, None]).min(1))
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 256 bins, as four longs: two sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _signed(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs`` with ``__node``, ``__bands`` and the SimHash fingerprint ``__fp``."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, fps = [], [], []
            for texts in slices(b.column(at)):
                hashes = [shingle_hashes(t, SHINGLE_WORDS) for t in texts]
                fps += [simhash.majority(*h) for h in hashes]
                sets = [np.unique(np.frombuffer(h, np.uint64)) for h, _ in hashes]
                nodes += [node(s) for s in sets]
                keys += [bands(s) for s in sets]
            own = [pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())]
            yield pa.record_batch([*b.columns, *own], [*b.schema.names, "__node", "__bands", "__fp"])
        give_back()

    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, signed: DataFrame, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that are similar, other columns along; texts are joined last by ``a``, of which no few are common."""
    needed = materialise(pairs.select(F.col("a").alias("__node")).union(pairs.select("b")).distinct(), "needed")
    texts = signed.select("__node", F.col(text_col).alias("t")).join(if_small(needed), "__node", "left_semi")
    texts = materialise(texts.groupBy("__node").agg(F.first("t").alias("t")), "texts")
    rest = pairs.columns
    first = texts.select(F.col("__node").alias("b"), F.col("t").alias("tb"))
    second = texts.select(F.col("__node").alias("a"), F.col("t").alias("ta"))
    joined = pairs.join(first, "b").join(second, "a").select(*rest, "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, np.ndarray] = {}
            tas, tbs = b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist()
            for t in {*tas, *tbs}:
                sets[t] = shingle_set(t)
            keep = pa.array([similar(sets[x], sets[y]) for x, y in zip(tas, tbs)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns[: len(rest)], names=rest).filter(keep)
        give_back()

    with small_batches(pairs.sparkSession, 256):
        return materialise(joined.mapInArrow(run, pairs.schema).distinct(), "verified")


def _prefixes(open_: DataFrame, signed: DataFrame, text_col: str) -> DataFrame:
    """``(token, node, c, n, at, sketch)``: the rarest shingles of the nodes ``open_(node, c)``, as many as two similar sets can't do without.

    Shingles are ranked by the number of open nodes that have them.  Of two sets of similarity 0.8 or more, at most a fifth of either
    is not in the other, so the first ``n - ceil(0.8 n) + 1`` of each have one in common.  ``n`` is the size of the set, ``at`` the
    rank in it.  Shingles of one node only join nothing and are left out.
    """
    at = signed.columns.index(text_col)
    nodes = open_.select("node", "c").distinct()
    texts = signed.join(if_small(materialise(nodes, "nodes")).withColumnRenamed("node", "__open"), F.col("__node") == F.col("__open"))
    texts = texts.groupBy(F.col("__node").alias("node")).agg(F.first("c").alias("c"), F.first(signed.columns[at]).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for texts in slices(b.column(2)) for t in texts]
            cols = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), sketch)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], ["node", "c", "shingles", "sketch"])
        give_back()

    with small_batches(signed.sparkSession, 256):
        sets = materialise(texts.mapInArrow(run, "node long, c long, shingles array<long>, sketch array<long>"), "sets")
    own = sets.select("node", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    held = own.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("held"))
    ranked = own.join(held, F.col("token") == F.col("t")).groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("s"))
    first = F.slice("s", 1, F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9).cast("int") + 1)
    rare = ranked.select("node", "c", "n", F.posexplode(first).alias("at", "s")).where("s.held > 1")
    drawn = sets.select(F.col("node").alias("n1"), "sketch")
    return rare.join(drawn, F.col("node") == F.col("n1")).select("s.token", "node", "c", "n", "at", "sketch")


def _possible(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``(a, b, c, d)`` of nodes of different classes that share a prefix shingle, and by sizes, ranks and sketches may be similar.

    Similar sets differ in at most a ninth of the sum of their sizes.
    """
    m, n = F.col("n"), F.col("n2")
    enough = F.least(m - F.col("at"), n - F.col("at2")) >= SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-9
    sizes = F.least(m, n) >= SIMILARITY * F.greatest(m, n) - 1e-9
    differ = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("s2")[i])) for i in range(4))
    near = differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (m + n) + 1e-9
    other = right.select(F.col("token").alias("t2"), F.col("node").alias("b"), F.col("c").alias("d"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("sketch").alias("s2"))
    joined = left.join(other, (F.col("token") == F.col("t2")) & (F.col("c") != F.col("d")) & sizes & enough & near)
    return joined.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), F.when(F.col("node") > F.col("b"), F.col("c")).otherwise(F.col("d")).alias("c"), F.when(F.col("node") > F.col("b"), F.col("d")).otherwise(F.col("c")).alias("d")).distinct()


def _merged(pairs: DataFrame, signed: DataFrame, text_col: str) -> DataFrame:
    """``(old, new)``: the classes that similar ``pairs`` link, and the least class that each can reach."""
    links = _verified(materialise(pairs, "pairs"), signed, text_col).select("c", "d").distinct()
    return materialise(connected_components(links, "c", "d").select(F.col("node").alias("old"), F.col("label").alias("new")), "merged")


def _renamed(rows: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    joined = rows.join(if_small(merged), F.col(column) == F.col("old"), "left")
    return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new")


def _alike(prints: DataFrame) -> DataFrame:
    """``(a, b)``: each node of ``prints(n, fp)`` with the least one of its SimHash class.  A node whose rows repeat shingles may have several fingerprints."""
    labels = materialise(simhash.classes(prints.select("fp").distinct()), "labels")
    named = materialise(prints.join(unsent(labels), F.col("fp") == F.col("node")).select("n", "label"), "alike")
    least = named.groupBy("label").agg(F.min("n").alias("b"), F.max("n").alias("most")).where("b <> most").select("label", "b")
    return named.join(if_small(materialise(least, "ends")), "label").where("n <> b").select(F.col("n").alias("a"), "b")


def _classes(nodes: DataFrame, prints: DataFrame, signed: DataFrame, text_col: str) -> DataFrame:
    """``(node, label)`` of the nodes that have a near copy.

    Nodes of one SimHash class are linked from the start.  Then each node is held only against the least one in each of its cells, which joins nearly all of a large group of near
    copies.  Nodes of cells that hold several classes still are open: all links among them are found by their rarest shingles,
    first each node against two of each of its prefix shingles, drawn by hash, then all pairs whose classes differ still and whose sizes
    ranks and sketches allow the similarity.  Texts that merely share a frequent passage have it at the end of the ranking and don't meet.
    """
    cells = materialise(nodes.select("node", F.explode("bands").alias("key")), "cells")
    least = cells.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("key", "b")
    least = materialise(least, "least")
    stars = cells.join(if_small(least), "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _verified(materialise(stars, "stars"), signed, text_col).unionByName(_alike(prints)).distinct()
    first = connected_components(materialise(links, "links"), "a", "b")
    first = materialise(first.select(F.col("node").alias("n1"), "label"), "first")
    shared = cells.join(if_small(least.select("key")), "key", "left_semi")
    known = materialise(shared.join(if_small(first), F.col("node") == F.col("n1"), "left").select("key", "node", F.coalesce("label", "node").alias("c")), "known")
    mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    known = materialise(known.join(if_small(materialise(mixed, "mixed")), "key", "left_semi").select("node", "c"), "open")
    rare = materialise(_prefixes(known, signed, text_col), "rare")
    drawn = F.struct(F.xxhash64("node", "token"), "node", "c", "n", "at", "sketch")
    ends = rare.groupBy("token").agg(F.array(F.min(drawn), F.max(drawn)).alias("ends"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    head = ends.where("lo <> hi").select("token", F.explode(F.array_distinct("ends")).alias("h")).select("token", "h.node", "h.c", "h.n", "h.at", "h.sketch")
    one = _merged(_possible(rare, head), signed, text_col)
    rare = materialise(_renamed(rare, "c", one), "merged")
    mixed = rare.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rare = materialise(rare.join(if_small(materialise(mixed, "mixed")), "token", "left_semi"), "left")
    two = _merged(_possible(rare, rare), signed, text_col)
    own = first.unionByName(known.select(F.col("node").alias("n1"), F.col("c").alias("label"))).distinct()
    return _renamed(_renamed(own, "label", one), "label", two).select(F.col("n1").alias("node"), "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each class of near copies; all columns stay.

    Rows are told apart by id and set of shingles, so an id that stands on unrelated texts keeps a row of each.  A class
    keeps its smallest id; null ids come last.  Texts without words (null, empty, blank) are one class.
    """
    with small_batches(docs.sparkSession):
        signed = materialise(_signed(docs, text_col), "signed")
    rows = materialise(signed.groupBy(F.col("__node").alias("node"), F.col(id_col).alias("id")).agg(F.count("*").alias("n"), F.first("__bands").alias("bands")), "rows")
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    nodes = materialise(rows.groupBy("node").agg(F.sum("n").alias("n"), F.min(own).alias("own"), F.first("bands").alias("bands")), "nodes")
    prints = materialise(signed.select(F.col("__node").alias("n"), F.col("__fp").alias("fp")).distinct(), "prints")
    found = materialise(_classes(nodes, prints, signed, text_col), "classes")
    named = nodes.select("node", "n", "own").join(if_small(found.withColumnRenamed("node", "n1")), F.col("node") == F.col("n1"), "left")
    named = materialise(named.select("node", "n", "own", F.coalesce("label", "node").alias("label")), "named")
    best = named.groupBy("label").agg(F.min(F.struct("own", "node")).alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    marks = named.join(if_small(materialise(best, "best")), "label").select(F.col("node").alias("__n"), (F.col("node") == F.col("best.node")).alias("__best"), F.col("own.id").alias("__id"))
    marks = materialise(marks, "marks")
    joined = signed.join(if_small(marks), F.col("__node") == F.col("__n"), "left")
    kept = joined.where(F.col("__n").isNull() | (F.col("__best") & F.col(id_col).eqNullSafe(F.col("__id"))))
    twice = rows.where("n > 1").select(F.col("node").alias("__node")).distinct()
    if not twice.limit(1).count():
        return kept.select(*docs.columns)
    twice = materialise(twice, "twice")
    alone = kept.join(if_small(twice), "__node", "left_anti").select(*docs.columns)
    again = kept.join(if_small(twice), "__node", "left_semi").dropDuplicates(["__node", id_col]).select(*docs.columns)
    return alone.unionByName(again)
