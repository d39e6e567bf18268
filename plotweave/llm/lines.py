"""Line dedup by content-defined chunks (operator 8), DataFrame functions only.

A rolling hash over the hashes of WINDOW = 2 neighbouring lines is taken at every line.  Where it occurs once in the corpus a chunk
ends: boundaries depend on what the lines say and not on their place, so a passage is cut alike whatever surrounds it.
Between boundaries lie chunks of two lines or more that the corpus repeats, possibly piece by piece.  Each pair of neighbouring
lines in them is compared byte by byte with the first one of its hash, pairs that follow one first text together, and all but the first go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import BROADCAST_ROWS, if_small, read, row_key
from plotweave.storage import discard, materialise, unsent

WINDOW = 2
#: Runs of repeated pairs that are held against one copy of the text in which they stand first.
PART = 1_000
_NONE = "cast(array() as array<struct<start:int,n:int>>)"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _rolling_sql(lines: str) -> str:
    """SQL for an array of the rolling hash at each line but the last, null where both lines are blank."""
    hashes = f"transform({lines}, l -> case when trim(l) = '' then 0L else xxhash64(l) end)"
    rolled = "case when hs[i] = 0 and hs[i + 1] = 0 then null else xxhash64(hs[i], hs[i + 1]) end"
    return _let(hashes, "hs", f"case when size(hs) > 1 then transform(sequence(0, size(hs) - 2), i -> {rolled}) end")


def repeated_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(r1, r2, at)``: lines at which a pair of lines begins that equals, byte for byte, one that stands earlier in the corpus.

    ``r1`` and ``r2`` are hashes of id and text; rows alike in both are one document.  Earlier means a smaller id (null first),
    then smaller hashes, then a place further up.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    pairs = rows.select("doc_id", "r1", "r2", F.posexplode(F.expr(_rolling_sql("lines"))).alias("at", "h")).where("h is not null")
    pairs = materialise(pairs, "pairs")
    place = F.struct("doc_id", "r1", "r2", "at")
    twice = pairs.groupBy("h").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("not (p <=> q)")
    twice = materialise(twice.select(F.col("h").alias("rh"), F.col("p.r1").alias("f1"), F.col("p.r2").alias("f2"), F.col("p.at").alias("first_at")), "repeated")
    first = (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2")) & (F.col("at") == F.col("first_at"))
    again = pairs.join(if_small(twice), F.col("h") == F.col("rh")).where(~first)
    # Only numbers take part in joins by hash; pairs that repeat one document's at one distance are compared together.
    runs = again.groupBy("r1", "r2", "f1", "f2", (F.col("at") - F.col("first_at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    runs = materialise(runs, "runs")
    discard(pairs, twice)
    found = materialise(_same_bytes(rows.drop("doc_id"), runs), "found")
    discard(runs)
    return found


def _same_bytes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``(r1, r2, at)`` of the pairs in ``runs`` whose two lines equal, byte for byte, those of the first place.

    A text is shuffled once with the list of its runs, and leaves with the lines that they name; a first text meets these in as many
    copies as PART runs each need, so that no text that many repeat is one task's.
    """
    firsts = runs.groupBy("f1", "f2").agg((F.floor(F.count("*") / PART) + 1).cast("int").alias("parts"))
    firsts = materialise(firsts, "firsts")
    dealt = runs.join(if_small(firsts), ["f1", "f2"]).withColumn("part", F.pmod(F.xxhash64("r1", "r2", "shift"), F.col("parts")).cast("int"))
    lists = dealt.groupBy(F.col("r1").alias("m1"), F.col("r2").alias("m2")).agg(F.collect_list(F.struct("f1", "f2", "part", "shift", "ats")).alias("runs"))
    lists = materialise(lists, "lists")
    small = runs.select(F.sum(F.size("ats"))).first()[0] or 0
    asked = F.broadcast(lists) if small <= BROADCAST_ROWS else unsent(lists)  # as many numbers in the lists
    own = "transform(array_union(u.ats, transform(u.ats, i -> i + 1)), i -> named_struct('i', i, 'line', lines[i]))"
    cut = f"transform(runs, u -> named_struct('f1', u.f1, 'f2', u.f2, 'part', u.part, 'shift', u.shift, 'ats', u.ats, 'own', {own}))"
    asking = rows.join(asked, (F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2"))).select("r1", "r2", F.explode(F.expr(cut)).alias("u")).select("r1", "r2", "u.*")
    named = firsts.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "parts")
    theirs = rows.join(if_small(named), (F.col("r1") == F.col("g1")) & (F.col("r2") == F.col("g2")))
    theirs = theirs.groupBy("g1", "g2").agg(F.first("lines").alias("theirs"), F.first("parts").alias("parts"))
    theirs = theirs.select("g1", "g2", "theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("g"))
    met = asking.join(theirs, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("part") == F.col("g")))
    same = "transform(filter(own, o -> o.line = get(theirs, o.i - shift)), o -> o.i)"
    ats = F.expr(_let(same, "s", "array_intersect(array_intersect(ats, s), transform(s, i -> i - 1))"))
    return met.select("r1", "r2", F.explode(ats).alias("at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated chunks, with ``n_lines``, ``removed_lines`` and ``removed``.

    A chunk has two lines or more; a line that repeats between other neighbours each time stays, and so do pairs of blank lines
    only.  ``removed`` lists the (start, n) of what went, in lines from 0.  The first place of a line's content always stays.  A null text
    stays null and has no line; an empty text has one.  A text of which all lines go becomes empty.  Unequal pairs
    whose hashes are equal are kept.  Rows alike in id and text are treated alike.  Columns that bear the names of the three new ones are replaced.
    """
    docs = docs.drop("n_lines", "removed_lines", "removed")
    found = repeated_pairs(docs, id_col, text_col)
    marks = found.groupBy(F.col("r1").alias("m1"), F.col("r2").alias("m2")).agg(F.collect_set("at").alias("at"))
    if found.count() <= BROADCAST_ROWS:  # as many numbers in the lists
        marks = F.broadcast(marks)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    whole = docs.select(rest.alias("row"), F.col(text_col).alias("own_text"), *row_key(id_col, text_col))
    joined = whole.join(marks, (F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2")), "left")
    gone = F.expr("sort_array(array_union(at, transform(at, i -> i + 1)))")
    cut = joined.select("row", "own_text", F.split("own_text", "\n").alias("lines"), gone.alias("gone"))
    begins, ends = "filter(gone, (g, i) -> i = 0 or gone[i - 1] <> g - 1)", "filter(gone, (g, i) -> i = size(gone) - 1 or gone[i + 1] <> g + 1)"
    removed = F.expr(f"coalesce(zip_with({begins}, {ends}, (s, e) -> named_struct('start', s, 'n', e - s + 1)), {_NONE})")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    text = F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(kept)
    columns = [text.alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    n_lines = F.when(F.col("own_text").isNull(), 0).otherwise(F.size("lines"))
    return cut.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"), removed.alias("removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents without their repeated chunks."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "removed_lines", "removed", "text")
