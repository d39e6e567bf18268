"""Language-model scores by masked pseudo-likelihood (operator 3).

Every word of a text is predicted from the REACH words on each side, never from itself; a text's score is the sum of the words'
conditional log-probabilities.  All words of the corpus, in order of spelling, are cut into BANDS bands of about equal token
counts.  A small window network in numpy gives the probability of each band from the context, and a word's share in its band is its
count over the whole corpus: P(word | context) = P(band | context) * count(word) / count(band).  So each word has a
probability of its own, however rare, and all of them sum to one.  As context, the VOCABULARY most frequent words have vectors of
their own and others share one a band, that is of their spelling.

Training goes through the corpus once, in STEPS steps: a hash of id and text deals the rows to steps, each step sums the gradient over all
positions of its rows, wherever they lie, and the driver moves the parameters.  So they depend on the rows, but for rounding not on
partitions.  Counts of words outside the vocabulary are joined as tables; they never come to the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import read, slices, words
from plotweave.storage import discard, materialise

VOCABULARY, BANDS = 32_000, 128
REACH, DIM, HIDDEN = 3, 16, 16
STEPS, RATE = 24, 0.12
#: Positions that are worked on at once; words outside the vocabulary that a Python worker remembers; sums added up in a task.
PIECE, REMEMBERED, FAN = 4_096, 400_000, 32
_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
#: The id that stands for what lies beyond a text's ends; its vector is zero.
OUTSIDE = VOCABULARY + BANDS
_SHAPES = {"emb": (OUTSIDE + 1, DIM), "pos": (2 * REACH, DIM), "w": (DIM, HIDDEN), "b": (HIDDEN,), "u": (HIDDEN + 1, BANDS)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


@dataclass
class Lexicon:
    """Vocabulary with its counts, the first word of each band but the first, and the token count of each band."""

    words: list[str]
    counts: np.ndarray
    starts: list[str]
    totals: np.ndarray

    def band(self, word: str) -> int:
        return bisect_right(self.starts, word)

    def bands(self) -> np.ndarray:
        """The band of each id."""
        return np.array([*map(self.band, self.words), *[0] * (VOCABULARY - len(self.words)), *range(BANDS), 0], np.int64)

    def shares(self) -> np.ndarray:
        """What each id adds to a word's log-probability besides the band's; for words outside the vocabulary without their own count."""
        own = np.zeros(OUTSIDE + 1)
        own[: len(self.words)] = np.log(self.counts)
        return own - np.log(np.maximum(self.totals, 1))[self.bands()]


def unpack(theta: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parts of a parameter vector."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = theta[at : at + n].reshape(shape)
        at += n
    return out


def initial(totals: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Parameters that predict each band by its share in the corpus, whatever the context, but for a little noise."""
    theta = np.zeros(SIZE, np.float32)
    p, rng = unpack(theta), np.random.default_rng(seed)
    p["emb"][:OUTSIDE] = rng.normal(0, 0.1, (OUTSIDE, DIM))
    p["pos"][:] = 1
    p["w"][:] = rng.normal(0, DIM**-0.5, p["w"].shape)
    p["u"][:-1] = rng.normal(0, 0.05, (HIDDEN, BANDS))
    if totals is not None:
        p["u"][-1] = np.log((totals + 0.5) / (totals + 0.5).sum())
    return theta


def _forward(p: dict[str, np.ndarray], window: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all places of ``window`` but REACH at each end: vectors, context sums, hidden layer with a column of ones, the bands' logits."""
    n = len(window) - 2 * REACH
    e = p["emb"][window]
    c = e[:n] * p["pos"][0]
    for k, o in enumerate(_OFFSETS[1:], 1):
        c += e[REACH + o : REACH + o + n] * p["pos"][k]
    h = np.ones((n, HIDDEN + 1), e.dtype)
    np.tanh(c @ p["w"] + p["b"], out=h[:, :-1])
    return e, c, h, h @ p["u"]


def windows(padded: np.ndarray) -> Iterator[np.ndarray]:
    """``padded`` in overlapping windows of at most PIECE places to be predicted each."""
    for at in range(REACH, len(padded) - REACH, PIECE):
        yield padded[at - REACH : min(at + PIECE, len(padded) - REACH) + REACH]


def log_probs(theta: np.ndarray, padded: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Log-probability of the band that stands at each place of ``padded``, given its neighbours; 0 outside of texts."""
    p, out = unpack(theta), np.zeros(len(padded))
    at, ones = REACH, np.ones(BANDS, theta.dtype)
    for window in windows(padded):
        z = _forward(p, window)[3]
        n = len(z)
        mid = window[REACH : REACH + n]
        own = z[np.arange(n), bands[mid]].astype(np.float64)
        out[at : at + n] = np.where(mid == OUTSIDE, 0, own - np.log(np.exp(z, out=z) @ ones))
        at += n
    return out


def gradient(theta: np.ndarray, padded: np.ndarray, bands: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total``, of 64 bits, the gradient of the negative log-probability summed over all places in texts."""
    p = unpack(theta)
    g, ones = unpack(total), np.ones((BANDS, 1), theta.dtype)
    for window in windows(padded):
        e, c, h, z = _forward(p, window)
        n = len(z)
        mid = window[REACH : REACH + n]
        d = np.exp(z, out=z)
        d *= (mid != OUTSIDE)[:, None] / (d @ ones)
        d[np.arange(n), bands[mid]] -= mid != OUTSIDE
        g["u"] += h.T @ d
        dz = (d @ p["u"][:-1].T) * (1 - h[:, :-1] ** 2)
        g["w"] += c.T @ dz
        g["b"] += dz.sum(0)
        dc = dz @ p["w"].T
        back = np.zeros_like(e)
        for k, o in enumerate(_OFFSETS):
            place = slice(REACH + o, REACH + o + n)
            g["pos"][k] += np.einsum("ij,ij->j", dc, e[place])
            back[place] += dc * p["pos"][k]
        order = np.argsort(window, kind="stable")
        first = np.flatnonzero(np.diff(window[order].astype(np.int32), prepend=-1))
        g["emb"][window[order][first]] += np.add.reduceat(back[order], first, axis=0)
    g["emb"][OUTSIDE] = 0


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: how often each lower-case word occurs in all documents."""
    return docs.select(F.explode(words(F.lower(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lexicon(counts: DataFrame) -> Lexicon:
    """The vocabulary by falling count, ties by word, bands of about equal counts in it, and the bands' counts of all words.

    Words of the count at which VOCABULARY words would be exceeded are all outside.
    """
    least, many = 0, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # the first few thousand of the different counts
        many += r["count"]
        if many > VOCABULARY:
            least = r.n
            break
    top = sorted(counts.where(F.col("n") > least).collect(), key=lambda r: (-r.n, r.word))
    known = sorted((r.word, r.n) for r in top)
    total, sofar, starts = sum(n for _, n in known), 0, []
    for i, (word, n) in enumerate(known):
        if i and sofar * BANDS >= (len(starts) + 1) * total and len(starts) < BANDS - 1:
            starts.append(word)
        sofar += n
    made = Lexicon([r.word for r in top], np.array([r.n for r in top], np.int64), starts, np.zeros(BANDS, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BANDS, np.int64)
        for b in batches:
            band = np.fromiter((bisect_right(starts, w) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
            np.add.at(sums, band, b.column(1).to_numpy())
        yield pa.record_batch([pa.array(np.arange(BANDS)), pa.array(sums)], ["band", "n"])

    for r in counts.mapInArrow(run, "band long, n long").groupBy("band").agg(F.sum("n").alias("n")).collect():
        made.totals[r.band] = r.n
    return made


class Coder:
    """Ids of the words of texts, and the hashes of the words outside the vocabulary."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.known = {w: i for i, w in enumerate(self.lexicon.words)}
        self.size = len(self.known)
        self.ids = np.arange(1 << 16)
        self.hashes = np.zeros(1 << 16, np.int64)

    def _learn(self, parts: list[str]) -> None:
        known, n = self.known, len(self.known)
        new = list(dict.fromkeys([w for w in parts if w not in known]))
        while n + len(new) > len(self.ids):
            self.ids, self.hashes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ids, self.hashes))
        known.update(zip(new, range(n, n + len(new))))
        self.ids[n : n + len(new)] = [VOCABULARY + self.lexicon.band(w) for w in new]
        self.hashes[n : n + len(new)] = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42) for w in new], np.uint64).view(np.int64)

    def code(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's words, and the hashes (Spark's) of those outside the vocabulary, in order."""
        parts = _split((text or "").lower())
        if len(self.known) > self.size + REMEMBERED:
            self._clear()
        try:
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            self._learn(parts)
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        return self.ids[at].astype(np.uint16), self.hashes[at[at >= self.size]]


def _split(text: str) -> list[str]:
    """Words between ASCII white space, as they were counted."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w.decode("utf-8") for w in text.encode("utf-8", "replace").split()]


def padded_batch(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of ids with REACH outside ones around each text, and where each text's words begin and end, a row each."""
    sizes = np.array([len(x) for x in ids], np.int64)
    ends = np.cumsum(sizes + REACH)
    out = np.full(int(sizes.sum()) + REACH * (len(ids) + 1), OUTSIDE, np.uint16)
    for x, e in zip(ids, ends):
        out[e - len(x) : e] = x
    return out, np.stack([ends - sizes, ends], axis=1)


def code(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, ids, rare, step)`` for each row: a number, ids of 16 bits, hashes of rare words, the step that trains on it."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            done = 0
            for texts in slices(b.column(3)):
                made = [coder.code(t) for t in texts]
                rest = b.slice(done, len(texts))
                done += len(texts)
                ends = np.cumsum([0, *[len(r) for _, r in made]])
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r for _, r in made])))
                yield pa.record_batch([rest.column(0), rest.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), rare, rest.column(2)], ["row", "doc_id", "ids", "rare", "step"])

    own, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), F.pmod(F.xxhash64(F.lit(3), own, text), F.lit(STEPS)).cast("int").alias("step"), text.alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, ids binary, rare array<long>, step int")


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Padded ids, places of the texts in them, and the rows, for some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield *padded_batch([np.frombuffer(x.as_buffer(), "<u2") for x in part.column(column)]), part


def _summed(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of rows ``(sums, n)`` of 64-bit vectors, added up by FAN in tasks until one is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE), 0
        for b in batches:
            for x, k in zip(b.column(0), b.column(1).to_pylist()):
                total += np.frombuffer(x.as_buffer(), np.float64)
                n += k
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(run, "sums binary, n long")
    rows = parts.collect()
    return sum((np.frombuffer(r.sums) for r in rows), np.zeros(SIZE)), sum(r.n for r in rows)


def train(coded: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Parameters trained on every position of all rows of ``coded(ids, step)``: a step of Adam for each of STEPS parts of the rows."""
    spark, theta, bands = coded.sparkSession, initial(lexicon.totals), lexicon.bands()
    mean, square = np.zeros(SIZE), np.zeros(SIZE)
    for step in range(STEPS):
        shared = spark.sparkContext.broadcast((theta, bands))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total, n = np.zeros(SIZE), 0
            for padded, places, _ in _batches(batches, 0):
                gradient(shared.value[0], padded, shared.value[1], total)
                n += int((places[:, 1] - places[:, 0]).sum())
            if n:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["sums", "n"])

        g, n = _summed(coded.where(F.col("step") == step).select("ids").mapInArrow(run, "sums binary, n long"))
        shared.destroy()
        if not n:
            continue
        g /= n
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        rate = RATE * (1 - 0.9 * step / STEPS)
        theta = (theta - rate * (mean / (1 - 0.8 ** (step + 1))) / (np.sqrt(square / (1 - 0.95 ** (step + 1))) + 1e-7)).astype(np.float32)
    return theta


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, log_prob, mean_log_prob)`` for each row, by a model trained on all rows of ``docs``.

    A text without words (null, empty, blank) has log_prob 0 and a null mean.  Null and repeated ids are kept, and equal rows
    have equal scores, but for rounding.  Texts of any length are scored whole, in pieces of PIECE places that overlap.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, text_col), "counts")
    lex = lexicon(counts)
    coded = materialise(code(docs, lex, id_col, text_col), "coded", ["step"])
    shared = spark.sparkContext.broadcast((train(coded, lex), lex.bands(), lex.shares()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, bands, share = shared.value
        for padded, places, rows in _batches(batches, 2):
            sums = np.concatenate([[0.0], np.cumsum(log_probs(theta, padded, bands) + np.where(padded == OUTSIDE, 0, share[padded]))])
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(places[:, 1] - places[:, 0]), pa.array(sums[places[:, 1]] - sums[places[:, 0]])], ["row", "doc_id", "n_words", "known"])

    scored = coded.select("row", "doc_id", "ids").mapInArrow(run, "row long, doc_id long, n_words long, known double")
    by_hash = counts.groupBy(F.xxhash64("word").alias("ch")).agg(F.sum("n").alias("n"))
    rare = coded.select("row", F.explode("rare").alias("h")).join(by_hash, F.col("h") == F.col("ch"))
    rare = rare.groupBy(F.col("row").alias("rrow")).agg(F.sum(F.log("n")).alias("counted"))
    both = scored.join(rare, F.col("row") == F.col("rrow"), "left").withColumn("log_prob", F.col("known") + F.coalesce("counted", F.lit(0.0)))
    out = both.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))
    out = materialise(out, "scores")
    discard(coded, counts)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, by a model of all documents."""
    return pseudo_likelihood(read(spark, sf_dir, "documents"))
