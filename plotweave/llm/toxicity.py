"""Toxicity by a string-kernel support vector machine (operator 7).

The kernel counts the subsequences of four letters that two words share, each weighted by DECAY to the
length of its span, so that letters put in between only lessen it.  A few words serve as Nyström landmarks: a word's features
are its kernel values with them times the inverse root of theirs among themselves.  A squared-hinge machine over these is
trained on labelled texts as bags of words, a text being as toxic as its most suspicious word, or as the two or three most suspicious ones together.  Runs of letters that toxic
texts share beyond chance choose the first suspects; rounds of training then add the words that the machine suspects in
texts not explained so far, and as counterexamples the clean words that come closest.

As the machine is linear in subsequence counts, a word is scored by one weight a subsequence: the same value as through
the landmarks, without computing a kernel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import give_back, read, small_batches
from plotweave.llm.training import fit_in_task, held_out, sample
from plotweave.storage import materialise

FOLDS, FOLD = 5, 0
#: At most so many labelled rows of each class, with their whole texts, are fitted on.
TRAIN_ROWS = 1_200
#: Letters of a subsequence; letters from its first to its last; weight of each letter of the span beyond its own.
LENGTH, SPAN, DECAY = 4, 6, 0.6
LANDMARKS, ROUNDS, PENALTY = 160, 4, 20.0
#: How much more frequent in toxic texts than in clean ones a word must be to be suspected.
ODDS = 3
#: Lengths of the runs of letters that choose the first suspects.
RUN = (4, 7)
#: Clean words in a round of training, and words that a Python worker remembers.
NEGATIVES, REMEMBERED = 6_000, 400_000
#: Longer words are scored by overlapping pieces of this length.
PIECE, STRIDE = 24, 16
#: A word's margin isn't below this; how many of a text's greatest margins are looked at; weight of a clean text called toxic.
FLOOR, MEANS, WARY = -1.0, 3, 3
#: Words whose kernel values are computed at once.
FEW = 128
#: Runs of at least so many one-letter words are also read as one word.
SPELLED = 4

_LETTERS = 36
_OFFSETS = np.array(list(combinations(range(1, SPAN), LENGTH - 1)))
_WEIGHTS = DECAY ** (_OFFSETS[:, -1] - (LENGTH - 1.0))
_CODES = _LETTERS**LENGTH
_STRIP = {i: None for i in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(0xA1, 0xC0), 0xD7, 0xF7, *range(0x200B, 0x2070)]}
_CODE = np.array([1 + i - 97 if 97 <= i < 123 else 27 + i % 8 for i in range(1 << 12)], np.int32)


def words_of(text: str) -> set[str]:
    """The distinct words of a text: lower case, without punctuation inside; runs of single letters also as one word."""
    tokens = text.lower().translate(_STRIP).split()
    out = set(tokens)
    ones = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(ones) >= SPELLED:
        run = [ones[0]]
        for i in [*ones[1:], -9]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) >= SPELLED:
                out.add("".join(tokens[k] for k in run))
            run = [i]
    return out


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STRIDE, STRIDE)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code of subsequence, weight): each pair of word and code once, the weights of its places summed.

    Words carry a mark before and after, so that where a word begins and ends counts; no word may be longer than PIECE.
    """
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64) if len(words) else np.empty(0, np.int64)
    width = int(n.max(initial=0)) + 2 + SPAN
    grid = np.zeros((len(words), width), np.int64)
    row = np.repeat(np.arange(len(words)), n)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
    grid[row, col] = _CODE[flat % len(_CODE)]
    grid[:, 0] = _LETTERS - 1
    grid[np.arange(len(words)), n + 1] = _LETTERS - 1
    parts_w, parts_c, parts_v = [], [], []
    for offsets, v in zip(_OFFSETS, _WEIGHTS):
        w, at = np.nonzero(grid[:, offsets[-1] : width - SPAN + offsets[-1]])  # a subsequence ends inside the marked word
        code = grid[w, at]
        for o in offsets:
            code = code * _LETTERS + grid[w, at + o]
        parts_w.append(w)
        parts_c.append(code)
        parts_v.append(np.full(len(w), v))
    key = np.concatenate(parts_w) * _CODES + np.concatenate(parts_c)
    order = np.argsort(key, kind="stable")
    key, value = key[order], np.concatenate(parts_v)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    value = np.add.reduceat(value, first) if len(key) else value
    key = key[first]
    return key // _CODES, key % _CODES, value


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel between two lists of words: 1 for equal words, 0 with nothing in common."""
    wb, cb, vb = subsequences(b)
    codes, place = np.unique(cb, return_inverse=True)
    dense = np.zeros((len(codes) + 1, len(b)))
    dense[place, wb] = vb / np.sqrt(np.maximum(np.bincount(wb, vb**2, len(b)), 1e-12))[wb]
    w, c, v = subsequences(a)
    norm = np.sqrt(np.maximum(np.bincount(w, v**2, len(a)), 1e-12))
    at = np.minimum(np.searchsorted(codes, c), len(codes) - 1) if len(codes) else np.zeros(len(c), np.int64)
    hit = np.flatnonzero(codes[at] == c) if len(codes) else np.empty(0, np.int64)
    out = np.zeros((len(a), len(b)))
    starts = np.flatnonzero(np.concatenate([[True], w[hit][1:] != w[hit][:-1]])) if len(hit) else hit
    if len(hit):
        for k in range(0, len(starts), FEW):  # rows of few words at a time: each of their subsequences takes a row of ``dense``
            lo, hi = starts[k], starts[k + FEW] if k + FEW < len(starts) else len(hit)
            some = hit[lo:hi]
            out[w[hit[starts[k : k + FEW]]]] = np.add.reduceat(v[some, None] * dense[at[some]], starts[k : k + FEW] - lo, axis=0)
    return out / norm[:, None]


@dataclass
class Model:
    """``weight`` a subsequence, ``bias`` of a word's margin; ``slope`` and ``edges`` turn a text's margins into a score.

    ``edges[k]`` is what the mean of the k + 1 greatest margins must reach; the text's score is that of the mean that
    exceeds its edge most.
    """

    weight: np.ndarray
    bias: float
    slope: float
    edges: tuple[float, ...]

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of words of any length; a long word's is the greatest of its pieces."""
        parts = [_pieces(w) for w in words]
        flat = [p for ps in parts for p in ps]
        out = np.empty(len(flat))
        for at in range(0, len(flat), 1024):
            some = flat[at : at + 1024]
            w, c, v = subsequences(some)
            up = np.bincount(w, v * self.weight[c], len(some))
            out[at : at + 1024] = up / np.sqrt(np.maximum(np.bincount(w, v * v, len(some)), 1e-12)) + self.bias
        if len(flat) == len(words):
            return out
        sizes = np.array([len(p) for p in parts])
        return np.maximum.reduceat(out, np.cumsum(sizes) - sizes)

    def texts(self, texts: pd.Series, memory: dict[str, float]) -> np.ndarray:
        """Scores of texts, few at a time: their words take more memory than they; null counts as empty."""
        parts = [self.scores([words_of(t or "") for t in texts.iloc[i : i + 128]], memory) for i in range(0, len(texts), 128)]
        return np.concatenate(parts) if parts else np.empty(0)

    def scores(self, bags: list[set[str]], memory: dict[str, float]) -> np.ndarray:
        if len(memory) > REMEMBERED:
            memory.clear()
        new = [w for w in set().union(*bags) if w not in memory] if bags else []
        memory.update(zip(new, self.margins(new).tolist()))
        over = (tops(bags, memory, len(self.edges)) - np.array(self.edges)).max(1) if bags else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * over, -500, 500)))


def tops(bags: list[set[str]], memory: dict[str, float], k: int) -> np.ndarray:
    """Means of the 1 to k greatest margins of each bag; what is missing or below counts as FLOOR."""
    best = [nlargest(k, map(memory.__getitem__, bag)) if bag else [] for bag in bags]
    rows = np.array([b + [FLOOR] * (k - len(b)) for b in best]).reshape(len(bags), k)
    return np.cumsum(np.maximum(rows, FLOOR), axis=1) / np.arange(1, k + 1)


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge linear machine, by Newton steps on the points inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        xa, ca = x1[inside], cost[inside, None]
        new = np.linalg.solve(ridge + xa.T @ (ca * xa), xa.T @ (ca[:, 0] * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _spoiled(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with one letter put in at a random inner place."""
    out = []
    for w in words:
        at = int(rng.integers(1, max(2, len(w))))
        out.append(w[:at] + chr(97 + int(rng.integers(26))) + w[at:])
    return out


def _runs(word: str) -> set[str]:
    """Runs of RUN letters of a word with a mark before and after."""
    marked = f"^{word}$"
    return {marked[i : i + n] for n in range(RUN[0], RUN[1] + 1) for i in range(len(marked) - n + 1)}


def _telling(toxic: list[list[str]], clean: list[set[str]], texts: int) -> list[str]:
    """Words of toxic texts to begin with, once a text: those with a run of letters that tells the classes apart.

    A run tells if toxic texts have it so much more often than clean ones as chance would not give to any run.
    A text without such a run gives its words with the run that most other toxic texts share.
    """
    runs = {w: _runs(w) for b in toxic for w in b}
    many = Counter(r for b in toxic for r in set().union(*[runs[w] for w in b]) if b)
    many = Counter({r: n for r, n in many.items() if n > 1})
    few: Counter[str] = Counter()
    of: dict[str, list[str]] = {}
    for b in clean:
        for w in b:
            if w not in of:
                of[w] = [r for r in _runs(w) if r in many]
        few.update({r for w in b for r in of[w]})
    share = len(toxic) / texts
    n = np.array([many[r] for r in many], float)
    f = np.array([few[r] for r in many], float)
    gain = n * np.log(n / ((n + f) * share)) + np.where(f > 0, f * np.log(np.maximum(f, 1) / ((n + f) * (1 - share))), 0)
    gain = np.where(n * len(clean) >= 3 * f * len(toxic), gain, 0)
    odds = dict(zip(many, gain.tolist()))
    enough = np.log(max(2, len(many))) + 5
    out = []
    for b in toxic:
        best = {w: max((odds.get(r, 0) for r in runs[w]), default=0) for w in b}
        top = max(best.values(), default=0)
        out += [w for w in b if best[w] >= enough or (0 < best[w] == top < enough)]
    return out


def fit(bags: list[set[str]], y: np.ndarray, seed: int = 0) -> Model:
    """Fit on bags of words with classes 0 and 1; with one class only the score is the smoothed share of class 1."""
    y = np.asarray(y, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(_CODES), 0.0, 1.0, (-float(np.log(prior / (1 - prior))),))
    rng = np.random.default_rng(seed)
    few = Counter(w for b, t in zip(bags, y) if not t for w in b)
    many = Counter(w for b, t in zip(bags, y) if t for w in b)
    # Suspects are words that toxic texts have ODDS times as often as clean ones, by the rates in both.
    seen = {w for w, n in many.items() if n * (len(y) - y.sum()) >= ODDS * few[w] * y.sum()}
    toxic = [sorted(w for w in b if w in seen and 2 < len(w) <= PIECE) for b, t in zip(bags, y) if t]
    clean_words = sorted(w for w in few if w not in seen and len(w) <= PIECE)
    everywhere = sorted({w for b in toxic for w in b})
    if not everywhere or not clean_words:
        return Model(np.zeros(_CODES), 0.0, 1.0, (-float(np.log(prior / (1 - prior))),))

    known = _telling(toxic, [b for b, t in zip(bags, y) if not t], len(y))
    model = None
    for turn in range(ROUNDS):
        if model is None:
            picked, near = known, None
        else:  # texts that no known word explains give the word that the machine suspects most
            have = set(known)
            rank = dict(zip(everywhere, model.margins(everywhere)))
            rest = [max(b, key=rank.__getitem__) for b in toxic if b and not have.intersection(b)]
            picked = known + [w for w in rest if rank[w] > 0]
            near = model.margins(clean_words)
        weight = Counter(picked)
        pos = sorted(weight)
        odd = _spoiled(pos, rng)
        hard = [] if near is None else [clean_words[i] for i in np.argsort(-near)[: NEGATIVES // 2]]
        easy = [clean_words[i] for i in rng.permutation(len(clean_words))[: NEGATIVES // 2]]
        neg = sorted(set(hard + easy))
        chosen = [w for w, _ in weight.most_common(LANDMARKS // 2)]
        others = [neg[i] for i in rng.permutation(len(neg))[: LANDMARKS - len(chosen)]]
        marks = sorted(set(chosen + others))
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])  # features = kernel values with the landmarks @ root
        points = pos + odd + neg
        x = kernel(points, marks) @ root
        sign = np.concatenate([np.ones(len(pos) + len(odd)), -np.ones(len(neg))])
        times = np.array([np.sqrt(weight[w]) for w in pos])
        cost = np.concatenate([times / times.sum(), 0.5 * times / times.sum(), np.ones(len(neg)) / len(neg)]) * PENALTY * len(pos) ** 0.5
        w = _machine(x, sign, cost)
        alpha = root @ w[:-1]
        mw, mc, mv = subsequences(marks)
        norm = np.sqrt(np.maximum(np.bincount(mw, mv**2, len(marks)), 1e-12))
        model = Model(np.bincount(mc, mv * (alpha / norm)[mw], _CODES), float(w[-1]), 1.0, (0.0,))

    memory: dict[str, float] = {}
    new = sorted(set().union(*bags))
    memory.update(zip(new, model.margins(new).tolist()))
    means, edges, left = tops(bags, memory, MEANS), [], np.ones(len(y), bool)
    for k in range(MEANS):
        edge = _edge(means[left, k], y[left])
        edges.append(edge)
        left &= means[:, k] < edge
    return Model(model.weight.astype(np.float32), model.bias, 4.0, tuple(edges))


def _edge(values: np.ndarray, y: np.ndarray) -> float:
    """The value that parts the classes with least error, a clean text counting WARY times; in the middle of a gap if there is one."""
    order = np.argsort(values)
    s, t = values[order], y[order]
    if not t.any():
        return float(s.max(initial=FLOOR)) + 1.0
    lost = np.concatenate([[0], np.cumsum(t)])  # toxic texts below each cut
    wrong = (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
    miss = lost + WARY * wrong
    best = np.flatnonzero(miss <= miss.min())
    k = int(best[len(best) // 2])
    if k == len(s):
        return float(s[-1]) + 0.5
    return float(s[max(0, k - 1)] + s[k]) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id") -> Model:
    rows = sample(docs, labels, label, FOLDS, FOLD, TRAIN_ROWS, id_col)
    return fit_in_task(rows, lambda texts, y: fit([words_of(t) for t in texts], y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row, over the whole text; null, empty and blank texts have the least score.

    Null and repeated ids are kept, equal texts score alike; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        memory: dict[str, float] = {}
        for s in texts:
            yield pd.Series(model.texts(s, memory))

    with small_batches(spark, 512):
        return materialise(docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("score")), "scores")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score 0.5 or more; all columns stay, whatever their names.

    Null and repeated ids are judged like any other, equal texts alike; null, empty and blank texts stay, long ones are judged whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        memory: dict[str, float] = {}
        for s in texts:
            yield pd.Series(model.texts(s, memory) >= 0.5)
        memory.clear()
        give_back()

    with small_batches(spark, 512):
        return materialise(docs.where(~toxic(F.col(text_col))), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents, by a machine trained on the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
