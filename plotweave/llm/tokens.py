"""Token-id output as entropy-coded binary blocks (operator 9).

Texts become ids by a given tokenizer, an end id after each.  Ids are counted over all documents for
one shared frequency table.  Documents are ordered by id in ranges; each range is cut into blocks of whole documents,
coded independently (see ``rans``) and written as Parquet rows ``(range, start, block)``, the table beside them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import give_back, read, slices, small_batches
from plotweave.llm.minhash import id_ranges
from plotweave.llm.rans import Block, Table, encode
from plotweave.storage import discard, materialise, new_path

END_ID = 0
#: Ids in a block: one is closed at the first document that starts beyond.
BLOCK_IDS = 1 << 19
#: Chunks whose ids a Python worker remembers; new chunks that the model gets as one.
REMEMBERED, JOINED = 250_000, 8
#: White space other than space and newline, and characters that mark keys: such texts go to the tokenizer whole.
_OTHER = re.compile("[\\x00-\\x02\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()
_LETTERS = {c: b for b, c in _BYTES.items()}


def _spans(token: str) -> bool:
    """Whether a token made of what plain chunks hold joins two of them, or a letter (or part of one) and the sign behind it."""
    text = bytes(_LETTERS.get(c, 0) for c in token).decode("utf-8", "replace")
    letter = [c.isalpha() or c == "\ufffd" for c in text]
    if not all(a or c in " \n" or c in punctuation for a, c in zip(letter, text)):
        return False
    return any(c in " \n" and b not in " \n" or b == "\n" and c not in " \n" or c in punctuation and a for a, b, c in zip(letter, text, text[1:]))


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, remembering chunks.

    Such a tokenizer never joins what lies on both sides of a single space or newline between two visible
    characters, so a text may be cut before each and the ids of equal chunks looked up; the library encodes new ones.  Texts with other white space, or with the string of an added token, are encoded by
    the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.texts = {}
        self.added = [str(t) for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        own = [t for t in vocabulary if t not in self.added]
        self.plain = type(self.tok.model).__name__ == "BPE" and self.tok.normalizer is None and not self.tok.encode(" a").tokens[0].startswith(" ") and not any(map(_spans, own))
        #: Whether a token begins with the letter that stands for a space or a newline.
        self.leads = np.zeros(max([size, *(i + 1 for i in vocabulary.values())]), bool)
        self.leads[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"\x01": 0}
        self.new: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 1
        self.ids[0] = END_ID
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.sizes[0] = 1

    def _remember(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Chunk k has ``ids[ends[k - 1]:ends[k]]``."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        n = len(self.index) + len(self.new)
        while n + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        begins = np.concatenate([[0], ends[:-1]])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(keys)] = self.used + begins
        self.sizes[n : n + len(keys)] = ends - begins
        self.new.update(zip(keys, range(n, n + len(keys))))
        self.used += len(ids)

    def _keep(self) -> None:
        """Remember for later calls what this one learned, up to REMEMBERED chunks; the frequent ones come early."""
        room = max(0, REMEMBERED - len(self.index))
        if len(self.new) > room:
            self.used = int(self.starts[len(self.index) + room])
        self.index.update(islice(self.new.items(), room))
        self.new = {}

    def _learn(self, keys: list[str]) -> None:
        """Remember the ids of chunks.  Words of letters with ASCII signs behind go to the model itself, JOINED at a time, and are
        cut where a token begins with a space or newline: no token of a plain vocabulary spans two of them, or letters and signs."""
        inner: list[str] = []
        whole: list[str] = []
        for k in keys:
            base = k.rstrip(punctuation)
            (inner if self.plain and (base.isalpha() or base[:1] == "\n" and base[1:].isalpha()) else whole).append(k)
        ids: list[int] = []
        tokenize = self.tok.model.tokenize
        for at in range(0, len(inner), JOINED):
            text = "".join([k if k[0] == "\n" else " " + k for k in inner[at : at + JOINED]])
            ids += [t.id for t in tokenize(text.replace(" ", "\u0120").replace("\n", "\u010a") if text.isascii() else text.encode().decode("latin1").translate(_BYTES))]
        if inner:
            every = np.array(ids, np.uint32)
            begins = np.flatnonzero(self.leads[every])
            if len(begins) != len(inner):
                raise ValueError("the tokenizer joins words")
            self._remember(inner, every, np.append(begins[1:], len(every)))
        for at in range(0, len(whole), 256):
            part = whole[at : at + 256]
            texts = [k if k[0] == "\n" else self.texts[k] if k[0] == "\x02" else k[1:] if k[0] == "\x00" else " " + k for k in part]
            got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            self._remember(part, np.array([i for g in got for i in g], np.uint32), np.cumsum([len(g) for g in got]))

    def _chunks(self, text: str) -> list[str]:
        """Keys of a text: chunks without their space, the first marked; or one key for the whole text."""
        if not text:
            return []
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _OTHER.search(text) or any(a in text for a in self.added):
            key = "\x02" + sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            self.texts[key] = text
            return [key]
        return ("\x00" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text's followed by the end id, and the number of each text's ids."""
        self.texts: dict[str, str] = {}  # texts that go to the tokenizer whole, by key
        keys: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self._chunks(text or "")
            counts[i] = len(own) + 1
            keys += own
            keys.append("\x01")
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = [keys[i] for i in miss]
            self._learn(list(dict.fromkeys(lost)))
            at[miss] = np.fromiter(map(self.new.__getitem__, lost), np.int64, len(lost))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.ids[where]
        self._keep()
        per = np.add.reduceat(sizes, np.cumsum(counts) - counts) if len(texts) else np.empty(0, np.int64)
        return ids, per


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder a Python worker: workers live through many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for each row; ``ids`` are little-endian 16-bit, or 32-bit for large vocabularies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc = _encoder(tokenizer)
        for b in batches:
            data, sizes = [], []
            for texts in slices(b.column(1), size=1 << 20):  # few texts at a time: their chunks take more memory than they
                ids, per = enc.encode(texts)
                raw = ids.astype(enc.dtype)
                data += [raw[e - n : e].tobytes() for e, n in zip(np.cumsum(per).tolist(), per.tolist())]
                sizes += per.tolist()
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids"])
            del data
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id over all rows; as many numbers as the vocabulary has come to the driver."""
    wide = vocabulary > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()
        give_back()
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for at in range(0, len(b), 256):
                raw = b"".join(b.column(0).slice(at, 256).to_pylist())
                n += np.bincount(np.frombuffer(raw, "<u4" if wide else "<u2"), minlength=vocabulary)
        have = np.flatnonzero(n)
        yield pa.record_batch([pa.array(have, pa.int64()), pa.array(n[have], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode all rows in ascending id order into files below ``path``: ``blocks`` by range, and ``table``.

    Null texts count as empty and have the end id alone; null ids come first; rows with equal ids are ordered by their ids'
    hash.  A document longer than a block makes its block longer.  Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = Encoder(tokenizer).tok.get_vocab_size()
    give_back()
    with small_batches(spark, 2048):
        tokens = materialise(tokenize(docs, tokenizer, id_col, text_col), "tokens")
    counts = count_ids(tokens, vocabulary)
    table = Table(counts)
    known = np.flatnonzero(table.freq)
    slots = spark.createDataFrame(list(zip(known.tolist(), table.freq[known].tolist())), "id long, slots long")
    slots.coalesce(1).write.mode("overwrite").parquet(f"{path}/table")

    ranged = tokens.withColumn("r", id_ranges(tokens, "doc_id"))
    totals = ranged.groupBy("r").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("r").alias("br"), before.alias("base"))  # a row a range, a bounded number
    w = Window.partitionBy("r").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("ids"))
    inner = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("inner", inner).join(F.broadcast(materialise(bases, "bases")), F.col("r") == F.col("br"))
    placed = placed.select("r", (F.col("base") + F.col("inner")).alias("start"), F.floor(F.col("inner") / block_ids).cast("long").alias("b"), "doc_id", "n_tokens", "ids")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # the worker may have tokenized before; blocks need its memory, not its tokenizer
        give_back()
        table = Table(shared.value)
        open_: list[tuple] = []

        def close() -> pa.RecordBatch:
            r, start = open_[0][0], open_[0][1]
            ids = np.concatenate([np.frombuffer(x[5], kind) for x in open_])
            nulls = np.array([x[3] is None for x in open_])
            block = encode(ids, table, start, np.array([x[3] or 0 for x in open_], np.int64), nulls, np.array([x[4] for x in open_]))
            open_.clear()
            return pa.record_batch([pa.array([r], pa.int32()), pa.array([start], pa.int64()), pa.array([block], pa.binary())], ["range", "start", "block"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if open_ and (open_[0][0], open_[0][2]) != (row[0], row[2]):
                    yield close()
                open_.append(row)
        if open_:
            yield close()

    blocks = placed.mapInArrow(run, "range int, start long, block binary")
    with small_batches(spark, 512):
        blocks.write.mode("overwrite").option("compression", "uncompressed").partitionBy("range").parquet(f"{path}/blocks")
    discard(tokens)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` for each document in the files below ``path``.

    Each block is decoded by itself; a damaged block, or one of another table, is an error.
    """
    slots = spark.read.parquet(f"{path}/table").toPandas()  # at most the vocabulary
    freq = np.zeros(int(slots["id"].max()) + 1 if len(slots) else 1, np.int64)
    freq[slots["id"]] = slots["slots"]
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for data in batch.column(0):
                block = Block(data.as_py(), table)
                ids = block.ids()
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(block.lengths)
                begins = (ends - block.lengths).tolist()
                parts = [raw[4 * a : 4 * e] for a, e in zip(begins, ends.tolist())]
                cols = [pa.array(block.doc_ids, pa.int64(), mask=block.nulls), pa.array(np.add(begins, block.start), pa.int64()), pa.array(block.lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    schema = "range int, start long, block binary"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks").select("block")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coded(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` below ``path`` (a new shared folder if None) and return what the files say, without the ids."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_tokens(docs, path, tokenizer or default_tokenizer())
    with small_batches(spark, 8):
        return materialise(read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32"), "read")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, written and read back."""
    return coded(read(spark, sf_dir, "documents"))
