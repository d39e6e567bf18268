"""Static range asymmetric numeral system over token ids, with interleaved lanes, checkpoints and checksums.

A block codes its ids by one shared frequency table of ``1 << BITS`` slots.  Id i belongs to lane i mod lanes;
each lane has a 64-bit state that is kept in [2^31, 2^63) by moving 32-bit words out and in.  Lanes step together as
numpy vectors.  A checkpoint holds all states and the place in the words before a step, so that the
pieces of a block between checkpoints can be decoded independently.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS, LOW = 20, 1 << 31
LANES, CHECKPOINT_STEPS = 1024, 256
MAGIC = b"PWR1"
_HEAD = struct.Struct("<4sIQQIIIIII")  # magic, crc of the rest, start, ids, documents, lanes, checkpoints, words, crc of ids, crc of table


class Table:
    """Frequencies scaled to ``1 << BITS`` slots; ids that never occur have none."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = np.asarray(counts, np.int64)
        if (counts > 0).sum() > 1 << BITS:
            raise ValueError("more ids than slots")
        total = max(1, int(counts.sum()))
        freq = np.where(counts > 0, np.maximum(1, np.rint(counts * ((1 << BITS) / total))), 0).astype(np.int64)
        off = (1 << BITS) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        at = 0
        while off and freq.any():
            k = order[at % len(order)]
            step = off if off > 0 else -min(-off, max(0, int(freq[k]) - 1))
            freq[k] += step
            off -= step
            at += 1
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(np.trim_zeros(freq, "b").astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table, start: int, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block: ``ids`` of whole documents, ``lengths`` ids each; ``start`` is the number of ids before it."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id has no slot in the frequency table")
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    states: dict[int, np.ndarray] = {}
    top = np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        f, v = freq[a:b], x[: b - a]
        over = v >= (f << top)
        if over.any():
            words[t] = v[over].astype(np.uint32)
            v = np.where(over, v >> np.uint64(32), v)
        q = v // f
        x[: b - a] = (q << np.uint64(BITS)) + (v - q * f) + cum[a:b]
        if t % CHECKPOINT_STEPS == 0:
            states[t] = x.copy()
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64)
    marks = sorted(states)
    rest = b"".join(
        [
            np.asarray(doc_ids, "<i8").tobytes(), np.packbits(np.asarray(nulls, bool)).tobytes(), np.asarray(lengths, "<u4").tobytes(),
            np.asarray(marks, "<u4").tobytes(), places[marks].astype("<u8").tobytes(), *[states[t].astype("<u8").tobytes() for t in marks], stream.astype("<u4").tobytes(),
        ]
    )
    return _HEAD.pack(MAGIC, zlib.crc32(rest), start, n, len(lengths), lanes, len(marks), len(stream), zlib.crc32(ids.astype("<u4").tobytes()), table.crc) + rest


class Block:
    """A parsed block; checksums of the bytes and of the table are compared on the way in."""

    def __init__(self, data: bytes, table: Table) -> None:
        magic, crc, self.start, self.n, docs, self.lanes, marks, words, self.ids_crc, table_crc = _HEAD.unpack_from(data)
        rest = memoryview(data)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(rest) != crc or table_crc != table.crc:
            raise ValueError("damaged block, or another frequency table")
        self.table, at = table, 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(rest, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", docs)
        self.nulls = np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
        self.lengths = take("<u4", docs).astype(np.int64)
        self.marks = take("<u4", marks)
        self.places = take("<u8", marks)
        self.states = take("<u8", marks * self.lanes).reshape(marks, self.lanes)
        self.words = take("<u4", words)

    def piece(self, k: int) -> np.ndarray:
        """The ids from checkpoint ``k`` to the next; pieces need nothing of each other."""
        lanes, table, n = self.lanes, self.table, self.n
        first = int(self.marks[k])
        last = int(self.marks[k + 1]) if k + 1 < len(self.marks) else -(-n // lanes)
        at, x = int(self.places[k]), self.states[k].astype(np.uint64)
        out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        mask, bits, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(LOW)
        for t in range(first, last):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            v = x[: b - a]
            slot = v & mask
            ids = table.slots[slot]
            out[a - first * lanes : b - first * lanes] = ids
            v = table.freq[ids] * (v >> bits) + slot - table.cum[ids]
            under = np.flatnonzero(v < low)
            if len(under):
                v[under] = (v[under] << np.uint64(32)) | self.words[at : at + len(under)]
                at += len(under)
            x[: b - a] = v
        return out

    def ids(self) -> np.ndarray:
        out = np.concatenate([self.piece(k) for k in range(len(self.marks))]) if len(self.marks) else np.empty(0, np.uint32)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("decoded ids fail their checksum")
        return out
