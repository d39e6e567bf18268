import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotweave.llm import rans, tokens
from tests.llm.conftest import prose, table

PATH = tokens.default_tokenizer()
TOK = Tokenizer.from_file(PATH)
ENC = tokens.Encoder(PATH)


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids + [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab É's.,1 \n\t 日_-"), max_size=4))
def test_encoder(texts):
    got, per = ENC.encode(texts)
    assert got.tolist() == [i for t in texts for i in ids(t)] and per.tolist() == [len(ids(t)) for t in texts]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    enc = tokens.Encoder(PATH)
    for k in range(6):
        texts = [prose(k * 10 + i, 30) + ".\nKa lo, <|endoftext|>"[: 8 * (i % 3)] for i in range(5)]
        got, _ = enc.encode(texts)
        assert got.tolist() == [i for t in texts for i in ids(t)]
    assert len(enc.index) < 2000


def test_new_words_go_to_the_model_together():
    """Words, also with signs behind or a newline before, are encoded several a call; ids stay those of the library."""
    enc = tokens.Encoder(PATH)
    calls = []

    class Tok:
        def __getattr__(self, name):
            return getattr(TOK, name)

        @property
        def model(self):
            return self

        def tokenize(self, text):
            calls.append(text)
            return TOK.model.tokenize(text)

    enc.tok = Tok()
    texts = [" ".join(prose(i, 200).split(" ")).replace("ka ", "été, ").replace("lo ", "ño.'\nSi ").replace("mi ", "'s ") for i in range(4)]
    got, _ = enc.encode(texts)
    assert got.tolist() == [i for t in texts for i in ids(t)]
    assert 0 < len(calls) < len(enc.index) / 4


def test_vocabulary_that_joins_words_is_not_plain():
    assert not any(tokens._spans(t) for t in ("\u0120the", "\u010a", "!?", "\u0120\u0120", "\u0120(", "'s"))
    assert all(tokens._spans(t) for t in ("of\u0120the", "\u010athe", "end.", "\u00c3\u00a9,"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 50))
def test_rans_round_trip(values, lanes):
    data = np.array(values, np.int64)
    table_ = rans.Table(np.bincount(data, minlength=50) if len(data) else np.zeros(50, int))
    old = rans.LANES, rans.CHECKPOINT_STEPS
    rans.LANES, rans.CHECKPOINT_STEPS = lanes, 3
    try:
        block = rans.Block(rans.encode(data, table_, 7, np.array([5]), np.array([False]), np.array([len(data)])), table_)
        assert block.ids().tolist() == values and block.start == 7 and block.doc_ids.tolist() == [5]
        parts = [block.piece(k) for k in reversed(range(len(block.marks)))][::-1]
        assert (np.concatenate(parts).tolist() if parts else []) == values
    finally:
        rans.LANES, rans.CHECKPOINT_STEPS = old


def test_rans_size_and_damage():
    rng = np.random.default_rng(0)
    data = rng.geometric(0.05, 200_000)
    table_ = rans.Table(np.bincount(data))
    raw = rans.encode(data, table_, 0, np.array([1]), np.array([False]), np.array([len(data)]))
    p = np.bincount(data) / len(data)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(data) / 8
    assert len(raw) < 1.12 * entropy
    bad = bytearray(raw)
    bad[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(bad), table_)
    with pytest.raises(ValueError):
        rans.Block(raw, rans.Table(np.bincount(data[:100])))


def test_files(spark, tmp_path):
    rows = [(i * 7 % 101, prose(i, i % 60)) for i in range(101)]
    path = str(tmp_path / "t")
    tokens.write_tokens(table(spark, rows), path, PATH, block_ids=500)
    got = {r.doc_id: r for r in tokens.read_tokens(spark, path).collect()}
    start = 0
    for i, t in sorted(rows):
        own = ids(t)
        raw = np.array(own, "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (start, len(own), zlib.crc32(raw), raw)
        start += len(own)


def test_odd(odd, empty, odd_rows):
    out = tokens.coded(odd).collect()
    assert len(out) == len(odd_rows) and sum(r.n_tokens for r in out) == sum(len(ids(t)) for _, t in odd_rows)
    assert sorted((r.start for r in out if r.doc_id is None)) == [0, min(len(ids(odd_rows[8][1])), 1)] or all(r.start < 1 + len(ids(odd_rows[8][1])) for r in out if r.doc_id is None)
    assert tokens.coded(empty).count() == 0
