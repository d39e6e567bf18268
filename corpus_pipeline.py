"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``.  ``docs`` is a table that has been written, so stages read it as often as they need, and the
working tables of a stage are deleted when the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import decontam, mixing, similar, tokens, toxicity
from plotweave.llm.common import read
from plotweave.storage import delete_path, discard, materialise, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the stage that ended last, in this thread.
_WORK: ContextVar[tuple[str, ...]] = ContextVar("work", default=())


def _in_turn(stage: Stage, first: bool = False, last: bool = False) -> Stage:
    """The stage, after deleting the working tables of the one before it; the result of the last may be read lazily."""

    @wraps(stage)
    def turn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in () if first else _WORK.get():
            delete_path(spark, path)
        _WORK.set(())
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _WORK.set(() if last else tuple(paths))
        return out

    return turn


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, trained on the labels of those given, doesn't reject."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: SimHash classes of operator 5, over five-word shingles, and similarity 0.8 or more."""
    return similar.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its own draw say, shuffled."""
    return mixing.poisson_mix(docs).select(docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as entropy-coded token files; a row for each document, from the files."""
    return tokens.coded(docs)


STAGES = [
    ("toxicity", _in_turn(drop_toxic, first=True)),
    ("near duplicates", _in_turn(drop_near_copies)),
    ("decontamination", _in_turn(drop_leaks)),
    ("source mix", _in_turn(mix_sources)),
    ("token output", _in_turn(write_token_files, last=True)),
]

#: The first, second and last stage have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k + 1}")
        discard(before)
    return docs
