"""Labelled rows for fitting a classifier: a bounded sample, chosen by a hash of the id."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import give_back


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` on division by ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def held_out_id(doc_id: int, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, text, y)``: at most ``rows`` labelled documents of each class that aren't held out.

    Those of least hash are taken, so the sample doesn't depend on the order of rows.  Ids labelled twice count once,
    rows without a label are left out; a null text counts as empty.  Of rows with equal ids one text is taken.
    """
    known = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("y")).where("lid is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("lid"), folds, fold)).withColumn("h", F.xxhash64(F.lit(7), F.col("lid")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "lid").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.groupBy("lid").agg(F.max("y").alias("y"))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.join(F.broadcast(picked), F.col("doc_id") == F.col("lid"))  # at most 2 * rows ids
    return found.groupBy("doc_id").agg(F.first("text").alias("text"), F.max("y").alias("y"))


def fit_in_task(rows: DataFrame, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """``fit(texts, classes)`` on a sample, in order of ids, run in one task: only the model comes to the driver.

    The sample is bounded by its parameters, so one task can hold it; a lost executor has it fitted anew.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        every = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"doc_id": [], "text": [], "y": []})
        made = pickle.dumps(fit(every["text"].tolist(), every["y"].to_numpy(np.int64)))
        del parts, every
        give_back()
        yield pd.DataFrame({"model": [made]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([], np.empty(0, np.int64))
