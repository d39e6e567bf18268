"""Numbers as text, rounded as Python rounds them: by the exact binary value, ties to even."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def two_places(values: pa.Array) -> pa.Array:
    """Two decimals; null stays null, NaN is "nan"."""
    return pa.array([None if v is None else f"{v:.2f}" for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def three_places(values: pa.Array) -> pa.Array:
    """Three decimals; null stays null, NaN is "nan"."""
    return pa.array([None if v is None else f"{v:.3f}" for v in values.to_pylist()], pa.string())
