"""Vectors as stored bytes: little-endian single-precision numbers one after another (Arrow-batched)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("binary")
def packed_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf("array<float>")
def unpacked_vector(blobs: pd.Series) -> pd.Series:
    """The numbers of a blob; bytes beyond the last whole one are left out."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))
