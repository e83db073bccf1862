"""Vectors that take part, and arrays of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """vec_id, x (array of doubles) and other columns of the rows with an id whose vector has only finite components, not all zero."""
    x = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), *others).where("vec_id is not null and size(x) > 0")
    return rows.where(finite("x"))


def finite(name: str) -> Column:
    """Whether an array has only finite components, and one that is not zero."""
    return F.forall(name, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))) & F.exists(name, lambda v: v != 0)  # NaN is above infinity in Spark


def stacked(column: pd.Series) -> np.ndarray:
    """A matrix of a column of arrays."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
