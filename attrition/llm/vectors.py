"""Reading embedding columns: which vectors take part, and their bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_usable() -> Column:
    """Whether a vector has components, all of them finite numbers and not all zero."""
    e, top = F.col("embedding"), 1.7976931348623157e308
    fine = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) <= top, F.lit(False)))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows that repeat a vec_id count once, with the smallest
    usable vector if there is one, else the smallest; null vec_ids take no part."""
    chosen = F.coalesce(F.min(F.when(is_usable(), F.col("embedding"))), F.min("embedding"))
    return vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(chosen.alias("embedding"))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is usable."""
    return vectors.where(is_usable())


def number_type(vectors: DataFrame) -> str:
    """numpy type of the components."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def matrix(rows, kind: str) -> np.ndarray:
    """Rows of bytes as doubles."""
    rows = list(rows)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
