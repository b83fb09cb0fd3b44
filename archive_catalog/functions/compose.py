"""Unicode composition, which Spark has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.astype(object).str.normalize("NFC") if s.notna().any() else s


def composed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column in composed form; of names without combining marks a null passes through Python. The input is planned once."""
    marked = F.when(F.col(column).rlike(r"\p{M}|[\x{1100}-\x{11FF}]"), F.col(column))
    return df.withColumn(column, F.coalesce(_nfc(marked), column))
