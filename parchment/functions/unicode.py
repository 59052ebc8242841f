"""Unicode forms, which Spark's own functions don't have."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Texts in the compatibility form NFKC, in Arrow batches; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))
