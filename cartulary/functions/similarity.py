"""Title similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the built-in edit distance measures something else."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])
