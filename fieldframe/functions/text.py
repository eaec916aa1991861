"""Fixed-decimal number text with Python's (binary-exact) rounding.

Java's ``%.6f`` rounds the shortest decimal form half-up, Python and C round
the exact binary value, so ties such as 0.2621885 print differently. Report
cells and log lines follow the reference's Python formatting; this runs as an
Arrow-batched pandas UDF on those small, already-aggregated tables only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _formatter(digits: int):
    @F.pandas_udf(T.StringType())
    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or pd.isna(v) else f"{v:.{digits}f}")

    return fmt


_FORMATTERS = {}


def fixed(col: Column, digits: int) -> Column:
    """``f"{value:.{digits}f}"`` for a double column (NULL stays NULL)."""
    if digits not in _FORMATTERS:
        _FORMATTERS[digits] = _formatter(digits)
    return _FORMATTERS[digits](col.cast("double"))
