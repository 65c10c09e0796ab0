"""Logarithms, powers and rounding of the C library, whose last digit decides between nearly equal scores as it does in SQL."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def log10(values: pd.Series) -> pd.Series:
    """Common logarithm of positive numbers; the JVM's own differs in the last bit, for 52 among others."""
    return pd.Series([math.log10(x) for x in values], dtype="float64")


@F.pandas_udf(DoubleType())
def exp(values: pd.Series) -> pd.Series:
    """Exponential; the JVM's own differs in the last bit for one number in twelve."""
    return pd.Series([math.exp(x) for x in values], dtype="float64")


@F.pandas_udf(DoubleType())
def power(values: pd.Series, exponents: pd.Series) -> pd.Series:
    return pd.Series([math.pow(x, y) for x, y in zip(values, exponents)], dtype="float64")


def rounded(value: Column, digits: int) -> Column:
    """Rounding by a scaled double, as C programs do; Spark's own rounds the shortest decimal form, which goes the other way at borders."""
    return F.round(value * 10.0 ** digits) / 10.0 ** digits
