"""String functions on sequences and names, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(F.upper(seq)), "ACGTRYKMBVDH", "TGCAYRMKVBHD")


def plain_name(name: Column) -> Column:
    """A region or name without the signs that separate fields."""
    return F.translate(name, ",;|!{}()", "")


@pandas_udf(StringType())
def ascii_folded(s: pd.Series) -> pd.Series:
    """Letters without their marks; what has no plain letter goes."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())
