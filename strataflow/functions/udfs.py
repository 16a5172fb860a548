"""Python functions of all kinds: a row at a time, scalar on Arrow batches, aggregate, of groups, table. Each does what the
built-in functions don't; where those can say it, they come first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def title_initials(name):
    """First letters of a name's words, by Python's own rules for case."""
    return None if name is None else "".join(w[0].casefold() for w in name.split() if w)


@F.pandas_udf(T.DoubleType())
def clipped_rank(v: pd.Series) -> pd.Series:
    """A value's place between 0 and 1 by a soft step round 25, on Arrow batches."""
    return 1 / (1 + 2.0 ** -((v - 25) / 5))


@F.pandas_udf(T.DoubleType())
def mid_count(v: pd.Series) -> float:
    """How many values lie from the lower to the upper quartile, both interpolated."""
    low, high = v.quantile(0.25), v.quantile(0.75)
    return float(((v >= low) & (v <= high)).sum())


def longest_rise(rows: pd.DataFrame) -> pd.DataFrame:
    """For a user's events: the longest run of events whose value exceeds that of the one before."""
    v = rows.sort_values("event_id")["value"]
    up = (v.diff() > 0).astype(int)
    runs = up.groupby((up == 0).cumsum()).sum()
    return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "rise": [int(runs.max())]})


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())]))
class Words:
    """The white-space words of a text with their places."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i
