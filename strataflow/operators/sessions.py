"""Sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.names import fresh


def sessionize(events: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """One row for each session: rows of a user less than `gap` apart. Sessions are merged before and after the exchange."""
    time, window = fresh(events, "_at", "_window")
    named = events.withColumn(time, F.col(at).cast("timestamp"))
    grouped = named.groupBy(user, F.session_window(time, gap).alias(window)).agg(F.count(F.lit(1)).alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return grouped.drop(window)
