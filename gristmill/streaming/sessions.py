"""Event-time sessions of a stream: a session takes in events of one key with gaps up to a limit, and is given out once closed.

State is Spark's own session window; the watermark is the greatest event time of earlier runs less the delay. Where a run
has ended, its state was cleaned by that watermark too. An event is late, and left out, if the watermark has reached the
end of its own session, its time and the gap; a session is closed, and given out once, when it has reached the session's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n, total): sessions of a stream of events, or of a table, where delay has no meaning. Null keys are a
    key of their own; an event without a time is in no session."""
    plain = events.schema[time].dataType.typeName()
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return held.select(key, F.col("session.start").cast(plain).alias("start"), F.col("session.end").cast(plain).alias("end"), "n", "total")
