"""The same stateless projection on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import DetectionEngine


def alert_stream(engine: DetectionEngine, events: DataFrame, json: str | None = None) -> DataFrame:
    """Alerts of a stream: append mode, no state, no watermark."""
    return engine.alerts(events, json)


def write_alerts(engine: DetectionEngine, events: DataFrame, sink: str, checkpoint: str, json: str | None = None, once: bool = False) -> StreamingQuery:
    """Starts a query that appends alerts as Parquet; exactly once by the checkpoint. once: what is there now, then ends."""
    writer = alert_stream(engine, events, json).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
