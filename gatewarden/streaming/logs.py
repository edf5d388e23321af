"""ST1: log cleaning (O3) and event typing (O6) over a stream.

Stateless: each micro-batch is cleaned map-side exactly as the batch job
does, so the stream's output equals the batch output on the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.logs import clean_log_lines, extract_lifecycle_events

LOG_RAW_SCHEMA = "deployment_id string, source string, ts timestamp, seq long, bytes binary"


def clean_log_stream(raw: DataFrame) -> DataFrame:
    """Streaming O3: raw byte lines -> cleaned lines (append mode)."""
    return clean_log_lines(raw)


def lifecycle_event_stream(raw: DataFrame) -> DataFrame:
    """Streaming O3 + O6: raw byte lines -> typed lifecycle events (append mode)."""
    return extract_lifecycle_events(clean_log_lines(raw))
