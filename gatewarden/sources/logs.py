"""O3 clean_log_lines and O6 extract_lifecycle_events.

Child-process output arrives as raw byte lines.  Cleaning: decode as UTF-8
with replacement, strip trailing whitespace (Python rules), *then* remove
colour codes (order matters: blanks before a trailing colour code stay).

The supervisor writes its own lines into the same stream; O6 turns them
back into typed events for the lifecycle jobs.  The message shapes are the
fixed values below.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_rstrip, strip_colour

# ---------------------------------------------------------------------------
# FIXED VALUES — message shapes written by the supervisor (regular
# expressions over the cleaned line), in the order they are tested.
# (event, pattern)
# ---------------------------------------------------------------------------
LINE_PATTERNS: list[tuple[str, str]] = [
    ("exit", r"^\[gateway\] exited \(code (-?\d+|None)\) — supervising restart"),
    ("crashed", r"^\[gateway\] crash-looping \((\d+) exits in (\d+)s\) — giving up auto-restart"),
    ("respawn_scheduled", r"^\[gateway\] restarting in (\d+)s \(attempt (\d+)\)"),
    ("respawn_cancelled", r"^\[gateway\] restart cancelled \(stopped/reconfigured\)"),
    ("unready", r"^\[gateway\] restart skipped — provider/model not configured"),
    ("lock_cleared", r"^\[gateway\] cleared stale pid file \(pid (\d+)\)"),
    ("start_failed", r"^\[error\] Failed to start: "),
    ("start", r"^\[gateway\] model=.* \| provider_key="),
    ("dashboard_spawned", r"^\[dashboard\] spawned pid=(\d+) "),
    ("dashboard_start_failed", r"^\[dashboard\] FAILED to spawn: "),
    ("dashboard_exit", r"^\[dashboard\] EXITED with code (-?\d+) — "),
    ("dashboard_exit", r"^\[dashboard\] exited cleanly \(code (0)\)"),
    ("upstream_status", r"^\[proxy\] (\S+) (\S*) -> (\d+) body="),
    ("upstream_failure", r"^\[proxy\] upstream error for (\S+) (\S*): "),
    ("ws_connect_failed", r"^\[ws-proxy\] upstream connect failed for (\S*): "),
    ("ws_pump_error", r"^\[ws-proxy\] (client→upstream|upstream→client) error on (\S*): "),
    ("oauth_poll_error", r"^\[xai-oauth\] poll error: "),
    ("oauth_authorized", r"^\[xai-oauth\] authorized — restarting gateway"),
    ("oauth_failed", r"^\[xai-oauth\] failed: (.*)$"),
    ("oauth_expired", r"^\[xai-oauth\] device code expired"),
    ("boot_unready", r"^\[server\] Config incomplete — gateway not started"),
]
# ---------------------------------------------------------------------------


def clean_log_lines(raw: DataFrame, data: str = "bytes", out: str = "line") -> DataFrame:
    """Decode (replacement for bad bytes), strip right, remove colour codes.

    ``data`` may be BINARY or STRING.  Map-side only; the colour regex runs
    only on lines that contain an escape character.
    """
    c = F.col(data)
    text = F.make_valid_utf8(c.cast("string")) if dict(raw.dtypes).get(data) == "binary" else c
    stripped = py_rstrip(text)
    cleaned = F.when(stripped.contains("\x1b"), strip_colour(stripped)).otherwise(stripped)
    return raw.withColumn(out, cleaned).drop(data) if data != out else raw.withColumn(out, cleaned)


def _padded(pattern: str, groups: int = 3) -> str:
    """Append empty groups so every pattern has ``groups`` groups (matching unchanged)."""
    return pattern + "()" * (groups - re.compile(pattern).groups)


def _match(line: Column) -> Column:
    """struct(event, pattern) of the first pattern the line matches."""
    e = None
    for name, pat in LINE_PATTERNS:
        val = F.struct(F.lit(name).alias("event"), F.lit(_padded(pat)).alias("pat"))
        cond = line.rlike(pat)
        e = F.when(cond, val) if e is None else e.when(cond, val)
    return e


def extract_lifecycle_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed events from cleaned log lines (lines of no known shape are dropped).

    Adds event, exit_code, delay_s, attempt, pid, method, path, status, detail.
    One ``CASE WHEN`` of ``rlike`` tests picks the event and its pattern; the
    typed columns are ``regexp_extract`` groups of that pattern (passed as a
    column, so the generated code stays small) + ``try_cast``.  Map-side only.
    """
    ln = F.col(line)
    # The cleaned line is usually an expression (O3's decode/strip/colour
    # removal).  Passing it through a one-element explode makes it an
    # attribute, so the pattern tests below read it instead of the optimizer
    # copying the whole cleaning expression into each of them.
    lines = lines.withColumn(line, F.explode(F.array(ln)))
    ev = lines.filter(ln.startswith("[")).withColumn("__m", _match(ln)).filter(F.col("__m").isNotNull())
    e = F.col("__m.event")

    def g(i: int) -> Column:
        return F.call_function("regexp_extract", ln, F.col("__m.pat"), F.lit(i))

    def as_int(c: Column) -> Column:
        return c.try_cast(T.IntegerType())

    return ev.withColumns(
        {
            "event": e,
            "exit_code": as_int(F.when(e.isin("exit", "dashboard_exit"), g(1))),
            "delay_s": as_int(F.when(e == "respawn_scheduled", g(1))),
            "attempt": as_int(F.when(e == "respawn_scheduled", g(2)).when(e == "crashed", g(1))),
            "pid": F.when(e.isin("lock_cleared", "dashboard_spawned"), g(1)).try_cast(T.LongType()),
            "method": F.when(e.isin("upstream_status", "upstream_failure"), g(1)),
            "path": F.when(e.isin("upstream_status", "upstream_failure", "ws_pump_error"), g(2)).when(
                e == "ws_connect_failed", g(1)
            ),
            "status": as_int(F.when(e == "upstream_status", g(3))),
            "detail": F.when(e == "oauth_failed", g(1)),
        }
    ).drop("__m")


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet"):
    """Structured Streaming source of raw log rows (see :mod:`gatewarden.streaming`)."""
    return spark.readStream.format(fmt).schema(schema).load(path)
