"""Shared pieces of the streaming jobs: sources, sinks, state-store setup."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store; set it unless the
    cluster already chose a provider."""
    current = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if current != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The stream manager brings up the state stores' coordinator, which processors on batch frames need too.
    spark.streams.active


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 200) -> DataFrame:
    """Structured Streaming file source (new files in ``path`` are new input); a
    micro-batch takes at most ``max_files``, so a backlog comes in portions."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(max_files)).load(path)


def start_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    processing_time: str | None = None,
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Append ``df`` to a file sink with its own checkpoint (exactly-once file sink).

    The checkpoint folder must be on shared storage; a restarted query resumes
    from it after an executor or driver loss.
    """
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


#: Rows of one key that are sorted in a worker's memory.
SORT_ROWS = 50_000
#: The watermark that a stateful processor sees where it runs on a batch frame.
BATCH_WATERMARK = -1


def is_batch(timer_values) -> bool:
    """True where a processor runs over a batch frame: all rows of a key come in one
    call and no timer will ever fire."""
    return timer_values.getCurrentWatermarkInMs() == BATCH_WATERMARK


def micros_of(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def timestamp_of(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


#: Shards that keys are dealt to where a call for each key would cost more than its
#: rows, and the pages of a shard's states.
SHARDS, PAGES = 4096, 16
#: Stands for a null time, as the least of all.
NO_TIME = -9223372036854776


def shard_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def micros_col(ts: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME))


class PagedStates:
    """States (JSON values) of the keys of one shard in ``MapState``, a page an entry.

    A call of the processor reads and writes each page that it touches once, however
    many of the page's keys it changes; pages that it does not touch are not read.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.pages = handle.getMapState(f"{name}_pages", "page int", "states string")

    def load(self) -> None:
        self.open: dict[int, dict[str | None, Any]] = {}

    def _page(self, key: str | None) -> dict[str | None, Any]:
        p = zlib.crc32((key or "").encode()) % PAGES
        if p not in self.open:
            # Pairs, as a key may be null.
            self.open[p] = dict(json.loads(self.pages.getValue((p,))[0])) if self.pages.containsKey((p,)) else {}
        return self.open[p]

    def get(self, key: str | None) -> Any:
        return self._page(key).get(key)

    def put(self, key: str | None, state: Any) -> None:
        self._page(key)[key] = state

    def save(self) -> None:
        for p, states in self.open.items():
            if states:
                self.pages.updateValue((p,), (json.dumps(list(states.items())),))


class HeldRows:
    """Rows of one key in event order: a priority queue in ``MapState``.

    Rows ``(micros, seq, ...)`` (JSON values) wait in buckets of ``bucket_s`` seconds
    of event time, one state entry for what one micro-batch brings to one bucket.
    Adding touches only the buckets of the new rows; draining reads and removes only
    buckets that are over, in order, each sorted by (micros, seq).  So the work is in
    proportion to what comes and to what is ripe, and one bucket is in memory at a
    time.  One timer stands for each key, at the next moment anything can be done.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, bucket_s: float):
        self.handle, self.bucket_us = handle, max(int(bucket_s * 1_000_000), 1)
        self.rows = handle.getMapState(f"{name}_rows", "bucket long, part long", "rows string")
        self.parts = handle.getMapState(f"{name}_parts", "bucket long", "parts long")
        self.timer = handle.getValueState(f"{name}_timer", "at_ms long")

    def add(self, rows: Iterable[tuple]) -> None:
        buckets: dict[int, list[tuple]] = {}
        for r in rows:
            buckets.setdefault(r[0] // self.bucket_us, []).append(r)
        for b, part in buckets.items():
            n = self.parts.getValue((b,))[0] if self.parts.containsKey((b,)) else 0
            self.rows.updateValue((b, n), (json.dumps(part),))
            self.parts.updateValue((b,), (n + 1,))

    def in_order(self, rows: Iterable[tuple]) -> Iterator[list]:
        """All of ``rows``, at once and in order, where none are to wait: sorted in memory
        up to ``SORT_ROWS``, beyond that through the buckets."""
        rows = iter(rows)
        some = list(islice(rows, SORT_ROWS + 1))
        if len(some) <= SORT_ROWS:
            yield sorted(some, key=lambda r: (r[0], r[1]))
            return
        while some:
            self.add(some)
            some = list(islice(rows, SORT_ROWS))
        yield from self.drain(None)

    def whole_until(self, now_us: int) -> int:
        """All rows before this moment have come once the watermark has reached ``now_us``."""
        return now_us // self.bucket_us * self.bucket_us

    def drain(self, until_us: int | None) -> Iterator[list[list]]:
        """The rows of each bucket that ends by ``until_us`` (of all where None)."""
        for b in sorted(k[0] for k in self.parts.keys()):
            if until_us is not None and (b + 1) * self.bucket_us > until_us:
                return
            rows: list[list] = []
            for part in range(self.parts.getValue((b,))[0]):
                rows += json.loads(self.rows.getValue((b, part))[0])
                self.rows.removeKey((b, part))
            self.parts.removeKey((b,))
            yield sorted(rows, key=lambda r: (r[0], r[1]))

    def wake(self, also_us: int | None = None) -> None:
        """Move the key's timer to the end of the first bucket held, or of the bucket of ``also_us``."""
        ends = [k[0] + 1 for k in self.parts.keys()]
        if also_us is not None:
            ends.append(also_us // self.bucket_us + 1)
        at = -(-min(ends) * self.bucket_us // 1000) if ends else None
        old = self.timer.get()[0] if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def fired(self) -> None:
        self.timer.clear()


class RecentTimes:
    """How many of a key's times lie less than a window back, in event order.

    Times are kept in up to 65 buckets of a window; adding one touches the last
    bucket, expiring touches the first ones, and buckets in between are not read.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, window_us: int):
        self.window_us, self.bucket_us = window_us, max(window_us // 64, 1)
        self.times = handle.getMapState(f"{name}_times", "bucket long", "times string")
        self.held = handle.getValueState(f"{name}_held", "counts string")

    def load(self) -> None:
        #: bucket -> its number of times, oldest first; the buckets read so far; those to write.
        self.counts = dict(json.loads(self.held.get()[0])) if self.held.exists() else {}
        self.open: dict[int, list[int]] = {}
        self.changed: set[int] = set()

    def _bucket(self, b: int) -> list[int]:
        if b not in self.open:
            self.open[b] = json.loads(self.times.getValue((b,))[0]) if b in self.counts else []
        return self.open[b]

    def add(self, t: int) -> int:
        """The number of times in the window that ends with ``t``, itself included."""
        gone = t - self.window_us
        for b in list(self.counts):
            if b * self.bucket_us > gone:
                break
            kept = [x for x in self._bucket(b) if x > gone] if (b + 1) * self.bucket_us > gone else []
            if len(kept) < self.counts[b]:
                self._replace(b, kept)
        b = t // self.bucket_us
        self._replace(b, [*self._bucket(b), t])
        return sum(self.counts.values())

    def _replace(self, b: int, times: list[int]) -> None:
        self.open[b] = times
        self.changed.add(b)
        if times:
            self.counts[b] = len(times)
        else:
            self.counts.pop(b, None)

    def clear(self) -> None:
        for b in list(self.counts):
            self.open[b] = []
            self.changed.add(b)
        self.counts = {}

    def save(self) -> None:
        for b in self.changed:
            if self.open[b]:
                self.times.updateValue((b,), (json.dumps(self.open[b]),))
            elif self.times.containsKey((b,)):
                self.times.removeKey((b,))
        if self.changed:
            self.held.update((json.dumps(list(self.counts.items())),))
