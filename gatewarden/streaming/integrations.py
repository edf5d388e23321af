"""ST5, integrations: which providers and channels are configured, kept by a stream.

Input rows are settings of whole snapshots (deployment_id, ts, key, value): one
snapshot of a deployment is all its rows of one ``ts``.  The state of a deployment
is its newest snapshot's flags of the catalogue's settings (at most one entry for
each, whatever the snapshot holds; a call of the processor serves a shard of
deployments); a snapshot emits a row for each integration
whose flag differs from the last one emitted, and the first one all of them.
Snapshots of one micro-batch (or batch frame) apply in order of time; one that
comes in several micro-batches adds to itself; older ones change nothing.

Folded to the newest row of each (deployment_id, kind, name) the rows equal
:func:`gatewarden.operators.settings.integration_status` of the newest snapshots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..functions.text import bool_like, truthy
from ..operators.settings import Registry, integration_catalogue
from .common import HeldRows, PagedStates, micros_col, shard_of

_SCHEMA = "deployment_id string, us long, kind string, name string, configured boolean"
_UNSET = ("", False, False)
_COLS = ["deployment_id", "us", "kind", "name", "configured"]
#: Rows given out at once.
_OUT_ROWS = 20_000


class IntegrationProcessor(StatefulProcessor):
    def __init__(self, catalogue: list[tuple[str, str, str, int]]):
        self.catalogue = catalogue

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Of each deployment: the time of its newest snapshot; found: settings key ->
        # [value, as provider, as channel] of that; shown: 0 or 1 for each catalogue
        # entry, as last emitted.
        self.states = PagedStates(handle, "snapshot")
        self.held = HeldRows(handle, "held", 86400)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.states.load()
        now: dict[str | None, list] = {}
        out: list[tuple] = []

        def show(dep: str | None, state: list) -> None:
            us, found, shown = state
            flags = [found.get(s, _UNSET)[2 if kind == "channel" else 1] for kind, _, s, _ in self.catalogue]
            state[2] = "".join("01"[flag] for flag in flags)
            if state[2] != shown:
                for i, ((kind, name, _, _), flag) in enumerate(zip(self.catalogue, flags)):
                    if shown is None or shown[i] != "01"[flag]:
                        out.append((dep, us, kind, name, flag))

        def new() -> Iterator[tuple]:
            for frame in rows:
                for dep, us, *setting, provider, channel in zip(*(frame[c] for c in ("deployment_id", "us", "key", "value", "as_provider", "as_channel"))):
                    yield int(us), 0, dep, *setting, bool(provider), bool(channel)

        for ripe in self.held.in_order(new()):
            for us, _, dep, setting, *flags in ripe:
                state = now.get(dep)
                if state is None:
                    state = now[dep] = self.states.get(dep) or [None, {}, None]
                if state[0] is None or us > state[0]:
                    if state[0] is not None:
                        show(dep, state)
                    state[0], state[1] = us, {}
                # Of several values of one key the greatest counts, as in the batch pivot.
                found = state[1]
                if us == state[0] and setting is not None and (setting not in found or flags[0] > found[setting][0]):
                    found[setting] = flags
            if len(out) >= _OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLS)
                out.clear()
        for dep, state in now.items():
            show(dep, state)
            self.states.put(dep, state)
            if len(out) >= _OUT_ROWS:
                yield pd.DataFrame(out, columns=_COLS)
                out.clear()
        self.states.save()
        if out:
            yield pd.DataFrame(out, columns=_COLS)

    def close(self) -> None:
        pass


def integration_stream(settings: DataFrame, registry: Registry = C.REGISTRY) -> DataFrame:
    """settings(deployment_id, ts, key, value) -> the integrations that changed (append).
    Settings outside the catalogue reach the state as a null key, which tells that a
    snapshot came and nothing else."""
    catalogue = integration_catalogue(registry)
    wanted = F.col("key").isin(*sorted({s for _, _, s, _ in catalogue}))
    rows = settings.select(
        shard_of("deployment_id").alias("shard"),
        "deployment_id",
        micros_col("ts").alias("us"),
        F.when(wanted, F.col("key")).alias("key"),
        F.when(wanted, F.coalesce("value", F.lit(""))).alias("value"),
        truthy("value").alias("as_provider"),
        bool_like("value").alias("as_channel"),
    )
    changes = rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=IntegrationProcessor(catalogue), outputStructType=_SCHEMA, outputMode="Append", timeMode="None"
    )
    return changes.select("deployment_id", F.timestamp_micros("us").alias("ts"), "kind", "name", "configured")


def latest_integrations(changes: DataFrame) -> DataFrame:
    """(deployment_id, kind, name, configured) after all changes."""
    return changes.groupBy("deployment_id", "kind", "name").agg(F.max_by("configured", "ts").alias("configured"))
