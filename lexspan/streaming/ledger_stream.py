"""Structured Streaming forms of the ledger: guarded transitions and step counts as steps arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import TRANSITIONS

_OUT = "run_id string, ts timestamp, from_state string, to_state string, legal boolean"


def dedup_steps(steps: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each step id once, within the watermark."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["step_id"])


def _check(key, frames, state: GroupState):
    rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.ts, r.step_id))
    at = state.get[0] if state.exists else None
    out = []
    for r in rows:
        if at is not None and r.state != at:
            out.append((key[0], r.ts, at, r.state, r.state in TRANSITIONS.get(at, [])))
        at = r.state
    state.update((at,))
    yield pd.DataFrame(out, columns=["run_id", "ts", "from_state", "to_state", "legal"])


def watch_transitions(steps: DataFrame) -> DataFrame:
    """Stream of steps (run_id, step_id, ts, state) -> each move with its legality; one short string of state for each run."""
    return steps.groupBy("run_id").applyInPandasWithState(_check, _OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def step_counts(steps: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Steps by state and tumbling window."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("steps"))
