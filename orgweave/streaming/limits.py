"""Structured Streaming forms of the budget, the limiter and the circuit, with state per provider."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "event_id long, provider string, admitted boolean, start_s double, is_open boolean"
_STATE = "used long, next_s double, failures long, open_until double"


def limited(calls: DataFrame, budget: int, rate: float, threshold: int, cooldown_s: float) -> DataFrame:
    """calls (event_id, provider, t_s, success) with admission, start time and circuit state, in the order of t_s within a batch.

    A budget of 0 admits none. The circuit opens for cooldown_s after `threshold` failures on end; a success closes it.
    A batch's calls of a provider are put in order in one task, in three numbers a call: a stream's batches are bounded
    by its source, whose limits (such as `maxFilesPerTrigger`) a hot provider calls for.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, next_s, failures, open_until = state.get if state.exists else (0, float("-inf"), 0, float("-inf"))
        rows = pd.concat(list(parts)).sort_values(["t_s", "event_id"])
        out = []
        for event_id, t, ok in zip(rows.event_id, rows.t_s, rows.success, strict=True):
            admitted = used < budget
            used += admitted
            start = max(t, next_s)
            next_s = start + 1 / rate
            is_open = t < open_until
            failures = 0 if ok else failures + 1
            if ok:
                open_until = float("-inf")
            elif failures >= threshold:
                open_until, failures = t + cooldown_s, 0
            out.append((event_id, key[0], bool(admitted), start, bool(is_open)))
        state.update((used, next_s, failures, open_until))
        yield pd.DataFrame(out, columns=["event_id", "provider", "admitted", "start_s", "is_open"])

    return calls.groupBy("provider").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
