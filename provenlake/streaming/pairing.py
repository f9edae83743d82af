"""Calls paired with their results on a stream of events.

State per (session, tool_id): the latest pending call.  A result takes it and emits one
row, so the emitted set equals the batch operator's whatever the micro-batches were, as
long as events of one id arrive in order.  With ``timeout_ms`` a call without a result is
dropped after that time, so abandoned calls do not pile up (the query then keeps running
batches, as processing-time timeouts do); without it, state stays until its result comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session string, tool_id string, use_seq long, result_seq long, command string, body string"
STATE = "seq long, command string"


def paired_stream(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``events`` (streaming): session, tool_id, seq, idx, etype (use or result), command, body."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["seq", "idx"])
        for r in rows.itertuples():
            if r.etype == "use":
                pending = (int(r.seq), r.command)
            elif pending is not None:
                out.append((key[0], key[1], pending[0], int(r.seq), pending[1], r.body))
                pending = None
        if pending is None:
            state.remove()
        else:
            state.update(pending)
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["session", "tool_id", "use_seq", "result_seq", "command", "body"])

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("session", "tool_id").applyInPandasWithState(step, OUTPUT, STATE, "append", kind)
