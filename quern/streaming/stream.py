"""Handlers over unbounded streams: one machine per stream, kept as state between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.streaming.batch import STREAM
from quern.streaming.handlers import Handler, Machine

#: Fields that every event has, if only as null.
NAMED = frozenset({*STREAM, "kind"})


def _events(frame: pd.DataFrame, order: str = "seq") -> list[dict]:
    rows = []
    for row in frame.sort_values(order, kind="stable").to_dict("records"):
        rows.append({k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in row.items() if k in NAMED or not (v is None or (isinstance(v, float) and v != v))})
    return rows


def _schema(handler: Handler, df: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return f"session_id {kinds['session_id']}, agent_id {kinds['agent_id']}, seq long" + "".join(f", `{n}` string" for n in handler.emit)


def run_machines(events: DataFrame, handler: Handler) -> DataFrame:
    """Batch: one machine per stream. For programs that only the machine can run."""

    keys, order = (["session_id"], "offer") if handler.scope == "session" else (STREAM, "seq")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(handler)
        return pd.DataFrame([r for e in _events(frame, order) for r in machine.accept(e)], columns=["session_id", "agent_id", "seq", *handler.emit])

    return events.groupBy(*keys).applyInPandas(one, _schema(handler, events))


def run_stream(events: DataFrame, handler: Handler) -> DataFrame:
    """Streaming: rows as windows close. A stream's events must arrive in order, between micro-batches too; a session's end
    drops its state."""
    out = _schema(handler, events)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(handler)
        if state.exists:
            machine.restore(pickle.loads(state.get[0]))
        rows, ended = [], False
        for e in _events(pd.concat(list(frames))):
            rows += machine.accept(e)
            ended = e["kind"] == "session.end"
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps(machine.state()),))
        yield pd.DataFrame(rows, columns=["session_id", "agent_id", "seq", *handler.emit])

    return events.groupBy(*STREAM).applyInPandasWithState(step, out, "machine binary", "append", GroupStateTimeout.NoTimeout)


def replay_counts(events: DataFrame, handler: Handler) -> DataFrame:
    """(session_id, agent_id, triggers, rows, unclosed, no_match, unsatisfied_before, first, last) per stream."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(handler)
        found = _events(frame)
        for e in found:
            machine.accept(e)
        c = machine.finish()
        times = [e["ts"] for e in found if "ts" in e]
        return pd.DataFrame([{"session_id": found[0]["session_id"], "agent_id": found[0]["agent_id"], **c, "first": str(min(times)) if times else None, "last": str(max(times)) if times else None}])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.groupBy(*STREAM).applyInPandas(one, f"session_id {kinds['session_id']}, agent_id {kinds['agent_id']}, triggers long, rows long, unclosed long, no_match long, unsatisfied_before long, first string, last string")
