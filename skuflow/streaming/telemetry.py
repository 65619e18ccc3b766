"""J5-J8 on streams: windowed request metrics with a watermark, and tailing
job events until the job is terminal.

Late data policy: requests later than the watermark (10 minutes behind the
newest completion time seen) are dropped; windows are emitted in append mode
once the watermark passes their end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skuflow.operators import telemetry

WATERMARK = "10 minutes"


def request_rate_stream(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """J6 streaming: same windows as the batch query, closed by the watermark."""
    return telemetry.request_rate(log.withWatermark(time_col, WATERMARK), time_col)


def latency_stream(log: DataFrame, time_col: str = "completed_at") -> DataFrame:
    """J7 streaming."""
    return telemetry.histogram_quantile(log.withWatermark(time_col, WATERMARK), time_col=time_col)


LONGEST_US = 600_000_000
GAUGE_SCHEMA = "sampled_at timestamp, in_progress long"
GAUGE_STATE = "at array<long>, n array<long>, next long, running long"


def _partial_changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per instant and task."""
    total: pd.Series | None = None
    for pdf in batches:
        part = pdf.groupby("t")["n"].sum()
        total = part if total is None else total.add(part, fill_value=0)
    if total is not None:
        t = total.index.to_numpy(dtype=np.int64)
        yield pd.DataFrame({"at": pd.to_datetime(t, unit="us", utc=True), "t": t, "n": total.to_numpy(dtype=np.int64), "one": 1})


def _gauge(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    step = telemetry.SCRAPE_INTERVAL_US
    at, n, following, running = state.get if state.exists else ([], [], None, 0)
    pending = pd.Series(list(n), index=list(at), dtype="int64")
    if not state.hasTimedOut:
        for pdf in pdfs:
            pending = pending.add(pdf.groupby("t")["n"].sum(), fill_value=0).astype("int64")
    closed = state.getCurrentWatermarkMs() * 1000  # no change before this instant can still come
    ready = pending[pending.index < closed].sort_index()
    if following is None and len(ready):
        following = int(ready.index[0])
    if following is not None and following < closed:
        instants = np.arange(following, closed, step, dtype=np.int64)
        change = np.zeros(len(instants), dtype=np.int64)
        change[(ready.index.to_numpy(dtype=np.int64) - following) // step] = ready.to_numpy()
        values = running + np.cumsum(change)
        following, running = int(instants[-1]) + step, int(values[-1])
        yield pd.DataFrame({"sampled_at": pd.to_datetime(instants, unit="us"), "in_progress": values})
    rest = pending[pending.index >= closed]
    state.update(([int(x) for x in rest.index], [int(x) for x in rest], following, running))
    state.setTimeoutTimestamp(max(0, state.getCurrentWatermarkMs()) + step // 1000)


def requests_in_progress_stream(log: DataFrame, time_col: str = "completed_at", longest_us: int = LONGEST_US) -> DataFrame:
    """J8 streaming: the gauge at every instant that the watermark has passed, idle ones included.

    Two levels: each task of a micro-batch sums its changes per instant, and one state adds those rows, keeps
    the instants that are still open (the watermark's delay long), and carries the running sum on. A timer
    emits instants at which nothing changes. A change comes up to a request's duration before its completion,
    so the watermark waits that much longer, ``longest_us`` at most; a longer request counts for that long.
    """
    changes = telemetry.gauge_changes(log, time_col, longest_us)
    partial = changes.mapInPandas(_partial_changes, "at timestamp, t long, n long, one int")
    delay = f"{int(pd.Timedelta(WATERMARK).total_seconds()) + -(-longest_us // 1_000_000)} seconds"
    return partial.withWatermark("at", delay).groupBy("one").applyInPandasWithState(
        _gauge, GAUGE_SCHEMA, GAUGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


TAIL_SCHEMA = "job_id string, event_id string, occurred_at timestamp, status string, kind string"
TAIL_STATE = "emitted array<string>, done boolean"
# Job states that end a tail, and the wait after the last event.
TERMINAL_EVENT_STATUS = ["completed", "completed_with_errors", "failed"]
IDLE_MS = 120_000


def _tail(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (job_id,) = key
    if state.hasTimedOut:
        done = state.get[1]
        state.remove()
        if not done:
            at = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            yield pd.DataFrame([(job_id, None, at, "still_running", "timeout")],
                               columns=["job_id", "event_id", "occurred_at", "status", "kind"])
        return
    emitted, done = (set(state.get[0] or []), state.get[1]) if state.exists else (set(), False)
    if done:
        return
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["occurred_at", "event_id"])
    rows = []
    for eid, ts, st in zip(batch["event_id"], batch["occurred_at"], batch["status"]):
        if eid in emitted or done:
            continue
        emitted.add(eid)
        rows.append((job_id, eid, ts, st, "event"))
        if st in TERMINAL_EVENT_STATUS:
            done = True
            rows.append((job_id, None, ts, st, "completed"))
    state.update((sorted(emitted), done))
    # A job that stays idle for 120 s of event time gets its timeout row then.
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(batch["occurred_at"].max().timestamp() * 1000)) + IDLE_MS)
    if rows:
        yield pd.DataFrame(rows, columns=["job_id", "event_id", "occurred_at", "status", "kind"])


def tail_job_events(events: DataFrame) -> DataFrame:
    """J5 (re-aimed): each operation event once per job, then one completion
    row when its state is completed, completed with errors or failed; a job
    idle for 120 s gets one timeout row (event time keeps replays
    deterministic)."""
    return events.withWatermark("occurred_at", "2 minutes").groupBy("job_id").applyInPandasWithState(
        _tail, TAIL_SCHEMA, TAIL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
