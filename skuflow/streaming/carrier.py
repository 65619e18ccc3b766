"""J1-J3 as a stateful stream: carrier events -> per-shipment lifecycle state.

``applyInPandasWithState`` keeps, per shipment, the current status and the
ids of accepted events (for duplicate detection). Each micro-batch's events
of a shipment are applied in arrival order; the verdict of every event is
emitted (append mode). Some time after a shipment has ended, its accepted ids
are dropped and only the end state stays, as a marker: an event that comes
even later gets the verdict ``after_end`` instead of being judged afresh. So the
state of an ended shipment is one short row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skuflow import schemas as S
from skuflow.operators import lifecycle, partners

OUTPUT_SCHEMA = ("shipment_id string, arrival_seq long, external_event_id string, event_type string, "
                 "occurred_at timestamp, verdict string, status_after string")
STATE_SCHEMA = "status string, accepted array<string>, last_arrival long, ended boolean"
TERMINAL_TIMEOUT = "1 day"
TERMINAL_TIMEOUT_MS = 24 * 3600 * 1000


def _step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (shipment_id,) = key
    if state.hasTimedOut:
        status, _, last, _ = state.get
        state.update((status, [], last, True))
        return
    if state.exists:
        status, accepted, last, ended = state.get
        accepted = set(accepted or [])
    else:
        status, accepted, last, ended = "planned", set(), -1, False
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values("arrival_seq")
    verdicts, after = [], []
    for eid, etype, seq in zip(batch["external_event_id"], batch["event_type"], batch["arrival_seq"]):
        if ended:
            verdicts.append("after_end")
        elif eid in accepted:
            verdicts.append("duplicate")
        else:
            nxt = lifecycle.status_after_event(status, etype)
            if nxt is None:
                verdicts.append("illegal_transition")
            else:
                status = nxt
                accepted.add(eid)
                verdicts.append("accepted")
        after.append(status)
        last = max(last, int(seq))
    state.update((status, sorted(accepted), last, ended))
    if status in S.TERMINAL_SHIPMENT_STATUS and not ended:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(batch["occurred_at"].max().timestamp() * 1000))
                                  + TERMINAL_TIMEOUT_MS)
    yield pd.DataFrame({
        "shipment_id": shipment_id, "arrival_seq": batch["arrival_seq"].astype("int64"),
        "external_event_id": batch["external_event_id"], "event_type": batch["event_type"],
        "occurred_at": batch["occurred_at"], "verdict": verdicts, "status_after": after,
    })


def lifecycle_stream(raw: DataFrame, shipments: DataFrame, watermark: str = TERMINAL_TIMEOUT) -> DataFrame:
    """Streaming verdicts for matched events; ``raw`` has ``arrival_seq`` and
    ``value`` (carrier JSON); ``shipments`` is a static table."""
    events, _ = partners.parse_carrier_events(raw)
    matched = lifecycle.match_tracking(events, shipments).where(F.col("match_status") == "matched")
    return (
        matched.withWatermark("occurred_at", watermark)
        .groupBy("shipment_id")
        .applyInPandasWithState(_step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    )
