"""Shipment lifecycle from a carrier event stream.

* D6: events resolve to a shipment by tracking reference: none -> not found,
  several (different suppliers) -> ambiguous.
* J1-J3: per shipment, events fold in *arrival* order from ``planned``; an
  event whose (shipment, external id) was already accepted is a duplicate; an
  event illegal in the current status is rejected and leaves the state
  unchanged (so a rejected event's id may be retried later).

An event is a function from a status to a status, and functions compose, so a
shipment's events need not lie in one task. Rows are range-partitioned on
(shipment, arrival) and sorted, so a shipment with very many events spans many
stored partitions:

1. each partition folds its first shipment's events from all statuses and its
   last one's from ``planned``, and reports one row of end statuses;
2. the driver follows those few rows and so knows the status in which each
   partition begins;
3. each partition judges its events: the statuses before all events of a batch
   come from prefix compositions in numpy, and which of them are duplicates from
   repeating that until it holds.

What a partition cannot see are ids accepted in an earlier partition. Only
shipments that cross a border can have such ids, so these (at most one per
partition) are checked afterwards, keyed by (shipment, id). Where a verdict
overlooked an acceptance, the shipment's events are judged once more with the
acceptances found so far. Each such round settles at least the events up to
the first that was wrong, usually all. The shipment summaries (status,
shipped_at, delivered_at) are plain aggregates over the verdict rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow import schemas as S
from skuflow.operators.sequences import ranged
from skuflow.session import store

_NEXT = {(cur, ev): nxt for cur, ev, nxt in S.SHIPMENT_TRANSITIONS}


def status_after_event(current: str, event_type: str) -> str | None:
    """The next status, or None when the event is illegal in ``current``."""
    return _NEXT.get((current, event_type))


def match_tracking(events: DataFrame, shipments: DataFrame) -> DataFrame:
    """Attach ``shipment_id`` and ``match_status`` (matched / not_found / ambiguous)."""
    by_ref = shipments.groupBy("tracking_reference").agg(
        F.count(F.lit(1)).alias("_matches"), F.min("shipment_id").alias("_sid"),
    )
    j = events.join(by_ref, "tracking_reference", "left")
    status = (F.when(F.col("_matches").isNull(), F.lit("not_found"))
              .when(F.col("_matches") > 1, F.lit("ambiguous")).otherwise(F.lit("matched")))
    return j.withColumn("match_status", status).withColumn(
        "shipment_id", F.when(F.col("_matches") == 1, F.col("_sid"))
    ).drop("_matches", "_sid")


_STATES = S.SHIPMENT_STATUS
_TYPES = sorted({ev for _, ev, _ in S.SHIPMENT_TRANSITIONS})
_PLANNED = _STATES.index("planned")
_SAME = len(_TYPES)  # the row of the step that changes nothing, also that of an unknown type
_STEP = np.array([[_STATES.index(_NEXT.get((s, t), s)) for s in _STATES] for t in _TYPES] + [list(range(len(_STATES)))])
_LEGAL = np.array([[(s, t) in _NEXT for s in _STATES] for t in _TYPES] + [[False] * len(_STATES)])
_VERDICTS = np.array(["illegal_transition", "accepted", "duplicate"], dtype=object)
_NAMES = np.array(_STATES, dtype=object)


def _statuses(begin: np.ndarray, steps: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Status before and after each event; ``begin``: place of the first event of each event's shipment,
    ``steps``: row of ``_STEP``, ``first``: status in which the first shipment of the batch begins."""
    n = len(steps)
    composed, at = _STEP[steps], np.arange(n) - begin
    width = 1
    while width <= int(at.max(initial=0)):
        rows = np.flatnonzero(at >= width)
        composed[rows] = np.take_along_axis(composed[rows], composed[rows - width], axis=1)
        width *= 2
    start = np.where(begin == 0, first, _PLANNED)
    after = composed[np.arange(n), start]
    return np.where(at > 0, np.r_[0, after[:-1]] if n else after, start), after


def _judge(begin: np.ndarray, ids: np.ndarray, types: np.ndarray, first: int,
           known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(verdict, status after)``; ``known``: events whose id was accepted before the batch. Whether an
    event is a duplicate depends on earlier verdicts of its id: begin with all repeats, until it holds."""
    key = ids + begin * (int(ids.max(initial=0)) + 1)
    order = np.argsort(key, kind="stable")
    head = np.maximum.accumulate(np.where(np.r_[True, np.diff(key[order]) != 0], np.arange(len(key)), 0)) if len(key) else order
    repeat = np.zeros(len(key), dtype=bool)
    repeat[order] = np.arange(len(key)) > head
    duplicate = known | repeat
    while True:
        before, after = _statuses(begin, np.where(duplicate, _SAME, types), first)
        accepted = ~duplicate & _LEGAL[types, before]
        total = np.r_[0, np.cumsum(accepted[order])]
        seen = np.empty(len(key), dtype=bool)
        seen[order] = total[:-1] > total[head]
        if np.array_equal(known | seen, duplicate):
            return np.where(duplicate, 2, accepted.astype(int)), after
        duplicate = known | seen


class _Fold:
    """Judges a sorted partition batch by batch; carries the last shipment's status and accepted ids."""

    def __init__(self, first: int):
        self.shipment, self.first, self.accepted, self.origin = None, first, set(), None
        self.started = False

    def batch(self, pdf: pd.DataFrame, order_col: str) -> tuple[np.ndarray, np.ndarray]:
        ships, names = pdf["shipment_id"].to_numpy(dtype=object), pdf["external_event_id"].to_numpy(dtype=object)
        arrival = pdf[order_col].to_numpy()
        begin = np.maximum.accumulate(np.where(np.r_[True, ships[1:] != ships[:-1]], np.arange(len(ships)), 0))
        if not self.started:
            self.started, self.shipment, self.origin = True, ships[0], arrival[0]
        elif ships[0] != self.shipment:
            self.first, self.accepted, self.origin = _PLANNED, set(), arrival[0]
        origin = np.where(begin == 0, self.origin, arrival[begin])
        head = int(np.searchsorted(begin, 1))
        known = pdf["_accepted_at"].to_numpy(dtype=float) < origin  # in an earlier partition; NaN: never
        known[:head] |= np.fromiter((x in self.accepted for x in names[:head]), dtype=bool, count=head)
        types = pd.Index(_TYPES).get_indexer(pdf["event_type"])
        verdict, after = _judge(begin, pd.factorize(names, use_na_sentinel=False)[0], np.where(types < 0, _SAME, types),
                                self.first, known)
        tail = int(begin[-1])
        if tail:
            self.accepted, self.origin = set(), arrival[tail]
        self.accepted.update(names[tail:][verdict[tail:] == 1])
        self.shipment, self.first = ships[-1], int(after[-1])
        return verdict, after


def _ends(order_col: str):
    """One row per stored partition: its first and last shipment, end statuses of the first one from every
    status, and the end status of the last one where that is another."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds, own, pid, one, last = [_Fold(s) for s in range(len(_STATES))], None, None, None, None
        for pdf in batches:
            pdf = pdf[(pdf["match_status"] == "matched").to_numpy()]
            if pdf.empty:
                continue
            ships = pdf["shipment_id"]
            if pid is None:
                pid, one = int(pdf["_pid"].iloc[0]), ships.iloc[0]
            last = ships.iloc[-1]
            if own is None:
                head = pdf[(ships == one).to_numpy()]
                for fold in folds if len(head) else []:
                    fold.batch(head, order_col)
            if last != one:
                own = own or _Fold(_PLANNED)
                own.batch(pdf[(ships == last).to_numpy()], order_col)
        if pid is not None:
            yield pd.DataFrame({"pid": [pid], "first": [one], "last": [last], "ends": [[f.first for f in folds]],
                                "tail": [own.first if own else -1]})
    return run


def _verdicts(order_col: str, starts: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = None
        for pdf in batches:
            found, status = pdf["match_status"].to_numpy(dtype=object).copy(), np.full(len(pdf), None, dtype=object)
            ours = found == "matched"
            if ours.any():
                fold = fold or _Fold(starts[int(pdf["_pid"].iloc[0])])
                verdict, after = fold.batch(pdf[ours], order_col)
                found[ours], status[ours] = _VERDICTS[verdict], _NAMES[after]
            yield pdf.assign(verdict=found, status_after=status)
    return run


def fold_events(events: DataFrame, order_col: str = "arrival_seq", partitions: int | None = None) -> DataFrame:
    """Verdict and status after each event (arrival order). An unmatched event keeps its match
    status as its verdict, as it belongs to no shipment. A shipment's events may lie in many partitions."""
    spark = events.sparkSession
    text = T.StringType()
    fields = [*events.schema.fields, T.StructField("verdict", text), T.StructField("status_after", text)]
    rows, settled = events.withColumn("_accepted_at", F.lit(None).cast("double")), None

    def done(judged: DataFrame) -> DataFrame:
        out = judged.select(*events.columns, "verdict", "status_after")
        return out if settled is None else settled.unionByName(out)

    while True:
        layout = ranged(rows, ["shipment_id", order_col, "external_event_id"], partitions)
        edges = sorted(layout.mapInPandas(_ends(order_col), "pid int, first string, last string, ends array<int>, tail int")
                       .collect(), key=lambda r: r.pid)
        starts, crossing, status, before = {}, set(), _PLANNED, None
        for e in edges:
            goes_on = before is not None and e.first == before
            starts[e.pid] = status if goes_on else _PLANNED
            crossing |= {e.first} if goes_on else set()
            status, before = (e.ends[starts[e.pid]] if e.last == e.first else e.tail), e.last
        judged = layout.mapInPandas(_verdicts(order_col, starts), T.StructType([*layout.schema.fields, *fields[-2:]]))
        if not crossing:
            return done(judged)
        judged = store(judged, "verdicts")
        # At most one crossing shipment per partition: a list as short as that of the partitions.
        across = F.broadcast(spark.createDataFrame([(c,) for c in sorted(crossing)], "shipment_id string"))
        arrival, verdict = F.col(order_col).cast("double"), F.col("verdict")
        ids = judged.join(across, "shipment_id").groupBy("shipment_id", "external_event_id").agg(
            F.min(F.when(verdict == "accepted", arrival)).alias("_accepted_at"),
            F.max(F.when(verdict != "duplicate", arrival)).alias("_open"),
            F.min(F.when(verdict == "duplicate", arrival)).alias("_closed"))
        wrong = ids.where("_open > _accepted_at OR _closed <= _accepted_at OR (_closed IS NOT NULL AND _accepted_at IS NULL)")
        again = [(r.shipment_id,) for r in wrong.select("shipment_id").distinct().collect()]
        if not again:
            return done(judged)
        again = F.broadcast(spark.createDataFrame(again, "shipment_id string"))
        settled = done(judged.join(again, "shipment_id", "left_anti"))
        rows = judged.select(*events.columns).join(again, "shipment_id", "left_semi").join(
            ids.select("shipment_id", "external_event_id", "_accepted_at"), ["shipment_id", "external_event_id"], "left")


def event_verdicts(events: DataFrame, shipments: DataFrame) -> DataFrame:
    """Per event: accepted / duplicate / illegal_transition / not_found / ambiguous."""
    return fold_events(match_tracking(events, shipments))


def shipment_states(verdicts: DataFrame, shipments: DataFrame | None = None,
                    order_col: str = "arrival_seq") -> DataFrame:
    """Final status, shipped_at (first accepted pickup), delivered_at
    (accepted delivery) and accepted event count per shipment. With
    ``shipments`` given, shipments without events are kept as ``planned``."""
    acc = verdicts.where(F.col("verdict") == "accepted")
    states = acc.groupBy("shipment_id").agg(
        F.max_by("status_after", order_col).alias("status"),
        F.min_by(F.when(F.col("event_type") == "picked_up", F.col("occurred_at")),
                 F.when(F.col("event_type") == "picked_up", F.col(order_col))).alias("shipped_at"),
        F.max_by(F.when(F.col("event_type") == "delivered", F.col("occurred_at")),
                 F.when(F.col("event_type") == "delivered", F.col(order_col))).alias("delivered_at"),
        F.count(F.lit(1)).alias("accepted_events"),
    )
    if shipments is None:
        return states
    base = shipments.select("shipment_id", "tracking_reference", "supplier_id")
    return base.join(states, "shipment_id", "left").select(
        "shipment_id", "tracking_reference", "supplier_id",
        F.coalesce("status", F.lit("planned")).alias("status"), "shipped_at", "delivered_at",
        F.coalesce("accepted_events", F.lit(0)).alias("accepted_events"),
    )


def duplicate_events(verdicts: DataFrame) -> DataFrame:
    """Events rejected because their id was already accepted for the shipment."""
    return verdicts.where(F.col("verdict") == "duplicate")
