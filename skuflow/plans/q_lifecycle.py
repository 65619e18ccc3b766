"""Carrier stream and shipment lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions.scalars import utc_iso_micros
from skuflow.operators import lifecycle, partners
from skuflow.plans.catalog import register
from skuflow.sources import views

_TS = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _events(spark, sf):
    events, _ = partners.parse_carrier_events(views.carrier_raw(spark, sf))
    return events


def _verdicts(spark, sf):
    return lifecycle.event_verdicts(_events(spark, sf), views.shipments(spark, sf))


@register("match_tracking_reference", """
SELECT arrival_seq, external_event_id, tracking_reference, match_status, shipment_id FROM cc_matched
""", ["cc_matched"])
def q_match_tracking_reference(spark, sf):
    """Event -> shipment by tracking reference (not found / ambiguous)."""
    m = lifecycle.match_tracking(_events(spark, sf), views.shipments(spark, sf))
    return m.select("arrival_seq", "external_event_id", "tracking_reference", "match_status", "shipment_id")


@register("shipment_event_rejects", """
SELECT arrival_seq, external_event_id, shipment_id, verdict, status_after FROM cc_verdicts
""", ["cc_verdicts"])
def q_shipment_event_rejects(spark, sf):
    """Per-event verdict in arrival order."""
    return _verdicts(spark, sf).select("arrival_seq", "external_event_id", "shipment_id", "verdict", "status_after")


@register("dedupe_shipment_events", """
SELECT arrival_seq, external_event_id, shipment_id FROM cc_verdicts WHERE verdict = 'duplicate'
""", ["cc_verdicts"])
def q_dedupe_shipment_events(spark, sf):
    """Re-sent events whose id was already accepted for the shipment."""
    return lifecycle.duplicate_events(_verdicts(spark, sf)).select("arrival_seq", "external_event_id", "shipment_id")


_STATE_SQL = f"""
SELECT shipment_id, status, {_TS.format(c='shipped_at')} AS shipped_at,
       {_TS.format(c='delivered_at')} AS delivered_at, accepted_events
FROM cc_states
"""


@register("shipment_lifecycle", _STATE_SQL, ["cc_states"])
def q_shipment_lifecycle(spark, sf):
    """Final status / shipped_at / delivered_at per shipment with events."""
    s = lifecycle.shipment_states(_verdicts(spark, sf))
    return s.select("shipment_id", "status", utc_iso_micros("shipped_at").alias("shipped_at"),
                    utc_iso_micros("delivered_at").alias("delivered_at"), "accepted_events")


@register("carrier_stream", f"""
SELECT s.shipment_id, s.tracking_reference, s.supplier_id, coalesce(c.status, 'planned') AS status,
       {_TS.format(c='c.shipped_at')} AS shipped_at, {_TS.format(c='c.delivered_at')} AS delivered_at,
       coalesce(c.accepted_events, 0) AS accepted_events
FROM v_shipments s LEFT JOIN cc_states c USING (shipment_id)
""", ["v_shipments", "cc_states"])
def q_carrier_stream(spark, sf):
    """Carrier JSON -> adapter -> tracking match -> lifecycle, all shipments."""
    ships = views.shipments(spark, sf)
    s = lifecycle.shipment_states(lifecycle.event_verdicts(_events(spark, sf), ships), ships)
    return s.withColumn("shipped_at", utc_iso_micros("shipped_at")).withColumn(
        "delivered_at", utc_iso_micros("delivered_at"))
