"""From exported captures to stored events, a ticket and a report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, history, summary
from ..operators.normalize import align, events_from_packets
from ..schemas import EVENT_SCHEMA, TICKET_SCHEMA
from ..session import cut_lineage
from ..sinks import reports, tables
from ..sources import alerts as alert_source
from ..sources import packets, sessions


def enriched_events(events: DataFrame, session_rows: DataFrame | None = None, alert_rows: DataFrame | None = None) -> DataFrame:
    """Events with their session and the alert fields of their first alert.

    The events get a number and are written once, so that the number stays the same when a lost
    task is run again.
    """
    numbered = cut_lineage(events.withColumn("event_id", F.monotonically_increasing_id()), "numbered-events")
    out = numbered if session_rows is None else enrich.match_sessions(numbered, session_rows)
    if alert_rows is not None:
        keyed = cut_lineage(alert_rows.withColumn("alert_key", F.monotonically_increasing_id()), "numbered-alerts")
        out = enrich.attach_alerts(out, enrich.match_alerts(keyed, numbered)).drop("alert_count")
    return align(out.drop("event_id"), EVENT_SCHEMA)


def _history(spark: SparkSession, path: str, ioc_type: str, ioc_value: str) -> DataFrame:
    """Verdicts of the earlier tickets of one indicator; none where there is no ticket table yet."""
    try:
        tickets = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        tickets = spark.createDataFrame([], TICKET_SCHEMA)
    earlier = tickets.filter((F.col("ioc_type") == ioc_type) & (F.col("ioc_value") == ioc_value))
    # Written before the new ticket joins the table.
    return cut_lineage(history.verdict_history(earlier, keys=()), "ticket-history")


def analyze_capture(
    spark: SparkSession, packets_path: str, store_path: str, tickets_path: str, report_path: str,
    sessions_path: str | None = None, alerts_path: str | None = None, alert_year: int | None = None,
    ticket_id: str | None = None, created_at: datetime | None = None,
) -> dict:
    """Ingest one capture, store its events, open a ticket for its main destination and write the report.

    The analysis covers this capture's events, all of them.
    """
    raw = packets.read_packet_fields(spark, packets_path)
    session_rows = sessions.read_sessions(spark, sessions_path) if sessions_path else None
    alert_rows = alert_source.read_alerts(spark, alerts_path, alert_year) if alerts_path else None
    events = cut_lineage(enriched_events(events_from_packets(raw, packets_path), session_rows, alert_rows), "enriched-events")
    inserted = tables.append_events(events, store_path)
    main = summary.primary_indicator(events).first()
    past = None
    if ticket_id is not None:
        at = lambda t: datetime.fromtimestamp(t, timezone.utc) if t is not None else None
        # History first: the new ticket is no evidence for itself.
        past = _history(spark, tickets_path, main.ioc_type, main.ioc_value)
        tables.create_ticket(
            spark, tickets_path, ticket_id=ticket_id, ioc_type=main.ioc_type, ioc_value=main.ioc_value, trigger_type="pcap_analysis",
            created_at=created_at, window_start=at(main.window_start), window_end=at(main.window_end), report_path=report_path)
    reports.export_machine_report(events, report_path, history=past)
    return {"events_inserted": inserted, "primary_indicator": main.ioc_value, "sightings": main.sightings}
