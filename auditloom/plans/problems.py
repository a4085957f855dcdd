"""Queries of the general data problems over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditloom.operators.deliveries import deletion_vectors, dropped_rows, read_kept
from auditloom.operators.orphans import Source, orphan_counts, orphan_parts, orphan_records, parent_state
from auditloom.session import table


def _references(spark: SparkSession, directory: str) -> tuple[list[Source], DataFrame]:
    sources = [
        Source(name, table(spark, directory, name), record, "audit_id", at)
        for name, record, at in (
            ("audit_findings", "finding_id", "created_at"),
            ("page_scores", "score_id", "calculated_at"),
            ("notification_deliveries", "delivery_id", "created_at"),
        )
    ]
    audits = table(spark, directory, "audits")
    return sources, parent_state(audits, "audit_id", "updated_at", "deleted_at", "loaded_at")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Records whose audit is missing, deleted or was loaded later."""
    return orphan_records(*_references(spark, directory))


def p2_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphan_counts(*orphan_parts(*_references(spark, directory)))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Deliveries to drop."""
    return dropped_rows(table(spark, directory, "audit_messages")).select("delivery_no")


def p3_kept(spark: SparkSession, directory: str) -> DataFrame:
    """The kept deliveries with all columns, read past the deletion vectors."""
    vectors = deletion_vectors(dropped_rows(table(spark, directory, "audit_messages")))
    return read_kept(spark, f"{directory}/audit_messages.parquet", vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_kept": p3_kept,
}

_UUID = "'^(urn:uuid:)?\\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\\}?$'"


def _key(column: str) -> str:
    plain = f"lower(trim({column}))"
    return f"CASE WHEN regexp_matches({plain}, {_UUID}) THEN regexp_replace({plain}, {_UUID}, '\\2\\3\\4\\5\\6') END"


_P2 = f"""
    WITH state AS (
      SELECT {_key('audit_id')} AS key, arg_max(deleted_at IS NOT NULL, updated_at) AS deleted, min(loaded_at) AS first_loaded
      FROM audits WHERE {_key('audit_id')} IS NOT NULL GROUP BY 1),
    refs AS (
      SELECT DISTINCT * FROM (
        SELECT 'audit_findings' AS record_table, finding_id AS record_id, audit_id, created_at AS made FROM audit_findings
        UNION ALL SELECT 'page_scores', score_id, audit_id, calculated_at FROM page_scores
        UNION ALL SELECT 'notification_deliveries', delivery_id, audit_id, created_at FROM notification_deliveries)
      WHERE trim(audit_id) <> ''),
    judged AS (
      SELECT record_table, record_id, coalesce(strftime(made, '%Y-%m'), 'unknown') AS period_month,
        CASE WHEN s.key IS NULL THEN 'missing' WHEN s.deleted THEN 'deleted' WHEN s.first_loaded > r.made THEN 'late' END AS reason
      FROM (SELECT *, {_key('audit_id')} AS key FROM refs) r LEFT JOIN state s ON r.key = s.key)"""

_P3 = """
    WITH named AS (
      SELECT *, coalesce(nullif(lower(trim(msg_id)), ''), 'audit:' || nullif(lower(trim(audit_id)), '') || ':' || CASE subject
          WHEN 'audit.events.crawl_completed' THEN 'crawl_completed'
          WHEN 'audit.events.score.computed' THEN 'score_computed'
          WHEN 'audit.events.report.generated' THEN 'report_generated:v' || json_extract_string(payload, '$.version') END) AS identity
      FROM audit_messages),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY identity ORDER BY received_at, delivery_no) AS place FROM named)"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_P2} SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL",
    "p2_counts": f"""{_P2} SELECT record_table, period_month, reason, count(*) AS orphans
      FROM (SELECT DISTINCT * FROM judged WHERE reason IS NOT NULL) GROUP BY ALL""",
    "p3_found": f"{_P3} SELECT delivery_no FROM placed WHERE place > 1 AND identity IS NOT NULL",
    "p3_kept": f"{_P3} SELECT * EXCLUDE (identity, place) FROM placed WHERE place = 1 OR identity IS NULL",
}
