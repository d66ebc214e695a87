"""Queries over the tables of messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redelivery import split_deliveries
from ..session import table

_TABLES = (("hook_input", "delivery_id"), ("session_metadata", "record_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (
        split_deliveries(table(spark, d, t), key, "session_id", "received_at", name=t)[1].select(
            F.lit(t).alias("source_table"), F.col(key).alias("row_id")
        )
        for t, key in _TABLES
    )
    return one.unionByName(two)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    one, two = (
        split_deliveries(table(spark, d, t), key, "session_id", "received_at", name=t)[0].select(
            F.lit(t).alias("source_table"), F.col(key).alias("row_id"), "session_id", "received_at"
        )
        for t, key in _TABLES
    )
    return one.unionByName(two)


_COPIES = """
WITH every AS (
  SELECT 'hook_input' AS source_table, delivery_id AS row_id, session_id, received_at FROM hook_input
  UNION ALL SELECT 'session_metadata', record_id, session_id, received_at FROM session_metadata
), bare AS (
  SELECT *, regexp_replace(lower(regexp_replace(session_id, '^[\\s{(]+|[\\s})]+$', '', 'g')), '^urn:uuid:', '') AS b FROM every
), named AS (
  SELECT *, CASE WHEN regexp_full_match(regexp_replace(b, '[-{}]', '', 'g'), '[0-9a-f]{32}') THEN regexp_replace(b, '[-{}]', '', 'g')
                 WHEN b <> '' THEN b END AS ident FROM bare
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_table, ident ORDER BY received_at, row_id) AS n FROM named
)
"""

QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept}
SQL = {
    "p2_found": _COPIES + "SELECT source_table, row_id FROM ranked WHERE ident IS NOT NULL AND n > 1",
    "p2_kept": _COPIES + "SELECT source_table, row_id, session_id, received_at FROM ranked WHERE ident IS NULL OR n = 1",
}
