"""The jobs as registered queries, and their DuckDB equivalents.

A query runs its job twice into one new folder, so the second run must add nothing, and returns what is there then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscope.operators.staging import scratch_dir
from bandscope.plans import queries as plans
from bandscope.plans.views import EM

from . import activity_store, publish_log


def new_folder(spark: SparkSession, name: str) -> str:
    """A place that no other call has; what is written there stays."""
    return f"{scratch_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of ``events`` with the hour they fall in and what explains them, from the store by day."""
    place = new_folder(spark, "activity")
    for _ in range(2):
        activity_store.run(spark, f"{sf_dir}/events.parquet", f"{place}/store", f"{place}/checkpoint")
    out = activity_store.read_activity(spark, f"{place}/store")
    return out.select("row_id", F.col("day").cast("string").alias("day"), "hour", "pmr_channel", "frequency_hz", F.round("duration_s", 4).alias("duration_s"), "attributed_to_hz", "attribution")


def job2_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event documents of ``documents`` and ``conversations``."""
    place = new_folder(spark, "publish")
    for _ in range(2):
        publish_log.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", f"{place}/events")
    return publish_log.read_events(spark, f"{place}/events")


ACTIVITY_SQL = f"""WITH {EM}, {plans._PAIRS}, {plans._SPLATTER}, {plans._INTERMOD}
SELECT em.row_id, CAST(DATE '1970-01-01' + CAST(floor(timestamp / 86400e0) AS INTEGER) AS VARCHAR)[1:10] AS day, CAST(floor((timestamp % 86400e0) / 3600e0) AS INTEGER) AS hour, pmr_channel, frequency_hz, round(duration_s, 4) AS duration_s,
coalesce(spl.parent_hz, imd.parent_hz) AS attributed_to_hz, CASE WHEN spl.row_id IS NOT NULL THEN 'SPLATTER' WHEN imd.row_id IS NOT NULL THEN 'INTERMOD3' END AS attribution
FROM em LEFT JOIN spl USING (row_id) LEFT JOIN imd USING (row_id)"""


def _escaped(sql: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        sql = f"replace({sql}, '{raw}', '{name}')"
    return sql


PUBLISH_SQL = rf"""WITH t AS (
  SELECT 'note.' || coalesce(CAST(doc_id AS VARCHAR), 'none') AS name, 'notes' AS log, coalesce(nullif(source, ''), 'unknown') AS sender, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'message.' || coalesce(CAST(conv_id AS VARCHAR), 'none') || '.' || coalesce(CAST(turn AS VARCHAR), 'none'), 'messages', coalesce(nullif(role, ''), 'unknown'), coalesce(text, '') FROM conversations),
n AS (SELECT *, CAST(greatest(ceil(length(text) / 10000e0), 1) AS INTEGER) AS parts FROM t),
p AS (SELECT name, log, sender, parts, part, regexp_replace(substring(text, (part - 1) * 10000 + 1, 10000), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g') AS text FROM (SELECT *, CAST(unnest(range(1, parts + 1)) AS INTEGER) AS part FROM n))
SELECT name, log, sender, part, parts, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><event version="2.0" uid="BAND.' || name || '.' || part || '" type="b-t-f" how="h-g-i-g-o" time="2026-08-17T07:00:00.00Z" start="2026-08-17T07:00:00.00Z" stale="2026-08-17T07:05:00.00Z">'
|| '<point lat="0.0000000" lon="0.0000000" hae="0.0" ce="9999999.0" le="9999999.0"/><detail><contact callsign="' || {_escaped("sender")} || '"/><remarks>' || {_escaped("text")} || '</remarks></detail></event>' AS event FROM p"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_activity": job1_activity, "job2_publish": job2_publish}
ORACLE: dict[str, str] = {"job1_activity": ACTIVITY_SQL, "job2_publish": PUBLISH_SQL}
