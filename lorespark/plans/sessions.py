"""Queries of problem 3 and of the session operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.operators.sessions import sessionize
from lorespark.session import table


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessionize(table(spark, sf_dir, "messages").select("peer_id", "vk_msg_id", "sent_at"), "peer_id", "sent_at", "vk_msg_id")
    return s.selectExpr("peer_id", "first_id as msg_from", "last_id as msg_to", "cast(unix_micros(started_at) as bigint) as start_us",
                        "cast(unix_micros(ended_at) as bigint) as end_us", "round(duration_s, 3) as duration_s", "n_events as n_messages")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).select("peer_id", "msg_from", "msg_to").distinct()


_SESSIONS = """
WITH once AS (
  SELECT peer_id, vk_msg_id, min(epoch_us(sent_at)) AS us FROM messages
  WHERE peer_id IS NOT NULL AND vk_msg_id IS NOT NULL AND sent_at IS NOT NULL GROUP BY 1, 2),
flagged AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 10800000000 THEN 0 ELSE 1 END AS fresh
  FROM once WINDOW w AS (PARTITION BY peer_id ORDER BY us, vk_msg_id)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY peer_id ORDER BY us, vk_msg_id ROWS UNBOUNDED PRECEDING) AS sid FROM flagged),
sessions AS (
  SELECT peer_id, sid, min(us) AS start_us, max(us) AS end_us, count(*) AS n_messages,
         arg_min(vk_msg_id, (us, vk_msg_id)) AS msg_from, arg_max(vk_msg_id, (us, vk_msg_id)) AS msg_to
  FROM numbered GROUP BY 1, 2)
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions}
SQL = {
    "p3_found": _SESSIONS + "SELECT DISTINCT peer_id, msg_from, msg_to FROM sessions",
    "p3_sessions": _SESSIONS + """SELECT peer_id, msg_from, msg_to, start_us, end_us,
        round((end_us - start_us) / 1e6, 3) AS duration_s, n_messages FROM sessions""",
}
