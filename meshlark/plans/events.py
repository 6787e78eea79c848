"""Registered queries of the streaming extension, over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from . import tables as t


def event_windows(spark, sf):
    w = events.windowed(t.table(spark, sf, "events"), "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def event_sessions(spark, sf):
    s = events.sessions(t.table(spark, sf, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


Q = {"event_windows": event_windows, "event_sessions": event_sessions}
SQL = {
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id",
}
