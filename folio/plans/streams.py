"""Windows over events; the functions work on streams too (see folio.streaming)."""

from __future__ import annotations

from folio.plans.register import query
from folio.sources import tables as t
from folio.streaming import daily as s


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_daily(spark, d):
    return s.daily(t.raw(spark, d, "events"))


@query(
    """SELECT user_id, min(ts) AS begun, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k"""
)
def session_windows(spark, d):
    return s.sessions(t.raw(spark, d, "events"))
