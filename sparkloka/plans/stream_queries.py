"""Streams run over all that is available and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloka.plans.registry import query
from sparkloka.streaming import events as E

_US = lambda c: F.unix_micros(c)


@query("stream_tumbling", "SELECT epoch_us(date_trunc('day', ts)) AS from_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    return E.run(E.tumbling(E.read(s, d)).select(_US("window.start").alias("from_us"), "event_type", "n", "total"), "complete")


@query("stream_sliding", "SELECT epoch_us(w) AS from_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding(s, d):
    return E.run(E.sliding(E.read(s, d)).select(_US("window.start").alias("from_us"), "event_type", "n"), "complete")


@query("stream_session", "SELECT user_id, epoch_us(min(ts)) AS from_us, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, g")
def stream_session(s, d):
    return E.run(E.sessions(E.read(s, d)).select("user_id", _US("session_window.start").alias("from_us"), "n"), "complete")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s, d):
    return E.run(E.dedupe(E.read(s, d), ["user_id", "event_type"]), "append")


@query("stream_decay", "SELECT event_type, count(*) AS n, round(sum(exp(-ln(2) / 30 * (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 8.64e10)), 4) AS weight FROM events GROUP BY 1")
def stream_decay(s, d):
    return E.run(E.decayed(E.read(s, d), "2024-01-31 00:00:00"), "complete")
