"""Streams in order of event time; a result has the events that the watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ordered as S
from ..streaming.stateful import drained, table_stream
from .inputs import Inputs
from .registry import query


def _events(t: Inputs, kind: str | None = None):
    S.with_state_store(t._spark)
    rows = table_stream(t._spark, t._folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.filter(F.col("event_type") == kind) if kind else rows


#: Events of the stream (an hour of lateness) that the watermark has passed, and its time.
_PASSED = "m AS (SELECT floor(epoch_ms(max(ts)) / 1000.0 - 3600)::BIGINT AS w FROM events {where}), e AS (SELECT user_id AS key, event_id AS id, floor(epoch_us(ts) / 1000000)::BIGINT AS t FROM events, m {where} QUALIFY t <= max(w) OVER ())"


@query("str14_alert_timeline", "WITH RECURSIVE " + _PASSED.format(where="WHERE event_type = 'error'") + """,
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, id) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, id) <= 86400 THEN 0 ELSE 1 END AS new FROM e)),
a AS (SELECT key, g, min(t) AS opened, max(t) + 86400 AS resolved, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT id, key, t FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, id) = 1
  UNION ALL SELECT id, key, t FROM (SELECT e.id, e.key, e.t, row_number() OVER (PARTITION BY e.key ORDER BY e.t, e.id) AS k FROM c JOIN e ON e.key = c.key AND e.t - c.t >= 259200) WHERE k = 1),
r AS (SELECT key, id, g, row_number() OVER (PARTITION BY key, g ORDER BY t, id) AS place FROM g)
SELECT key AS user_id, opened AS at, 'opened' AS what, 1::BIGINT AS n FROM a
UNION ALL SELECT key, resolved, 'resolved', n FROM a, m WHERE resolved <= w
UNION ALL SELECT c.key, c.t, 'paged', r.place FROM c JOIN r USING (key, id)""")
def str14(t: Inputs):
    return drained(S.alert_timeline(_events(t, "error"), "user_id", "ts", "event_id", "1 hour", 86400, 259200), "append", "alerts")


@query("str7_guard_stream", "WITH " + _PASSED.format(where="") + " SELECT key AS user_id, id AS event_id, n, CASE WHEN n > 5 THEN 'block' WHEN n = 5 THEN 'warn' ELSE 'pass' END AS state FROM (SELECT x.key, x.id, count(*) AS n FROM e x JOIN e y ON x.key = y.key AND y.t >= x.t - 86400 AND (y.t, y.id) <= (x.t, x.id) GROUP BY 1, 2)")
def str7(t: Inputs):
    return drained(S.guarded(_events(t), "user_id", "ts", "event_id", "1 hour", 86400, 5), "append", "guard")


@query("str6_limited_stream")
def str6(t: Inputs):
    return drained(S.limited(_events(t), "user_id", "ts", "event_id", "1 hour", 3, 86400), "append", "limited")
