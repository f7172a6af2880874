"""Queries over sessions and steps."""

from __future__ import annotations

from loomgraph.operators import sessions as S
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query

_LAST = """+last AS (
  SELECT session_id, status, command FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, step_id DESC) AS rn FROM steps) WHERE rn = 1)
"""


@query("session_states", with_carriers(_LAST + """
SELECT CASE WHEN l.status IS NULL OR l.status = 'pending' THEN 'in-progress' ELSE l.status END AS state, count(*) AS n
FROM sessions s LEFT JOIN last l ON s.session_id = l.session_id GROUP BY 1""", "sessions", "steps"))
def session_states(spark, sf):
    return S.session_states(carrier(spark, sf, "sessions"), carrier(spark, sf, "steps"))


@query("e1_last_step", with_carriers("""
SELECT step_id, session_id, command, status, started_at, inputs FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, step_id DESC) AS rn FROM steps) WHERE rn = 1""", "steps"))
def e1(spark, sf):
    return S.last_step(carrier(spark, sf, "steps"))


@query("d1_session_stats", with_carriers(_LAST + """
SELECT count(*) AS sessions, count(*) FILTER (l.status = 'complete') AS complete, count(*) FILTER (l.status = 'failed') AS failed,
  count(*) FILTER (l.status = 'interrupted') AS interrupted, count(*) FILTER (l.status IS NULL OR l.status = 'pending') AS in_progress,
  (SELECT count(*) FROM steps) AS steps, (SELECT min(started_at) FROM steps) AS oldest, (SELECT max(started_at) FROM steps) AS newest, (SELECT count(*) FROM components) AS components
FROM sessions s LEFT JOIN last l ON s.session_id = l.session_id""", "sessions", "steps", "components"))
def d1(spark, sf):
    return S.session_stats(carrier(spark, sf, "sessions"), carrier(spark, sf, "steps"), carrier(spark, sf, "components"))


@query("c7_latest_session", with_carriers("""
SELECT session_id FROM steps JOIN sessions USING (session_id) WHERE command = 'apply push' AND status = 'complete' ORDER BY started_at DESC, step_id DESC LIMIT 1""", "sessions", "steps"))
def c7(spark, sf):
    return S.latest_session(carrier(spark, sf, "sessions"), carrier(spark, sf, "steps"), "apply push")


@query("c8_session_list", with_carriers("""
SELECT * FROM (
  SELECT s.session_id, s.name, (SELECT count(*) FROM steps t WHERE t.session_id = s.session_id) AS steps, (SELECT min(started_at) FROM steps t WHERE t.session_id = s.session_id) AS created_at,
    (SELECT command FROM steps t WHERE t.session_id = s.session_id ORDER BY started_at DESC, step_id DESC LIMIT 1) AS last_command,
    (SELECT status FROM steps t WHERE t.session_id = s.session_id ORDER BY started_at DESC, step_id DESC LIMIT 1) AS last_status
  FROM sessions s ORDER BY created_at DESC NULLS LAST, session_id LIMIT 100) WHERE last_status IS DISTINCT FROM 'interrupted'""", "sessions", "steps"))
def c8(spark, sf):
    return S.session_list(carrier(spark, sf, "sessions"), carrier(spark, sf, "steps"), 100)


@query("c27_session_steps", with_carriers("""
SELECT step_id, session_id, command, status, started_at, row_number() OVER (ORDER BY started_at, step_id) AS number, CAST(json_extract_string(inputs, '$.k') AS VARCHAR) AS k
FROM steps WHERE session_id = (SELECT min(session_id) FROM steps)""", "steps"))
def c27(spark, sf):
    steps = carrier(spark, sf, "steps")
    first = steps.agg({"session_id": "min"}).first()[0]
    return S.session_steps(steps, first).selectExpr("step_id", "session_id", "command", "status", "started_at", "number", "inputs['k'] AS k")


@query("e10_interrupt_stale_steps", with_carriers("""
SELECT step_id, session_id, command, CASE WHEN status = 'pending' AND lead(started_at) OVER (PARTITION BY session_id, command ORDER BY started_at, step_id) IS NOT NULL THEN 'interrupted' ELSE status END AS status, started_at, inputs
FROM steps""", "steps"))
def e10(spark, sf):
    return S.interrupt_stale_steps(carrier(spark, sf, "steps"))


@query("b29_prune_sessions", with_carriers(_LAST + """
SELECT s.session_id, s.name, o.created_at, l.status AS last_status,
  coalesce(o.created_at < (SELECT max(started_at) FROM steps) - INTERVAL 14 DAY, false) AND l.status IS NOT DISTINCT FROM 'complete' AS deleted
FROM sessions s LEFT JOIN (SELECT session_id, min(started_at) AS created_at FROM steps GROUP BY 1) o USING (session_id) LEFT JOIN last l USING (session_id)""", "sessions", "steps"))
def b29(spark, sf):
    steps = carrier(spark, sf, "steps")
    return S.prune_sessions(carrier(spark, sf, "sessions"), steps, steps.agg({"started_at": "max"}).first()[0], older_than="2w", status="complete")


@query("k3_command_lifecycle", with_carriers("""
+r AS (SELECT *, sum(CASE WHEN kind = 'invoked' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS run FROM command_events),
e AS (SELECT session_id, run, min(CASE WHEN kind = 'invoked' THEN ts END) AS started_at, arg_min(CASE WHEN exit_code = 130 THEN 'interrupted' ELSE kind END, (ts, event_id)) FILTER (kind IN ('completed', 'failed')) AS kind, min(ts) FILTER (kind IN ('completed', 'failed')) AS ended_at FROM r WHERE run > 0 GROUP BY 1, 2)
SELECT session_id, CAST(run AS BIGINT) AS run, started_at, CASE kind WHEN 'completed' THEN 'ok' WHEN 'failed' THEN 'error' WHEN 'interrupted' THEN 'interrupted' ELSE 'open' END AS outcome, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS seconds FROM e""", "command_events"))
def k3(spark, sf):
    return S.command_lifecycle(carrier(spark, sf, "command_events"))


@query("k4_session_started_once", with_carriers("""
SELECT session_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM command_events WHERE kind = 'started') WHERE rn = 1""", "command_events"))
def k4(spark, sf):
    return S.session_started_once(carrier(spark, sf, "command_events"))
