"""DuckDB oracle SQL for each stand-in query of :mod:`gatewarden.plans.bindings`.

Each statement is written independently of the Spark code, in the most
direct (often brute-force) form of the rule, over the driver's views.
Column names equal the Spark query's.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["crash_loop"] = """
WITH ev AS (
  SELECT user_id AS deployment_id, event_id AS seq, epoch_us(ts) AS ts_us,
         event_type = 'error' AS is_exit,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM events WHERE event_type IN ('error', 'signup')
), ev2 AS (
  SELECT *, coalesce(max(CASE WHEN NOT is_exit THEN pos END) OVER (
            PARTITION BY deployment_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS rpos
  FROM ev
), ex AS (SELECT * FROM ev2 WHERE is_exit),
cnt AS (
  SELECT e.deployment_id, e.seq, e.ts_us, count(*) AS exits_in_window
  FROM ex e JOIN ex x
    ON x.deployment_id = e.deployment_id AND x.pos <= e.pos AND x.pos > e.rpos
   AND x.ts_us > e.ts_us - CAST(240 AS BIGINT) * 3600 * 1000000
  GROUP BY e.deployment_id, e.seq, e.ts_us
)
SELECT deployment_id, seq, ts_us, exits_in_window,
       CASE WHEN exits_in_window > 5 THEN 'crashed' ELSE 'respawn' END AS verdict,
       CAST(CASE WHEN exits_in_window > 5 THEN NULL
            ELSE CAST(least(2.0 * pow(2.0, exits_in_window - 1), 30.0) AS BIGINT) END AS VARCHAR) AS delay_s
FROM cnt
"""

ORACLE["tail_per_source"] = """
SELECT deployment_id, seq, ts_us, newest_rank FROM (
  SELECT user_id AS deployment_id, event_id AS seq, epoch_us(ts) AS ts_us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest_rank
  FROM events) t
WHERE newest_rank <= 50
"""

_LIFECYCLE_EVENTS = """
  SELECT user_id AS deployment_id, ts, event_id AS seq, event_id AS pid,
         CASE event_type WHEN 'click' THEN 'start' WHEN 'error' THEN 'exit'
                         WHEN 'purchase' THEN 'stop' WHEN 'signup' THEN 'restart' END AS event
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup')
"""

ORACLE["lifecycle_state"] = """
WITH ev AS (
  SELECT user_id * 24 + hour(ts) AS deployment_id, ts, event_id AS seq,
         CASE event_type WHEN 'click' THEN CASE WHEN value > 45 THEN 'start_failed' ELSE 'start' END
                         WHEN 'error' THEN CASE WHEN value > 40 THEN 'crashed' ELSE 'exit' END
                         WHEN 'purchase' THEN 'stop' WHEN 'signup' THEN 'restart'
                         ELSE CASE WHEN value < 5 THEN 'running' WHEN value < 10 THEN 'starting' WHEN value < 40 THEN 'stopping' ELSE 'stopped' END END AS event
  FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'
), pos AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, seq) AS p FROM ev
), b AS (
  SELECT e.*,
    (SELECT arg_max(x.event, x.p) FROM pos x WHERE x.deployment_id = e.deployment_id AND x.p < e.p AND x.event NOT IN ('starting', 'stopping')) AS life,
    (SELECT arg_max(x.event, x.p) FROM pos x WHERE x.deployment_id = e.deployment_id AND x.p < e.p AND x.event NOT IN ('exit', 'crashed', 'start_failed')) AS ctl
  FROM pos e
), t AS (
  SELECT *, coalesce(life IN ('start', 'running', 'restart'), false) AS live,
         coalesce(ctl IN ('stop', 'stopping', 'stopped'), false) AS halting FROM b
), st AS (
  SELECT *, CASE WHEN event = 'start' AND live THEN NULL WHEN event IN ('start', 'restart', 'running') THEN 'running'
                 WHEN event IN ('starting', 'stopping', 'crashed') THEN event WHEN event IN ('stop', 'stopped') THEN 'stopped'
                 WHEN event = 'exit' AND halting THEN NULL ELSE 'error' END AS after,
         event = 'restart' OR (event IN ('start', 'running') AND NOT live) AS begins
  FROM t
), a AS (
  SELECT deployment_id, coalesce(arg_max(after, p) FILTER (WHERE after IS NOT NULL), 'stopped') AS state,
         max(p) FILTER (WHERE begins) AS run_p, count(*) FILTER (WHERE event = 'restart') AS restarts
  FROM st GROUP BY deployment_id
)
SELECT a.deployment_id, a.state, CAST(CASE WHEN a.state = 'running' THEN r.seq END AS VARCHAR) AS pid,
       CAST(CASE WHEN a.state = 'running'
            THEN CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(r.ts)) / 1000000) AS BIGINT) END AS VARCHAR) AS uptime_s,
       a.restarts
FROM a LEFT JOIN pos r ON r.deployment_id = a.deployment_id AND r.p = a.run_p
"""

ORACLE["lifecycle_crash_loop"] = f"""
WITH ev AS ({_LIFECYCLE_EVENTS}),
s AS (
  SELECT *,
    last_value(CASE WHEN event = 'stop' THEN 'stop' WHEN event IN ('start', 'restart', 'respawn', 'running') THEN 'go' END
               IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY ts, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctl,
    last_value(CASE WHEN event IN ('start', 'running', 'respawn', 'restart') THEN true
                    WHEN event IN ('stop', 'stopped', 'exit', 'start_failed', 'crashed', 'unready') THEN false END
               IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY ts, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_before
  FROM ev
), f AS (
  SELECT deployment_id, seq, ts, epoch_us(ts) AS ts_us,
         event = 'exit' AND coalesce(ctl, '') <> 'stop' AS is_exit,
         event = 'restart' OR (event = 'start' AND NOT coalesce(live_before, false)) AS is_reset
  FROM s
), g AS (
  SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, seq) AS pos FROM f WHERE is_exit OR is_reset
), g2 AS (
  SELECT *, coalesce(max(CASE WHEN is_reset THEN pos END) OVER (PARTITION BY deployment_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS rpos
  FROM g
), ex AS (SELECT * FROM g2 WHERE is_exit),
cnt AS (
  SELECT e.deployment_id, e.seq, e.ts_us, count(*) AS exits_in_window
  FROM ex e JOIN ex x ON x.deployment_id = e.deployment_id AND x.pos <= e.pos AND x.pos > e.rpos
   AND x.ts_us > e.ts_us - CAST(240 AS BIGINT) * 3600 * 1000000
  GROUP BY e.deployment_id, e.seq, e.ts_us
)
SELECT deployment_id, seq, ts_us, exits_in_window,
       CASE WHEN exits_in_window > 5 THEN 'crashed' ELSE 'respawn' END AS verdict,
       CAST(CASE WHEN exits_in_window > 5 THEN NULL
            ELSE CAST(least(2.0 * pow(2.0, exits_in_window - 1), 30.0) AS BIGINT) END AS VARCHAR) AS delay_s
FROM cnt
"""

_SQUEEZED = f"""
SELECT deployment_id, seq, epoch_us(ts) // 3600 AS t, event FROM ({_LIFECYCLE_EVENTS}) l
UNION ALL SELECT user_id, event_id, epoch_us(ts) // 3600, CASE WHEN value < 10 THEN 'config_unready' ELSE 'config_ready' END
FROM events WHERE event_type = 'view'
"""

ORACLE["respawn_checks"] = f"""
WITH ev AS ({_SQUEEZED}),
s AS (
  SELECT *,
    last_value(CASE WHEN event = 'stop' THEN 'stop' WHEN event IN ('start', 'restart') THEN 'go' END IGNORE NULLS)
      OVER (PARTITION BY deployment_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctl,
    last_value(CASE WHEN event IN ('start', 'restart') THEN true WHEN event IN ('stop', 'exit') THEN false END IGNORE NULLS)
      OVER (PARTITION BY deployment_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_before
  FROM ev
), f AS (
  SELECT deployment_id, seq, t, event = 'exit' AND coalesce(ctl, '') <> 'stop' AS is_exit,
         event = 'restart' OR (event = 'start' AND NOT coalesce(live_before, false)) AS is_reset
  FROM s
), g AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY t, seq) AS pos FROM f WHERE is_exit OR is_reset
), g2 AS (
  SELECT *, coalesce(max(CASE WHEN is_reset THEN pos END) OVER (PARTITION BY deployment_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS rpos FROM g
), ex AS (SELECT * FROM g2 WHERE is_exit),
cnt AS (
  SELECT e.deployment_id, e.seq, e.t, count(*) AS n
  FROM ex e JOIN ex x ON x.deployment_id = e.deployment_id AND x.pos <= e.pos AND x.pos > e.rpos AND x.t > e.t - 240000000
  GROUP BY e.deployment_id, e.seq, e.t
), due AS (SELECT *, t + CAST(least(2.0 * pow(2.0, n - 1), 30.0) AS BIGINT) * 1000000 AS d FROM cnt WHERE n <= 5)
SELECT d.deployment_id, d.seq, d.d AS due_us,
       CASE WHEN arg_max(CASE WHEN e.event = 'stop' THEN 'stop' ELSE 'go' END, (e.t, e.seq)) FILTER (WHERE e.event IN ('stop', 'start', 'restart')) = 'stop' THEN 'cancelled'
            WHEN coalesce(arg_max(e.event IN ('start', 'restart'), (e.t, e.seq)) FILTER (WHERE e.event IN ('stop', 'start', 'restart', 'exit')), false) THEN 'already_running'
            WHEN coalesce(arg_max(e.event, (e.t, e.seq)) FILTER (WHERE e.event IN ('config_ready', 'config_unready')), '') = 'config_unready' THEN 'unready'
            ELSE 'respawn_due' END AS outcome
FROM due d JOIN ev e ON e.deployment_id = d.deployment_id AND e.t <= d.d
GROUP BY d.deployment_id, d.seq, d.d
"""

ORACLE["restart_counts"] = f"""
SELECT deployment_id, count(*) FILTER (WHERE event IN ('restart', 'respawn')) AS restarts
FROM ({_LIFECYCLE_EVENTS}) ev GROUP BY deployment_id
"""

ORACLE["stale_locks"] = f"""
WITH ev AS (SELECT * FROM ({_LIFECYCLE_EVENTS}) e WHERE event IN ('start', 'exit')),
sc AS (
  SELECT *, last_value(CASE WHEN event = 'start' THEN pid END IGNORE NULLS) OVER (
            PARTITION BY deployment_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_pid
  FROM ev
), dead AS (SELECT DISTINCT deployment_id, cur_pid AS pid FROM sc WHERE event = 'exit' AND cur_pid IS NOT NULL)
SELECT l.deployment_id, l.pid, d.pid IS NOT NULL AS stale
FROM (SELECT deployment_id, pid FROM sc WHERE event = 'start') l
LEFT JOIN dead d ON d.deployment_id = l.deployment_id AND d.pid = l.pid
"""

ORACLE["device_flow_outcome"] = """
WITH flows AS (
  SELECT user_id AS flow_id, min(ts) + CASE WHEN user_id % 7 = 0 THEN INTERVAL 900 SECOND ELSE INTERVAL 10 DAY END AS expires_at, 5 AS init
  FROM events GROUP BY user_id
), polls AS (
  SELECT user_id AS flow_id, ts, event_id AS seq, epoch_us(ts) AS t,
         CASE WHEN event_type = 'purchase' THEN 200 ELSE 400 END AS http_status,
         CASE event_type WHEN 'view' THEN 'authorization_pending' WHEN 'click' THEN 'slow_down'
                         WHEN 'error' THEN 'access_denied' END AS error,
         CASE WHEN event_type = 'error' AND value > 25 THEN 'The user denied the request' END AS error_description,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS slow
  FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'
), p2 AS (
  SELECT p.*, f.init, f.expires_at,
         sum(slow) OVER (PARTITION BY p.flow_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k_incl
  FROM polls p JOIN flows f USING (flow_id)
), p3 AS (
  SELECT *,
         CASE WHEN k_incl - slow <= 0 THEN init ELSE least(init + 5 * (k_incl - slow), 30) END AS int_before,
         CASE WHEN k_incl <= 0 THEN init ELSE least(init + 5 * k_incl, 30) END AS int_after
  FROM p2
), allowed AS (
  SELECT * FROM p3 WHERE t - int_before * 1000000 < epoch_us(expires_at)
), term AS (
  SELECT flow_id, arg_min(struct_pack(
           status := CASE WHEN http_status = 200 THEN 'authorized' ELSE 'error' END,
           error := CASE WHEN http_status = 200 THEN NULL
                         ELSE coalesce(nullif(error_description, ''), nullif(error, ''), 'Unknown error') END,
           interval_s := int_before), (t, seq)) AS s
  FROM allowed
  WHERE http_status = 200 OR coalesce(error, '') NOT IN ('authorization_pending', 'slow_down')
  GROUP BY flow_id
), last_int AS (
  SELECT flow_id, arg_max(int_after, (t, seq)) AS li FROM allowed GROUP BY flow_id
)
SELECT f.flow_id,
       coalesce(term.s.status, CASE WHEN TIMESTAMP '2024-01-31 00:00:00' >= f.expires_at THEN 'expired' ELSE 'pending' END) AS status,
       term.s.error AS error,
       CAST(coalesce(term.s.interval_s, last_int.li, f.init) AS BIGINT) AS interval_s
FROM flows f LEFT JOIN term USING (flow_id) LEFT JOIN last_int USING (flow_id)
"""

ORACLE["cleared_locks"] = f"""
WITH ev AS (SELECT * FROM ({_LIFECYCLE_EVENTS}) e WHERE event IN ('start', 'exit')),
n AS (
  SELECT *, lead(event) OVER (PARTITION BY deployment_id ORDER BY ts, seq) AS next_event FROM ev
)
SELECT deployment_id, pid FROM n WHERE event = 'start' AND coalesce(next_event, '') <> 'exit'
"""

from .oracle_fleet import LOG_LINES as _LOG_LINES  # noqa: E402
from .oracle_fleet import ORACLE as _FLEET  # noqa: E402

ORACLE.update(_FLEET)

_TYPED_EVENTS = f"""
SELECT deployment_id, seq, ts, TRY_CAST(regexp_extract(line, 'restarting in (\\d+)s', 1) AS BIGINT) AS delay_s,
  CASE WHEN regexp_matches(line, '^\\[gateway\\] exited \\(code (-?\\d+|None)\\) — supervising restart') THEN 'exit'
       WHEN regexp_matches(line, '^\\[gateway\\] restarting in (\\d+)s \\(attempt (\\d+)\\)') THEN 'respawn_scheduled'
       WHEN regexp_matches(line, '^\\[gateway\\] model=.* \\| provider_key=') THEN 'start' END AS event
FROM ({_LOG_LINES}) l JOIN (SELECT event_id, ts FROM events) e ON e.event_id = l.seq
"""

ORACLE["lifecycle_state_from_logs"] = f"""
WITH raw AS (SELECT deployment_id * 24 + hour(ts) AS deployment_id, seq, ts, delay_s,
    coalesce(event, CASE WHEN (SELECT event_type = 'purchase' AND value <= 100 FROM events v WHERE v.event_id = x.seq) THEN 'start_failed' END) AS event
  FROM ({_TYPED_EVENTS}) x),
p AS (SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, seq) AS p FROM raw WHERE event IS NOT NULL),
m AS (
  SELECT e.*, n.event AS ahead,
    last_value(CASE WHEN e.event = 'respawn_scheduled' THEN epoch_us(e.ts) + e.delay_s * 1000000 WHEN e.event IN ('start', 'exit') THEN -1 END IGNORE NULLS)
      OVER (PARTITION BY e.deployment_id ORDER BY e.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM p e LEFT JOIN p n ON n.deployment_id = e.deployment_id AND n.p = e.p + 1
), k AS (
  SELECT *, event = 'start' AND coalesce(ahead, '') <> 'start_failed' AS begins,
    event = 'start' AND prev >= 0 AND epoch_us(ts) >= prev AS respawned
  FROM m WHERE ts <= TIMESTAMP '2024-01-31 00:00:00' AND event <> 'respawn_scheduled'
), a AS (
  SELECT deployment_id, arg_max(CASE WHEN begins THEN 'running' WHEN event = 'start' THEN 'starting' ELSE 'error' END, p) AS state,
    max(p) FILTER (WHERE begins) AS run_p, count(*) FILTER (WHERE respawned) AS restarts
  FROM k GROUP BY deployment_id
)
SELECT a.deployment_id, a.state, CAST(CASE WHEN a.state = 'running' THEN r.seq END AS VARCHAR) AS pid,
       CAST(CASE WHEN a.state = 'running'
            THEN CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(r.ts)) / 1000000) AS BIGINT) END AS VARCHAR) AS uptime_s,
       a.restarts
FROM a LEFT JOIN p r ON r.deployment_id = a.deployment_id AND r.p = a.run_p
"""

ORACLE["crash_loop_from_logs"] = f"""
WITH t AS (SELECT * FROM ({_TYPED_EVENTS}) x WHERE event IS NOT NULL),
m AS (
  SELECT *, last_value(CASE WHEN event = 'respawn_scheduled' THEN epoch_us(ts) + delay_s * 1000000
                            WHEN event IN ('start', 'exit', 'respawn_cancelled', 'unready') THEN -1 END IGNORE NULLS)
            OVER (PARTITION BY deployment_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM t
), ev AS (
  SELECT deployment_id, seq, ts, CASE WHEN event = 'start' AND prev >= 0 AND epoch_us(ts) >= prev THEN 'respawn' ELSE event END AS event
  FROM m WHERE event <> 'respawn_scheduled'
), s AS (
  SELECT *,
    last_value(CASE WHEN event = 'stop' THEN 'stop' WHEN event IN ('start', 'restart', 'respawn', 'running') THEN 'go' END
               IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY ts, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctl,
    last_value(CASE WHEN event IN ('start', 'running', 'respawn', 'restart') THEN true
                    WHEN event IN ('stop', 'stopped', 'exit', 'start_failed', 'crashed', 'unready') THEN false END
               IGNORE NULLS) OVER (PARTITION BY deployment_id ORDER BY ts, seq
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live_before
  FROM ev
), f AS (
  SELECT deployment_id, seq, ts, epoch_us(ts) AS ts_us,
         event = 'exit' AND coalesce(ctl, '') <> 'stop' AS is_exit,
         event = 'restart' OR (event = 'start' AND NOT coalesce(live_before, false)) AS is_reset
  FROM s
), g AS (
  SELECT *, row_number() OVER (PARTITION BY deployment_id ORDER BY ts, seq) AS pos FROM f WHERE is_exit OR is_reset
), g2 AS (
  SELECT *, coalesce(max(CASE WHEN is_reset THEN pos END) OVER (PARTITION BY deployment_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS rpos
  FROM g
), ex AS (SELECT * FROM g2 WHERE is_exit),
cnt AS (
  SELECT e.deployment_id, e.seq, e.ts_us, count(*) AS exits_in_window
  FROM ex e JOIN ex x ON x.deployment_id = e.deployment_id AND x.pos <= e.pos AND x.pos > e.rpos
   AND x.ts_us > e.ts_us - CAST(240 AS BIGINT) * 3600 * 1000000
  GROUP BY e.deployment_id, e.seq, e.ts_us
)
SELECT deployment_id, seq, ts_us, exits_in_window,
       CASE WHEN exits_in_window > 5 THEN 'crashed' ELSE 'respawn' END AS verdict,
       CAST(CASE WHEN exits_in_window > 5 THEN NULL
            ELSE CAST(least(2.0 * pow(2.0, exits_in_window - 1), 30.0) AS BIGINT) END AS VARCHAR) AS delay_s
FROM cnt
"""

# --- streams: the rows of each processor over all events -----------------------

ORACLE["st1_lifecycle_events"] = ORACLE["extract_lifecycle_events"]

_EXITS = ORACLE["respawn_checks"].split(", due AS (")[0]
ORACLE["st2_crash_alerts"] = f"""
SELECT deployment_id, seq, 'respawn_check' AS kind, outcome AS result, CAST(NULL AS VARCHAR) AS exits FROM ({ORACLE["respawn_checks"]}) r
UNION ALL
SELECT deployment_id, seq, 'exit', CASE WHEN n > 5 THEN 'crashed' ELSE 'respawn' END, CAST(n AS VARCHAR) FROM ({_EXITS} SELECT * FROM cnt) c
"""

ORACLE["st3_pairing"] = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events
), d AS (
  SELECT e.*,
    (SELECT max(r.p) FROM ev r WHERE r.user_id = e.user_id AND r.p < e.p AND r.event_type = 'signup') AS request
  FROM ev e WHERE event_type <> 'signup'
), s AS (
  SELECT d.*, r.value AS asked, r.event_id AS asked_id,
    EXISTS (SELECT 1 FROM ev x WHERE x.user_id = d.user_id AND x.p > d.request AND x.p < d.p
            AND (x.event_type = 'error' OR (x.event_type = 'click' AND r.value >= 20))) AS gone
  FROM d LEFT JOIN ev r ON r.user_id = d.user_id AND r.p = d.request
), o AS (
  SELECT *, CASE WHEN event_type IN ('purchase', 'view') THEN 400 WHEN event_type = 'error' THEN 200
                 WHEN request IS NULL OR gone THEN 404 WHEN asked < 20 THEN 422 ELSE 200 END AS status FROM s
)
SELECT 'outcome' AS kind, event_id AS decision_id, CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS code,
       CAST(status AS BIGINT) AS status, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS user_name FROM o
UNION ALL
SELECT 'approval', event_id, CAST(user_id AS VARCHAR), 200, CAST(user_id AS VARCHAR), 'n' || CAST(asked_id AS VARCHAR)
FROM o WHERE event_type = 'click' AND status = 200
"""

ORACLE["st4_device_flow"] = ORACLE["device_flow_outcome"].replace("TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '2100-01-01 00:00:00'")

_STATE_ALL = ORACLE["lifecycle_state"].replace("FROM events WHERE ts <= TIMESTAMP '2024-01-31 00:00:00'", "FROM events").split("SELECT a.deployment_id, a.state")[0]
ORACLE["st5_status"] = f"""
{_STATE_ALL}
SELECT a.deployment_id, a.state, CAST(CASE WHEN a.state = 'running' THEN r.seq END AS VARCHAR) AS pid,
       CAST(CASE WHEN a.state = 'running' THEN epoch_us(r.ts) END AS VARCHAR) AS run_us, a.restarts
FROM a LEFT JOIN pos r ON r.deployment_id = a.deployment_id AND r.p = a.run_p
"""

_FLAGS = ORACLE["integration_status"].replace("AS configured", "AS configured, c.c_acctbal < 0 AS cleared")
ORACLE["st5_integrations"] = f"""
SELECT deployment_id, kind, name, configured AND NOT cleared AS configured, CASE WHEN configured AND cleared THEN 2 ELSE 1 END AS changes
FROM ({_FLAGS}) f
"""
