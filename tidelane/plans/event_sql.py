"""SQL of the registered queries on events, for DuckDB."""

from __future__ import annotations

# Topic priorities of the registered queries (a part of the default table).
TOPICS = [
    ("sensor/1", 4), ("sensor/temperature", 2), ("sensor/pressure", 2), ("system/errors", 3), ("system/info", 1),
    ("db/error", 4), ("analytics/metrics", 0), ("batch/topic_0", 0), ("audit", 0), ("payment/card", 0),
]

_EVENTS = f"""
base AS (SELECT event_id AS id, epoch_us(ts) AS arrival_us, event_id % 5 AS priority, event_id % 9 AS elapsed_ms, event_id * event_id + 1 AS latency_ns, event_id % 50 AS dedup_id,
  CASE event_type WHEN 'view' THEN ['sensor/temperature', 'sensor/temperature/room1', 'sensor/1'][user_id % 3 + 1]
    WHEN 'error' THEN ['sensor/pressure', 'system/errors', 'db/error'][user_id % 3 + 1]
    WHEN 'purchase' THEN ['payment', 'payment/card'][user_id % 2 + 1] WHEN 'signup' THEN ['audit', 'state/user'][user_id % 2 + 1]
    ELSE ['analytics/metrics', 'batch/topic_0', 'system/info'][user_id % 3 + 1] END AS topic,
  CAST(floor(value) AS BIGINT) % 256 AS raw_reading,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(floor(value * 10000) AS BIGINT) END AS amount,
  CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE 4 END AS BIGINT) AS body_len
  FROM events WHERE event_id IS NOT NULL),
topics(topic, tp) AS (VALUES {", ".join(f"('{t}', {p})" for t, p in TOPICS)}),
ev AS (SELECT b.*, raw_reading AS reading, greatest(priority, coalesce(tp, 2)) AS eff FROM base b LEFT JOIN topics t ON b.topic = t.topic),
routed AS (SELECT *, CASE WHEN eff >= 3 THEN 'REALTIME' WHEN eff >= 1 THEN 'TRANSACTIONAL' ELSE 'BATCH' END AS lane FROM ev),
named AS (SELECT *, CASE WHEN starts_with(topic, 'sensor/temperature') THEN 'SensorTemperatureHandler' WHEN starts_with(topic, 'sensor/pressure') THEN 'SensorPressureHandler'
  WHEN starts_with(topic, 'payment') THEN 'PaymentEventHandler' WHEN starts_with(topic, 'audit') THEN 'AuditEventHandler' ELSE 'DefaultEventHandler' END AS handler,
  CASE lane WHEN 'REALTIME' THEN 'RealtimeProcessor' WHEN 'TRANSACTIONAL' THEN 'TransactionalProcessor' ELSE 'BatchProcessor' END AS processor FROM routed),
checked AS (SELECT *, CASE handler
  WHEN 'SensorTemperatureHandler' THEN CASE WHEN body_len = 0 THEN 'empty body for temperature sensor' WHEN reading > 150 THEN 'temperature out of physical range' END
  WHEN 'SensorPressureHandler' THEN CASE WHEN body_len = 0 THEN 'empty body for pressure sensor' END
  WHEN 'PaymentEventHandler' THEN CASE WHEN body_len < 4 THEN 'payment body too short' WHEN amount = 0 THEN 'payment amount is zero' WHEN amount > 1000000 THEN 'payment amount exceeds limit' END
  WHEN 'AuditEventHandler' THEN CASE WHEN body_len = 0 THEN 'empty audit log body' END
  ELSE CASE WHEN topic = '' THEN 'empty topic' END END AS reason FROM named),
handled AS (SELECT *, CASE WHEN reason IS NULL AND handler = 'SensorTemperatureHandler' THEN CASE WHEN reading > 100 THEN 2 WHEN reading > 80 THEN 1 END
    WHEN reason IS NULL AND handler = 'SensorPressureHandler' THEN CASE WHEN reading > 200 THEN 3 WHEN reading > 150 THEN 1 END END AS alert_level,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN handler = 'SensorTemperatureHandler' AND reading > 80 THEN 'Temperature ' || CASE WHEN reading > 100 THEN 'critical' ELSE 'warning' END || ': ' || reading || 'C'
    WHEN handler = 'SensorPressureHandler' AND reading > 150 THEN 'Pressure ' || CASE WHEN reading > 200 THEN 'emergency' ELSE 'high' END || ': ' || reading || ' bar'
    WHEN handler = 'PaymentEventHandler' THEN 'payment_ok amount=' || amount END AS message FROM checked),
x AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'DROP' WHEN alert_level IS NOT NULL THEN 'ALERT' ELSE 'SUCCESS' END AS outcome FROM handled),
hist AS (SELECT CAST(floor(log2(1)) AS INT) + length(bin(latency_ns)) - 1 AS bucket, count(*) AS cnt FROM x GROUP BY 1)"""


def with_events(query: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_EVENTS}{more}\n{query}"


_ANCHORED = """,
windowable AS (SELECT * FROM x WHERE {where}),
chain(key, n, anchor) AS (
  SELECT topic, CAST(0 AS BIGINT), min(arrival_us) FROM windowable GROUP BY topic
  UNION ALL
  SELECT * FROM (SELECT c.key, c.n + 1, (SELECT min(e.arrival_us) FROM windowable e WHERE e.topic = c.key AND e.arrival_us >= c.anchor + {w}) AS anchor FROM chain c) WHERE anchor IS NOT NULL),
spans AS (SELECT key, n, anchor, lead(anchor) OVER (PARTITION BY key ORDER BY n) AS close FROM chain),
windowed AS (SELECT key, id, arrival_us AS time, n AS "window", close IS NOT NULL AS flushed
  FROM windowable x JOIN spans ON topic = key AND (arrival_us > anchor OR (n = 0 AND arrival_us = anchor)) AND (close IS NULL OR arrival_us <= close))"""
_DEDUP = """,
d AS (SELECT dedup_id AS key, id, arrival_us AS time, {ok} AS ok FROM {source}),
acc(key, t) AS (
  SELECT key, min(time) FROM d WHERE ok GROUP BY key
  UNION ALL
  SELECT * FROM (SELECT a.key, (SELECT min(e.time) FROM d e WHERE e.key = a.key AND e.ok AND e.time > a.t + {ttl}) AS t FROM acc a) WHERE t IS NOT NULL),
told AS (SELECT d.key, d.id, d.time, CASE WHEN EXISTS (SELECT 1 FROM acc a WHERE a.key = d.key AND a.t = d.time) THEN 'processed'
  WHEN EXISTS (SELECT 1 FROM acc a WHERE a.key = d.key AND a.t < d.time AND d.time - a.t <= {ttl}) THEN 'duplicate' ELSE 'failed' END AS status FROM d)"""
HOUR = 3_600_000_000
DAY = 24 * HOUR
#: What becomes of each event, with duplicates by dedup_id within a day, and what follows from that.
_FATES = _DEDUP.format(ok="reason IS NULL", source="x WHERE lane = 'TRANSACTIONAL'", ttl=DAY) + """,
fates AS (SELECT x.*, CASE WHEN lane = 'TRANSACTIONAL' AND t.status = 'duplicate' THEN 'duplicate' WHEN reason IS NOT NULL THEN 'dropped' WHEN lane = 'REALTIME' AND elapsed_ms > 5 THEN 'late' ELSE 'processed' END AS status
  FROM x LEFT JOIN told t ON x.id = t.id),
letters AS (SELECT id, topic, lane, processor, CASE status WHEN 'late' THEN 'sla_breach' ELSE reason END AS reason, arrival_us AS drop_seq FROM fates WHERE status IN ('dropped', 'late')),
metrics AS (SELECT processor AS component, count(*) FILTER (status IN ('processed', 'late')) AS processed, count(*) FILTER (status IN ('dropped', 'late')) AS dropped, CAST(0 AS BIGINT) AS queue_depth,
  max(arrival_us) FILTER (status = 'processed') AS last_event_us FROM fates GROUP BY processor)"""
_COMPONENTS = """SELECT * FROM metrics UNION ALL SELECT 'EventBus', count(*), 0, 0, max(arrival_us) FROM x"""


def _overflow(keep: int, order: str) -> str:
    return with_events(
        f"SELECT id, n <= {keep} AS kept FROM (SELECT id, row_number() OVER (ORDER BY arrival_us {order}, id {order}) AS n FROM x WHERE lane = 'REALTIME')"
    )


def _percentile(p: str) -> str:
    return f"SELECT CAST({p} AS DOUBLE) AS p, CAST(CASE WHEN b = 0 THEN 0 ELSE (1::BIGINT << b) + (1::BIGINT << (b - 1)) END AS BIGINT) AS value FROM (SELECT min(bucket) AS b FROM run WHERE cum > least(floor({p} / 100 * n), n - 1))"


_BUFFERED = _ANCHORED.format(w=HOUR, where="lane = 'BATCH' AND reason IS NULL")


SQL = {
    "lane_counts": with_events("SELECT lane, count(*) AS events FROM x GROUP BY lane"),
    "effective_priority": with_events("SELECT id, topic, CAST(priority AS INT) AS priority, CAST(eff AS INT) AS effective_priority, lane FROM x"),
    "topic_lookup_left": with_events(
        "SELECT b.topic, tp AS table_priority, count(*) AS events FROM base b LEFT JOIN topics t ON b.topic = t.topic GROUP BY ALL"
    ),
    "handler_longest_prefix": with_events("SELECT topic, handler, count(*) AS events FROM x GROUP BY ALL"),
    "validate_reasons": with_events(
        "SELECT handler, reason, count(*) AS events FROM x WHERE reason IS NOT NULL AND reason NOT IN ('temperature out of physical range', 'payment amount is zero', 'payment amount exceeds limit') GROUP BY ALL"
    ),
    "rule_violations": with_events(
        "SELECT handler, reason, count(*) AS events FROM x WHERE reason IN ('temperature out of physical range', 'payment amount is zero', 'payment amount exceeds limit') GROUP BY ALL"
    ),
    "alerts_realtime": with_events(
        "SELECT CAST(alert_level AS INT) AS level, message, topic AS source, id AS event_id FROM x WHERE lane = 'REALTIME' AND alert_level IS NOT NULL UNION ALL SELECT 1, 'SLA breach: ' || elapsed_ms || 'ms > 5ms', topic, id FROM x WHERE lane = 'REALTIME' AND outcome <> 'DROP' AND elapsed_ms > 5"
    ),
    "alerts_suppressed_other_lanes": with_events(
        "SELECT lane, CAST(alert_level AS INT) AS alert_level, count(*) AS events FROM x WHERE lane <> 'REALTIME' AND alert_level IS NOT NULL GROUP BY ALL"
    ),
    "payment_amounts": with_events("SELECT id, amount, message FROM x WHERE handler = 'PaymentEventHandler' AND outcome = 'SUCCESS'"),
    "lane_outcomes": with_events(
        "SELECT lane, handler, outcome, reason, CAST(alert_level AS INT) AS alert_level, count(*) AS events FROM x GROUP BY ALL"
    ),
    "destinations": with_events("""SELECT id, processor, CASE WHEN processor = 'RealtimeProcessor' AND starts_with(topic, 'sensor/pressure') THEN 'emergency-svc' WHEN processor = 'RealtimeProcessor' AND starts_with(topic, 'sensor/temperature') THEN 'monitoring'
      WHEN processor = 'TransactionalProcessor' AND starts_with(topic, 'payment') THEN 'payment-status' WHEN processor = 'TransactionalProcessor' AND starts_with(topic, 'state') THEN 'state-change'
      WHEN processor = 'TransactionalProcessor' AND starts_with(topic, 'audit') THEN 'compliance' WHEN processor = 'BatchProcessor' AND starts_with(topic, 'audit') THEN 'analytics' END AS destination FROM fates WHERE status = 'processed'""", _FATES),
    "subscribe_prefix": with_events(
        "SELECT id, CAST(eff AS INT) AS priority, topic, body_len FROM fates WHERE status = 'processed' AND starts_with(topic, 'sensor/')", _FATES
    ),
    "subscriber_fanout": with_events(
        "SELECT subscriber, id, topic FROM fates JOIN (VALUES ('all', ''), ('pay', 'payment'), ('sense', 'sensor/'), ('temp', 'sensor/temperature')) s(subscriber, prefix) ON starts_with(topic, prefix) WHERE status = 'processed'",
        _FATES
    ),
    "frame_decode": with_events("SELECT id, CAST(priority AS INT) AS priority, topic, body_len AS payload_len FROM x"),
    "frame_errors": with_events(
        "SELECT CASE id % 7 WHEN 1 THEN 'Frame too small: missing length prefix' WHEN 2 THEN 'Frame length mismatch' WHEN 3 THEN 'Frame too small: missing priority or topic_len' WHEN 4 THEN 'Invalid priority value' WHEN 5 THEN 'Frame too small for declared topic length' WHEN 6 THEN 'Topic length cannot be zero' END AS error, count(*) AS frames FROM x GROUP BY 1"
    ),
    "batch_windows_anchored": with_events(
        'SELECT key, "window", count(*) AS events, min(time) AS first_us, max(time) AS last_us, bool_and(flushed) AS flushed FROM windowed GROUP BY key, "window"',
        _BUFFERED
    ),
    "batch_window_flush_counts": with_events(
        'SELECT key, count(DISTINCT "window") AS windows, count(*) AS events FROM windowed WHERE flushed GROUP BY key', _BUFFERED
    ),
    "batch_tail_unflushed": with_events("SELECT key, count(*) AS events FROM windowed WHERE NOT flushed GROUP BY key", _BUFFERED),
    "dedup_no_expiry": with_events("SELECT dedup_id, min(id) AS first_id, count(*) AS events FROM x GROUP BY dedup_id"),
    "dedup_ttl": with_events("SELECT key, id, status FROM told", _DEDUP.format(ok="TRUE", source="x", ttl=6 * HOUR)),
    "dedup_success_only": with_events("SELECT key, id, status FROM told", _DEDUP.format(ok="id % 11 <> 0", source="x", ttl=6 * HOUR)),
    "transactional_status": with_events(
        "SELECT id, status, CASE WHEN status = 'dropped' THEN reason END AS final_reason, CAST(status = 'processed' AS INT) AS attempts FROM fates WHERE lane = 'TRANSACTIONAL'",
        _FATES
    ),
    "dlq_all": with_events("SELECT id, topic, lane, processor, reason, drop_seq FROM letters", _FATES),
    "dlq_last_n": with_events("SELECT id, reason FROM letters ORDER BY drop_seq DESC, id DESC LIMIT 1000", _FATES),
    "dlq_recent": with_events("SELECT id, reason FROM letters ORDER BY drop_seq DESC, id DESC LIMIT 100", _FATES),
    "dlq_stats": with_events(
        "SELECT count(*) AS total, least(count(*), 1000) AS stored, arg_max(reason, drop_seq) AS last_reason, max(drop_seq) AS last_seq FROM letters",
        _FATES
    ),
    "dlq_text": with_events(
        "SELECT '[' || drop_seq // 1000000 || '] DROPPED: id=' || id || ' topic=' || topic || ' lane=' || lane || ' reason=' || reason AS value FROM letters",
        _FATES
    ),
    "overflow_drop_old": _overflow(99, "DESC"),
    "overflow_drop_new": _overflow(100, "ASC"),
    "overflow_block": _overflow(250, "ASC"),
    "pressure_latch": with_events(
        "SELECT id, r AS rank, CASE WHEN eff = 3 AND r > 121 THEN 'TRANSACTIONAL' ELSE lane END AS lane_after, CAST(CASE WHEN r - 1 >= 140 THEN 2 WHEN r - 1 >= 120 THEN 1 ELSE 0 END AS INT) AS pressure FROM (SELECT *, CAST(sum(CASE WHEN eff >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r FROM x) WHERE eff >= 3"
    ),
    "purge_batch_64": with_events("SELECT id, topic FROM x WHERE lane = 'BATCH' ORDER BY arrival_us, id LIMIT 64"),
    "sla_breach": with_events(
        "SELECT id, elapsed_ms, outcome <> 'DROP' AND elapsed_ms > 5 AS breach, outcome <> 'DROP' AND elapsed_ms <= 5 AS stored, CAST(outcome <> 'DROP' AS INT) AS processed, CAST(outcome = 'DROP' OR elapsed_ms > 5 AS INT) AS dropped FROM x WHERE lane = 'REALTIME'"
    ),
    "pause_transactions": with_events("SELECT id, 'dropped' AS status, 'processor_paused' AS final_reason FROM x WHERE lane = 'TRANSACTIONAL'"),
    "drop_batch_mode": with_events("SELECT id, 'backpressure_drop' AS final_reason FROM x WHERE lane = 'BATCH'"),
    "metrics_by_component": with_events("SELECT * FROM metrics", _FATES),
    "drop_rate_percent": with_events(
        "SELECT component, CASE WHEN processed + dropped > 0 THEN dropped * 100 // (processed + dropped) ELSE 0 END AS drop_rate FROM metrics", _FATES
    ),
    "health_status": with_events(
        "SELECT component, CASE WHEN dropped * 100.0 / (processed + dropped) > 2.0 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS health FROM metrics", _FATES
    ),
    "engine_totals_component_sum": with_events(
        f"SELECT CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(queue_depth) AS BIGINT) AS queue_depth FROM ({_COMPONENTS})",
        _FATES
    ),
    "engine_totals_unique": with_events(
        "SELECT CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(queue_depth) AS BIGINT) AS queue_depth FROM metrics",
        _FATES
    ),
    "latency_histogram": with_events("SELECT CAST(bucket AS INT) AS bucket, cnt FROM hist"),
    "latency_percentiles": with_events(
        " UNION ALL ".join(_percentile(p) for p in ("50.0::DOUBLE", "99.0::DOUBLE", "99.9::DOUBLE")),
        ", run AS (SELECT bucket, sum(cnt) OVER (ORDER BY bucket) AS cum, sum(cnt) OVER () AS n FROM hist)"
    ),
    "latency_min_max": with_events(
        "SELECT CASE WHEN min(bucket) > 0 THEN 1::BIGINT << CAST(min(bucket) AS BIGINT) ELSE 0 END AS min_value, (1::BIGINT << CAST(max(bucket) + 1 AS BIGINT)) - 1 AS max_value, CAST(sum(cnt) AS BIGINT) AS total FROM hist"
    ),
    "exact_percentiles": with_events(
        "SELECT lane, CAST(p AS INT) AS p, list_sort(list(latency_ns))[CAST(least(count(*) * p // 100, count(*) - 1) + 1 AS BIGINT)] AS value FROM x, (VALUES (50), (90), (99)) q(p) GROUP BY lane, p"
    ),
    "retry_attempts": with_events(
        "SELECT status, CAST(status = 'processed' AS INT) AS attempts, count(*) AS events FROM fates WHERE lane = 'TRANSACTIONAL' GROUP BY ALL",
        _FATES
    ),
    "producer_union": with_events(
        "SELECT source_type, count(*) AS events, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT CAST(id % 2 AS INT) AS source_type, id FROM x) GROUP BY 1"
    ),
    "priority_enum_names": with_events(
        "SELECT CAST(priority AS INT) AS priority, ['BATCH', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][priority + 1] AS name, CAST(priority AS INT) AS value, count(*) AS events FROM x GROUP BY ALL"
    ),
    "topic_file": "SELECT * FROM (VALUES ('sensor/1', 4), ('a b', 1), ('late', 0)) t(topic, priority)",
    "topic_reload": "SELECT * FROM (VALUES ('sensor/1', 4), ('a b', 3), ('late', 0), ('new', 2)) t(topic, priority)",
    "event_log_round_trip": with_events("SELECT id, arrival_us * 1000 AS ts_ns, CAST(0 AS INT) AS source_type, topic, body_len FROM x"),
    "stored_by_id": with_events("SELECT id, topic, lane FROM x WHERE id = 77"),
    "tumbling_windows": with_events(f'SELECT topic, arrival_us // {HOUR} AS "window", count(*) AS events FROM x GROUP BY ALL'),
    "stream_lane_counts": with_events("SELECT lane, count(*) AS events FROM x GROUP BY lane"),
    "stream_dedup": with_events("SELECT key, id, status FROM told", _DEDUP.format(ok="id % 11 <> 0", source="x", ttl=6 * HOUR)),
    "stream_batch_windows": with_events(
        'SELECT key, "window", count(*) AS events FROM windowed GROUP BY key, "window"', _ANCHORED.format(w=HOUR, where="TRUE")
    ),
    "handler_failures": with_events("""SELECT id, lane, CASE WHEN lane = 'TRANSACTIONAL' AND failed IS NOT NULL THEN 'dropped' WHEN lane = 'REALTIME' AND failed IS NOT NULL THEN 'dropped' WHEN lane = 'BATCH' AND failed IS NOT NULL THEN 'failed_at_flush' WHEN reason IS NOT NULL THEN 'dropped'
        WHEN lane = 'REALTIME' AND elapsed_ms > 5 THEN 'late' ELSE 'processed' END AS status,
      CASE WHEN failed IS NOT NULL THEN CASE lane WHEN 'TRANSACTIONAL' THEN 'max_retries_exceeded' ELSE failed END WHEN reason IS NOT NULL THEN reason WHEN lane = 'REALTIME' AND elapsed_ms > 5 THEN 'sla_breach' END AS letter,
      CAST(reason IS NULL AND (failed IS NULL OR lane = 'BATCH') AS INT) AS processed, CAST(reason IS NOT NULL OR (failed IS NOT NULL AND lane <> 'BATCH') OR (lane = 'REALTIME' AND elapsed_ms > 5) AS INT) AS dropped,
      reason IS NULL AND failed IS NULL AND (lane <> 'REALTIME' OR elapsed_ms <= 5) AS stored, CAST(CASE WHEN reason IS NOT NULL THEN 0 WHEN failed IS NOT NULL AND lane = 'TRANSACTIONAL' THEN 3 ELSE 1 END AS INT) AS attempts FROM refusing""",
      """, refusing AS (SELECT *, CASE WHEN starts_with(topic, 'state') AND id % 7 < 2 THEN 'state refused' WHEN starts_with(topic, 'analytics') AND id % 3 = 0 THEN 'analytics refused' WHEN topic = 'sensor/1' AND id % 4 = 0 THEN 'reading refused' END AS failed FROM x)"""),
    "ingest_counters": with_events(
        "SELECT CASE id % 2 WHEN 0 THEN 'tcp' ELSE 'udp' END AS source, count(DISTINCT id % 20) AS connections, count(*) FILTER (id % 7 IN (0)) AS events, count(*) FILTER (id % 7 <> 0) AS errors, CAST(sum(CASE id % 7 WHEN 0 THEN 7 + strlen(topic) + body_len WHEN 1 THEN 2 WHEN 2 THEN 8 + strlen(topic) + body_len WHEN 3 THEN 6 WHEN 4 THEN 8 WHEN 5 THEN 8 ELSE 8 END) AS BIGINT) AS bytes FROM x GROUP BY 1"
    ),
    "stage_latencies": with_events(
        "SELECT id, 1000 * (id % 7) AS ingest_to_dequeue_ns, id * id + 1 AS dequeue_to_done_ns, 1000 * (id % 7) + id * id + 1 AS total_ns FROM x"
    ),
    "success_latency_histogram": with_events(
        "SELECT CAST(length(bin(latency_ns)) - 1 AS INT) AS bucket, count(*) AS cnt FROM fates WHERE lane = 'TRANSACTIONAL' AND status = 'processed' GROUP BY 1",
        _FATES
    ),
    "dedup_state_size": with_events(
        f"SELECT dedup_id % 8 AS bucket, count(DISTINCT dedup_id) AS ids FROM fates WHERE lane = 'TRANSACTIONAL' AND status = 'processed' AND arrival_us + {DAY} >= (SELECT max(arrival_us) FROM x) GROUP BY 1",
        _FATES
    ),
    "queue_depth_by_lane": with_events(
        "SELECT lane, count(*) FILTER (arrival_us <= now AND arrival_us + elapsed_ms * 1000 > now) AS queue_depth FROM x, (SELECT max(arrival_us) AS now FROM x) GROUP BY lane"
    ),
    "engine_frames": with_events(
        "SELECT topic, count(*) AS events, CAST(sum(body_len) AS BIGINT) AS bytes FROM x WHERE reason IS NULL GROUP BY topic"
    ),
}
