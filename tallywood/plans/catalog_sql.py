"""SQL of the stand-in facts and rules, shared by the SQL of several queries."""

from __future__ import annotations

from . import standins as s

_num = lambda x: "NULL" if x is None else f"CAST({x} AS DOUBLE)"
RULES = "rules(concept, abs_limit, rel_limit, window_days) AS (VALUES " + ", ".join(f"('{a}', {_num(b)}, {_num(c)}, {w})" for a, b, c, w, _ in s.RULES) + ")"
FACTS = """facts AS (
  SELECT CASE WHEN user_id % 50 <> 0 THEN user_id END AS subject, event_type AS concept, event_id AS fact_id, CAST(ts AS DATE) AS obs_date, value,
    CASE WHEN value >= 50 THEN 'HIGH' WHEN value >= 10 THEN 'MID' ELSE 'LOW' END AS value_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS document_id, round((event_id % 10) / 10.0, 1) AS confidence
  FROM events)"""
