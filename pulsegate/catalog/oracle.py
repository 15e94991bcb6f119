"""SQL oracles, written independently of the Spark forms: self-joins, correlated
subqueries and recursion in place of windows, buckets, pointers and folds."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

CDP = """
cdp AS (
  SELECT event_id, user_id, 'ID_' || user_id AS customer_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'A' ELSE 'B' END AS source,
         ts, epoch_us(ts) AS us, event_type,
         CAST(round(value * 100) AS BIGINT) AS amount_cents,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (['IOS', 'ANDROID', 'DESKTOP', 'TABLET'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS device_type,
         (['MOBILE_APP', 'WEB', 'ATM', 'BRANCH', 'CALL_CENTER'])[event_id % 5 + 1] AS login_channel,
         user_id || '_' || strftime(ts, '%Y%m%d') AS session_id
  FROM events
)"""
PROFILE = """
profile AS (
  SELECT 'ID_' || c_custkey AS customer_id, c_mktsegment AS customer_segment,
         CAST(round(c_acctbal * 100) AS BIGINT) AS acctbal_cents, c_nationkey AS nation
  FROM customer
)"""
H = 3_600_000_000


def oracle(name: str, body: str, *ctes: str) -> None:
    parts = [CDP, *ctes]
    ORACLES[name] = "WITH " + ("RECURSIVE " if "RECURSIVE" in body else "") + ",".join(parts) + body.replace("RECURSIVE", "")


# ---- rules --------------------------------------------------------------------------

def window(alias: str, agg: str, keep: str, duration: int, slide: int, value: str = "b.amount_cents") -> str:
    """Per event: aggregate over earlier rows of the customer inside the window's cells."""
    inner = "count(*)" if agg == "count" else f"{agg}({value})"
    return f"""
{alias} AS (
  SELECT e.event_id, {inner} FILTER (WHERE b.event_id IS NOT NULL AND ({keep})) AS v
  FROM cdp e LEFT JOIN cdp b ON b.user_id = e.user_id
    AND (b.us < e.us OR (b.us = e.us AND b.event_id < e.event_id))
    AND b.us // {slide} > e.us // {slide} - {duration // slide} AND b.us // {slide} <= e.us // {slide}
  GROUP BY e.event_id
)"""


# Latest value of a source's column at every event, the event included.
def latest(alias: str, source: str, columns: list[str]) -> str:
    picks = ", ".join(f"arg_max(b.{c}, (b.us, b.event_id)) AS {c}" for c in columns)
    return f"""
{alias} AS (
  SELECT e.event_id, {picks}
  FROM cdp e LEFT JOIN cdp b ON b.user_id = e.user_id AND b.source = '{source}'
    AND (b.us < e.us OR (b.us = e.us AND b.event_id <= e.event_id))
  GROUP BY e.event_id
)"""


RULE_CTES = [
    PROFILE,
    latest("la", "A", ["amount_cents", "k", "device_type"]),
    latest("lb", "B", ["event_type", "amount_cents", "k", "device_type", "login_channel", "session_id", "us"]),
    window("w1", "sum", "b.source = 'A' AND b.event_type <> 'error'", 24 * H, 6 * H),
    window("w3", "count", "b.source = 'B' AND b.event_type IN ('click', 'view')", 12 * H, 12 * H),
    window("w7a", "avg", "b.source = 'B' AND b.device_type <> 'TABLET'", 48 * H, 12 * H),
    window("w7b", "max", "b.source = 'B' AND b.device_type <> 'TABLET'", 24 * H, 6 * H),
    window("w11", "min", "b.source = 'A' AND b.login_channel <> 'ATM'", 24 * H, 6 * H, "b.amount_cents * CAST(0.5 AS DOUBLE) + b.k * CAST(0.5 AS DOUBLE)"),
    """
follows AS (
  SELECT a.event_id FROM cdp a WHERE a.source = 'B' AND a.event_type = 'view' AND EXISTS (
    SELECT 1 FROM cdp b WHERE b.session_id = a.session_id AND b.source = 'B' AND b.event_type = 'click'
      AND (b.us > a.us OR (b.us = a.us AND b.event_id > a.event_id)) AND b.us < a.us + 86400000000)
)""",
    """
ranked AS (
  SELECT event_id, session_id || '|' || event_type AS key, us,
         row_number() OVER (PARTITION BY session_id, event_type ORDER BY us, event_id) AS rn FROM cdp
),
fold AS (
  SELECT key, rn, us AS kept, event_id, true AS ok FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.key, r.rn, CASE WHEN r.us >= f.kept + 43200000000 THEN r.us ELSE f.kept END, r.event_id, r.us >= f.kept + 43200000000
  FROM fold f JOIN ranked r ON r.key = f.key AND r.rn = f.rn + 1
),
firsts AS (SELECT event_id FROM fold WHERE ok)""",
    """
risky AS (SELECT DISTINCT device_type, login_channel, k FROM cdp WHERE k % 7 = 0)""",
    """
judging AS (
  SELECT e.*, p.customer_segment, p.acctbal_cents,
    la.amount_cents AS a_amount, la.k AS a_k, la.device_type AS a_device,
    lb.event_type AS b_type, lb.amount_cents AS b_amount, lb.k AS b_k, lb.device_type AS b_device,
    lb.login_channel AS b_channel, lb.session_id AS b_session, lb.us - lb.k * 3600000000 AS b_login,
    w1.v AS w1, w3.v AS w3, w7a.v AS w7a, w7b.v AS w7b, w11.v AS w11,
    follows.event_id IS NOT NULL AS follows, firsts.event_id IS NOT NULL AS first_seen, risky.k IS NOT NULL AS risky
  FROM cdp e JOIN profile p USING (customer_id) JOIN la USING (event_id) JOIN lb USING (event_id)
    JOIN w1 USING (event_id) JOIN w3 USING (event_id) JOIN w7a USING (event_id) JOIN w7b USING (event_id) JOIN w11 USING (event_id)
    LEFT JOIN follows USING (event_id) LEFT JOIN firsts USING (event_id)
    LEFT JOIN risky ON risky.device_type = e.device_type AND risky.login_channel = e.login_channel AND risky.k = e.k
)""",
]

# Rule -> (per source: groups of (path, test)), leaves of the tree (path, test), tree.
RULES = {
    "R01": ({"A": [[("trigger.0.0.0", "event_type = 'purchase'")]]},
            [("tree.0", "w1 > 10000"), ("tree.1", "acctbal_cents >= 0")], "{0} AND {1}"),
    "R02": ({"B": [[("trigger.0.0.0", "device_type = 'TABLET'"), ("trigger.0.0.1", "k BETWEEN 10 AND 60")], [("trigger.0.1.0", "login_channel = 'ATM'")]]},
            [("tree.0", "b_type IN ('click', 'view')"), ("tree.1", "b_amount > 3000")], "{0} OR {1}"),
    "R03": ({"A": [], "B": []}, [("tree", "w3 >= 1")], "{0}"),
    "R04": ({"A": [[("trigger.0.0.0", "device_type IN ('IOS', 'ANDROID')")]]},
            [("tree.0", "a_amount * CAST(0.65 AS DOUBLE) + a_k * CAST(0.35 AS DOUBLE) >= 1000.0"),
             ("tree.1.0", "customer_segment NOT IN ('MACHINERY', 'FURNITURE')"), ("tree.1.1", "a_amount > 5000")], "{0} AND ({1} OR {2})"),
    "R05": ({"B": [[("trigger.0.0.0", "starts_with(login_channel, 'W')")]]},
            [("tree", "b_login BETWEEN epoch_us(TIMESTAMP '2024-01-04 17:00:00') AND epoch_us(TIMESTAMP '2024-01-19 17:00:00')")], "{0}"),
    "R06": ({"A": [], "B": [[("trigger.1.0.0", "event_type = 'error'")]]},
            [("tree.0", "a_k % 10 IN (1, 3, 5, 7)"), ("tree.1", "a_amount / CAST(2 AS DOUBLE) > a_k * 20")], "{0} AND {1}"),
    "R07": ({"B": [[("trigger.0.0.0", "k < 50")]]}, [("tree.0", "w7a <= 2500.0"), ("tree.1", "w7b > 9000")], "{0} OR {1}"),
    "R08": ({"B": [[("trigger.0.0.0", "event_type = 'view'")]]}, [("tree", "event_type = 'view' AND NOT follows")], "{0}"),
    "R09": ({"A": [], "B": []}, [("tree", "first_seen")], "{0}"),
    "R10": ({"B": [[("trigger.0.0.0", "risky")]]}, [("tree", "b_type IS NOT NULL")], "{0}"),
    "R11": ({"A": [[("trigger.0.0.0", "event_type <> 'signup'")]]}, [("tree.0", "a_device <> b_device"), ("tree.1", "w11 < 900.0")], "{0} AND {1}"),
    "R12": ({"B": [[("trigger.0.0.0", "length(login_channel) > 4")]]},
            [("tree.0", "contains(b_session, '_202401')"), ("tree.1", "NOT ends_with(b_channel, 'R')"), ("tree.2", "b_k NOT IN (1, 2, 3)")], "{0} AND {1} AND {2}"),
}


def _verdict(rule: str) -> str:
    triggers, leaves, tree = RULES[rule]
    safe = lambda test: f"coalesce({test}, false)"
    fired, failures = [], []
    for source, groups in triggers.items():
        dnf = " OR ".join("(" + " AND ".join(safe(t) for _, t in g) + ")" for g in groups) or "true"
        fired.append(f"(source = '{source}' AND ({dnf}))")
        failures += [f"CASE WHEN source = '{source}' AND NOT {safe(t)} THEN '{p}' END" for g in groups for p, t in g]
    whole = tree.format(*[safe(t) for _, t in leaves])
    tree_failures = ", ".join(f"CASE WHEN NOT {safe(t)} THEN '{p}' END" for p, t in leaves)
    trigger_failures = f"concat_ws(',', {', '.join(failures)})" if failures else "'trigger'"
    sources = ", ".join(f"'{s}'" for s in triggers)
    return f"""
SELECT event_id, customer_id, source, ts, us, event_type, amount_cents, device_type, '{rule}' AS rule_id, CAST(1 AS BIGINT) AS rule_version,
  CASE WHEN ({" OR ".join(fired)}) AND ({whole}) THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN NOT ({" OR ".join(fired)}) THEN {trigger_failures} WHEN NOT ({whole}) THEN concat_ws(',', {tree_failures}) END AS failed_condition
FROM judging WHERE source IN ({sources})"""


def judged(*rules: str) -> list[str]:
    return [*RULE_CTES, "\njudged AS (" + "\nUNION ALL".join(_verdict(r) for r in rules) + ")"]


AUDIT = " SELECT event_id, customer_id, rule_id, rule_version, status, failed_condition FROM judged RECURSIVE"
oracle("flagship", AUDIT, *judged("R01"))
oracle("rule_audit", AUDIT, *judged(*RULES))
oracle("rule_audit_flat", " SELECT event_id, customer_id, rule_id, status, failed_condition, event_type, amount_cents, device_type FROM judged RECURSIVE", *judged("R02", "R05"))
oracle("audit_flat_shared", """ SELECT c.event_id AS row_id, c.event_id - c.event_id % 4 AS event_id, rule_id, status, c.event_type
FROM judged j JOIN cdp c ON c.event_id = j.event_id RECURSIVE""", *judged("R02", "R05"))
oracle("rules_in_force", f""" SELECT event_id, 'F1' AS rule_id, CASE WHEN device_type = 'TABLET' AND amount_cents > 3000 THEN 'PASS' ELSE 'FAIL' END AS status FROM cdp
WHERE source = 'B' AND us + (event_id % 5) * {H} >= epoch_us(TIMESTAMP '2024-01-08 00:00:00') AND us + (event_id % 5) * {H} < epoch_us(TIMESTAMP '2024-01-20 12:00:00')""")
oracle("segments", " SELECT rule_id, count(DISTINCT customer_id) AS customers FROM judged WHERE status = 'PASS' GROUP BY rule_id RECURSIVE", *judged("R02", "R04", "R05", "R12"))
oracle("trigger_dnf", """ SELECT rule_id, source, count(*) FILTER (WHERE NOT coalesce(failed_condition LIKE 'trigger%', false)) AS fired, count(*) AS routed
FROM judged GROUP BY rule_id, source RECURSIVE""", *judged("R02", "R04", "R06", "R12"))

_CASES = {
    "int_eq": "k = 7", "int_ne": "k <> 7", "int_gt": "k > 50", "int_lt": "k < 50", "int_ge": "k >= 50", "int_le": "k <= 50",
    "int_between": "k BETWEEN 10.5 AND 20", "int_in": "k IN (1, 2, 3)", "int_not_in": "k NOT IN (1, 2, 3)", "long_between": "amount_cents BETWEEN 1000 AND 2000",
    "text_eq": "d = 'IOS'", "text_ne": "d <> 'IOS'", "text_in": "d IN ('IOS', 'TABLET')", "text_not_in": "d NOT IN ('IOS', 'TABLET')",
    "starts": "d LIKE 'TAB%'", "not_starts": "d NOT LIKE 'TAB%'", "ends": "d LIKE '%OID'", "not_ends": "d NOT LIKE '%OID'",
    "contains": "d LIKE '%KT%'", "not_contains": "d NOT LIKE '%KT%'", "is_null": "d IS NULL", "is_not_null": "d IS NOT NULL", "length_gt": "length(d) > 3",
    "bool_eq": "amount_cents > 5000", "bool_ne": "NOT (amount_cents > 5000)", "time_gt": "ts > TIMESTAMP '2024-01-10 00:00:00'",
    "time_between": "ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'", "field_field": "amount_cents > k * 50",
}
oracle("pred_matrix", " " + " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER (WHERE {t}) AS matching FROM x" for n, t in _CASES.items()),
       "\nx AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN device_type END AS d FROM cdp)")
oracle("expr_rules", """ SELECT event_id,
  amount_cents * CAST(0.65 AS DOUBLE) + k * CAST(0.35 AS DOUBLE) >= 1000.0 AS linear, k % 10 IN (1, 3, 5) AS modulo,
  coalesce(CASE WHEN k <> 0 THEN CAST(amount_cents AS DOUBLE) / k > 100.0 END, false) AS ratio,
  amount_cents - k * 20 < k * 3 + 100 AS both_sides, CAST(amount_cents + k AS DOUBLE) / 2 BETWEEN 500.0 AND 3000.0 AS within
FROM cdp""")

# ---- windows and profile ------------------------------------------------------------


def _windows(duration: int, slide: int) -> str:
    return f""" SELECT e.event_id,
  CAST(sum(b.amount_cents) FILTER (WHERE b.event_type <> 'error') AS BIGINT) AS w_sum,
  count(*) FILTER (WHERE b.event_type <> 'error') AS w_count,
  CAST(CAST(sum(b.amount_cents) FILTER (WHERE b.event_type <> 'error') AS BIGINT) AS DOUBLE) / nullif(count(*) FILTER (WHERE b.event_type <> 'error'), 0) AS w_avg,
  min(b.amount_cents) FILTER (WHERE b.event_type <> 'error') AS w_min,
  max(b.amount_cents) FILTER (WHERE b.event_type <> 'error') AS w_max,
  CAST(sum(b.amount_cents + b.k) FILTER (WHERE b.device_type = 'IOS') AS BIGINT) AS w_expr,
  coalesce(sum(b.amount_cents) FILTER (WHERE b.event_type <> 'error') > 10000, false) AS over_threshold
FROM cdp e LEFT JOIN cdp b ON b.user_id = e.user_id AND (b.us < e.us OR (b.us = e.us AND b.event_id < e.event_id))
  AND b.us // {slide} > e.us // {slide} - {duration // slide} AND b.us // {slide} <= e.us // {slide}
GROUP BY e.event_id"""


oracle("win_tumbling", _windows(12 * H, 12 * H))
oracle("win_sliding", _windows(24 * H, 6 * H))
_WIDTHS = {"h6": (6 * H, H // 4), "h24": (24 * H, 6 * H), "h48": (48 * H, 6 * H), "d2": (48 * H, 48 * H)}
oracle("win_shared", " SELECT e.event_id, " + ", ".join(
    f"CAST(sum(b.amount_cents) FILTER (WHERE b.source = 'B' AND b.us // {s} > e.us // {s} - {d // s} AND b.us // {s} <= e.us // {s}) AS BIGINT) AS {n}"
    for n, (d, s) in _WIDTHS.items()) + """
FROM cdp e LEFT JOIN cdp b ON b.user_id = e.user_id AND (b.us < e.us OR (b.us = e.us AND b.event_id < e.event_id)) GROUP BY e.event_id""")
GENERAL = """
gen AS (
  SELECT event_id, customer_id, us, 'EVT' AS source, event_type AS trans_type, amount_cents AS total_spend, device_type AS device FROM cdp
  UNION ALL
  SELECT o_orderkey + 1000000000, 'ID_' || o_custkey, epoch_us(o_orderdate), 'ORD', o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT), NULL FROM orders
)"""
oracle("general_metric", f""" SELECT e.event_id, e.source, CAST(sum(b.total_spend) AS BIGINT) AS spend
FROM gen e LEFT JOIN gen b ON b.customer_id = e.customer_id AND (b.us < e.us OR (b.us = e.us AND b.event_id < e.event_id))
  AND b.us // {12 * H} > e.us // {12 * H} - 4 GROUP BY e.event_id, e.source""", GENERAL)
oracle("general_schema", """ SELECT source, trans_type, count(*) AS n, CAST(sum(total_spend) AS BIGINT) AS spend, count(device) AS with_device
FROM gen GROUP BY source, trans_type""", GENERAL)
oracle("mapped_events", " SELECT event_id, amount_cents AS trans_amount, login_channel AS channel FROM cdp")
oracle("pane_table", f""" SELECT customer_id, (us // {12 * H} - i) * {12 * H} AS pane_start, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total, max(amount_cents) AS top
FROM cdp, (VALUES (0), (1)) AS s(i) GROUP BY ALL""")
oracle("profile_latest", """ SELECT customer_id, arg_max(device_type, (us, event_id)) AS device_type, arg_max(login_channel, (us, event_id)) AS login_channel,
  arg_max(amount_cents, (us, event_id)) AS amount_cents FROM cdp GROUP BY customer_id""")
oracle("profile_asof", " SELECT e.event_id, la.device_type AS a_device, lb.amount_cents AS b_amount, customer_segment AS segment FROM cdp e JOIN la USING (event_id) JOIN lb USING (event_id) JOIN profile USING (customer_id)",
       PROFILE, latest("la", "A", ["device_type"]), latest("lb", "B", ["amount_cents"]))
oracle("batch_refresh", """ SELECT p.customer_id, d.device_type, p.customer_segment, p.nation, o.orders FROM profile p
LEFT JOIN (SELECT customer_id, arg_max(device_type, (us, event_id)) AS device_type FROM cdp GROUP BY 1) d USING (customer_id)
LEFT JOIN (SELECT 'ID_' || o_custkey AS customer_id, count(*) AS orders FROM orders GROUP BY 1) o USING (customer_id)""", PROFILE)

# ---- ingest -------------------------------------------------------------------------

MESSAGES = """
msg AS (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN (event_id // 50) % 6 ELSE -1 END AS br, event_id % 97 = 13 AS no_source FROM cdp
),
outcome AS (
  SELECT *, CASE WHEN br = 4 THEN 'corrupted_payload' WHEN no_source THEN 'missing_source' WHEN br = 3 THEN 'schema_missing'
    WHEN br IN (0, 1, 2) THEN 'corrupted_payload' END AS reason FROM msg
)"""
oracle("ingest_valid", """ SELECT event_id AS "offset", 'data-' || event_id % 4 || '-' || event_id AS event_id, customer_id, source, 'v2' AS schema_version, us AS event_us, event_type,
  CASE WHEN br = 5 THEN 0 ELSE amount_cents END AS amount_cents, device_type, CAST(k AS BIGINT) AS k, CAST(5 AS BIGINT) AS n_fields
FROM outcome WHERE reason IS NULL""", MESSAGES)
oracle("ingest_dlq", """ SELECT event_id AS "offset", reason AS reject_reason FROM outcome WHERE reason IS NOT NULL""", MESSAGES)
oracle("ingest_strict", " SELECT coalesce(reason, CASE WHEN br = 5 THEN 'corrupted_payload' ELSE 'valid' END) AS outcome, count(*) AS messages FROM outcome GROUP BY 1", MESSAGES)
oracle("undeclared_fields", """ SELECT event_id AS "offset", 'note' AS path, 'x' || k AS value FROM outcome WHERE reason IS NULL""", MESSAGES)
oracle("event_wide", """ SELECT event_id AS "offset", event_type, CASE WHEN br = 5 THEN 0 ELSE amount_cents END AS amount_cents, device_type, k
FROM outcome WHERE reason IS NULL AND source = 'A'""", MESSAGES)
oracle("key_format", """ SELECT source, count(*) FILTER (WHERE event_id % 4 = 0) AS accepted, count(*) FILTER (WHERE event_id % 4 <> 0) AS rejected FROM cdp GROUP BY source""")
oracle("late_events", """ SELECT event_id, w AS watermark_us, coalesce(t < w, false) AS is_late FROM (
  SELECT a.event_id, a.t, (SELECT max(b.t) FROM arr b WHERE b.p = a.p AND b.event_id < a.event_id) - 10000000 AS w FROM arr a)""",
       "\narr AS (SELECT event_id, event_id % 4 AS p, us - CASE WHEN event_id % 20 = 0 THEN 1800000000 ELSE 0 END AS t FROM cdp)")
CHECKED = """
chk AS (
  SELECT event_id, event_id % 13 <> 0 AS known, event_id % 11 = 0 AS no_time, device_type, event_id % 7 = 0 AS word,
         event_id % 17 = 0 AS no_k, k, (SELECT CAST(max(n_nationkey) * 4 AS DOUBLE) FROM nation) AS high, source FROM cdp
),
err AS (
  SELECT event_id, 'REQUIRED:event_time' AS e FROM chk WHERE no_time
  UNION ALL SELECT event_id, 'SCHEMA:v9:' || source FROM chk WHERE NOT known
  UNION ALL SELECT event_id, 'ENUM:device_type' FROM chk WHERE known AND device_type NOT IN ('IOS', 'ANDROID', 'DESKTOP')
  UNION ALL SELECT event_id, 'TYPE:k' FROM chk WHERE known AND word
  UNION ALL SELECT event_id, 'MISSING:k' FROM chk WHERE known AND NOT word AND no_k
  UNION ALL SELECT event_id, 'RANGE:k' FROM chk WHERE known AND NOT word AND NOT no_k AND NOT k BETWEEN 5 AND high
  UNION ALL SELECT event_id, 'RANGE:half' FROM chk WHERE known AND NOT k / CAST(2 AS DOUBLE) BETWEEN 0 AND high
  UNION ALL SELECT event_id, 'INTEGER:half' FROM chk WHERE known AND k % 2 = 1
)"""
oracle("validation_errors", " SELECT event_id, string_agg(e, ';' ORDER BY e) AS errors FROM err GROUP BY event_id", CHECKED)
oracle("validation_summary", """ SELECT count(*) AS total, count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM err)) AS valid,
  count(*) FILTER (WHERE event_id IN (SELECT event_id FROM err)) AS invalid FROM chk""", CHECKED)

# ---- schemas ------------------------------------------------------------------------

SCHEMAS = """
sm AS (SELECT p_partkey AS "offset", p_brand AS source, p_type AS version, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         CASE WHEN p_partkey % 2 = 0 THEN 'INT' ELSE 'STRING' END AS type FROM part),
newest AS (SELECT * FROM sm a WHERE p_size % 10 <> 0 AND NOT EXISTS (
  SELECT 1 FROM sm b WHERE b.source = a.source AND b.version = a.version AND b.p_size % 10 <> 0 AND b."offset" > a."offset")),
cols AS (
  SELECT source, version, 'metadata.customer_id' AS key_field, p_size AS total_fields, w1 || '.' || w2 AS path, type, 'dynamic_numeric' AS category FROM newest
  UNION ALL SELECT source, version, 'metadata.customer_id', p_size, 'size_' || p_size, 'LONG', 'static_numeric' FROM newest)"""
oracle("schema_messages_parsed", """ SELECT "offset", source, version, 'metadata.customer_id' AS key_field, p_size AS total_fields, CAST(2 AS INTEGER) AS n_columns, p_size % 10 <> 0 AS valid FROM sm""", SCHEMAS)
oracle("schema_columns", " SELECT * FROM cols", SCHEMAS)
oracle("schema_publish", " SELECT * FROM cols", SCHEMAS)
oracle("schema_search", " SELECT path, type FROM cols WHERE source = 'Brand#1' AND version = 'ECONOMY' AND category = 'dynamic_numeric'", SCHEMAS)

# ---- rule tables --------------------------------------------------------------------

MANY = """
r AS (SELECT p_partkey AS p, p_size AS s, (['IOS', 'ANDROID', 'DESKTOP', 'TABLET'])[p_partkey % 4 + 1] AS dev,
        (['MOBILE_APP', 'WEB', 'ATM', 'BRANCH', 'CALL_CENTER'])[p_partkey % 5 + 1] AS c0,
        (['MOBILE_APP', 'WEB', 'ATM', 'BRANCH', 'CALL_CENTER'])[(p_partkey + 2) % 5 + 1] AS c1, p_partkey % 50 = 0 AS empty FROM part),
preds AS (
  SELECT p, '0.0' AS g, 0 AS i, 'device_type' AS field, '==' AS op, dev AS value FROM r WHERE NOT empty
  UNION ALL SELECT p, '0.0', 1, 'login_channel', 'IN', '["' || c0 || '", "' || c1 || '"]' FROM r WHERE NOT empty
  UNION ALL SELECT p, '0.0', 2, 'k', 'BETWEEN', '[' || s || ', ' || (s + 20) || ']' FROM r WHERE NOT empty AND p % 2 = 1
  UNION ALL SELECT p, '0.1', 0, 'k', '==', CAST(p % 100 AS VARCHAR) FROM r WHERE NOT empty AND p % 3 = 0
  UNION ALL SELECT p, '0.1', 1, 'event_type', '==', 'view' FROM r WHERE NOT empty AND p % 3 = 0),
idx AS (
  SELECT p, g, i, field, value FROM preds WHERE op = '=='
  UNION ALL SELECT p, '0.0', 1, 'login_channel', unnest([c0, c1]) FROM r WHERE NOT empty),
complex AS (SELECT p FROM r WHERE empty OR p % 2 = 1)"""
oracle("rule_leaves", """ SELECT 'P' || p AS rule_id, 'trigger' AS part, 'B' AS source, 'v2' AS version, 'trigger.' || g || '.' || i AS node_path, g AS group_id, i AS pred_id, 'condition' AS kind, field, op, value FROM preds
UNION ALL SELECT 'P' || p, 'trigger', 'B', 'v2', 'trigger.0', '0.0', 0, 'always', NULL, NULL, NULL FROM r WHERE empty
UNION ALL SELECT 'P' || p, 'tree', NULL, NULL, 'tree', NULL, NULL, 'condition', 'B.v2.amount_cents', '>', '0' FROM r""", MANY)
oracle("rule_violations", """ SELECT 'P' || p_partkey AS rule_id, 'tree' AS node_path, unnest(CASE p_partkey % 50
  WHEN 1 THEN ['operator > not allowed for STRING'] WHEN 11 THEN ['unknown field B.v2.no_such_field'] WHEN 21 THEN ['IN needs a list of literals']
  WHEN 31 THEN ['slide must divide duration', 'filter field is not dynamic_categorical: B.v2.k'] ELSE ['operator REGEX not allowed for STRING'] END) AS problem
FROM part WHERE p_partkey % 50 IN (1, 11, 21, 31, 41)""")
oracle("rule_envelope_paths", """ SELECT 'P' || p_partkey AS rule_id, CASE WHEN p_partkey % 4 = 3 THEN 'unknown field metadata.no_such' ELSE 'accepted' END AS outcome FROM part""")
oracle("rule_index", """ SELECT field, value, count(DISTINCT p) AS rules FROM idx GROUP BY field, value UNION ALL SELECT '*', '*', count(*) FROM complex""", MANY)
oracle("doc_freq", " SELECT 'B' AS source, 'v2' AS version, field, count(DISTINCT p) AS rules FROM preds GROUP BY field", MANY)

_G0 = "e.device_type = r.dev AND e.login_channel IN (r.c0, r.c1)"
_G1 = "r.p % 3 = 0 AND e.k = r.p % 100 AND e.event_type = 'view'"


def _matches(test: str) -> str:
    return f""" SELECT e.event_id, count(r.p) AS n_rules, CAST(coalesce(sum(r.p), 0) AS BIGINT) AS rule_sum
FROM cdp e LEFT JOIN r ON e.source = 'B' AND ({test}) GROUP BY e.event_id"""


_ANY = "r.empty OR r.p % 2 = 1 OR e.device_type = r.dev OR e.login_channel IN (r.c0, r.c1) OR (r.p % 3 = 0 AND (e.k = r.p % 100 OR e.event_type = 'view'))"
oracle("candidate_rules", _matches(_ANY), MANY)
oracle("candidate_rules_active", _matches(f"r.p % 7 <> 0 AND ({_ANY})"), MANY)
_RARE = f"r.empty OR ({_G0}) OR ({_G1})"
oracle("rare_two", _matches(_RARE), MANY)
oracle("exact_groups", _matches(f"r.empty OR ({_G0} AND (r.p % 2 = 0 OR e.k BETWEEN r.s AND r.s + 20)) OR ({_G1})"), MANY)
_SHAPES = [
    "e.k BETWEEN r.s AND r.s + 3", "e.amount_cents > r.p * 3 AND e.amount_cents <= r.p * 3 + 200", "e.k < r.s % 5 OR e.amount_cents >= 20000 + r.p",
    "starts_with(e.device_type, r.dev[1:2]) AND e.k = r.p % 100", "starts_with(e.device_type, r.dev[1:3]) AND e.k <> r.p % 100",
    "e.login_channel LIKE '%' || (['EB', 'TM', 'NCH'])[r.p % 3 + 1] AND e.amount_cents < r.p % 700", "e.event_type LIKE '%ie%' AND e.k > 97 - r.s % 3",
    "(e.login_channel NOT IN ('ATM', 'WEB') AND e.amount_cents BETWEEN r.p * 5 AND r.p * 5 + 90) OR (e.device_type IN ('IOS', r.dev) AND e.login_channel = 'ATM' AND e.k >= 90 + r.s % 9)",
    "e.device_type NOT LIKE '%T' AND length(e.login_channel) > 6 + r.s % 6",
    "e.amount_cents < e.k OR (e.device_type LIKE '%' || r.dev[-2:] AND e.k = r.s)",
]
oracle("exact_all_operators", _matches("CASE r.p % 10 " + " ".join(f"WHEN {i} THEN {test}" for i, test in enumerate(_SHAPES)) + " END"), MANY)
oracle("access_paths", """ SELECT unnest(CASE p % 10 WHEN 0 THEN ['line'] WHEN 1 THEN ['line'] WHEN 2 THEN ['line'] WHEN 3 THEN ['one'] WHEN 4 THEN ['text'] WHEN 5 THEN ['text']
  WHEN 6 THEN ['line'] WHEN 7 THEN ['line', 'pair'] WHEN 8 THEN ['always'] ELSE ['always'] END) AS kind, count(DISTINCT p) AS rules FROM r GROUP BY kind""", MANY)
oracle("event_log", " SELECT event_id, customer_id, event_type, amount_cents FROM cdp")
oracle("first_arrival_shared", """ SELECT event_id AS row_id, event_id - event_id % 4 AS event_id,
  CASE WHEN row_number() OVER (PARTITION BY event_id - event_id % 4, event_type ORDER BY us, event_id) = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM cdp""")
oracle("selectivity", f""" SELECT e.source, count(DISTINCT e.event_id) AS events, count(r.p) AS candidates, (SELECT count(*) FROM part) AS rules,
  round(1 - count(r.p)::DOUBLE / (count(DISTINCT e.event_id) * (SELECT count(*) FROM part)), 6) AS pruned
FROM cdp e LEFT JOIN r ON e.source = 'B' AND ({_RARE}) GROUP BY e.source""", MANY)

# ---- datasets -----------------------------------------------------------------------

oracle("in_dataset", " SELECT event_id, customer_id FROM cdp WHERE customer_id IN (SELECT customer_id FROM profile WHERE customer_segment = 'BUILDING')", PROFILE)
oracle("in_dataset_tuple", """ SELECT event_id, coalesce(c IS NOT NULL AND EXISTS (SELECT 1 FROM members m WHERE m.d = t.d AND m.c = t.c), false) AS member FROM t""", """
t AS (SELECT event_id, k, CASE WHEN k % 5 = 0 THEN 'A' WHEN k % 5 = 1 THEN 'A_B' ELSE device_type END AS d,
        CASE WHEN k % 5 = 0 THEN 'B_C' WHEN k % 5 = 1 THEN 'C' WHEN k % 5 <> 4 THEN login_channel END AS c FROM cdp),
members AS (SELECT DISTINCT d, c FROM t WHERE k % 7 = 0 AND c IS NOT NULL AND d <> 'A_B' AND k % 2 + 1 = (
  SELECT max(k % 2 + 1) FROM t WHERE k % 7 = 0 AND c IS NOT NULL AND d <> 'A_B'))""")
oracle("dataset_newest", """ SELECT dataset_id, dataset_version, tuples FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC) AS r FROM (
  SELECT o_orderstatus AS dataset_id, o_orderkey % 12 AS n, CASE o_orderstatus WHEN 'F' THEN 'v1.' || (o_orderkey % 12) WHEN 'O' THEN '2024-' || (o_orderkey % 12) END AS dataset_version, count(DISTINCT o_orderpriority) AS tuples
  FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL)) WHERE r = 1
UNION ALL SELECT o_orderstatus, NULL, count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1""")
oracle("dataset_upsert", """ SELECT 'seen' AS dataset_id, v AS dataset_version, count(*) AS tuples, count(*) < 50 AS use_in FROM (
  SELECT DISTINCT 'v' || o_orderkey % 3 AS v, a, b FROM (SELECT o_orderkey, o_orderstatus AS a, o_orderpriority AS b FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders))
GROUP BY v""")

# ---- patterns -----------------------------------------------------------------------

_LATER = "(b.us > a.us OR (b.us = a.us AND b.event_id > a.event_id))"
oracle("followed_by", f""" SELECT a.event_id FROM cdp a WHERE a.event_type = 'view' AND EXISTS (SELECT 1 FROM cdp b
  WHERE b.session_id = a.session_id AND b.event_type IN ('click', 'view') AND {_LATER} AND b.us < a.us + {8 * H})""")
oracle("not_followed_by", f""" SELECT a.event_id, a.us + {48 * H} AS fires_us FROM cdp a WHERE a.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM cdp b
  WHERE b.customer_id = a.customer_id AND b.event_type = 'purchase' AND {_LATER} AND b.us < a.us + {48 * H})""")
oracle("followed_orders", f""" SELECT a.event_id, EXISTS (SELECT 1 FROM ord b WHERE b.cust = a.cust AND {_LATER} AND b.us < a.us + {90 * 24 * H}) AS followed
FROM ord a WHERE a.amount > 20000000""", "\nord AS (SELECT o_orderkey AS event_id, o_custkey AS cust, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders)")


def _fold(rows: str, ttl: int, out: str) -> tuple[str, str]:
    return f" SELECT {out} FROM chain WHERE ok RECURSIVE", f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS rn FROM ({rows})),
chain AS (
  SELECT key, rn, us AS kept, event_id, extra, true AS ok FROM rk WHERE rn = 1
  UNION ALL
  SELECT r.key, r.rn, CASE WHEN r.us >= f.kept + {ttl} THEN r.us ELSE f.kept END, r.event_id, r.extra, r.us >= f.kept + {ttl}
  FROM chain f JOIN rk r ON r.key = f.key AND r.rn = f.rn + 1)"""


_body, _cte = _fold("SELECT event_id, us, customer_id || '|' || event_type AS key, 1 AS extra FROM cdp", 24 * H, "event_id")
oracle("first_arrival", _body, _cte)
oracle("first_arrival_ever", """ SELECT event_id FROM cdp a WHERE NOT EXISTS (SELECT 1 FROM cdp b WHERE b.session_id = a.session_id AND b.device_type = a.device_type
  AND (b.us < a.us OR (b.us = a.us AND b.event_id < a.event_id)))""")
_body, _cte = _fold("SELECT event_id, us, customer_id || '|' || rule_id AS key, rule_id AS extra FROM judged WHERE status = 'PASS'", 24 * H, "event_id, extra AS rule_id")
oracle("cooldown", _body, *judged("R02", "R04"), _cte)

# ---- life cycle and mapping ---------------------------------------------------------

LOADS = """
act AS (SELECT 'P' || p_partkey AS rule_id, p_size AS rule_version, p_partkey % 2 = 0 AS is_active, p_brand AS body FROM part WHERE p_partkey % 3 <> 0),
arr AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 40 = 0 THEN '' ELSE 'P' || (p_partkey - CASE WHEN p_partkey % 10 = 4 THEN 2 ELSE 0 END) END AS rule_id, p_type AS body FROM part WHERE p_partkey % 2 = 0),
usable AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY pos DESC) AS rn FROM arr WHERE rule_id <> ''),
fresh AS (SELECT * FROM usable WHERE rn = 1)"""
oracle("rule_versions", """ SELECT coalesce(f.rule_id, a.rule_id) AS rule_id, CAST(coalesce(a.rule_version, 0) + CASE WHEN f.rule_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS rule_version,
  CASE WHEN f.rule_id IS NULL THEN a.is_active ELSE true END AS is_active, CASE WHEN f.rule_id IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(1700000000 AS BIGINT) END AS updated_s,
  coalesce(f.body, a.body) AS body FROM act a FULL OUTER JOIN fresh f ON a.rule_id = f.rule_id""", LOADS)
oracle("rule_history", """ SELECT f.rule_id || '_v' || (coalesce(a.rule_version, 0) + 1) AS history_id, f.rule_id, CAST(coalesce(a.rule_version, 0) + 1 AS INTEGER) AS rule_version, f.body, false AS refused
FROM fresh f LEFT JOIN act a USING (rule_id) UNION ALL SELECT '', rule_id, 0, body, true FROM usable WHERE rn > 1""", LOADS)
oracle("cdc_latest", """ SELECT 'U' || user_id AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'c' END AS op, us // 1000 AS ts_ms, event_type FROM cdp a
WHERE event_type <> 'signup' AND NOT EXISTS (SELECT 1 FROM cdp b WHERE b.user_id = a.user_id AND (b.us // 1000 > a.us // 1000 OR (b.us // 1000 = a.us // 1000 AND b.event_id > a.event_id)))""")
oracle("rules_effective", """ SELECT v.rule_id, v.rule_version, count(*) AS judged FROM v JOIN cdp e ON e.source = CASE WHEN v.rule_version % 2 = 0 THEN 'A' ELSE 'B' END
  AND e.us >= v.s AND (v.e IS NULL OR e.us < v.e) GROUP BY ALL""", """
v AS (SELECT 'P' || p_partkey // 3 AS rule_id, p_partkey AS rule_version, (1704067200 + (p_partkey % 29) * 86400 + p_size * 617) * 1000000 AS s,
        (SELECT (1704067200 + (n.p_partkey % 29) * 86400 + n.p_size * 617) * 1000000 FROM part n WHERE n.p_partkey = part.p_partkey + 1 AND n.p_partkey // 3 = part.p_partkey // 3) AS e FROM part)""")
MAPPERS = """
m AS (SELECT 'M' || n_regionkey AS mapper_id, 'S' || n_regionkey AS source, 'a' || n_nationkey // 5 AS alias, 'raw.n' || n_nationkey AS raw_path FROM nation JOIN region ON n_regionkey = r_regionkey)"""
oracle("rule_rewrite", """ SELECT DISTINCT l.rule_id, l.field, k.source || '.' || k.raw_path AS raw_field FROM l LEFT JOIN (SELECT DISTINCT n.rule_id, m.source, m.alias, m.raw_path FROM n JOIN m USING (mapper_id)) k
  ON k.rule_id = l.rule_id AND k.alias = l.alias AND (l.src = 'general_schema' OR l.src = k.source)""", MAPPERS, """
l AS (SELECT 'P' || p_partkey AS rule_id, CASE WHEN p_partkey % 9 = 0 THEN 'general_schema' ELSE 'S' || p_size % 5 END AS src, 'a' || p_partkey % 6 AS alias,
        CASE WHEN p_partkey % 9 = 0 THEN 'general_schema' ELSE 'S' || p_size % 5 END || '.a' || p_partkey % 6 AS field FROM part),
n AS (SELECT 'P' || p_partkey AS rule_id, 'M' || (p_partkey % 5) AS mapper_id FROM part UNION SELECT 'P' || p_partkey, 'M' || (p_partkey % 3) FROM part)""")


oracle("rule_rewrite_body", """ SELECT 'P' || p AS rule_id, 'S' || r || '.' || coalesce(a.raw_path, 'a' || p % 6) AS field,
  'S' || r || '.' || coalesce(b.raw_path, 'a' || s % 6) || ' * 2' AS expr,
  array_to_string(list_sort(list_distinct([CASE WHEN a.raw_path IS NULL THEN 'S' || r || '.a' || p % 6 END, CASE WHEN b.raw_path IS NULL THEN 'S' || r || '.a' || s % 6 END])), ',') AS unknown
FROM (SELECT p_partkey AS p, p_size AS s, p_partkey % 5 AS r FROM part)
LEFT JOIN m a ON a.source = 'S' || r AND a.alias = 'a' || p % 6 LEFT JOIN m b ON b.source = 'S' || r AND b.alias = 'a' || s % 6""", """
m AS (SELECT 'S' || n_regionkey AS source, 'a' || n_nationkey // 5 AS alias, 'raw.n' || n_nationkey AS raw_path FROM nation)""")
oracle("throughput", """ SELECT s AS interval_s, ok AS succeeded, bad AS failed, ok / CAST(3600 AS DOUBLE) AS rate, ok / CAST(3600 AS DOUBLE) / CAST(0.005 AS DOUBLE) AS share_of_target,
  ok / CAST(3600 AS DOUBLE) < CAST(0.0045 AS DOUBLE) AS warning,
  CAST((SELECT sum(ok) FROM slot b WHERE b.s <= a.s) AS DOUBLE) / (s - (SELECT min(s) FROM slot) + 3600) AS average_rate FROM slot a""", """
slot AS (SELECT us // 3600000000 * 3600 AS s, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS bad FROM cdp GROUP BY 1)""")
oracle("hot_keys", """ SELECT customer_id, max(n) AS peak, count(*) AS hot_slots, CAST(sum(n) AS BIGINT) AS hot_events FROM (
  SELECT customer_id, us // 86400000000 AS d, count(*) AS n FROM cdp GROUP BY 1, 2) WHERE n > 1 GROUP BY customer_id ORDER BY peak DESC, hot_events DESC, customer_id LIMIT 10""")
