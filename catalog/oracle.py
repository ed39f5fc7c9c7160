"""DuckDB SQL for the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

FEATURES = (
    "amount",
    "error_balance_orig",
    "error_balance_dest",
    "type_TRANSFER",
    "type_CASH_OUT",
    "type_CASH_IN",
    "type_DEBIT",
    "orig_tx_count_1h",
    "orig_amount_sum_1h",
    "dest_tx_count_1h",
)
DUMMIES = FEATURES[3:7]

_TXN = """
base AS (
  SELECT event_id,
    date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS step,
    CASE event_type WHEN 'click' THEN 'PAYMENT' WHEN 'purchase' THEN 'TRANSFER'
      WHEN 'error' THEN 'CASH_OUT' WHEN 'view' THEN 'CASH_IN' WHEN 'signup' THEN 'DEBIT' END AS type,
    CAST(round(value * 100) AS BIGINT) AS amt_c,
    'C' || user_id AS nameOrig,
    'C' || ((user_id * 7 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) % 150) AS nameDest,
    (event_id * 7919) % 60000 AS oo_c,
    (event_id * 104729) % 60000 AS od_c
  FROM events
),
txn AS (
  SELECT event_id, step, type, CAST(amt_c AS DOUBLE) / 100 AS amount, nameOrig,
    CAST(oo_c AS DOUBLE) / 100 AS oldbalanceOrg,
    CAST(greatest(oo_c - amt_c, 0) AS DOUBLE) / 100 AS newbalanceOrig,
    nameDest,
    CAST(od_c AS DOUBLE) / 100 AS oldbalanceDest,
    CAST(CASE WHEN type = 'TRANSFER' AND event_id % 3 = 0 THEN od_c ELSE od_c + amt_c END
      AS DOUBLE) / 100 AS newbalanceDest,
    CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND oo_c < amt_c AND event_id % 5 = 0
      THEN 1 ELSE 0 END AS isFraud,
    CASE WHEN type = 'TRANSFER' AND amt_c > 20000 THEN 1 ELSE 0 END AS isFlaggedFraud
  FROM base
)"""

_SPOILED = """
spoiled AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 107 <> 0 THEN step END AS step,
    CASE WHEN event_id % 83 = 0 THEN 'REFUND' ELSE type END AS type,
    CASE WHEN event_id % 97 = 0 THEN 0.0 WHEN event_id % 101 = 0 THEN -amount
      WHEN event_id % 103 = 0 THEN 'NaN'::DOUBLE ELSE amount END AS amount,
    CASE WHEN event_id % 79 <> 0 THEN nameOrig END AS nameOrig,
    CASE WHEN event_id % 113 <> 0 THEN nameDest END AS nameDest,
    CASE WHEN event_id % 89 = 0 THEN -1.0 ELSE oldbalanceOrg END AS oldbalanceOrg,
    CASE WHEN event_id % 73 <> 0 THEN newbalanceDest END AS newbalanceDest)
  FROM txn
),
judged AS (
  SELECT *,
    step IS NULL AS bad_step,
    coalesce(type NOT IN ('PAYMENT', 'TRANSFER', 'CASH_OUT', 'CASH_IN', 'DEBIT'), true) AS bad_type,
    coalesce(NOT (amount > 0) OR isnan(amount), true) AS bad_amount,
    nameOrig IS NULL AS bad_orig,
    nameDest IS NULL AS bad_dest,
    coalesce(NOT (oldbalanceOrg >= 0), true) AS bad_oo,
    coalesce(NOT (newbalanceOrig >= 0), true) AS bad_no,
    coalesce(NOT (oldbalanceDest >= 0), true) AS bad_od,
    coalesce(NOT (newbalanceDest >= 0), true) AS bad_nd
  FROM spoiled
),
accepted AS (
  SELECT * FROM judged WHERE NOT (bad_step OR bad_type OR bad_amount OR bad_orig OR bad_dest
    OR bad_oo OR bad_no OR bad_od OR bad_nd)
)"""

_SCORED = """
marked AS (
  SELECT *, CAST(least(999, (event_id * 7907) % 700 + 250 * isFraud
      + 40 * (CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 1 ELSE 0 END)) AS DOUBLE) / 1000
      AS risk_score,
    CAST((event_id * 613) % 1200 AS DOUBLE) / 10 AS latency_ms
  FROM txn
),
scored AS (
  SELECT *, CASE WHEN risk_score >= 0.7 THEN 'BLOCK' WHEN risk_score >= 0.3 THEN 'REVIEW'
    ELSE 'APPROVE' END AS decision
  FROM marked
)"""

_BY_ROLE = """
by_role AS (
  SELECT event_id,
    count(*) OVER o AS orig_tx_count_1h,
    CAST(coalesce(sum(CAST(round(amount * 100) AS BIGINT)) OVER o, 0) AS DOUBLE) / 100
      AS orig_amount_sum_1h,
    count(*) OVER d AS dest_tx_count_1h
  FROM txn
  WINDOW o AS (PARTITION BY step, nameOrig ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    d AS (PARTITION BY step, nameDest ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

_SHARED = """
touched AS (
  SELECT event_id, step, 'o' AS side, nameOrig AS account,
    CAST(round(amount * 100) AS BIGINT) AS c FROM txn {where}
  UNION ALL
  SELECT event_id, step, 'd', nameDest, CAST(round(amount * 100) AS BIGINT) FROM txn {where}
),
seen AS (
  SELECT event_id, side, count(*) OVER w AS n, coalesce(sum(c) OVER w, 0) AS c
  FROM touched
  WINDOW w AS (PARTITION BY step, account ORDER BY event_id
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shared AS (
  SELECT event_id,
    CAST(max(CASE WHEN side = 'o' THEN n END) AS BIGINT) AS orig_tx_count_1h,
    CAST(max(CASE WHEN side = 'o' THEN c END) AS DOUBLE) / 100 AS orig_amount_sum_1h,
    CAST(max(CASE WHEN side = 'd' THEN n END) AS BIGINT) AS dest_tx_count_1h
  FROM seen GROUP BY event_id
)"""

_MIXED = """
wide AS (SELECT max(event_id) // 4 + 1 AS width FROM txn),
mixed AS (
  SELECT event_id, step, CASE WHEN event_id % 3 = 0 THEN 'HOT' ELSE nameOrig END AS nameOrig,
    nameDest, CAST(round(amount * 100) AS BIGINT) AS c,
    least(3, greatest(event_id + ((event_id * 7919) % 5 - 2) * 20, 0) // width
      + (event_id % 20 = 7)::INTEGER) AS portion
  FROM txn, wide
),
newest AS (
  SELECT portion, max(max(step)) OVER (ORDER BY portion ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS newest FROM mixed GROUP BY portion
),
timed AS (
  SELECT mixed.*, coalesce(step < newest - 2, false) AS late
  FROM mixed JOIN newest USING (portion)
),
sides AS (
  SELECT event_id, step, portion, late, c, 'o' AS side, nameOrig AS account FROM timed
  UNION ALL
  SELECT event_id, step, portion, late, c, 'd', nameDest FROM timed
),
counted AS (
  SELECT event_id, side, late, count(*) OVER w AS n, coalesce(sum(c) OVER w, 0) AS c
  FROM sides
  WINDOW w AS (PARTITION BY step, account, CASE WHEN late THEN portion ELSE -1 END
    ORDER BY portion * 1000000000000 + event_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
stream_mixed AS (
  SELECT event_id,
    CAST(max(CASE WHEN side = 'o' THEN n END) AS BIGINT) AS orig_tx_count_1h,
    CAST(max(CASE WHEN side = 'o' THEN c END) AS DOUBLE) / 100 AS orig_amount_sum_1h,
    CAST(max(CASE WHEN side = 'd' THEN n END) AS BIGINT) AS dest_tx_count_1h,
    bool_or(late) AS late
  FROM counted GROUP BY event_id
)"""

_DERIVED = """
  (oldbalanceOrg - newbalanceOrig) - amount AS error_balance_orig,
  (newbalanceDest - oldbalanceDest) - amount AS error_balance_dest,
  CAST(type = 'TRANSFER' AS INTEGER) AS type_TRANSFER,
  CAST(type = 'CASH_OUT' AS INTEGER) AS type_CASH_OUT,
  CAST(type = 'CASH_IN' AS INTEGER) AS type_CASH_IN,
  CAST(type = 'DEBIT' AS INTEGER) AS type_DEBIT"""

_FEAT = f"""
feat AS (SELECT *, {_DERIVED} FROM marked JOIN by_role USING (event_id))"""

_LONG = """
long AS (
{parts}
)""".format(
    parts="\n  UNION ALL\n".join(
        f"  SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, step <= 500 AS is_ref FROM {{source}}"
        for f in (*FEATURES, "risk_score")
    )
)

_KS = """
counts AS (
  SELECT feature, v, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c
  FROM long GROUP BY feature, v
),
cdf AS (
  SELECT feature, CAST(sum(r) OVER w AS DOUBLE) / sum(r) OVER f AS fr,
    CAST(sum(c) OVER w AS DOUBLE) / sum(c) OVER f AS fc,
    CAST(sum(r) OVER f AS BIGINT) AS n, CAST(sum(c) OVER f AS BIGINT) AS m
  FROM counts
  WINDOW w AS (PARTITION BY feature ORDER BY v
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY feature)
),
dist AS (
  SELECT feature, max(abs(fr - fc)) AS d, max(n) AS n, max(m) AS m FROM cdf GROUP BY feature
),
lam AS (
  SELECT *, d * sqrt(CAST(n AS DOUBLE) * m / (n + m)) AS l FROM dist
),
ks AS (
  SELECT feature, d, n, m,
    CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * (
      SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * l * l))
      FROM range(1, 101) AS t(k)))) END AS p
  FROM lam
)"""

_CHI2 = """
cells AS (
  SELECT feature,
    CAST(count(*) FILTER (is_ref AND v = 1) AS DOUBLE) AS a,
    CAST(count(*) FILTER (is_ref AND v <> 1) AS DOUBLE) AS b,
    CAST(count(*) FILTER (NOT is_ref AND v = 1) AS DOUBLE) AS c,
    CAST(count(*) FILTER (NOT is_ref AND v <> 1) AS DOUBLE) AS e
  FROM long WHERE feature IN ({dummies}) GROUP BY feature
),
chi AS (
  SELECT feature, (a + b + c + e) * (a * e - b * c) * (a * e - b * c)
    / ((a + b) * (c + e) * (a + c) * (b + e)) AS x FROM cells
),
tee AS (SELECT *, sqrt(x / 2) AS z, 1 / (1 + 0.5 * sqrt(x / 2)) AS t FROM chi),
chi2 AS (
  SELECT feature, x, least(1.0, t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196
    + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587
    + t * (-0.82215223 + t * 0.17087277)))))))))) AS p
  FROM tee
)""".format(dummies=", ".join(f"'{d}'" for d in DUMMIES))

_CURVE = """
points AS (
  SELECT risk_score AS threshold, count(*) FILTER (isFraud = 1) AS pos, count(*) AS n
  FROM scored GROUP BY risk_score
),
curve AS (
  SELECT threshold, CAST(pos AS DOUBLE) AS pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp,
    CAST(sum(n) OVER w AS DOUBLE) AS seen, CAST(sum(pos) OVER () AS DOUBLE) AS all_pos
  FROM points
  WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_DAILY = """
days AS (
  SELECT (step - 1) // 24 AS period, risk_score, count(*) FILTER (isFraud = 1) AS pos,
    count(*) AS n
  FROM scored GROUP BY 1, 2
),
daycurve AS (
  SELECT period, CAST(pos AS DOUBLE) AS pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp,
    CAST(sum(n) OVER w AS DOUBLE) AS seen, CAST(sum(pos) OVER f AS DOUBLE) AS all_pos
  FROM days
  WINDOW w AS (PARTITION BY period ORDER BY risk_score DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY period)
),
daily AS (
  SELECT CAST(period AS BIGINT) AS period,
    round(CASE WHEN max(all_pos) = 0 THEN 0.0 ELSE sum(pos * (tp / seen)) / max(all_pos) END, 6)
      AS pr_auc
  FROM daycurve GROUP BY period
),
runs AS (
  SELECT period, 'v' || (period + 1) AS version, pr_auc,
    pr_auc - coalesce(lag(pr_auc) OVER (ORDER BY period), 0.0) AS improvement
  FROM daily
),
judged_runs AS (
  SELECT *, improvement >= 0.005 - 1e-12 AS promoted FROM runs
)"""

_ACCOUNTS = """
ft AS (SELECT * FROM txn WHERE type = 'TRANSFER' AND isFraud = 1),
gt AS (SELECT * FROM txn WHERE type = 'TRANSFER' AND isFraud = 0),
fc AS (SELECT * FROM txn WHERE type = 'CASH_OUT' AND isFraud = 1),
gc AS (SELECT * FROM txn WHERE type = 'CASH_OUT' AND isFraud = 0)"""


def _q(select: str, *parts: str) -> str:
    return "WITH " + ",".join((_TXN, *parts)) + "\n" + select.strip()


def _describe(value: str, keys: str, source: str) -> str:
    return f"""
SELECT {keys}, count({value}) AS count, round(avg({value}), 4) AS mean,
  round(stddev_samp({value}), 4) AS std, round(min({value}), 4) AS min,
  round(quantile_cont({value}, 0.25), 4) AS p25, round(quantile_cont({value}, 0.5), 4) AS p50,
  round(quantile_cont({value}, 0.75), 4) AS p75, round(max({value}), 4) AS max
FROM {source} GROUP BY {keys}"""


_SUMMARY = """
recent AS (SELECT * FROM scored ORDER BY event_id DESC LIMIT {window}),
summary AS (
  SELECT 'ok' AS status, count(*) AS window_size, avg(risk_score) AS score_mean,
    quantile_cont(risk_score, 0.95) AS score_p95, quantile_cont(risk_score, 0.99) AS score_p99,
    quantile_cont(latency_ms, 0.5) AS latency_p50_ms,
    quantile_cont(latency_ms, 0.99) AS latency_p99_ms
  FROM recent
),
life AS (
  SELECT count(*) AS n, count(*) FILTER (decision = 'APPROVE') AS a,
    count(*) FILTER (decision = 'REVIEW') AS r, count(*) FILTER (decision = 'BLOCK') AS b
  FROM scored
)"""

_POINTS = """
placed AS (SELECT *, row_number() OVER (ORDER BY event_id) AS number FROM scored),
points AS (
  SELECT number AS rows_seen, a, r, b FROM (
    SELECT number, count(*) FILTER (decision = 'APPROVE') OVER w AS a,
      count(*) FILTER (decision = 'REVIEW') OVER w AS r,
      count(*) FILTER (decision = 'BLOCK') OVER w AS b
    FROM placed WINDOW w AS (ORDER BY number))
  WHERE number % 1000 = 0
),
looks AS (
  SELECT rows_seen, any_value(a) AS a, any_value(r) AS r, any_value(b) AS b,
    count(*) AS window_size, avg(risk_score) AS score_mean,
    quantile_cont(risk_score, 0.95) AS score_p95, quantile_cont(risk_score, 0.99) AS score_p99,
    quantile_cont(latency_ms, 0.5) AS latency_p50_ms,
    quantile_cont(latency_ms, 0.99) AS latency_p99_ms
  FROM points JOIN placed ON number > rows_seen - 10000 AND number <= rows_seen
  GROUP BY rows_seen
)"""

_WINDOWED = """
shifted AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 10000 >= 5000 THEN amount * 1.5 + 1 ELSE amount END AS amount),
    (row_number() OVER (ORDER BY event_id) - 1) // 2500 AS win
  FROM feat
),
wins AS (SELECT win FROM shifted GROUP BY win HAVING count(*) = 2500),
flat AS (
{parts}
),
tallies AS (
  SELECT win, feature, v, 0 AS r, count(*) AS c FROM flat SEMI JOIN wins USING (win)
    GROUP BY ALL
  UNION ALL
  SELECT wins.win, feature, v, count(*) AS r, 0 AS c FROM flat, wins WHERE is_ref GROUP BY ALL
),
counts AS (
  SELECT win || ' ' || feature AS feature, v, sum(r) AS r, sum(c) AS c FROM tallies
  GROUP BY ALL
)""".format(
    parts="\n  UNION ALL\n".join(
        f"  SELECT win, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, step <= 100 AS is_ref FROM shifted"
        for f in FEATURES
    )
)
_WINDOWED_KS = _KS[_KS.index("cdf AS") :]

_RINGS = """
pay AS (
  SELECT (step - 1) // 24 AS period, nameOrig AS x, nameDest AS y,
    CAST(round(amount * 100) AS BIGINT) AS c
  FROM txn WHERE type IN ('TRANSFER', 'CASH_OUT') AND isFraud = 1 AND nameOrig <> nameDest
),
links AS (
  SELECT period, x AS a, y AS b FROM pay UNION SELECT period, y, x FROM pay
),
reach AS (
  SELECT DISTINCT period, a AS node, a AS label FROM links
  UNION
  SELECT reach.period, links.b, reach.label
  FROM reach JOIN links ON links.period = reach.period AND links.a = reach.node
),
labelled AS (SELECT period, node, min(label) AS ring FROM reach GROUP BY ALL),
rings AS (
  SELECT period, ring, count(*) AS frauds, CAST(sum(c) AS DOUBLE) / 100 AS amount
  FROM pay JOIN labelled USING (period) WHERE node = x
  GROUP BY ALL HAVING count(*) >= 2
)"""

_CHAINS = """
SELECT event_id, account, step, amount, isFraud, out_id, out_step, out_amount, out_fraud,
  out_step - step AS lag_steps
FROM (
  SELECT t.event_id, t.nameDest AS account, t.step, t.amount, t.isFraud, o.event_id AS out_id,
    o.step AS out_step, o.amount AS out_amount, o.isFraud AS out_fraud
  FROM (SELECT * FROM txn WHERE type = 'TRANSFER') AS t
  ASOF JOIN (SELECT * FROM txn WHERE type = 'CASH_OUT') AS o
    ON t.nameDest = o.nameOrig AND t.event_id < o.event_id)
WHERE out_step - step <= 24"""

_LAST_RECEIVED = """
SELECT a.event_id, b.event_id AS received_id, b.amount AS received_amount
FROM txn AS a ASOF LEFT JOIN txn AS b ON a.nameOrig = b.nameDest AND a.event_id > b.event_id"""


def _rolling(hours: int) -> str:
    return f"""
SELECT a.event_id, count(b.event_id) AS sent_count,
  CAST(coalesce(sum(CAST(round(b.amount * 100) AS BIGINT)), 0) AS DOUBLE) / 100 AS sent_sum
FROM timed AS a LEFT JOIN timed AS b ON a.nameOrig = b.nameOrig
  AND b.us >= a.us - {hours} * 3600000000
  AND (b.us < a.us OR (b.us = a.us AND b.event_id < a.event_id))
GROUP BY a.event_id"""


_TIMED = """
timed AS (
  SELECT txn.*, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us
  FROM txn JOIN events USING (event_id)
)"""

_MEDIANS = ("amount", "oldbalanceOrg", "newbalanceDest")
_MEDIAN_SCORES = (
    "SELECT event_id, "
    + ", ".join(f"round({v}_z, 4) AS {v}_score" for v in _MEDIANS)
    + ", round(greatest("
    + ", ".join(f"abs({v}_z)" for v in _MEDIANS)
    + "), 4) AS anomaly_score FROM (SELECT event_id, "
    + ", ".join(
        f"CASE WHEN {v}_s > 0 THEN 0.6745::DOUBLE * ({v} - {v}_m) / {v}_s END AS {v}_z"
        for v in _MEDIANS
    )
    + " FROM txn JOIN centres USING (type) JOIN spreads USING (type))"
)
_CENTRES = (
    "\ncentres AS (SELECT type, "
    + ", ".join(f"quantile_cont({v}, 0.5) AS {v}_m" for v in _MEDIANS)
    + " FROM txn GROUP BY type),\nspreads AS (SELECT type, "
    + ", ".join(f"quantile_cont(abs({v} - {v}_m), 0.5) AS {v}_s" for v in _MEDIANS)
    + " FROM txn JOIN centres USING (type) GROUP BY type)"
)

_COUNTS4 = """
cm AS (
  SELECT CAST(count(*) FILTER (isFraud = 1 AND risk_score >= 0.5) AS BIGINT) AS tp,
    CAST(count(*) FILTER (isFraud = 0 AND risk_score >= 0.5) AS BIGINT) AS fp,
    CAST(count(*) FILTER (isFraud = 1 AND risk_score < 0.5) AS BIGINT) AS fn,
    CAST(count(*) FILTER (isFraud = 0 AND risk_score < 0.5) AS BIGINT) AS tn
  FROM scored
),
per AS (
  SELECT *,
    CASE WHEN tn + fn = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / (tn + fn) END AS p0,
    CASE WHEN tn + fp = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS r0,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p1,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r1
  FROM cm
),
rep AS (
  SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
    CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
    tn + fp AS n0, tp + fn AS n1, tn + fp + tp + fn AS n
  FROM per
)"""


def _sweep(thresholds) -> str:
    grid = " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS threshold, {y} AS label, {p} AS prediction"
        for t in thresholds
        for y in (0, 1)
        for p in (0, 1)
    )
    return f"""
SELECT g.threshold, CAST(g.label AS INTEGER) AS label, CAST(g.prediction AS INTEGER) AS prediction,
  count(s.event_id) AS rows
FROM ({grid}) g LEFT JOIN scored s
  ON s.isFraud = g.label AND (CASE WHEN s.risk_score >= g.threshold THEN 1 ELSE 0 END) = g.prediction
GROUP BY ALL"""


_TOPK = " UNION ALL ".join(
    f"SELECT event_id, {i} AS i, '{f}' AS feature, "
    f"CAST((event_id * {31 + 17 * i} + {7919 * i}) % 2001 - 1000 AS DOUBLE) / 1000 AS value "
    "FROM events"
    for i, f in enumerate(FEATURES)
)

_NULLS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, "
    "(SELECT count(*) > 0 FROM spoiled WHERE step IS NULL OR nameOrig IS NULL OR nameDest IS NULL "
    "OR newbalanceDest IS NULL) AS any_null FROM spoiled"
    for c in (
        "event_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
        "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
    )
)

_QUESTIONS = (
    ("fraud transfer receivers among fraud cash-out senders", "ft", "nameDest", "fc", "nameOrig"),
    ("fraud transfer receivers among genuine cash-out senders", "ft", "nameDest", "gc", "nameOrig"),
    ("genuine transfer receivers among fraud cash-out senders", "gt", "nameDest", "fc", "nameOrig"),
    ("genuine transfer receivers among fraud transfer receivers",
     "gt", "nameDest", "ft", "nameDest"),
    ("genuine transfer senders among fraud transfer receivers", "gt", "nameOrig", "ft", "nameDest"),
    ("genuine transfer senders among fraud transfer senders", "gt", "nameOrig", "ft", "nameOrig"),
    ("genuine transfer receivers among fraud transfer senders", "gt", "nameDest", "ft", "nameOrig"),
)

_MEMBERS = "\nUNION ALL ".join(
    f"SELECT '{q}' AS question, (SELECT count(*) FROM {a} WHERE {ak} IN (SELECT {bk} FROM {b})) "
    "AS rows"
    for q, a, ak, b, bk in _QUESTIONS
)

_VELOCITY = "SELECT event_id, orig_tx_count_1h, orig_amount_sum_1h, dest_tx_count_1h FROM "
_SHARED_ALL = _SHARED.format(where="")
_SHARED_VALID = _SHARED.format(where="WHERE amount > 0")
_LONG_FEAT = _LONG.format(source="feat")
_MOVED = """
moved AS (
  SELECT * REPLACE (
    CASE WHEN step > 500 THEN amount * 1.5 + 1 ELSE amount END AS amount,
    CASE WHEN step > 500 THEN orig_tx_count_1h * 1.5 + 1 ELSE orig_tx_count_1h END
      AS orig_tx_count_1h,
    CASE WHEN step > 500 THEN orig_amount_sum_1h * 1.5 + 1 ELSE orig_amount_sum_1h END
      AS orig_amount_sum_1h,
    CASE WHEN step > 500 THEN dest_tx_count_1h * 1.5 + 1 ELSE dest_tx_count_1h END
      AS dest_tx_count_1h)
  FROM feat
)"""
_ORDERED_HITS = "SELECT CASE feature " + " ".join(
    f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURES)
) + " END AS i, feature FROM ks WHERE p < 0.05 AND feature <> 'risk_score'"

ORACLE: dict[str, str] = {
    "decision_report": _q(
        """
SELECT type, CASE WHEN orig_tx_count_1h > 0 THEN 'active' ELSE 'first' END AS sender, decision,
  count(*) AS rows,
  round(CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100, 6) AS total_amount,
  round(avg(isFraud), 6) AS fraud_rate
FROM scored JOIN shared USING (event_id) WHERE amount > 0 GROUP BY 1, 2, 3""",
        _SCORED,
        _SHARED_VALID,
    ),
    "txn_scan": _q("SELECT * FROM txn"),
    "split_summary": _q(
        """
SELECT CASE WHEN step <= 500 THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
  CAST(sum(isFraud) AS BIGINT) AS frauds, round(avg(isFraud), 6) AS fraud_rate
FROM txn GROUP BY 1"""
    ),
    "partitioned_table": _q("SELECT * FROM txn WHERE step BETWEEN 400 AND 600"),
    "csv_round_trip": _q("SELECT * FROM txn"),
    "validate_rows": _q(
        "\nUNION ALL ".join(
            f"SELECT '{rule}' AS rule, count(*) FILTER ({flag}) AS rows FROM judged"
            for rule, flag in (
                ("step", "bad_step"), ("type", "bad_type"), ("amount", "bad_amount"),
                ("nameOrig", "bad_orig"), ("nameDest", "bad_dest"), ("oldbalanceOrg", "bad_oo"),
                ("newbalanceOrig", "bad_no"), ("oldbalanceDest", "bad_od"),
                ("newbalanceDest", "bad_nd"),
            )
        ),
        _SPOILED,
    ),
    "valid_rows": _q(
        """
SELECT event_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
  oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud FROM accepted""",
        _SPOILED,
    ),
    "quarantine_rows": _q(
        """
SELECT event_id, concat_ws(',', CASE WHEN bad_step THEN 'step' END,
  CASE WHEN bad_type THEN 'type' END, CASE WHEN bad_amount THEN 'amount' END,
  CASE WHEN bad_orig THEN 'nameOrig' END, CASE WHEN bad_dest THEN 'nameDest' END,
  CASE WHEN bad_oo THEN 'oldbalanceOrg' END, CASE WHEN bad_no THEN 'newbalanceOrig' END,
  CASE WHEN bad_od THEN 'oldbalanceDest' END, CASE WHEN bad_nd THEN 'newbalanceDest' END)
  AS violations
FROM judged WHERE bad_step OR bad_type OR bad_amount OR bad_orig OR bad_dest OR bad_oo OR bad_no
  OR bad_od OR bad_nd""",
        _SPOILED,
    ),
    "fraud_only": _q("SELECT * FROM txn WHERE step >= 501 AND isFraud = 1 AND amount > 0"),
    "replay_order": _q(
        "SELECT event_id, step, row_number() OVER (ORDER BY step, event_id) AS position "
        "FROM accepted",
        _SPOILED,
    ),
    "replay_cap": _q(
        "SELECT * FROM txn WHERE step >= 501 AND amount > 0 ORDER BY step, event_id LIMIT 500"
    ),
    "rename_columns": _q(
        """
SELECT event_id, step, type, amount, nameOrig AS name_orig, oldbalanceOrg AS old_balance_orig,
  newbalanceOrig AS new_balance_orig, nameDest AS name_dest, oldbalanceDest AS old_balance_dest,
  newbalanceDest AS new_balance_dest, isFraud AS is_fraud, isFlaggedFraud AS is_flagged_fraud
FROM txn"""
    ),
    "wire_fields": _q(
        """
SELECT nameOrig AS key, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
  oldbalanceDest, newbalanceDest, isFraud FROM txn"""
    ),
    "message_quarantine": _q(
        """
SELECT CAST(event_id AS VARCHAR) AS key, concat_ws(',', CASE WHEN NOT amount > 0 THEN 'amount' END,
  CASE WHEN event_id % 61 = 0 THEN 'nameOrig' END,
  CASE WHEN event_id % 59 = 0 THEN 'isFraud' END) AS violations
FROM txn WHERE NOT amount > 0 OR event_id % 61 = 0 OR event_id % 59 = 0"""
    ),
    "newest_by_arrival": _q(
        """
SELECT (event_id % 4) * 17592186044416 + event_id AS event_id, risk_score FROM scored
ORDER BY event_id // 3 DESC, (event_id % 4) * 17592186044416 + event_id DESC LIMIT 1000""",
        _SCORED,
    ),
    "gbt_score_checks": _q(
        "SELECT event_id, isFraud, true AS in_range, true AS is_band FROM txn WHERE step > 500"
    ),
    "gbt_explain_checks": _q(
        "SELECT event_id, true AS from_gate, true AS adds_up, true AS top_first "
        "FROM txn WHERE step > 500"
    ),
    "logistic_score_checks": _q(
        "SELECT event_id, isFraud, true AS in_range FROM txn WHERE step > 500"
    ),
    "stream_scoring_checks": _q(
        "SELECT count(*) AS decisions, CAST(0 AS BIGINT) AS differing FROM accepted", _SPOILED
    ),
    "publish_dry_run": _q(
        """
SELECT nameOrig AS key, step, type, amount, nameDest FROM txn WHERE step >= 501 AND amount > 0
ORDER BY step, event_id LIMIT 5"""
    ),
    "published_totals": _q(
        "SELECT count(*) AS published, count(*) FILTER (isFraud = 1) AS frauds FROM txn "
        "WHERE amount > 0"
    ),
    "preview": _q("SELECT * FROM txn ORDER BY event_id LIMIT 5"),
    "table_shape": _q("SELECT count(*) AS rows, CAST(12 AS BIGINT) AS columns FROM txn"),
    "balance_errors": _q(
        """
SELECT event_id, (oldbalanceOrg - newbalanceOrig) - amount AS error_balance_orig,
  (newbalanceDest - oldbalanceDest) - amount AS error_balance_dest FROM txn"""
    ),
    "balance_errors_alt": _q(
        """
SELECT event_id, newbalanceOrig + amount - oldbalanceOrg AS "errorBalanceOrig",
  oldbalanceDest + amount - newbalanceDest AS "errorBalanceDest" FROM txn"""
    ),
    "type_dummies": _q(
        """
SELECT event_id, CAST(type = 'TRANSFER' AS INTEGER) AS "type_TRANSFER",
  CAST(type = 'CASH_OUT' AS INTEGER) AS "type_CASH_OUT",
  CAST(type = 'CASH_IN' AS INTEGER) AS "type_CASH_IN",
  CAST(type = 'DEBIT' AS INTEGER) AS "type_DEBIT" FROM txn"""
    ),
    "dummies_drop_first": _q(
        """
SELECT event_id, step, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
  isFlaggedFraud, CAST(type = 'CASH_OUT' AS INTEGER) AS "type_CASH_OUT",
  CAST(type = 'DEBIT' AS INTEGER) AS "type_DEBIT",
  CAST(type = 'PAYMENT' AS INTEGER) AS "type_PAYMENT",
  CAST(type = 'TRANSFER' AS INTEGER) AS "type_TRANSFER" FROM txn WHERE step >= 501"""
    ),
    "velocity_by_role": _q(_VELOCITY + "by_role", _BY_ROLE),
    "velocity_by_role_hot": _q(_VELOCITY + "by_role", _BY_ROLE),
    "velocity_shared": _q(_VELOCITY + "shared", _SHARED_ALL),
    "velocity_shared_hot": _q(_VELOCITY + "shared", _SHARED_ALL),
    "stream_velocity_mixed": _q("SELECT * FROM stream_mixed", _MIXED),
    "stream_velocity": _q(_VELOCITY + "shared", _SHARED_ALL),
    "velocity_mode_diff": _q(
        """
SELECT count(*) FILTER (r.orig_tx_count_1h <> s.orig_tx_count_1h) AS sender_rows,
  count(*) FILTER (r.dest_tx_count_1h <> s.dest_tx_count_1h) AS receiver_rows
FROM by_role r JOIN shared s USING (event_id)""",
        _BY_ROLE,
        _SHARED_ALL,
    ),
    "features_batch": _q(f"SELECT *, {_DERIVED} FROM txn JOIN by_role USING (event_id)", _BY_ROLE),
    "features_online": _q(
        f"SELECT *, {_DERIVED} FROM txn JOIN shared USING (event_id)", _SHARED_VALID
    ),
    "feature_matrix": _q(
        "SELECT event_id, "
        + ", ".join(f'CAST(CAST({f} AS FLOAT) AS DOUBLE) AS "{f}"' for f in FEATURES)
        + ", isFraud FROM feat",
        _SCORED,
        _BY_ROLE,
        _FEAT,
    ),
    "decision_bands": _q("SELECT event_id, risk_score, decision FROM scored", _SCORED),
    "decision_guard": _q(
        """
SELECT event_id, risk_score,
  CASE WHEN risk_score + 0.05 >= 0.7 THEN 'BLOCK' WHEN risk_score + 0.05 >= 0.3 THEN 'REVIEW'
    ELSE 'APPROVE' END AS decision, decision AS expected_decision
FROM scored
WHERE decision <> CASE WHEN risk_score + 0.05 >= 0.7 THEN 'BLOCK'
  WHEN risk_score + 0.05 >= 0.3 THEN 'REVIEW' ELSE 'APPROVE' END""",
        _SCORED,
    ),
    "decision_records": _q(
        """
SELECT step, nameOrig, nameDest, amount, type, round(risk_score / 3, 4) AS risk_score, decision,
  round(latency_ms / 7, 2) AS latency_ms, isFraud AS is_fraud_ground_truth FROM scored""",
        _SCORED,
    ),
    "decision_log": _q(
        """
SELECT step, nameOrig, type, round(amount, 2) AS amount, round(risk_score, 4) AS risk_score,
  decision, round(latency_ms, 1) AS latency_ms FROM scored""",
        _SCORED,
    ),
    "flagged_rows": _q(
        "SELECT event_id, decision FROM scored WHERE decision IN ('REVIEW', 'BLOCK')", _SCORED
    ),
    "decision_mix": _q(
        """
SELECT d.decision, count(s.event_id) AS rows,
  round(100.0::DOUBLE * count(s.event_id) / (SELECT count(*) FROM scored), 6) AS percent
FROM (VALUES ('APPROVE'), ('REVIEW'), ('BLOCK')) d(decision) LEFT JOIN scored s USING (decision)
GROUP BY d.decision""",
        _SCORED,
    ),
    "interesting_cases": _q(
        """
SELECT event_id, step, type, amount, risk_score, decision,
  CASE WHEN isFraud = 1 THEN '[FRAUD]' ELSE '' END AS label
FROM scored WHERE risk_score > 0.05 ORDER BY step, event_id LIMIT 10""",
        _SCORED,
    ),
    "first_frauds": _q(
        "SELECT event_id, step, type, amount FROM txn WHERE step >= 501 AND isFraud = 1 "
        "ORDER BY event_id LIMIT 3"
    ),
    "compare_scores": _q(
        """
SELECT decision AS champion_decision,
  CASE WHEN (event_id * 6007) % 1000 >= 700 THEN 'BLOCK'
    WHEN (event_id * 6007) % 1000 >= 300 THEN 'REVIEW' ELSE 'APPROVE' END AS challenger_decision,
  count(*) AS rows,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scored), 6) AS share
FROM scored GROUP BY 1, 2""",
        _SCORED,
    ),
    "top_k_features": f"""
SELECT event_id, CAST(place AS INTEGER) AS place, feature, value FROM (
  SELECT event_id, feature, value,
    row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, i) - 1 AS place
  FROM ({_TOPK}))
WHERE place < 3""",
    "label_share": _q(
        """
SELECT isFraud, count(*) AS rows,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM txn), 6) AS share
FROM txn GROUP BY isFraud"""
    ),
    "type_counts": _q("SELECT type, count(*) AS rows FROM txn GROUP BY type"),
    "step_range": _q("SELECT min(step) AS min_step, max(step) AS max_step FROM txn"),
    "amount_range_by_label": _q(
        "SELECT isFraud, min(amount) AS min_amount, max(amount) AS max_amount FROM txn "
        "GROUP BY isFraud"
    ),
    "label_counts": _q(
        "SELECT count(*) FILTER (isFraud = 1) AS frauds, count(*) FILTER (isFraud = 0) AS genuine "
        "FROM txn"
    ),
    "null_counts": _q(_NULLS, _SPOILED),
    "duplicate_rows": _q(
        """
SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (
  SELECT CAST(sum(1 + CAST(event_id % 50 = 0 AS INT) + CAST(event_id % 150 = 0 AS INT)) AS BIGINT)
    AS n FROM txn
  GROUP BY step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest,
    newbalanceDest, isFraud, isFlaggedFraud)"""
    ),
    "xtab_type_label": _q(
        'SELECT type, count(*) FILTER (isFraud = 0) AS "isFraud_0", '
        'count(*) FILTER (isFraud = 1) AS "isFraud_1" FROM txn GROUP BY type'
    ),
    "xtab_flag_label": _q(
        'SELECT isFlaggedFraud, count(*) FILTER (isFraud = 0) AS "isFraud_0", '
        'count(*) FILTER (isFraud = 1) AS "isFraud_1" FROM txn GROUP BY isFlaggedFraud'
    ),
    "fraud_rate_by_type": _q(
        "SELECT type, round(avg(isFraud), 6) AS fraud_rate FROM txn GROUP BY type"
    ),
    "describe_amount": _q(_describe("amount", "isFraud", "txn")),
    "describe_errors": _q(
        _describe("v", "error, isFraud", "errors"),
        """
errors AS (
  SELECT 'error_balance_orig' AS error, isFraud,
    (oldbalanceOrg - newbalanceOrig) - amount AS v FROM txn
  UNION ALL
  SELECT 'error_balance_dest', isFraud, (newbalanceDest - oldbalanceDest) - amount FROM txn
)""",
    ),
    "fraud_types": _q("SELECT DISTINCT type FROM txn WHERE isFraud = 1"),
    "distinct_parties": _q(
        """
SELECT t.type, count(x.event_id) AS rows, count(DISTINCT x.nameOrig) AS senders,
  count(DISTINCT x.nameDest) AS receivers
FROM (VALUES ('TRANSFER'), ('CASH_OUT')) t(type)
LEFT JOIN (SELECT * FROM txn WHERE isFraud = 1) x USING (type) GROUP BY t.type"""
    ),
    "zero_dest_share": _q(
        """
SELECT isFraud, round(avg(CASE WHEN (event_id % 7 = 0 OR oldbalanceDest = 0)
  AND (event_id % 14 < 3 OR newbalanceDest = 0)
  AND amount <> 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS zero_dest_share
FROM txn WHERE type IN ('TRANSFER', 'CASH_OUT') GROUP BY isFraud"""
    ),
    "nonzero_error_share": _q(
        """
SELECT type,
  round(avg(CASE WHEN round((newbalanceOrig + amount - oldbalanceOrg) * 100) <> 0
    THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS orig_share,
  round(avg(CASE WHEN round((oldbalanceDest + amount - newbalanceDest) * 100) <> 0
    THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS dest_share
FROM txn GROUP BY type"""
    ),
    "nonzero_error_rows": _q(
        """
SELECT event_id, type, newbalanceOrig + amount - oldbalanceOrg AS "errorBalanceOrig",
  oldbalanceDest + amount - newbalanceDest AS "errorBalanceDest"
FROM txn WHERE round((oldbalanceDest + amount - newbalanceDest) * 100) <> 0"""
    ),
    "semi_join_counts": _q(_MEMBERS, _ACCOUNTS),
    "member_rows": _q(
        "SELECT event_id, nameDest FROM gt WHERE nameDest IN (SELECT nameOrig FROM fc)", _ACCOUNTS
    ),
    "class_ratio": _q(
        """
SELECT count(*) FILTER (isFraud = 0) AS negatives, count(*) FILTER (isFraud = 1) AS positives,
  round(CAST(count(*) FILTER (isFraud = 0) AS DOUBLE)
    / greatest(count(*) FILTER (isFraud = 1), 1), 6) AS positive_weight
FROM txn WHERE step <= 500"""
    ),
    "threshold_sweep": _q(_sweep((0.1, 0.3, 0.5, 0.7)), _SCORED),
    "predictions": _q(
        "SELECT event_id, CAST(risk_score >= 0.1 AS INTEGER) AS prediction FROM scored", _SCORED
    ),
    "confusion": _q(_sweep((0.5,)), _SCORED),
    "class_report": _q(
        """
SELECT 'Legitimate' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall,
  round(f0, 6) AS f1, n0 AS support FROM rep
UNION ALL SELECT 'Fraud', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM rep
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tp + tn AS DOUBLE) / n, 6), n FROM rep
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6),
  round((f0 + f1) / 2, 6), n FROM rep
UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / n, 6),
  round((r0 * n0 + r1 * n1) / n, 6), round((f0 * n0 + f1 * n1) / n, 6), n FROM rep""",
        _SCORED,
        _COUNTS4,
    ),
    "average_precision": _q(
        "SELECT round(sum(pos * (tp / seen)) / max(all_pos), 8) AS pr_auc FROM curve",
        _SCORED,
        _CURVE,
    ),
    "pr_curve": _q(
        """
SELECT threshold, round(tp / seen, 6) AS precision, round(tp / all_pos, 6) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0""",
        _SCORED,
        _CURVE,
    ),
    "best_f1": _q(
        """
SELECT threshold AS best_threshold, round(2 * tp / (seen + all_pos), 6) AS best_f1 FROM curve
ORDER BY 2 * tp / (seen + all_pos) DESC, threshold LIMIT 1""",
        _SCORED,
        _CURVE,
    ),
    "monitor_summary": _q(
        """
SELECT status, window_size, round(score_mean, 6) AS score_mean, round(score_p95, 6) AS score_p95,
  round(score_p99, 6) AS score_p99, round(CAST(b AS DOUBLE) / n, 6) AS block_rate,
  round(CAST(r AS DOUBLE) / n, 6) AS review_rate, round(CAST(a AS DOUBLE) / n, 6) AS approve_rate,
  round(latency_p50_ms, 6) AS latency_p50_ms, round(latency_p99_ms, 6) AS latency_p99_ms,
  a AS approve_count, r AS review_count, b AS block_count
FROM summary, life""",
        _SCORED,
        _SUMMARY.format(window=5000),
    ),
    "distinct_parties_by_day": _q(
        """
SELECT CAST((step - 1) // 24 AS BIGINT) AS period, count(*) AS rows,
  count(DISTINCT nameOrig) AS exact_senders, count(DISTINCT nameDest) AS exact_receivers,
  true AS within
FROM txn GROUP BY 1"""
    ),
    "percentiles_by_day": _q(
        "SELECT CAST((step - 1) // 24 AS BIGINT) AS period, count(*) AS rows, "
        + ", ".join(
            f"true AS {v}_{p}_within" for v in ("risk_score", "latency_ms") for p in ("p50", "p95", "p99")
        )
        + " FROM scored GROUP BY 1",
        _SCORED,
    ),
    "fraud_rings": _q(
        """
SELECT CAST(period AS BIGINT) AS period, ring, count(*) AS accounts, any_value(frauds) AS frauds,
  any_value(amount) AS amount
FROM rings JOIN labelled USING (period, ring) GROUP BY ALL""",
        _RINGS,
    ).replace("WITH", "WITH RECURSIVE", 1),
    "ring_members": _q(
        """
SELECT CAST(period AS BIGINT) AS period, ring, node AS account
FROM rings JOIN labelled USING (period, ring)""",
        _RINGS,
    ).replace("WITH", "WITH RECURSIVE", 1),
    "payment_degrees": _q(
        """
SELECT account, count(*) FILTER (sent) AS sent_to, count(*) FILTER (NOT sent) AS received_from
FROM (SELECT DISTINCT nameOrig AS account, nameDest AS other, true AS sent FROM txn
    WHERE type IN ('TRANSFER', 'CASH_OUT') AND nameOrig <> nameDest
  UNION SELECT DISTINCT nameDest, nameOrig, false FROM txn
    WHERE type IN ('TRANSFER', 'CASH_OUT') AND nameOrig <> nameDest)
GROUP BY account"""
    ),
    "cash_out_chains": _q(_CHAINS),
    "cash_out_chains_hot": _q(_CHAINS),
    "asof_last_received": _q(_LAST_RECEIVED),
    "asof_last_received_hot": _q(_LAST_RECEIVED),
    "asof_step_profile": _q(
        """
SELECT event_id, sent_count, CAST(sent_cents AS BIGINT) AS sent_cents
FROM txn AS a ASOF LEFT JOIN (
  SELECT nameOrig, step, count(*) AS sent_count, sum(CAST(round(amount * 100) AS BIGINT))
    AS sent_cents FROM txn GROUP BY nameOrig, step) AS p
  ON a.nameOrig = p.nameOrig AND a.step > p.step"""
    ),
    "rolling_hour": _q(_rolling(1), _TIMED),
    "rolling_day_hot": _q(_rolling(24), _TIMED),
    "median_scores": _q(_MEDIAN_SCORES, _CENTRES),
    "monitor_points": _q(
        """
SELECT rows_seen, 'ok' AS status, window_size, round(score_mean, 6) AS score_mean,
  round(score_p95, 6) AS score_p95, round(score_p99, 6) AS score_p99,
  round(CAST(b AS DOUBLE) / rows_seen, 6) AS block_rate,
  round(CAST(r AS DOUBLE) / rows_seen, 6) AS review_rate,
  round(CAST(a AS DOUBLE) / rows_seen, 6) AS approve_rate,
  round(latency_p50_ms, 6) AS latency_p50_ms, round(latency_p99_ms, 6) AS latency_p99_ms,
  a AS approve_count, r AS review_count, b AS block_count
FROM looks""",
        _SCORED, _POINTS,
    ),
    "stream_alerts": _q(
        """
SELECT rows_seen, 'block_rate' AS alert, round(CAST(b AS DOUBLE) / rows_seen, 6) AS value,
  CAST(0.01 AS DOUBLE) AS "limit"
FROM looks WHERE CAST(b AS DOUBLE) / rows_seen > 0.001::DOUBLE * 10
UNION ALL
SELECT rows_seen, 'latency', round(latency_p99_ms, 6), CAST(100 AS DOUBLE)
FROM looks WHERE CAST(b AS DOUBLE) / rows_seen <= 0.001::DOUBLE * 10 AND latency_p99_ms > 100""",
        _SCORED, _POINTS,
    ),
    "stream_drift": _q(
        """
SELECT CAST(split_part(feature, ' ', 1) AS BIGINT) AS "window",
  count(*) FILTER (p < 0.05) / 10.0::DOUBLE > 0.05 AS is_drifted,
  count(*) FILTER (p < 0.05) / 10.0::DOUBLE AS drift_ratio,
  coalesce(string_agg(f, ',' ORDER BY i) FILTER (p < 0.05), '') AS drifted_features,
  max(m) AS current_size, max(n) AS reference_size
FROM ks JOIN (VALUES """
        + ", ".join(f"({i}, '{f}')" for i, f in enumerate(FEATURES))
        + """) AS t(i, f) ON split_part(feature, ' ', 2) = f
GROUP BY 1""",
        _SCORED, _BY_ROLE, _FEAT, _WINDOWED, _WINDOWED_KS,
    ),
    "monitor_alert": _q(
        """
SELECT 'block_rate' AS alert, round(CAST(b AS DOUBLE) / n, 6) AS value,
  CAST(0.01 AS DOUBLE) AS "limit",
  printf('block rate %.2f%% is over %.2f%%', 100 * CAST(b AS DOUBLE) / n, 1.0::DOUBLE) AS message
FROM summary, life WHERE CAST(b AS DOUBLE) / n > 0.001::DOUBLE * 10""",
        _SCORED,
        _SUMMARY.format(window=10000),
    ),
    "latency_alert": _q(
        """
SELECT 'latency' AS alert, round(latency_p99_ms, 6) AS value, CAST(100 AS DOUBLE) AS "limit",
  printf('p99 latency %.1f ms is over %.1f ms', latency_p99_ms, 100.0::DOUBLE) AS message
FROM summary WHERE latency_p99_ms > 100""",
        _SCORED,
        _SUMMARY.format(window=10000),
    ),
    "progress_batches": _q(
        """
SELECT CAST((batch + 1) * 1000 AS BIGINT) AS processed, CAST(max(hits) AS BIGINT) AS flagged,
  max(latency_ms) FILTER (place = 10) AS p99_latency_ms
FROM (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY latency_ms DESC) AS place FROM (
    SELECT latency_ms, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch,
      sum(CASE WHEN decision IN ('REVIEW', 'BLOCK') THEN 1 ELSE 0 END)
        OVER (ORDER BY event_id) AS hits
    FROM scored))
GROUP BY batch HAVING count(*) = 1000""",
        _SCORED,
    ),
    "ks_by_feature": _q(
        """
SELECT feature, round(d, 4) AS ks_stat, round(p, 6) AS p_value, n AS reference_rows,
  m AS current_rows, p < 0.05 AS drifted FROM ks WHERE feature <> 'risk_score'""",
        _SCORED, _BY_ROLE, _FEAT, _LONG_FEAT, _KS,
    ),
    "score_drift": _q(
        """
SELECT feature, round(d, 4) AS ks_stat, round(p, 6) AS p_value, n AS reference_rows,
  m AS current_rows, p < 0.05 AS drifted FROM ks WHERE feature = 'risk_score'""",
        _SCORED, _BY_ROLE, _FEAT, _LONG_FEAT, _KS,
    ),
    "chi2_dummies": _q(
        "SELECT feature, round(x, 4) AS chi2, round(p, 6) AS p_value, p < 0.05 AS drifted "
        "FROM chi2",
        _SCORED, _BY_ROLE, _FEAT, _LONG_FEAT, _CHI2,
    ),
    "drift_by_column": _q(
        f"""
SELECT feature, 'ks' AS test, round(d, 4) AS statistic, round(p, 6) AS p_value,
  p < 0.05 AS drifted FROM ks WHERE feature NOT IN ({", ".join(f"'{d}'" for d in DUMMIES)})
UNION ALL
SELECT feature, 'chi2', round(x, 4), round(p, 6), p < 0.05 FROM chi2""",
        _SCORED, _BY_ROLE, _FEAT, _LONG_FEAT, _KS, _CHI2,
    ),
    "drift_summary": _q(
        f"""
SELECT (SELECT count(*) FROM hits) / 10.0::DOUBLE > 0.3 AS is_drifted,
  (SELECT count(*) FROM hits) / 10.0::DOUBLE AS drift_ratio,
  (SELECT coalesce(string_agg(feature, ',' ORDER BY i), '') FROM hits) AS drifted_features,
  (SELECT count(*) FROM txn WHERE step > 500) AS current_size,
  (SELECT count(*) FROM txn WHERE step <= 500) AS reference_size""",
        _SCORED, _BY_ROLE, _FEAT, _MOVED, _LONG.format(source="moved"), _KS,
        f"hits AS ({_ORDERED_HITS})",
    ),
    "retrain_trigger": _q(
        """
SELECT count(*) / 10.0::DOUBLE > 0.3 AS retrain,
  CASE WHEN count(*) / 10.0::DOUBLE > 0.3 THEN 'drift' END AS trigger,
  count(*) / 10.0::DOUBLE AS drift_score
FROM hits""",
        _SCORED, _BY_ROLE, _FEAT, _MOVED, _LONG.format(source="moved"), _KS,
        f"hits AS ({_ORDERED_HITS})",
    ),
    "ap_by_bucket": _q("SELECT period, pr_auc FROM daily", _SCORED, _DAILY),
    "promotion_rule": _q(
        "SELECT version, pr_auc, round(improvement, 6) AS improvement, promoted FROM judged_runs",
        _SCORED,
        _DAILY,
    ),
    "champion_lookup": _q(
        "SELECT version, pr_auc FROM judged_runs WHERE promoted ORDER BY period DESC LIMIT 1",
        _SCORED,
        _DAILY,
    ),
    "next_version": _q(
        "SELECT 'v' || (max(CAST(substr(version, 2) AS INTEGER)) + 1) AS next_version FROM runs",
        _SCORED,
        _DAILY,
    ),
    "retrain_window": _q(
        """
SELECT count(*) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds FROM txn
WHERE step <= 500 AND step >= greatest(1, (SELECT max(step) FROM txn WHERE step <= 500) - 200)"""
    ),
}
