"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

# Receipt lines; {period} is the period expression.
_LINES = """
lines AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) AS receipt_id,
    CAST(l_partkey AS VARCHAR) AS product_id,
    CAST(l_extendedprice AS DECIMAL(8,2)) AS line_total,
    CASE WHEN l_partkey % 4 = 0 THEN l_quantity END AS weight,
    'S' || CAST(o_custkey % 10 AS VARCHAR) AS store_id,
    strftime(o_orderdate, '%Y%m%d') AS date_str,
    lpad(CAST(8 + o_orderkey % 13 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(o_orderkey * 7 % 60 AS VARCHAR), 2, '0') AS time_str,
    'C' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') AS cashier_id,
    lpad(substr(o_orderpriority, 1, 1), 2, '0') AS payment_method_code,
    CAST(l_extendedprice AS DECIMAL(8,2)) * CAST(l_discount AS DECIMAL(4,2)) AS total_discounts,
    CAST(0 AS INTEGER) AS points_redeemed,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS self_scan,
    CAST(8 + o_orderkey % 13 AS INTEGER) AS hour_of_day,
    o_orderkey % 40 = 0 AS is_abort,
    l_returnflag = 'R' AND l_linestatus = 'F' AS is_item_void,
    false AS is_void,
    l_discount = 0 AS is_gift,
    CAST(o_orderdate AS DATE) AS order_day,
    {period} AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

def _mean(column: str, count: str, unit: int) -> str:
    """A mean of whole numbers of ``unit`` parts, rounded to four digits, half up, in whole numbers."""
    total = f"CAST(round({column} * {count} * CAST({unit} AS DOUBLE)) AS BIGINT)"
    up = f"((abs({total}) * 20000 + {count} * {unit}) // ({count} * {2 * unit}))"
    return f"sign({total}) * CAST({up} AS DOUBLE) / CAST(10000 AS DOUBLE) AS {column}"


# Exact median of a column per group: the mean of the two middle rows.
_PRICES = """,
ranked AS (
  SELECT period, product_id, line_total,
    row_number() OVER (PARTITION BY period, product_id ORDER BY line_total) AS rn,
    count(*) OVER (PARTITION BY period, product_id) AS n
  FROM lines
),
prices AS (
  SELECT period, product_id, max(n) AS priced_lines,
    (max(line_total) FILTER (WHERE rn = (n + 1) // 2)
      + max(line_total) FILTER (WHERE rn = n // 2 + 1)) * CAST(0.5 AS DECIMAL(2,1)) AS standard
  FROM ranked GROUP BY period, product_id
),
priced AS (
  SELECT l.*, p.standard,
    l.line_total < p.standard AS is_discounted,
    CAST(l.line_total - p.standard AS DOUBLE) AS price_delta,
    CASE WHEN l.weight > 0 THEN CAST(l.line_total AS DOUBLE) / l.weight
      ELSE CAST(l.line_total AS DOUBLE) END AS avg_unit_price
  FROM lines l JOIN prices p ON l.period = p.period AND l.product_id = p.product_id
)"""

_BASKETS = """,
summed AS (
  SELECT period, receipt_id,
    CAST(sum(line_total) AS DOUBLE) AS basket_value,
    count(*) AS basket_size,
    bool_or(coalesce(weight, 0) > 0) AS has_fresh_produce,
    CAST(sum(CAST(is_discounted AS INTEGER)) AS BIGINT) AS discounted_item_count,
    CAST(coalesce(sum(weight) FILTER (WHERE weight > 0), 0) AS DOUBLE) AS fresh_weight_sum,
    CAST(sum(coalesce(weight, 0)) AS DOUBLE) AS total_weight,
    CAST(sum(CAST(is_item_void AS INTEGER)) AS BIGINT) AS total_voids,
    CAST(abs(coalesce(sum(line_total) FILTER (WHERE is_item_void), 0)) AS DOUBLE) AS void_value,
    CAST(coalesce(sum(line_total) FILTER (WHERE weight > 0), 0) AS DOUBLE) AS fresh_value_sum,
    avg(avg_unit_price) AS avg_basket_unit_price,
    avg(price_delta) AS avg_price_delta_per_basket,
    min(hour_of_day) AS hour_of_day,
    min(order_day) AS order_day,
    min(cashier_id) AS cashier_id,
    min(store_id) AS store_id
  FROM priced GROUP BY period, receipt_id
),
baskets AS (
  SELECT period, receipt_id, basket_value, basket_size, has_fresh_produce, discounted_item_count,
    fresh_weight_sum, total_weight, total_voids, void_value, fresh_value_sum,
    {unit_price},
    {price_delta},
    hour_of_day,
    CAST(isodow(order_day) IN (6, 7) AS TINYINT) AS is_weekend,
    CAST('0x' || substr(md5(store_id), 1, 8) AS BIGINT) % 1000 AS store_numeric,
    CASE WHEN hour_of_day BETWEEN 12 AND 14 OR hour_of_day BETWEEN 18 AND 20
      THEN 1 ELSE 0 END AS peak_hour_pressure_numeric,
    cashier_id, store_id,
    CAST(basket_size = 1 AS TINYINT) AS is_single_item_flag,
    basket_value / basket_size AS basket_value_per_item,
    CAST(total_voids AS DOUBLE) / basket_size AS void_rate_per_receipt,
    CAST(discounted_item_count AS DOUBLE) / basket_size AS discount_ratio,
    fresh_weight_sum / (total_weight + CAST(0.000001 AS DOUBLE)) AS freshness_weight_ratio,
    fresh_value_sum / (basket_value + CAST(0.000001 AS DOUBLE)) AS freshness_value_ratio,
    void_value / (basket_value + void_value + CAST(0.000001 AS DOUBLE)) AS leakage_pct
  FROM summed
)""".replace("{unit_price}", _mean("avg_basket_unit_price", "basket_size", 1_000_000)).replace(
    "{price_delta}", _mean("avg_price_delta_per_basket", "basket_size", 200)
)

_FINGERPRINT_MEANS = ", ".join(
    _mean(column, "total_transactions", unit)
    for column, unit in (
        ("avg_transaction_value", 100), ("void_rate_per_receipt", 1), ("abort_rate", 1), ("cash_reliance_ratio", 1),
    )
)

# The lines with missing and malformed values.
_DIRTY = _LINES.replace("lines AS (", "clean AS (") + """,
lines AS (
  SELECT * REPLACE (
    CASE WHEN CAST(product_id AS INTEGER) % 12 = 0 THEN CAST('nan' AS DOUBLE)
      WHEN CAST(product_id AS INTEGER) % 20 <> 0 THEN weight END AS weight,
    CASE WHEN CAST(product_id AS INTEGER) % 5 <> 0 THEN cashier_id END AS cashier_id,
    CASE WHEN CAST(product_id AS INTEGER) % 6 <> 0 THEN payment_method_code END AS payment_method_code,
    CASE WHEN CAST(product_id AS INTEGER) % 7 = 0 THEN 'bad'
      WHEN CAST(product_id AS INTEGER) % 11 <> 0 THEN date_str END AS date_str,
    CASE WHEN CAST(product_id AS INTEGER) % 9 = 0 THEN 'xx:yy'
      WHEN CAST(product_id AS INTEGER) % 13 <> 0 THEN time_str END AS time_str
  ) FROM clean
)"""

_ALL = "'ALL'"
_YEAR = "CAST(year(o_orderdate) AS VARCHAR)"

_B2B = (
    "basket_size > 30 OR (basket_size > 10 AND basket_value_per_item > 150)"
)


def _with(body: str, *parts: str, period: str = _ALL) -> str:
    # the period expression is the only placeholder of the shared parts
    return "WITH " + "".join(parts).replace("{period}", period) + body


_L = (_LINES,)
_P = (_LINES, _PRICES)
_B = (_LINES, _PRICES, _BASKETS)

# The given segment model: distances to its centres, in standardised units.
_ASSIGNED = f""",
points AS (
  SELECT *, (basket_size - CAST(4.0 AS DOUBLE)) / CAST(2.0 AS DOUBLE) AS a,
    (basket_value_per_item - CAST(52000.0 AS DOUBLE)) / CAST(20000.0 AS DOUBLE) AS b,
    (freshness_weight_ratio - CAST(0.65 AS DOUBLE)) / CAST(0.5 AS DOUBLE) AS c
  FROM baskets
),
centers(cluster, x, y, z) AS (VALUES
  (0, CAST(-1.0 AS DOUBLE), CAST(-0.8 AS DOUBLE), CAST(-1.3 AS DOUBLE)),
  (1, -1.0, 0.9, -1.3), (2, -0.6, 0.2, 0.7), (3, 0.5, 0.0, 0.7), (4, 6.0, -0.1, 0.2)
),
named_centers AS (
  SELECT *, CASE WHEN x * 2.0 + 4.0 > 15 THEN 'B2B / Bulk Outlier'
    WHEN x * 2.0 + 4.0 > 5 THEN 'Weekly Stock-up'
    WHEN z * 0.5 + 0.65 > 0.3 THEN 'Daily Fresh Pick'
    WHEN x * 2.0 + 4.0 <= 2.5 AND y * 20000 + 52000 > 45 THEN 'Premium/Specialty Single-Item'
    WHEN x * 2.0 + 4.0 <= 2.5 AND y * 20000 + 52000 < 12 THEN 'Quick Convenience'
    ELSE 'Standard Mixed Trip' END AS name
  FROM centers
),
nearest AS (
  SELECT period, receipt_id, basket_value, basket_size, basket_value_per_item, cluster, name,
    row_number() OVER (PARTITION BY period, receipt_id ORDER BY
      (a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z), cluster) AS rn
  FROM points, named_centers
),
assigned AS (
  SELECT period, receipt_id, basket_value, basket_size, cluster,
    CASE WHEN {_B2B} THEN 'B2B / Bulk Outlier' ELSE name END AS shopping_mission
  FROM nearest WHERE rn = 1
)"""

_INSIGHTS = _ASSIGNED + """,
insights AS (
  SELECT period, shopping_mission, count(*) AS receipt_count,
    sum(basket_value) AS revenue,
    round(avg(basket_value), 2) AS avg_trip_value,
    round(avg(basket_size), 2) AS avg_items_per_trip
  FROM assigned GROUP BY period, shopping_mission
),
shares AS (
  SELECT period, shopping_mission, receipt_count, round(revenue, 2) AS total_mission_revenue,
    avg_trip_value, avg_items_per_trip,
    round(revenue / sum(revenue) OVER (PARTITION BY period) * 100, 3) AS revenue_share_pct,
    round(CAST(receipt_count AS DOUBLE) / sum(receipt_count) OVER (PARTITION BY period) * 100, 3)
      AS traffic_share_pct
  FROM insights
)"""

_CASHIER_SCORES = """,
rates AS (
  SELECT period, cashier_id, avg(discount_ratio) AS rate FROM baskets
  GROUP BY period, cashier_id HAVING count(*) >= 2
),
cashier_scores AS (
  SELECT period, cashier_id,
    CASE WHEN peers < 2 THEN 0.0
      ELSE (rate - mean) / coalesce(nullif(std, 0), 0.001) END AS z
  FROM (SELECT *, count(*) OVER p AS peers, avg(rate) OVER p AS mean,
      stddev_samp(rate) OVER p AS std FROM rates WINDOW p AS (PARTITION BY period))
)"""

_ALERTS = _CASHIER_SCORES + """,
alerts AS (
  SELECT period, cashier_id, CAST(-1 AS TINYINT) AS flag, round(z, 6) AS z
  FROM cashier_scores WHERE z > 1.5
)"""

_SHOWN_ALERTS = """ SELECT period, cashier_id, flag AS cashier_sweethearting_anomaly_score,
  z AS cashier_sweethearting_z_score FROM alerts"""

_FINGERPRINTS = """,
cashier_receipts AS (
  SELECT period, cashier_id, receipt_id, CAST(sum(line_total) AS DOUBLE) AS receipt_value,
    sum(CAST(is_item_void AS INTEGER)) AS voids,
    max(CAST(is_abort AS INTEGER)) AS aborted,
    min(payment_method_code) AS pay_code
  FROM lines GROUP BY period, cashier_id, receipt_id
),
fingerprints AS (
  SELECT period, cashier_id, count(*) AS total_transactions,
    avg(receipt_value) AS avg_transaction_value,
    avg(voids) AS void_rate_per_receipt,
    avg(aborted) AS abort_rate,
    avg(CASE WHEN pay_code = '01' THEN 1 ELSE 0 END) AS cash_reliance_ratio
  FROM cashier_receipts GROUP BY period, cashier_id HAVING count(*) > 10
)"""

_RISKS = _FINGERPRINTS + """,
risks AS (
  SELECT *,
    0.1 * coalesce(abs((avg_transaction_value - avg(avg_transaction_value) OVER p)
      / (stddev_samp(avg_transaction_value) OVER p + 1e-6)), 0)
    + 0.4 * coalesce(abs((void_rate_per_receipt - avg(void_rate_per_receipt) OVER p)
      / (stddev_samp(void_rate_per_receipt) OVER p + 1e-6)), 0)
    + 0.2 * coalesce(abs((abort_rate - avg(abort_rate) OVER p)
      / (stddev_samp(abort_rate) OVER p + 1e-6)), 0)
    + 0.3 * coalesce(abs((cash_reliance_ratio - avg(cash_reliance_ratio) OVER p)
      / (stddev_samp(cash_reliance_ratio) OVER p + 1e-6)), 0) AS risk
  FROM fingerprints WINDOW p AS (PARTITION BY period)
)"""

_SHOWN_RISKS = f""" SELECT period, cashier_id, total_transactions, {_FINGERPRINT_MEANS},
  round(risk, 6) AS risk_score
FROM risks"""

_LEAKAGE = """,
leakage AS (
  SELECT period, cashier_id,
    CAST(sum(total_discounts) AS DOUBLE) AS total_markdowns,
    CAST(sum(CAST(is_item_void AS INTEGER)) AS BIGINT) AS total_voids,
    CAST(sum(line_total) AS DOUBLE) AS captured_revenue,
    CAST(sum(total_discounts) AS DOUBLE) / CAST(sum(line_total) AS DOUBLE) AS leakage_pct
  FROM lines GROUP BY period, cashier_id
)"""

_PRODUCE = """, weighed AS (
  SELECT *, CAST(line_total AS DOUBLE) / weight AS unit_price,
    row_number() OVER (PARTITION BY period, product_id
      ORDER BY CAST(line_total AS DOUBLE) / weight) AS rn,
    count(*) OVER (PARTITION BY period, product_id) AS n
  FROM lines WHERE weight > 0 AND line_total > 0
), centers AS (
  SELECT period, product_id,
    (max(unit_price) FILTER (WHERE rn = (n + 1) // 2)
      + max(unit_price) FILTER (WHERE rn = n // 2 + 1)) * CAST(0.5 AS DOUBLE) AS med
  FROM weighed GROUP BY period, product_id
), deviations AS (
  SELECT w.*, abs(unit_price - med) AS d,
    row_number() OVER (PARTITION BY w.period, w.product_id
      ORDER BY abs(unit_price - med)) AS drn
  FROM weighed w JOIN centers c ON w.period = c.period AND w.product_id = c.product_id
), spreads AS (
  SELECT period, product_id,
    (max(d) FILTER (WHERE drn = (n + 1) // 2)
      + max(d) FILTER (WHERE drn = n // 2 + 1)) * CAST(0.5 AS DOUBLE) AS mad
  FROM deviations GROUP BY period, product_id
)
SELECT d.period, d.date_str, d.receipt_id, d.product_id AS "scontrinoBarcode",
  'Peso/Prezzo Errante' AS "scontrinoTipo", d.store_id
FROM deviations d JOIN spreads s ON d.period = s.period AND d.product_id = s.product_id
WHERE mad > 0 AND d / (mad * CAST(1.4826 AS DOUBLE)) > 6"""

_SCALED = """,
inputs AS (
  SELECT period, receipt_id, basket_value AS y,
    CAST(basket_size AS DOUBLE) AS x0, basket_value_per_item AS x1, freshness_weight_ratio AS x2
  FROM baskets
),
scaled AS (
  SELECT period, receipt_id, y,
    (x0 - avg(x0) OVER p) / stddev_pop(x0) OVER p AS x0,
    (x1 - avg(x1) OVER p) / stddev_pop(x1) OVER p AS x1,
    (x2 - avg(x2) OVER p) / stddev_pop(x2) OVER p AS x2
  FROM inputs WINDOW p AS (PARTITION BY period)
)"""


def _validation() -> str:
    checked = [
        ("basket_value", "Fatturato (Basket Value)", "mission clustering"),
        ("freshness_weight_ratio", "Incidenza Peso Freschissimi", "mission clustering"),
        ("freshness_value_ratio", "Incidenza Valore Freschissimi", "mission clustering"),
        ("leakage_pct", "Percentuale Perdita (Leakage)", "cashier risk"),
        ("void_rate_per_receipt", "Tasso Storni", "cashier risk"),
        ("total_voids", "Totale Articoli Stornati", "cashier risk"),
    ]
    rows = [
        f"""SELECT period, '{metric}' AS metric, '{name}' AS business_name,
          round(CAST(sum({metric}) AS DOUBLE), 4) AS total, round(avg({metric}), 4) AS avg,
          CASE WHEN sum({metric}) = 0 THEN 'ZERO_ALERT' ELSE 'OK' END AS status,
          CASE WHEN sum({metric}) = 0 THEN '{area}' END AS impact
        FROM baskets GROUP BY period"""
        for metric, name, area in checked
    ]
    return " UNION ALL ".join(rows)


def _moments() -> str:
    sums = ["count(*) AS n", "round(sum(y) / 1e6, 3) AS y", "round(sum(y * y) / 1e12, 3) AS yy"]
    for i in range(3):
        sums += [f"round(sum(x{i}), 3) AS x{i}", f"round(sum(x{i} * y) / 1e6, 3) AS x{i}y"]
        sums += [f"round(sum(x{i} * x{j}), 3) AS x{i}x{j}" for j in range(i, 3)]
    return (
        "SELECT period, CAST('0x' || substr(md5(receipt_id), 1, 8) AS BIGINT) % 5 AS fold, "
        + ", ".join(sums)
        + " FROM scaled GROUP BY 1, 2"
    )


# The year, unknown for orders of February; a null period is a group like any other.
_SPOILT_YEAR = "CASE WHEN month(o_orderdate) <> 2 THEN CAST(year(o_orderdate) AS VARCHAR) END"
_NULLSAFE_B = tuple(part.replace("l.period = p.period", "l.period IS NOT DISTINCT FROM p.period") for part in _B)


def _severity(score: str) -> str:
    """Severity of a score of ``baskets`` by the 1 % and 5 % order statistics of each period, null among them."""
    return f""", scores AS (
          SELECT period, receipt_id, {score} AS anomaly_score FROM baskets
        ), placed AS (
          SELECT period, receipt_id, anomaly_score,
            row_number() OVER (PARTITION BY period ORDER BY anomaly_score) AS rn,
            count(*) OVER (PARTITION BY period) AS n
          FROM scores
        ), limits AS (
          SELECT period,
            max(anomaly_score) FILTER (WHERE rn = round(0.01 * (n - 1)) + 1) AS q01,
            max(anomaly_score) FILTER (WHERE rn = round(0.05 * (n - 1)) + 1) AS q05
          FROM placed GROUP BY period
        )
        SELECT p.period, receipt_id, anomaly_score,
          CASE WHEN anomaly_score <= q01 THEN 'critical' WHEN anomaly_score <= q05 THEN 'warning'
            ELSE 'info' END AS severity
        FROM placed p JOIN limits l ON p.period IS NOT DISTINCT FROM l.period"""


def _given_forest() -> str:
    """Path scores of the given trees: two for years before 1995, two for the others."""
    values = ("basket_size", "basket_value_per_item", "freshness_weight_ratio")
    trees = [
        ((0, 4.0), (1, 40_000.0), (2, 0.5), (3.0, 5.5, 6.25, 2.0)),
        ((1, 60_000.0), (0, 2.0), (2, 0.9), (6.0, 4.5, 2.5, 3.75)),
        ((2, 0.2), (1, 30_000.0), (0, 6.0), (2.25, 5.0, 6.5, 3.0)),
        ((0, 3.0), (0, 1.0), (1, 50_000.0), (1.5, 4.0, 5.25, 2.75)),
    ]

    def depth(top, left, right, leaves):
        above = lambda node: f"{values[node[0]]} > {node[1]}"
        return (
            f"CASE WHEN {above(top)} THEN CASE WHEN {above(right)} THEN {leaves[3]} ELSE {leaves[2]} END "
            f"ELSE CASE WHEN {above(left)} THEN {leaves[1]} ELSE {leaves[0]} END END"
        )

    early, late = (" + ".join(f"({depth(*t)})" for t in part) for part in (trees[:2], trees[2:]))
    mean = f"2 * (2 * (ln(63) + {0.5772156649015329}) - {2 * 63 / 64})"
    total = f"CAST(CASE WHEN period < '1995' THEN {early} ELSE {late} END AS DOUBLE)"
    return f"round(0.5 - pow(2, -({total}) / ({mean})), 9)"


def _vif_by_period() -> str:
    return """, r AS (
          SELECT period, corr(basket_size, basket_value_per_item) AS a,
            corr(basket_size, freshness_weight_ratio) AS b,
            corr(basket_value_per_item, freshness_weight_ratio) AS c
          FROM baskets GROUP BY period
        ), factors AS (
          SELECT period, unnest(['basket_size', 'basket_value_per_item', 'freshness_weight_ratio']) AS feature,
            unnest([1 - c * c, 1 - b * b, 1 - a * a])
              / (1 + 2 * a * b * c - a * a - b * b - c * c) AS vif
          FROM r
        )
        SELECT period, feature, round(vif, 6) AS vif,
          CASE WHEN vif < 5 THEN 'PASS' ELSE 'HIGH COLLINEARITY' END AS status
        FROM factors"""


def _validation_of_partial() -> str:
    rows = _validation().split(" UNION ALL ")
    missing = """SELECT period, 'leakage_pct' AS metric, 'Percentuale Perdita (Leakage)' AS business_name,
          CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS avg, 'MISSING_COLUMN' AS status, NULL AS impact
        FROM baskets GROUP BY period"""
    zero = """SELECT period, 'total_voids' AS metric, 'Totale Articoli Stornati' AS business_name,
          CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS avg, 'ZERO_ALERT' AS status, 'cashier risk' AS impact
        FROM baskets GROUP BY period"""
    kept = [r for r in rows if "'leakage_pct'" not in r and "'total_voids'" not in r]
    return " UNION ALL ".join([*kept, missing, zero])


# The ragged text files of the stores from S3 on; the others are parquet.
_CSV = """, numbered AS (
          SELECT *, CAST(product_id AS INTEGER) AS n, CASE WHEN store_id < 'S3' THEN 'parquet' ELSE 'csv' END AS format
          FROM lines
        ), parsed AS (
          SELECT receipt_id, product_id, cashier_id, store_id, format,
            CASE WHEN format = 'parquet' OR (n % 17 <> 0 AND n % 23 <> 0) THEN CAST(line_total AS DOUBLE) END AS line_total,
            CASE WHEN format = 'parquet' OR n % 17 <> 0 THEN date_str END AS date_str,
            CASE WHEN format = 'parquet' THEN NULL WHEN n % 17 = 0 THEN 'short' WHEN n % 19 = 0 THEN 'long'
              WHEN n % 23 = 0 THEN 'unparseable' END AS problem
          FROM numbered
        )"""

_MD5_MOD_100 = "CAST('0x' || substr(md5(receipt_id), 1, 8) AS BIGINT) % 100"
for _start in (9, 17, 25):
    _MD5_MOD_100 = (
        f"(({_MD5_MOD_100}) * 96 + CAST('0x' || substr(md5(receipt_id), {_start}, 8) AS BIGINT)) % 100"
    )

ORACLE_SQL: dict[str, str] = {
    "scan_period": _with(
        """ SELECT receipt_id, product_id, CAST(line_total AS DOUBLE) AS line_total, weight, store_id,
          date_str, cashier_id
        FROM lines WHERE year(order_day) = 1997 AND month(order_day) BETWEEN 3 AND 5
          AND day(order_day) BETWEEN 1 AND 15""",
        *_L,
    ),
    "scan_layout": _with(
        """ SELECT CASE WHEN substr(store_id, 2) < '5' THEN '382' ELSE '500' END AS area,
          strftime(order_day, '%Y-%m') AS period, receipt_id, product_id,
          CAST(line_total AS DOUBLE) AS line_total, store_id
        FROM lines WHERE year(order_day) = 1997 AND month(order_day) BETWEEN 3 AND 5
          AND day(order_day) BETWEEN 1 AND 15""",
        *_L,
    ),
    "csv_lines": _with(
        " SELECT receipt_id, product_id, cashier_id, line_total, date_str, problem, format FROM parsed", *_L, _CSV
    ),
    "csv_quality": _with(
        """ SELECT store_id, format, count(*) AS line_count,
          count(*) FILTER (WHERE line_total IS NOT NULL AND date_str IS NOT NULL) AS complete_count,
          count(*) FILTER (WHERE problem = 'short') AS short_count,
          count(*) FILTER (WHERE problem = 'long') AS long_count,
          count(*) FILTER (WHERE problem = 'unparseable') AS unparseable_count
        FROM parsed GROUP BY store_id, format""",
        *_L,
        _CSV,
    ),
    "preview_lines": _with(
        """ SELECT receipt_id, product_id, CAST(line_total AS DOUBLE) AS line_total FROM lines
        ORDER BY receipt_id, line_total, product_id LIMIT 5""",
        *_L,
    ),
    "validate_partial": _with(" " + _validation_of_partial(), *_B, period=_YEAR),
    "receipts_without_cashier": _with(
        """ SELECT receipt_id, 'N/A' AS cashier_id, CAST(0 AS DOUBLE) AS cashier_sweethearting_z_score,
          CAST(0 AS TINYINT) AS cashier_sweethearting_anomaly_score FROM baskets""",
        *_B,
    ),
    "mission_reuse": _with(" SELECT period, receipt_id, shopping_mission FROM assigned", *_B, _ASSIGNED, period=_YEAR),
    "dirty_period_missions": _with(
        " SELECT period, shopping_mission, count(*) AS receipt_count FROM assigned GROUP BY period, shopping_mission",
        *_NULLSAFE_B,
        _ASSIGNED,
        period=_SPOILT_YEAR,
    ),
    "dirty_period_severity": _with(_severity("basket_value_per_item"), *_NULLSAFE_B, period=_SPOILT_YEAR),
    "forest_severity": _with(_severity(_given_forest()), *_B, period=_YEAR),
    "lasso_moments_by_period": _with(" " + _moments(), *_B, _SCALED, period=_YEAR),
    "vif_by_period": _with(_vif_by_period(), *_B, period=_YEAR),
    "consensus_correlations": _with(
        """, relations AS (
          SELECT period, unnest(['basket_size', 'basket_value_per_item', 'freshness_weight_ratio']) AS feature,
            unnest([corr(x0, y), corr(x1, y), corr(x2, y)]) AS r,
            unnest([covar_pop(x0, y), covar_pop(x1, y), covar_pop(x2, y)]) AS c
          FROM scaled GROUP BY period
        ), forest AS (
          SELECT period, feature, r * r AS importance, max(r * r) OVER (PARTITION BY period) AS top
          FROM relations WHERE abs(r) > 0.05
        ), slopes AS (
          SELECT period, feature, abs(c) AS strength, max(abs(c)) OVER (PARTITION BY period) AS strongest FROM relations
        )
        SELECT f.period, f.feature, round(importance / top * 50 + strength / strongest * 50, 2) AS consensus_score
        FROM forest f JOIN slopes s ON f.period = s.period AND f.feature = s.feature""",
        *_B,
        _SCALED,
        period=_YEAR,
    ),
    "report_documents": _with(
        """, periods AS (SELECT DISTINCT period FROM lines),
        sections AS (
          SELECT period, 'insight_mensili' AS section, total_mission_revenue AS v FROM shares
          UNION ALL SELECT period, 'fingerprint_comportamentale_cassieri', round(risk, 2) FROM risks WHERE risk > 0.5
          UNION ALL SELECT period, 'analisi_perdita_margine', captured_revenue FROM leakage
        ),
        names AS (SELECT unnest(['insight_mensili', 'fingerprint_comportamentale_cassieri', 'analisi_perdita_margine'])
          AS section)
        SELECT p.period AS periodo, CAST(16 AS INTEGER) AS fields, n.section, CAST(count(v) AS INTEGER) AS records,
          round(coalesce(sum(v), 0.0), 2) AS total
        FROM periods p CROSS JOIN names n LEFT JOIN sections s ON s.period = p.period AND s.section = n.section
        GROUP BY ALL""",
        *_B,
        _INSIGHTS,
        _RISKS,
        _LEAKAGE,
        period=_YEAR,
    ),
    "hash_sample": _with(
        f""" SELECT receipt_id, product_id, CAST(line_total AS DOUBLE) AS line_total
        FROM lines WHERE {_MD5_MOD_100} < 10""",
        *_L,
    ),
    "normalize_lines": _with(
        """ SELECT receipt_id, product_id, CAST(line_total AS DOUBLE) AS line_total, weight, store_id,
          date_str, time_str, cashier_id, payment_method_code,
          CAST(total_discounts AS DOUBLE) AS total_discounts, points_redeemed,
          self_scan AS "selfScanning", hour_of_day, is_abort, is_item_void, is_void, is_gift
        FROM lines""",
        *_L,
    ),
    "line_calendar": _with(
        """ SELECT receipt_id, product_id, order_day AS date_str, hour_of_day,
          CAST(isodow(order_day) AS INTEGER) AS day_of_week,
          CAST(isodow(order_day) IN (6, 7) AS TINYINT) AS is_weekend,
          CAST(self_scan = 'Y' AS TINYINT) AS "selfScanning",
          CAST('0x' || substr(md5(store_id), 1, 8) AS BIGINT) % 1000 AS store_numeric,
          coalesce(weight, 0.0) AS weight,
          CASE WHEN hour_of_day BETWEEN 12 AND 14 OR hour_of_day BETWEEN 18 AND 20
            THEN 1 ELSE 0 END AS peak_hour_pressure_numeric,
          coalesce(weight, 0.0) > 0 AS is_fresh
        FROM lines""",
        *_L,
    ),
    "time_quality": _with(
        """ SELECT period, count(*) AS line_count, CAST(0 AS BIGINT) AS bad_time_count,
          CAST(0 AS BIGINT) AS bad_date_count, count(*) FILTER (WHERE time_str IS NULL)
          AS missing_time_count, count(*) FILTER (WHERE date_str IS NULL) AS missing_date_count
        FROM lines GROUP BY period""",
        *_L,
    ),
    "dirty_time_quality": _with(
        """ SELECT period, count(*) AS line_count,
          count(*) FILTER (WHERE time_str IS NOT NULL
            AND TRY_CAST(substr(time_str, 1, 2) AS INTEGER) IS NULL) AS bad_time_count,
          count(*) FILTER (WHERE date_str IS NOT NULL
            AND try_strptime(date_str, '%Y%m%d') IS NULL) AS bad_date_count,
          count(*) FILTER (WHERE time_str IS NULL) AS missing_time_count,
          count(*) FILTER (WHERE date_str IS NULL) AS missing_date_count
        FROM lines GROUP BY period""",
        _DIRTY,
    ),
    "dirty_receipts": _with(
        """, whole AS (
          SELECT receipt_id, count(*) AS basket_size,
            bool_or(isfinite(weight) AND weight > 0) IS TRUE AS has_fresh_produce,
            coalesce(sum(weight) FILTER (WHERE isfinite(weight) AND weight > 0), 0.0) AS fresh_weight_sum,
            coalesce(sum(weight) FILTER (WHERE isfinite(weight)), 0.0) AS total_weight,
            CAST(coalesce(sum(line_total) FILTER (WHERE isfinite(weight) AND weight > 0), 0) AS DOUBLE)
              AS fresh_value_sum,
            first(cashier_id ORDER BY date_str NULLS LAST, time_str NULLS LAST, cashier_id)
              FILTER (WHERE cashier_id IS NOT NULL) AS cashier_id,
            min(store_id) AS store_id,
            first(time_str ORDER BY date_str NULLS LAST, time_str NULLS LAST)
              FILTER (WHERE time_str IS NOT NULL) AS time_str,
            first(date_str ORDER BY date_str NULLS LAST, time_str NULLS LAST)
              FILTER (WHERE date_str IS NOT NULL) AS date_str
          FROM lines GROUP BY receipt_id
        )
        SELECT * EXCLUDE (time_str, date_str), TRY_CAST(substr(time_str, 1, 2) AS INTEGER) AS hour_of_day,
          CAST(isodow(try_strptime(date_str, '%Y%m%d')) IN (6, 7) AS TINYINT) AS is_weekend
        FROM whole""",
        _DIRTY,
    ),
    "dirty_cashier_receipts": _with(
        """ SELECT period, cashier_id, receipt_id, CAST(sum(line_total) AS DOUBLE) AS receipt_value,
          CAST(sum(CAST(is_item_void AS INTEGER)) AS BIGINT) AS void_items_count,
          max(CAST(is_abort AS INTEGER)) AS was_aborted,
          first(payment_method_code ORDER BY date_str NULLS LAST, time_str NULLS LAST, payment_method_code)
            FILTER (WHERE payment_method_code IS NOT NULL) AS pay_code
        FROM lines GROUP BY period, cashier_id, receipt_id""",
        _DIRTY,
    ),
    "dirty_produce": _with(
        _PRODUCE.replace("WHERE weight > 0", "WHERE isfinite(weight) AND weight > 0"), _DIRTY
    ),
    "standard_price": _with(
        """ SELECT period, product_id, priced_lines, CAST(standard AS DOUBLE) AS "Standard_Price"
        FROM prices""",
        *_P,
    ),
    "line_price_features": _with(
        """ SELECT receipt_id, product_id, CAST(line_total AS DOUBLE) AS line_total,
          CAST(standard AS DOUBLE) AS "Standard_Price", is_discounted, price_delta, avg_unit_price,
          period AS partition_key
        FROM priced""",
        *_P,
    ),
    "lines_per_receipt": _with(
        """ SELECT period, count(DISTINCT receipt_id) AS receipt_count, count(*) AS line_count,
          CAST(count(*) AS DOUBLE) / count(DISTINCT receipt_id) AS avg_lines_per_receipt
        FROM lines GROUP BY period""",
        *_L,
    ),
    "canonical_features": _with(" SELECT * FROM baskets", *_B),
    "canonical_features_by_period": _with(" SELECT * FROM baskets", *_B, period=_YEAR),
    "validate_metrics": _with(" " + _validation(), *_B),
    "mission_rule": _with(
        f""" SELECT receipt_id, basket_size, basket_value_per_item,
          CASE WHEN {_B2B} THEN 'B2B / Bulk Outlier' ELSE 'PENDING' END AS shopping_mission
        FROM baskets""",
        *_B,
    ),
    "mission_assign": _with(
        " SELECT receipt_id, cluster, shopping_mission FROM assigned", *_B, _ASSIGNED
    ),
    "mission_insights": _with(" SELECT * FROM shares", *_B, _INSIGHTS),
    "mission_insights_by_period": _with(" SELECT * FROM shares", *_B, _INSIGHTS, period=_YEAR),
    "report_missions": _with(
        """ SELECT period AS periodo,
          CASE shopping_mission
            WHEN 'Standard Mixed Trip' THEN 'Spesa Standard Mista'
            WHEN 'Premium/Specialty Single-Item' THEN 'Premium / Specialità Singolo Articolo'
            WHEN 'B2B / Bulk Outlier' THEN 'B2B / Ingrosso Outlier'
            WHEN 'Weekly Stock-up' THEN 'Spesa Settimanale di Scorta'
            WHEN 'Quick Convenience' THEN 'Convenienza Rapida'
            WHEN 'Daily Fresh Pick' THEN 'Fresco Quotidiano'
          END AS "Missione Spesa",
          receipt_count AS "Numero Scontrini", total_mission_revenue AS "Fatturato Totale Missione",
          avg_trip_value AS "Valore Medio Spesa", avg_items_per_trip AS "Media Articoli per Spesa",
          revenue_share_pct AS "Percentuale Fatturato", traffic_share_pct AS "Percentuale Traffico"
        FROM shares""",
        *_B,
        _INSIGHTS,
        period=_YEAR,
    ),
    "standardized_features": _with(
        """ SELECT receipt_id, round(x0, 6) AS basket_size_scaled,
          round(x1, 6) AS basket_value_per_item_scaled, round(x2, 6) AS freshness_weight_ratio_scaled
        FROM scaled""",
        *_B,
        _SCALED,
    ),
    "centroid_names": _with(
        """ SELECT *, CASE WHEN basket_size > 15 THEN 'B2B / Bulk Outlier'
            WHEN basket_size > 5 THEN 'Weekly Stock-up'
            WHEN fresh_ratio > 0.3 THEN 'Daily Fresh Pick'
            WHEN basket_size <= 2.5 AND item_value > 45 THEN 'Premium/Specialty Single-Item'
            WHEN basket_size <= 2.5 AND item_value < 12 THEN 'Quick Convenience'
            ELSE 'Standard Mixed Trip' END AS mission
        FROM (SELECT store_id, basket_size, count(*) AS receipts,
            round(avg(basket_value_per_item), 4) AS item_value,
            round(avg(freshness_weight_ratio), 6) AS fresh_ratio
          FROM baskets GROUP BY store_id, basket_size)""",
        *_B,
    ),
    "b2b_audit": _with(
        f""" SELECT period, receipt_id, basket_value, basket_size,
          'B2B / Bulk Outlier' AS shopping_mission, round(z, 6) AS anomaly_score
        FROM (SELECT *, (basket_value - avg(basket_value) OVER p)
            / stddev_samp(basket_value) OVER p AS z
          FROM baskets WINDOW p AS (PARTITION BY period))
        WHERE {_B2B}""",
        *_B,
    ),
    "severity": _with(
        """, placed AS (
          SELECT period, receipt_id, basket_value_per_item AS anomaly_score,
            row_number() OVER (PARTITION BY period ORDER BY basket_value_per_item) AS rn,
            count(*) OVER (PARTITION BY period) AS n
          FROM baskets
        ), limits AS (
          SELECT period,
            max(anomaly_score) FILTER (WHERE rn = round(0.01 * (n - 1)) + 1) AS q01,
            max(anomaly_score) FILTER (WHERE rn = round(0.05 * (n - 1)) + 1) AS q05
          FROM placed GROUP BY period
        )
        SELECT period, receipt_id, anomaly_score,
          CASE WHEN anomaly_score <= q01 THEN 'critical' WHEN anomaly_score <= q05 THEN 'warning'
            ELSE 'info' END AS severity
        FROM placed JOIN limits USING (period)""",
        *_B,
    ),
    "lasso_moments": _with(" " + _moments(), *_B, _SCALED),
    "vif": _with(
        """, r AS (
          SELECT corr(basket_size, basket_value_per_item) AS a,
            corr(basket_size, freshness_weight_ratio) AS b,
            corr(basket_value_per_item, freshness_weight_ratio) AS c
          FROM baskets
        ), factors AS (
          SELECT unnest(['basket_size', 'basket_value_per_item', 'freshness_weight_ratio']) AS feature,
            unnest([1 - c * c, 1 - b * b, 1 - a * a])
              / (1 + 2 * a * b * c - a * a - b * b - c * c) AS vif
          FROM r
        )
        SELECT feature, round(vif, 6) AS vif,
          CASE WHEN vif < 5 THEN 'PASS' ELSE 'HIGH COLLINEARITY' END AS status
        FROM factors""",
        *_B,
    ),
    "cashier_sweethearting": _with(
        """ SELECT b.receipt_id, b.cashier_id,
          round(coalesce(s.z, 0), 6) AS cashier_sweethearting_z_score,
          CAST(CASE WHEN s.z > 1.5 THEN -1 ELSE 0 END AS TINYINT)
            AS cashier_sweethearting_anomaly_score
        FROM baskets b LEFT JOIN cashier_scores s
          ON b.period = s.period AND b.cashier_id = s.cashier_id""",
        *_B,
        _CASHIER_SCORES,
    ),
    "cashier_alerts": _with(_SHOWN_ALERTS, *_B, _ALERTS),
    "cashier_alerts_by_period": _with(_SHOWN_ALERTS, *_B, _ALERTS, period=_YEAR),
    "report_integrity": _with(
        """ SELECT period AS periodo, cashier_id AS "Codice Cassiere",
          flag AS "Score Anomalia Sweethearting", z AS "Z-Score Deviazione" FROM alerts""",
        *_B,
        _ALERTS,
    ),
    "produce_weighing_errors": _with(_PRODUCE, *_L),
    "produce_weighing_errors_by_period": _with(_PRODUCE, *_L, period=_YEAR),
    "cashier_receipts": _with(
        """ SELECT period, cashier_id, receipt_id, receipt_value,
          CAST(voids AS BIGINT) AS void_items_count, CAST(aborted AS INTEGER) AS was_aborted, pay_code
        FROM cashier_receipts""",
        *_L,
        _FINGERPRINTS,
    ),
    "cashier_fingerprint": _with(
        f""" SELECT period, cashier_id, total_transactions, {_FINGERPRINT_MEANS}
        FROM fingerprints""",
        *_L,
        _FINGERPRINTS,
    ),
    "behavioral_risk": _with(_SHOWN_RISKS, *_L, _RISKS),
    "behavioral_risk_by_period": _with(_SHOWN_RISKS, *_L, _RISKS, period=_YEAR),
    "report_risk": _with(
        """ SELECT period AS periodo, cashier_id AS "Codice Cassiere",
          round(risk, 2) AS "Score Rischio Comportamentale",
          round(cash_reliance_ratio, 3) AS "Indice Uso Contanti",
          round(void_rate_per_receipt, 3) AS "Tasso Storni"
        FROM risks WHERE risk > 0.5""",
        *_L,
        _RISKS,
    ),
    "behavioral_risk_report": _with(
        """ SELECT period, cashier_id, round(risk, 2) AS risk_score,
          round(cash_reliance_ratio, 3) AS cash_reliance_ratio,
          round(void_rate_per_receipt, 3) AS void_rate_per_receipt
        FROM risks WHERE risk > 0.5""",
        *_L,
        _RISKS,
    ),
    "margin_leakage": _with(" SELECT * FROM leakage", *_L, _LEAKAGE),
    "margin_leakage_by_period": _with(" SELECT * FROM leakage", *_L, _LEAKAGE, period=_YEAR),
    "report_behavioral": _with(
        """ SELECT period AS periodo, cashier_id AS "Codice Cassiere",
          total_markdowns AS "Totale Sconti e Ribassi", total_voids AS "Totale Articoli Stornati",
          captured_revenue AS "Fatturato Acquisito",
          leakage_pct AS "Percentuale Perdita (Leakage)" FROM leakage""",
        *_L,
        _LEAKAGE,
    ),
}
