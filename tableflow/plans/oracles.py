"""The same answers as plain SQL over the shipped tables, for a second engine to check."""

from __future__ import annotations

from tableflow.operators.quality import NAME_HINTS, VALUE_PATTERNS, VERDICT_CLEAN, VERDICT_CONFIRMED, VERDICT_HINT

# ---- views -------------------------------------------------------------------------

TRIPS = """trips AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS pickup_ts, l_suppkey AS pu_location_id,
         l_extendedprice AS fare_amount, l_discount AS trip_distance, l_tax AS passenger_count,
         l_extendedprice * l_tax AS tip_amount,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_amount
  FROM lineitem)"""

ZONES = """zones AS (
  SELECT s_suppkey AS location_id, r_name AS borough, n_name AS zone
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ORDER_TRIPS = """order_trips AS (
  SELECT o_orderkey, o_orderdate AS pickup_ts, CAST(substr(o_orderpriority, 1, 1) AS INT) AS payment_type,
         o_totalprice AS fare_amount, o_totalprice AS total_amount
  FROM orders)"""

TASK_RUNS = """task_runs AS (
  SELECT user_id AS run_id, event_type AS task_name, ts AS started_at,
         ts + to_microseconds(CAST(floor(value * 1000 + 0.5) AS BIGINT)) AS ended_at,
         value AS duration_ms, event_id,
         CASE WHEN k < 70 THEN 'success' WHEN k < 85 THEN 'skipped' WHEN k < 93 THEN 'failed'
              WHEN k < 97 THEN 'upstream_failed' ELSE 'oom' END AS status,
         1 AS attempt, 100 + k * 30 AS peak_mb
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

PIPELINE_RUNS = """pipeline_runs AS (
  SELECT user_id AS run_id, 'job_' || CAST(user_id % 7 AS VARCHAR) AS module_path, min(ts) AS started_at,
         CASE WHEN user_id % 10 <> 0 THEN max(ts) END AS ended_at,
         CASE WHEN user_id % 10 = 0 THEN 'running' WHEN user_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status
  FROM events GROUP BY user_id
  UNION ALL
  SELECT CAST(-1 - r_regionkey AS BIGINT), 'job_idle', TIMESTAMP '2024-01-01 00:00:00', NULL, 'running'
  FROM region)"""

STATE_RUNS = TASK_RUNS + """, state_runs AS (
  SELECT CAST(run_id AS VARCHAR) AS run_id, task_name, status, started_at, ended_at, duration_ms,
         CASE WHEN status IN ('failed', 'oom') THEN 'stopped' END AS error,
         md5(task_name) AS fingerprint, CAST(day(started_at) AS INT) AS attempt, event_id
  FROM task_runs)"""

RUN_COLS = "run_id, task_name, status, started_at, ended_at, duration_ms, error, fingerprint, attempt"

SLICES = STATE_RUNS + f""", base AS (SELECT {RUN_COLS} FROM state_runs WHERE event_id % 4 IN (0, 3)),
  delta AS (SELECT {RUN_COLS}, 'd1' AS batch_id FROM state_runs WHERE event_id % 4 IN (0, 1)
            UNION ALL
            SELECT {RUN_COLS}, 'd2' AS batch_id FROM state_runs WHERE event_id % 4 IN (1, 2))"""

ABSORBED = SLICES + f""", first_delta AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_name, attempt
                                                ORDER BY batch_id, started_at) AS rn FROM delta)
    WHERE rn = 1)
  SELECT {RUN_COLS} FROM base
  UNION ALL
  SELECT {RUN_COLS} FROM first_delta d
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.run_id = d.run_id AND b.task_name = d.task_name
                    AND b.attempt = d.attempt)"""

CONTACTS = """contacts AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_custkey % 10 < 7 THEN 'user' || CAST(c_custkey AS VARCHAR) || '@example.com'
              WHEN c_custkey % 10 < 9 THEN 'n/a' END AS email,
         '555-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS phone,
         '192.0.2.' || CAST(c_custkey % 250 AS VARCHAR) AS signup_ip,
         CAST(NULL AS VARCHAR) AS address, c_mktsegment AS plan
  FROM customer)"""

PRINT_ROWS = """old_rows AS (
    SELECT l_returnflag AS flag, l_orderkey, l_linenumber,
           CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
           CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax, l_shipdate
    FROM lineitem),
  new_rows AS (
    SELECT flag, l_orderkey, l_linenumber, cents, CASE WHEN flag = 'A' THEN tax + 1 ELSE tax END AS tax, l_shipdate
    FROM old_rows WHERE flag <> 'R'
    UNION ALL
    SELECT 'X', o_orderkey, 1, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT), 0, o_orderdate FROM orders)"""

DEFS = """defs AS (
    SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS task_name, p_name AS source,
           p_brand || '/' || p_type AS config, sha256(p_name || p_type) AS fingerprint,
           p_size % 7 <> 0 AS cacheable, p_size, p_partkey
    FROM part),
  stored AS (
    SELECT task_name, CASE WHEN p_size % 3 = 0 THEN md5(fingerprint) ELSE fingerprint END AS fingerprint
    FROM defs WHERE p_size % 11 <> 0),
  results AS (
    SELECT task_name, fingerprint, CAST(p_size AS BIGINT) * 1000 AS n_rows,
           CAST(p_size AS BIGINT) * 2000000 AS size_bytes
    FROM defs),
  cache AS (SELECT * FROM results WHERE n_rows % 5000 <> 0)"""

EDGES = """edges AS (
    SELECT DISTINCT task_name, upstream_task_name FROM (
      SELECT p_partkey AS task_name, p_partkey // 2 AS upstream_task_name FROM part
      UNION ALL SELECT p_partkey, p_partkey // 3 FROM part)
    WHERE upstream_task_name > 0)"""

NAMED_EDGES = EDGES + """, named_edges AS (
    SELECT 'part_' || CAST(task_name AS VARCHAR) AS task_name,
           'part_' || CAST(upstream_task_name AS VARCHAR) AS upstream_task_name FROM edges)"""

PREVIEW = DEFS + """, preview AS (
    SELECT d.task_name,
           CASE WHEN d.cacheable AND s.fingerprint = d.fingerprint AND c.task_name IS NOT NULL
                THEN 'skip (unchanged)'
                WHEN NOT d.cacheable THEN 'run (not cached)' ELSE 'run (changed)' END AS next_run
    FROM defs d LEFT JOIN stored s ON s.task_name = d.task_name
    LEFT JOIN cache c ON c.task_name = d.task_name AND c.fingerprint = d.fingerprint)"""


PRINT_COLUMNS = ["l_orderkey", "l_linenumber", "cents", "tax", "l_shipdate"]


def cell(col: str) -> str:
    """Length and text of a value, a dash for NULL."""
    return f"coalesce(length(CAST({col} AS VARCHAR)) || ':' || CAST({col} AS VARCHAR), '-')"


def exact(col: str) -> str:
    return f"sum(CAST({col} AS DECIMAL(18,6)))"


def cents(col: str) -> str:
    return f"CAST(round({exact(col)}, 2) AS DOUBLE)"


FAILED = "('failed', 'upstream_failed', 'oom')"
CLEAN = "fare_amount > 0 AND trip_distance > 0"

BOROUGH_DAY = f"""{TRIPS}, {ZONES}, daily AS (
  SELECT borough, date_trunc('day', pickup_ts)::TIMESTAMP AS day, count(*) AS trips,
         {cents('fare_amount')} AS revenue
  FROM trips JOIN zones ON pu_location_id = location_id
  WHERE {CLEAN} AND pu_location_id IS NOT NULL GROUP BY 1, 2)"""

PAYMENT_DAYS = f"""{ORDER_TRIPS}, daily AS (
  SELECT payment_type, CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trip_count,
         {cents('fare_amount')} AS total_revenue
  FROM order_trips WHERE fare_amount > 0 AND payment_type IN (1, 2) GROUP BY 1, 2)"""

DAILY_REVENUE = f"""{ORDER_TRIPS}, daily AS (
  SELECT CAST(pickup_ts AS DATE) AS trip_date, payment_type,
         sum(total_amount) AS revenue, count(*) AS trip_count
  FROM order_trips WHERE fare_amount > 0 GROUP BY 1, 2)"""

BY_PAYMENT = f"""{ORDER_TRIPS}, pay AS (
  SELECT payment_type, count(*) AS trip_count, {cents('fare_amount')} AS total_fare
  FROM order_trips GROUP BY 1)"""

LABEL = """CASE {c} WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No charge'
           WHEN 4 THEN 'Dispute' WHEN 6 THEN 'Voided trip' ELSE 'Other' END"""

MANIFEST = f"""{TRIPS}, {ZONES}, manifest AS (
  SELECT replace(lower(borough), ' ', '_') AS borough, count(*) AS rows,
         'borough=' || replace(lower(borough), ' ', '_') AS path
  FROM trips JOIN zones ON pu_location_id = location_id
  WHERE borough NOT IN ('AFRICA', 'ASIA') GROUP BY borough)"""

HINTS = "|".join(NAME_HINTS)


def scan_sql(source: str, columns: dict[str, int]) -> str:
    """Findings of the listed string columns (name -> position among the string columns)."""
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, '{label}' AS pattern, count({c}) AS n,"
        f" count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS m FROM {source}"
        for c, i in columns.items()
        for label, pattern in VALUE_PATTERNS.items()
    )
    return f"""counts AS ({counts}),
      hits AS (SELECT *, m / n >= 0.5 AS hit FROM counts WHERE n > 0),
      findings AS (
        SELECT column_name, position, regexp_matches(lower(column_name), '{HINTS}') AS name_hint,
               pattern, round(m / n, 2) AS ratio FROM hits WHERE hit
        UNION ALL
        SELECT column_name, position, true, NULL, NULL FROM hits
        WHERE regexp_matches(lower(column_name), '{HINTS}')
        GROUP BY column_name, position HAVING NOT bool_or(hit))"""


CONTACT_SCAN = CONTACTS + ", " + scan_sql(
    "contacts", {"c_name": 0, "email": 1, "phone": 2, "signup_ip": 3, "address": 4, "plan": 5}
)


def triage_sql(scan: str, source: str, n_columns: int) -> str:
    """The one-row report over the findings of a scan."""
    return f"""WITH {scan}, cols AS (
          SELECT column_name, position, count(pattern) AS n FROM findings GROUP BY 1, 2),
        names AS (
          SELECT coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (WHERE n > 0), '') AS confirmed,
                 coalesce(string_agg(column_name, ',' ORDER BY position) FILTER (WHERE n = 0), '') AS worth_a_look,
                 count(*) FILTER (WHERE n > 0) AS sure, count(*) FILTER (WHERE n = 0) AS maybe FROM cols)
        SELECT (SELECT count(*) FROM {source}) AS n_rows, {n_columns} AS columns_scanned, confirmed, worth_a_look,
               (SELECT coalesce(string_agg(column_name || ':' || pattern || '=' || CAST(ratio AS VARCHAR), ','
                       ORDER BY position, pattern), '') FROM findings WHERE pattern IS NOT NULL) AS detail,
               CASE WHEN sure > 0 THEN replace('{VERDICT_CONFIRMED}', '{{n}}', CAST(sure AS VARCHAR))
                    WHEN maybe > 0 THEN replace('{VERDICT_HINT}', '{{n}}', CAST(maybe AS VARCHAR))
                    ELSE '{VERDICT_CLEAN}' END AS verdict
        FROM names"""


# Every node p > 0 sits one level below p // 2, whose level is the deeper of its two upstreams.
BELOW = """WITH RECURSIVE {views}, below AS (
    SELECT DISTINCT task_name FROM {edges} WHERE upstream_task_name IN ({start})
    UNION
    SELECT e.task_name FROM {edges} e JOIN below b ON e.upstream_task_name = b.task_name)"""


def propagated_sql(edges: str, depth: int = 22) -> str:
    """Fingerprints resolved level by level; a level holds the keys of one bit length."""
    parts = [
        f"{DEFS}, {edges}",
        "f1 AS (SELECT p_partkey, task_name, sha256(source || chr(0) || config || chr(0)) AS fingerprint"
        " FROM defs WHERE p_partkey < 2)",
    ]
    for k in range(2, depth + 1):
        parts.append(
            f"f{k} AS (SELECT * FROM f{k - 1} UNION ALL"
            f" SELECT d.p_partkey, d.task_name, sha256(any_value(d.source) || chr(0) || any_value(d.config)"
            f" || chr(0) || string_agg(u.task_name || '=' || u.fingerprint || chr(0), ''"
            f" ORDER BY u.task_name))"
            f" FROM defs d JOIN edges e ON e.task_name = d.p_partkey"
            f" JOIN f{k - 1} u ON u.p_partkey = e.upstream_task_name"
            f" WHERE d.p_partkey >= {2 ** (k - 1)} AND d.p_partkey < {2 ** k} GROUP BY 1, 2)"
        )
    return f"WITH {', '.join(parts)} SELECT task_name, fingerprint FROM f{depth}"


def half_sum(start: int) -> str:
    """Sum of 64 bits of the digest ``h``, from hex digit ``start``, as signed numbers."""
    half = f"CAST('0x' || substr(h, {start}, 16) AS UBIGINT)::HUGEINT"
    return f"sum(CASE WHEN {half} >= 9223372036854775808::HUGEINT THEN {half} - 18446744073709551616::HUGEINT ELSE {half} END)"


TIER = "CASE " + " ".join(
    f"WHEN peak_mb <= {t} * 0.8 THEN {t}" for t in (128, 256, 512, 1024, 1536, 2048, 3008)
) + " ELSE 4096 END"

SCENARIOS = "scenarios AS (SELECT * FROM (VALUES ('hyperscale', 1.09::DOUBLE), ('industry avg', 1.54::DOUBLE)) t(scenario, pue))"

NOTES = """SELECT doc_id, length(note) AS n, md5(note) AS digest
        FROM (SELECT doc_id, 'say "' || text || '", ok' || chr(10) || source AS note FROM documents)"""

ORACLES: dict[str, str] = {
    "z1_daily_fares": f"""WITH {TRIPS}
        SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trip_count,
               {cents('fare_amount')} AS total_fare, {cents('tip_amount')} AS total_tip,
               round(CAST({exact('total_amount')} AS DOUBLE) / count(total_amount), 2) AS avg_total
        FROM trips WHERE {CLEAN} AND passenger_count > 0 GROUP BY 1 ORDER BY 1""",
    "z2_borough_list": f"""WITH {TRIPS}, {ZONES}
        SELECT DISTINCT borough FROM trips JOIN zones ON pu_location_id = location_id
        WHERE borough NOT IN ('AFRICA', 'ASIA') ORDER BY 1""",
    "z2_partition_manifest": f"WITH {MANIFEST} SELECT * FROM manifest",
    "z2_partition_count": f"WITH {MANIFEST} SELECT count(DISTINCT borough) AS partitions FROM manifest",
    "z3_rolling_revenue": f"""WITH {DAILY_REVENUE}
        SELECT trip_date, payment_type, trip_count, round(revenue, 4) AS revenue,
               round(avg(revenue) OVER (PARTITION BY payment_type ORDER BY trip_date
                                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS revenue_3d_avg,
               {LABEL.format(c='payment_type')} AS payment_type_label
        FROM daily""",
    "z3_report": f"""WITH {DAILY_REVENUE}
        SELECT {LABEL.format(c='payment_type')} AS payment_type_label, count(*) AS n_rows FROM daily GROUP BY 1""",
    "z4_by_payment": f"WITH {BY_PAYMENT} SELECT * FROM pay ORDER BY payment_type",
    "z4_by_hour": "SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS trip_count FROM events GROUP BY 1 ORDER BY 1",
    "z4_combined": f"""WITH {BY_PAYMENT}
        SELECT (SELECT count(*) FROM pay) AS by_payment_type_rows,
               (SELECT count(DISTINCT hour(ts)) FROM events) AS by_hour_rows""",
    "z5_daily_totals": f"""WITH {TRIPS}
        SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trip_count, {cents('fare_amount')} AS total_fare
        FROM trips WHERE {CLEAN} GROUP BY ALL""",
    "z6_totals": f"""WITH {BY_PAYMENT}
        SELECT count(*) AS payment_types, {cents('total_fare')} AS total_fare FROM pay""",
    "z8_payment_days": f"WITH {PAYMENT_DAYS} SELECT * FROM daily",
    "z8_card_days": f"WITH {PAYMENT_DAYS} SELECT * FROM daily WHERE payment_type = 1",
    "z8_payment_reports": f"""WITH {PAYMENT_DAYS}
        SELECT payment_type, CAST(sum(trip_count) AS BIGINT) AS total_trips,
               {cents('total_revenue')} AS total_revenue,
               (SELECT trip_date FROM daily d WHERE d.payment_type = o.payment_type
                ORDER BY total_revenue DESC, trip_date LIMIT 1) AS best_day
        FROM daily o GROUP BY payment_type""",
    "z9_measures": f"""WITH {ORDER_TRIPS}
        SELECT count(*) FILTER (WHERE payment_type = 1) AS card_trips,
               count(*) FILTER (WHERE payment_type = 2) AS cash_trips,
               round(avg(fare_amount), 6) AS mean_value FROM order_trips""",
    "z10_borough_day": f"WITH {BOROUGH_DAY} SELECT * FROM daily",
    "z10_report": f"""WITH {BOROUGH_DAY}
        SELECT count(*) AS day_borough_rows, CAST(sum(trips) AS BIGINT) AS total_trips,
               {cents('revenue')} AS total_revenue,
               (SELECT borough FROM daily GROUP BY borough ORDER BY {exact('revenue')} DESC, borough LIMIT 1)
                 AS top_borough_by_revenue
        FROM daily""",
    "z10_year_of_files": f"""WITH {BOROUGH_DAY}
        SELECT count(*) AS day_borough_rows, CAST(sum(trips) AS BIGINT) AS total_trips,
               {cents('revenue')} AS total_revenue,
               (SELECT borough FROM daily GROUP BY borough ORDER BY {exact('revenue')} DESC, borough LIMIT 1)
                 AS top_borough_by_revenue,
               (SELECT CAST(count(DISTINCT month(l_shipdate)) AS INT) FROM lineitem) AS sources
        FROM daily""",
    "z11_extract": """SELECT * FROM orders
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
        ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000""",
    "io_parquet": f"WITH {ZONES} SELECT * FROM zones",
    "io_csv": f"WITH {ZONES} SELECT * FROM zones",
    "io_any": f"""WITH {ORDER_TRIPS}
        SELECT count(*) AS csv_rows, max(pickup_ts) AS last_ts, (SELECT count(*) FROM supplier) AS parquet_rows
        FROM order_trips""",
    "io_replaced_table": f"WITH {BY_PAYMENT} SELECT * FROM pay",
    "io_union": f"""SELECT l_linenumber, count(*) AS n,
               count(*) FILTER (WHERE l_linenumber <= 3 AND l_tax IS NOT NULL) AS with_tax,
               {cents('l_extendedprice')} AS price FROM lineitem GROUP BY 1""",
    "io_union_types": """SELECT l_linenumber, count(*) AS n,
               sum(CASE WHEN l_linenumber <= 3 THEN trunc(l_quantity) ELSE l_quantity END) AS quantity
        FROM lineitem GROUP BY 1""",
    "io_csv_text": NOTES,
    "io_csv_split": NOTES,
    "io_materialize": "SELECT count(*) AS n_rows, true AS same, true AS sized FROM orders",
    "json_rows": f"WITH {PAYMENT_DAYS} SELECT trip_date, trip_count, total_revenue FROM daily",
    "json_codec": """SELECT event_id, '[{"k":' || json_extract_string(props, '$.k') || ',"id":'
               || CAST(event_id AS VARCHAR) || '}]' AS encoded FROM events""",
    "literal_join": f"""WITH {ORDER_TRIPS}
        SELECT payment_type, count(*) AS n, nullif({LABEL.format(c='payment_type')}, 'Other') AS label
        FROM order_trips GROUP BY 1""",
    "filter_chain": """SELECT * FROM orders
        WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
          AND o_totalprice IS NOT NULL AND o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') AND o_orderstatus = 'F'""",
    "derived_orders": f"""SELECT o_orderkey, o_orderpriority, o_orderdate,
               {LABEL.format(c="CAST(substr(o_orderpriority, 1, 1) AS INT)")} AS label,
               replace(lower(o_orderpriority), ' ', '_') AS tag,
               regexp_matches(lower(o_orderpriority), 'high|low') AS hint,
               CAST(NULL AS TIMESTAMP) AS ended_at,
               date_diff('microsecond', o_orderdate, TIMESTAMP '2000-01-01') / 1000.0::DOUBLE AS to_midnight_ms
        FROM orders""",
    "matching_orders": """SELECT * FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem",
    "bucket_sums": """SELECT l_orderkey % 7 AS bucket, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total
        FROM lineitem GROUP BY 1""",
    "bucket_filter": "SELECT o_orderkey, CAST(o_orderkey % 3 AS INT) AS bucket FROM orders",
    "bucket_union": """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 = 1""",
    "array_ops": """SELECT l_orderkey, l_linenumber,
               array_to_string(list_transform(a, lambda x: x * 2), ',') AS doubled,
               array_to_string(list_concat(list_transform(a, lambda x: x * 2),
                                           list_transform(a, lambda x: x + 100)), ',') AS joined,
               coalesce(array_to_string(list_filter(a, lambda x: x % 3 = 0), ','), '') AS thirds
        FROM (SELECT l_orderkey, l_linenumber, [l_orderkey, l_partkey, l_suppkey] AS a FROM lineitem)""",
    "borough_totals": f"WITH {BOROUGH_DAY} SELECT borough, {cents('revenue')} AS revenue FROM daily GROUP BY 1",
    "best_payment_day": f"""WITH {PAYMENT_DAYS}
        SELECT payment_type, trip_date, total_revenue FROM (
          SELECT *, row_number() OVER (PARTITION BY payment_type ORDER BY total_revenue DESC, trip_date) AS rn
          FROM daily) WHERE rn = 1""",
    "rolling_events": """SELECT event_id, round(avg(floor(value * 100 + 0.5)) OVER (
               PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean_cents
        FROM events""",
    "history_latest": f"""WITH {TASK_RUNS}
        SELECT run_id, task_name, status, started_at, ended_at, duration_ms FROM task_runs
        QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY ended_at DESC, event_id DESC) = 1""",
    "history_last_status": f"""WITH {TASK_RUNS}
        SELECT status, ended_at FROM task_runs WHERE task_name = 'click' ORDER BY ended_at DESC LIMIT 1""",
    "history_run_summary": f"""WITH {TASK_RUNS}, {PIPELINE_RUNS}
        SELECT p.run_id, p.module_path, p.started_at, p.ended_at, p.status, count(t.task_name) AS task_count,
               count(*) FILTER (WHERE t.status = 'success') AS succeeded_count,
               count(*) FILTER (WHERE t.status = 'skipped') AS skipped_count,
               count(*) FILTER (WHERE t.status IN {FAILED}) AS failed_count
        FROM pipeline_runs p LEFT JOIN task_runs t ON t.run_id = p.run_id GROUP BY 1, 2, 3, 4, 5""",
    "history_status_counts": f"""WITH {TASK_RUNS}
        SELECT run_id, task_name, count(*) FILTER (WHERE status = 'success') AS succeeded_count,
               count(*) FILTER (WHERE status = 'skipped') AS skipped_count,
               count(*) FILTER (WHERE status IN {FAILED}) AS failed_count FROM task_runs GROUP BY 1, 2""",
    "history_task_stats": f"""WITH {TASK_RUNS}
        SELECT task_name, count(*) AS runs,
               round(avg(duration_ms), 6) AS avg_duration_ms,
               max(duration_ms) AS max_duration_ms, max(ended_at) AS last_run_at,
               count(*) FILTER (WHERE status = 'skipped') AS skipped_count,
               count(*) FILTER (WHERE status IN {FAILED}) AS failed_count FROM task_runs GROUP BY 1""",
    "history_recent": f"""WITH {PIPELINE_RUNS}
        SELECT * FROM pipeline_runs ORDER BY started_at DESC, run_id LIMIT 20""",
    "history_slowest": f"""WITH {TASK_RUNS}
        SELECT task_name, count(*) AS runs,
               round(avg(duration_ms), 6) AS avg_duration_ms,
               max(duration_ms) AS max_duration_ms,
               count(*) FILTER (WHERE status = 'skipped') AS skipped_count,
               count(*) FILTER (WHERE status IN {FAILED}) AS failed_count
        FROM task_runs GROUP BY 1 ORDER BY 3 DESC""",
    "history_outcome": f"""WITH {TASK_RUNS}
        SELECT run_id, CASE WHEN bool_or(status IN {FAILED}) THEN 'failed' ELSE 'success' END AS outcome
        FROM task_runs GROUP BY 1""",
    "history_appended": f"""WITH {TASK_RUNS}
        SELECT event_id, run_id, task_name, status,
               date_diff('microsecond', started_at, ended_at) / 1000.0::DOUBLE AS duration_ms FROM task_runs""",
    "history_closed": f"""WITH {TASK_RUNS}, {PIPELINE_RUNS}, seen AS (
          SELECT run_id, max(ended_at) AS last_end,
                 CASE WHEN bool_or(status IN {FAILED}) THEN 'failed' ELSE 'success' END AS outcome
          FROM task_runs GROUP BY 1)
        SELECT p.run_id, p.module_path, p.started_at,
               CASE WHEN p.status = 'running' THEN coalesce(s.last_end, p.ended_at) ELSE p.ended_at END AS ended_at,
               CASE WHEN p.status = 'running' THEN coalesce(s.outcome, p.status) ELSE p.status END AS status
        FROM pipeline_runs p LEFT JOIN seen s ON s.run_id = p.run_id""",
    "history_unclosed": f"""WITH {TASK_RUNS}, {PIPELINE_RUNS}
        SELECT p.run_id, p.started_at,
               CASE WHEN count(t.run_id) = 0 THEN NULL
                    WHEN bool_or(t.status IN {FAILED}) THEN 'failed' ELSE 'success' END AS outcome,
               max(t.ended_at) AS last_task_end
        FROM pipeline_runs p LEFT JOIN task_runs t ON t.run_id = p.run_id
        WHERE p.status = 'running' GROUP BY 1, 2""",
    "merge_insert_absent": f"WITH {ABSORBED}",
    "merge_absorb_twice": f"WITH {ABSORBED}",
    "merge_compacted": f"WITH {ABSORBED}",
    "stream_absorb": f"WITH {ABSORBED}",
    "merge_all_tables": f"""WITH {SLICES.replace(STATE_RUNS, STATE_RUNS + ", " + PIPELINE_RUNS)}, {DEFS}, {NAMED_EDGES},
        absorbed AS (WITH {ABSORBED[len(SLICES) + 2:]}),
        numbered AS (SELECT *, CAST(substr(task_name, 6) AS BIGINT) AS i FROM named_edges),
        rows AS (
          SELECT 'pipeline_runs' AS table_name, concat_ws('|', run_id, CASE WHEN ((run_id % 3) + 3) % 3 = 2 THEN 'late' ELSE module_path END,
                 status) AS row_text FROM pipeline_runs
          UNION ALL
          SELECT 'task_runs', concat_ws('|', run_id, task_name, attempt, status, CAST(duration_ms > 50 AS VARCHAR)) FROM absorbed
          UNION ALL
          SELECT 'task_fingerprints', concat_ws('|', task_name, CASE WHEN CAST(substr(task_name, 6) AS BIGINT) % 3 = 1
                 THEN md5(fingerprint) ELSE fingerprint END) FROM stored
          UNION ALL
          SELECT 'task_lineage', concat_ws('|', task_name, upstream_task_name) FROM numbered WHERE i % 4 <> 1
          UNION ALL
          SELECT DISTINCT 'task_lineage', concat_ws('|', task_name, 'x') FROM numbered WHERE i % 8 = 5
          UNION ALL
          SELECT 'task_lineage', concat_ws('|', task_name, u) FROM (SELECT DISTINCT task_name FROM numbered WHERE i % 8 = 1), (VALUES ('y'), ('z')) t(u)
          UNION ALL
          SELECT 'task_cache', concat_ws('|', task_name, fingerprint,
                 CASE WHEN CAST(substr(task_name, 6) AS BIGINT) % 3 = 2 THEN 'csv' ELSE 'parquet' END, n_rows, size_bytes) FROM results)
        SELECT table_name, row_text, count(*) AS copies FROM rows GROUP BY 1, 2""",
    "merge_anti_insert": f"""WITH {SLICES}
        SELECT run_id FROM base UNION SELECT run_id FROM delta""",
    "merge_replace_key": f"""WITH {SLICES}, newest AS (
          SELECT run_id, task_name, attempt, max(batch_id) AS batch_id FROM delta GROUP BY 1, 2, 3)
        SELECT {RUN_COLS} FROM base b
        WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.run_id = b.run_id AND n.task_name = b.task_name
                          AND n.attempt = b.attempt)
        UNION ALL
        SELECT {RUN_COLS} FROM delta d
        WHERE EXISTS (SELECT 1 FROM newest n WHERE n.run_id = d.run_id AND n.task_name = d.task_name
                      AND n.attempt = d.attempt AND n.batch_id = d.batch_id)""",
    "merge_upsert_latest": f"""WITH {SLICES}
        SELECT {RUN_COLS} FROM (SELECT {RUN_COLS} FROM base UNION ALL SELECT {RUN_COLS} FROM delta)
        QUALIFY row_number() OVER (PARTITION BY run_id, task_name, attempt ORDER BY started_at DESC) = 1""",
    "merge_conflicts": f"""WITH {STATE_RUNS}
        SELECT run_id, task_name, attempt, count(*) AS n_rows, count(DISTINCT status) AS n_statuses
        FROM state_runs GROUP BY 1, 2, 3 HAVING count(DISTINCT status) > 1""",
    "merge_shared_run": f"""WITH {TASK_RUNS}, {PIPELINE_RUNS}
        SELECT * FROM pipeline_runs WHERE status <> 'running'
        UNION ALL
        SELECT run_id, module_path, started_at, ended_at, status FROM (
          SELECT run_id, 'job_' || task_name AS module_path, started_at, CAST(NULL AS TIMESTAMP) AS ended_at,
                 'running' AS status, row_number() OVER (PARTITION BY run_id ORDER BY started_at) AS rn
          FROM task_runs)
        WHERE rn = 1 AND run_id NOT IN (SELECT run_id FROM pipeline_runs WHERE status <> 'running')""",
    "merge_delta_keys": f"WITH {STATE_RUNS} SELECT DISTINCT task_name, attempt FROM state_runs",
    "merge_first_runs": f"WITH {TASK_RUNS}, {PIPELINE_RUNS} SELECT * FROM pipeline_runs",
    "merge_first_cache": f"""WITH {DEFS}
        SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM results""",
    "merge_first_prints": f"""WITH {DEFS}
        SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM stored""",
    "merge_first_lineage": f"WITH {NAMED_EDGES} SELECT * FROM named_edges",
    "fp_table": f"""WITH {PRINT_ROWS}, prints AS (
          SELECT flag, count(*) AS n_rows,
                 {half_sum(1)} AS high, {half_sum(17)} AS low
          FROM (SELECT flag, md5({" || ".join(cell(c) for c in PRINT_COLUMNS)}) AS h FROM old_rows) GROUP BY 1)
        SELECT flag, n_rows, CAST(high AS VARCHAR) || ':' || CAST(low AS VARCHAR) AS fingerprint FROM prints""",
    "fp_tree": f"""WITH {PRINT_ROWS}, edited AS (
          SELECT * REPLACE (CASE WHEN l_orderkey = 0 THEN cents + 1 ELSE cents END AS cents) FROM old_rows), prints AS (
          SELECT flag, count(*) AS n_rows,
                 {half_sum(1)} AS high, {half_sum(17)} AS low
          FROM (SELECT flag, md5({" || ".join(cell(c) for c in PRINT_COLUMNS)}) AS h FROM edited) GROUP BY 1)
        SELECT flag, n_rows, CAST(high AS VARCHAR) || ':' || CAST(low AS VARCHAR) AS fingerprint FROM prints""",
    "fp_changed_partitions": f"""WITH {PRINT_ROWS}, o AS (
          SELECT flag, count(*) AS n, md5(string_agg(concat_ws('|', l_orderkey, l_linenumber, cents, tax, l_shipdate), ','
                 ORDER BY l_orderkey, l_linenumber, cents, tax, l_shipdate)) AS h FROM old_rows GROUP BY 1),
        n AS (
          SELECT flag, count(*) AS n, md5(string_agg(concat_ws('|', l_orderkey, l_linenumber, cents, tax, l_shipdate), ','
                 ORDER BY l_orderkey, l_linenumber, cents, tax, l_shipdate)) AS h FROM new_rows GROUP BY 1)
        SELECT coalesce(o.flag, n.flag) AS flag,
               CASE WHEN o.flag IS NULL THEN 'added' WHEN n.flag IS NULL THEN 'removed'
                    WHEN o.h = n.h AND o.n = n.n THEN 'same' ELSE 'changed' END AS state
        FROM o FULL JOIN n ON o.flag = n.flag""",
    "refresh_result": f"""WITH {PRINT_ROWS}
        SELECT flag, l_linenumber, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(tax) AS BIGINT) AS tax
        FROM new_rows GROUP BY 1, 2""",
    "refresh_stored": f"""WITH {PRINT_ROWS}
        SELECT flag, l_linenumber, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(tax) AS BIGINT) AS tax
        FROM new_rows GROUP BY 1, 2""",
    "refresh_preview": f"WITH {PREVIEW} SELECT * FROM preview",
    "ready_to_run": f"""WITH {DEFS}, {NAMED_EDGES}, late AS (
          SELECT d.task_name FROM defs d LEFT JOIN stored s ON s.task_name = d.task_name
          WHERE s.fingerprint IS NULL OR s.fingerprint <> d.fingerprint)
        SELECT d.task_name, count(l.task_name) AS blockers, min(l.task_name) AS first_blocker,
               count(l.task_name) = 0 AS ready
        FROM defs d LEFT JOIN named_edges e ON e.task_name = d.task_name
        LEFT JOIN late l ON l.task_name = e.upstream_task_name GROUP BY 1""",
    "cache_report": f"""WITH {DEFS}
        SELECT task_name, fingerprint, CAST(sum(n_rows) AS BIGINT) AS n_rows,
               CAST(sum(size_bytes) AS BIGINT) AS size_bytes, sum(size_bytes) > 50 * 1024 * 1024 AS large
        FROM results GROUP BY 1, 2""",
    "hash_chain": """SELECT p_partkey, sha256(p_name || chr(0) || p_brand || chr(0) || CAST(p_size AS VARCHAR) || chr(0))
               AS hash FROM part""",
    "fp_definitions": f"""WITH {DEFS}
        SELECT task_name, sha256(source || chr(0) || config || chr(0) || 'a=' || source || chr(0)
               || 'size=' || CAST(p_size AS VARCHAR) || chr(0)) AS fingerprint FROM defs""",
    "fp_propagated": propagated_sql(EDGES),
    "fp_prefix_names": propagated_sql("""edges AS (
          SELECT DISTINCT task_name, upstream_task_name FROM (
            SELECT p_partkey AS task_name, unnest([p_partkey // 2, p_partkey // 20]) AS upstream_task_name FROM part)
          WHERE upstream_task_name > 0)"""),
    "snap_diff": f"""WITH {STATE_RUNS}
        SELECT {RUN_COLS}, 'removed' AS change, CAST(count(*) AS BIGINT) AS copies
        FROM state_runs WHERE status = 'skipped' GROUP BY ALL""",
    "pii_profile": """SELECT c AS column_name, t AS dtype, p AS position, (SELECT count(*) FROM customer) AS row_count
        FROM (VALUES ('c_custkey', 'bigint', 1), ('c_name', 'string', 2), ('email', 'string', 3),
                     ('phone', 'string', 4), ('signup_ip', 'string', 5), ('address', 'string', 6),
                     ('plan', 'string', 7)) v(c, t, p)""",
    "pii_scan": f"WITH {CONTACT_SCAN} SELECT column_name, position, name_hint, pattern, ratio FROM findings",
    "pii_triage": triage_sql(CONTACT_SCAN, "contacts", 7),
    "pii_triage_hint": triage_sql(scan_sql("supplier", {"s_name": 0}), "supplier", 4),
    "pii_triage_clean": triage_sql(scan_sql("documents", {"text": 0, "lang": 1, "source": 2}), "documents", 5),
    "pii_documents": "WITH "
    + scan_sql("documents", {"text": 0, "lang": 1, "source": 2})
    + " SELECT column_name, position, name_hint, pattern, ratio FROM findings",
    "non_null_counts": f"""WITH {CONTACTS}
        SELECT count(c_custkey) AS c_custkey, count(c_name) AS c_name, count(email) AS email, count(phone) AS phone,
               count(signup_ip) AS signup_ip, count(address) AS address, count(plan) AS plan FROM contacts""",
    "lineage_levels": f"""WITH RECURSIVE {EDGES}, walk AS (
          SELECT p_partkey AS task_name, 1 AS level FROM part
          WHERE p_partkey NOT IN (SELECT task_name FROM edges)
          UNION
          SELECT e.task_name, w.level + 1 FROM walk w JOIN edges e ON e.upstream_task_name = w.task_name)
        SELECT task_name, max(level) AS level FROM walk GROUP BY 1""",
    "lineage_roots": f"""WITH {EDGES}
        SELECT p_partkey AS task_name FROM part WHERE p_partkey NOT IN (SELECT task_name FROM edges)""",
    "lineage_descendants": f"""WITH RECURSIVE {EDGES}, walk AS (
          SELECT task_name, 1 AS distance FROM edges WHERE upstream_task_name = 2
          UNION
          SELECT e.task_name, w.distance + 1 FROM walk w JOIN edges e ON e.upstream_task_name = w.task_name)
        SELECT task_name, min(distance) AS distance FROM walk GROUP BY 1""",
    "lineage_deep_levels": "SELECT p_partkey AS task_name, greatest(p_partkey, 1) AS level FROM part",
    "lineage_deep_descendants": "SELECT p_partkey AS task_name, p_partkey - 10 AS distance FROM part WHERE p_partkey > 10",
    "lineage_failure": BELOW.format(
        views=f"""{EDGES}, outcomes AS (
          SELECT p_partkey AS task_name, CASE WHEN p_partkey % 97 = 30 THEN 'failed'
                 WHEN p_partkey % 89 = 40 THEN 'oom' ELSE 'success' END AS status FROM part)""",
        edges="edges",
        start="SELECT task_name FROM outcomes WHERE status <> 'success'",
    )
    + """ SELECT o.task_name, CASE WHEN b.task_name IS NOT NULL THEN 'upstream_failed' ELSE o.status END AS status
        FROM outcomes o LEFT JOIN below b ON b.task_name = o.task_name""",
    "lineage_cycles": f"""WITH RECURSIVE {EDGES}, back AS (
          SELECT p_partkey // 2 AS task_name, p_partkey AS upstream_task_name FROM part WHERE p_partkey % 50 = 7),
        all_edges AS (SELECT * FROM edges UNION ALL SELECT * FROM back),
        stuck AS (
          SELECT task_name FROM back UNION SELECT upstream_task_name FROM back
          UNION
          SELECT e.task_name FROM all_edges e JOIN stuck s ON e.upstream_task_name = s.task_name)
        SELECT task_name FROM stuck""",
    "lineage_adjacency": f"""WITH {DEFS}, {NAMED_EDGES}
        SELECT d.task_name,
               coalesce(string_agg(e.upstream_task_name, ',' ORDER BY e.upstream_task_name), '') AS depends_on
        FROM defs d LEFT JOIN named_edges e ON e.task_name = d.task_name GROUP BY 1""",
    "lineage_upstreams": f"""WITH {NAMED_EDGES}
        SELECT task_name,
               string_agg(upstream_task_name, ',' ORDER BY upstream_task_name) AS depends_on
        FROM named_edges GROUP BY 1""",
    "lineage_resume": BELOW.format(
        views=f"{PREVIEW}, {NAMED_EDGES}",
        edges="named_edges",
        start="SELECT task_name FROM preview WHERE next_run <> 'skip (unchanged)'",
    )
    + """ SELECT task_name FROM preview WHERE next_run <> 'skip (unchanged)'
        UNION SELECT task_name FROM below""",
    "lineage_duplicates": """SELECT p_brand || CAST(p_size AS VARCHAR) AS task_name, count(DISTINCT p_type) AS definitions
        FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""",
    "cost_per_run": f"""WITH {TASK_RUNS}, {SCENARIOS}, sized AS (SELECT *, {TIER} AS tier_mb FROM task_runs)
        SELECT event_id, tier_mb, scenario,
               round(tier_mb / 1769.0::DOUBLE * 1.948e-3::DOUBLE * (duration_ms / 1000.0::DOUBLE / 3600.0::DOUBLE)
                     * pue * 1e9::DOUBLE, 3) AS kwh_e9,
               round((tier_mb / 1024.0::DOUBLE * (duration_ms / 1000.0::DOUBLE) * 1.66667e-5::DOUBLE
                     + 0.2e-6::DOUBLE) * 1e9::DOUBLE, 3) AS usd_e9
        FROM sized CROSS JOIN scenarios""",
    "cost_rollup": f"""WITH {TASK_RUNS}, {SCENARIOS}, sized AS (SELECT *, {TIER} AS tier_mb FROM task_runs),
        daily AS (
          SELECT task_name, CAST(started_at AS DATE) AS day, count(*) AS runs,
                 sum(CAST(tier_mb AS BIGINT) * CAST(round(duration_ms * 1000) AS BIGINT))::DOUBLE / 1e6::DOUBLE AS mb_s
          FROM sized GROUP BY 1, 2),
        costed AS (
          SELECT *, mb_s / 1769.0::DOUBLE * 1.948e-3::DOUBLE / 3600.0::DOUBLE * pue AS kwh,
                 mb_s / 1024.0::DOUBLE * 1.66667e-5::DOUBLE + runs * 0.2e-6::DOUBLE AS usd,
                 4 * 24 * 365 * (4.34e-4::DOUBLE + (1.948e-3::DOUBLE - 4.34e-4::DOUBLE) * 0.15::DOUBLE) * pue AS standing
          FROM daily CROSS JOIN scenarios)
        SELECT task_name, day, scenario, runs, round(kwh * 1e9::DOUBLE, 3) AS kwh_e9,
               round(usd * 1e9::DOUBLE, 3) AS usd_e9, round(standing, 4) AS standing_kwh,
               round(standing / (kwh * 365), 2) AS multiple
        FROM costed""",
}
