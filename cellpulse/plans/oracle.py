"""Equivalent SQL per registered query, over the same tables.

``STEPS`` are named sub-queries; ``with_steps`` prepends those a statement mentions.
"""

import re

from cellpulse.operators.ml import TREE_GRID
from cellpulse.schemas import MODEL_FEATURES

STEPS = {}
ORACLE = {}


def with_steps(body: str) -> str:
    needed = []

    def visit(text):
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(STEPS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({STEPS[name]})" for name in needed)
    return f"WITH {parts}\n{body}"


STEPS["s_raw"] = """
SELECT CASE WHEN event_id % 997 <> 5 THEN date_trunc('hour', ts) END AS datetime,
       CASE WHEN event_id % 991 <> 7 THEN CAST(user_id // 38 + 1 AS INTEGER) END AS CellID,
       CAST(user_id AS INTEGER) AS countrycode,
       CASE WHEN event_type = 'click' THEN v END AS smsin,
       CASE WHEN event_type = 'view' THEN v END AS smsout,
       CASE WHEN event_type = 'purchase' THEN v END AS callin,
       CASE WHEN event_type = 'signup' THEN v END AS callout,
       CASE WHEN event_type = 'error' THEN v END AS internet,
       'sms-call-internet-mi-' || strftime(ts, '%Y-%m-%d') || '.csv' AS source_file
FROM (SELECT *, CASE WHEN event_id % 983 = 11 THEN -round(value * 100) - 1
                     ELSE round(value * 100) END AS v FROM events)"""

STEPS["s_canon"] = """
SELECT datetime AS timestamp, CellID AS grid_id, countrycode AS country_code, smsin AS sms_in,
       smsout AS sms_out, callin AS call_in, callout AS call_out, internet AS internet_activity,
       (datetime IS NULL OR CellID IS NULL
        OR coalesce(least(smsin, smsout, callin, callout, internet) < 0, false)) AS bad
FROM s_raw"""

STEPS["s_clean"] = """
SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls,
       sms_in + sms_out + call_in + call_out + internet_activity AS total_activity,
       CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour,
       CAST(dayofweek(timestamp) + 1 AS INTEGER) AS day_of_week
FROM (SELECT timestamp, grid_id, country_code, coalesce(sms_in, 0) AS sms_in,
             coalesce(sms_out, 0) AS sms_out, coalesce(call_in, 0) AS call_in,
             coalesce(call_out, 0) AS call_out,
             coalesce(internet_activity, 0) AS internet_activity
      FROM s_canon WHERE NOT bad)"""

STEPS["s_hourly"] = """
SELECT timestamp, grid_id, sum(sms_in) AS sms_in, sum(sms_out) AS sms_out,
       sum(call_in) AS call_in, sum(call_out) AS call_out,
       sum(internet_activity) AS internet_activity, sum(total_sms) AS total_sms,
       sum(total_calls) AS total_calls, sum(total_activity) AS total_activity,
       CASE WHEN sum(total_activity) > 0 THEN sum(internet_activity) / sum(total_activity)
            ELSE 0.0 END AS internet_share,
       CAST(timestamp AS DATE) AS date
FROM s_clean GROUP BY timestamp, grid_id"""

STEPS["s_text"] = """
SELECT coalesce(strftime(datetime, '%Y-%m-%d %H:%M:%S'), 'not-a-time') AS datetime,
       CAST(CellID AS VARCHAR) AS CellID, CAST(countrycode AS VARCHAR) AS countrycode,
       CAST(smsin AS VARCHAR) AS smsin, CAST(smsout AS VARCHAR) AS smsout,
       CAST(callin AS VARCHAR) AS callin, CAST(callout AS VARCHAR) AS callout,
       CAST(internet AS VARCHAR) AS internet, source_file
FROM s_raw"""

_CH = ["smsin", "smsout", "callin", "callout", "internet"]
_NEGATIVE = " ".join(
    f"WHEN neg_{c} > 0 THEN 'Negative activity values found in {c}: ' || neg_{c}" for c in _CH
)
_ODD = " ".join(f"WHEN odd_{c} > 0 THEN 'Non-numeric values found in {c}: ' || odd_{c}" for c in _CH)
STEPS["s_gate"] = f"""
SELECT filename, CASE WHEN refusal IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
       row_count, coalesce(refusal, CASE {_ODD} ELSE 'Minimum quality validation passed' END)
         AS reason
FROM (SELECT *, CASE
        WHEN filename LIKE '%7.csv' THEN 'Missing required column(s): internet'
        WHEN bad_times > 0 THEN 'Malformed timestamp values: ' || bad_times
        WHEN hours <> 24 THEN 'Expected exactly 24 distinct hourly timestamps, found ' || hours
        {_NEGATIVE} END AS refusal
      FROM (SELECT source_file AS filename, count(*) AS row_count,
                   count(*) - count(datetime) AS bad_times, count(DISTINCT datetime) AS hours,
                   {', '.join(f'count(*) - count({c}) AS odd_{c}' for c in _CH)},
                   {', '.join(f'count(*) FILTER ({c} < 0) AS neg_{c}' for c in _CH)}
            FROM s_raw GROUP BY source_file))"""

STEPS["s_lookup"] = """
SELECT CellID AS grid_id,
       CASE WHEN CellID % 11 = 2 THEN 'MultiPoint' ELSE 'Polygon' END AS geometry_type,
       CAST(CellID % 100 AS DOUBLE) AS x, CAST(CellID // 100 AS DOUBLE) AS y
FROM (SELECT DISTINCT CellID FROM s_raw WHERE CellID IS NOT NULL)"""
STEPS["s_some_lookup"] = "SELECT * FROM s_lookup WHERE grid_id % 3 <> 0"

STEPS["s_dim_time"] = """
SELECT row_number() OVER (ORDER BY timestamp) AS time_key, timestamp,
       CAST(timestamp AS DATE) AS date_value, CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
       CAST(dayofweek(timestamp) AS INTEGER) AS day_of_week
FROM (SELECT DISTINCT timestamp FROM s_hourly)"""
STEPS["s_dim_grid"] = """
SELECT row_number() OVER (ORDER BY grid_id) AS grid_key, grid_id,
       CASE WHEN geometry_type = 'Polygon' THEN round((5 * y + 2) / 5, 6) END
         AS centroid_latitude,
       CASE WHEN geometry_type = 'Polygon' THEN round((5 * x + 2) / 5, 6) END
         AS centroid_longitude,
       'cells.geojson#' || grid_id AS geometry_ref
FROM s_lookup"""
STEPS["s_fact"] = """
SELECT g.grid_key, t.time_key, h.sms_in, h.sms_out, h.call_in, h.call_out, h.internet_activity,
       h.total_sms, h.total_calls, h.total_activity
FROM s_hourly h JOIN s_dim_grid g ON h.grid_id = g.grid_id
                JOIN s_dim_time t ON h.timestamp = t.timestamp"""

_HOURLY_CHECKS = {
    "null_keys": "SELECT count(*) FROM s_hourly WHERE grid_id IS NULL OR timestamp IS NULL",
    "cells_out_of_range": "SELECT count(*) FROM s_hourly WHERE grid_id NOT BETWEEN 1 AND 10000",
    "null_measures": "SELECT count(*) FROM s_hourly WHERE total_activity IS NULL",
    "negative_measures": "SELECT count(*) FROM s_hourly WHERE total_activity < 0",
    "repeated_grain": "SELECT count(*) FROM (SELECT 1 FROM s_hourly GROUP BY timestamp, grid_id"
    " HAVING count(*) > 1)",
    "days_without_24_hours": "SELECT count(*) FROM (SELECT date FROM s_hourly GROUP BY date"
    " HAVING count(DISTINCT timestamp) <> 24)",
    "negative_daily_totals": "SELECT count(*) FROM (SELECT date FROM s_hourly"
    " GROUP BY date, grid_id HAVING sum(total_activity) < 0)",
    "missing_columns": "SELECT 0",
    "geometry_in_hourly": "SELECT 0",
}
STEPS["s_hourly_checks"] = " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, CAST(({sql}) AS BIGINT) AS failures"
    for name, sql in _HOURLY_CHECKS.items()
)


def _features(extra_columns, where):
    return f"""
SELECT grid_id, timestamp AS feature_timestamp, ra AS avg_activity,
       {extra_columns}
       CAST(ah AS INTEGER) AS active_hours,
       CASE WHEN ra = 0 THEN 0.0 ELSE pk / ra END AS peak_ratio,
       CASE WHEN rt = 0 THEN 0.0 ELSE ri / rt END AS internet_share
FROM (SELECT grid_id, timestamp, avg(total_activity) OVER near AS ra,
             max(total_activity) OVER near AS pk,
             count(*) FILTER (total_activity > 0) OVER near AS ah,
             stddev_samp(total_activity) OVER near AS ds,
             stddev_pop(total_activity) OVER near AS dp,
             sum(total_activity) OVER near AS rt, sum(internet_activity) OVER near AS ri,
             avg(total_activity) OVER far AS pa, count(*) OVER both_days AS n,
             count(*) OVER span AS n_span
      FROM s_hourly
      WINDOW near AS (PARTITION BY grid_id ORDER BY timestamp
                      ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
             far AS (PARTITION BY grid_id ORDER BY timestamp
                     ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING),
             both_days AS (PARTITION BY grid_id ORDER BY timestamp
                           ROWS BETWEEN 47 PRECEDING AND CURRENT ROW),
             span AS (PARTITION BY grid_id ORDER BY timestamp
                      RANGE BETWEEN INTERVAL 47 HOURS PRECEDING AND CURRENT ROW))
WHERE {where}"""


STEPS["s_features"] = _features(
    """CASE WHEN pa = 0 THEN CASE WHEN ra = 0 THEN 0.0 ELSE 1.0 END ELSE (ra - pa) / pa END
         AS activity_growth,
       coalesce(ds, 0.0) AS variability,""",
    "n_span = 48",
)
STEPS["s_features_pop"] = _features(
    """CASE WHEN pa = 0 THEN 0.0 ELSE (ra - pa) / pa END AS activity_growth,
       coalesce(dp, 0.0) AS variability,""",
    "n = 48",
)
STEPS["s_median"] = """
SELECT grid_id, timestamp AS feature_timestamp, m AS trailing_median_24h
FROM (SELECT grid_id, timestamp, median(total_activity) OVER w AS m, count(*) OVER w AS n
      FROM s_hourly
      WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp
                   RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW))
WHERE n = 24"""
STEPS["s_labels"] = """
SELECT m.grid_id, m.feature_timestamp, h.timestamp AS target_timestamp,
       h.total_activity AS target_activity, m.trailing_median_24h,
       CASE WHEN m.trailing_median_24h > 0 THEN h.total_activity / m.trailing_median_24h END
         AS target_ratio,
       CAST(h.total_activity > 1.5 * m.trailing_median_24h AS INTEGER) AS high_activity
FROM s_median m JOIN s_hourly h
  ON h.grid_id = m.grid_id AND h.timestamp = m.feature_timestamp + INTERVAL 1 HOUR"""
STEPS["s_calendar"] = """
SELECT DISTINCT timestamp AS feature_timestamp, CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
       CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week
FROM s_hourly"""
STEPS["s_table2"] = """
SELECT f.*, m.trailing_median_24h, c.hour_of_day, c.day_of_week
FROM s_features f JOIN s_median m USING (grid_id, feature_timestamp)
                  JOIN s_calendar c USING (feature_timestamp)"""
STEPS["s_train"] = """
SELECT f.*, l.target_timestamp, l.target_activity, l.trailing_median_24h, l.target_ratio,
       l.high_activity, c.hour_of_day, c.day_of_week
FROM s_features f JOIN s_labels l USING (grid_id, feature_timestamp)
                  JOIN s_calendar c USING (feature_timestamp)"""
STEPS["s_scored"] = """
SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction
FROM (SELECT *, round(least(peak_ratio / 6, 1.0), 6) AS probability FROM s_train)"""

STEPS["s_daily_total"] = """
SELECT grid_id, date, sum(total_activity) AS total, count(*) AS n
FROM s_hourly GROUP BY grid_id, date"""
STEPS["s_ranked_day"] = """
SELECT grid_id, timestamp, date, total_activity,
       list(total_activity) OVER (PARTITION BY grid_id, date) AS day_values
FROM s_hourly"""
STEPS["s_loo"] = """
SELECT grid_id, timestamp, date, total_activity, day_values,
       CASE WHEN len(day_values) > 1 THEN list_aggregate(
            list_concat(list_sort(day_values)[:list_position(list_sort(day_values),
                                                             total_activity) - 1],
                        list_sort(day_values)[list_position(list_sort(day_values),
                                                            total_activity) + 1:]),
            'median') END AS baseline_activity
FROM s_ranked_day"""
STEPS["s_hours"] = """
SELECT l.grid_id, l.timestamp, l.total_activity,
       lag(l.total_activity) OVER (PARTITION BY l.grid_id ORDER BY l.timestamp)
         AS previous_activity,
       l.baseline_activity, d.n,
       d.total >= (SELECT quantile_cont(total, 0.1) FROM s_daily_total) AS above_floor
FROM s_loo l JOIN s_daily_total d ON l.grid_id = d.grid_id AND l.date = d.date"""


def _alerts(condition, baseline):
    def one(kind, rule, text):
        return f"""SELECT grid_id, timestamp, '{kind}' AS alert_type,
              total_activity AS current_activity, {baseline} AS baseline_activity,
              'Current activity ' || printf('%.2f', total_activity) || {text} || '.' AS reason
       FROM s_hours WHERE {condition} AND {rule}"""

    return " UNION ALL ".join(
        [
            one("HIGH_ACTIVITY", f"total_activity >= 1.5 * {baseline}",
                "' is at least 1.50x the within-day baseline ' || "
                f"printf('%.2f', {baseline})"),
            one("ACTIVITY_SPIKE",
                "previous_activity IS NOT NULL AND total_activity >= 1.5 * previous_activity",
                "' is at least 1.50x the preceding hour ' || printf('%.2f', previous_activity)"),
            one("ACTIVITY_DROP", f"total_activity <= 0.5 * {baseline}",
                "' is at most 0.50x the within-day baseline ' || "
                f"printf('%.2f', {baseline})"),
        ]
    )


STEPS["s_alerts"] = (
    "SELECT *, CASE WHEN alert_type = 'HIGH_ACTIVITY' THEN 'HIGH' ELSE 'MEDIUM' END AS severity"
    f" FROM ({_alerts('above_floor AND n = 24', 'baseline_activity')})"
)
STEPS["s_alerts_any"] = _alerts("above_floor", "baseline_activity")

STEPS["s_anomalies"] = """
SELECT grid_id, timestamp, hour_of_day, total_activity, historical_baseline, baseline_count,
       deviation, abs(deviation) AS anomaly_score, anomaly_direction,
       CAST(anomaly_direction IN ('HIGH', 'LOW') AS INTEGER) AS anomaly_flag,
       CASE WHEN anomaly_direction IN ('HIGH', 'LOW') THEN 'INVESTIGATE' ELSE 'NONE' END
         AS recommended_action,
       CASE anomaly_direction
         WHEN 'HIGH' THEN 'Activity is ' || pct || '% above the historical baseline for ' || place
              || ' (baseline=' || printf('%.2f', historical_baseline) || ', history_count='
              || baseline_count || ').'
         WHEN 'LOW' THEN 'Activity is ' || pct || '% below the historical baseline for ' || place
              || ' (baseline=' || printf('%.2f', historical_baseline) || ', history_count='
              || baseline_count || ').'
         WHEN 'NORMAL' THEN 'Activity is within the historical range for ' || place
              || ' (' || pct || '% absolute deviation).'
         ELSE 'Insufficient historical observations to establish a reliable baseline for '
              || place || ' (history_count=' || baseline_count || '; minimum_required=3).'
       END AS reason
FROM (SELECT *, CASE WHEN deviation IS NULL THEN 'UNKNOWN' WHEN deviation >= 0.5 THEN 'HIGH'
                     WHEN deviation <= -0.5 THEN 'LOW' ELSE 'NORMAL' END AS anomaly_direction,
             printf('%.1f', round(abs(deviation) * 1000) / 10) AS pct,
             printf('grid %d at hour %02d', grid_id, hour_of_day) AS place
      FROM (SELECT *, CASE WHEN historical_baseline <> 0
                      THEN (total_activity - historical_baseline) / historical_baseline END
                        AS deviation
            FROM (SELECT grid_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
                         total_activity,
                         CAST(row_number() OVER w - 1 AS INTEGER) AS baseline_count,
                         CASE WHEN row_number() OVER w > 3 THEN median(total_activity) OVER (
                              PARTITION BY grid_id, hour(timestamp) ORDER BY timestamp
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END
                           AS historical_baseline
                  FROM s_hourly
                  WINDOW w AS (PARTITION BY grid_id, hour(timestamp) ORDER BY timestamp))))"""
STEPS["s_buckets"] = """
SELECT grid_id, CAST(hour(timestamp) AS INTEGER) AS hour_of_day, count(*) AS bucket_count
FROM s_hourly GROUP BY ALL"""

STEPS["s_predictions"] = """
SELECT grid_id, target_timestamp AS timestamp, peak_ratio, activity_growth, trailing_median_24h,
       target_activity, prediction AS ml_prediction, probability AS ml_prediction_probability
FROM s_scored"""
STEPS["s_indicators"] = """
SELECT grid_id, timestamp, CAST(max(alert_type = 'HIGH_ACTIVITY') AS INTEGER) AS np3_high,
       CAST(max(alert_type = 'ACTIVITY_SPIKE') AS INTEGER) AS np3_spike,
       max(CASE WHEN alert_type = 'HIGH_ACTIVITY' THEN baseline_activity END)
         AS np3_baseline_activity
FROM s_alerts GROUP BY grid_id, timestamp"""


def _three(third):
    return f"""CASE WHEN m3 AND m4 AND {third} THEN 'ALL_THREE'
            WHEN m3 AND m4 THEN 'ML3_ML4_ONLY' WHEN m3 AND {third} THEN 'ML3_NP3_ONLY'
            WHEN m4 AND {third} THEN 'ML4_NP3_ONLY' WHEN m3 THEN 'ML3_ONLY'
            WHEN m4 THEN 'ML4_ONLY' WHEN {third} THEN 'NP3_ONLY' ELSE 'NONE' END"""


def _two(a, b, names):
    both, first, second, none = names
    return (
        f"CASE WHEN {a} AND {b} THEN '{both}' WHEN {a} THEN '{first}' WHEN {b} THEN '{second}'"
        f" ELSE '{none}' END"
    )


STEPS["s_compared"] = f"""
SELECT * EXCLUDE (m3, m4, odd, n_high, n_spike),
       {_two('m3', 'odd', ['BOTH_ANOMALY', 'ML3_ONLY', 'ML4_ONLY', 'NEITHER'])}
         AS agreement_category,
       CASE WHEN m3 AND m4 THEN 'BOTH_ML3_AND_ML4_HIGH' WHEN m3 THEN 'ML3_HIGH_ONLY'
            WHEN m4 THEN 'ML4_HIGH_ONLY' WHEN anomaly_direction = 'LOW' THEN 'ML4_LOW'
            ELSE 'NEITHER_HIGH' END AS direction_category,
       {_two('m3', 'm4', ['BOTH_HIGH', 'ML3_HIGH_ONLY', 'ML4_HIGH_ONLY', 'NEITHER_HIGH'])}
         AS high_comparison_group,
       {_two('m3', 'n_high', ['BOTH_AGREE_HIGH_ACTIVITY', 'ML_ONLY', 'NP3_ONLY', 'NEITHER'])}
         AS ml_vs_rule_high,
       {_two('m3', 'n_spike', ['BOTH_AGREE_SPIKE', 'ML_ONLY', 'NP3_ONLY', 'NEITHER'])}
         AS ml_vs_rule_spike,
       {_three('n_high')} AS three_way_high_category,
       {_three('n_spike')} AS three_way_spike_category
FROM (SELECT p.*, a.hour_of_day, a.total_activity, a.historical_baseline, a.deviation,
             a.anomaly_direction, a.anomaly_flag, coalesce(i.np3_high, 0) AS np3_high,
             coalesce(i.np3_spike, 0) AS np3_spike, i.np3_baseline_activity,
             p.ml_prediction = 1 AS m3, a.anomaly_direction = 'HIGH' AS m4,
             a.anomaly_flag = 1 AS odd, coalesce(i.np3_high, 0) = 1 AS n_high,
             coalesce(i.np3_spike, 0) = 1 AS n_spike
      FROM s_predictions p JOIN s_anomalies a USING (grid_id, timestamp)
      LEFT JOIN s_indicators i USING (grid_id, timestamp))"""

STEPS["s_requests"] = """
SELECT DISTINCT grid_id, date_trunc('day', timestamp) + INTERVAL 810 MINUTES AS as_of
FROM s_hourly"""
STEPS["s_day_pairs"] = """
SELECT DISTINCT grid_id, date AS date_a, CAST(date + 7 AS DATE) AS date_b FROM s_hourly"""


def _stats(by):
    return f"""
SELECT {by}, sum(total_activity) AS total, avg(total_activity) AS average,
       sum(total_sms) AS sms_total, avg(total_sms) AS sms_avg, max(total_sms) AS sms_peak,
       sum(total_calls) AS calls_total, avg(total_calls) AS calls_avg,
       max(total_calls) AS calls_peak, sum(internet_activity) AS internet_total,
       avg(internet_activity) AS internet_avg, max(internet_activity) AS internet_peak,
       max(total_activity) AS peak,
       CAST(hour(min(timestamp) FILTER (total_activity = m)) AS INTEGER) AS peak_hour
FROM (SELECT *, max(total_activity) OVER (PARTITION BY {by}) AS m FROM s_hourly) GROUP BY {by}"""


STEPS["s_cell_stats"] = _stats("grid_id")
STEPS["s_day_stats"] = _stats("grid_id, date")


def _r(*names):
    """Replacement list that rounds the named columns."""
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_SIX = ["avg_activity", "activity_growth", "peak_ratio", "variability", "internet_share"]


def _describe(table, columns, extra=()):
    parts = []
    for c in columns:
        qs = "".join(
            f", round(quantile_cont({c}, {q}), 6) AS {name}"
            for q, name in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75"), *extra]
        )
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
                round(stddev_samp({c}), 6) AS std,
                round(CAST(min({c}) AS DOUBLE), 6) AS min_value,
                round(CAST(max({c}) AS DOUBLE), 6) AS max_value{qs} FROM {table}"""
        )
    return " UNION ALL ".join(parts)


def _shares(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS comparison, {c} AS category, count(*) AS n_rows,
            round(count(*) * 100.0 / (SELECT count(*) FROM {table}), 6) AS percentage
            FROM {table} GROUP BY {c}"""
        for c in columns
    )


def oracle(**statements):
    for name, body in statements.items():
        ORACLE[name] = body


oracle(
    clean="SELECT * FROM s_clean",
    rejected="SELECT * EXCLUDE (bad) FROM s_canon WHERE bad",
    null_profile="\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
                   round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct FROM s_raw"""
        for c in ["smsin", "smsout", "callin", "callout", "internet"]
    ),
    row_balance="""
        SELECT (SELECT count(*) FROM s_raw) AS raw_rows,
               (SELECT count(*) FROM s_clean) AS clean_rows,
               (SELECT count(*) FROM s_canon WHERE bad) AS rejected_rows,
               true AS balanced""",
    time_parts="""
        SELECT DISTINCT timestamp, CAST(timestamp AS DATE) AS date,
               CAST(hour(timestamp) AS INTEGER) AS hour,
               CAST(dayofweek(timestamp) + 1 AS INTEGER) AS dow_sunday_1,
               CAST(dayofweek(timestamp) AS INTEGER) AS dow_sunday_0,
               CAST(isodow(timestamp) - 1 AS INTEGER) AS dow_monday_0,
               dayname(timestamp) AS day_name
        FROM s_hourly""",
    profile="""
        SELECT count(DISTINCT source_file) AS files, count(*) AS total_rows,
               count(DISTINCT CellID) AS unique_cells,
               count(DISTINCT countrycode) AS unique_countries,
               count(DISTINCT datetime) AS unique_hours,
               min(datetime) AS time_start, max(datetime) AS time_end,
               CAST(8 AS INTEGER) AS total_columns,
               (SELECT h FROM (SELECT h, count(*) AS n FROM (
                    SELECT date_diff('second', lag(datetime) OVER (ORDER BY datetime), datetime)
                           / 3600.0 AS h
                    FROM (SELECT DISTINCT datetime FROM s_raw WHERE datetime IS NOT NULL))
                  WHERE h IS NOT NULL GROUP BY h) ORDER BY n DESC, h LIMIT 1) AS cadence_hours,
               (SELECT CAST(sum(n - 1) AS BIGINT) FROM (
                    SELECT count(*) AS n FROM s_raw GROUP BY datetime, CellID, countrycode))
                 AS repeated_rows
        FROM s_raw""",
    multi_country="""
        SELECT timestamp, grid_id, count(DISTINCT country_code) AS countries,
               count(*) AS source_rows
        FROM s_clean GROUP BY timestamp, grid_id HAVING count(DISTINCT country_code) > 1""",
    country_freq="SELECT country_code, count(*) AS frequency FROM s_canon GROUP BY country_code",
    grain_check="""
        SELECT datetime, CellID, countrycode, count(*) AS n_rows FROM s_raw
        GROUP BY datetime, CellID, countrycode HAVING count(*) > 1""",
    hourly_summary="SELECT * REPLACE (round(internet_share, 6) AS internet_share) FROM s_hourly",
    daily_summary="""
        SELECT date, grid_id, sum(total_activity) AS daily_activity, sum(total_sms) AS daily_sms,
               sum(total_calls) AS daily_calls, sum(internet_activity) AS daily_internet,
               round(avg(total_activity), 6) AS daily_avg_activity,
               max(total_activity) AS daily_max_activity,
               min(total_activity) AS daily_min_activity,
               round(CASE WHEN sum(total_activity) > 0
                     THEN sum(internet_activity) / sum(total_activity) ELSE 0 END, 6)
                 AS internet_share
        FROM s_hourly GROUP BY date, grid_id""",
    daily_share="""
        SELECT h.timestamp, h.grid_id, h.date, h.total_activity, h.internet_activity,
               d.a AS daily_activity, d.i AS daily_internet,
               round(CASE WHEN d.a > 0 THEN h.total_activity / d.a ELSE 0 END, 6) AS share_of_day,
               round(CASE WHEN d.a > 0 THEN d.i / d.a ELSE 0 END, 6) AS daily_internet_share
        FROM s_hourly h JOIN (SELECT date, grid_id, sum(total_activity) AS a,
                                     sum(internet_activity) AS i
                              FROM s_hourly GROUP BY date, grid_id) d
          ON h.date = d.date AND h.grid_id = d.grid_id""",
    daily_network="""
        SELECT date, sum(total_sms) AS total_sms, sum(total_calls) AS total_calls,
               sum(internet_activity) AS internet_activity,
               sum(total_activity) AS total_activity, count(DISTINCT grid_id) AS unique_grids
        FROM s_hourly GROUP BY date""",
    grid_summary="""
        SELECT grid_id, sum(total_sms) AS total_sms, sum(total_calls) AS total_calls,
               sum(internet_activity) AS internet_activity,
               sum(total_activity) AS total_activity, count(DISTINCT timestamp) AS active_hours
        FROM s_hourly GROUP BY grid_id""",
    dashboard_hourly="""
        SELECT timestamp, sum(total_activity) AS total_activity, sum(total_sms) AS total_sms,
               sum(total_calls) AS total_calls, sum(internet_activity) AS internet_activity,
               count(DISTINCT grid_id) AS active_grid_count
        FROM s_hourly GROUP BY timestamp""",
    dashboard_hourly_channels="""
        SELECT timestamp, sum(total_activity) AS total_activity, sum(sms_in) AS total_sms_in,
               sum(sms_out) AS total_sms_out, sum(call_in) AS total_call_in,
               sum(call_out) AS total_call_out,
               sum(internet_activity) AS total_internet_activity,
               count(DISTINCT grid_id) AS active_grid_count
        FROM s_hourly GROUP BY timestamp""",
    kpis="""
        SELECT (SELECT count(*) FROM s_raw) AS input_rows,
               (SELECT count(*) FROM s_clean) AS cleaned_rows,
               count(*) AS grid_hour_rows, count(DISTINCT grid_id) AS unique_grids,
               min(timestamp) AS time_start, max(timestamp) AS time_end,
               (SELECT CAST(hour(timestamp) AS INTEGER) FROM s_hourly GROUP BY 1
                ORDER BY sum(total_activity) DESC, 1 LIMIT 1) AS busiest_hour,
               (SELECT grid_id FROM s_hourly GROUP BY 1
                ORDER BY sum(total_activity) DESC, 1 LIMIT 1) AS busiest_grid,
               sum(total_sms) AS total_sms, sum(total_calls) AS total_calls,
               sum(total_activity) AS total_activity
        FROM s_hourly""",
    peak_hour="""
        SELECT timestamp, sum(total_activity) AS network_activity FROM s_hourly
        GROUP BY timestamp ORDER BY 2 DESC, 1 LIMIT 1""",
    peak_per_grid="""
        SELECT grid_id, timestamp AS peak_activity_hour, total_activity AS peak_activity
        FROM (SELECT *, row_number() OVER (PARTITION BY grid_id
                                           ORDER BY total_activity DESC, timestamp) AS r
              FROM s_hourly) WHERE r = 1""",
    overall_peak="""
        SELECT grid_id, timestamp, total_activity FROM s_hourly
        ORDER BY total_activity DESC, timestamp, grid_id LIMIT 1""",
    hotspots="""
        SELECT grid_id, sum(total_activity) AS total_activity FROM s_hourly
        GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10""",
    hotspots_window="""
        SELECT grid_id, sum(total_activity) AS total_activity FROM s_hourly
        WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'
        GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 3""",
    hotspot_rank="""
        SELECT timestamp, date, grid_id, total_activity,
               CAST(row_number() OVER (PARTITION BY timestamp
                    ORDER BY total_activity DESC, grid_id) AS INTEGER) AS hotspot_rank
        FROM s_hourly""",
)

oracle(
    csv_scan="SELECT * FROM s_raw",
    csv_scan_text="SELECT * FROM s_text",
    ingest_gate="SELECT * FROM s_gate",
    ingest_gate_extras="""
        SELECT source_file AS filename, CAST(0 AS BIGINT) AS rows_of_other_dates,
               count(*) - count(DISTINCT (datetime, coalesce(CellID, '-'), countrycode))
                 AS repeated_rows
        FROM s_text GROUP BY source_file""",
    ingest_route="""
        SELECT t.*, CASE WHEN g.status = 'ACCEPTED' THEN 'raw' ELSE 'rejected' END AS zone
        FROM s_text t JOIN s_gate g ON t.source_file = g.filename""",
    ingest_ledger="SELECT *, TIMESTAMP '2024-01-31 06:00:00' AS processed_at FROM s_gate",
    run_status_record="""
        SELECT 'run-1' AS run_id, TIMESTAMP '2024-01-31 06:00:00' AS timestamp, 'FAILED' AS status,
               rows_in, rows_rejected, CAST(7 AS BIGINT) AS nulls_handled, rows_published, current_as_of,
               false AS healthy, 'load_warehouse=FAILED,publish=SKIPPED,spark_process=SUCCESS' AS tasks,
               current_as_of AS latest_data_timestamp, age_hours, freshness AS indicator,
               'Warehouse loading was not successful.' AS reasons
        FROM (SELECT CAST(sum(row_count) AS BIGINT) AS rows_in,
               CAST(coalesce(sum(row_count) FILTER (status = 'REJECTED'), 0) AS BIGINT)
                 AS rows_rejected,
               (SELECT count(*) FROM s_hourly) AS rows_published,
               (SELECT max(timestamp) FROM s_hourly) AS current_as_of,
               round(date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                               TIMESTAMP '2024-01-31 06:00:00') / 3600.0, 6) AS age_hours,
               '' AS reasons,
               round(100.0 * coalesce(sum(row_count) FILTER (status = 'REJECTED'), 0)
                     / sum(row_count), 6) AS rejection_rate_pct,
               CASE WHEN date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                                   TIMESTAMP '2024-01-31 06:00:00') <= 7200 THEN 'FRESH'
                    WHEN date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                                   TIMESTAMP '2024-01-31 06:00:00') <= 86400 THEN 'RECENT'
                    ELSE 'STALE' END AS freshness,
               true AS healthy, 'SUCCESS' AS status
        FROM s_gate)""",
    run_status="""
        SELECT CAST(sum(row_count) AS BIGINT) AS rows_in,
               CAST(coalesce(sum(row_count) FILTER (status = 'REJECTED'), 0) AS BIGINT)
                 AS rows_rejected,
               (SELECT count(*) FROM s_hourly) AS rows_published,
               (SELECT max(timestamp) FROM s_hourly) AS current_as_of,
               round(date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                               TIMESTAMP '2024-01-31 06:00:00') / 3600.0, 6) AS age_hours,
               '' AS reasons,
               round(100.0 * coalesce(sum(row_count) FILTER (status = 'REJECTED'), 0)
                     / sum(row_count), 6) AS rejection_rate_pct,
               CASE WHEN date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                                   TIMESTAMP '2024-01-31 06:00:00') <= 7200 THEN 'FRESH'
                    WHEN date_diff('second', (SELECT max(timestamp) FROM s_hourly),
                                   TIMESTAMP '2024-01-31 06:00:00') <= 86400 THEN 'RECENT'
                    ELSE 'STALE' END AS freshness,
               true AS healthy, 'SUCCESS' AS status
        FROM s_gate""",
    sink_roundtrip="""
        SELECT count(*) AS expected_rows, count(*) AS stored_rows,
               count(DISTINCT date) AS expected_partitions,
               count(DISTINCT date) AS stored_partitions, true AS schema_match, true AS passed
        FROM s_hourly""",
    dedupe="""
        SELECT timestamp, grid_id, country_code, total_activity, total_sms, total_calls
        FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, grid_id, country_code
                          ORDER BY total_activity, total_sms, total_calls) AS r
              FROM s_clean) WHERE r = 1""",
    geo_lookup="""
        SELECT grid_id, geometry_type,
               CASE WHEN geometry_type = 'Polygon' THEN CAST(5 AS INTEGER) END AS ring_points,
               CASE WHEN geometry_type = 'Polygon' THEN x END AS first_longitude,
               CASE WHEN geometry_type = 'Polygon' THEN y END AS first_latitude
        FROM s_lookup""",
    geo_enrich="""
        SELECT h.grid_id, h.timestamp, h.total_activity, l.geometry_type
        FROM s_hourly h LEFT JOIN s_some_lookup l ON h.grid_id = l.grid_id""",
    geo_coverage="""
        SELECT count(*) AS total_rows, count(l.grid_id) AS matched_rows,
               count(DISTINCT h.grid_id) AS total_cells,
               count(DISTINCT l.grid_id) AS matched_cells,
               round(100.0 * count(l.grid_id) / count(*), 6) AS coverage_pct
        FROM s_hourly h LEFT JOIN s_some_lookup l ON h.grid_id = l.grid_id""",
    unmatched_cells="""
        SELECT DISTINCT grid_id FROM s_hourly
        WHERE grid_id NOT IN (SELECT grid_id FROM s_some_lookup)""",
    geometry_types="""
        SELECT geometry_type, count(*) AS cells FROM s_lookup GROUP BY geometry_type""",
    geo_validate="""
        SELECT count(*) AS cells, count(*) - count(l.grid_id) AS missing_geometry,
               count(*) - count(l.grid_id) AS empty_geometry,
               count(*) - count(l.grid_id) AS invalid_geometry,
               count(*) = count(l.grid_id) AS valid
        FROM (SELECT DISTINCT grid_id FROM s_hourly) h
        LEFT JOIN s_some_lookup l ON h.grid_id = l.grid_id""",
    hotspots_geo="""
        SELECT t.grid_id, t.total_activity, l.geometry_type
        FROM (SELECT grid_id, sum(total_activity) AS total_activity FROM s_hourly
              GROUP BY grid_id ORDER BY 2 DESC, 1 LIMIT 10) t
        LEFT JOIN s_some_lookup l ON t.grid_id = l.grid_id""",
    dim_time="SELECT * FROM s_dim_time",
    dim_grid="SELECT * FROM s_dim_grid",
    dim_upsert="""
        SELECT row_number() OVER (ORDER BY timestamp < TIMESTAMP '2024-01-16', timestamp)
                 AS time_key,
               timestamp, date_value, hour_of_day, day_of_week
        FROM s_dim_time""",
    alert_style_upsert="""
        SELECT grid_id, timestamp,
               CASE WHEN hour(timestamp) >= 12 THEN total_calls ELSE total_sms END AS v
        FROM s_hourly""",
    fact_build="SELECT * FROM s_fact",
    fact_load="""
        SELECT f.* FROM s_fact f JOIN s_dim_time t ON f.time_key = t.time_key
        WHERE t.date_value >= DATE '2024-01-08'""",
    dimension_coverage="""
        SELECT count(*) AS hourly_rows,
               count(*) FILTER (grid_id % 3 <> 0) AS rows_in_dim_grid,
               count(*) AS rows_in_dim_time
        FROM s_hourly""",
    star_history="""
        SELECT g.grid_id, t.timestamp, t.date_value, t.hour_of_day,
               f.* EXCLUDE (grid_key, time_key)
        FROM s_fact f JOIN s_dim_grid g ON f.grid_key = g.grid_key
                      JOIN s_dim_time t ON f.time_key = t.time_key""",
    warehouse_checks="""
        SELECT (SELECT count(*) + count(*) FILTER ((grid_key * 31 + time_key) % 97 = 0) FROM s_fact) AS fact_rows,
               (SELECT count(*) FILTER ((grid_key * 31 + time_key) % 89 = 0)
                       + count(*) FILTER ((grid_key * 31 + time_key) % 89 = 0
                                          AND (grid_key * 31 + time_key) % 97 = 0)
                FROM s_fact) AS null_measure_rows,
               (SELECT count(*) FROM s_dim_grid) AS grid_rows,
               (SELECT count(*) FROM s_dim_time) AS time_rows,
               CAST(0 AS BIGINT) AS cells_out_of_range, CAST(0 AS BIGINT) AS repeated_grids,
               (SELECT count(*) FILTER ((grid_key * 31 + time_key) % 97 = 0) FROM s_fact)
                 AS repeated_facts,
               false AS passed""",
    hourly_checks="SELECT *, failures = 0 AS passed FROM s_hourly_checks",
    publish_gate="""
        SELECT count(*) AS checks_run, count(*) FILTER (failures > 0) AS checks_failed,
               coalesce(string_agg(check_name, ', ' ORDER BY check_name)
                        FILTER (failures > 0), '') AS failed_checks,
               CASE WHEN count(*) FILTER (failures > 0) = 0 THEN 'PUBLISH'
                    ELSE 'DO NOT PUBLISH' END AS decision
        FROM s_hourly_checks""",
    audit_sample="""
        SELECT grid_id, timestamp, total_activity FROM s_hourly
        WHERE (grid_id * 31 + hour(timestamp) + dayofyear(timestamp) * 7) % 7 = 0""",
)

_FEATURE_CHECKS = {
    "null_rows": "SELECT count(*) FROM s_features WHERE avg_activity IS NULL",
    "non_finite_rows": "SELECT count(*) FROM s_features WHERE NOT isfinite(avg_activity)",
    "cells_out_of_range": "SELECT count(*) FROM s_features WHERE grid_id NOT BETWEEN 1 AND 10000",
    "active_hours_out_of_range":
        "SELECT count(*) FROM s_features WHERE active_hours NOT BETWEEN 0 AND 24",
    "share_out_of_range":
        "SELECT count(*) FROM s_features WHERE internet_share NOT BETWEEN 0 AND 1",
    "repeated_keys": "SELECT count(*) - count(DISTINCT (grid_id, feature_timestamp))"
                     " FROM s_features",
}
_CATEGORIES = [
    "agreement_category", "direction_category", "high_comparison_group", "ml_vs_rule_high",
    "ml_vs_rule_spike", "three_way_high_category", "three_way_spike_category",
]
_PROFILED = [
    "peak_ratio", "activity_growth", "trailing_median_24h", "target_activity",
    "ml_prediction_probability", "deviation", "historical_baseline",
]
_GROUPS = ["BOTH_HIGH", "ML3_HIGH_ONLY", "ML4_HIGH_ONLY", "NEITHER_HIGH"]

oracle(
    cadence_gaps="""
        SELECT grid_id, timestamp, p AS previous_timestamp,
               round(date_diff('second', p, timestamp) / 3600.0, 6) AS hour_difference,
               coalesce(date_diff('second', p, timestamp) <> 3600, false) AS cadence_gap
        FROM (SELECT grid_id, timestamp,
                     lag(timestamp) OVER (PARTITION BY grid_id ORDER BY timestamp) AS p
              FROM s_hourly)""",
    cadence_gaps_feed="""
        SELECT timestamp, p AS previous_timestamp,
               round(date_diff('second', p, timestamp) / 3600.0, 6) AS hour_difference,
               coalesce(date_diff('second', p, timestamp) <> 3600, false) AS cadence_gap
        FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS p
              FROM (SELECT DISTINCT timestamp FROM s_hourly))""",
    cadence_gaps_network="""
        SELECT date, timestamp, p AS previous_timestamp,
               round(date_diff('second', p, timestamp) / 3600.0, 6) AS hour_difference,
               coalesce(date_diff('second', p, timestamp) <> 3600, false) AS cadence_gap
        FROM (SELECT date, timestamp,
                     lag(timestamp) OVER (PARTITION BY date ORDER BY timestamp) AS p
              FROM (SELECT DISTINCT date, timestamp FROM s_hourly))""",
    sequences="""
        SELECT grid_id, timestamp, total_activity, p AS previous_timestamp,
               coalesce(p <> timestamp - INTERVAL 1 HOUR, false) AS cadence_gap,
               CAST(count(*) FILTER (p IS NULL OR p <> timestamp - INTERVAL 1 HOUR)
                    OVER (PARTITION BY grid_id ORDER BY timestamp
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
                 AS sequence_id
        FROM (SELECT grid_id, timestamp, total_activity,
                     lag(timestamp) OVER (PARTITION BY grid_id ORDER BY timestamp) AS p
              FROM s_hourly)""",
    features=f"SELECT * REPLACE ({_r(*_SIX)}) FROM s_features",
    features_pop=f"SELECT * REPLACE ({_r(*_SIX)}) FROM s_features_pop",
    feature_table=f"SELECT * REPLACE ({_r(*_SIX)}) FROM s_table2",
    feature_checks=" UNION ALL ".join(
        f"SELECT '{n}' AS check_name, ({q}) AS failures, ({q}) = 0 AS passed"
        for n, q in _FEATURE_CHECKS.items()
    ),
    feature_describe=_describe(
        "s_table2",
        ["avg_activity", "activity_growth", "peak_ratio", "variability", "internet_share",
         "trailing_median_24h", "hour_of_day", "day_of_week"],
    ),
    trailing_median="SELECT * FROM s_median",
    next_hour_label=f"SELECT * REPLACE ({_r('target_ratio')}) FROM s_labels",
    ml_dataset=f"SELECT * REPLACE ({_r(*_SIX, 'target_ratio')}) FROM s_train",
    training_table=f"SELECT * REPLACE ({_r(*_SIX, 'target_ratio')}) FROM s_train",
    target_ratio_stats=_describe(
        "s_labels",
        ["target_ratio", "trailing_median_24h", "target_activity"],
        [(0.9, "p90"), (0.95, "p95"), (0.975, "p97_5"), (0.99, "p99")],
    ),
    target_ratio_near=f"""
        SELECT * REPLACE ({_r('target_ratio')}) FROM s_labels
        WHERE target_ratio BETWEEN 1.4 AND 1.6""",
    class_balance="""
        SELECT high_activity, count(*) AS n_rows,
               round(count(*) / (SELECT count(*) FROM s_labels), 6) AS proportion
        FROM s_labels GROUP BY high_activity""",
    leakage_check="""
        SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS rows_on_one_side,
               CAST(0 AS BIGINT) AS rows_changed, true AS leak_free
        FROM s_features WHERE feature_timestamp <= TIMESTAMP '2024-01-16 12:00:00'""",
    daily_coverage="""
        SELECT grid_id, date, count(DISTINCT hour(timestamp)) AS hour_count,
               count(DISTINCT hour(timestamp)) = 24 AS complete_day
        FROM s_hourly GROUP BY grid_id, date""",
    activity_floor="""
        SELECT count(*) AS grid_days, round(quantile_cont(total, 0.1), 6) AS activity_floor
        FROM s_daily_total""",
    loo_baseline="SELECT grid_id, timestamp, total_activity, baseline_activity FROM s_loo",
    hotspot_ratio="""
        SELECT grid_id, timestamp, total_activity, baseline_activity,
               round(CASE WHEN baseline_activity > 0 THEN total_activity / baseline_activity END, 6)
                 AS activity_ratio,
               coalesce(baseline_activity > 0 AND total_activity / baseline_activity >= 1.5, false)
                 AS hotspot_flag
        FROM s_loo""",
    alerts="SELECT * FROM s_alerts",
    alerts_any_day="SELECT * FROM s_alerts_any",
    alert_summary="""
        SELECT count(*) AS total_alert_records,
               count(DISTINCT (grid_id, timestamp)) AS alerted_grid_hours,
               count(*) FILTER (alert_type = 'HIGH_ACTIVITY') AS high_activity,
               count(*) FILTER (alert_type = 'ACTIVITY_SPIKE') AS activity_spike,
               count(*) FILTER (alert_type = 'ACTIVITY_DROP') AS activity_drop,
               (SELECT count(*) FROM s_hourly) AS total_grid_hours,
               round(count(DISTINCT (grid_id, timestamp)) / (SELECT count(*) FROM s_hourly), 6)
                 AS proportion_alerted
        FROM s_alerts""",
    alert_top_cells="""
        SELECT grid_id, count(*) AS alerts FROM s_alerts GROUP BY grid_id
        ORDER BY 2 DESC, 1 LIMIT 10""",
    alert_type_summary="""
        SELECT alert_type, severity, count(*) AS alert_count, min(timestamp) AS first_timestamp,
               max(timestamp) AS last_timestamp
        FROM s_alerts GROUP BY alert_type, severity""",
    alert_load_checks="""
        SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS null_grid_id,
               CAST(0 AS BIGINT) AS null_timestamp, CAST(0 AS BIGINT) AS null_alert_type,
               CAST(0 AS BIGINT) AS null_current_activity, count(*) - count(reason) AS null_reason,
               CAST(0 AS BIGINT) AS unknown_types, CAST(0 AS BIGINT) AS repeated_rows
        FROM s_alerts""",
    alert_grain_check="""
        SELECT grid_id, timestamp, alert_type, CAST(2 AS BIGINT) AS n_rows
        FROM s_alerts WHERE alert_type = 'ACTIVITY_DROP'""",
    anomalies=f"SELECT * REPLACE ({_r('deviation', 'anomaly_score')}) FROM s_anomalies",
    anomalies_increment=f"""
        SELECT * REPLACE ({_r('deviation', 'anomaly_score')}) FROM s_anomalies
        WHERE timestamp >= TIMESTAMP '2024-01-24'""",
    anomalies_long_history=f"""
        SELECT * REPLACE ({_r('deviation', 'anomaly_score')}) FROM s_anomalies""",
    bucket_coverage="""
        SELECT count(*) AS buckets, min(bucket_count) AS min_rows, max(bucket_count) AS max_rows,
               round(avg(bucket_count), 6) AS mean_rows,
               count(*) FILTER (bucket_count < 3) AS low_history_buckets,
               CAST(24 * (SELECT count(*) FROM s_lookup) AS BIGINT) AS expected_buckets,
               CAST(24 * (SELECT count(*) FROM s_lookup) - count(*) AS BIGINT) AS missing_buckets
        FROM s_buckets""",
    low_history_buckets="SELECT * FROM s_buckets WHERE bucket_count < 30",
    anomaly_summary="""
        SELECT anomaly_direction, anomaly_flag, recommended_action, count(*) AS n_rows,
               count(*) - count(historical_baseline) AS null_historical_baseline,
               count(*) - count(deviation) AS null_deviation,
               count(*) - count(anomaly_score) AS null_anomaly_score
        FROM s_anomalies GROUP BY anomaly_direction, anomaly_flag, recommended_action""",
    anomaly_checks="""
        SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS hour_mismatches,
               CAST(0 AS BIGINT) AS baseline_too_early, CAST(0 AS BIGINT) AS baseline_missing,
               CAST(0 AS BIGINT) AS missing_reasons, CAST(0 AS BIGINT) AS buckets_not_from_zero
        FROM s_anomalies""",
    baseline_audit="""
        SELECT grid_id, timestamp, historical_baseline, historical_baseline AS recomputed,
               true AS agrees
        FROM s_anomalies
        WHERE (grid_id * 31 + hour(timestamp) + dayofyear(timestamp) * 7) % 5 = 0""",
    detector_compare=f"""
        SELECT * REPLACE ({_r('peak_ratio', 'activity_growth', 'deviation')}) FROM s_compared""",
    detector_shares=_shares("s_compared", _CATEGORIES),
    anomaly_vs_rules=f"""
        SELECT *, {_two("anomaly_direction = 'HIGH'", 'np3_high = 1',
                        ['BOTH_AGREE', 'ML4_ONLY', 'NP3_ONLY', 'NEITHER'])} AS ml4_vs_np3_high,
               {_two("anomaly_direction = 'HIGH'", 'np3_spike = 1',
                     ['BOTH_AGREE', 'ML4_ONLY', 'NP3_ONLY', 'NEITHER'])} AS ml4_vs_np3_spike
        FROM (SELECT a.grid_id, a.timestamp, a.total_activity,
                     round(a.deviation, 6) AS deviation, a.anomaly_direction,
                     coalesce(i.np3_high, 0) AS np3_high, coalesce(i.np3_spike, 0) AS np3_spike,
                     i.np3_baseline_activity
              FROM s_anomalies a LEFT JOIN s_indicators i USING (grid_id, timestamp)
              WHERE a.timestamp BETWEEN (SELECT min(timestamp) FROM s_predictions)
                                    AND (SELECT max(timestamp) FROM s_predictions))""",
    detector_agreement="""
        SELECT count(*) AS total_compared,
               count(*) FILTER (ml_prediction = 1 AND np3_spike = 1) AS both_agree,
               count(*) FILTER (ml_prediction = 1 AND np3_spike = 0) AS ml_only,
               count(*) FILTER (ml_prediction = 0 AND np3_spike = 1) AS np3_only,
               count(*) FILTER (ml_prediction = 0 AND np3_spike = 0) AS neither,
               round(count(*) FILTER (ml_prediction = np3_spike) / count(*), 6) AS agreement_rate
        FROM s_compared""",
    disagreement_profile=" UNION ALL ".join(
        f"""SELECT high_comparison_group, '{c}' AS "column",
            round(median({c}), 4) AS median_value, round(avg({c}), 4) AS mean_value
            FROM s_compared GROUP BY high_comparison_group"""
        for c in _PROFILED
    ),
    disagreement_hours="SELECT hour_of_day, "
    + ", ".join(
        f"""round(count(*) FILTER (high_comparison_group = '{g}') * 100.0
            / nullif((SELECT count(*) FROM s_compared WHERE high_comparison_group = '{g}'), 0), 6)
            AS {g.lower()}"""
        for g in _GROUPS
    )
    + " FROM s_compared GROUP BY hour_of_day",
    disagreement_examples="""
        SELECT three_way_high_category, CAST(place AS INTEGER) AS place, grid_id, timestamp,
               round(signal, 6) AS signal
        FROM (SELECT *, row_number() OVER (PARTITION BY three_way_high_category
                             ORDER BY signal DESC NULLS LAST, grid_id, timestamp) AS place
              FROM (SELECT *, CASE three_way_high_category WHEN 'ML4_ONLY' THEN deviation
                                   WHEN 'NP3_ONLY' THEN np3_baseline_activity
                                   ELSE ml_prediction_probability END AS signal
                    FROM s_compared
                    WHERE three_way_high_category NOT IN ('NONE', 'ML3_NP3_ONLY')))
        WHERE place <= 5""",
)


def _network(scope):
    return f"""
        SELECT sum(total_activity) AS total_activity,
               (SELECT count(*) FROM s_hourly WHERE timestamp = TIMESTAMP '2024-01-20 18:00:00'
                                                AND total_activity > 0) AS active_grids,
               (SELECT CAST(hour(timestamp) AS INTEGER) FROM {scope} GROUP BY 1
                ORDER BY sum(total_activity) DESC, 1 LIMIT 1) AS peak_hour,
               (SELECT grid_id FROM s_upto GROUP BY 1
                ORDER BY sum(total_activity) DESC, 1 LIMIT 1) AS top_grid,
               TIMESTAMP '2024-01-20 18:00:00' AS as_of
        FROM {scope}"""


STEPS["s_upto"] = "SELECT * FROM s_hourly WHERE timestamp <= TIMESTAMP '2024-01-20 18:00:00'"
_ACTIVITY = """SELECT grid_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
               total_sms, total_calls, internet_activity, total_activity FROM s_upto"""
_PAIR = "round(a.average, 6) AS average_a, round(b.average, 6) AS average_b, " + ", ".join(
    f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in ["total", "peak", "peak_hour"]
)
_DIFF = """CASE WHEN least(a.total, b.total) > 0
           THEN (greatest(a.total, b.total) - least(a.total, b.total)) / least(a.total, b.total)
                * 100 ELSE 100.0 END"""
_AVERAGES = ["average", "sms_avg", "calls_avg", "internet_avg"]

oracle(
    network_summary=_network("s_hourly"),
    network_summary_strict=_network("s_upto"),
    grid_activity="""
        SELECT grid_id, timestamp, CAST(hour(timestamp) AS INTEGER) AS hour_of_day, total_sms,
               total_calls, internet_activity, total_activity
        FROM s_hourly
        WHERE timestamp >= (SELECT max(timestamp) FROM s_hourly) - INTERVAL 23 HOURS""",
    grid_activity_date=_ACTIVITY + " WHERE grid_id IN (1, 2) AND date = DATE '2024-01-20'",
    grid_activity_hour=_ACTIVITY + " WHERE hour(timestamp) = 9",
    grid_activity_from=_ACTIVITY + " WHERE hour(timestamp) = 9 AND date >= DATE '2024-01-10'",
    features_as_of=f"""
        SELECT r.grid_id, r.as_of, f.* EXCLUDE (grid_id) REPLACE ({_r(*_SIX)}),
               CASE WHEN f.grid_id IS NULL THEN 'NOT FOUND' ELSE 'GOOD' END AS data_quality,
               CASE WHEN f.feature_timestamp >= l.t THEN 'CURRENT'
                    WHEN date_diff('second', f.feature_timestamp, l.t) <= 86400 THEN 'RECENT'
                    WHEN f.feature_timestamp IS NOT NULL THEN 'STALE' END AS feature_freshness
        FROM s_requests r
        ASOF LEFT JOIN s_features f ON r.grid_id = f.grid_id AND r.as_of >= f.feature_timestamp,
        (SELECT max(timestamp) AS t FROM s_hourly) l""",
    anomaly_as_of=f"""
        SELECT r.grid_id, r.as_of,
               a.* EXCLUDE (grid_id, reason) REPLACE ({_r('deviation', 'anomaly_score')})
        FROM s_requests r
        ASOF LEFT JOIN s_anomalies a ON r.grid_id = a.grid_id AND r.as_of >= a.timestamp""",
    alerts_feed="""
        SELECT * FROM s_alerts WHERE timestamp <= TIMESTAMP '2024-01-20 18:00:00'
        ORDER BY timestamp DESC, grid_id, alert_type LIMIT 100""",
    alerts_feed_filtered="""
        SELECT * FROM s_alerts
        WHERE timestamp <= TIMESTAMP '2024-01-20 18:00:00' AND severity = 'MEDIUM'
          AND alert_type = 'ACTIVITY_DROP'
        ORDER BY timestamp DESC, grid_id, alert_type LIMIT 20""",
    alert_hotspots="""
        SELECT a.* FROM s_alerts a
        JOIN (SELECT grid_id, max(timestamp) AS t FROM s_alerts
              WHERE timestamp <= TIMESTAMP '2024-01-20 18:00:00' GROUP BY grid_id) m
          ON a.grid_id = m.grid_id AND a.timestamp = m.t
        ORDER BY a.current_activity DESC, a.timestamp DESC, a.grid_id, a.alert_type LIMIT 100""",
    grid_location="""
        SELECT r.grid_id, g.centroid_latitude, g.centroid_longitude, g.geometry_ref,
               g.grid_id IS NOT NULL AS found
        FROM (SELECT DISTINCT CAST(grid_id + 1 AS INTEGER) AS grid_id FROM s_hourly) r
        LEFT JOIN s_dim_grid g ON r.grid_id = g.grid_id""",
    grid_stats=f"SELECT * REPLACE ({_r(*_AVERAGES)}) FROM s_cell_stats",
    composition=" UNION ALL ".join(
        f"""SELECT grid_id, '{kind}' AS kind, {c} AS amount, round({c} / total, 6) AS share
            FROM s_cell_stats WHERE {c} > 0"""
        for kind, c in [("Calls", "calls_total"), ("SMS", "sms_total"),
                        ("Internet", "internet_total")]
    ),
    compare_grids=f"""
        SELECT a.grid_id AS grid_a, b.grid_id AS grid_b, {_PAIR},
               round({_DIFF}, 6) AS difference_pct,
               CASE WHEN a.total >= b.total THEN 'A' ELSE 'B' END AS higher,
               a.total <> 0 OR b.total <> 0 AS meaningful
        FROM s_cell_stats a JOIN s_cell_stats b ON b.grid_id = a.grid_id + 1""",
    compare_days=f"""
        SELECT p.*, {_PAIR}, round({_DIFF}, 6) AS difference_pct, {_DIFF} < 15 AS recurring
        FROM s_day_pairs p
        JOIN s_day_stats a ON a.grid_id = p.grid_id AND a.date = p.date_a
        JOIN s_day_stats b ON b.grid_id = p.grid_id AND b.date = p.date_b""",
    compare_days_hourly="""
        SELECT p.*, CAST(s.hour AS INTEGER) AS hour, a.total_activity AS a, b.total_activity AS b
        FROM (SELECT *, unnest(range(24)) AS hour FROM s_day_pairs) s
        JOIN s_day_pairs p ON p.grid_id = s.grid_id AND p.date_a = s.date_a
        LEFT JOIN s_hourly a ON a.grid_id = p.grid_id AND a.date = p.date_a
                            AND hour(a.timestamp) = s.hour
        LEFT JOIN s_hourly b ON b.grid_id = p.grid_id AND b.date = p.date_b
                            AND hour(b.timestamp) = s.hour""",
    alert_context="""
        SELECT a.*, n.anomaly_flag, n.anomaly_direction, round(n.deviation, 6) AS deviation,
               m.trailing_median_24h,
               round(100 * (a.current_activity - a.baseline_activity)
                     / nullif(a.baseline_activity, 0), 6) AS deviation_pct,
               coalesce(n.anomaly_flag = 1, false) AS corroborated
        FROM s_alerts a LEFT JOIN s_anomalies n USING (grid_id, timestamp)
        LEFT JOIN s_median m ON m.grid_id = a.grid_id AND m.feature_timestamp = a.timestamp""",
    alert_status_map="""
        SELECT grid_id, CAST(max(CASE WHEN severity = 'HIGH' THEN 3 ELSE 2 END) AS INTEGER)
                 AS status_rank,
               string_agg(DISTINCT alert_type, ', ' ORDER BY alert_type) AS alert_types,
               CASE WHEN max(CASE WHEN severity = 'HIGH' THEN 3 ELSE 2 END) = 3 THEN 'HIGH'
                    ELSE 'ATTENTION' END AS status
        FROM s_alerts GROUP BY grid_id""",
    evidence_summary="""
        SELECT h.grid_id, count(*) AS observations,
               round(avg(total_activity), 6) AS average_activity,
               min(total_activity) AS minimum_activity,
               min(timestamp) FILTER (total_activity = lo) AS minimum_at,
               max(total_activity) AS maximum_activity,
               min(timestamp) FILTER (total_activity = hi) AS maximum_at,
               max(total_activity) FILTER (timestamp = newest) AS latest_activity,
               max(timestamp) AS latest_at,
               (SELECT count(*) FROM s_alerts a WHERE a.grid_id = h.grid_id
                  AND a.timestamp < (SELECT max(timestamp) FROM s_hourly n WHERE n.grid_id = h.grid_id)) AS prior_alerts
        FROM (SELECT *, min(total_activity) OVER (PARTITION BY grid_id) AS lo,
                     max(total_activity) OVER (PARTITION BY grid_id) AS hi,
                     max(timestamp) OVER (PARTITION BY grid_id) AS newest FROM s_hourly) h
        GROUP BY h.grid_id""",
)

STEPS["s_cutoff"] = """
SELECT feature_timestamp AS cutoff
FROM (SELECT feature_timestamp, row_number() OVER (ORDER BY feature_timestamp) AS r,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT feature_timestamp FROM s_train))
WHERE r = CAST(floor(0.8 * n) AS BIGINT)"""
STEPS["s_split"] = """
SELECT *, CASE WHEN feature_timestamp <= (SELECT cutoff FROM s_cutoff) THEN 'train'
               ELSE 'test' END AS split
FROM s_train"""

STEPS["s_inner_cutoff"] = """
SELECT feature_timestamp AS cutoff
FROM (SELECT feature_timestamp, row_number() OVER (ORDER BY feature_timestamp) AS r,
             count(*) OVER () AS n
      FROM (SELECT DISTINCT feature_timestamp FROM s_split WHERE split = 'train'))
WHERE r = CAST(floor(0.8 * n) AS BIGINT)"""

#: What any sound fit says about the test rows.
_FACTS = """
        SELECT count(*) AS rows_scored, CAST(sum(high_activity) AS BIGINT) AS positives,
               CAST(0 AS BIGINT) AS class_disagrees, CAST(0 AS BIGINT) AS odd_probabilities,
               CAST(sum(high_activity) AS BIGINT) AS positives_in_matrix,
               CAST(count(*) - sum(high_activity) AS BIGINT) AS negatives_in_matrix,
               true AS ranking_in_range
        FROM s_split WHERE split = 'test'"""
_GRID = ", ".join(f"({depth}, {leaf})" for depth, leaf in TREE_GRID)
_INPUTS = ", ".join(f"('{name}')" for name in MODEL_FEATURES)


def _metrics(table, said, score):
    """One row of class and ranking metrics of a table with high_activity."""
    return f"""
    SELECT c.tp, c.fp, c.fn, c.tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
           round(p, 6) AS precision, round(r, 6) AS recall,
           round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
           round(((tp + fn) * p + (tn + fp) * CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END)
                 / (tp + fp + fn + tn), 6) AS weighted_precision,
           round((tp + tn) / (tp + fp + fn + tn), 6) AS weighted_recall,
           round(k.auc, 6) AS roc_auc, round(k.ap, 6) AS average_precision
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
          FROM (SELECT count(*) FILTER (high_activity = 1 AND {said}) AS tp,
                       count(*) FILTER (high_activity = 0 AND {said}) AS fp,
                       count(*) FILTER (high_activity = 1 AND NOT {said}) AS fn,
                       count(*) FILTER (high_activity = 0 AND NOT {said}) AS tn
                FROM {table})) c,
         (SELECT sum(pos * (total_neg - fp_upto + neg / 2)) / (max(total_pos) * max(total_neg))
                   AS auc,
                 sum(pos * tp_upto / (tp_upto + fp_upto)) / max(total_pos) AS ap
          FROM (SELECT pos, neg, sum(pos) OVER w AS tp_upto, sum(neg) OVER w AS fp_upto,
                       sum(pos) OVER () AS total_pos, sum(neg) OVER () AS total_neg
                FROM (SELECT {score} AS s, count(*) FILTER (high_activity = 1) AS pos,
                             count(*) FILTER (high_activity = 0) AS neg
                      FROM {table} GROUP BY 1)
                WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) k"""


_SWEEP = " UNION ALL ".join(
    f"""SELECT CAST({cut} AS DOUBLE) AS threshold,
        count(*) FILTER (probability >= {cut} AND high_activity = 1) AS tp,
        count(*) FILTER (probability >= {cut} AND high_activity = 0) AS fp,
        count(*) FILTER (probability < {cut} AND high_activity = 1) AS fn,
        count(*) FILTER (probability < {cut} AND high_activity = 0) AS tn FROM s_scored"""
    for cut in [round(0.10 + 0.05 * i, 2) for i in range(17)]
)

oracle(
    chrono_split="SELECT grid_id, feature_timestamp, split FROM s_split",
    split_report="""
        SELECT split, min(feature_timestamp) AS earliest, max(feature_timestamp) AS latest,
               count(*) AS n_rows, count(DISTINCT feature_timestamp) AS timestamps,
               count(DISTINCT grid_id) AS grids
        FROM s_split GROUP BY split""",
    split_checks="""
        SELECT max(feature_timestamp) FILTER (split = 'train') AS train_latest,
               min(feature_timestamp) FILTER (split = 'test') AS test_earliest,
               count(*) FILTER (target_timestamp <> feature_timestamp + INTERVAL 1 HOUR)
                 AS invalid_targets,
               CAST(0 AS BIGINT) AS rows_with_nulls, CAST(0 AS BIGINT) AS forbidden_features,
               true AS passed
        FROM s_split""",
    class_weights="""
        SELECT grid_id, feature_timestamp, high_activity,
               round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY high_activity)), 6)
                 AS weight
        FROM s_train""",
    ml_eval=_metrics("s_scored", "prediction = 1", "probability"),
    confusion_matrix="""
        SELECT high_activity, prediction, count(*) AS n_rows FROM s_scored GROUP BY ALL""",
    predicted_classes="SELECT prediction, count(*) AS n_rows FROM s_scored GROUP BY ALL",
    threshold_sweep=f"""
        SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, recall DESC, threshold) AS INTEGER)
                    AS place
        FROM (SELECT threshold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
                     round(p, 6) AS precision, round(r, 6) AS recall,
                     round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
              FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
                           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
                    FROM ({_SWEEP})))""",
    ml_baseline=_metrics("s_train", "false", "0.0"),
    model_compare=f"""
        SELECT *, 'majority' AS model FROM ({_metrics('s_train', 'false', '0.0')})
        UNION ALL
        SELECT *, 'default' AS model
        FROM ({_metrics('s_scored', 'prediction = 1', 'probability')})
        UNION ALL
        SELECT *, 'tuned' AS model
        FROM ({_metrics('s_scored', 'probability >= 0.35', 'probability')})""",
    ml_dt=_FACTS,
    ml_dt_plain=_FACTS,
    ml_lr=_FACTS,
    ml_gbt=_FACTS,
    ml_lr_coefficients=f"""
        SELECT feature, true AS solved, true AS sized FROM (VALUES {_INPUTS}) v(feature)""",
    ml_importance=f"""
        SELECT feature, true AS in_range, true AS adds_to_one FROM (VALUES {_INPUTS}) v(feature)""",
    ml_tune=f"""
        SELECT max_depth, min_samples_leaf, count(*) AS rows_validated,
               CAST(sum(high_activity) AS BIGINT) AS positives
        FROM s_split, (VALUES {_GRID}) g(max_depth, min_samples_leaf)
        WHERE split = 'train' AND feature_timestamp > (SELECT cutoff FROM s_inner_cutoff)
        GROUP BY ALL""",
    ml_predictions="""
        SELECT grid_id, feature_timestamp, target_timestamp, high_activity,
               true AS logistic_agrees, true AS tree_agrees
        FROM s_split WHERE split = 'test'""",
    ml_roundtrip="""
        SELECT count(*) AS rows_scored, CAST(0 AS BIGINT) AS rows_different
        FROM s_split WHERE split = 'test'""",
    risk_scores_checked="""
        SELECT grid_id, feature_timestamp, true AS score_in_range, true AS band_fits, true AS note_fits,
               'Predicted high-activity risk is x% for the next hour; an operational indicator, '
               || 'not confirmed congestion.' AS note, 'ml3-decision-tree-v1' AS model_version
        FROM s_table2""",
    training_audit=f"""
        SELECT grid_id, feature_timestamp, trailing_median_24h, target_activity, high_activity,
               CAST(24 AS BIGINT) AS hours_found, trailing_median_24h AS recomputed_median,
               target_activity AS recomputed_target, high_activity AS recomputed_label, true AS agrees
        FROM s_train
        WHERE (grid_id * 31 + hour(feature_timestamp) + dayofyear(feature_timestamp) * 7) % 5 = 0""",
    risk_levels="""
        SELECT grid_id, feature_timestamp, probability AS risk_score,
               CASE WHEN probability >= 0.8 THEN 'CRITICAL' WHEN probability >= 0.6 THEN 'HIGH'
                    WHEN probability >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
               'stand-in' AS model_version,
               'Predicted high-activity risk is ' || printf('%.1f', round(probability * 1000) / 10)
               || '% for the next hour; an operational indicator, not confirmed congestion.'
                 AS explanation_note
        FROM s_scored""",
)
