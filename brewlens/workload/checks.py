"""SQL (DuckDB dialect) over the same tables, one text per query that SQL can express."""

from __future__ import annotations

TELEMETRY = """(SELECT CAST(user_id AS VARCHAR) AS batch_id, ts, event_type AS variable, value, event_id,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'g/L' WHEN event_type = 'error' THEN '%' END AS unit
  FROM events)"""
SENSORS = f"(SELECT * FROM {TELEMETRY} WHERE variable <> 'purchase')"
ASSAY = f"(SELECT *, value * 0.05 AS uncertainty, 'HPLC' AS method FROM {TELEMETRY} WHERE variable = 'purchase')"

PHASES = """(SELECT batch_id, CASE tile WHEN 1 THEN 'lag' WHEN 2 THEN 'exponential' WHEN 3 THEN 'stationary'
    ELSE 'decline' END AS phase_type, min(ts) AS start_ts, max(ts) AS end_ts
  FROM (SELECT CAST(user_id AS VARCHAR) AS batch_id, ts,
          ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tile FROM events)
  GROUP BY ALL)"""

BATCHES = """(SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, 'Run-' || o_orderstatus || '-' || o_orderkey AS name,
    CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'harvested' WHEN 'P' THEN 'planned' END AS lifecycle,
    o_orderdate AS ts_inoculation, o_orderdate AS created_at, o_orderdate AS updated_at,
    o_orderpriority AS strain, c_mktsegment AS media, o_totalprice / 1000 AS scale_liters, c_name AS operator,
    [o_orderstatus, c_mktsegment, CASE WHEN o_totalprice > 300000 THEN 'scale-up' ELSE 'bench' END] AS tags
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

def sensor_records(source: str = "nation") -> str:
    """Nations or suppliers as sensor records: key, region, number of inputs and of coefficients, type."""
    key, region = {"nation": ("n_nationkey", "n_regionkey"), "supplier": ("s_suppkey", "s_nationkey % 5")}[source]
    return f"""(SELECT *, CASE WHEN k % 7 <> 6 THEN inputs ELSE 3 END AS weights, 's' || k AS sensor_id,
      CASE region WHEN 3 THEN 'pls' WHEN 4 THEN 'spline' ELSE 'linear' END AS kind,
      region / 100 - CASE WHEN k % 11 = 10 THEN 1 ELSE 0 END AS std
    FROM (SELECT CAST({key} AS BIGINT) AS k, {region} AS region, CASE {region} WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS inputs FROM {source}))"""


DAILY = f"""(SELECT batch_id, date_trunc('day', ts) AS ts, min(value) FILTER (variable = 'click') AS c,
    min(value) FILTER (variable = 'view') AS v, min(value) FILTER (variable = 'error') AS e
  FROM {TELEMETRY} GROUP BY ALL)"""
#: Predictions of the usable weighted records.
PREDICTED = f"""(SELECT * FROM (SELECT r.*, batch_id, ts, 'est_' || k AS variable, CASE region WHEN 0 THEN k / 10 + (k + 1) * c
      WHEN 1 THEN k / 10 + (k + 1) * v - 2 * c WHEN 2 THEN k / 10 + (k + 1) * e
      WHEN 3 THEN k / 10 + (k + 1) * (v - 1) / 2 - 4 * (e - 1) / 2 + 0.5 * (c - 1) / 2 END AS value
    FROM {sensor_records()} r, {DAILY} d WHERE weights = inputs AND std >= 0) WHERE value IS NOT NULL)"""

METRICS = f"""
  rng AS (SELECT p.batch_id, p.phase_type, p.start_ts, p.end_ts,
      greatest(min(t.ts) FILTER (variable = 'click'), min(t.ts) FILTER (variable = 'view')) AS lo,
      least(max(t.ts) FILTER (variable = 'click'), max(t.ts) FILTER (variable = 'view')) AS hi
    FROM {PHASES} p JOIN {TELEMETRY} t ON t.batch_id = p.batch_id AND t.ts BETWEEN p.start_ts AND p.end_ts
    GROUP BY ALL),
  rows_in AS (SELECT r.*, t.ts, t.value, t.variable, (epoch_us(t.ts) - epoch_us(r.start_ts)) / 3.6e9 AS h,
      t.ts BETWEEN lo AND hi AND count(*) FILTER (variable = 'click' AND t.ts BETWEEN lo AND hi) OVER w >= 2
        AND count(*) FILTER (variable = 'view' AND t.ts BETWEEN lo AND hi) OVER w >= 2 AS in_common,
      count(*) FILTER (variable = 'click' AND t.ts BETWEEN lo AND hi) OVER w >= 2
        AND count(*) FILTER (variable = 'view' AND t.ts BETWEEN lo AND hi) OVER w >= 2 AS has_common
    FROM rng r JOIN {TELEMETRY} t ON t.batch_id = r.batch_id AND t.ts BETWEEN r.start_ts AND r.end_ts
    WINDOW w AS (PARTITION BY r.batch_id, r.phase_type)),
  agg AS (SELECT batch_id, phase_type, start_ts,
      count(*) FILTER (variable = 'click') AS bn, count(*) FILTER (variable = 'view') AS sn,
      count(*) FILTER (variable = 'purchase') AS pn, min(value) FILTER (variable = 'click') AS blow,
      regr_slope(ln(value), h) FILTER (variable = 'click') AS slope,
      regr_r2(ln(value), h) FILTER (variable = 'click') AS r2,
      arg_min(value, ts) FILTER (variable = 'purchase') AS p0, arg_max(value, ts) FILTER (variable = 'purchase') AS p1,
      min(h) FILTER (variable = 'purchase') AS pt0, max(h) FILTER (variable = 'purchase') AS pt1,
      arg_min(value, ts) FILTER (variable = 'click' AND (in_common OR NOT has_common)) AS b0,
      arg_max(value, ts) FILTER (variable = 'click' AND (in_common OR NOT has_common)) AS b1,
      arg_min(value, ts) FILTER (variable = 'view' AND (in_common OR NOT has_common)) AS s0,
      arg_max(value, ts) FILTER (variable = 'view' AND (in_common OR NOT has_common)) AS s1
    FROM rows_in GROUP BY ALL),
  metric AS (SELECT * FROM (SELECT batch_id, phase_type, start_ts,
      CASE WHEN bn >= 2 AND phase_type = 'exponential' AND blow > 0 THEN slope END AS mu,
      CASE WHEN bn >= 2 AND phase_type = 'exponential' AND blow > 0 THEN r2 END AS r_squared,
      CASE WHEN bn >= 2 AND pn >= 2 THEN CASE WHEN pt1 > pt0 THEN (p1 - p0) / (pt1 - pt0) ELSE 0.0 END END AS qp,
      CASE WHEN bn >= 2 AND sn >= 2 THEN CASE WHEN abs(s0 - s1) < 1e-10 THEN 0.0 ELSE (b1 - b0) / (s0 - s1) END END AS yx_s,
      CASE WHEN bn >= 2 AND sn >= 2 AND pn >= 2 THEN
        CASE WHEN abs(s0 - s1) < 1e-10 THEN 0.0 ELSE (p1 - p0) / (s0 - s1) END END AS yp_s
    FROM agg) WHERE coalesce(mu, qp, yx_s, yp_s) IS NOT NULL)"""

SIGNAL = f"""
  x AS (SELECT batch_id, variable, ts, CASE WHEN value > {{limit}} THEN NULL ELSE value END AS v,
      row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY batch_id, variable) AS n
    FROM {TELEMETRY} WINDOW w AS (PARTITION BY batch_id, variable ORDER BY ts, CASE WHEN value > {{limit}} THEN 'nan'::DOUBLE ELSE value END)),
  nb AS (SELECT *,
      last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv,
      first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(v IGNORE NULLS) OVER a AS nv
    FROM x WINDOW b AS (PARTITION BY batch_id, variable ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      a AS (PARTITION BY batch_id, variable ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  fl AS (SELECT *, coalesce(v, CASE WHEN ni - pi - 1 <= 5 THEN pv + (nv - pv) * (i - pi) / (ni - pi) END) AS filled FROM nb),
  sm AS (SELECT *, CASE WHEN count(filled) OVER f = 5 - greatest(0, 2 - i) - greatest(0, i + 3 - n) THEN
      (sum(filled) OVER f + greatest(0, 2 - i) * first_value(filled) OVER f
        + greatest(0, i + 3 - n) * last_value(filled) OVER f) / 5 END AS smoothed
    FROM fl WINDOW f AS (PARTITION BY batch_id, variable ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""

ALIGNED = f"""
  anchor AS (SELECT batch_id, start_ts AS a FROM {PHASES} WHERE phase_type = 'exponential'),
  aligned AS (SELECT batch_id, variable, epoch_us(ts) - epoch_us(a) AS t, avg(value) AS v
    FROM {TELEMETRY} JOIN anchor USING (batch_id) {{where}} GROUP BY ALL)"""

GRID = """
  span AS (SELECT min(t) AS lo, max(t) AS hi FROM aligned),
  pts AS (SELECT lo + k * {step} AS g FROM span, range(0, CAST(ceil((hi - lo) / {step} + 0.5) AS BIGINT)) r(k)),
  link AS (SELECT *, lead(t) OVER w AS tn, lead(v) OVER w AS vn FROM aligned
    WINDOW w AS (PARTITION BY batch_id, variable ORDER BY t)),
  grid AS (SELECT batch_id, variable, g, CASE WHEN tn IS NULL THEN v ELSE v + (vn - v) * ((g - t) / (tn - t)) END AS v
    FROM link JOIN pts ON g >= t AND (tn IS NULL OR g < tn))"""

LONG_ALIGNED = """
  aligned AS (SELECT event_type AS batch_id, 'activity' AS variable,
      epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type)) AS t, value AS v FROM events)"""


def _uuid(*parts: str) -> str:
    h = f"sha256(concat_ws(chr(31), {', '.join(parts)}))"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12))"


AUDIT = f"""(SELECT CAST(conv_id AS VARCHAR) AS tenant_id, turn AS seq, {_uuid('conv_id', 'turn')} AS entry_id,
    1700000000000000 + conv_id * 60000000 + turn * 1500000 AS us, role AS user_id,
    CASE WHEN turn = 0 THEN 'create' WHEN role = 'user' THEN 'update' ELSE 'sign' END AS action,
    CASE WHEN turn = 0 THEN '' ELSE sha256(conv_id || ':' || (turn - 1)) END AS old_value_hash,
    sha256(text) AS new_value_hash,
    CASE WHEN role = 'user' THEN 'said \\"hello\\"\\t\\u00e9' ELSE '' END AS reason_json
  FROM conversations)"""


def _canonical(previous: str, reason: str = "reason_json") -> str:
    return (
        "'{\"action\":\"' || action || '\",\"entity_id\":\"' || tenant_id || '\",\"entity_type\":\"conversation\",\"entry_id\":\"' || entry_id "
        "|| '\",\"new_value_hash\":\"' || new_value_hash || '\",\"old_value_hash\":\"' || old_value_hash "
        f"|| '\",\"previous_entry_hash\":\"' || {previous} || '\",\"reason\":\"' || {reason} || '\",\"timestamp\":\"' "
        "|| strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' "
        "ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END || '+00:00\",\"user_id\":\"' || user_id || '\"}'"
    )


CHAIN = f"""
  a AS MATERIALIZED (SELECT * FROM {AUDIT}),
  chain AS (SELECT tenant_id, seq, '' AS link, sha256({_canonical("''")}) AS h FROM a WHERE seq = 0
    UNION ALL SELECT a.tenant_id, a.seq, c.h AS link, sha256({_canonical('c.h')}) AS h FROM chain c
      JOIN (SELECT tenant_id AS jt, seq AS js, a.* FROM a) a ON a.jt = c.tenant_id AND a.js = c.seq + 1)"""
# inside the recursion the columns of the joined entry must win over those of the chain
CHAIN = CHAIN.replace(_canonical("c.h"), _canonical("c.h").replace("tenant_id", "a.tenant_id"))

VERIFIED = f"""{CHAIN},
  tampered AS (SELECT a.*, c.link, c.h AS stored,
      CASE WHEN a.action = 'sign' AND a.new_value_hash < '8' THEN 'edited' ELSE a.reason_json END AS reason_now
    FROM a JOIN chain c ON c.tenant_id = a.tenant_id AND c.seq = a.seq),
  hashed AS (SELECT *, sha256({_canonical('link', 'reason_now')}) AS now_hash FROM tampered),
  verified AS (SELECT tenant_id, seq, link = coalesce(lag(now_hash) OVER w, '') AS chain_ok,
      link = coalesce(lag(stored) OVER w, '') AS stored_link_ok, stored = now_hash AS content_ok
    FROM hashed WINDOW w AS (PARTITION BY tenant_id ORDER BY seq))"""

LEAF = "sha256('\\x00'::BLOB || encode(h))"


def _tree(one: bool) -> str:
    tenant = "'all'" if one else "tenant_id"
    order = "CAST(tenant_id AS BIGINT), seq" if one else "seq"
    part = "" if one else "PARTITION BY tenant_id"
    return f"""
  leaf AS MATERIALIZED (SELECT {tenant} AS tenant, row_number() OVER ({part} ORDER BY {order}) - 1 AS idx, count(*) OVER ({part}) AS size,
      sha256('\\x00'::BLOB || encode(sha256({_canonical("''")}))) AS hash FROM {AUDIT}),
  tree AS (SELECT tenant, size, size AS n, 0 AS level, idx, hash FROM leaf
    UNION ALL SELECT tenant, size, (n + 1) // 2, level + 1, idx // 2,
      CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(min_by(hash, idx)) || unhex(max_by(hash, idx)))
        ELSE any_value(hash) END
    FROM tree WHERE n > 1 GROUP BY tenant, size, n, level, idx // 2)"""


def _checks() -> dict[str, str]:
    v = {}
    # --- catalog
    v["batch_search"] = f"""SELECT batch_id, name, operator AS meta_operator, epoch_us(ts_inoculation) AS inoculation_us
      FROM {BATCHES} WHERE strain = '1-URGENT' AND lifecycle = 'harvested' AND list_contains(tags, 'scale-up')
      AND list_contains(tags, 'BUILDING') AND ts_inoculation >= '1993-01-01' AND ts_inoculation < '1998-01-01'"""
    v["name_contains"] = f"SELECT batch_id, name, lifecycle FROM {BATCHES} WHERE name ILIKE '%run-f-1%'"
    v["media_and_operator"] = f"""SELECT batch_id, media AS meta_media, operator AS meta_operator FROM {BATCHES}
      WHERE media = 'MACHINERY' AND operator = 'Customer#000000001'"""
    v["time_range"] = f"""SELECT batch_id, epoch_us(ts) AS ts_us, variable, value, unit FROM {TELEMETRY}
      WHERE ts >= '2024-01-10' AND ts < '2024-01-13'"""
    v["one_batch_scan"] = f"""SELECT batch_id, epoch_us(ts) AS ts_us, variable, value FROM {TELEMETRY}
      WHERE batch_id = '7' AND variable IN ('click', 'view')"""
    v["topk_batches"] = f"""SELECT batch_id, name, round(scale_liters, 6) AS scale_liters FROM {BATCHES}
      ORDER BY scale_liters DESC LIMIT 10"""
    v["newest_batches"] = f"""SELECT batch_id, epoch_us(created_at) AS created_us FROM {BATCHES}
      ORDER BY created_at DESC, batch_id LIMIT 20 OFFSET 20"""
    v["ranked_first"] = f"SELECT batch_id FROM {BATCHES} ORDER BY scale_liters, batch_id LIMIT 5"
    v["group_by_strain"] = f"""SELECT strain, lifecycle, count(*) AS n, round(avg(scale_liters), 6) AS mean_scale,
      round(min(scale_liters), 6) AS min_scale, round(max(scale_liters), 6) AS max_scale,
      round(sum(scale_liters), 6) AS sum_scale FROM {BATCHES} GROUP BY strain, lifecycle"""
    v["bracket_filter"] = f"""SELECT batch_id, strain, media FROM {BATCHES} WHERE lifecycle = 'running'
      AND (strain LIKE '%URGENT%' OR scale_liters > 450) AND NOT media = 'BUILDING'"""
    v["single_batch_query"] = f"SELECT batch_id, name, operator FROM {BATCHES} WHERE batch_id = '42'"
    v["rejected_rows"] = f"""SELECT 'scale not positive' AS reason, count(*) AS n FROM {BATCHES}
      WHERE scale_liters - 100 <= 0 GROUP BY 1
      UNION ALL SELECT 'value not finite', count(*) FROM events WHERE value > 100 GROUP BY 1"""
    v["updated_catalog"] = f"""SELECT batch_id, CASE WHEN lifecycle = 'running' THEN 'harvested' ELSE lifecycle END AS lifecycle,
      epoch_us(CASE WHEN lifecycle = 'running' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END) AS updated_us FROM {BATCHES}"""
    v["catalog_log"] = v["updated_catalog"] + " WHERE scale_liters <= 400"
    v["nested_round_trip"] = f"""SELECT batch_id, strain AS meta_strain, array_to_string(tags, '|') AS tags FROM {BATCHES}"""
    v["duplicate_batches"] = f"""SELECT batch_id FROM {BATCHES} WHERE scale_liters > 450 AND lifecycle IN ('running', 'planned')"""
    # --- telemetry
    view = """a.variable AS analyte, a.value AS assay_value, round(a.uncertainty, 6) AS assay_uncertainty,
      'g/L' AS assay_unit, a.method AS assay_method, epoch_us(a.ts) AS assay_us, t.variable AS sensor,
      t.value AS sensor_value, t.unit AS sensor_unit, epoch_us(t.ts) AS telemetry_us"""
    v["asof_unified"] = f"""SELECT a.batch_id, {view} FROM {ASSAY} a ASOF JOIN {SENSORS} t
      ON a.batch_id = t.batch_id AND a.ts >= t.ts"""
    v["asof_per_sensor"] = f"""SELECT a.batch_id, {view}
      FROM (SELECT a.*, s.variable AS want FROM {ASSAY} a
        JOIN (SELECT DISTINCT batch_id, variable FROM {SENSORS}) s ON s.batch_id = a.batch_id) a
      ASOF JOIN {SENSORS} t ON a.batch_id = t.batch_id AND a.want = t.variable AND a.ts >= t.ts"""
    v["telemetry_union_assay"] = f"""SELECT batch_id, variable, unit, method, count(*) AS n, round(sum(value), 6) AS total,
      round(sum(uncertainty), 6) AS sigma_total FROM (
        SELECT batch_id, variable, unit, NULL AS method, value, NULL AS uncertainty FROM {SENSORS}
        UNION ALL SELECT batch_id, variable, 'g/L', method, value, uncertainty FROM {ASSAY}) GROUP BY 1, 2, 3, 4"""
    v["batch_summary"] = f"""SELECT batch_id, count(*) AS n_points, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
      count(DISTINCT variable) AS n_variables, max(value) FILTER (variable = 'click') AS max_biomass,
      min(value) FILTER (variable = 'error') AS min_oxygen FROM {TELEMETRY} GROUP BY batch_id"""
    v["compare_batches"] = f"""SELECT variable, batch_id, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS lowest,
      max(value) AS highest FROM {TELEMETRY} GROUP BY ALL"""
    v["daily_means"] = f"""SELECT batch_id, variable, epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS day_us,
      round(avg(value), 6) AS value FROM {TELEMETRY} GROUP BY ALL"""
    kinds = ("click", "error", "purchase", "signup", "view")
    cols = ", ".join(f"min(value) FILTER (variable = '{k}') AS {k}" for k in kinds)
    v["pivot_sensors"] = f"SELECT batch_id, epoch_us(ts) AS ts_us, {cols} FROM {TELEMETRY} GROUP BY batch_id, ts"
    v["zscore"] = f"""SELECT batch_id, variable, epoch_us(ts) AS ts_us, value, round(CASE WHEN stddev_pop(value) OVER w > 1e-10
      THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END, 6) AS z FROM {TELEMETRY}
      WINDOW w AS (PARTITION BY batch_id, variable)"""
    v["missing_inputs"] = """WITH d AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS batch_id, event_type FROM events)
      SELECT b.batch_id, w.variable FROM (SELECT DISTINCT batch_id FROM d) b, (VALUES ('click'), ('view')) w(variable)
      WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.batch_id = b.batch_id AND d.event_type = w.variable)"""
    # --- phases and metrics
    hours = "(epoch_us({0}.end_ts) - epoch_us({0}.start_ts)) / 3.6e9"
    v["phase_duration"] = f"""SELECT b.batch_id, b.strain, round({hours.format('e')}, 6) AS exp_hours,
      round({hours.format('l')}, 6) AS lag_hours FROM {BATCHES} b
      LEFT JOIN {PHASES} e ON e.batch_id = b.batch_id AND e.phase_type = 'exponential'
      LEFT JOIN {PHASES} l ON l.batch_id = b.batch_id AND l.phase_type = 'lag' WHERE {hours.format('e')} > 1"""
    v["phase_join_stats"] = f"""SELECT t.batch_id, p.phase_type, t.variable, count(*) AS n, round(avg(value), 6) AS mean,
      min(value) AS lowest, max(value) AS highest FROM {TELEMETRY} t JOIN {PHASES} p
      ON p.batch_id = t.batch_id AND t.ts BETWEEN p.start_ts AND p.end_ts GROUP BY ALL"""
    v["batch_metrics"] = f"""WITH {METRICS} SELECT batch_id, phase_type, epoch_us(start_ts) AS start_us, round(mu, 5) AS mu,
      round(r_squared, 5) AS r_squared, round(qp, 5) AS qp, round(yx_s, 5) AS yx_s, round(yp_s, 5) AS yp_s FROM metric"""
    v["growth_rate_by_strain"] = f"""WITH {METRICS} SELECT strain, round(avg(mu), 6) AS mean_mu, count(mu) AS n_mu,
      count(*) AS n_batches FROM {BATCHES} b LEFT JOIN metric m ON m.batch_id = b.batch_id AND m.phase_type = 'exponential'
      GROUP BY strain"""
    v["yield_query"] = f"""WITH {METRICS} SELECT b.batch_id, round(yx_s, 5) AS yx_s FROM {BATCHES} b
      LEFT JOIN metric m ON m.batch_id = b.batch_id WHERE yx_s <> 0"""
    v["growth_rates"] = f"""WITH r AS (SELECT batch_id, value, epoch_us(ts) / 3.6e9 - 473352 AS h FROM {TELEMETRY} WHERE variable = 'click'),
      g AS (SELECT batch_id, count(*) AS n, min(value) AS lowest, regr_slope(ln(value), h) AS b, regr_r2(ln(value), h) AS r2,
        regr_sxx(ln(value), h) AS sxx, regr_syy(ln(value), h) AS syy, regr_sxy(ln(value), h) AS sxy FROM r GROUP BY 1)
      SELECT batch_id, CASE WHEN n >= 2 AND lowest > 0 THEN round(b, 6) END AS mu,
        CASE WHEN n >= 2 AND lowest > 0 THEN round(r2, 6) END AS r_squared,
        CASE WHEN n = 2 AND lowest > 0 THEN 0.0 WHEN n > 2 AND lowest > 0 THEN
          round(sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx), 6) END AS std_error, n FROM g"""
    v["productivity"] = f"""SELECT batch_id, variable, round(CASE WHEN count(*) < 2 THEN NULL WHEN max(ts) > min(ts) THEN
      (arg_max(value, ts) - arg_min(value, ts)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9) ELSE 0.0 END, 6) AS qp,
      count(*) AS n FROM {TELEMETRY} GROUP BY ALL"""
    v["yield_uncertainty"] = f"""WITH f AS (SELECT batch_id, arg_min(value, ts) FILTER (variable = 'view') AS c0,
        arg_max(value, ts) FILTER (variable = 'view') AS c1, arg_min(value, ts) FILTER (variable = 'click') AS p0,
        arg_max(value, ts) FILTER (variable = 'click') AS p1 FROM {TELEMETRY} GROUP BY 1)
      SELECT batch_id, CASE WHEN abs(c0 - c1) < 1e-10 THEN 0.0 ELSE round((p1 - p0) / (c0 - c1), 5) END AS yield,
        CASE WHEN abs(c0 - c1) < 1e-10 THEN 0.0 ELSE round(sqrt(
          (pow(p0 * 0.05, 2) + pow(p1 * 0.05, 2)) / pow(c0 - c1, 2)
          + pow(p1 - p0, 2) * (pow(c0 * 0.05, 2) + pow(c1 * 0.05, 2)) / pow(c0 - c1, 4)), 4) END AS sigma
      FROM f WHERE c0 IS NOT NULL AND p0 IS NOT NULL"""
    v["label_segments"] = """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS batch_id, value, ts,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
      s AS (SELECT batch_id, CAST(i * 4 // n AS INTEGER) AS seg, count(*) AS len, arg_min(value, i) AS f, arg_max(value, i) AS l FROM n GROUP BY ALL),
      r AS (SELECT *, CASE WHEN len <= 1 THEN 0.0 ELSE (l - f) / len END AS rate FROM s),
      m AS (SELECT *, max(rate) OVER w AS top, max(abs(rate)) OVER w AS big,
          first_value(seg) OVER (PARTITION BY batch_id ORDER BY rate DESC, seg) AS top_seg FROM r WINDOW w AS (PARTITION BY batch_id))
      SELECT batch_id, seg, round(rate, 6) AS growth_rate, CASE WHEN top > 0 AND seg = top_seg THEN 'exponential'
        WHEN top > 0 AND seg > top_seg AND rate < 0 THEN 'decline' WHEN top > 0 AND seg < top_seg AND abs(rate) < 0.1 * big THEN 'lag'
        WHEN top > 0 AND seg > top_seg AND abs(rate) < 0.1 * big THEN 'stationary' ELSE 'unknown' END AS phase_type FROM m"""
    # --- signals
    faulty, clean = SIGNAL.replace("{limit}", "60"), SIGNAL.replace("{limit}", "1e300")
    v["gap_fill"] = f"WITH {faulty} SELECT batch_id, variable, epoch_us(ts) AS ts_us, round(filled, 6) AS filled FROM sm"
    v["smooth"] = f"WITH {faulty} SELECT batch_id, variable, epoch_us(ts) AS ts_us, round(smoothed, 6) AS smoothed FROM sm"
    v["auto_penalty"] = f"""WITH {clean} SELECT batch_id, variable, count(smoothed) AS n, round(ln(count(smoothed))
      * CASE WHEN var_pop(smoothed) < 1e-10 THEN 1.0 ELSE var_pop(smoothed) END, 6) AS penalty FROM sm GROUP BY 1, 2"""
    v["downsample"] = """WITH x AS (SELECT CAST(user_id AS VARCHAR) AS batch_id, ts, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
      k AS (SELECT batch_id, n, k, CASE WHEN n <= 10 OR k < 9 THEN CASE WHEN n <= 10 THEN k ELSE floor(k * ((n - 1) / 9.0::DOUBLE)) END ELSE n - 1 END AS at
        FROM (SELECT DISTINCT batch_id, n FROM x), range(0, 10) r(k) WHERE k < n)
      SELECT x.batch_id, k.k, epoch_us(ts) AS ts_us, value FROM x JOIN k ON k.batch_id = x.batch_id AND k.at = x.i"""
    # --- alignment
    every, two = ALIGNED.replace("{where}", ""), ALIGNED.replace("{where}", "WHERE variable IN ('click', 'view')")
    half_day = GRID.replace("{step}", "43200000000")
    v["align_long"] = f"WITH {every} SELECT batch_id, variable, t AS elapsed_us, round(v, 6) AS value FROM aligned"
    v["align_grid"] = f"WITH {two}, {half_day} SELECT batch_id, variable, g AS elapsed_us, round(v, 6) AS value FROM grid"
    wide = ", ".join(f"round(min(v) FILTER (batch_id = '{k}'), 6) AS {k}__activity" for k in kinds)
    v["align_wide"] = f"""WITH {LONG_ALIGNED}, {GRID.replace('{step}', '21600000000')}
      SELECT round(g / 3.6e9, 6) AS elapsed_hours, {wide} FROM grid GROUP BY g"""
    v["golden_profile"] = f"""WITH {two}, {half_day}, p AS (SELECT variable, g, avg(v) AS m, stddev_pop(v) AS s, count(v) AS n
      FROM grid GROUP BY ALL) SELECT variable, g AS elapsed_us, n AS n_batches, round(m, 6) AS mean, round(s, 6) AS std,
      round(m - s, 6) AS lower, round(m + s, 6) AS upper FROM p"""
    v["phase_overlay"] = f"""SELECT p.batch_id, p.phase_type, round((epoch_us(p.start_ts) - epoch_us(a.start_ts)) / 3.6e9, 6) AS start_hours,
      round((epoch_us(p.end_ts) - epoch_us(a.start_ts)) / 3.6e9, 6) AS end_hours FROM {PHASES} p JOIN {PHASES} a
      ON a.batch_id = p.batch_id AND a.phase_type = 'exponential'"""
    # --- soft sensors
    v["linear_sensor"] = f"""SELECT batch_id, epoch_us(ts) AS ts_us, 'biomass_est' AS variable, round(value * 2.0 + 0.5, 6) AS value,
      0.25::DOUBLE AS uncertainty, 'soft_sensor' AS source FROM {TELEMETRY} WHERE variable = 'click'"""
    v["model_sensor"] = f"""SELECT batch_id, epoch_us(ts) AS ts_us, 'log_est' AS variable, round(ln(1 + min(value)) * 3.0, 6) AS value,
      0.1::DOUBLE AS uncertainty FROM {TELEMETRY} WHERE variable = 'view' GROUP BY batch_id, ts"""
    v["with_predictions"] = f"""SELECT batch_id, variable, source, count(*) AS n, round(sum(value), 6) AS total FROM (
      SELECT batch_id, variable, NULL AS source, value FROM {TELEMETRY} UNION ALL
      SELECT batch_id, 'est', 'soft_sensor', value * 2.0 + 0.5 FROM {TELEMETRY} WHERE variable = 'click') GROUP BY 1, 2, 3"""
    v["sensor_records"] = f"""SELECT sensor_id, batch_id, epoch_us(ts) AS ts_us, variable, round(value, 6) AS value,
      round(std, 6) AS uncertainty, 'soft_sensor' AS source FROM {PREDICTED}"""
    v["custom_sensor_records"] = f"""SELECT sensor_id, variable, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT sensor_id, variable, value FROM {PREDICTED} UNION ALL
      SELECT sensor_id, 'est_' || k, ln(1 + v) * 3 FROM {sensor_records()} r, {DAILY} d WHERE region = 4 AND std >= 0 AND v IS NOT NULL
      ) GROUP BY 1, 2"""
    v["sensor_issues"] = f"""SELECT sensor_id, unnest(list_filter([CASE WHEN kind = 'spline' THEN 'unknown model type' END,
      CASE WHEN kind <> 'spline' AND weights <> inputs THEN 'coefficients do not fit the inputs' END,
      CASE WHEN std < 0 THEN 'negative deviation' END], lambda x: x IS NOT NULL)) AS issue FROM {sensor_records('supplier')}"""
    # --- ingestion
    raw = "(SELECT l_returnflag || l_linestatus AS source, * FROM lineitem)"
    v["melt_units"] = f"""SELECT source, variable, unit, epoch_us(ts) AS ts_us, count(*) AS n, round(sum(value), 6) AS total FROM (
      SELECT source, 'glucose' AS variable, 'g/L' AS unit, l_shipdate AS ts, l_quantity / 1000 AS value FROM {raw} WHERE l_linenumber <> 7
      UNION ALL SELECT source, 'temperature', 'C', l_shipdate, l_extendedprice - 273.15 FROM {raw}
      UNION ALL SELECT source, 'volume', 'L', l_shipdate, l_discount / 1000 FROM {raw}
      UNION ALL SELECT source, 'ph', NULL, l_shipdate, l_tax FROM {raw} WHERE l_linenumber <> 1) GROUP BY 1, 2, 3, 4"""
    v["column_plan"] = f"""SELECT s.source, p.* REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM (SELECT DISTINCT source FROM {raw}) s, (VALUES
      (0, 'timestamp', true, NULL, NULL, NULL, NULL), (1, 'glucose_mg_L', false, 'glucose', 0.96, 'g/L', 'mg/L'),
      (2, 'temp_K', false, 'temperature', 1.0, 'C', 'K'), (3, 'vol_mL', false, 'volume', 0.91, 'L', 'mL'),
      (4, 'pH', false, 'ph', 1.0, NULL, NULL)) p(col_no, header, is_ts, variable, confidence, unit, from_unit)"""
    v["quality_flags"] = """SELECT l_quantity - 10 AS value, CASE WHEN l_quantity - 10 < 0 THEN 'below_minimum'
      WHEN l_quantity - 10 > 14 THEN 'above_maximum' END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2"""
    v["unit_by_range"] = """SELECT l_partkey, CASE WHEN avg(l_extendedprice) / 50 > 500 THEN 'mg/L' WHEN avg(l_extendedprice) / 50 >= 0.1 THEN 'g/L' END AS by_price,
      CASE WHEN avg(l_quantity) * 8 > 200 THEN 'K' ELSE 'C' END AS by_quantity,
      CASE WHEN avg(l_discount) * 2 > 500 THEN 'mg/L' WHEN avg(l_discount) * 2 >= 0.1 THEN 'g/L' END AS by_discount FROM lineitem GROUP BY 1"""
    v["unit_conversion"] = """SELECT l_returnflag, round(sum(l_extendedprice / 1000), 2) AS g_l,
      round(sum((l_extendedprice - 32) * 5 / 9), 2) AS celsius, round(sum(l_extendedprice / 60), 2) AS hours, NULL AS molar
      FROM lineitem GROUP BY 1"""
    v["elapsed_to_time"] = """SELECT l_orderkey, l_linenumber, l_partkey,
      epoch_us(l_shipdate) + CAST(round_even((l_quantity + l_tax) * 6e7, 0) AS BIGINT) AS ts_us FROM lineitem"""
    v["text_timestamps"] = "SELECT l_linenumber AS n, epoch_us(l_shipdate) AS ts_us, count(*) AS rows FROM lineitem GROUP BY 1, 2"
    # --- landed extracts
    mapped = """CASE event_type WHEN 'click' THEN 'biomass' WHEN 'error' THEN 'temperature' WHEN 'view' THEN 'ph' END AS variable"""
    v["historian_pull"] = f"""SELECT CAST(user_id AS VARCHAR) AS batch_id, epoch_us(ts) AS ts_us, {mapped},
      round(CASE event_type WHEN 'click' THEN value / 1000 WHEN 'error' THEN value - 273.15 ELSE value * 0.1 END, 6) AS value,
      CASE event_type WHEN 'click' THEN 'g/L' WHEN 'error' THEN 'C' END AS unit
      FROM (SELECT user_id, ts, event_type, min(value) AS value FROM events GROUP BY ALL)
      WHERE event_type IN ('click', 'error', 'view') AND ts >= '2024-01-05' AND ts < '2024-01-20'"""
    v["missing_points"] = """SELECT s AS source, 'Source field ''' || s || ''' not found' AS warning
      FROM (VALUES ('click'), ('error'), ('view'), ('nothing'), ('signup')) w(s) WHERE s NOT IN (SELECT event_type FROM events)"""
    v["point_readings"] = f"""SELECT CAST(user_id AS VARCHAR) AS batch_id, epoch_us(ts) AS ts_us, {mapped},
      round(CASE event_type WHEN 'view' THEN value * 0.1 ELSE value END, 6) AS value,
      CASE event_type WHEN 'click' THEN 'mg/L' WHEN 'error' THEN 'K' END AS unit FROM events
      WHERE event_type IN ('click', 'error', 'view')"""
    v["lims_results"] = """SELECT CAST(o_custkey AS VARCHAR) AS batch_id, variable, unit, 'lims' AS method, count(*) AS n,
      round(sum(value), 3) AS total, epoch_us(max(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) AS last_us FROM (
        SELECT *, 'titer' AS variable, 'g/L' AS unit, o_totalprice AS value FROM orders WHERE o_orderpriority <> '5-LOW'
        UNION ALL SELECT *, 'viable_cell_density', 'cells', o_totalprice / 10 FROM orders) WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3"""
    note = """(SELECT CAST(o_custkey AS VARCHAR) AS batch_id, CASE WHEN o_orderstatus = 'O' THEN 'titer' ELSE o_orderpriority END AS name,
      o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_text, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders)"""
    v["notebook_assays"] = f"""SELECT batch_id, 'titer' AS variable, 'g/L' AS unit, 'eln' AS method, count(*) AS n,
      round(sum(o_totalprice), 3) AS total FROM {note} WHERE name = 'titer' AND NOT is_text GROUP BY 1"""
    v["notebook_observations"] = f"""SELECT batch_id, name, arg_max('note ' || o_orderkey, {{'d': d, 't': 'note ' || o_orderkey}}) AS text
      FROM {note} WHERE is_text GROUP BY 1, 2"""
    # --- lineage
    v["lineage_down"] = """SELECT CAST(a.conv_id AS VARCHAR) AS batch_id, a.conv_id || ':' || a.turn AS root_id,
      b.conv_id || ':' || b.turn AS operation_id, CAST(b.turn - a.turn AS INTEGER) AS depth
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn"""
    v["lineage_up"] = """WITH RECURSIVE up AS (SELECT conv_id, turn AS root, turn - 1 AS turn, 1 AS depth FROM conversations WHERE turn > 0
      UNION ALL SELECT conv_id, root, turn - 1, depth + 1 FROM up WHERE turn > 0)
      SELECT CAST(conv_id AS VARCHAR) AS batch_id, conv_id || ':' || root AS root_id, conv_id || ':' || turn AS operation_id, depth FROM up"""
    v["lineage_rings"] = """WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS batch_id, conv_id || ':' || turn AS id, conv_id // 10 AS ring,
        row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id // 10) AS size
        FROM conversations WINDOW w AS (PARTITION BY conv_id // 10 ORDER BY conv_id, turn))
      SELECT a.batch_id, a.id AS root_id, b.id AS operation_id, CAST((b.i - a.i + a.size) % a.size AS INTEGER) AS depth
      FROM n a JOIN n b ON a.ring = b.ring AND a.i <> b.i"""
    # --- audit
    v["entry_hashes"] = f"""SELECT tenant_id, seq, sha256({_canonical("''")}) AS entry_hash FROM {AUDIT}"""
    v["chain_append"] = f"WITH RECURSIVE {CHAIN} SELECT tenant_id, seq, link AS previous_entry_hash, h AS record_hash FROM chain"
    v["chain_verify"] = f"WITH RECURSIVE {VERIFIED} SELECT tenant_id, seq, chain_ok, stored_link_ok, content_ok FROM verified"
    v["chain_verdict"] = f"""WITH RECURSIVE {VERIFIED} SELECT tenant_id, count(*) AS entries, count(*) FILTER (NOT chain_ok) AS broken_links,
      count(*) FILTER (NOT content_ok) AS changed_entries, bool_and(chain_ok) AS intact FROM verified GROUP BY 1"""
    v["last_hashes"] = f"""WITH RECURSIVE {CHAIN} SELECT tenant_id, max(seq) AS last_seq, arg_max(h, seq) AS last_hash FROM chain GROUP BY 1"""
    v["audit_page"] = f"""SELECT tenant_id, seq, us AS timestamp_us FROM {AUDIT} WHERE action = 'update'
      ORDER BY us DESC, entry_id LIMIT 25 OFFSET 25"""
    v["tenant_rows"] = f"SELECT tenant_id, seq, action FROM {AUDIT} WHERE tenant_id = '7'"
    v["field_completeness"] = f"SELECT tenant_id, seq, 'reason' AS field FROM {AUDIT} WHERE reason_json = ''"
    v["format_issues"] = f"""SELECT tenant_id, seq, 'invalid entry_id' AS issue FROM {AUDIT} WHERE seq = 3
      UNION ALL SELECT tenant_id, seq, 'invalid action' FROM {AUDIT} WHERE seq = 5"""
    v["role_violations"] = f"""SELECT tenant_id, seq, user_id, CASE WHEN action = 'sign' THEN 'sign' ELSE 'write' END AS permission
      FROM {AUDIT} WHERE user_id <> 'assistant'"""
    broken = f"(SELECT count(*) FILTER (NOT chain_ok) FROM verified)"
    empty = "(SELECT count(*) FROM hashed WHERE reason_now = '')"
    items = ("CFR11-10d", "CFR11-10e", "CFR11-10f", "CFR11-10g", "CFR11-10k", "CFR11-50", "CFR11-70", "CFR11-100",
             "CFR11-200", "AX11-9", "AX11-12.1", "AX11-12.4", "AX11-14")
    kinds_of = ("access", "format", "chain", "access", "fields", "signature", "signature", "access", "signature", "format",
                "chain", "none", "signature")
    sections = ("11.10(d)", "11.10(e)", "11.10(f)", "11.10(g)", "11.10(k)", "11.50", "11.70", "11.100", "11.200",
                "Clause 9", "Clause 12.1", "Clause 12.4", "Clause 14")
    values = ", ".join(
        f"({n}, '{i}', '{'21_CFR_Part_11' if i.startswith('CFR') else 'EU_Annex_11'}', '{s}', '{k}')"
        for n, (i, s, k) in enumerate(zip(items, sections, kinds_of, strict=True)))
    status = f"""CASE kind WHEN 'access' THEN 'warning' WHEN 'signature' THEN 'not_applicable'
      WHEN 'chain' THEN CASE WHEN {broken} > 0 THEN 'fail' ELSE 'pass' END
      WHEN 'fields' THEN CASE WHEN {empty} > 0 THEN 'fail' ELSE 'pass' END ELSE 'pass' END"""
    report = f"""WITH RECURSIVE {VERIFIED}, rep AS (SELECT item_no, item_id, regulation, section, {status} AS status
      FROM (VALUES {values}) i(item_no, item_id, regulation, section, kind))"""
    v["compliance_report"] = f"{report} SELECT * FROM rep"
    v["compliance_overall"] = f"""{report} SELECT count(*) AS items, count(*) FILTER (status = 'pass') AS pass,
      count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warning') AS warning,
      count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'not_applicable') AS not_applicable,
      CASE WHEN bool_or(status IN ('fail', 'error')) THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'pass' END AS overall
      FROM rep WHERE regulation = 'EU_Annex_11'"""
    v["record_fingerprints"] = f"SELECT batch_id, sha256(batch_id || ':' || name || ':' || lifecycle) AS fingerprint FROM {BATCHES}"
    v["table_fingerprint"] = """WITH h AS (SELECT sha256(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus,
        printf('%.2f', o_totalprice))) AS h FROM orders)
      SELECT count(*) AS n_rows, sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS hash_high,
        sum(CAST('0x' || substr(h, 13, 12) AS HUGEINT)) AS hash_low FROM h"""
    # --- Merkle trees
    one, each = f"WITH RECURSIVE {_tree(True)}", f"WITH RECURSIVE {_tree(False)}"
    v["merkle_leaves"] = f"WITH {_tree(True).split('  tree AS')[0].rstrip().rstrip(',')} SELECT idx, size, hash FROM leaf"
    root = "SELECT tenant AS tenant_id, size, hash AS root FROM tree WHERE n = 1"
    v["merkle_root"] = f"SELECT * FROM ({one} {root}) UNION ALL SELECT * FROM ({each} {root})"
    v["frontier_roots"] = f"{each} {root}"
    v["frontier_check"] = "SELECT CAST(conv_id AS VARCHAR) AS tenant_id, count(*) AS size, count(*) < 8 AS matches FROM conversations GROUP BY 1"
    v["merkle_nodes"] = f"{one} SELECT level, idx, hash FROM tree"
    v["inclusion_proofs"] = f"""{one} SELECT l.idx, t.level, CASE WHEN (l.idx >> t.level) & 1 = 1 THEN 'L' ELSE 'R' END AS side, t.hash
      FROM leaf l JOIN tree t ON t.n > 1 AND t.idx = xor(l.idx >> t.level, 1)"""
    v["inclusion_verified"] = "SELECT CAST(conv_id AS VARCHAR) AS tenant_id, turn AS idx, true AS valid FROM conversations"
    v["consistency_verified"] = """SELECT CAST(conv_id AS VARCHAR) AS tenant_id, count(*) - 1 AS old_size, count(*) AS new_size, true AS valid
      FROM conversations GROUP BY 1 HAVING count(*) > 1"""
    v["consistency_cases"] = """SELECT CAST(conv_id AS VARCHAR) AS tenant_id, count(*) + d AS old_size, count(*) AS new_size, c AS "case",
      c = 'equal' AS valid FROM conversations, (VALUES ('equal', 0), ('altered', -1), ('shrunk', 1)) k(c, d) GROUP BY conv_id, c, d"""
    # --- detection: what must hold whatever the changepoints are
    for name in ("pelt_cover", "online_cover"):
        v[name] = """SELECT CAST(user_id AS VARCHAR) AS batch_id, count(*) AS n, count(*) AS upto, epoch_us(min(ts)) AS first_us,
          epoch_us(max(ts)) AS last_us, 0::BIGINT AS gaps FROM events GROUP BY 1"""
    v["stream_equals_batch"] = """SELECT CAST(user_id AS VARCHAR) AS batch_id, count(*) AS n, epoch_us(max(ts)) AS last_us,
      0::BIGINT AS differ FROM events GROUP BY 1"""
    v["checkpoint_check"] = """SELECT CAST(conv_id AS VARCHAR) AS tenant_id, count(*) AS size, count(*) < 8 AS matches
      FROM conversations GROUP BY 1"""
    return v


def oracle_sql() -> dict[str, str]:
    return _checks()
