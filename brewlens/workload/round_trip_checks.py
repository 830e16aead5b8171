"""SQL for the queries of :mod:`brewlens.workload.round_trips`, over the tables as they were before the round trip."""

from __future__ import annotations

from brewlens.workload import checks
from brewlens.workload.checks import ALIGNED, ASSAY, BATCHES, GRID, PHASES, PREDICTED, SENSORS, TELEMETRY


def round_trip_sql() -> dict[str, str]:
    v: dict[str, str] = {}
    rows = "batch_id, epoch_us(ts) AS ts_us, variable, value, unit"
    v["stored_telemetry"] = f"SELECT {rows} FROM {TELEMETRY} WHERE value <= 100"
    v["stored_loads"] = f"SELECT {rows} FROM {TELEMETRY}"
    v["stored_batch"] = f"SELECT {rows} FROM {TELEMETRY} WHERE value <= 100 AND batch_id = '7'"
    v["stored_sensors"] = f"""SELECT variable, source, uncertainty, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT variable, NULL AS source, NULL AS uncertainty, value FROM {TELEMETRY}
      UNION ALL SELECT variable, 'soft_sensor', CASE kind WHEN 'pls' THEN 7.0 ELSE std END::DOUBLE, value FROM {PREDICTED} WHERE sensor_id <> 's1')
      GROUP BY 1, 2, 3"""
    chain = checks.oracle_sql()
    v["stored_chain"], v["stored_heads"] = chain["chain_append"], chain["last_hashes"]
    v["quoted_load"] = """SELECT l_returnflag || l_linestatus AS kind, epoch_us(date_trunc('second', l_shipdate)) AS ts_us, 'ph' AS variable,
      count(*) AS n, round(sum(l_tax), 6) AS total FROM lineitem GROUP BY 1, 2"""
    v["stored_rejects"] = f"""SELECT batch_id, 'value not finite' AS reason, count(*) AS n FROM {TELEMETRY}
      WHERE value > 100 AND variable = 'purchase' GROUP BY 1"""
    v["stored_assay"] = f"""SELECT batch_id, epoch_us(ts) AS ts_us, variable, value, round(uncertainty, 6) AS uncertainty,
      unit, method FROM {ASSAY}"""
    v["stored_phases"] = f"""SELECT batch_id, phase_type, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us
      FROM {PHASES} WHERE phase_type <> 'decline' AND batch_id NOT IN ('7', '9')"""
    v["stored_operations"] = """SELECT conv_id || ':' || turn AS operation_id, CAST(conv_id AS VARCHAR) AS batch_id, role AS name,
      CASE WHEN turn = 0 THEN 'upstream' ELSE 'downstream' END AS operation_type,
      CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) ELSE '' END AS parents FROM conversations"""
    v["stored_catalog"] = f"""SELECT batch_id, name, CASE lifecycle WHEN 'planned' THEN 'running' ELSE lifecycle END AS lifecycle,
      strain AS meta_strain FROM {BATCHES} WHERE batch_id <> '7'"""
    v["cascading_delete"] = f"""SELECT batch_id, variable, count(*) AS n FROM {TELEMETRY}
      WHERE value <= 100 AND batch_id <> '7' GROUP BY 1, 2"""
    v["sql_text"] = f"""SELECT b.name, b.strain, t.variable, count(*) AS n, round(sum(t.value), 6) AS total
      FROM {BATCHES} b JOIN {TELEMETRY} t USING (batch_id) WHERE t.value <= 100 AND b.lifecycle <> 'planned' GROUP BY 1, 2, 3"""
    two = ALIGNED.replace("{where}", "WHERE variable IN ('click', 'view')")
    half_day = GRID.replace("{step}", "43200000000")
    v["golden_source"] = f"""WITH {two}, {half_day} SELECT variable, g AS elapsed_us, count(v) AS n_batches,
      round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM grid GROUP BY variable, g"""
    for fmt in ("csv", "parquet", "arrow"):
        v[f"export_{fmt}"] = f"""SELECT {rows}, NULL::DOUBLE AS uncertainty, NULL::VARCHAR AS method FROM {SENSORS}
          UNION ALL SELECT {rows}, round(uncertainty, 6), method FROM {ASSAY}"""
    wanted = "FROM events WHERE event_type IN ('click', 'error', 'view')"
    v["text_load"] = f"""SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS ts_us,
      CASE event_type WHEN 'click' THEN 'glucose' WHEN 'error' THEN 'temperature' ELSE 'volume' END AS variable,
      round(CASE event_type WHEN 'error' THEN value - 273.15 ELSE value / 1000 END, 6) AS value,
      CASE event_type WHEN 'click' THEN 'g/L' WHEN 'error' THEN 'C' ELSE 'L' END AS unit {wanted}"""
    v["load_summary"] = f"""SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS rows_imported,
      count(DISTINCT ts) AS time_points, 3::BIGINT AS columns_mapped, 3::BIGINT AS columns_converted {wanted} GROUP BY 1"""
    v["original_rows"] = """SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) + 1 AS n,
      count(*) FILTER (event_type = 'click') + 1 AS n_glucose, 'timestamp,glucose,temperature,volume' AS headers
      FROM events GROUP BY 1"""
    sheets = """(SELECT CAST(c_nationkey AS VARCHAR) AS file, c_mktsegment || ' ' || c_name AS sheet, c_mktsegment AS segment,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'telemetry' WHEN 'MACHINERY' THEN 'assay' ELSE 'unknown' END AS type FROM customer)"""
    info = "(SELECT CAST(n_nationkey AS VARCHAR) AS file, 'Run_Info ' AS sheet, 'metadata' AS type, n_name FROM nation)"
    v["sheet_types"] = f"""SELECT file, sheet, type, false AS batch_per_sheet FROM {sheets}
      UNION ALL SELECT file, sheet, type, false FROM {info}"""
    v["run_per_sheet"] = f"""SELECT file || ' ' || segment AS file, sheet,
      count(*) OVER (PARTITION BY file, segment) >= 2 AS batch_per_sheet FROM {sheets}"""
    v["metadata_sheets"] = f"""SELECT file, 'strain' AS key, n_name AS value FROM {info}
      UNION ALL SELECT file, 'region', 'again' FROM {info}"""
    v["external_ids"] = """SELECT CAST(user_id AS VARCHAR) AS batch_id, 'first_event' AS key, arg_min(event_type, event_id) AS value
      FROM events GROUP BY 1
      UNION ALL SELECT CAST(user_id AS VARCHAR), 'session', CAST(min(event_id) AS VARCHAR) FROM events
      WHERE event_type = 'view' GROUP BY 1"""
    v["stream_ingest"] = f"""SELECT CAST(user_id AS VARCHAR) AS batch_id, epoch_us(ts) AS ts_us,
      CASE event_type WHEN 'click' THEN 'biomass' WHEN 'error' THEN 'temperature' ELSE 'ph' END AS variable,
      round(CASE event_type WHEN 'click' THEN value / 1000 WHEN 'error' THEN value - 273.15 ELSE value * 0.1 END, 6) AS value,
      CASE event_type WHEN 'click' THEN 'g/L' WHEN 'error' THEN 'C' END AS unit
      FROM (SELECT user_id, ts, event_type, min(value) AS value {wanted} GROUP BY ALL)"""
    return v
