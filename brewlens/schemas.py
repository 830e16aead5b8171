"""Declared table schemas. Reads force them; nothing stored is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TELEMETRY = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("variable", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])

ASSAY = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("variable", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("uncertainty", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("method", T.StringType()),
])

BATCHES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lifecycle", T.StringType()),
    T.StructField("ts_inoculation", T.TimestampType()),
    T.StructField("ts_feed_start", T.TimestampType()),
    T.StructField("ts_induction", T.TimestampType()),
    T.StructField("ts_harvest", T.TimestampType()),
    T.StructField("meta_strain", T.StringType()),
    T.StructField("meta_media", T.StringType()),
    T.StructField("meta_scale_liters", T.DoubleType()),
    T.StructField("meta_operator", T.StringType()),
    T.StructField("meta_extra", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

OPERATIONS = T.StructType([
    T.StructField("operation_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("operation_type", T.StringType()),
    T.StructField("parent_ids", T.ArrayType(T.StringType())),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
])

PHASES = T.StructType([
    T.StructField("annotation_id", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("phase_type", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("signal_variable", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

METRICS = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("phase_type", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("mu", T.DoubleType()),
    T.StructField("qp", T.DoubleType()),
    T.StructField("yx_s", T.DoubleType()),
    T.StructField("yp_s", T.DoubleType()),
    T.StructField("r_squared", T.DoubleType()),
    T.StructField("signal_variable", T.StringType()),
])

GOLDEN_PROFILES = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("elapsed_us", T.LongType()),
    T.StructField("elapsed_hours", T.DoubleType()),
    T.StructField("variable", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("n_batches", T.LongType()),
])

SENSORS = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("output_variable", T.StringType()),
    T.StructField("input_variables", T.ArrayType(T.StringType())),
    T.StructField("model_type", T.StringType()),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("center", T.ArrayType(T.DoubleType())),
    T.StructField("scale", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("prediction_std", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

AUDIT = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("entry_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("old_value_hash", T.StringType()),
    T.StructField("new_value_hash", T.StringType()),
    T.StructField("previous_entry_hash", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("signature", T.BinaryType()),
    T.StructField("public_key_pem", T.StringType()),
    T.StructField("record_hash", T.StringType()),
])

USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

LIFECYCLES = ("planned", "inoculated", "running", "harvested", "aborted")
PHASE_TYPES = ("lag", "exponential", "stationary", "decline", "unknown")
AUDIT_ACTIONS = ("create", "update", "delete", "sign")
