"""The library's tables as views of the given benchmark tables (events, orders, lineitem, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.functions.scalars import stable_id
from brewlens.plans.ordered import PIECE, ordinals
from brewlens.session import ship_package

# Which event type plays which variable.
BIOMASS, PRODUCT, SUBSTRATE, OXYGEN = "click", "purchase", "view", "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per user, one variable per event type."""
    kind = F.col("event_type")
    unit = F.when(kind == "click", "g/L").when(kind == "error", "%").when(kind == "purchase", "g/L").when(
        kind == "view", "g/L"
    )
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("batch_id"), "ts", kind.alias("variable"), "value", unit.alias("unit")
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per user with all its events as one signal."""
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("batch_id"), "ts", F.lit("activity").alias("variable"), "value",
        F.lit(None).cast("string").alias("unit"),
    )


def long_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few, long signals: one batch per event type."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("batch_id"), "ts", F.lit("activity").alias("variable"), "value",
        F.lit(None).cast("string").alias("unit"),
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).where(F.col("variable") != PRODUCT)


def sensor_records(spark: SparkSession, sf_dir: str, source: str = "nation") -> DataFrame:
    """Nations (or suppliers) as sensor records: the region picks inputs and model type, one of them an unknown type."""
    rows = table(spark, sf_dir, source)
    key = F.col({"nation": "n_nationkey", "supplier": "s_suppkey"}[source]).cast("long")
    region = (F.col("n_regionkey") if source == "nation" else F.col("s_nationkey") % 5).cast("int")
    inputs = F.get(F.array(*[F.array(*[F.lit(v) for v in names]) for names in (
        ["click"], ["view", "click"], ["error"], ["view", "error", "click"], ["click"],
    )]), region)
    kind = F.get(F.array(*[F.lit(k) for k in ("linear", "linear", "linear", "pls", "spline")]), region)
    weights = F.array((key + 1).cast("double"), -(region + 1).cast("double"), F.lit(0.5))
    return rows.select(
        F.concat(F.lit("s"), key).alias("sensor_id"), F.concat(F.lit("est_"), key).alias("output_variable"),
        inputs.alias("input_variables"), kind.alias("model_type"),
        F.when(key % 7 != 6, F.slice(weights, F.lit(1), F.size(inputs))).otherwise(weights).alias("coefficients"),
        F.array_repeat(F.lit(1.0), F.size(inputs)).alias("center"), F.array_repeat(F.lit(2.0), F.size(inputs)).alias("scale"),
        (key / 10).alias("intercept"), (region / 100 - F.when(key % 11 == 10, 1).otherwise(0)).alias("prediction_std"),
        F.create_map(F.lit("origin"), F.lit(source)).alias("metadata"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with times cut to the day, so that variables of a batch share times."""
    return telemetry(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts"))


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as offline assays with 5 % uncertainty."""
    return telemetry(spark, sf_dir).where(F.col("variable") == PRODUCT).select(
        "batch_id", "ts", "variable", "value", (F.col("value") * 0.05).alias("uncertainty"), F.lit("g/L").alias("unit"),
        F.lit("HPLC").alias("method"),
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four phases per user, a quarter of its events each (the first quarters take the remainder)."""
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("batch_id"), "ts", "event_id")
    numbered = ordinals(rows, ["batch_id"], ["ts", "event_id"], F.unix_micros("ts"), PIECE * 7)
    quarter, rest = F.floor(F.col("_n") / 4), F.col("_n") % 4
    longer = rest * (quarter + 1)
    tile = F.when(F.col("_i") < longer, F.floor(F.col("_i") / (quarter + 1))).otherwise(
        rest + F.floor((F.col("_i") - longer) / F.greatest(quarter, F.lit(1)))
    )
    names = F.array(*[F.lit(p) for p in ("lag", "exponential", "stationary", "decline")])
    bands = numbered.groupBy("batch_id", F.get(names, tile.cast("int")).alias("phase_type")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    return bands.select(
        stable_id(F.col("batch_id"), F.col("phase_type")).alias("annotation_id"), "batch_id", "phase_type",
        "start_ts", "end_ts", F.lit("activity").alias("signal_variable"), F.lit(1.0).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the batch catalog, customers as operators."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    status = F.col("o_orderstatus")
    lifecycle = F.when(status == "O", "running").when(status == "F", "harvested").when(status == "P", "planned")
    none = F.lit(None).cast("timestamp")
    started = F.col("o_orderdate").cast("timestamp")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("batch_id"),
        F.concat_ws("-", F.lit("Run"), "o_orderstatus", "o_orderkey").alias("name"),
        lifecycle.alias("lifecycle"), started.alias("ts_inoculation"), none.alias("ts_feed_start"),
        none.alias("ts_induction"), none.alias("ts_harvest"), F.col("o_orderpriority").alias("meta_strain"),
        F.col("c_mktsegment").alias("meta_media"), (F.col("o_totalprice") / 1000).alias("meta_scale_liters"),
        F.col("c_name").alias("meta_operator"), F.create_map().cast("map<string,string>").alias("meta_extra"),
        F.array_compact(F.array(
            "o_orderstatus", "c_mktsegment", F.when(F.col("o_totalprice") > 300_000, "scale-up").otherwise("bench"),
        )).alias("tags"),
        started.alias("created_at"), started.alias("updated_at"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as unit operations, each following the turn before."""
    turn = F.col("turn")
    oid = F.concat_ws(":", "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select(
        oid.alias("operation_id"), F.col("conv_id").cast("string").alias("batch_id"), F.col("role").alias("name"),
        F.when(turn == 0, "upstream").otherwise("downstream").alias("operation_type"),
        F.when(turn > 0, F.array(F.concat_ws(":", F.col("conv_id"), turn - 1))).otherwise(
            F.array().cast("array<string>")
        ).alias("parent_ids"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"),
        F.create_map().cast("map<string,string>").alias("parameters"),
    )


def audit_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as audit entries that are not linked yet; one tenant per conversation.

    Whole texts are hashed; the turn's number orders the entries of a tenant.
    """
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    user = F.col("role") == "user"
    return c.select(
        F.col("conv_id").cast("string").alias("tenant_id"), turn.cast("long").alias("seq"),
        stable_id(F.col("conv_id"), turn).alias("entry_id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("conv_id") * 60_000_000 + turn * 1_500_000)
        .alias("timestamp"),
        F.col("role").alias("user_id"),
        F.when(turn == 0, "create").when(user, "update").otherwise("sign").alias("action"),
        F.lit("conversation").alias("entity_type"), F.col("conv_id").cast("string").alias("entity_id"),
        F.when(turn == 0, "").otherwise(F.sha2(F.concat_ws(":", "conv_id", turn - 1), 256)).alias("old_value_hash"),
        F.sha2("text", 256).alias("new_value_hash"),
        F.when(user, "said \"hello\"\té").otherwise("").alias("reason"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers as users: the assistant edits, the user may only read."""
    roles = table(spark, sf_dir, "conversations").select("role").distinct()
    return roles.select(
        F.col("role").alias("user_id"), F.col("role").alias("name"),
        F.when(F.col("role") == "assistant", "editor").otherwise("viewer").alias("role"), F.lit(True).alias("active"),
    )
