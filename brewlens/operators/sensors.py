"""Soft sensors: predicted variables from measured ones."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.functions.scalars import finite
from brewlens.session import kept

#: Model types of a sensor record. A ``linear`` one is intercept + sum of coefficient * input; ``pls`` (a fitted projection
#: is linear in its inputs) centres and scales the inputs before; ``custom`` names a Python model in ``metadata['model']``.
MODEL_TYPES = ("linear", "pls", "custom")
PREDICTION = "batch_id string, ts timestamp, variable string, value double, uncertainty double, source string"
SOURCE = "soft_sensor"


class Sensor(ABC):
    """A user model. ``predict`` gets one array per input and the timestamps of the first input."""

    output_variable: str
    input_variables: Sequence[str]
    #: True when a prediction depends on other rows of the same batch (needs the batch as a whole).
    sequential = False

    @abstractmethod
    def predict(
        self, inputs: dict[str, np.ndarray], timestamps: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray | None]: ...


@dataclass(frozen=True)
class LinearSensor:
    """y = slope * x + intercept with a constant 1-sigma; applied as a column expression."""

    input_variable: str
    output_variable: str
    slope: float
    intercept: float
    std: float | None = None


def _linear(sensor: LinearSensor, telemetry: DataFrame) -> DataFrame:
    return telemetry.where(F.col("variable") == sensor.input_variable).select(
        "batch_id", "ts", F.lit(sensor.output_variable).alias("variable"),
        (F.col("value") * F.lit(sensor.slope) + F.lit(sensor.intercept)).alias("value"),
        F.lit(sensor.std).cast("double").alias("uncertainty"), F.lit(SOURCE).alias("source"),
    )


def wide_inputs(telemetry: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(batch_id, ts, x0, x1, ...) at the timestamps of the first variable, matched by equal time."""
    columns = [F.min(F.when(F.col("variable") == v, F.col("value"))).alias(f"x{i}") for i, v in enumerate(variables)]
    return (
        telemetry.where(F.col("variable").isin(list(variables))).groupBy("batch_id", "ts").agg(*columns)
        .where("x0 is not null")
    )


def _predict(sensor: Sensor, rows: pd.DataFrame) -> pd.DataFrame:
    inputs = {v: rows[f"x{i}"].to_numpy(float) for i, v in enumerate(sensor.input_variables)}
    try:
        values, sigma = sensor.predict(inputs, rows["ts"].to_numpy())
    except ValueError:
        raise
    except Exception as exc:
        raise RuntimeError(f"soft sensor prediction failed: {exc}") from exc
    if len(values) != len(rows):
        raise ValueError(f"prediction has {len(values)} values for {len(rows)} timestamps")
    return pd.DataFrame({
        "batch_id": rows["batch_id"].to_numpy(), "ts": rows["ts"].to_numpy(), "variable": sensor.output_variable,
        "value": np.asarray(values, float), "uncertainty": np.nan if sigma is None else np.asarray(sigma, float),
        "source": SOURCE,
    })


def apply_sensor(sensor: Sensor | LinearSensor, telemetry: DataFrame) -> DataFrame:
    """Predicted rows for all batches.

    Row-wise models run on Arrow batches wherever the rows are; only models that declare themselves
    sequential get a whole batch in one call.
    """
    if isinstance(sensor, LinearSensor):
        return _linear(sensor, telemetry)
    wide = wide_inputs(telemetry, sensor.input_variables)
    if sensor.sequential:
        return wide.groupBy("batch_id").applyInPandas(lambda g: _predict(sensor, g.sort_values("ts")), PREDICTION)

    def rowwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield _predict(sensor, rows)

    return wide.mapInPandas(rowwise, PREDICTION)


# --- sensor records --------------------------------------------------------------------------------------------------


def record_issues(records: DataFrame, models: Mapping[str, Sensor] | None = None) -> DataFrame:
    """(sensor_id, issue) of records that cannot be applied; ``models`` are the Python models at hand."""
    models = models or {}
    inputs, kind, model = F.size("input_variables"), F.col("model_type"), F.col("metadata")["model"]
    weighted, custom = kind.isin("linear", "pls"), kind == "custom"
    known = model.isin(list(models)) if models else F.lit(False)
    wanted = F.create_map(*[x for n, m in models.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in m.input_variables]))])
    other = wanted[model] != F.col("input_variables") if models else F.lit(False)
    checks = {
        "no sensor_id": F.col("sensor_id").isNull(),
        "no output variable": F.coalesce(F.col("output_variable"), F.lit("")) == "",
        "no input variables": F.coalesce(inputs, F.lit(0)) <= 0,
        "unknown model type": ~F.coalesce(kind.isin(*MODEL_TYPES), F.lit(False)),
        "coefficients do not fit the inputs": weighted & ~F.coalesce(
            (F.size("coefficients") == inputs) & F.forall("coefficients", lambda c: finite(c).isNotNull()), F.lit(False)),
        "centres or scales do not fit the inputs": (kind == "pls") & ~F.coalesce(
            (F.size("center") == inputs) & (F.size("scale") == inputs)
            & F.forall("center", lambda c: finite(c).isNotNull()) & F.forall("scale", lambda c: finite(c).isNotNull() & (c != 0)),
            F.lit(False)),
        "intercept not finite": weighted & finite(F.col("intercept")).isNull(),
        "model not at hand": custom & ~F.coalesce(known, F.lit(False)),
        "inputs are not the model's": custom & F.coalesce(other, F.lit(False)),
        "negative deviation": F.col("prediction_std") < 0,
    }
    found = records.select("sensor_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("issue"))
    repeated = records.where("sensor_id is not null").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(repeated.select("sensor_id", F.lit("several records").alias("issue")))


def usable_records(records: DataFrame, models: Mapping[str, Sensor] | None = None) -> DataFrame:
    """Records without an issue."""
    return records.join(record_issues(records, models).select("sensor_id").distinct(), "sensor_id", "left_anti").where(
        "sensor_id is not null"
    )


def _weighted(records: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Predictions of all linear and pls records in one pass.

    A sensor predicts where all its inputs have a reading at one time; of several the smallest counts.
    A time point is one row with all its readings and meets each sensor once, by the sensor's first input; nothing is
    grouped once points have met sensors. Records are kept, so that few of them are broadcast.
    """
    one, none = F.array_repeat(F.lit(1.0), F.size("input_variables")), F.array_repeat(F.lit(0.0), F.size("input_variables"))
    pls = F.col("model_type") == "pls"
    weighted = kept(records.where(F.col("model_type").isin("linear", "pls")).select(
        "sensor_id", "output_variable", "prediction_std", "intercept", F.get("input_variables", F.lit(0)).alias("variable"),
        F.arrays_zip(
            F.col("input_variables").alias("input"), F.col("coefficients").alias("coefficient"),
            F.when(pls, F.col("center")).otherwise(none).alias("center"), F.when(pls, F.col("scale")).otherwise(one).alias("scale"),
        ).alias("terms"),
    ), "sensors")
    readings = telemetry.where("variable is not null").groupBy("batch_id", "ts", "variable").agg(
        F.min(finite(F.col("value"))).alias("x")).where("x is not null")
    points = readings.groupBy("batch_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("variable", "x"))).alias("at"))
    met = points.withColumn("variable", F.explode(F.map_keys("at"))).join(weighted, "variable")

    def reading(term: Column) -> Column:
        return F.try_element_at(F.col("at"), term["input"])

    whole = met.where(F.forall("terms", lambda t: reading(t).isNotNull()))
    added = F.aggregate(
        "terms", F.lit(0.0), lambda total, t: total + t["coefficient"] * (reading(t) - t["center"]) / t["scale"])
    return whole.select(
        "sensor_id", "batch_id", "ts", F.col("output_variable").alias("variable"),
        (F.col("intercept") + added).alias("value"), F.col("prediction_std").alias("uncertainty"),
        F.lit(SOURCE).alias("source"),
    )


def _modelled(models: Mapping[str, Sensor], telemetry: DataFrame) -> DataFrame:
    """``model`` and predictions of Python models; all that work row by row share one pass over one wide table."""
    rowwise = {n: m for n, m in models.items() if not m.sequential}
    schema = f"{PREDICTION}, model string"
    parts = [apply_sensor(m, telemetry).withColumn("model", F.lit(n)) for n, m in models.items() if m.sequential]
    if rowwise:
        variables = list(dict.fromkeys(v for m in rowwise.values() for v in m.input_variables))
        columns = [F.min(F.when(F.col("variable") == v, F.col("value"))).alias(f"v{i}") for i, v in enumerate(variables)]
        wide = telemetry.where(F.col("variable").isin(variables)).groupBy("batch_id", "ts").agg(*columns)

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for name, model in rowwise.items():
                    at = [variables.index(v) for v in model.input_variables]
                    mine = rows[rows[f"v{at[0]}"].notna()]
                    if len(mine):
                        named = mine[["batch_id", "ts"]].assign(**{f"x{i}": mine[f"v{j}"] for i, j in enumerate(at)})
                        yield _predict(model, named).assign(model=name)

        parts.append(wide.mapInPandas(predict, schema))
    return reduce(DataFrame.unionByName, parts)


def apply_records(records: DataFrame, telemetry: DataFrame, models: Mapping[str, Sensor] | None = None) -> DataFrame:
    """``sensor_id`` and predicted rows of every usable record for all batches; see :func:`record_issues` for the rest.

    A custom record renames its model's output and gives a deviation where the model has none.
    """
    good = usable_records(records, models)
    found = _weighted(good, telemetry)
    if not models:
        return found
    named = good.where("model_type = 'custom'").select(
        "sensor_id", F.col("metadata")["model"].alias("model"), F.col("output_variable").alias("output"), "prediction_std"
    )
    made = _modelled(models, telemetry).join(named, "model").select(
        "sensor_id", "batch_id", "ts", F.col("output").alias("variable"), "value",
        F.coalesce(finite(F.col("uncertainty")), "prediction_std").alias("uncertainty"), "source",
    )
    return found.unionByName(made)


def with_predictions(telemetry: DataFrame, predictions: DataFrame) -> DataFrame:
    """Telemetry and predicted rows together."""
    return telemetry.unionByName(predictions, allowMissingColumns=True)
