from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from brewlens.operators.phases import OnlineConfig
from brewlens.sources.landed import FieldMapping, SourceMapping
from brewlens.streaming import online
from tests.conftest import START, TELEMETRY, signal_rows


def run(spark, source, target, checkpoint, config):
    stream = online.telemetry_stream(spark, str(source), max_files=1)
    online.detect_online(stream, config).writeStream.format("parquet").option("path", str(target)).option(
        "checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(target))


def test_state_survives_batches_and_late_rows_are_counted(spark, tmp_path):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.1, 120), r.normal(4, 0.1, 60)])
    rows = signal_rows("a", "OD600", x) + signal_rows("b", "OD600", x[:30] + 1) + signal_rows("a", "pH", [7.0] * 5)
    config = OnlineConfig(hazard=0.01, threshold=0.3)
    source = tmp_path / "in"
    spark.createDataFrame(rows[:100], TELEMETRY).coalesce(1).write.mode("append").parquet(str(source))
    run(spark, source, tmp_path / "out", tmp_path / "cp", config)
    late = [("a", START + timedelta(seconds=5), "OD600", 99.0, None)]
    spark.createDataFrame(rows[100:] + late, TELEMETRY).coalesce(1).write.mode("append").parquet(str(source))
    out = run(spark, source, tmp_path / "out", tmp_path / "cp", config)
    got = out.where("batch_id = 'a' and not late").orderBy("ts").collect()
    assert [(r["value"], r["detected"], r["short_mass"]) for r in out.where("late").collect()] == [(99.0, None, None)]
    p = config.posterior()
    expected = [p.update(v) for v in x]
    assert [r["detected"] for r in got] == [d for d, _ in expected]
    assert np.allclose([r["short_mass"] for r in got], [m for _, m in expected])
    assert out.where("batch_id = 'b'").count() == 30 and out.where("variable = 'pH'").isEmpty()
    assert out.agg(F.max("late_dropped")).first()[0] == 1


def test_ingest_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    schema = "reactor string, _time timestamp, T double"
    spark.createDataFrame([("r1", START, 310.15), ("r2", START, None)], schema).write.parquet(str(landing))
    mapping = SourceMapping("_time", (FieldMapping("T", "temperature", "K"),))
    stream = spark.readStream.schema(schema).parquet(str(landing))
    online.ingest_stream(stream, mapping, "reactor", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["batch_id"], round(r["value"], 6), r["unit"]) for r in row] == [("r1", 37.0, "C")]
