import pytest
from pyspark.sql import functions as F

from brewlens.operators import query as q
from brewlens.schemas import BATCHES, METRICS
from tests.conftest import START


@pytest.fixture(scope="module")
def views(spark):
    names = [f.name for f in BATCHES.fields]

    def batch(i, strain, scale):
        row = dict(batch_id=f"b{i}", name=f"Run-{i}", lifecycle="running", meta_strain=strain, meta_scale_liters=scale, tags=[])
        return tuple(row.get(n) for n in names)

    batches = spark.createDataFrame([batch(1, "A", 1.0), batch(2, "A", None), batch(3, "B", 3.0), batch(4, None, 2.0)], BATCHES)
    metrics = spark.createDataFrame(
        [("b1", "exponential", START, START, 0.2, None, 0.5, None, 0.9, "x"), ("b1", "stationary", START, START, None, None, 0.7, None, None, "x"),
         ("b2", "exponential", START, START, 0.4, None, None, None, 0.9, "x")], METRICS)
    hours = F.expr("interval 2 hours")
    phases = metrics.select("batch_id", "phase_type", "start_ts", (F.col("end_ts") + hours).alias("end_ts"))
    profiles = spark.createDataFrame([("g1", 0.0, "x", 1.0), ("g2", 0.0, "x", 2.0)], "profile_id string, elapsed_hours double, variable string, mean double")
    return q.Views(batches, phases, metrics, None, profiles)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_projection_filter_order_limit(views):
    df = q.BatchQuery(views).select("name", q.field("scale_liters").named("s")).order_by("s").to_df()
    assert rows(df) == [("Run-1", 1.0), ("Run-4", 2.0), ("Run-3", 3.0), ("Run-2", None)]
    df = q.BatchQuery(views).select("name").order_by("scale_liters", descending=True).limit(2).to_df()
    assert rows(df) == [("Run-3",), ("Run-4",)]
    cond = (q.field("strain") == "A") | ~(q.field("scale_liters") < 3) & q.field("name").like("Run-%")
    assert sorted(rows(q.BatchQuery(views).select("batch_id").where(cond).to_df())) == [("b1",), ("b2",), ("b3",)]
    assert rows(q.BatchQuery(views).batch("b3").select("name").to_df()) == [("Run-3",)]
    assert rows(q.BatchQuery(views).golden_profile("g2").select("mean").to_df()) == [(2.0,)]
    inside = q.BatchQuery(views).batches(where=q.field("strain") != "A").select("batch_id")
    assert rows(inside.to_df()) == [("b3",)]


def test_domain_functions_join_once_per_argument(views):
    df = q.BatchQuery(views).select(
        "batch_id", q.growth_rate().named("mu"), q.phase_duration("exponential").named("e"), q.phase_duration("stationary").named("s")).to_df()
    assert sorted(rows(df), key=str) == [("b1", 0.2, 2.0, 2.0), ("b2", 0.4, 2.0, None), ("b3", None, None, None), ("b4", None, None, None)]
    fan = q.BatchQuery(views).select("batch_id", q.yield_coefficient().named("y")).where(q.yield_coefficient() > 0).to_df()
    assert sorted(rows(fan)) == [("b1", 0.5), ("b1", 0.7)]
    only_where = q.BatchQuery(views).select("batch_id").where(q.growth_rate() >= 0.4).to_df()
    assert rows(only_where) == [("b2",)]


def test_grouping(views):
    df = q.BatchQuery(views).select("strain", q.agg("avg", q.growth_rate()).named("mu"), q.agg("count").named("n")).group_by(
        "strain").order_by("strain").to_df()
    assert rows(df) == [("A", pytest.approx(0.3), 2), ("B", None, 1), (None, None, 1)]
    assert rows(q.BatchQuery(views).select(q.agg("max", "scale_liters"), q.agg("COUNT")).to_df()) == [(3.0, 4)]
    with pytest.raises(ValueError, match="neither grouped"):
        q.BatchQuery(views).select("name", q.agg("count")).group_by("strain").to_df()


def test_bad_input_is_rejected(views):
    for name in ('x"; DROP', "1a", "a b", ""):
        with pytest.raises(ValueError):
            q.field(name)
    with pytest.raises(ValueError):
        q.field("a").named("b c")
    for name in ("compare", "align", "median"):
        with pytest.raises(ValueError, match="unknown function"):
            q.agg(name)
    with pytest.raises(ValueError, match="unknown field"):
        q.BatchQuery(views).select("nope").to_df()
    deep = q.field("name") == "x"
    for _ in range(60):
        deep = ~deep
    everyone = q.BatchQuery(views).select("name").to_df().count()
    assert 0 <= q.BatchQuery(views).select("name").where(deep).to_df().count() <= everyone
    with pytest.raises(ValueError, match="not available"):
        q.BatchQuery(views).select(q.golden_score()).to_df()
    with pytest.raises(ValueError):
        q.BatchQuery(views).limit(-1)
    with pytest.raises(ValueError, match="needs an argument"):
        q.BatchQuery(views).select(q.agg("avg")).to_df()
    with pytest.raises(ValueError, match="literal"):
        q.BatchQuery(views).select("name").where(q.field("name") == None).to_df()  # noqa: E711


def test_sql_text_with_parameters(spark, views):
    df = q.sql(spark, views, "SELECT strain, max(mu) AS mu FROM batches LEFT JOIN batch_metrics USING (batch_id) WHERE strain = ? GROUP BY strain", ["A"])
    assert rows(df) == [("A", 0.4)]
