"""Growth rate, productivity and yields per (batch, phase), as built-in aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.functions.scalars import finite, hours_between, yield_coefficient, yield_with_uncertainty
from brewlens.operators.phases import in_phases
from brewlens.operators.timeseries import first_last

PHASE = ["batch_id", "phase_type", "start_ts", "end_ts"]


def _slope_and_fit(y: Column, x: Column) -> dict[str, Column]:
    return {
        "slope": F.regr_slope(y, x), "sxx": F.regr_sxx(y, x), "syy": F.regr_syy(y, x), "sxy": F.regr_sxy(y, x),
        "points": F.regr_count(y, x),
    }


def growth_rates(df: DataFrame, keys: list[str], hours: Column, value: Column) -> DataFrame:
    """mu, r_squared and std_error of ln(value) against hours per key.

    Null where there are fewer than two points or any value is not positive.
    """
    y = F.when(value > 0, F.ln(value))
    agg = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lowest"),
        *[c.alias(n) for n, c in _slope_and_fit(y, hours).items()],
    )
    ok = (F.col("n") >= 2) & (F.col("lowest") > 0) & (F.col("sxx") > 0)
    r2 = F.when(F.col("syy") == 0, 0.0).otherwise(F.pow("sxy", F.lit(2)) / (F.col("sxx") * F.col("syy")))
    rest = F.greatest(F.col("syy") - F.pow("sxy", F.lit(2)) / F.col("sxx"), F.lit(0.0))
    err = F.when(F.col("n") == 2, 0.0).otherwise(F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")))
    return agg.select(
        *keys, F.when(ok, F.col("slope")).alias("mu"), F.when(ok, r2).alias("r_squared"),
        F.when(ok, err).alias("std_error"), "n",
    )


def productivity(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Volumetric productivity (last - first) / hours; 0 when no time passes, null below two points."""
    rank = F.struct(ts, value)
    agg = df.where(finite(F.col(value)).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, rank).alias("p0"), F.max_by(value, rank).alias("p1"),
        F.min(ts).alias("t0"), F.max(ts).alias("t1"),
    )
    hours = hours_between(F.col("t0"), F.col("t1"))
    qp = F.when(hours > 0, (F.col("p1") - F.col("p0")) / hours).otherwise(0.0)
    return agg.select(*keys, F.when(F.col("n") >= 2, qp).alias("qp"), "n")


def yields_with_uncertainty(assay: DataFrame, consumed: str, produced: str) -> DataFrame:
    """Yield and its 1-sigma per batch from the first and last assay of two analytes."""
    ends = first_last(assay.where(F.col("variable").isin(consumed, produced)), F.col("ts"))

    def pick(name: str, which: str) -> Column:
        return F.max_by(which, F.when(F.col("variable") == name, F.lit(1))).alias(f"{which}_{name}")

    # one row per (batch, analyte) reaches this aggregation
    wide = ends.groupBy("batch_id").agg(
        pick(consumed, "first").alias("c0"), pick(consumed, "last").alias("c1"),
        pick(produced, "first").alias("p0"), pick(produced, "last").alias("p1"),
    ).where(F.col("c0").isNotNull() & F.col("p0").isNotNull())
    value, sigma = yield_with_uncertainty(F.col("p0"), F.col("p1"), F.col("c0"), F.col("c1"))
    return wide.select("batch_id", value.alias("yield"), sigma.alias("sigma"))


def batch_metrics(
    telemetry: DataFrame,
    phases: DataFrame,
    biomass: str = "OD600",
    product: str | None = None,
    substrate: str | None = None,
) -> DataFrame:
    """mu, qp, yx_s, yp_s and r_squared for every phase that has at least one of them.

    One range join and one aggregation; the common time range of biomass and substrate, which the yields
    need, takes a first narrow pass over those two variables when a substrate is named.
    """
    names = [v for v in (biomass, product, substrate) if v is not None]
    rows = (
        telemetry.where(F.col("variable").isin(names))
        .select("batch_id", "ts", "variable", finite(F.col("value")).alias("value"))
        .where("value is not null")
    )
    bands = phases.select(*PHASE).distinct()
    is_bio, is_prod = F.col("variable") == biomass, F.col("variable") == (product or "")
    is_sub = F.col("variable") == (substrate or "")

    extra: tuple[str, ...] = ()
    if substrate is not None:
        ranges = in_phases(rows.where(is_bio | is_sub), bands).groupBy(*PHASE).agg(
            F.greatest(F.min(F.when(is_bio, F.col("ts"))), F.min(F.when(is_sub, F.col("ts")))).alias("common_lo"),
            F.least(F.max(F.when(is_bio, F.col("ts"))), F.max(F.when(is_sub, F.col("ts")))).alias("common_hi"),
        )
        bands = bands.join(ranges, PHASE, "left")
        extra = ("common_lo", "common_hi")

    inside = in_phases(rows, bands, extra)
    value, ts = F.col("value"), F.col("ts")
    hours = hours_between(F.col("start_ts"), ts)

    def ends(prefix: str, cond: Column) -> list[Column]:
        rank = F.when(cond, F.struct(ts, value))
        return [
            F.count(F.when(cond, 1)).alias(f"{prefix}_n"),
            F.min_by(value, rank).alias(f"{prefix}_0"), F.max_by(value, rank).alias(f"{prefix}_1"),
        ]

    log_bio = F.when(is_bio & (value > 0), F.ln(value))
    aggregates = [
        F.min(F.when(is_bio, value)).alias("bio_low"),
        *[c.alias(n) for n, c in _slope_and_fit(log_bio, hours).items()],
        *ends("bio", is_bio),
    ]
    if product is not None:
        aggregates += ends("prod", is_prod)
        aggregates += [F.min(F.when(is_prod, ts)).alias("prod_t0"), F.max(F.when(is_prod, ts)).alias("prod_t1")]
    if substrate is not None:
        common = ts.between(F.col("common_lo"), F.col("common_hi"))
        aggregates += ends("sub", is_sub) + ends("bioc", is_bio & common) + ends("subc", is_sub & common)
    agg = inside.groupBy(*PHASE).agg(*aggregates)

    enough = F.col("bio_n") >= 2
    fits = enough & (F.col("phase_type") == "exponential") & (F.col("bio_low") > 0) & (F.col("sxx") > 0)
    r2 = F.when(F.col("syy") == 0, 0.0).otherwise(F.pow("sxy", F.lit(2)) / (F.col("sxx") * F.col("syy")))
    out = {
        "mu": F.when(fits, F.col("slope")),
        "r_squared": F.when(fits, r2),
        "qp": F.lit(None).cast("double"),
        "yx_s": F.lit(None).cast("double"),
        "yp_s": F.lit(None).cast("double"),
    }
    if product is not None:
        dt = hours_between(F.col("prod_t0"), F.col("prod_t1"))
        qp = F.when(dt > 0, (F.col("prod_1") - F.col("prod_0")) / dt).otherwise(0.0)
        out["qp"] = F.when(enough & (F.col("prod_n") >= 2), qp)
    if substrate is not None:
        aligned = (F.col("bioc_n") >= 2) & (F.col("subc_n") >= 2)
        b0, b1 = (F.when(aligned, F.col(f"bioc_{i}")).otherwise(F.col(f"bio_{i}")) for i in (0, 1))
        s0, s1 = (F.when(aligned, F.col(f"subc_{i}")).otherwise(F.col(f"sub_{i}")) for i in (0, 1))
        has_sub = enough & (F.col("sub_n") >= 2)
        out["yx_s"] = F.when(has_sub, yield_coefficient(b0, b1, s0, s1))
        if product is not None:
            out["yp_s"] = F.when(
                has_sub & (F.col("prod_n") >= 2),
                yield_coefficient(F.col("prod_0"), F.col("prod_1"), s0, s1),
            )
    result = agg.select(
        *PHASE, *[out[n].alias(n) for n in ("mu", "qp", "yx_s", "yp_s", "r_squared")],
        F.lit(biomass).alias("signal_variable"),
    )
    return result.where(F.coalesce("mu", "qp", "yx_s", "yp_s").isNotNull())
