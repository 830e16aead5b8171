"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from brewlens import constants as K

MICROS_PER_HOUR = 3_600_000_000


def lookup(table: dict[str, str | None], key: Column) -> Column:
    """Value of a small fixed dictionary for ``key``; null when absent."""
    pairs = [F.lit(x) for x in chain.from_iterable((k, v) for k, v in table.items() if v is not None)]
    return F.create_map(*pairs)[key]


def finite(value: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


# Texts are tested by pattern before they are parsed: a failed parse costs an exception per value, which
# is far more than the match.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def numeric(text: Column) -> Column:
    """A finite number parsed from text, else null."""
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER), F.when(F.abs(value) < F.lit(float("inf")), value))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_HOUR))


def elapsed_to_timestamp(elapsed: Column, unit: Column, reference: Column) -> Column:
    """Elapsed time in ``h``/``min``/``s`` after ``reference`` as a timestamp."""
    per_unit = F.when(unit == "min", F.lit(6.0e7)).when(unit == "s", F.lit(1.0e6)).when(unit == "h", F.lit(3.6e9))
    return F.timestamp_micros(F.unix_micros(reference) + F.bround(elapsed * per_unit).cast("long"))


def elapsed_unit(header: Column) -> Column:
    """Unit of an elapsed-time column from its name; hours when the name says nothing."""
    name = F.lower(F.trim(header))
    return (
        F.when(name.rlike("_mins?$"), "min")
        .when(name.rlike("_(s|sec|seconds)$"), "s")
        .when(name.rlike("_(h|hr|hours)$"), "h")
        .when(name.isin("minutes", "min"), "min")
        .when(name.isin("seconds", "sec", "s"), "s")
        .otherwise("h")
    )


def clean_header(header: Column) -> Column:
    return F.btrim(F.trim(header), F.lit("_"))


def canonical_unit(variable: Column) -> Column:
    units = {v: K.CANONICAL_UNITS[c] for v, c in K.VARIABLE_CATEGORY.items()}
    return lookup(units, variable)


def header_unit(header: Column) -> Column:
    """Unit named by the last two, else the last, underscore part of a header."""
    parts = F.split(F.trim(header), "_")
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1))
    two = F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)
    return F.coalesce(
        F.when(n >= 3, lookup(K.HEADER_SUFFIX_UNITS, two)),
        F.when(n >= 2, lookup(K.HEADER_SUFFIX_UNITS, last)),
    )


def range_unit(variable: Column, mean: Column) -> Column:
    """Unit guessed from the mean of a few sample values."""
    concentrations = [v for v, c in K.VARIABLE_CATEGORY.items() if c == "concentration"]
    temperatures = ["temperature"] + [v for v, c in K.VARIABLE_CATEGORY.items() if c == "temperature"]
    return (
        F.when(mean.isNull(), F.lit(None).cast("string"))
        .when(variable.isin(temperatures), F.when(mean > 200, "K").otherwise("C"))
        .when(variable.isin(concentrations), F.when(mean > 500, "mg/L").when(mean >= 0.1, "g/L"))
    )


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """``value`` in ``target`` units; null where no conversion exists or the value is not finite."""
    clean = finite(value)
    out = F.when(source == target, clean)
    for src, dst, subtract, multiply, divide in K.UNIT_CONVERSIONS:
        if subtract is None:
            continue
        step = clean
        if subtract:
            step = step - F.lit(subtract)
        if multiply != 1.0:
            step = step * F.lit(multiply)
        if divide != 1.0:
            step = step / F.lit(divide)
        out = out.when((source == src) & (target == dst), step)
    return out


def conversion_warning(value: Column, source: Column, target: Column) -> Column:
    """Why ``convert_unit`` gives null, or null when it does not."""
    needs_more = F.lit(False)
    known = source == target
    for src, dst, subtract, _, _ in K.UNIT_CONVERSIONS:
        pair = (source == src) & (target == dst)
        known = known | pair
        if subtract is None:
            needs_more = needs_more | pair
    label = F.concat(source, F.lit(" to "), target)
    return (
        F.when(finite(value).isNull(), F.concat(F.lit("Cannot convert non-finite value "), value.cast("string")))
        .when(needs_more, F.concat(F.lit("Conversion from "), label, F.lit(" requires additional parameters")))
        .when(~known, F.concat(F.lit("No conversion from "), label))
    )


def conversion_factors(source: Column, target: Column) -> Column:
    """Struct (subtract, multiply, divide) of a conversion, null where there is none.

    For plans that convert many values between the same two units: y = (x - subtract) * multiply / divide.
    """
    out = F.when(source == target, F.struct(F.lit(0.0).alias("subtract"), F.lit(1.0).alias("multiply"),
                                            F.lit(1.0).alias("divide")))
    for src, dst, *factors in K.UNIT_CONVERSIONS:
        if factors[0] is not None:
            step = F.struct(*[F.lit(f).alias(n) for n, f in zip(("subtract", "multiply", "divide"), factors, strict=True)])
            out = out.when((source == src) & (target == dst), step)
    return out


def quality_limits(variable: Column) -> Column:
    """Struct (low, high) of the plausible range of a variable; null where there is none."""
    name = F.lower(variable)
    out = F.when(F.lit(False), F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    for var, (low, high) in K.QUESTIONABLE_RANGES.items():
        out = out.when(name == var, F.struct(F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")))
    return out


def quality_flag(variable: Column, value: Column) -> Column:
    """``below_minimum`` / ``above_maximum`` for questionable values; the row is kept."""
    name = F.lower(variable)
    out = F.when(F.lit(False), F.lit("").cast("string"))
    for var, (low, high) in K.QUESTIONABLE_RANGES.items():
        if low is not None:
            out = out.when((name == var) & (value < low), "below_minimum")
        if high is not None:
            out = out.when((name == var) & (value > high), "above_maximum")
    return out


_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?"
_HALF_DAY = r" \d{1,2}:\d{2}(:\d{2})? ?[AaPp][Mm]"
_SLASHED, _SLASHED_HALF = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_HALF_DAY}$"
# Time texts beside ISO: pattern and layout; text without an offset is read as UTC.
TIMESTAMP_FORMATS = (
    (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_CLOCK}$", "yyyy/M/d[ H:mm[:ss]]"),
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_HALF_DAY}$", "yyyy-M-d h:mm[:ss][ ]a"),
    (rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_CLOCK}$", "d.M.yyyy[ H:mm[:ss]]"),
    (rf"^\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}}{_CLOCK}$", "d-MMM-yyyy[ H:mm[:ss]]"),
    (rf"^\d{{1,2}}-[A-Za-z]{{3}}-\d{{2}}{_CLOCK}$", "d-MMM-yy[ H:mm[:ss]]"),
    (rf"^\d{{1,2}} [A-Za-z]{{3}} \d{{4}}{_CLOCK}$", "d MMM yyyy[ H:mm[:ss]]"),
    (rf"^\d{{1,2}} [A-Za-z]{{4,9}} \d{{4}}{_CLOCK}$", "d MMMM yyyy[ H:mm[:ss]]"),
    (rf"^[A-Za-z]{{3}} \d{{1,2}},? \d{{4}}{_CLOCK}$", "MMM d[,] yyyy[ H:mm[:ss]]"),
    (rf"^[A-Za-z]{{4,9}} \d{{1,2}},? \d{{4}}{_CLOCK}$", "MMMM d[,] yyyy[ H:mm[:ss]]"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
    (r"^\d{8} \d{6}$", "yyyyMMdd HHmmss"),
)


def looks_dated(text: Column) -> Column:
    """Whether a text begins like a date: a year or day and a month, or a month's name and a day."""
    return F.trim(text).rlike(
        r"^(\d{4}[-/]\d{1,2}[-/]\d|\d{1,2}[-/. ](\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2}|[A-Za-z]{3,9} \d{1,2},? \d{4}|\d{8}[T ]\d{6}$)"
    )


def day_leads(text: Column) -> Column:
    """Whether a slashed date has a first number that can be no month."""
    return F.trim(text).rlike(r"^(1[3-9]|[23]\d)/\d{1,2}/\d{4}")


def parse_timestamp(text: Column, day_first: Column | None = None) -> Column:
    """Absolute timestamp text in ISO or one of the known layouts; null when it is neither.

    Plain numbers are data values, not dates, and give null. Slashed dates are month first unless ``day_first``
    holds; without it, those that can be no month-first date are read day first.
    """
    t = F.trim(text)

    def slashed(clock: str, of: Column) -> Column:
        month, day = (F.try_to_timestamp(of, F.lit(f"{order}/yyyy{clock}")) for order in ("M/d", "d/M"))
        return F.coalesce(month, day) if day_first is None else F.when(day_first, day).otherwise(month)

    parsed = F.when(t.rlike(_SLASHED), slashed("[ H:mm[:ss]]", t))
    parsed = parsed.when(t.rlike(_SLASHED_HALF), slashed(" h:mm[:ss][ ]a", F.upper(t)))
    for pattern, layout in TIMESTAMP_FORMATS:
        of = F.upper(t) if layout.endswith("a") else t
        parsed = parsed.when(t.rlike(pattern), F.try_to_timestamp(of, F.lit(layout)))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d"), t.try_cast("timestamp")), parsed)


def yield_with_uncertainty(p0: Column, p1: Column, c0: Column, c1: Column) -> tuple[Column, Column]:
    """Yield (p1-p0)/(c0-c1) and its 1-sigma from four (value, uncertainty) structs.

    First-order propagation with independent readings; no consumption gives (0, 0).
    """
    dp = p1["value"] - p0["value"]
    dc = c0["value"] - c1["value"]
    var_p = F.pow(p0["uncertainty"], 2) + F.pow(p1["uncertainty"], 2)
    var_c = F.pow(c0["uncertainty"], 2) + F.pow(c1["uncertainty"], 2)
    flat = F.abs(dc) < F.lit(1e-10)
    sigma = F.sqrt(var_p / F.pow(dc, 2) + F.pow(dp, 2) * var_c / F.pow(dc, 4))
    return F.when(flat, 0.0).otherwise(dp / dc), F.when(flat, 0.0).otherwise(sigma)


def yield_coefficient(p0: Column, p1: Column, c0: Column, c1: Column) -> Column:
    dc = c0 - c1
    return F.when(F.abs(dc) < F.lit(1e-10), 0.0).otherwise((p1 - p0) / dc)


def row_fingerprint(*cols: Column) -> Column:
    """SHA-256 of the values joined by ``:``."""
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def stable_id(*cols: Column) -> Column:
    """A UUID-shaped id derived from the natural key, the same on every re-run."""
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
             F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)
