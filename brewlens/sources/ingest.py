"""Loads of raw instrument files: plan the columns, then melt, convert and flag.

A load covers many files. Its plan is a DataFrame with one row per (file, column), made from the header and
from sums over all cells of a column; the transform joins the plan to all lines and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.functions import kernels
from brewlens.functions import scalars as S
from brewlens.session import cut_lineage, kept
from brewlens.sources import delimited, workbook


# --- vocabulary and header matching -------------------------------------------------------------------------


def vocabulary(custom: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Known aliases per variable; custom aliases are appended, new variables added."""
    merged = {v: list(a) for v, a in K.VOCABULARY.items()}
    for variable, aliases in (custom or {}).items():
        merged.setdefault(variable, [])
        merged[variable] += list(aliases)
    return merged


def vocabulary_table(spark: SparkSession, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(n, alias, var) for n, (alias, var) in enumerate((a, v) for v, al in vocab.items() for a in al)]
    return spark.createDataFrame(rows, "alias_no int, alias string, variable string")


def match_headers(headers: DataFrame, vocab: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(header, variable, confidence) for a frame of distinct headers.

    Equal to an alias ignoring case: confidence 1. Otherwise the most similar alias with a similarity of
    at least 70 %, else null and 0.
    """
    words = vocabulary() if vocab is None else vocab
    exact = {a.lower(): v for v, al in words.items() for a in al}
    aliases = [(a, exact[a.lower()]) for al in words.values() for a in al]

    @F.pandas_udf("struct<variable:string,confidence:double>")
    def match(cleaned: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        for text in cleaned.unique():
            if not text:
                known[text] = (None, 0.0)
            elif text.lower() in exact:
                known[text] = (exact[text.lower()], 1.0)
            else:
                var, confidence = kernels.best_alias(text, aliases, K.MATCH_THRESHOLD)
                known[text] = (var, confidence)
        return pd.DataFrame([known[t] for t in cleaned], columns=["variable", "confidence"])

    found = headers.select("header").distinct().withColumn("m", match(S.clean_header(F.col("header"))))
    return found.select("header", "m.variable", "m.confidence")


# --- planning ---------------------------------------------------------------------------------------------------


def is_unit_row(fields: Column) -> Column:
    texts = F.filter(F.transform(fields, lambda x: F.trim(x)), lambda x: x != "")
    known = F.array(*[F.lit(u) for u in K.KNOWN_UNITS])
    return (F.size(texts) > 0) & F.forall(texts, lambda x: F.array_contains(known, x))


def position(major: Column, minor: Column) -> Column:
    """One number that orders rows by ``major``, then ``minor`` (longs from 0 on; null comes first)."""
    high, low = (F.coalesce(c.cast("decimal(19,0)") + 1, F.lit(0).cast("decimal(19,0)")) for c in (major, minor))
    return high * F.lit(Decimal(1 << 63)) + low


def column_statistics(rows: DataFrame) -> DataFrame:
    """(source, col_no, filled, numbers, dated, day_first, mean, first_number) from every row (source, pos, fields).

    ``filled`` counts cells with text, ``numbers`` those that are numbers, ``dated`` those that look like a date;
    ``day_first`` holds if some cell has a day that can be no month in front. Sums are combined before the shuffle.
    A file's header and unit rows take part: they hold neither numbers nor dates. ``pos`` is a number, for which sums
    are hashed; for a struct or a text all cells would be sorted (see :func:`position`).
    """
    cells = rows.select("source", "pos", F.posexplode("fields").alias("col_no", "cell")).where(F.trim("cell") != "")
    number = S.numeric(F.col("cell"))
    parsed = cells.select("source", "pos", "col_no", "cell", number.alias("number"))
    dated = F.col("number").isNull() & S.looks_dated(F.col("cell"))
    return parsed.groupBy("source", "col_no").agg(
        F.count(F.lit(1)).alias("filled"), F.count("number").alias("numbers"), F.count_if(dated).alias("dated"),
        F.coalesce(F.bool_or(F.col("number").isNull() & S.day_leads(F.col("cell"))), F.lit(False)).alias("day_first"),
        F.avg("number").alias("mean"),
        F.min_by("number", F.when(F.col("number").isNotNull(), F.col("pos"))).alias("first_number"),
    )


def plan_columns(
    heads: DataFrame,
    rows: DataFrame,
    custom_vocab: Mapping[str, Sequence[str]] | None = None,
    confirmed: DataFrame | None = None,
) -> DataFrame:
    """One row per (source, column).

    ``heads`` has (source, rn, fields): row 0 is the header, row 1 may be a unit row. ``rows`` has (source, pos,
    fields), all rows of each source in the order of ``pos``: the date column, an elapsed clock and units guessed
    from a column's mean are decided by all of its cells. ``confirmed`` (source or null, header, variable) replaces
    the automatic header match for the headers it names.
    """
    ends = F.transform(F.sort_array(F.collect_list(F.struct("rn", "fields"))), lambda s: s["fields"])
    per_source = heads.where("rn < 2").groupBy("source").agg(ends.alias("rows"))
    second = F.coalesce(F.get("rows", F.lit(1)), F.array().cast("array<string>"))
    per_source = per_source.select(
        "source", F.get("rows", F.lit(0)).alias("headers"), F.when(is_unit_row(second), second).alias("units")
    )
    columns = per_source.select("source", "units", F.posexplode("headers").alias("col_no", "header")).select(
        "source", "col_no", "header", F.trim(F.get("units", F.col("col_no"))).alias("unit_row")
    ).join(column_statistics(rows), ["source", "col_no"], "left").na.fill(0, ["filled", "numbers", "dated"])
    matches = match_headers(columns, vocabulary(custom_vocab))
    planned = columns.join(matches, "header", "left")
    if confirmed is not None:
        fixed = confirmed.select("header", F.col("variable").alias("fixed")).distinct()
        planned = planned.join(fixed, "header", "left").withColumns({
            "variable": F.coalesce("fixed", "variable"),
            "confidence": F.when(F.col("fixed").isNotNull(), 1.0).otherwise(F.col("confidence")),
        }).drop("fixed")

    named = F.lower(S.clean_header(F.col("header"))).isin(*K.TIMESTAMP_NAMES)
    whole = Window.partitionBy("source")
    by_name = F.min(F.when(named, F.col("col_no"))).over(whole)
    # A date column by its values: three in five of its cells. A clock: more numbers than dates, from below 1 on.
    by_value = F.min(F.when((F.col("dated") > 0) & (5 * F.col("dated") >= 3 * F.col("filled")), F.col("col_no"))).over(whole)
    runs = (F.col("numbers") > F.col("dated")) & F.coalesce(F.col("first_number") < 1.0, F.lit(False))
    planned = planned.withColumn("ts_col", F.coalesce(by_name, by_value)).withColumns({
        "is_ts": F.col("col_no") == F.col("ts_col"),
        "is_elapsed": (F.col("col_no") == F.col("ts_col")) & named & runs,
    })
    source_unit = F.coalesce(
        F.when(F.col("unit_row") != "", F.col("unit_row")), S.header_unit(F.col("header")),
        S.range_unit(F.col("variable"), F.col("mean")),
    )
    canonical = S.canonical_unit(F.col("variable"))
    return planned.select(
        "source", "col_no", "header", "is_ts", "is_elapsed", "ts_col", "day_first",
        F.when(F.col("is_ts"), S.elapsed_unit(F.col("header"))).alias("elapsed_unit"),
        F.when(~F.coalesce("is_ts", F.lit(False)), F.col("variable")).alias("variable"),
        F.when(~F.coalesce("is_ts", F.lit(False)), F.col("confidence")).alias("confidence"),
        canonical.alias("unit"),
        F.when(canonical.isNotNull() & (source_unit != canonical), source_unit).alias("from_unit"),
    )


def plan_problems(plan: DataFrame, has_inoculation: bool) -> DataFrame:
    """(source, problem): sources that cannot be loaded."""
    per_source = plan.groupBy("source").agg(
        F.max("ts_col").alias("ts_col"), F.bool_or(F.coalesce("is_elapsed", F.lit(False))).alias("elapsed")
    )
    problem = F.when(F.col("ts_col").isNull(), "no timestamp column")
    if not has_inoculation:
        problem = problem.when(F.col("elapsed"), "elapsed time needs an inoculation time")
    return per_source.withColumn("problem", problem).where("problem is not null").select("source", "problem")


# --- transform -----------------------------------------------------------------------------------------------------


@dataclass
class Load:
    """The result of planning and transforming a load; every member is a lazy DataFrame.

    Sources with a problem give no records and do not keep the others from loading; ``loadable`` leaves them out.
    """

    records: DataFrame    # (source, batch_id, ts, variable, value, unit, quality_flag, warning)
    rejects: DataFrame    # (source, fields, reason)
    plan: DataFrame       # one row per (source, column)
    problems: DataFrame   # (source, problem)
    original: DataFrame   # (batch_id, source, headers, fields)
    batches: DataFrame    # (batch_id, name, source)

    def loadable(self) -> tuple[DataFrame, DataFrame]:
        """Batches and original rows of the sources without a problem."""
        bad = self.problems.select("source").distinct()
        return self.batches.join(bad, "source", "left_anti"), self.original.join(bad, "source", "left_anti")

    def summary(self) -> DataFrame:
        """Per source: long records, wide rows behind them, converted columns, flagged and warned rows."""
        conversions = self.plan.groupBy("source").agg(
            F.count_if(F.col("variable").isNotNull()).alias("columns_mapped"),
            F.count_if(F.col("variable").isNotNull() & F.col("from_unit").isNotNull()).alias("columns_converted"),
        )
        counts = self.records.groupBy("source", "batch_id").agg(
            F.count(F.lit(1)).alias("rows_imported"), F.count_distinct("ts").alias("time_points"),
            F.count("quality_flag").alias("questionable"), F.count("warning").alias("unconverted"),
        )
        return counts.join(conversions, "source", "left")

    def warnings(self) -> DataFrame:
        flagged = self.records.where("quality_flag is not null or warning is not null")
        text = F.coalesce(
            "warning",
            F.concat(F.lit("questionable "), F.col("variable"), F.lit(" value "), F.col("value").cast("string")),
        )
        return flagged.select("source", "batch_id", "ts", "variable", text.alias("warning"))


def melt(rows: DataFrame, plan: DataFrame, reference: Column) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from (source, fields) rows and their plan.

    ``reference`` is the start time of elapsed clocks. Header and unit rows hold no numbers and therefore
    give neither records nor, because their texts equal the plan's, rejects.
    """
    # What happens to a column's values is decided here, once per column; a cell only needs arithmetic.
    from_unit, unit = F.col("from_unit"), F.col("unit")
    factors = S.conversion_factors(F.coalesce(from_unit, F.lit("")), F.coalesce(F.when(from_unit.isNotNull(), unit), F.lit("")))
    decided = plan.withColumns({
        "factors": factors, "limits": S.quality_limits(F.col("variable")),
        "warning": F.when(from_unit.isNotNull(), S.conversion_warning(F.lit(1.0), from_unit, unit)),
    }).withColumn("final_unit", F.when(F.col("factors").isNull(), from_unit).otherwise(unit))
    per_source = decided.groupBy("source").agg(
        F.collect_list(F.when(
            F.col("variable").isNotNull(),
            F.struct("col_no", "variable", F.col("final_unit").alias("unit"), "factors", "limits", "warning"),
        )).alias("columns"),
        F.max("ts_col").alias("ts_col"),
        F.bool_or(F.coalesce("is_elapsed", F.lit(False))).alias("elapsed"),
        F.max("elapsed_unit").alias("elapsed_unit"),
        F.coalesce(F.bool_or(F.when(F.col("is_ts"), F.col("day_first"))), F.lit(False)).alias("day_first"),
        F.transform(F.sort_array(F.collect_list(F.struct("col_no", "header"))), lambda s: s["header"]).alias("headers"),
    )
    # Kept, so that the plan of few files is broadcast and their rows stay where they are.
    joined = rows.join(kept(per_source, "plan"), "source")
    raw_ts = F.get("fields", F.col("ts_col"))
    elapsed = S.elapsed_to_timestamp(S.numeric(raw_ts), F.col("elapsed_unit"), reference)
    timed = joined.withColumn("ts", F.when(F.col("elapsed"), elapsed).otherwise(S.parse_timestamp(raw_ts, F.col("day_first"))))
    heading = (F.col("fields") == F.col("headers")) | is_unit_row(F.col("fields"))
    rejects = timed.where(F.col("ts").isNull() & ~heading).select(
        "source", "fields", F.lit("timestamp not readable").alias("reason")
    )
    # Cells are looked up inside the array and parsed behind it, where code is compiled; cells that are no numbers end there.
    cells = F.transform("columns", lambda c: F.struct(
        c["variable"].alias("variable"), c["unit"].alias("unit"), c["factors"].alias("f"), c["limits"].alias("q"),
        c["warning"].alias("warning"), F.get("fields", c["col_no"]).alias("cell"),
    ))
    single = timed.select("source", "ts", F.explode(F.when(F.col("ts").isNotNull(), cells)).alias("c"))
    numbers = single.withColumn("raw", S.numeric(F.col("c.cell"))).where("raw IS NOT NULL")
    converted = F.expr("(raw - c.f.subtract) * c.f.multiply / c.f.divide")
    records = numbers.select(
        "source", "ts", "c.variable", F.coalesce(converted, F.col("raw")).alias("value"), "c.unit", "c.q", "c.warning"
    ).withColumn("quality_flag", F.expr(
        "CASE WHEN value < q.low THEN 'below_minimum' WHEN value > q.high THEN 'above_maximum' END"
    ))
    return records.select("source", "ts", "variable", "value", "unit", "quality_flag", "warning"), rejects


def _finish(
    rows: DataFrame, plan: DataFrame, batches: DataFrame, inoculation: datetime | str | None, broken: DataFrame | None = None
) -> Load:
    reference = F.lit(inoculation).cast("timestamp")
    problems = plan_problems(plan, inoculation is not None)
    if broken is not None:
        problems = problems.unionByName(broken)
    loadable = plan.join(problems, "source", "left_anti")
    records, rejects = melt(rows, loadable, reference)
    ids = batches.select("source", "batch_id")
    headers = plan.groupBy("source").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("col_no", "header"))), lambda s: s["header"]).alias("headers")
    ).join(ids, "source")
    original = rows.join(headers, "source").where(F.col("fields") != F.col("headers"))
    return Load(
        records=records.join(ids, "source").select(
            "source", "batch_id", "ts", "variable", "value", "unit", "quality_flag", "warning"
        ),
        rejects=rejects, plan=plan, problems=problems,
        original=original.select("batch_id", "source", "headers", "fields"),
        batches=batches,
    )


def _base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "\\.[^.]*$", "")


def load_delimited(
    spark: SparkSession,
    path: str,
    *,
    batch_name: str | None = None,
    inoculation: datetime | str | None = None,
    custom_vocab: Mapping[str, Sequence[str]] | None = None,
    confirmed: DataFrame | None = None,
) -> Load:
    """Plan and transform every delimited text file below ``path``; one batch per file."""
    records, unclosed = delimited.read_records(delimited.read_lines(spark, path))
    fields = delimited.split_line(F.col("line"), F.col("sep")).alias("fields")
    records = kept(records.select("source", *delimited.ORDER, fields), "records")
    rows = records.select("source", "pos", "fields")
    heads = delimited.head_lines(records, 2)
    plan = cut_lineage(plan_columns(heads, rows, custom_vocab, confirmed))
    name = F.lit(batch_name) if batch_name else _base_name(F.col("source"))
    batches = plan.select("source").distinct().select("source", S.stable_id(F.lit("file"), F.col("source")).alias("batch_id"), name.alias("name"))
    return _finish(rows.select("source", "fields"), plan, batches, inoculation, unclosed)


def load_workbooks(
    spark: SparkSession,
    path: str,
    *,
    inoculation: datetime | str | None = None,
    custom_vocab: Mapping[str, Sequence[str]] | None = None,
    confirmed: DataFrame | None = None,
) -> tuple[Load, Load, DataFrame]:
    """(telemetry load, assay load, metadata maps) of every workbook below ``path``.

    A workbook with one run per sheet gives one batch ``file-sheet`` per sheet; otherwise its telemetry
    and assay sheets belong to one batch and its metadata sheet describes it.
    """
    found = workbook.read_workbooks(spark, path)
    rows = found.where("error is null")
    broken = found.where("error is not null").select(F.col("file").alias("source"), F.col("error").alias("problem"))
    sheets = workbook.sheet_headers(rows)
    source = F.concat_ws("!", "file", "sheet")
    per_sheet = F.col("batch_per_sheet")
    base = _base_name(F.col("file"))
    labelled = sheets.select(
        "file", "sheet", "type", "batch_per_sheet", source.alias("source"),
        S.stable_id(F.lit("workbook"), F.col("file"), F.when(per_sheet, F.col("sheet"))).alias("batch_id"),
        F.when(per_sheet, F.concat_ws("-", base, F.col("sheet"))).otherwise(base).alias("name"),
    )

    def one(kind: Column) -> Load:
        chosen = labelled.where(kind)
        body = rows.select("file", "sheet", "rn", "fields").join(
            chosen.select("file", "sheet", "source"), ["file", "sheet"]
        )
        plan = plan_columns(
            body.where("rn < 2").select("source", "rn", "fields"),
            body.select("source", F.col("rn").alias("pos"), "fields"), custom_vocab, confirmed,
        )
        return _finish(body.select("source", "fields"), plan, chosen.select("source", "batch_id", "name"), inoculation)

    telemetry = one(per_sheet | (F.col("type") == "telemetry"))
    telemetry = replace(telemetry, problems=telemetry.problems.select("source", "problem").unionByName(broken))
    assay = one(~per_sheet & (F.col("type") == "assay"))
    metadata = workbook.metadata_maps(rows, sheets.where(~per_sheet)).join(
        labelled.select("file", "batch_id").distinct(), "file"
    )
    return telemetry, assay, metadata


def apply_metadata(batches: DataFrame, metadata: DataFrame) -> DataFrame:
    """Catalog rows with the four known metadata keys set and all others in ``meta_extra``."""
    m = F.col("metadata")
    known = F.array(*[F.lit(k) for k in K.METADATA_KEYS])
    rest = F.map_filter(m, lambda k, v: ~F.array_contains(known, k))
    joined = batches.join(metadata.select("batch_id", "metadata"), "batch_id", "left")
    return joined.withColumns({
        "meta_strain": F.coalesce(m["strain"], F.col("meta_strain")),
        "meta_media": F.coalesce(m["media"], F.col("meta_media")),
        "meta_scale_liters": F.coalesce(S.numeric(m["scale_liters"]), F.col("meta_scale_liters")),
        "meta_operator": F.coalesce(m["operator"], F.col("meta_operator")),
        "meta_extra": F.when(m.isNull(), F.col("meta_extra")).otherwise(
            F.map_concat(F.map_filter(
                F.coalesce("meta_extra", F.create_map().cast("map<string,string>")),
                lambda k, v: ~F.array_contains(F.map_keys(rest), k),
            ), rest)
        ),
    }).drop("metadata")
