"""Batch queries: catalog or profile rows with domain functions, as plain DataFrame operations.

``BatchQuery`` composes a DataFrame; Catalyst plans it. Users who prefer text register the views and write
Spark SQL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.functions.scalars import hours_between
from brewlens.operators.catalog import with_aliases

_IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
RESERVED = ("compare", "align")


# --- expressions --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A field, a domain function or an aggregate of one, optionally named."""

    kind: str
    name: str = ""
    arg: Term | str | None = None
    alias: str | None = None

    def named(self, alias: str) -> Term:
        return replace(self, alias=_identifier(alias))

    def _cmp(self, op: str, other: object) -> Condition:
        return Condition(op, self, other)

    def __eq__(self, other: object) -> Condition:  # type: ignore[override]
        return self._cmp("=", other)

    def __ne__(self, other: object) -> Condition:  # type: ignore[override]
        return self._cmp("!=", other)

    def __lt__(self, other: object) -> Condition:
        return self._cmp("<", other)

    def __le__(self, other: object) -> Condition:
        return self._cmp("<=", other)

    def __gt__(self, other: object) -> Condition:
        return self._cmp(">", other)

    def __ge__(self, other: object) -> Condition:
        return self._cmp(">=", other)

    def like(self, pattern: str) -> Condition:
        return self._cmp("LIKE", pattern)

    __hash__ = object.__hash__


@dataclass(frozen=True)
class Condition:
    """A comparison, or conditions combined with ``&``, ``|`` and ``~``."""

    op: str
    left: object
    right: object = None

    def __and__(self, other: Condition) -> Condition:
        return Condition("AND", self, other)

    def __or__(self, other: Condition) -> Condition:
        return Condition("OR", self, other)

    def __invert__(self) -> Condition:
        return Condition("NOT", self)


def _identifier(name: str) -> str:
    for part in name.split("."):
        if not _IDENTIFIER.match(part):
            raise ValueError(f"invalid identifier: {name!r}")
    return name


def field(name: str) -> Term:
    return Term("field", _identifier(name))


def phase_duration(phase_type: str) -> Term:
    """Hours of each phase of the given type."""
    return Term("phase_duration", arg=phase_type)


def growth_rate() -> Term:
    return Term("growth_rate")


def yield_coefficient() -> Term:
    return Term("yield_coefficient")


def golden_score(profile_id: str | None = None) -> Term:
    return Term("golden_score", arg=profile_id)


def agg(name: str, of: Term | str | None = None) -> Term:
    """``agg("count")`` counts rows; the others aggregate a field or domain function."""
    lower = name.lower()
    if lower in RESERVED or lower not in AGGREGATES:
        raise ValueError(f"unknown function: {name}")
    return Term("aggregate", lower, field(of) if isinstance(of, str) else of)


# --- builder --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Views:
    """The tables a query can touch; only the ones it uses are read."""

    batches: DataFrame
    phases: DataFrame | None = None
    metrics: DataFrame | None = None
    scores: DataFrame | None = None
    profiles: DataFrame | None = None

    def register(self, prefix: str = "") -> None:
        """Temporary views for Spark SQL text queries."""
        for name, df in (
            ("batches", with_aliases(self.batches)), ("phases", self.phases), ("batch_metrics", self.metrics),
            ("batch_scores", self.scores), ("golden_profiles", self.profiles),
        ):
            if df is not None:
                df.createOrReplaceTempView(f"{prefix}{name}")


class BatchQuery:
    def __init__(self, views: Views) -> None:
        self._views = views
        self._source: tuple[str, object] = ("batches", None)
        self._select: list[Term] = []
        self._where: Condition | None = None
        self._group: list[Term] = []
        self._order: tuple[str, bool] | None = None
        self._limit: int | None = None

    def batches(self, where: Condition | None = None) -> BatchQuery:
        self._source = ("batches", where)
        return self

    def batch(self, batch_id: str) -> BatchQuery:
        self._source = ("batches", field("batch_id") == batch_id)
        return self

    def golden_profile(self, profile_id: str) -> BatchQuery:
        self._source = ("profiles", field("profile_id") == profile_id)
        return self

    def select(self, *terms: Term | str) -> BatchQuery:
        self._select = [field(t) if isinstance(t, str) else t for t in terms]
        return self

    def where(self, condition: Condition) -> BatchQuery:
        self._where = condition if self._where is None else self._where & condition
        return self

    def group_by(self, *names: str) -> BatchQuery:
        self._group = [field(n) for n in names]
        return self

    def order_by(self, name: str, descending: bool = False) -> BatchQuery:
        self._order = (_identifier(name), descending)
        return self

    def limit(self, n: int) -> BatchQuery:
        if n < 0:
            raise ValueError("limit must not be negative")
        self._limit = n
        return self

    # -- composition

    def to_df(self) -> DataFrame:
        kind, filter_ = self._source
        base = self._views.batches if kind == "batches" else self._views.profiles
        if base is None:
            raise ValueError("golden profiles are not available")
        if kind == "batches":
            base = with_aliases(base)
        context = _Joined(base, self._views)
        terms = [*self._select, *self._group]
        for t in terms:
            context.need(t)
        for c in (filter_, self._where):
            context.need_in(c)
        df = context.df
        for c in (filter_, self._where):
            if c is not None:
                df = df.where(context.condition(c))
        outputs = [(context.column(t), t.alias or _label(t)) for t in self._select]
        aggregated = any(_has_aggregate(t) for t in self._select)
        names = [n for _, n in outputs]
        if self._group or aggregated:
            keys = [context.column(g).alias(f"_g{i}") for i, g in enumerate(self._group)]
            picks = []
            for t, (col, name) in zip(self._select, outputs, strict=True):
                if _has_aggregate(t):
                    picks.append(col.alias(name))
                elif t.kind == "field" and t.name in [g.name for g in self._group]:
                    picks.append(F.first(col).alias(name))
                else:
                    raise ValueError(f"{_label(t)} is neither grouped nor aggregated")
            df = df.groupBy(*keys).agg(*picks) if keys else df.agg(*picks)
            if self._order and self._order[0] not in names and self._order[0] in [g.name for g in self._group]:
                position = [g.name for g in self._group].index(self._order[0])
                df = self._sorted(df, F.col(f"_g{position}"))
            elif self._order:
                df = self._sorted(df, F.col(self._order[0]))
            df = df.select(*names)
        else:
            if self._order and self._order[0] not in names:
                df = self._sorted(df, context.column(field(self._order[0])))
                df = df.select(*[c.alias(n) for c, n in outputs])
            else:
                df = df.select(*[c.alias(n) for c, n in outputs])
                if self._order:
                    df = self._sorted(df, F.col(self._order[0]))
        return df if self._limit is None else df.limit(self._limit)

    def _sorted(self, df: DataFrame, column: Column) -> DataFrame:
        return df.orderBy(column.desc_nulls_last() if self._order[1] else column.asc_nulls_last())


def _label(t: Term) -> str:
    if t.kind == "field":
        return t.name.split(".")[-1]
    if t.kind == "aggregate":
        return t.name if t.arg is None else f"{t.name}_{_label(t.arg)}"
    return t.kind if t.kind != "phase_duration" else f"phase_duration_{t.arg}"


def _has_aggregate(t: Term) -> bool:
    return t.kind == "aggregate"


class _Joined:
    """The base table with one left join per helper table and argument that the query uses."""

    def __init__(self, base: DataFrame, views: Views) -> None:
        self.df, self.views, self._columns = base, views, {}
        self._base_columns = set(base.columns)

    def need_in(self, c: Condition | None) -> None:
        if c is None:
            return
        for side in (c.left, c.right):
            if isinstance(side, Condition):
                self.need_in(side)
            elif isinstance(side, Term):
                self.need(side)

    def need(self, t: Term) -> None:
        if t.kind == "aggregate":
            if t.arg is not None:
                self.need(t.arg)
            return
        if t.kind == "field":
            return
        key = (t.kind, t.arg)
        if key in self._columns:
            return
        name = f"_f{len(self._columns)}"
        helper = self._helper(t, name)
        self.df = self.df.join(helper, "batch_id", "left")
        self._columns[key] = name

    def _helper(self, t: Term, name: str) -> DataFrame:
        def table(df: DataFrame | None, what: str) -> DataFrame:
            if df is None:
                raise ValueError(f"{what} are not available")
            return df

        if t.kind == "phase_duration":
            chosen = table(self.views.phases, "phases").where(F.col("phase_type") == F.lit(t.arg))
            return chosen.select("batch_id", hours_between(F.col("start_ts"), F.col("end_ts")).alias(name))
        if t.kind == "growth_rate":
            chosen = table(self.views.metrics, "metrics").where(F.col("phase_type") == "exponential")
            return chosen.select("batch_id", F.col("mu").alias(name))
        if t.kind == "yield_coefficient":
            return table(self.views.metrics, "metrics").select("batch_id", F.col("yx_s").alias(name))
        if t.kind == "golden_score":
            scores = table(self.views.scores, "scores")
            if t.arg is not None:
                scores = scores.where(F.col("profile_id") == F.lit(t.arg))
            return scores.select("batch_id", F.col("score").alias(name))
        raise ValueError(f"unknown function: {t.kind}")

    def column(self, t: Term) -> Column:
        if t.kind == "field":
            name = t.name.split(".")[0]
            if name not in self._base_columns:
                raise ValueError(f"unknown field: {t.name}")
            return F.col(t.name)
        if t.kind == "aggregate":
            if t.arg is None:
                if t.name != "count":
                    raise ValueError(f"{t.name} needs an argument")
                return F.count(F.lit(1))
            return AGGREGATES[t.name](self.column(t.arg))
        return F.col(self._columns[(t.kind, t.arg)])

    def operand(self, value: object) -> Column:
        if isinstance(value, Term):
            if value.kind == "aggregate":
                raise ValueError("aggregates are not allowed in conditions")
            return self.column(value)
        if isinstance(value, bool) or not isinstance(value, (int, float, str, date)):
            raise ValueError(f"unsupported literal: {value!r}")
        return F.lit(value)

    def condition(self, c: Condition) -> Column:
        if c.op == "AND":
            return self.condition(c.left) & self.condition(c.right)
        if c.op == "OR":
            return self.condition(c.left) | self.condition(c.right)
        if c.op == "NOT":
            return ~self.condition(c.left)
        left, right = self.operand(c.left), self.operand(c.right)
        if c.op == "LIKE":
            return F.like(left, right)
        return {
            "=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right,
            ">=": left >= right,
        }[c.op]


def sql(spark, views: Views, text: str, args: Sequence[object] | None = None) -> DataFrame:
    """Spark SQL text over the registered views, with positional parameters."""
    views.register()
    return spark.sql(text, args=list(args or []))
