"""Queries over the benchmark tables, one per operator, and SQL that must give the same rows."""

from brewlens.workload import checks, round_trips  # the latter registers its queries
from brewlens.workload.detection_checks import detection_sql
from brewlens.workload.round_trip_checks import round_trip_sql
from brewlens.workload.runs import queries


def oracle_sql() -> dict[str, str]:
    return checks.oracle_sql() | round_trip_sql() | detection_sql()


__all__ = ["oracle_sql", "queries", "round_trips"]
