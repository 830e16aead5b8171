"""Regulatory checklist report over an audit trail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.operators import audit, merkle
from brewlens.plans.ordered import DENSE


def checklist(spark, regulation: str | None = None) -> DataFrame:
    """Checklist items; ``None`` gives both regulations together."""
    if regulation is not None and regulation not in K.REGULATIONS:
        raise ValueError(f"unknown regulation: {regulation}")
    items = [i for i in K.CHECKLIST if regulation in (None, i[1])]
    rows = [(n, *i[:5], list(i[5])) for n, i in enumerate(items)]
    return spark.createDataFrame(
        rows, "item_no int, item_id string, regulation string, section string, requirement string, "
        "verification_type string, required_fields array<string>"
    )


def _check(counts: DataFrame, name: str, bad: str, good_text: Column, bad_text: Column) -> DataFrame:
    """One row (check, status, evidence) from a one-row frame with ``total`` and a count of bad rows."""
    status = F.when(F.col("total") == 0, "not_applicable").when(F.col(bad) > 0, "fail").otherwise("pass")
    evidence = F.when(F.col("total") == 0, "No audit entries").when(F.col(bad) > 0, bad_text).otherwise(good_text)
    return counts.select(F.lit(name).alias("check"), status.alias("status"), evidence.alias("evidence"))


def chain_check(entries: DataFrame, piece: int = DENSE) -> DataFrame:
    counts = audit.verify_chain(entries, piece).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("chain_ok")).alias("bad")
    )
    return _check(
        counts, "hash_chain", "bad",
        F.concat(F.lit("Hash chain intact across "), F.col("total").cast("string"), F.lit(" entries")),
        F.concat(F.lit("Hash chain broken at "), F.col("bad").cast("string"), F.lit(" entries")),
    )


def fields_check(entries: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Field completeness as one pass that counts empty required fields."""
    gaps = audit.missing_fields(entries, required).agg(F.count(F.lit(1)).alias("bad"))
    counts = entries.agg(F.count(F.lit(1)).alias("total")).withColumn("bad", gaps.scalar())
    return _check(
        counts, "field_completeness:" + ",".join(required), "bad",
        F.concat(F.lit(f"All {len(required)} required fields present in "), F.col("total").cast("string"),
                 F.lit(" entries")),
        F.concat(F.lit("Missing fields in "), F.col("bad").cast("string"), F.lit(" cases")),
    )


def format_check(entries: DataFrame) -> DataFrame:
    issues = audit.format_issues(entries).agg(F.count(F.lit(1)).alias("bad"))
    counts = entries.agg(F.count(F.lit(1)).alias("total")).withColumn("bad", issues.scalar())
    return _check(
        counts, "audit_entry_format", "bad",
        F.concat(F.lit("All "), F.col("total").cast("string"), F.lit(" entries are well formed")),
        F.concat(F.lit("Format issues in "), F.col("bad").cast("string"), F.lit(" cases")),
    )


def signature_check(
    entries: DataFrame, verifier: Callable[[bytes, bytes, str], bool] | None, public_key_pem: str | None = None
) -> DataFrame:
    """Signature check; without a verifier signed rows cannot be confirmed, which is an error."""
    if verifier is None:
        counts = entries.agg(F.count_if(F.length("signature") > 0).alias("signed"))
        status = F.when(F.col("signed") == 0, "not_applicable").otherwise("error")
        text = F.when(F.col("signed") == 0, "No signed entries found").otherwise(
            F.concat(F.col("signed").cast("string"), F.lit(" signed entries and no verifier"))
        )
        return counts.select(F.lit("signature").alias("check"), status.alias("status"), text.alias("evidence"))
    counts = audit.signature_results(entries, verifier, public_key_pem).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("valid")).alias("bad")
    )
    checked = _check(
        counts, "signature", "bad",
        F.concat(F.lit("All "), F.col("total").cast("string"), F.lit(" signatures verified")),
        F.concat(F.lit("Invalid signature on "), F.col("bad").cast("string"), F.lit(" entries")),
    )
    none_signed = F.col("status") == "not_applicable"
    return checked.withColumn(
        "evidence", F.when(none_signed, "No signed entries found").otherwise(F.col("evidence"))
    )


def access_check(users: DataFrame) -> DataFrame:
    counts = users.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "admin").alias("admins"),
        F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("roles"),
    )
    status = F.when((F.col("n") == 0) | (F.col("admins") == 0), "warning").otherwise("pass")
    text = (
        F.when(F.col("n") == 0, "No users found; roles are not configured")
        .when(F.col("admins") == 0, F.concat(F.lit("No admin user found; roles present: "), F.col("roles")))
        .otherwise(F.concat(F.lit("Roles configured for "), F.col("n").cast("string"), F.lit(" users: "),
                            F.col("roles")))
    )
    return counts.select(F.lit("access_control").alias("check"), status.alias("status"), text.alias("evidence"))


def merkle_check(entries: DataFrame, stored: DataFrame, piece: int = DENSE) -> DataFrame:
    """Stored tree checkpoints against the trees rebuilt from the entries."""
    tree = merkle.leaves(audit.with_entry_hash(entries), piece=piece)
    counts = merkle.check_against(tree, stored).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("matches")).alias("bad")
    )
    return _check(
        counts, "merkle", "bad",
        F.concat(F.col("total").cast("string"), F.lit(" tree checkpoints match")),
        F.concat(F.col("bad").cast("string"), F.lit(" tree checkpoints do not match")),
    )


def report(
    entries: DataFrame,
    users: DataFrame,
    regulation: str | None = None,
    verifier: Callable[[bytes, bytes, str], bool] | None = None,
    public_key_pem: str | None = None,
    checkpoints: DataFrame | None = None,
    piece: int = DENSE,
) -> DataFrame:
    """(item_id, regulation, section, requirement, status, evidence) per checklist item.

    Each kind of check runs once; with stored checkpoints an extra ``MERKLE`` row is added.
    """
    spark = entries.sparkSession
    items = [i for i in K.CHECKLIST if regulation in (None, i[1])]
    checks = [chain_check(entries, piece), format_check(entries), access_check(users)]
    checks.append(signature_check(entries, verifier, public_key_pem))
    checks += [fields_check(entries, f) for f in sorted({i[5] for i in items if i[4] == "field_completeness"})]
    results = checks[0]
    for more in checks[1:]:
        results = results.unionByName(more)
    key = F.when(
        F.col("verification_type") == "field_completeness",
        F.concat(F.lit("field_completeness:"), F.array_join("required_fields", ",")),
    ).otherwise(F.col("verification_type"))
    listed = checklist(spark, regulation).withColumn("check", key).join(results, "check", "left").select(
        "item_no", "item_id", "regulation", "section", "requirement",
        F.coalesce("status", F.lit("error")).alias("status"), "evidence",
    )
    if checkpoints is not None:
        extra = merkle_check(entries, checkpoints, piece).select(
            F.lit(len(items)).alias("item_no"), F.lit("MERKLE").alias("item_id"),
            F.lit(regulation or "+".join(K.REGULATIONS)).alias("regulation"), F.lit("").alias("section"),
            F.lit("Stored tree checkpoints").alias("requirement"), "status", "evidence",
        )
        listed = listed.unionByName(extra)
    return listed


def overall(report_rows: DataFrame) -> DataFrame:
    """One row: counts per status and the overall status (fail over warning over pass)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "warning", "error", "not_applicable")]
    agg = report_rows.agg(F.count(F.lit(1)).alias("items"), *counts)
    status = F.when((F.col("fail") > 0) | (F.col("error") > 0), "fail").when(F.col("warning") > 0, "warning").otherwise(
        "pass"
    )
    return agg.withColumn("overall", status)
