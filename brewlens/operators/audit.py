"""Hash-chained audit trail: canonical text, entry hashes, appending and verifying chains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.plans.ordered import DENSE, carry
from brewlens.plans.skew import spread
from brewlens.schemas import AUDIT, AUDIT_ACTIONS

# The hashed fields in the order in which they are written.
HASHED_FIELDS = (
    "action", "entity_id", "entity_type", "entry_id", "new_value_hash", "old_value_hash",
    "previous_entry_hash", "reason", "timestamp", "user_id",
)
UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


_ESCAPED = r"""CASE
  WHEN c = '"' THEN r'\"' WHEN c = r'\' THEN r'\\'
  WHEN ascii(c) BETWEEN 32 AND 126 THEN c
  WHEN c = '\n' THEN r'\n' WHEN c = '\r' THEN r'\r' WHEN c = '\t' THEN r'\t'
  WHEN ascii(c) = 8 THEN r'\b' WHEN ascii(c) = 12 THEN r'\f'
  WHEN ascii(c) > 65535 THEN concat(
    r'\u', lower(hex(55296 + shiftright(ascii(c) - 65536, 10))), r'\u', lower(hex(56320 + ((ascii(c) - 65536) & 1023))))
  ELSE concat(r'\u', lower(lpad(hex(ascii(c)), 4, '0'))) END"""


def json_text(value: str) -> str:
    """SQL for a string as an ASCII-only JSON literal; plain text, the usual case, is only quoted."""
    text = f"coalesce({value}, '')"
    return (
        rf"""concat('"', CASE WHEN {text} RLIKE r'^[ !#-\[\]-~]*\z' THEN {text} """
        f"""ELSE array_join(transform(split({text}, ''), c -> {_ESCAPED}), '') END, '"')"""
    )


def iso_timestamp(ts: str) -> str:
    """SQL for ISO 8601 in UTC; the fraction is written only when it is not zero."""
    fraction = f"pmod(unix_micros({ts}), 1000000)"
    return (
        f"concat(date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN {fraction} = 0 THEN '' "
        f"ELSE concat('.', lpad(cast({fraction} AS string), 6, '0')) END, '+00:00')"
    )


def canonical_text(previous: str = "previous_entry_hash") -> Column:
    """Canonical JSON of an entry: fixed key order, no spaces, ASCII only, without the signature.

    ``previous`` is the SQL expression of the predecessor hash.
    """
    fields = {n: n for n in HASHED_FIELDS}
    fields["timestamp"] = iso_timestamp("`timestamp`")
    fields["previous_entry_hash"] = previous
    members = ", ',', ".join(f"""'"{n}":', {json_text(e)}""" for n, e in fields.items())
    return F.expr(f"concat('{{', {members}, '}}')")


def with_entry_hash(entries: DataFrame, name: str = "entry_hash") -> DataFrame:
    return entries.withColumn(name, F.sha2(canonical_text(), 256))


def last_hashes(entries: DataFrame) -> DataFrame:
    """Newest sequence number and entry hash per tenant, as recorded; nothing is hashed (``verify_chain`` does that)."""
    return entries.groupBy("tenant_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("last_hash")
    )


def append_entries(
    new: DataFrame, existing: DataFrame | None = None, signer: Callable[[bytes], bytes] | None = None,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Link new entries (ordered by ``seq`` inside a tenant) behind the stored chain.

    The chain is given by its ``heads`` (tenant_id, last_seq, last_hash) or as a whole. Each link hashes its
    predecessor's hash, so one tenant is one ordered stream: rows arrive from sorted partitions in Arrow batches and only
    the previous hash is kept. Tenants run in parallel. The canonical text around the hash is built by column
    expressions beforehand.
    """
    if heads is None and existing is not None:
        heads = last_hashes(existing)
    # Cut the text at the link field. Quotes inside user text are escaped, so the first occurrence of the
    # quoted field name with an empty value is the field itself.
    prepared = new.withColumn("_text", canonical_text("''")).withColumns({
        "_head": F.expr("""substring(_text, 1, locate('"previous_entry_hash":""', _text) + 22)"""),
        "_tail": F.expr("""substring(_text, locate('"previous_entry_hash":""', _text) + 23)"""),
    }).drop("_text")
    if heads is not None:
        prepared = prepared.join(heads.select("tenant_id", "last_seq", "last_hash"), "tenant_id", "left")
        prepared = prepared.withColumn("seq", F.col("seq") + F.coalesce(F.col("last_seq") + 1, F.lit(0)))
        prepared = prepared.withColumn("_seed", F.coalesce("last_hash", F.lit(""))).drop("last_seq", "last_hash")
    else:
        prepared = prepared.withColumn("_seed", F.lit(""))
    names = [f.name for f in AUDIT.fields]
    for name in ("previous_entry_hash", "record_hash", "public_key_pem"):
        prepared = prepared.withColumn(name, F.lit("") if name not in new.columns else F.col(name))
    if "signature" not in new.columns:
        prepared = prepared.withColumn("signature", F.lit(b""))
    ordered = spread(prepared.select(*names, "_head", "_tail", "_seed"), "tenant_id").sortWithinPartitions(
        "tenant_id", "seq"
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, previous = None, ""
        for rows in batches:
            links, hashes, signatures = [], [], []
            for t, head, tail, seed, signature in zip(
                rows["tenant_id"], rows["_head"], rows["_tail"], rows["_seed"], rows["signature"], strict=True
            ):
                if t != tenant:
                    tenant, previous = t, seed
                text_bytes = (head + previous + tail).encode()
                links.append(previous)
                previous = hashlib.sha256(text_bytes).hexdigest()
                hashes.append(previous)
                signatures.append(signer(text_bytes) if signer else signature)
            yield rows[names].assign(previous_entry_hash=links, record_hash=hashes, signature=signatures)

    return ordered.mapInPandas(link, AUDIT)


def verify_chain(entries: DataFrame, piece: int = DENSE) -> DataFrame:
    """Per entry: is its link the predecessor's recomputed hash, and does its stored hash fit its content?

    All hashes are recomputed in parallel; the predecessor comes from an ordered carry that also splits a
    tenant with very many entries.
    """
    hashed = with_entry_hash(entries).select(
        "tenant_id", "seq", "entry_id", "previous_entry_hash", "record_hash", "entry_hash"
    )
    linked = carry(
        hashed, ["tenant_id"], ["seq", "entry_id"], F.col("seq"),
        forward={"expected": (F.col("entry_hash"), False), "stored": (F.col("record_hash"), False)},
        piece=piece,
    )
    given = F.coalesce("previous_entry_hash", F.lit(""))
    return linked.select(
        "tenant_id", "seq", "entry_id",
        (given == F.coalesce("expected", F.lit(""))).alias("chain_ok"),
        (given == F.coalesce("stored", F.lit(""))).alias("stored_link_ok"),
        (F.col("record_hash") == F.col("entry_hash")).alias("content_ok"),
    )


def chain_verdict(entries: DataFrame, piece: int = DENSE) -> DataFrame:
    """One row per tenant: entries, broken links, and whether the chain is intact."""
    return verify_chain(entries, piece).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~F.col("chain_ok")).alias("broken_links"),
        F.count_if(~F.col("content_ok")).alias("changed_entries"),
        F.bool_and("chain_ok").alias("intact"),
    )


def list_entries(
    entries: DataFrame, action: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Newest entries first, one page."""
    if action is not None:
        if action not in AUDIT_ACTIONS:
            raise ValueError(f"unknown action: {action}")
        entries = entries.where(F.col("action") == action)
    return entries.orderBy(F.col("timestamp").desc(), F.col("entry_id").asc()).offset(offset).limit(limit)


# --- row checks --------------------------------------------------------------------------------------------


def missing_fields(entries: DataFrame, required: list[str] | tuple[str, ...]) -> DataFrame:
    """(tenant_id, seq, entry_id, field) for every required field that is empty and not exempt."""
    gaps = []
    for name in required:
        value = F.col(name)
        empty = value.isNull()
        kind = dict(entries.dtypes)[name]
        if kind == "string":
            empty = empty | (value == "")
        elif kind == "binary":
            empty = empty | (F.length(value) == 0)
        for action, allowed in K.EMPTY_ALLOWED.items():
            if name in allowed:
                empty = empty & (F.col("action") != action)
        gaps.append(F.when(empty, F.lit(name)))
    if not gaps:
        return entries.select("tenant_id", "seq", "entry_id", F.lit("").alias("field")).where(F.lit(False))
    return entries.select(
        "tenant_id", "seq", "entry_id", F.explode(F.array_compact(F.array(*gaps))).alias("field")
    )


def format_issues(entries: DataFrame) -> DataFrame:
    """(tenant_id, seq, entry_id, issue) for malformed ids, users, timestamps and actions."""
    issues = F.array_compact(F.array(
        F.when(F.col("entry_id").isNull() | ~F.col("entry_id").rlike(UUID_PATTERN), "invalid entry_id"),
        F.when(F.col("timestamp").isNull(), "timestamp missing"),
        F.when(F.col("user_id").isNull() | (F.col("user_id") == ""), "empty user_id"),
        F.when(F.col("action").isNull() | ~F.col("action").isin(*AUDIT_ACTIONS), "invalid action"),
    ))
    return entries.select("tenant_id", "seq", "entry_id", F.explode(issues).alias("issue"))


def signature_results(
    entries: DataFrame, verifier: Callable[[bytes, bytes, str], bool], public_key_pem: str | None = None
) -> DataFrame:
    """(tenant_id, seq, entry_id, valid, error) for signed rows, by a caller-supplied verifier.

    ``verifier(signature, message, pem)``; an external key replaces the one embedded in the row.
    """
    signed = entries.where(F.length("signature") > 0).select(
        "tenant_id", "seq", "entry_id", "signature", canonical_text().alias("message"),
        (F.lit(public_key_pem) if public_key_pem else F.col("public_key_pem")).alias("pem"),
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            valid, errors = [], []
            for signature, message, pem in zip(rows["signature"], rows["message"], rows["pem"], strict=True):
                if not pem:
                    valid.append(False)
                    errors.append("no public key")
                    continue
                try:
                    valid.append(bool(verifier(bytes(signature), message.encode(), pem)))
                    errors.append(None)
                except Exception as exc:
                    valid.append(False)
                    errors.append(str(exc))
            yield rows[["tenant_id", "seq", "entry_id"]].assign(valid=valid, error=errors)

    return signed.mapInPandas(check, "tenant_id string, seq long, entry_id string, valid boolean, error string")


def permission_table(spark) -> DataFrame:
    pairs = [(role, p) for role, granted in K.ROLE_PERMISSIONS.items() for p in granted]
    return spark.createDataFrame(pairs, "role string, permission string")


def role_violations(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Audit actions whose user is unknown, inactive, or lacks the permission the action needs."""
    spark = entries.sparkSession
    needs = F.create_map(*[F.lit(x) for pair in K.ACTION_PERMISSION.items() for x in pair])[F.col("action")]
    acted = entries.select("tenant_id", "seq", "entry_id", "user_id", "action", needs.alias("permission"))
    grants = users.where("active").join(F.broadcast(permission_table(spark)), "role").select("user_id", "permission")
    return acted.join(grants.distinct(), ["user_id", "permission"], "left_anti")


def tamper_free_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent fingerprint of a table: row count and the sum of row hashes.

    Row hashes are added, not concatenated, so nothing is gathered and any partitioning gives the same
    value. The sum is kept in two exact decimal halves of the 128-bit row hash.
    """
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    high = F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(h, 13, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(high).alias("hash_high"), F.sum(low).alias("hash_low")
    )
