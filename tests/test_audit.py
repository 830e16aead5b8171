import hashlib
import json
from datetime import UTC, timedelta

import pytest
from pyspark.sql import functions as F

from brewlens.operators import audit, compliance, lineage, merkle
from brewlens.plans.ordered import DENSE
from brewlens.session import cut_lineage
from brewlens.schemas import AUDIT, USERS
from tests.conftest import START

NEW = ("tenant_id string, seq long, entry_id string, timestamp timestamp, user_id string, action string, entity_type string, "
       "entity_id string, old_value_hash string, new_value_hash string, reason string")
REASONS = ["plain", 'quote " back\\slash', "tab\tnewline\nbell\x07 del\x7f", "umlaut ü €", "emoji 😀", ""]


def entries(spark, tenants=2, n=6, first=0):
    rows = []
    for t in range(tenants):
        for i in range(first, first + n):
            rows.append((f"t{t}", i - first, f"00000000-0000-7000-8000-{t:04d}{i:08d}",
                         START + timedelta(seconds=i, microseconds=(i % 2) * 250), "alice", "update" if i else "create",
                         "batch", f"b{i}", "old" if i else "", f"new{i}", REASONS[i % len(REASONS)]))
    return spark.createDataFrame(rows, NEW)


def python_hash(r):
    data = {k: r[k] or "" for k in audit.HASHED_FIELDS if k != "timestamp"}
    data["timestamp"] = r["timestamp"].replace(tzinfo=UTC).isoformat()
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_entry_hash_equals_sorted_compact_json(spark):
    rows = audit.with_entry_hash(entries(spark).withColumn("previous_entry_hash", F.lit("ab"))).collect()
    assert all(r["entry_hash"] == python_hash(r) for r in rows)


def test_chain_is_appended_continued_and_verified(spark):
    chain = audit.append_entries(entries(spark)).cache()
    previous = {}
    for r in sorted(chain.collect(), key=lambda r: (r["tenant_id"], r["seq"])):
        assert r["previous_entry_hash"] == previous.get(r["tenant_id"], "")
        assert r["record_hash"] == python_hash(r)
        previous[r["tenant_id"]] = r["record_hash"]
    longer = chain.unionByName(audit.append_entries(entries(spark, n=3, first=6), chain)).cache()
    assert longer.agg(F.max("seq")).first()[0] == 8
    for piece in (DENSE, 3):
        verdict = audit.chain_verdict(longer, piece).collect()
        assert all(v["intact"] and v["entries"] == 9 and v["changed_entries"] == 0 for v in verdict)
    tampered = longer.withColumn("new_value_hash", F.when(
        (F.col("tenant_id") == "t1") & (F.col("seq") == 4), "evil").otherwise(F.col("new_value_hash")))
    for piece in (DENSE, 3):
        rows = {(r["tenant_id"], r["seq"]): r for r in audit.verify_chain(tampered, piece).collect()}
        assert [k for k, r in rows.items() if not r["chain_ok"]] == [("t1", 5)]
        assert [k for k, r in rows.items() if not r["content_ok"]] == [("t1", 4)]
        assert all(r["stored_link_ok"] for r in rows.values())
    removed = longer.where("not (tenant_id = 't0' and seq = 2)")
    assert audit.chain_verdict(removed).where("not intact").count() == 1
    assert audit.list_entries(longer, "create").count() == 2
    with pytest.raises(ValueError):
        audit.list_entries(longer, "nothing")


def test_signatures(spark):
    sign = lambda text: hashlib.sha256(b"k" + text).digest()
    chain = audit.append_entries(entries(spark, 1).withColumn("public_key_pem", F.lit("k")), signer=sign).cache()

    def verifier(signature, message, pem):
        return signature == hashlib.sha256(pem.encode() + message).digest()

    assert audit.signature_results(chain, verifier).where("not valid").isEmpty()
    bad = chain.withColumn("reason", F.when(F.col("seq") == 2, "x").otherwise(F.col("reason")))
    assert [r["seq"] for r in audit.signature_results(bad, verifier).where("not valid").collect()] == [2]
    assert audit.signature_results(chain.withColumn("public_key_pem", F.lit("")), verifier).where("error = 'no public key'").count() == 6
    statuses = [compliance.signature_check(f, v).first()["status"] for f, v in (
        (chain, verifier), (bad, verifier), (chain, None), (chain.withColumn("signature", F.lit(b"")), verifier),
        (chain.withColumn("signature", F.lit(b"")), None))]
    assert statuses == ["pass", "fail", "error", "not_applicable", "not_applicable"]


def rfc_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + rfc_root(leaves[:k]) + rfc_root(leaves[k:])).digest()


@pytest.fixture(scope="module")
def trees(spark):
    """One tree per size 1..50 and one of 1500 leaves (more than one block of ten levels)."""
    sizes = [*range(1, 51), 1500]
    rows = [(str(n), i, hashlib.sha256(f"{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    tree = merkle.leaves(spark.createDataFrame(rows, "tenant_id string, seq long, entry_hash string")).cache()
    return sizes, tree, merkle.nodes(tree).cache()


def leaf(i):
    return hashlib.sha256(b"\x00" + hashlib.sha256(f"{i}".encode()).hexdigest().encode()).digest()


def test_roots_follow_the_rfc(trees):
    sizes, tree, _ = trees
    got = {int(r["tenant_id"]): r["root"] for r in merkle.roots(tree).collect()}
    assert got == {n: rfc_root([leaf(i) for i in range(n)]).hex() for n in sizes}


def test_inclusion_proofs_verify_and_tampering_shows(trees):
    sizes, tree, nodes = trees
    proofs = merkle.inclusion_proofs(tree, nodes).cache()
    roots = merkle.roots(tree)
    assert merkle.verify_inclusion(tree, proofs, roots).where("not valid").isEmpty()
    longest = proofs.where("tenant_id = '1500'").groupBy("idx").count().agg(F.max("count")).first()[0]
    assert longest == 11
    forged = tree.withColumn("hash", F.when(
        (F.col("tenant_id") == "17") & (F.col("idx") == 16), F.lit(b"x" * 32)).otherwise(F.col("hash")))
    bad = merkle.verify_inclusion(forged, proofs, roots).where("not valid").collect()
    assert [(r["tenant_id"], r["idx"]) for r in bad] == [("17", 16)]


def test_consistency_proofs(spark, trees):
    sizes, tree, nodes = trees
    roots = {int(r["tenant_id"]): r["root"] for r in merkle.roots(tree).collect()}
    pairs = [(str(n), m, n, roots[m], roots[n]) for n in range(1, 51) for m in range(1, n + 1)]
    pairs += [("1500", m, 1500, roots[m], roots[1500]) for m in range(1, 51)]
    at = spark.createDataFrame(pairs, "tenant_id string, old_size long, new_size long, old_root string, new_root string").cache()
    proofs = merkle.consistency_proofs(at.select("tenant_id", "old_size", "new_size"), nodes).cache()
    assert merkle.verify_consistency(proofs, at).where("not valid").isEmpty()
    changed = proofs.withColumn("hash", F.when(F.col("pos") == 0, F.lit(b"y" * 32)).otherwise(F.col("hash")))
    assert merkle.verify_consistency(changed, at).where("valid and old_size < new_size").isEmpty()
    other = at.withColumn("old_root", F.lit(roots[50])).where("old_size < new_size and old_size < 50")
    assert merkle.verify_consistency(proofs, other).where("valid").isEmpty()
    sizes = spark.createDataFrame([(10, 20), (5, 4), (0, 4), (7, 7), (3, 1 << 50)], "old_size long, new_size long")
    steps = {r[0]: r[1] for r in sizes.select("old_size", merkle.consistency_steps()).collect()}
    assert steps[10] and all(s["level"] > 0 for s in steps[10])
    assert steps[5] == steps[0] == steps[7] == [] and len(steps[3]) == 51


def test_stored_checkpoints(trees):
    sizes, tree, _ = trees
    saved = merkle.checkpoint_rows(tree).where("size between 5 and 8")
    assert merkle.check_against(tree, saved).where("matches").count() == 4
    short = tree.where("not (tenant_id = '6' and idx = 5)")
    assert [r["tenant_id"] for r in merkle.check_against(short, saved).where("not matches").collect()] == ["6"]


def test_report(spark):
    users = spark.createDataFrame([("alice", "Alice", "admin", True)], USERS)
    chain = audit.append_entries(entries(spark, 1, 4).withColumn("reason", F.lit("why"))).cache()
    rows = {r["item_id"]: r["status"] for r in compliance.report(chain, users).collect()}
    assert len(rows) == 13 and rows["CFR11-10f"] == "pass" and rows["CFR11-10k"] == "pass" and rows["CFR11-50"] == "not_applicable"
    assert compliance.overall(compliance.report(chain, users)).first()["overall"] == "pass"
    none = compliance.report(chain, users.limit(0), "21_CFR_Part_11")
    assert compliance.overall(none).first()["overall"] == "warning" and none.count() == 9
    empty = compliance.report(spark.createDataFrame([], AUDIT), users, "EU_Annex_11").collect()
    assert {r["status"] for r in empty} == {"not_applicable"} and len(empty) == 4
    broken = chain.withColumn("user_id", F.when(F.col("seq") == 1, "").otherwise(F.col("user_id")))
    status = {r["item_id"]: r["status"] for r in compliance.report(broken, users).collect()}
    assert status["CFR11-10e"] == "fail" and status["CFR11-10f"] == "fail" and status["CFR11-10k"] == "fail"
    saved = merkle.checkpoint_rows(merkle.leaves(audit.with_entry_hash(chain)))
    with_tree = {r["item_id"]: r["status"] for r in compliance.report(chain, users, checkpoints=saved).collect()}
    assert with_tree["MERKLE"] == "pass"
    with pytest.raises(ValueError):
        compliance.report(chain, users, "unknown")


def test_roles_and_fields(spark):
    users = spark.createDataFrame([("alice", "A", "editor", True), ("bob", "B", "admin", False)], USERS)
    rows = entries(spark, 1, 4).withColumns({
        "user_id": F.when(F.col("seq") == 3, "bob").otherwise(F.col("user_id")),
        "action": F.when(F.col("seq") == 2, "delete").otherwise(F.col("action")),
        "new_value_hash": F.when(F.col("seq") == 2, "").otherwise(F.col("new_value_hash"))})
    assert {(r["seq"], r["permission"]) for r in audit.role_violations(rows, users).collect()} == {(2, "delete"), (3, "write")}
    assert audit.missing_fields(rows, ["old_value_hash", "new_value_hash"]).isEmpty()
    assert audit.missing_fields(rows, []).isEmpty()
    a = audit.tamper_free_fingerprint(rows, ["seq", "user_id"]).first()
    assert a == audit.tamper_free_fingerprint(rows.orderBy(F.desc("seq")).repartition(3), ["seq", "user_id"]).first()
    assert a != audit.tamper_free_fingerprint(rows.where("seq > 0"), ["seq", "user_id"]).first()


def test_lineage_handles_cycles_diamonds_and_other_batches(spark):
    rows = [("a", "b1", []), ("b", "b1", ["a"]), ("c", "b1", ["a"]), ("d", "b1", ["b", "c"]), ("e", "b2", ["d"]),
            ("x", "b3", ["y"]), ("y", "b3", ["x"])]
    ops = spark.createDataFrame(rows, "operation_id string, batch_id string, parent_ids array<string>")
    down = {(r["root_id"], r["operation_id"]): r["depth"] for r in lineage.descendants(ops).collect()}
    assert down == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("b", "d"): 1, ("c", "d"): 1, ("x", "y"): 1, ("y", "x"): 1}
    across = lineage.ancestors(ops, ops.where("operation_id = 'e'").select("operation_id"), across_batches=True)
    assert {(r["operation_id"], r["depth"]) for r in across.collect()} == {("d", 1), ("b", 2), ("c", 2), ("a", 3)}


def test_shortened_log_is_invalid(spark):
    sizes = spark.createDataFrame(
        [("a", 5, 3, "00", "00"), ("b", 0, 3, "00", "00")],
        "tenant_id string, old_size long, new_size long, old_root string, new_root string",
    )
    none = spark.createDataFrame([], "tenant_id string, size long, level int, idx long, hash binary")
    proofs = merkle.consistency_proofs(sizes.select("tenant_id", "old_size", "new_size"), none)
    assert [r["valid"] for r in merkle.verify_consistency(proofs, sizes).collect()] == [False, False]


def plain_root(hashes):
    if not hashes:
        return hashlib.sha256(b"").digest()
    if len(hashes) == 1:
        return hashes[0]
    k = 1 << (len(hashes) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + plain_root(hashes[:k]) + plain_root(hashes[k:])).digest()


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_frontiers_grow_like_whole_trees(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "ROUNDS", 7 if bits == 1 else 4)
    leaf = [hashlib.sha256(bytes([i])).digest() for i in range(40)]
    sizes = [(0, 1), (1, 1), (2, 3), (3, 8), (5, 0), (7, 1), (8, 8), (13, 20), (16, 0), (20, 20), (31, 2)]
    rows = [(f"{a}-{b}", i, leaf[i]) for a, b in sizes for i in range(a + b)]
    leaves = spark.createDataFrame(rows, "tenant_id string, idx long, hash binary")
    cut = F.split("tenant_id", "-")[0].cast("long")
    first = cut_lineage(merkle.frontiers(leaves.where(F.col("idx") < cut)))
    grown = cut_lineage(merkle.frontiers(leaves.where(F.col("idx") >= cut), first))
    got = {r["tenant_id"]: (r["size"], r["root"]) for r in merkle.frontier_roots(grown).collect()}
    assert got == {f"{a}-{b}": (a + b, plain_root(leaf[: a + b]).hex()) for a, b in sizes}
    peaks = {r["tenant_id"]: [p["level"] for p in r["peaks"]] for r in grown.collect()}
    assert all(sum(1 << p for p in found) == sum(map(int, t.split("-"))) for t, found in peaks.items())
    claimed = merkle.frontier_roots(grown).withColumn("root", F.when(F.col("tenant_id") == "3-8", "0").otherwise(F.col("root")))
    checked = merkle.check_growth(first, leaves.where(F.col("idx") >= cut), claimed).collect()
    assert {r["tenant_id"] for r in checked if not r["matches"]} == {"3-8"} and len(checked) == len(sizes)


def test_empty_tree_has_a_root(spark):
    leaves = spark.createDataFrame([("a", 0, 1, b"x" * 32)], "tenant_id string, idx long, size long, hash binary")
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    got = {r["tenant_id"]: (r["size"], r["root"]) for r in merkle.roots(leaves, tenants).collect()}
    assert got["b"] == (0, hashlib.sha256(b"").hexdigest()) and got["a"][0] == 1
    bare = merkle.frontier_roots(spark.createDataFrame([("b", 0, [])], f"tenant_id string, size long, peaks {merkle._PEAKS}"))
    assert bare.first()["root"] == hashlib.sha256(b"").hexdigest()


def test_lineage_rounds_grow_with_the_logarithm(spark):
    n = 200
    ops = spark.createDataFrame([(f"o{i}", "b", [f"o{i - 1}"] if i else []) for i in range(n)],
                                "operation_id string, batch_id string, parent_ids array<string>")
    start = spark.createDataFrame([("o0",)], "operation_id string")
    spark.sparkContext.setJobGroup("lineage", "lineage")
    got = lineage.descendants(ops, start)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lineage"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r["operation_id"], r["depth"]) for r in got.collect()} == {(f"o{i}", i) for i in range(1, n)}
    assert jobs < 60  # nine rounds; a level a round would take two hundred
