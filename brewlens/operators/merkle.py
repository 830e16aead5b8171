"""Merkle trees over audit entry hashes (RFC 6962): roots, all nodes, inclusion and consistency proofs.

A tree level halves the nodes. Instead of one shuffle per level, aligned runs of 2**10 nodes are hashed
up ten levels inside one row, so a tree of a trillion leaves takes four rounds and no group ever holds
more than 1024 hashes. A node without a right neighbour is promoted unchanged, which equals the RFC split
at the largest power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.plans.ordered import DENSE, ordinals

BITS = 10
#: rounds of ten levels; 4 cover trees of up to 2**40 leaves
ROUNDS = 4
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def leaf_hash(entry_hash: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), entry_hash.cast("binary")), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def leaves(entries: DataFrame, hash_column: str = "entry_hash", piece: int = DENSE) -> DataFrame:
    """(tenant_id, idx, size, hash): leaves numbered densely by ``seq`` inside each tenant."""
    numbered = ordinals(
        entries.select("tenant_id", "seq", hash_column), ["tenant_id"], ["seq", hash_column], F.col("seq"), piece
    )
    return numbered.select(
        "tenant_id", F.col("_i").alias("idx"), F.col("_n").alias("size"), leaf_hash(F.col(hash_column)).alias("hash")
    )


def _pair_up(nodes: str) -> str:
    """SQL for one level up: neighbours hashed together, a lone last node promoted."""
    return (
        f"transform(sequence(0, (size({nodes}) - 1) div 2), i -> CASE WHEN 2 * i + 1 < size({nodes}) "
        f"THEN unhex(sha2(concat(X'01', get({nodes}, 2 * i), get({nodes}, 2 * i + 1)), 256)) "
        f"ELSE get({nodes}, 2 * i) END)"
    )


def _gather(level: DataFrame) -> DataFrame:
    """Nodes grouped into aligned runs of 2**BITS, in order."""
    return level.groupBy("tenant_id", "size", F.shiftright("idx", BITS).alias("idx")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]).alias("nodes")
    )


def roots(tree_leaves: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """(tenant_id, size, root) with the root as lower-case hex; trees beyond the rounds' 2**40 leaves are an error.

    Those of ``tenants`` (tenant_id) without a leaf get the root of the empty tree.
    """
    level = tree_leaves
    for _ in range(ROUNDS):
        top = F.expr(f"get(aggregate(sequence(1, {BITS}), nodes, (acc, step) -> {_pair_up('acc')}), 0)")
        level = _gather(level).select("tenant_id", "size", "idx", top.alias("hash"))
    fits = F.when(F.col("size") > 1 << BITS * ROUNDS, F.raise_error(F.lit("tree has more than 2**40 leaves")))
    found = level.select("tenant_id", "size", F.coalesce(fits.cast("string"), F.lower(F.hex("hash"))).alias("root"))
    if tenants is None:
        return found
    bare = tenants.select("tenant_id").distinct().join(tree_leaves.select("tenant_id"), "tenant_id", "left_anti")
    return found.unionByName(bare.select("tenant_id", F.lit(0).cast("long").alias("size"), F.lit(EMPTY_ROOT).alias("root")))


def nodes(tree_leaves: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tenant_id, size, level, idx, hash): every node, with promoted nodes repeated on each level."""
    level = tree_leaves.select("tenant_id", "size", "idx", "hash")
    table = level.withColumn("level", F.lit(0))
    built = F.expr(
        f"aggregate(sequence(1, {BITS}), "
        "named_struct('cur', nodes, 'all', cast(array() AS array<array<binary>>)), "
        f"(acc, step) -> named_struct('cur', {_pair_up('acc.cur')}, 'all', concat(acc.all, array({_pair_up('acc.cur')}))))"
    )
    for r in range(rounds):
        grouped = _gather(level).select("tenant_id", "size", "idx", built.alias("b"))
        upper = grouped.select(
            "tenant_id", "size", F.col("idx").alias("block"), F.posexplode("b.all").alias("step", "hashes")
        ).select(
            "tenant_id", "size", "block", "step", F.posexplode("hashes").alias("k", "hash")
        )
        table = table.unionByName(upper.select(
            "tenant_id", "size", F.expr(f"shiftleft(block, {BITS - 1} - step) + k").cast("long").alias("idx"), "hash",
            (F.col("step") + 1 + r * BITS).cast("int").alias("level"),
        ))
        level = grouped.select("tenant_id", "size", "idx", F.get("b.cur", F.lit(0)).alias("hash"))
    return table.where(F.col("level") <= _height()).select("tenant_id", "size", "level", "idx", "hash")


def _height() -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return F.expr("CASE WHEN size <= 1 THEN 0 ELSE length(bin(size - 1)) END")


def inclusion_proofs(targets: DataFrame, node_table: DataFrame) -> DataFrame:
    """Proof rows (tenant_id, idx, level, side, hash) for each (tenant_id, size, idx) in ``targets``.

    The sibling on level l is node (idx >> l) xor 1; where it does not exist the node was promoted and
    contributes no step.
    """
    steps = targets.select("tenant_id", "size", "idx").withColumn("height", _height()).where("height > 0")
    steps = steps.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    at = F.expr("shiftright(idx, level)")
    wanted = steps.select(
        "tenant_id", "level", at.bitwiseXOR(F.lit(1)).alias("sibling"), F.col("idx").alias("leaf"),
        F.when(at.bitwiseAND(F.lit(1)) == 1, "L").otherwise("R").alias("side"),
    )
    keys = ["tenant_id", "level", "sibling"]
    table = node_table.select("tenant_id", "level", F.col("idx").alias("sibling"), "hash")
    # A node near the root is the sibling of a large part of all leaves: adaptive execution splits such keys.
    found = wanted.join(table, keys)
    return found.select("tenant_id", F.col("leaf").alias("idx"), "level", "side", "hash")


def verify_inclusion(leaf_table: DataFrame, proofs: DataFrame, root_table: DataFrame) -> DataFrame:
    """(tenant_id, idx, valid): fold each leaf with its proof (at most one step per level) to the root."""
    gathered = proofs.groupBy("tenant_id", "idx").agg(
        F.sort_array(F.collect_list(F.struct("level", "side", "hash"))).alias("steps")
    )
    joined = leaf_table.select("tenant_id", "idx", "hash").join(gathered, ["tenant_id", "idx"], "left")
    folded = F.aggregate(
        F.coalesce("steps", F.array().cast("array<struct<level:int,side:string,hash:binary>>")), F.col("hash"),
        lambda acc, s: F.when(s["side"] == "L", node_hash(s["hash"], acc)).otherwise(node_hash(acc, s["hash"])),
    )
    final = joined.withColumn("reached", F.lower(F.hex(folded)))
    return final.join(root_table.select("tenant_id", "root"), "tenant_id").select(
        "tenant_id", "idx", (F.col("reached") == F.col("root")).alias("valid")
    )


# --- consistency -------------------------------------------------------------------------------------------


def _span(lo: str, hi: str, side: str) -> str:
    """The tree node over the leaves from ``lo`` to ``hi`` as a proof step."""
    level = f"if({hi} - {lo} = 1, 0, length(bin({hi} - {lo} - 1)))"
    return f"named_struct('side', '{side}', 'level', {level}, 'idx', shiftright({lo}, {level}))"


def consistency_steps(old: str = "old_size", new: str = "new_size") -> Column:
    """Which nodes prove that the first ``old`` of ``new`` leaves are unchanged (RFC 6962, 2.1.2), in proof order.

    An array of (side, level, idx); side ``S`` is the seed. Only sizes are used. The open range is halved until it
    ends where the old tree ends, at most 63 times. Equal sizes need no step; a log that shrank has no proof.
    """
    middle = "(a.lo + shiftleft(1L, length(bin(a.hi - a.lo - 1)) - 1))"
    walked = f"""aggregate(sequence(1, 63),
        named_struct('lo', 0L, 'hi', cast({new} AS bigint), 'whole', true,
          'trail', cast(array() AS array<struct<side: string, level: int, idx: bigint>>)),
        (a, i) -> CASE WHEN a.hi = {old} THEN a
          WHEN {old} <= {middle} THEN named_struct('lo', a.lo, 'hi', {middle}, 'whole', a.whole,
            'trail', concat(array({_span(middle, 'a.hi', 'R')}), a.trail))
          ELSE named_struct('lo', {middle}, 'hi', a.hi, 'whole', false,
            'trail', concat(array({_span('a.lo', middle, 'L')}), a.trail)) END,
        a -> if(a.whole, a.trail, concat(array({_span('a.lo', 'a.hi', 'S')}), a.trail)))"""
    return F.expr(f"if(0 < {old} AND {old} < {new}, {walked}, array())")


def consistency_proofs(sizes: DataFrame, node_table: DataFrame) -> DataFrame:
    """Proof rows for each (tenant_id, old_size, new_size); ``node_table`` holds the tree of new_size."""
    wanted = sizes.select(
        "tenant_id", "old_size", "new_size", F.posexplode(consistency_steps()).alias("pos", "p")
    ).select("tenant_id", "old_size", "new_size", "pos", "p.*")
    return wanted.join(node_table.select("tenant_id", "level", "idx", "hash"), ["tenant_id", "level", "idx"]).select(
        "tenant_id", "old_size", "new_size", "pos", "side", "hash"
    )


def verify_consistency(proofs: DataFrame, roots_at: DataFrame) -> DataFrame:
    """(tenant_id, old_size, new_size, valid) from proof rows and the two roots only.

    ``roots_at`` has (tenant_id, old_size, new_size, old_root, new_root) with hex roots.
    """
    keys = ["tenant_id", "old_size", "new_size"]
    gathered = proofs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "side", "hash"))).alias("steps")
    )
    joined = roots_at.join(gathered, keys, "left").withColumn(
        "steps", F.coalesce("steps", F.array().cast("array<struct<pos:int,side:string,hash:binary>>"))
    )
    seeded = F.exists("steps", lambda s: s["side"] == "S")
    seed = F.when(seeded, F.get(F.col("steps"), F.lit(0))["hash"]).otherwise(F.unhex("old_root"))
    pair = F.struct(seed.alias("o"), seed.alias("n"))
    walk = F.aggregate(
        F.filter("steps", lambda s: s["side"] != "S"), pair,
        lambda acc, s: F.when(
            s["side"] == "L",
            F.struct(node_hash(s["hash"], acc["o"]).alias("o"), node_hash(s["hash"], acc["n"]).alias("n")),
        ).otherwise(F.struct(acc["o"].alias("o"), node_hash(acc["n"], s["hash"]).alias("n"))),
    )
    done = joined.withColumn("w", walk)
    same = (F.col("old_size") == F.col("new_size")) & (F.col("old_root") == F.col("new_root")) & (F.size("steps") == 0)
    grown = (F.col("old_size") < F.col("new_size")) & (F.size("steps") > 0) & (
        F.lower(F.hex("w.o")) == F.col("old_root")
    ) & (F.lower(F.hex("w.n")) == F.col("new_root"))
    return done.select(*keys, F.coalesce(same | grown, F.lit(False)).alias("valid"))


# --- checkpoints ---------------------------------------------------------------------------------------------


_PEAKS = "array<struct<level: int, hash: binary>>"


def _climb(base: int) -> str:
    """SQL: the full nodes of one aligned run, ``cur`` with its first index ``p``, climbed ``BITS`` levels.

    Each level first takes the stored peak on its left where the run begins with a right child, then hashes neighbours; a last
    node without a right neighbour is loose: a peak of the grown tree.
    """
    level = f"cast({base} + s div 2 AS int)"
    paired = "unhex(sha2(concat(X'01', get(a.cur, 2 * i), get(a.cur, 2 * i + 1)), 256))"
    return f"""aggregate(sequence(0, {2 * BITS - 1}),
      named_struct('cur', nodes, 'p', first, 'loose', cast(array() AS {_PEAKS})),
      (a, s) -> CASE
        WHEN size(a.cur) = 0 THEN a
        WHEN s % 2 = 0 AND a.p % 2 = 0 THEN a
        WHEN s % 2 = 0 THEN named_struct('cur', concat(filter(peaks, x -> x.level = {level}).hash, a.cur), 'p', a.p - 1, 'loose', a.loose)
        ELSE named_struct(
          'cur', if(size(a.cur) < 2, cast(array() AS array<binary>), transform(sequence(0, size(a.cur) div 2 - 1), i -> {paired})),
          'p', a.p div 2,
          'loose', if(size(a.cur) % 2 = 0, a.loose, concat(a.loose, array(named_struct('level', {level}, 'hash', element_at(a.cur, -1))))))
        END)"""


def frontiers(new_leaves: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(tenant_id, size, peaks): the roots of the full subtrees, at most one a level, after ``new_leaves``.

    ``before`` holds stored frontiers and ``new_leaves`` (tenant_id, idx, hash) the leaves behind them, numbered on; only
    these are hashed. A frontier is all that is needed to go on, to give the root and to check a grown log.
    """
    spark = new_leaves.sparkSession
    if before is None:
        before = spark.createDataFrame([], f"tenant_id string, size long, peaks {_PEAKS}")
    old = before.select("tenant_id", F.col("size").alias("old_size"), "peaks")
    nodes = new_leaves.select("tenant_id", "idx", "hash", F.lit(None).cast("int").alias("level"))
    for r in range(ROUNDS):
        # Peaks found so far (``level`` says where) pass by in groups of their own.
        run = F.when(F.col("level").isNull(), F.shiftright("idx", BITS)).otherwise(-1 - F.col("level"))
        runs = nodes.groupBy("tenant_id", run.alias("run"), "level").agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("held"))
        runs = runs.select("tenant_id", "run", "level", F.expr("held.hash AS nodes"), F.expr("held[0].idx AS first"))
        climbed = runs.join(old.select("tenant_id", "peaks"), "tenant_id", "left").withColumn(
            "peaks", F.coalesce("peaks", F.array().cast(_PEAKS))
        ).withColumn("b", F.when(F.col("level").isNull(), F.expr(_climb(r * BITS))))
        out = F.expr("""if(level IS NOT NULL, array(named_struct('idx', 0L, 'hash', nodes[0], 'level', level)), concat(
          transform(b.cur, h -> named_struct('idx', run, 'hash', h, 'level', cast(NULL AS int))),
          transform(b.loose, x -> named_struct('idx', 0L, 'hash', x.hash, 'level', x.level))))""")
        nodes = climbed.select("tenant_id", F.explode(out).alias("n")).select("tenant_id", "n.*")
    beyond = F.raise_error(F.lit("tree has more leaves than its rounds cover")).cast("int")
    loose = nodes.select("tenant_id", F.struct(F.coalesce("level", beyond).alias("level"), "hash").alias("peak"))
    grown = new_leaves.groupBy("tenant_id").agg((F.max("idx") + 1).alias("size")).join(old, "tenant_id", "full").select(
        "tenant_id", F.coalesce("size", "old_size").alias("size"), F.coalesce("old_size", F.lit(0)).alias("old_size"), "peaks"
    )
    stays = """filter(coalesce(peaks, array()), x -> shiftright(size, x.level) % 2 = 1
      AND shiftright(size, x.level + 1) = shiftright(old_size, x.level + 1))"""
    kept = grown.select("tenant_id", F.explode(F.expr(stays)).alias("peak"))
    peaks = kept.unionByName(loose).groupBy("tenant_id").agg(F.sort_array(F.collect_list("peak")).alias("peaks"))
    return grown.select("tenant_id", "size").join(peaks, "tenant_id", "left").select(
        "tenant_id", "size", F.coalesce("peaks", F.array().cast(_PEAKS)).alias("peaks")
    )


def frontier_roots(frontier: DataFrame) -> DataFrame:
    """(tenant_id, size, root) from frontiers alone; an empty tree has the hash of nothing for its root."""
    folded = F.expr("""aggregate(slice(peaks, 2, greatest(size(peaks) - 1, 0)), peaks[0].hash,
      (acc, x) -> unhex(sha2(concat(X'01', x.hash, acc), 256)))""")
    root = F.when(F.size("peaks") == 0, F.lit(EMPTY_ROOT)).otherwise(F.lower(F.hex(folded)))
    return frontier.select("tenant_id", "size", root.alias("root"))


def check_growth(before: DataFrame, new_leaves: DataFrame, claimed: DataFrame) -> DataFrame:
    """(tenant_id, size, matches): does the log that had the stored frontiers and got ``new_leaves`` have the claimed size
    and root? Only new leaves are hashed; :func:`check_against` hashes the old ones too."""
    found = frontier_roots(frontiers(new_leaves, before))
    said = claimed.select("tenant_id", F.col("size").alias("said_size"), F.col("root").alias("said_root"))
    same = (F.col("size") == F.col("said_size")) & (F.col("root") == F.col("said_root"))
    return said.join(found, "tenant_id", "left").select(
        "tenant_id", F.col("said_size").alias("size"), F.coalesce(same, F.lit(False)).alias("matches")
    )


def checkpoint_rows(tree_leaves: DataFrame) -> DataFrame:
    """(tenant_id, size, root): the state to store after a run."""
    return roots(tree_leaves)


def check_against(tree_leaves: DataFrame, stored: DataFrame) -> DataFrame:
    """Rebuild the tree of the stored size for each tenant and compare: (tenant_id, size, matches)."""
    saved = stored.select("tenant_id", F.col("size").alias("saved_size"), F.col("root").alias("saved_root"))
    prefix = tree_leaves.join(saved.select("tenant_id", "saved_size"), "tenant_id").where("idx < saved_size")
    rebuilt = roots(prefix.select("tenant_id", "idx", F.col("saved_size").alias("size"), "hash"))
    counts = prefix.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("present"))
    joined = saved.join(rebuilt.select("tenant_id", "root"), "tenant_id", "left").join(counts, "tenant_id", "left")
    ok = (F.col("root") == F.col("saved_root")) & (F.col("present") == F.col("saved_size"))
    return joined.select("tenant_id", F.col("saved_size").alias("size"), F.coalesce(ok, F.lit(False)).alias("matches"))
