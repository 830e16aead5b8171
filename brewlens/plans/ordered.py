"""Ordered work inside a key without putting a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The functions here cut each key into pieces
of fixed width in position and carry values from piece to piece, in one plan for keys of every size:

1. a row's position says in which piece it lies, and windows run inside (key, piece);
2. one summary row per piece (combined before its shuffle) holds its count and border values; running over them gives
   each piece what lies before and after it, joined back by (key, piece), by which the rows are partitioned already.

Nothing runs while a plan is built, nothing is counted beforehand, sampled or dropped, and the result does not depend on
where the cuts fall. A key has as many summary rows as its range has pieces: for a run of a year and pieces of a day, 366.
Rows without a key stay in one piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a piece: a day of microseconds; and for positions that are numbers in a row.
PIECE, DENSE = 86_400_000_000, 65_536


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    pos: Column,
    *,
    forward: Mapping[str, tuple[Column, bool]] | None = None,
    backward: Mapping[str, tuple[Column, bool]] | None = None,
    running: Mapping[str, Column] | None = None,
    index: bool = False,
    piece: int = PIECE,
) -> DataFrame:
    """Add running values and positions inside each key.

    ``forward[name] = (value, inclusive)`` is the last non-null ``value`` before (or at) the row,
    ``backward[name]`` the first one after (or at) it, ``running[name]`` the sum of a whole number up to and with the row.
    ``index`` adds ``_i`` (0-based position) and ``_n`` (rows of the key). ``pos`` is a long that grows with the first
    element of ``order``; ``piece`` is the width of a piece in it.
    """
    forward, backward, running, keys = dict(forward or {}), dict(backward or {}), dict(running or {}), list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = [*keys, "_piece"]
    lost = reduce(or_, [F.col(k).isNull() for k in keys])
    # A row without a position comes before all others, as nulls do in ``order``.
    at = F.when(lost, F.lit(0)).otherwise(F.coalesce(F.floor(pos / F.lit(piece)), F.lit(-(1 << 62)))).cast("long")
    cut = df.withColumn("_piece", at)

    local = Window.partitionBy(*parts).orderBy(*order)
    # Looking ahead is looking back from the other end: a frame that runs to the last row is computed anew for each row.
    from_end = Window.partitionBy(*parts).orderBy(*[o.desc_nulls_last() for o in order])
    added: dict[str, Column] = {}
    for name, (value, inclusive) in forward.items():
        added[name] = F.last(value, True).over(local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for name, (value, inclusive) in backward.items():
        added[name] = F.last(value, True).over(from_end.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for name, value in running.items():
        added[name] = F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, 0))
    if index:
        added |= {"_i": (F.row_number().over(local) - 1).cast("long"), "_n": F.count(F.lit(1)).over(Window.partitionBy(*parts))}
    rows = cut.withColumns(added)

    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    borders = [F.count(F.lit(1)).alias("_count")]
    borders += [F.max_by(v, F.when(v.isNotNull(), rank)).alias(f"_s_{n}") for n, (v, _) in forward.items()]
    borders += [F.min_by(v, F.when(v.isNotNull(), rank)).alias(f"_s_{n}") for n, (v, _) in backward.items()]
    borders += [F.sum(v).alias(f"_s_{n}") for n, v in running.items()]
    summary = cut.where(~lost).groupBy(*parts).agg(*borders)
    before, after = (
        Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_piece", F.desc("_piece"))
    )
    around = [F.sum("_count").over(before).alias("_c__i"), F.sum("_count").over(Window.partitionBy(*keys)).alias("_c__n")]
    around = around if index else []
    around += [F.last(f"_s_{n}", True).over(before).alias(f"_c_{n}") for n in forward]
    around += [F.last(f"_s_{n}", True).over(after).alias(f"_c_{n}") for n in backward]
    around += [F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in running]

    result = rows.join(summary.select(*parts, *around), parts, "left")
    merged: dict[str, Column] = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in [*forward, *backward]}
    sums = {n: f"_c_{n}" for n in running} | ({"_i": "_c__i"} if index else {})
    merged |= {n: F.col(n) + F.coalesce(F.col(c), F.lit(0)) for n, c in sums.items()}
    if index:
        merged["_n"] = F.coalesce("_c__n", "_n")
    names = [*df.columns, *forward, *backward, *running, *(["_i", "_n"] if index else [])]
    return result.withColumns(merged).select(*names)


def ordinals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pos: Column, piece: int = PIECE
) -> DataFrame:
    """Add ``_i`` (0-based position in the key) and ``_n`` (rows of the key)."""
    return carry(df, keys, order, pos, index=True, piece=piece)


def halo_blocks(df: DataFrame, index: str, size: int, halo: int) -> DataFrame:
    """Cut numbered rows into blocks of ``size`` and repeat ``halo`` rows around each block.

    Adds ``_block`` and ``_own`` (true for the one copy that belongs to the block), so that any moving
    window reaching at most ``halo`` rows can run per (key, block) and keep only ``_own`` rows.
    """
    if halo >= size:
        raise ValueError("halo must be smaller than the block")
    home = F.floor(F.col(index) / size)
    first, last = F.floor((F.col(index) - halo) / size), F.floor((F.col(index) + halo) / size)
    return (
        df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        .withColumn("_own", F.col("_block") == home)
    )
