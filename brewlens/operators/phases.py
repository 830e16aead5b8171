"""Growth-phase detection over all batches at once, phase labels, and phase joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.functions import kernels
from brewlens.functions.scalars import finite, hours_between, stable_id
from brewlens.operators.signals import KEYS, prepare
from brewlens.plans.ordered import PIECE, halo_blocks
from brewlens.plans.skew import spread

SEGMENTS = (
    "batch_id string, variable string, seg int, start_i long, end_i long, start_ts timestamp, "
    "end_ts timestamp, first_value double, last_value double"
)


@dataclass(frozen=True)
class DetectionConfig:
    signal: str = "OD600"
    kernel: str = "rbf"
    min_size: int = 10
    penalty: float | None = None
    smoothing_window: int = 5


@dataclass(frozen=True)
class OnlineConfig:
    signal: str = "OD600"
    hazard: float = 0.01
    mu0: float = 0.0
    kappa0: float = 1.0
    alpha0: float = 1.0
    beta0: float = 1.0
    threshold: float = 0.5
    max_run_length: int = 500

    def __post_init__(self) -> None:
        if not 0.0 < self.hazard < 1.0:
            raise ValueError("hazard must be in (0, 1)")

    def posterior(self) -> kernels.RunLengthPosterior:
        return kernels.RunLengthPosterior(
            self.hazard, self.mu0, self.kappa0, self.alpha0, self.beta0, self.threshold, self.max_run_length
        )


# --- offline segmentation ----------------------------------------------------------------------------------


_SEGMENT_COLUMNS = [
    "batch_id", "variable", "seg", "start_i", "end_i", "start_ts", "end_ts", "first_value", "last_value",
]
#: Rows of one block and rows it shows of each neighbour; a block is what one call of the quadratic kernel sees.
BLOCK, HALO = 4096, 1024
#: Ranks at which a signal's values are read: they give the kernel's width and the nodes on which its samples are summed.
RANKS = 256
#: What a block, or a cut, has to know of its signal; it comes as a row before the samples.
_HEAD = "nodes array<double>, gamma double, penalty double"
_PIECES = (
    "batch_id string, variable string, start_i long, n long, start_ts timestamp, last_ts timestamp, "
    "first_value double, last_value double, own double, weights array<double>, size long, " + _HEAD
)
_BORDERS = (
    "border long, first long, last long, w_start long, w_stop long, before array<double>, after array<double>, "
    "n_before long, n_after long, nodes array<double>, gamma double"
)
_CUTS = "batch_id string, variable string, border long, cut long, cut_ts timestamp, cut_value double, value_before double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _per_group(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str
) -> DataFrame:
    """``work`` on the columns of each group, one group held at a time; many small groups share an Arrow batch."""
    ordered = spread(df, *keys).sortWithinPartitions(*keys, *order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[dict[str, np.ndarray]] = []

        def close() -> list[tuple]:
            return work({c: np.concatenate([h[c] for h in held]) for c in held[0]}) if held else []

        for pdf in batches:
            if len(pdf) == 0:
                continue
            arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
            changed = np.zeros(len(pdf) - 1, dtype=bool)
            for k in keys:
                changed |= arrays[k][1:] != arrays[k][:-1]
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(pdf)]
            out: list[tuple] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                here = tuple(arrays[k][lo] for k in keys)
                if here != key:
                    out += close()
                    key, held = here, []
                held.append({c: a[lo:hi] for c, a in arrays.items()})
            yield pd.DataFrame(out, columns=_names(schema))
        yield pd.DataFrame(close(), columns=_names(schema))

    return ordered.mapInPandas(walk, schema)


def _signal_statistics(prepared: DataFrame, config: DetectionConfig) -> DataFrame:
    """(batch, variable, nodes, gamma, penalty, size) of every signal with a usable value, from all its rows."""
    ranks = [(k + 0.5) / RANKS for k in range(RANKS)]
    x = F.col("smoothed")
    stats = prepared.groupBy(*KEYS).agg(
        F.count(x).alias("m"), F.var_pop(x).alias("variance"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.percentile_approx(x, ranks, 10_000).alias("quantiles"), F.first("_n").alias("size"),
    ).where("m > 0")

    @F.pandas_udf("double")
    def gamma(quantiles: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([kernels.gamma_from_quantiles(q, int(n)) for q, n in zip(quantiles, m, strict=True)])

    floor = F.when(F.col("variance") < K.VARIANCE_FLOOR, 1.0).otherwise(F.col("variance"))
    penalty = F.ln("m") * floor if config.penalty is None else F.lit(float(config.penalty))
    nodes = F.array_sort(F.array_distinct(F.concat(F.array("lo"), "quantiles", F.array("hi"))))
    return stats.select(
        *KEYS, nodes.alias("nodes"), gamma("quantiles", "m").alias("gamma"), penalty.alias("penalty"), "size"
    )


def _pieces_of(g: dict[str, np.ndarray], config: DetectionConfig) -> list[tuple]:
    """One block cut at the breakpoints the exact kernel finds in it; rows of neighbours only help to find them."""
    if g["_i"][0] != -1:  # a signal without a usable value has no head
        return []
    nodes, gamma, penalty, size = np.asarray(g["nodes"][0]), float(g["gamma"][0]), float(g["penalty"][0]), int(g["_n"][0])
    batch, variable = g["batch_id"][0], g["variable"][0]
    g = {c: a[1:] for c, a in g.items()}
    x, i, value = g["smoothed"].astype(float), g["_i"], g["value"].astype(float)
    usable = ~np.isnan(x)
    at, mine = i[usable], i[g["_own"].astype(bool)]
    ends = (
        kernels.kernel_changepoints(x[usable], penalty, config.min_size, config.kernel, gamma) if len(at) else []
    )
    found = (int(at[e]) for e in ends if e < len(at))
    cuts = [int(mine[0]), *(c for c in found if mine[0] < c <= mine[-1]), int(mine[-1]) + 1]
    out = []
    for start, stop in zip(cuts, cuts[1:], strict=False):
        a, b = np.searchsorted(i, [start, stop])
        part = x[a:b][usable[a:b]]
        own = float((part * part).sum()) if config.kernel == "linear" else len(part) * kernels.SELF_SIMILARITY
        out.append((
            batch, variable, start, len(part), g["ts"][a], g["ts"][b - 1], value[a], value[b - 1], own,
            kernels.node_weights(part, nodes), size, nodes, gamma, penalty,
        ))
    return out


def _chosen_segments(g: dict[str, np.ndarray], config: DetectionConfig, block: int) -> list[tuple]:
    """The cheapest way to join the pieces of one signal to segments; and for each that begins at a block's border, where
    its first sample may come to lie instead (between the middles of the segments around it)."""
    nodes, gamma, penalty = np.asarray(g["nodes"][0]), float(g["gamma"][0]), float(g["penalty"][0])
    weights, n = np.stack(g["weights"]), g["n"]
    ends = kernels.piece_changepoints(
        n, g["own"], weights, penalty, config.min_size, kernels.similarity_of(nodes, nodes, gamma, config.kernel)
    )
    stops = np.append(g["start_i"], g["size"][0])
    until = [*g["start_ts"], g["last_ts"][-1]]
    starts = [0, *ends[:-1]]
    out = []
    for seg, (a, b) in enumerate(zip(starts, ends, strict=True)):
        border: tuple = (None,) * 11
        if seg and stops[a] % block == 0:
            p, half = starts[seg - 1], -(-config.min_size // 2)
            low = stops[p] + config.min_size if seg == 1 else (stops[p] + stops[a] + 1) // 2 + half
            high = stops[b] - config.min_size if b == len(n) else (stops[a] + stops[b]) // 2 - half
            border = (
                stops[a], max(low, stops[a - 1]), min(high, stops[a + 1]), stops[a - 1], stops[a + 1],
                weights[p : a - 1].sum(axis=0), weights[a + 1 : b].sum(axis=0), n[p : a - 1].sum(), n[a + 1 : b].sum(), nodes, gamma,
            )
        out.append((
            g["batch_id"][0], g["variable"][0], seg, stops[a], stops[b], g["start_ts"][a], until[b],
            g["first_value"][a], g["last_value"][b - 1], *border,
        ))
    return out


def _refined(g: dict[str, np.ndarray], config: DetectionConfig) -> list[tuple]:
    """The exact place of one cut that lies at a block's border."""
    head = {c: a[0] for c, a in g.items()}
    i, value, x = g["_i"][1:], g["value"][1:].astype(float), g["smoothed"][1:].astype(float)
    usable = np.flatnonzero(~np.isnan(x))
    at = np.append(i[usable], head["w_stop"])  # the row at which a segment would begin
    first, last = np.searchsorted(at, head["first"]), np.searchsorted(at, head["last"], side="right") - 1
    cut = int(head["border"])
    if first <= last and len(usable):
        best = kernels.refined_cut(
            x[usable], np.asarray(head["before"]), np.asarray(head["after"]), int(head["n_before"]), int(head["n_after"]),
            np.asarray(head["nodes"]), float(head["gamma"]), config.kernel, int(first), int(last),
        )
        cut = int(at[best])
    row = int(np.searchsorted(i, cut))
    if not 0 < row < len(i):
        return []
    return [(head["batch_id"], head["variable"], head["border"], cut, g["ts"][1:][row], value[row], value[row - 1])]


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Samples with the rows of ``heads`` before them (as sample -1); what either side lacks is null."""
    return rows.unionByName(heads.withColumn("_i", F.lit(-1).cast("long")), allowMissingColumns=True)


def _segment_signals(prepared: DataFrame, config: DetectionConfig, block: int, halo: int) -> DataFrame:
    """Segments of every signal; every sample counts, and no task holds more than two blocks of samples.

    A signal is cut into blocks that see ``halo`` rows of their neighbours. The exact kernel runs on each
    block under the penalty and width of the whole signal and proposes breakpoints; what lies between two of
    them (or a block's border) becomes a piece with its values laid on nodes: the signal's own quantiles, so that
    outliers do not move them. A last programme joins pieces to segments: the cost of joined pieces follows from
    their sums on the nodes. It sees pieces only, a few per block. A cut it leaves at a block's border, as for a change
    too weak to be seen in one block, is then placed by the exact kernel over the pieces on its two sides. The form is
    the same for short and long signals; on up to ``RANKS`` samples it is exact. Otherwise it approximates:
    a breakpoint that no block proposes is looked for next to borders only, and not found if a cut at the border itself
    does not pay its penalty; similarities over more than a block are interpolated between nodes.
    """
    stats = _signal_statistics(prepared, config)
    rows = prepared.select(*KEYS, "ts", "value", "smoothed", "_i", "_n")
    blocks = halo_blocks(rows, "_i", block, halo).where((F.col("_block") * block) < F.col("_n"))
    heads = stats.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}"))))
    heads = heads.withColumn("_own", F.lit(False)).withColumnRenamed("size", "_n")
    pieces = _per_group(
        _with_heads(blocks, heads), [*KEYS, "_block"], ["_i"], lambda g: _pieces_of(g, config), _PIECES
    )
    chosen = _per_group(
        pieces, KEYS, ["start_i"], lambda g: _chosen_segments(g, config, block), f"{SEGMENTS}, {_BORDERS}"
    )
    segments, names = chosen.select(*_SEGMENT_COLUMNS), [c for c in _names(_BORDERS)]
    borders = chosen.where("border is not null").select(*KEYS, *names)
    beside = rows.withColumn("border", F.explode(F.expr(f"array(_i div {block} * {block}, (_i div {block} + 1) * {block})")))
    window = borders.select(*KEYS, "border", "w_start", "w_stop")
    near = beside.join(window, [*KEYS, "border"]).where("_i >= w_start AND _i < w_stop").drop("w_start", "w_stop", "_n")
    cuts = _per_group(
        _with_heads(near, borders), [*KEYS, "border"], ["_i"], lambda g: _refined(g, config), _CUTS
    )
    opened = cuts.withColumnsRenamed({"border": "start_i", "cut": "cut_i"}).drop("value_before")
    closed = cuts.select(
        *KEYS, F.col("border").alias("end_i"), F.col("cut").alias("stop_i"), F.col("cut_ts").alias("stop_ts"), "value_before"
    )
    moved = segments.join(opened, [*KEYS, "start_i"], "left").join(closed, [*KEYS, "end_i"], "left")
    return moved.select(
        *KEYS, "seg", F.coalesce("cut_i", "start_i").alias("start_i"), F.coalesce("stop_i", "end_i").alias("end_i"),
        F.coalesce("cut_ts", "start_ts").alias("start_ts"), F.coalesce("stop_ts", "end_ts").alias("end_ts"),
        F.when(F.col("cut_i").isNull(), F.col("first_value")).otherwise(F.col("cut_value")).alias("first_value"),
        F.when(F.col("stop_i").isNull(), F.col("last_value")).otherwise(F.col("value_before")).alias("last_value"),
    )


def offline_segments(
    telemetry: DataFrame, config: DetectionConfig = DetectionConfig(), piece: int = PIECE,
    block: int = BLOCK, halo: int = HALO,
) -> DataFrame:
    """Segments of the configured signal of every batch (kernel changepoints on the prepared signal)."""
    chosen = telemetry.where(F.col("variable") == config.signal)
    return _segment_signals(prepare(chosen, window=config.smoothing_window, piece=piece), config, block, halo)


# --- online segmentation of stored signals -------------------------------------------------------------------


def online_segments(telemetry: DataFrame, config: OnlineConfig = OnlineConfig()) -> DataFrame:
    """Segments between the changepoints an online detector reports, for every batch.

    The posterior after each value depends on all earlier values, so one signal is one ordered stream. It
    is read in Arrow batches from sorted partitions with constant memory (the posterior has at most
    ``max_run_length`` entries); a signal is never held as a whole.
    """
    chosen = telemetry.where(F.col("variable") == config.signal).select(*KEYS, "ts", "value")
    ordered = spread(chosen, *KEYS).sortWithinPartitions(*KEYS, "ts", "value")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        posterior = config.posterior()
        key: tuple[str, str] | None = None
        seg = start = i = 0
        start_ts = last_ts = None
        start_value = last_value = float("nan")
        any_finite = False

        def closed() -> tuple:
            return (*key, seg, start, i, start_ts, last_ts, start_value, last_value)

        for pdf in batches:
            out: list[tuple] = []
            names = zip(pdf["batch_id"], pdf["variable"], strict=True)
            for here, ts, value in zip(names, pdf["ts"], pdf["value"].to_numpy(float), strict=True):
                if here != key:
                    if key is not None and any_finite:
                        out.append(closed())
                    key, seg, start, i, any_finite = here, 0, 0, 0, False
                    start_ts, start_value = ts, value
                    posterior.reset()
                found, _ = posterior.update(value)
                any_finite = any_finite or np.isfinite(value)
                if found and i > 0:
                    out.append(closed())
                    seg, start, start_ts, start_value = seg + 1, i, ts, value
                i += 1
                last_ts, last_value = ts, value
            yield pd.DataFrame(out, columns=_SEGMENT_COLUMNS)
        if key is not None and any_finite:
            yield pd.DataFrame([closed()], columns=_SEGMENT_COLUMNS)

    return ordered.mapInPandas(walk, SEGMENTS)


# --- labels ----------------------------------------------------------------------------------------------------


def _growth_rate() -> Column:
    length = F.col("end_i") - F.col("start_i")
    return F.when(length <= 1, F.lit(0.0)).otherwise(finite((F.col("last_value") - F.col("first_value")) / length))


def label_segments(segments: DataFrame) -> DataFrame:
    """Add ``growth_rate`` (per sample) and ``phase_type``.

    The peak segment is the first with the largest positive rate. After it, falling segments are decline
    and near-flat ones stationary; before it, near-flat ones are lag; the rest is unknown.
    """
    # Windows over segments, not samples: a signal's segments come from the one task that found them.
    whole = Window.partitionBy(*KEYS)
    rated = segments.withColumn("growth_rate", _growth_rate())
    joined = rated.withColumns({
        "_top": F.max("growth_rate").over(whole),
        "_top_seg": F.min_by(
            "seg", F.when(F.col("growth_rate").isNotNull(), F.struct(-F.col("growth_rate"), F.col("seg")))
        ).over(whole),
        "_largest": F.max(F.abs("growth_rate")).over(whole),
    })
    rate, has_peak = F.col("growth_rate"), F.col("_top") > 0
    flat = F.abs(rate) < F.lit(K.RATE_TOLERANCE) * F.col("_largest")
    after, before = has_peak & (F.col("seg") > F.col("_top_seg")), has_peak & (F.col("seg") < F.col("_top_seg"))
    label = (
        F.when(has_peak & (F.col("seg") == F.col("_top_seg")), "exponential")
        .when(after & (rate < 0), "decline")
        .when(before & flat, "lag")
        .when(after & flat, "stationary")
        .otherwise("unknown")
    )
    return joined.withColumn("phase_type", label).drop("_top", "_top_seg", "_largest")


def annotations(segments: DataFrame, method: str) -> DataFrame:
    """Labelled segments as phase annotations."""
    labelled = label_segments(segments)
    rate = F.col("growth_rate").cast("string")
    details = F.create_map(F.lit("growth_rate"), rate)
    if method == "bocpd":
        details = F.create_map(F.lit("growth_rate"), rate, F.lit("detection_method"), F.lit(method))
    return labelled.select(
        stable_id(F.col("batch_id"), F.col("variable"), F.lit(method), F.col("seg")).alias("annotation_id"),
        "batch_id", "phase_type", "start_ts", "end_ts", F.col("variable").alias("signal_variable"),
        F.lit(1.0).alias("confidence"), details.alias("metadata"),
    )


def detect_phases(
    telemetry: DataFrame,
    config: DetectionConfig | OnlineConfig = DetectionConfig(),
    piece: int = PIECE,
) -> DataFrame:
    """Phase annotations of every batch in ``telemetry``; the config type picks the method."""
    if isinstance(config, OnlineConfig):
        return annotations(online_segments(telemetry, config), "bocpd")
    return annotations(offline_segments(telemetry, config, piece), "pelt")


# --- phase joins ------------------------------------------------------------------------------------------------


#: Phases shorter than 2**20 microseconds (a second) lie on the grid of that width.
_FINEST = 20


def in_phases(telemetry: DataFrame, phases: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Telemetry rows with every phase whose closed interval holds them.

    A sample on a shared boundary belongs to both neighbours. Each phase lies on a grid of cells as wide as the power of
    two above its length, of which it touches two at most; a reading looks up its one cell on each grid that its batch
    has. So readings meet only phases that are near them (a fourth of these hold on average), however many phases the
    batch has, and the rows of one batch spread over its cells.
    """
    start, end = F.unix_micros("start_ts"), F.unix_micros("end_ts")
    grid = F.greatest(F.length(F.bin(F.greatest(end - start, F.lit(1)))), F.lit(_FINEST))
    bands = phases.select("batch_id", "phase_type", "start_ts", "end_ts", *extra, grid.alias("_grid"))
    grids = bands.groupBy("batch_id").agg(F.collect_set("_grid").alias("_grids"))  # 44 at most
    cells = bands.withColumn("_cell", F.explode(F.expr(
        "sequence(shiftright(unix_micros(start_ts), _grid), shiftright(unix_micros(end_ts), _grid))")))
    placed = telemetry.join(grids, "batch_id").withColumn("_grid", F.explode("_grids")).drop("_grids")
    placed = placed.withColumn("_cell", F.expr("shiftright(unix_micros(ts), _grid)"))
    return placed.join(cells, ["batch_id", "_grid", "_cell"]).where(
        (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))
    ).drop("_grid", "_cell")


def phase_statistics(telemetry: DataFrame, phases: DataFrame) -> DataFrame:
    """Count, mean and extremes per (batch, phase type, variable)."""
    value = finite(F.col("value"))
    return in_phases(telemetry, phases).groupBy("batch_id", "phase_type", "variable").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def phase_durations(phases: DataFrame) -> DataFrame:
    return phases.withColumn("hours", hours_between(F.col("start_ts"), F.col("end_ts")))


def phase_bands(phases: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Phase intervals for drawing; with anchors, as hours from each batch's anchor."""
    bands = phases.select("batch_id", "phase_type", "start_ts", "end_ts", "confidence")
    if anchors is None:
        return bands
    joined = bands.join(anchors, "batch_id")
    return joined.select(
        "batch_id", "phase_type", "confidence",
        hours_between(F.col("anchor_ts"), F.col("start_ts")).alias("start_hours"),
        hours_between(F.col("anchor_ts"), F.col("end_ts")).alias("end_hours"),
    )
