"""Small numeric kernels called inside grouped or streamed Spark tasks.

Each works on one bounded group (or one observation) and knows nothing about Spark.
"""

from __future__ import annotations

import math
import re
from collections import deque

import numpy as np

# ---------------------------------------------------------------------------------------------------
# Offline changepoints: optimal partitioning with pruning (Killick et al. 2012) under a Gaussian
# kernel cost (Celisse et al. 2018).
# ---------------------------------------------------------------------------------------------------


def median_squared_distance(x: np.ndarray) -> float:
    """Exact median of all pairwise squared differences, without building the pairs.

    The k-th smallest difference is found by bisection on the sorted signal, counting pairs with one
    ``searchsorted`` per step.
    """
    s = np.sort(x)
    n = len(s)
    pairs = n * (n - 1) // 2
    if pairs == 0:
        return 0.0
    if n <= 256:
        i, j = np.triu_indices(n, 1)
        return float(np.median((s[j] - s[i]) ** 2))
    rows = np.arange(n)

    def count(d: float) -> int:
        return int((np.searchsorted(s, s + d, side="right") - rows - 1).sum())

    def kth(k: int) -> float:
        low, high = 0.0, float(s[-1] - s[0])
        if count(0.0) >= k:
            return 0.0
        for _ in range(200):
            mid = 0.5 * (low + high)
            if mid in (low, high):
                break
            if count(mid) >= k:
                high = mid
            else:
                low = mid
        return high

    if pairs % 2:
        return kth(pairs // 2 + 1) ** 2
    return 0.5 * (kth(pairs // 2) ** 2 + kth(pairs // 2 + 1) ** 2)


#: Similarity of a value to itself: squared distances below 0.01 count as 0.01.
SELF_SIMILARITY = math.exp(-1e-2)


def gamma_from_quantiles(quantiles, n: int) -> float:
    """1 / median squared difference of ``n`` values known by equally spaced quantiles.

    All ordered pairs of quantiles are compared; a value's pair with itself makes up 1/n of them and is left out.
    """
    q = np.asarray(quantiles, dtype=float)
    d = np.sort(np.abs(q[:, None] - q[None, :]).ravel())
    median = float(d[min(int(len(d) * (0.5 + 0.5 / n)), len(d) - 1)]) ** 2
    return 1.0 / median if median > 0 else 1.0


def node_weights(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Each value shared between its two neighbours among the ascending ``nodes``, summed up."""
    if len(nodes) == 1:
        return np.array([float(len(x))])
    left = np.clip(np.searchsorted(nodes, x, side="right") - 1, 0, len(nodes) - 2)
    share = np.clip((x - nodes[left]) / (nodes[left + 1] - nodes[left]), 0.0, 1.0)
    return np.bincount(left, 1.0 - share, len(nodes)) + np.bincount(left + 1, share, len(nodes))


def similarity_of(a: np.ndarray, b: np.ndarray, gamma: float, kernel: str) -> np.ndarray:
    """Similarity of each value of ``a`` to each of ``b``."""
    if kernel == "linear":
        return np.outer(a, b)
    return np.exp(-np.clip(gamma * (a[:, None] - b[None, :]) ** 2, 1e-2, 1e2))


def refined_cut(
    x: np.ndarray, before: np.ndarray, after: np.ndarray, n_before: int, n_after: int, nodes: np.ndarray, gamma: float,
    kernel: str, first: int, last: int, rows: int = 512,
) -> int:
    """Where in the window ``x`` to cut so that the two segments around it cost least: a position from ``first`` to ``last``.

    Samples of the window meet each other exactly; those of the segments outside it are known by their sums on the nodes.
    """
    inside_left, inside_right = np.empty(len(x)), np.empty(len(x))  # similarity to earlier and to later samples
    for low in range(0, len(x), rows):
        met = similarity_of(x[low : low + rows], x, gamma, kernel)
        upto = np.arange(low, low + len(met))
        sums = np.concatenate((np.zeros((len(met), 1)), np.cumsum(met, axis=1)), axis=1)
        inside_left[upto] = sums[np.arange(len(met)), upto]
        inside_right[upto] = sums[:, -1] - sums[np.arange(len(met)), upto + 1]
    to_nodes = similarity_of(nodes, nodes, gamma, kernel)
    own = x * x if kernel == "linear" else np.full(len(x), SELF_SIMILARITY)
    left_of = own + 2.0 * (inside_left + np.interp(x, nodes, to_nodes @ before))
    right_of = own + 2.0 * (inside_right + np.interp(x, nodes, to_nodes @ after))
    left = before @ to_nodes @ before + np.concatenate(([0.0], np.cumsum(left_of)))
    right = after @ to_nodes @ after + np.concatenate((np.cumsum(right_of[::-1])[::-1], [0.0]))
    at = np.arange(first, last + 1)
    gain = left[at] / np.maximum(n_before + at, 1) + right[at] / np.maximum(n_after + len(x) - at, 1)
    return int(at[np.argmax(gain)])


def piece_changepoints(
    n: np.ndarray, own: np.ndarray, weights: np.ndarray, penalty: float, min_size: int, similarity: np.ndarray
) -> list[int]:
    """Ends (exclusive, in pieces) of the joined pieces that minimise kernel cost + penalty per segment.

    ``n`` values per piece, their self-similarities ``own`` and ``weights`` on nodes. With running sums T of the weights
    the similarity sum of pieces a..b is (T_b - T_a)' K (T_b - T_a).
    """
    if len(n) == 1 or n.sum() < 2 * min_size:
        return [len(n)]
    size = np.concatenate(([0], np.cumsum(n)))
    diag = np.concatenate(([0.0], np.cumsum(own)))
    sums = np.concatenate((np.zeros((1, len(similarity))), np.cumsum(weights, axis=0)))
    met = sums @ similarity
    square = (sums * met).sum(axis=1)
    best = np.full(len(n) + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(len(n) + 1, dtype=np.int64)
    for end in range(1, len(n) + 1):
        starts = np.flatnonzero((size[end] - size[:end] >= min_size) & np.isfinite(best[:end]))
        if end == len(n) and not len(starts):
            starts = np.array([0])
        if not len(starts):
            continue
        gram = square[end] + square[starts] - 2.0 * (sums[starts] @ met[end])
        cost = best[starts] + diag[end] - diag[starts] - gram / np.maximum(size[end] - size[starts], 1)
        k = int(np.argmin(cost))
        best[end], back[end] = cost[k] + penalty, starts[k]
    ends: list[int] = []
    at = len(n)
    while at > 0:
        ends.append(at)
        at = int(back[at])
    return ends[::-1]


def kernel_changepoints(
    x: np.ndarray, penalty: float, min_size: int = 10, kernel: str = "rbf", gamma: float | None = None
) -> list[int]:
    """End positions (exclusive) of the segments that minimise kernel cost + penalty per segment.

    Quadratic in the signal's length at worst and linear in memory: the similarity sums of all open
    segments are updated as each point arrives. Leading starts that can no longer win are dropped.
    """
    x = np.asarray(x, dtype=float)
    n = len(x)
    if n < 2 * min_size:
        return [n]
    if kernel == "rbf":
        if gamma is None:
            med = median_squared_distance(x)
            gamma = 1.0 / med if med > 0 else 1.0

        def similarity(block: np.ndarray, point: float) -> np.ndarray:
            d = block - point
            np.multiply(d, d, out=d)
            d *= -gamma
            np.maximum(d, -1e2, out=d)
            np.minimum(d, -1e-2, out=d)
            return np.exp(d, out=d)

        own = np.full(n, SELF_SIMILARITY)
    elif kernel == "linear":

        def similarity(block: np.ndarray, point: float) -> np.ndarray:
            return block * point

        own = x * x
    else:
        raise ValueError(f"unknown kernel: {kernel}")

    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, dtype=np.int64)
    gram = np.zeros(n)                                # similarity sum of the open segment of each start
    diag = np.concatenate(([0.0], np.cumsum(own)))    # self-similarity up to each position
    position = np.arange(n + 1, dtype=float)
    lo = 0                                            # first start still in play
    pending: deque[tuple[int, int]] = deque()         # (end from which it holds, new first start)
    for end in range(1, n + 1):
        while pending and pending[0][0] <= end:
            lo = max(lo, pending.popleft()[1])
        col = similarity(x[lo:end], x[end - 1])
        tail = np.cumsum(col[::-1])[::-1]
        tail *= 2.0
        tail -= own[end - 1]
        gram[lo:end] += tail
        upto = end - min_size + 1
        if upto <= lo:
            continue
        total = gram[lo:upto] / (position[lo:upto] - end)
        total += best[lo:upto]
        total += diag[end] - diag[lo:upto]
        k = int(np.argmin(total))
        best[end] = total[k] + penalty
        back[end] = lo + k
        # A start whose cost already reaches best[end] cannot win once a segment may begin at ``end``.
        drop = 0
        while drop < k and total[drop] >= best[end]:
            drop += 1
        if drop:
            pending.append((end + min_size, lo + drop))
    ends: list[int] = []
    at = n
    while at > 0:
        ends.append(at)
        at = int(back[at])
    return ends[::-1]


# ---------------------------------------------------------------------------------------------------
# Online changepoints (Adams & MacKay 2007), Normal-Inverse-Gamma model, constant hazard.
# ---------------------------------------------------------------------------------------------------


class RunLengthPosterior:
    """Run-length posterior of one scalar stream; memory is bounded by ``max_run_length``."""

    def __init__(
        self,
        hazard: float = 0.01,
        mu0: float = 0.0,
        kappa0: float = 1.0,
        alpha0: float = 1.0,
        beta0: float = 1.0,
        threshold: float = 0.5,
        max_run_length: int = 500,
    ) -> None:
        if not 0.0 < hazard < 1.0:
            raise ValueError("hazard must be in (0, 1)")
        self.hazard, self.threshold, self.limit = hazard, threshold, max_run_length
        self.mu0, self.beta0 = mu0, beta0
        # kappa and alpha depend on the run length alone, so they and the Student-t constants are tables.
        r = np.arange(max_run_length + 2, dtype=float)
        self._kappa = kappa0 + r
        self._alpha = alpha0 + 0.5 * r
        df = 2.0 * self._alpha
        self._half = 0.5 * (df + 1.0)
        self._const = np.array(
            [math.lgamma((v + 1.0) / 2.0) - math.lgamma(v / 2.0) - 0.5 * math.log(v * math.pi) for v in df]
        )
        self.reset()

    def reset(self) -> None:
        self.t = 0
        self.probs = np.array([1.0])
        self.mu = np.array([self.mu0])
        self.beta = np.array([self.beta0])

    def update(self, x: float) -> tuple[bool, float]:
        """Take one value; returns (changepoint?, mass on the ten shortest run lengths)."""
        if not math.isfinite(x):
            return False, 0.0
        m = len(self.probs)
        kappa, alpha = self._kappa[:m], self._alpha[:m]
        df = 2.0 * alpha
        scale2 = self.beta * (kappa + 1.0) / (alpha * kappa)
        dev = x - self.mu
        log_pdf = self._const[:m] - 0.5 * np.log(scale2) - self._half[:m] * np.log1p(dev * dev / (df * scale2))
        weight = self.probs * np.maximum(np.exp(log_pdf), 1e-300)
        probs = np.empty(m + 1)
        probs[0] = weight.sum() * self.hazard
        probs[1:] = weight * (1.0 - self.hazard)
        evidence = probs.sum()
        if not evidence > 0:
            t = self.t + 1
            self.reset()
            self.t = t
            return False, 1.0
        probs /= evidence
        beta = self.beta + 0.5 * kappa * dev * dev / (kappa + 1.0)
        mu = (kappa * self.mu + x) / (kappa + 1.0)
        self.mu = np.concatenate(([self.mu0], mu))
        self.beta = np.concatenate(([self.beta0], beta))
        keep = self.limit + 1
        if len(probs) > keep:
            overflow = probs[keep:].sum()
            probs = probs[:keep].copy()
            probs[0] += overflow
            probs /= probs.sum()
            self.mu, self.beta = self.mu[:keep], self.beta[:keep]
        self.probs = probs
        self.t += 1
        short = float(probs[:10].sum())
        return bool(self.t > 10 and int(np.argmax(probs)) < 5 and short > self.threshold), short

    def state(self) -> tuple[int, list[float], list[float], list[float]]:
        return self.t, self.probs.tolist(), self.mu.tolist(), self.beta.tolist()

    def restore(self, t: int, probs: list[float], mu: list[float], beta: list[float]) -> None:
        self.t = int(t)
        self.probs, self.mu, self.beta = np.array(probs, float), np.array(mu, float), np.array(beta, float)


# ---------------------------------------------------------------------------------------------------
# Multivariate dynamic time warping: FastDTW (Salvador & Chan 2007).
# ---------------------------------------------------------------------------------------------------


def _dtw_in_window(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, want_path: bool):
    """DTW restricted to columns ``lo[i]..hi[i]`` of each row; rows are processed as vectors.

    Inside a row, D[j] = c[j] + min(up, diagonal, D[j-1]); with prefix sums C of the costs this is
    C[j] + running minimum of (entry[k] - C[k-1]), one ``minimum.accumulate``.
    """
    n = len(a)
    moves: list[np.ndarray] = []
    prev = np.empty(0)
    prev_lo = prev_hi = 0
    for i in range(n):
        l, h = int(lo[i]), int(hi[i])
        diff = b[l:h + 1] - a[i]
        cost = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        width = h - l + 1
        up = np.full(width, np.inf)
        diagonal = np.full(width, np.inf)
        if i == 0:
            diagonal[0] = 0.0
        else:
            s, e = max(l, prev_lo), min(h, prev_hi)
            if s <= e:
                up[s - l:e - l + 1] = prev[s - prev_lo:e - prev_lo + 1]
            s, e = max(l, prev_lo + 1), min(h, prev_hi + 1)
            if s <= e:
                diagonal[s - l:e - l + 1] = prev[s - 1 - prev_lo:e - prev_lo]
        entry = np.minimum(up, diagonal)
        total = np.cumsum(cost)
        row = total + np.minimum.accumulate(entry - total + cost)
        if want_path:
            left = np.concatenate(([np.inf], row[:-1]))
            move = np.where(up <= np.minimum(left, diagonal), 0, np.where(left <= diagonal, 1, 2))
            moves.append(move.astype(np.int8))
        prev, prev_lo, prev_hi = row, l, h
    distance = float(prev[-1])
    if not want_path:
        return distance, None
    path = []
    i, j = n - 1, int(hi[n - 1])
    while True:
        path.append((i, j))
        if i == 0 and j == int(lo[0]):
            break
        move = moves[i][j - int(lo[i])]
        if move == 0:
            i -= 1
        elif move == 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return distance, path[::-1]


def _halve(series: np.ndarray) -> np.ndarray:
    even = len(series) // 2 * 2
    return 0.5 * (series[0:even:2] + series[1:even:2])


def _window_around(path, n: int, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fine row, the column range covered by the coarse path widened by ``radius`` coarse cells."""
    coarse_rows = max(i for i, _ in path) + 1
    low = np.full(coarse_rows, np.iinfo(np.int64).max)
    high = np.full(coarse_rows, -1)
    for i, j in path:
        low[i] = min(low[i], j)
        high[i] = max(high[i], j)
    # low and high never decrease along a warping path, so the widest neighbours are the outer ones.
    rows = np.arange(n)
    above = np.clip(rows // 2 - radius, 0, coarse_rows - 1)
    below = np.clip(rows // 2 + radius, 0, coarse_rows - 1)
    lo = np.clip(2 * (low[above] - radius), 0, m - 1)
    hi = np.clip(2 * (high[below] + radius) + 1, 0, m - 1)
    lo[0], hi[-1] = 0, m - 1
    return lo, np.maximum(lo, hi)


def fast_dtw(a: np.ndarray, b: np.ndarray, radius: int, want_path: bool = False):
    """Approximate DTW distance (and path) of two (points x variables) series."""
    n, m = len(a), len(b)
    if n < radius + 2 or m < radius + 2:
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, m - 1, dtype=np.int64)
    else:
        _, coarse = fast_dtw(_halve(a), _halve(b), radius, want_path=True)
        lo, hi = _window_around(coarse, n, m, radius)
    return _dtw_in_window(a, b, lo, hi, want_path)


def exact_dtw(a: np.ndarray, b: np.ndarray) -> float:
    n, m = len(a), len(b)
    return _dtw_in_window(a, b, np.zeros(n, dtype=np.int64), np.full(n, m - 1, dtype=np.int64), False)[0]


def zscore_columns(arr: np.ndarray) -> np.ndarray:
    """Column-wise z-score with the population deviation; constant columns become zero."""
    arr = np.asarray(arr, dtype=float)
    mean, std = np.nanmean(arr, axis=0), np.nanstd(arr, axis=0)
    flat = ~(std > 1e-10)
    out = (arr - mean) / np.where(flat, 1.0, std)
    out[:, flat] = 0.0
    return out


def golden_score(trajectory: np.ndarray, profile_mean: np.ndarray, max_distance: float = 2.0) -> tuple[float, float]:
    """(score 0..100 rounded to 2, normalised distance rounded to 6)."""
    a, b = zscore_columns(trajectory), zscore_columns(profile_mean)
    radius = max(len(a) // 5, 10)
    distance, _ = fast_dtw(a, b, radius)
    norm = distance / max(len(a), len(b))
    return round(min(max(100.0 * (1.0 - norm / max_distance), 0.0), 100.0), 2), round(norm, 6)


# ---------------------------------------------------------------------------------------------------
# Header similarity
# ---------------------------------------------------------------------------------------------------

_NON_WORD = re.compile(r"\W")


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(_NON_WORD.sub(" ", text).lower().split()))


def token_sort_ratio(left: str, right: str) -> float:
    """100 * normalised Indel similarity of the token-sorted, cleaned strings; 0 if either is empty."""
    a, b = _sorted_tokens(left), _sorted_tokens(right)
    if not a or not b:
        return 0.0
    # Longest common subsequence by bit-parallel rows: bit j of ``row`` is 0 where the LCS grows.
    masks: dict[str, int] = {}
    for j, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << j)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def best_alias(header: str, aliases: list[tuple[str, str]], threshold: float = 70.0) -> tuple[str | None, float]:
    """Variable whose alias is most similar to ``header`` and the confidence, or (None, 0)."""
    best, var = 0.0, None
    for alias, variable in aliases:
        score = token_sort_ratio(header, alias)
        if score >= threshold and score > best:
            best, var = score, variable
    return var, (round(best) / 100.0 if var is not None else 0.0)
