import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brewlens.functions import kernels as k
from tests.conftest import growth_curve


def brute_segments(x, penalty, min_size):
    n = len(x)
    d = (x[:, None] - x[None]) ** 2
    med = np.median(d[np.triu_indices(n, 1)])
    gram = np.exp(-np.clip(d / med, 1e-2, 1e2))
    best, back = np.full(n + 1, np.inf), [0] * (n + 1)
    best[0] = -penalty
    for e in range(1, n + 1):
        for s in range(0, e - min_size + 1):
            if np.isfinite(best[s]):
                block = gram[s:e, s:e]
                v = best[s] + np.trace(block) - block.sum() / (e - s) + penalty
                if v < best[e]:
                    best[e], back[e] = v, s
    out, at = [], n
    while at > 0:
        out.append(at)
        at = back[at]
    return out[::-1]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("penalty", [0.1, 1.0, 3.0])
def test_changepoints_equal_exhaustive_search(seed, penalty):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(m, 1, r.integers(10, 25)) for m in (0, 3, 0, -2)])
    assert k.kernel_changepoints(x, penalty, 5) == brute_segments(x, penalty, 5)


def test_higher_penalty_never_gives_more_segments():
    x = growth_curve()
    assert len(k.kernel_changepoints(x, 100.0)) <= len(k.kernel_changepoints(x, 0.01))
    assert 3 <= len(k.kernel_changepoints(x, 5.0)) <= 6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=257, max_size=400))
def test_median_of_pairs_by_bisection(values):
    x = np.array(values)
    i, j = np.triu_indices(len(x), 1)
    expected = np.median((x[j] - x[i]) ** 2)
    assert k.median_squared_distance(x) == pytest.approx(expected, rel=1e-6, abs=1e-9)


def naive_posterior(values, hazard, limit=500):
    """Textbook run-length recursion with explicit parameters per run length."""
    from math import exp, lgamma, log, pi

    probs, params = [1.0], [(0.0, 1.0, 1.0, 1.0)]
    for x in values:
        pred = []
        for mu, kappa, alpha, beta in params:
            df, s2 = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            pred.append(exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi * s2)
                            - (df + 1) / 2 * log(1 + (x - mu) ** 2 / (df * s2))))
        grown = [p * q * (1 - hazard) for p, q in zip(probs, pred)]
        probs = [sum(p * q * hazard for p, q in zip(probs, pred)), *grown]
        total = sum(probs)
        probs = [p / total for p in probs]
        params = [(0.0, 1.0, 1.0, 1.0)] + [
            ((kp * m + x) / (kp + 1), kp + 1, a + 0.5, b + 0.5 * kp * (x - m) ** 2 / (kp + 1)) for m, kp, a, b in params]
    return probs


def test_run_length_posterior_equals_textbook():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 40), r.normal(6, 1, 20)])
    p = k.RunLengthPosterior(hazard=0.02)
    for v in x:
        p.update(v)
    assert np.allclose(p.probs, naive_posterior(x, 0.02), atol=1e-12)


def test_online_step_is_found_and_noise_is_quiet():
    r = np.random.default_rng(0)
    p = k.RunLengthPosterior(hazard=0.01, threshold=0.3)
    hits = [i for i, v in enumerate(np.concatenate([r.normal(0, 0.1, 500), r.normal(5, 0.1, 100)])) if p.update(v)[0]]
    assert any(500 <= i <= 520 for i in hits)
    quiet = k.RunLengthPosterior()
    assert sum(quiet.update(v)[0] for v in r.normal(0, 0.1, 500)) <= 5
    assert len(quiet.probs) <= 501


def test_non_finite_values_leave_the_posterior_alone():
    p = k.RunLengthPosterior()
    p.update(1.0)
    before = p.state()
    assert p.update(float("nan")) == (False, 0.0) and p.update(float("inf")) == (False, 0.0)
    assert p.state() == before
    with pytest.raises(ValueError):
        k.RunLengthPosterior(hazard=1.0)


def naive_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return d[-1, -1]


@pytest.mark.parametrize("seed", range(5))
def test_dtw_bounds(seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(61, 2)).cumsum(0), r.normal(size=(83, 2)).cumsum(0)
    exact = naive_dtw(a, b)
    assert k.exact_dtw(a, b) == pytest.approx(exact)
    for radius in (1, 5, 20):
        assert k.fast_dtw(a, b, radius)[0] >= exact - 1e-9
    assert k.fast_dtw(a, b, 100)[0] == pytest.approx(exact)
    assert k.fast_dtw(a, a, 1)[0] == pytest.approx(0.0)


def test_scores():
    t = np.linspace(0, 24, 50)
    up = np.column_stack([np.exp(t / 10), np.cos(t)])
    assert k.golden_score(up, up) == (100.0, 0.0)
    assert k.golden_score(-up, up)[0] < 60
    assert k.golden_score(np.ones((20, 2)), up)[0] < 100


def test_header_similarity():
    assert k.token_sort_ratio("glucose conc", "conc glucose") == 100.0
    assert k.token_sort_ratio("", "x") == 0.0
    aliases = [("glucose", "glucose"), ("reactor_temp", "temperature")]
    assert k.best_alias("Reactor-Temp", aliases) == ("temperature", 0.92)
    assert k.best_alias("zzz", aliases) == (None, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=20), st.text(min_size=1, max_size=20))
def test_similarity_is_a_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            new = [0]
            for j, c in enumerate(y):
                new.append(row[j] + 1 if ch == c else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    x, y = k._sorted_tokens(a), k._sorted_tokens(b)
    expected = 200.0 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0
    assert k.token_sort_ratio(a, b) == pytest.approx(expected)
