"""SQL of detection on short signals: the whole programme over all cuts, and the textbook run-length recursion.

Both walk one sample a step in a recursive query; they share nothing with the kernels they check.
"""

from __future__ import annotations

#: All events of a user as one signal, numbered in time; smoothed over five samples with the ends repeated.
SIGNAL = """raw AS (
  SELECT CAST(user_id AS VARCHAR) AS batch_id, ts, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)
), signal AS (
  SELECT *, (sum(value) OVER f + greatest(0, 2 - i) * first_value(value) OVER k + greatest(0, i + 2 - (n - 1)) * last_value(value) OVER k) / 5 AS x
  FROM raw WINDOW f AS (PARTITION BY batch_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
    k AS (PARTITION BY batch_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)"""

#: Segments (batch_id, seg, start_i, end_i) with times and values of their ends, then the labels of their phases.
LABELS = """seg_rows AS (
  SELECT s.batch_id, seg, end_i - start_i AS len, a.ts AS start_ts, {end_ts} AS end_ts, a.value AS first, b.value AS last
  FROM segs s JOIN raw a ON a.batch_id = s.batch_id AND a.i = start_i JOIN raw b ON b.batch_id = s.batch_id AND b.i = end_i - 1
    LEFT JOIN raw c ON c.batch_id = s.batch_id AND c.i = end_i
), rated AS (
  SELECT *, CASE WHEN len <= 1 THEN 0.0 ELSE (last - first) / len END AS rate FROM seg_rows
), topped AS (
  SELECT *, max(rate) OVER w AS top, max(abs(rate)) OVER w AS big, first_value(seg) OVER (PARTITION BY batch_id ORDER BY rate DESC, seg) AS top_seg
  FROM rated WINDOW w AS (PARTITION BY batch_id)
), phase AS (
  SELECT *, CASE WHEN top > 0 AND seg = top_seg THEN 'exponential' WHEN top > 0 AND seg > top_seg AND rate < 0 THEN 'decline'
    WHEN top > 0 AND seg < top_seg AND abs(rate) < 0.1 * big THEN 'lag'
    WHEN top > 0 AND seg > top_seg AND abs(rate) < 0.1 * big THEN 'stationary' ELSE 'unknown' END AS phase_type FROM topped
)"""

#: Kernel segmentation: similarities of all pairs, their sums over all spans, and the cheapest way to each end.
#: ``gamma`` is 1 over the squared median distance of the values at 256 ranks.
SEGMENTS = f"""{SIGNAL}, ordered AS (
  SELECT batch_id, n, list(x ORDER BY x) AS xs, list(x ORDER BY i) AS path FROM signal GROUP BY batch_id, n
), ranked AS (
  SELECT batch_id, n, path, list_transform(range(256), lambda k: xs[CAST(ceil((k + 0.5) / 256 * n) AS INTEGER)]) AS q FROM ordered
), distances AS (
  SELECT batch_id, n, path, list_sort(flatten(list_transform(q, lambda a: list_transform(q, lambda b: abs(a - b))))) AS d FROM ranked
), width AS (
  SELECT batch_id, n, path, CASE WHEN m > 0 THEN 1 / (m * m) ELSE 1.0 END AS gamma
  FROM (SELECT *, d[1 + CAST(least(floor(65536 * (0.5 + 0.5 / n)), 65535) AS INTEGER)] AS m FROM distances)
), alike AS (
  SELECT a.batch_id, a.i, b.i AS j, exp(-least(greatest(gamma * (a.x - b.x) * (a.x - b.x), 1e-2), 1e2)) AS k
  FROM signal a JOIN signal b ON a.batch_id = b.batch_id JOIN width w ON w.batch_id = a.batch_id
), along AS (
  SELECT batch_id, i, j, sum(k) OVER (PARTITION BY batch_id, i ORDER BY j) AS s FROM alike
), sums AS (
  SELECT batch_id, i + 1 AS i, j + 1 AS j, sum(s) OVER (PARTITION BY batch_id, j ORDER BY i) AS s FROM along
), corner AS (SELECT batch_id, i, s FROM sums WHERE i = j UNION ALL SELECT batch_id, 0, 0.0 FROM width
), spans AS (
  SELECT e.batch_id, e.i AS stop, list((e.i - a.i) * exp(-1e-2) - (e.s - 2 * coalesce(m.s, 0) + a.s) / (e.i - a.i) ORDER BY a.i) AS cost
  FROM corner e JOIN corner a ON a.batch_id = e.batch_id AND a.i < e.i
    LEFT JOIN sums m ON m.batch_id = e.batch_id AND m.i = a.i AND m.j = e.i GROUP BY 1, 2
), walk(batch_id, stop, best, back) AS (
  SELECT batch_id, 0, [CAST(-{{penalty}} AS DOUBLE)], [0::BIGINT] FROM width
  UNION ALL
  SELECT batch_id, stop, list_append(best, CASE WHEN len(v) = 0 THEN 'inf'::DOUBLE ELSE list_min(v) + {{penalty}} END),
    list_append(back, CASE WHEN len(v) = 0 THEN 0 ELSE list_position(v, list_min(v)) - 1 END)
  FROM (SELECT w.batch_id, s.stop, best, back,
      list_transform(range(0, greatest(s.stop - {{min_size}} + 1, 0)), lambda a: best[a + 1] + cost[a + 1]) AS v
    FROM walk w JOIN spans s ON s.batch_id = w.batch_id AND s.stop = w.stop + 1)
), whole AS (
  SELECT w.batch_id, n, CASE WHEN n < 2 * {{min_size}} THEN list_transform(back, lambda b: 0::BIGINT) ELSE back END AS back
  FROM walk w JOIN width ON width.batch_id = w.batch_id AND stop = n
), unroll(batch_id, back, start_i, end_i) AS (
  SELECT batch_id, back, back[n + 1], n FROM whole
  UNION ALL SELECT batch_id, back, back[start_i + 1], start_i FROM unroll WHERE start_i > 0
), segs AS (
  SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY start_i) - 1 AS seg, start_i, end_i FROM unroll
), {LABELS.format(end_ts='coalesce(c.ts, b.ts)')}"""

#: Online detection: after each value the posterior of the run length, with a Student-t prediction per run length.
ONLINE = f"""{SIGNAL}, posterior(batch_id, t, probs, mu, beta, found) AS (
  SELECT DISTINCT batch_id, 0::BIGINT, [1.0::DOUBLE], [0.0::DOUBLE], [1.0::DOUBLE], false FROM raw
  UNION ALL
  SELECT batch_id, t + 1, probs, list_concat([0.0::DOUBLE], list_transform(range(len(mu)), lambda r: ((1 + r) * mu[r + 1] + x) / (2 + r))),
    list_concat([1.0::DOUBLE], list_transform(range(len(mu)), lambda r: beta[r + 1] + 0.5 * (1 + r) * (x - mu[r + 1]) ** 2 / (2 + r))),
    t + 1 > 10 AND list_position(probs, list_max(probs)) <= 5 AND list_sum(probs[1:10]) > {{threshold}}
  FROM (SELECT batch_id, t, mu, beta, x, list_transform(grown, lambda p: p / list_sum(grown)) AS probs
    FROM (SELECT *, list_concat([list_sum(weight) * {{hazard}}], list_transform(weight, lambda w: w * (1 - {{hazard}}))) AS grown
      FROM (SELECT p.batch_id, t, mu, beta, r.value AS x,
          list_transform(range(len(probs)), lambda r: probs[r + 1] * greatest(exp(
            lgamma((3 + r) / 2) - lgamma((2 + r) / 2) - 0.5 * ln((2 + r) * pi())
            - 0.5 * ln(beta[r + 1] * (2 + r) / ((1 + 0.5 * r) * (1 + r)))
            - (3 + r) / 2 * ln(1 + (r.value - mu[r + 1]) ** 2 / ((2 + r) * beta[r + 1] * (2 + r) / ((1 + 0.5 * r) * (1 + r))))), 1e-300)) AS weight
        FROM posterior p JOIN raw r ON r.batch_id = p.batch_id AND r.i = t)))
), starts AS (
  SELECT batch_id, 0 AS start_i FROM raw WHERE i = 0 UNION SELECT batch_id, t - 1 FROM posterior WHERE found AND t > 1
), segs AS (
  SELECT s.batch_id, row_number() OVER w - 1 AS seg, start_i, coalesce(lead(start_i) OVER w, n) AS end_i
  FROM starts s JOIN (SELECT DISTINCT batch_id, n FROM raw) r ON r.batch_id = s.batch_id WINDOW w AS (PARTITION BY s.batch_id ORDER BY start_i)
), {LABELS.format(end_ts='b.ts')}"""


def detection_sql() -> dict[str, str]:
    pelt = "WITH RECURSIVE " + SEGMENTS.replace("{penalty}", "2.0").replace("{min_size}", "5")
    online = "WITH RECURSIVE " + ONLINE.replace("{hazard}", "(1.0 / 250)").replace("{threshold}", "0.3")
    ends = "epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us"
    return {
        "pelt_phases": f"{pelt} SELECT batch_id, phase_type, {ends}, round(rate, 6) AS growth_rate FROM phase",
        "online_phases": f"{online} SELECT batch_id, phase_type, {ends} FROM phase",
        "detected_metrics": f"""{pelt}, fit AS (
            SELECT p.batch_id, p.start_ts, p.end_ts, min(r.value) AS lowest, count(*) AS n,
              regr_slope(ln(r.value), (epoch_us(r.ts) - epoch_us(p.start_ts)) / 3.6e9) AS mu
            FROM phase p JOIN raw r ON r.batch_id = p.batch_id AND r.ts BETWEEN p.start_ts AND p.end_ts
            WHERE phase_type = 'exponential' GROUP BY 1, 2, 3)
          SELECT batch_id, 'exponential' AS phase_type, epoch_us(start_ts) AS start_us, round(mu, 6) AS mu
          FROM fit WHERE n >= 2 AND lowest > 0 AND mu IS NOT NULL""",
    }
