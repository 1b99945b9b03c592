"""SQL for DuckDB that gives the queries' rows, put together from shared common table expressions."""

from __future__ import annotations

from cambium.functions.params import DEFAULT_INIT, DEFAULT_MU, DEFAULT_PHI, DEFAULT_PI, DEFAULT_TRANS

_D = lambda v: f"{v!r}::DOUBLE"

PRM = "prm(k, pi, mu, phi, ini) AS (VALUES " + ", ".join(f"({k}, {_D(a)}, {_D(b)}, {_D(c)}, {_D(d)})" for k, (a, b, c, d) in enumerate(zip(DEFAULT_PI, DEFAULT_MU, DEFAULT_PHI, DEFAULT_INIT))) + ")"
TR = "tr(i, j, la) AS (SELECT i, j, ln(p) FROM (VALUES " + ", ".join(f"({i}, {j}, {_D(p)})" for i, row in enumerate(DEFAULT_TRANS) for j, p in enumerate(row)) + ") AS q(i, j, p))"
PANEL = """u AS (SELECT DISTINCT user_id FROM events), dd AS (SELECT unnest(range(0, 30)) AS t),
s AS (SELECT user_id, datediff('day', TIMESTAMP '2024-01-01', ts) AS t, sum(CAST(round(value * 100) AS BIGINT)) AS c,
             count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
panel AS (SELECT u.user_id AS pid, CAST(dd.t AS INTEGER) AS t,
                 CAST(least(100, coalesce(s.c // (400 * (1 + (u.user_id % 12) * (u.user_id % 12))), 0)) AS INTEGER) AS pct
          FROM u CROSS JOIN dd LEFT JOIN s ON s.user_id = u.user_id AND s.t = dd.t)"""
E = """e AS (SELECT pid, t, k, CASE WHEN pct = 0 THEN ln(pi) ELSE ln(1 - pi) + lgamma(phi) - lgamma(mu * phi) - lgamma((1 - mu) * phi)
  + (mu * phi - 1) * ln(least(pct / 100.0::DOUBLE, 0.999)) + ((1 - mu) * phi - 1) * ln(1 - least(pct / 100.0::DOUBLE, 0.999)) END AS le FROM panel, prm)"""
V = """v AS (SELECT pid, t, k, ln(ini) + le AS dlt, [k] AS path FROM e JOIN prm USING (k) WHERE t = 0
  UNION ALL SELECT pid, t, k, dlt, path FROM (SELECT e.pid, e.t, e.k, max(v.dlt + la) + any_value(e.le) AS dlt, list_append(arg_max(v.path, v.dlt + la), e.k) AS path
  FROM v JOIN e ON e.pid = v.pid AND e.t = v.t + 1 JOIN {tr} GROUP BY e.pid, e.t, e.k)),
best AS (SELECT pid, arg_max(path, dlt) AS states, max(dlt) AS log_prob FROM v WHERE t = 29 GROUP BY pid),
decoded AS (SELECT pid, CAST(unnest(range(0, 30)) AS INTEGER) AS t, CAST(unnest(states) AS INTEGER) AS state FROM best)"""
STATIC = V.format(tr="tr ON tr.i = v.k AND tr.j = e.k")
FB = """a AS (SELECT pid, t, k, ln(ini) + le AS la_ FROM e JOIN prm USING (k) WHERE t = 0
  UNION ALL SELECT pid, t, k, any_value(mx) + ln(sum(exp(s - mx))) + any_value(le) FROM (
    SELECT e.pid, e.t, e.k, e.le, a.la_ + tr.la AS s, max(a.la_ + tr.la) OVER (PARTITION BY e.pid, e.t, e.k) AS mx
    FROM a JOIN e ON e.pid = a.pid AND e.t = a.t + 1 JOIN tr ON tr.i = a.k AND tr.j = e.k) GROUP BY pid, t, k),
b AS (SELECT pid, t, k, 0.0::DOUBLE AS lb FROM e WHERE t = 29
  UNION ALL SELECT pid, t, k, any_value(mx) + ln(sum(exp(s - mx))) FROM (
    SELECT b.pid, b.t - 1 AS t, tr.i AS k, tr.la + e.le + b.lb AS s, max(tr.la + e.le + b.lb) OVER (PARTITION BY b.pid, b.t, tr.i) AS mx
    FROM b JOIN e ON e.pid = b.pid AND e.t = b.t AND e.k = b.k JOIN tr ON tr.j = b.k WHERE b.t > 0) GROUP BY pid, t, k),
ev AS (SELECT pid, max(la_) + ln(sum(exp(la_ - m))) AS ll FROM (SELECT *, max(la_) OVER (PARTITION BY pid) AS m FROM a WHERE t = 29) GROUP BY pid),
post AS (SELECT a.pid, a.t, a.k, exp(la_ + lb - ll) AS p FROM a JOIN b USING (pid, t, k) JOIN ev USING (pid))"""
CELLS = """cells AS (SELECT pid, CAST(pid // 15 AS INTEGER) AS r, CAST(pid % 15 AS INTEGER) AS c,
  CASE WHEN pid % 7 = 3 THEN 0 WHEN pid % 50 = 49 THEN 255 ELSE 1 END AS mask, CAST((pid // 15 // 4) * 4 + (pid % 15) // 4 AS INTEGER) AS tile_id
  FROM (SELECT DISTINCT user_id AS pid FROM events))"""
KEPT = "kept AS (SELECT tile_id, count(*) AS n_cells, count(*) FILTER (mask > 0 AND mask != 255) AS n_valid FROM cells GROUP BY 1 HAVING n_valid >= 0.01 * n_cells)"
COV = """cov AS (SELECT p.pid, p.t, CAST(least(4, coalesce(s.errors, 0)) AS INTEGER) AS fire_severity, (coalesce(s.c, 0) % 600) / 100.0::DOUBLE - 3 AS spei,
  CASE WHEN p.pid % 11 != 0 THEN CAST(cu.c_acctbal AS DOUBLE) END AS elevation, (p.pid % 13) / 13.0::DOUBLE AS chili, 0.2::DOUBLE + 0.1::DOUBLE * (p.pid % 5) AS aridity
  FROM panel p LEFT JOIN s ON s.user_id = p.pid AND s.t = p.t LEFT JOIN customer cu ON cu.c_custkey = p.pid),
x AS (SELECT pid, t, [1.0::DOUBLE, fire_severity::DOUBLE, spei, coalesce(elevation * 1e-4::DOUBLE, 0), chili, aridity] AS x FROM cov)"""
DTR = """w(i, j, dd, w) AS (SELECT i, j, d, CASE WHEN i = j THEN 0.0::DOUBLE ELSE ((7 * i + 3 * j + d) % 11 - 5) / 50.0::DOUBLE END FROM range(0, 6) q(i), range(0, 6) q2(j), range(0, 6) q3(d)),
l AS (SELECT pid, t, i, j, sum(x[dd + 1] * w) AS lg FROM x, w WHERE t < 29 GROUP BY ALL),
m AS (SELECT *, max(lg) OVER (PARTITION BY pid, t, i) AS mx FROM l),
dtr AS (SELECT pid, t, i, j, lg - mx - ln(sum(exp(lg - mx)) OVER (PARTITION BY pid, t, i)) AS la FROM m)"""
FIRST = "(SELECT min(t) + 1986 FROM decoded d2 WHERE d2.pid = d.pid AND d2.state >= {k})"
YEARS = "yr AS (SELECT pid, " + ", ".join(f"CAST(min(t) FILTER (state >= {k}) + 1986 AS SMALLINT) AS {n}" for k, n in enumerate(("first_trace", "first_sparse", "first_open", "first_woodland", "first_forest"), 1)) + ", CAST(max(state) AS TINYINT) AS max_state FROM decoded GROUP BY pid)"


def _sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


_VIT = (PANEL, PRM, TR, E, STATIC)
_FB = (PANEL, PRM, TR, E, FB)
_NEAR = """tiled AS (SELECT p.pid, p.t, c.tile_id, c.r - min(c.r) OVER (PARTITION BY c.tile_id) AS r, c.c - min(c.c) OVER (PARTITION BY c.tile_id) AS c, least(p.pct / 100.0::DOUBLE, 0.999) AS x FROM panel p JOIN cells c USING (pid)),
size AS (SELECT tile_id, max(r) + 1 AS h, max(c) + 1 AS w FROM tiled GROUP BY 1)"""

_DFB = FB.replace("JOIN tr ON tr.i = a.k AND tr.j = e.k", "JOIN dtr tr ON tr.pid = a.pid AND tr.t = a.t AND tr.i = a.k AND tr.j = e.k").replace("JOIN tr ON tr.j = b.k", "JOIN dtr tr ON tr.pid = b.pid AND tr.t = b.t - 1 AND tr.j = b.k")
_XI = """xi AS (SELECT a.pid, a.t, tr.i, tr.j, tr.la, exp(a.la_ + tr.la + e.le + b.lb - ev.ll) AS xi FROM a JOIN dtr tr ON tr.pid = a.pid AND tr.t = a.t AND tr.i = a.k
  JOIN e ON e.pid = a.pid AND e.t = a.t + 1 AND e.k = tr.j JOIN b ON b.pid = e.pid AND b.t = e.t AND b.k = e.k JOIN ev ON ev.pid = a.pid),
slope AS (SELECT pid, t, i, j, sum(xi) OVER (PARTITION BY pid, t, i) * exp(la) - xi AS miss FROM xi),
loss AS (SELECT -sum(xi * la) + 0.001::DOUBLE * (SELECT sum(w * w) FROM w WHERE i != j) AS loss FROM xi)"""
_KEPT_NEAR = """ktiled AS (SELECT g.*, c.mask > 0 AND c.mask != 255 AS valid FROM tiled g JOIN cells c ON c.pid = g.pid WHERE g.tile_id IN (SELECT tile_id FROM kept)),
near AS (SELECT g.pid, g.t, coalesce(min(30 * sqrt((g.r - s.r) ^ 2 + (g.c - s.c) ^ 2)) FILTER (s.x >= 0.04), 50000.0) AS near FROM ktiled g JOIN ktiled s USING (tile_id, t) WHERE g.valid GROUP BY g.pid, g.t),
o AS (SELECT unnest(range(-5, 6)) AS o), n AS (SELECT g.pid, g.t, g.tile_id, ((g.r + a.o) % (2 * h) + 2 * h) % (2 * h) AS mr, ((g.c + b.o) % (2 * w) + 2 * w) % (2 * w) AS mc, h, w FROM ktiled g JOIN size USING (tile_id), o a, o b WHERE g.valid),
focal AS (SELECT n.pid, n.t, avg(s.x) AS fm FROM n JOIN ktiled s ON s.tile_id = n.tile_id AND s.t = n.t AND s.r = CASE WHEN mr < h THEN mr ELSE 2 * h - 1 - mr END AND s.c = CASE WHEN mc < w THEN mc ELSE 2 * w - 1 - mc END GROUP BY n.pid, n.t)"""

ORACLES = {
    "panel_build": _sql(PANEL, select="SELECT pid, t, pct FROM panel"),
    "rap_to_float": _sql(PANEL, select="SELECT pid, t, round(least(greatest(pct / 100.0::DOUBLE, 0), 0.999), 6) AS x FROM panel"),
    "zib_emission": _sql(PANEL, PRM, E, select="SELECT pid, t, CAST(k AS INTEGER) AS k, round(le, 6) AS le FROM e"),
    "gaussian_emission": _sql(PANEL, select="SELECT pid, t, CAST(k AS INTEGER) AS k, round(-0.5 * (ln(2 * pi() * 44.89::DOUBLE) + (pct - mean) * (pct - mean) / 44.89::DOUBLE), 6) AS le FROM panel, (VALUES (0, 1.5::DOUBLE), (1, 10.0::DOUBLE)) AS g(k, mean)"),
    "viterbi_states": _sql(*_VIT, select="SELECT pid, t, state FROM decoded"),
    "viterbi_collapsed": _sql(*_VIT, select="SELECT pid, t, state FROM decoded"),
    "viterbi_expression": _sql(*_VIT, select="SELECT pid, t, state FROM decoded"),
    "viterbi_log_prob": _sql(*_VIT, select="SELECT pid, round(log_prob, 6) AS log_prob FROM best"),
    "forward_loglik": _sql(*_FB, select="SELECT pid, round(ll, 6) AS log_lik FROM ev"),
    "total_loglik": _sql(*_FB, select="SELECT round(sum(ll), 4) AS log_lik, count(*) AS n_series FROM ev"),
    "posterior": _sql(*_FB, select="SELECT pid, t, CAST(k AS INTEGER) AS k, round(p, 6) AS p FROM post"),
    "posterior_quantized": _sql(*_FB, select="SELECT pid, t, CAST(k AS INTEGER) AS k, CAST(floor(least(greatest(round(p, 9) * 200, 0), 200)) AS SMALLINT) AS q FROM post"),
    "uncertainty_bands": _sql(*_FB, select="SELECT band, count(*) AS n FROM (SELECT CASE WHEN max(round(p, 9)) > 0.9 THEN 'high' WHEN max(round(p, 9)) >= 0.6 THEN 'moderate' ELSE 'low' END AS band FROM post GROUP BY pid, t) GROUP BY band"),
    "expected_transitions": _sql(*_FB, select="SELECT CAST(tr.i AS INTEGER) AS i, CAST(tr.j AS INTEGER) AS j, round(sum(exp(a.la_ + tr.la + e.le + b.lb - ev.ll)), 4) AS n FROM a JOIN tr ON tr.i = a.k JOIN e ON e.pid = a.pid AND e.t = a.t + 1 AND e.k = tr.j JOIN b ON b.pid = e.pid AND b.t = e.t AND b.k = e.k JOIN ev ON ev.pid = a.pid GROUP BY 1, 2"),
    "zero_fraction": _sql(*_FB, select="SELECT CAST(k AS INTEGER) AS k, round(greatest(least(sum(p) FILTER (pct = 0) / greatest(sum(p), 1e-10), 1 - 1e-6), 1e-6), 6) AS p FROM post JOIN panel USING (pid, t) GROUP BY k"),
    "init_mstep": _sql(*_FB, select="SELECT CAST(k AS INTEGER) AS k, round(greatest(avg(p), 1e-8) / sum(greatest(avg(p), 1e-8)) OVER (), 6) AS p FROM post WHERE t = 0 GROUP BY k"),
    "transition_mstep": _sql(*_FB, select="SELECT i, j, round(greatest(n / d, 1e-8) / sum(greatest(n / d, 1e-8)) OVER (PARTITION BY i), 6) AS p FROM (SELECT CAST(tr.i AS INTEGER) AS i, CAST(tr.j AS INTEGER) AS j, sum(exp(a.la_ + tr.la + e.le + b.lb - ev.ll)) AS n FROM a JOIN tr ON tr.i = a.k JOIN e ON e.pid = a.pid AND e.t = a.t + 1 AND e.k = tr.j JOIN b ON b.pid = e.pid AND b.t = e.t AND b.k = e.k JOIN ev ON ev.pid = a.pid GROUP BY 1, 2) JOIN (SELECT k, greatest(sum(p), 1e-10) AS d FROM post WHERE t < 29 GROUP BY k) ON k = i"),
    "beta_suffstats": _sql(*_FB, select="SELECT CAST(k AS INTEGER) AS k, round(sum(p), 4) AS w, round(sum(p * ln(least(pct / 100.0::DOUBLE, 0.999))), 4) AS s_ln, round(sum(p * ln(1 - least(pct / 100.0::DOUBLE, 0.999))), 4) AS s_ln1m FROM post JOIN panel USING (pid, t) WHERE pct > 0 GROUP BY k"),
    "first_year_products": _sql(*_VIT, YEARS, select="SELECT * FROM yr"),
    "max_state": _sql(*_VIT, select="SELECT pid, CAST(max(state) AS TINYINT) AS max_state FROM decoded GROUP BY pid"),
    "year_state_summary": _sql(*_VIT, select="SELECT CAST(t + 1986 AS INTEGER) AS year, CAST(k AS INTEGER) AS state, count(*) FILTER (state = k) AS n, count(state) AS n_valid, count(*) FILTER (state IS NULL) AS n_nodata, round(count(*) FILTER (state = k) / greatest(count(state), 1)::DOUBLE, 6) AS fraction FROM decoded, range(0, 6) q(k) GROUP BY t, k"),
    "first_year_summary": _sql(*_VIT, YEARS, select="SELECT product, count(*) AS n_pixels, round(avg(y), 6) AS mean, median(y)::DOUBLE AS median, min(y) AS min, max(y) AS max FROM (UNPIVOT (SELECT first_trace, first_sparse, first_open, first_woodland, first_forest FROM yr) ON COLUMNS(*) INTO NAME product VALUE y) GROUP BY product"),
    "hard_transitions": _sql(*_VIT, select="SELECT a.state AS i, b.state AS j, count(*) AS n FROM decoded a JOIN decoded b ON a.pid = b.pid AND b.t = a.t + 1 GROUP BY 1, 2"),
    "tiles": _sql(CELLS, "h AS (SELECT max(r) + 1 AS h FROM cells)", "g AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, least(4, h - r * 4) AS height, least(4, 15 - c * 4) AS width FROM range(0, 10000) q(r), range(0, 4) q2(c), h WHERE r * 4 < h)", select="SELECT CAST(r * 4 + c AS INTEGER) AS tile_id, CAST(r * 4 AS INTEGER) AS row_off, CAST(c * 4 AS INTEGER) AS col_off, CAST(height AS INTEGER) AS height, CAST(width AS INTEGER) AS width, CAST(height * width AS INTEGER) AS n_pixels FROM g"),
    "raster_window": _sql(CELLS, select="SELECT CAST(a.r AS INTEGER) AS r, CAST(b.c AS INTEGER) AS c, CAST(coalesce(mask, 0) AS INTEGER) AS value FROM range(0, 8) a(r) CROSS JOIN range(2, 11) b(c) LEFT JOIN cells ON cells.r = a.r AND cells.c = b.c AND mask > 0"),
    "tile_filter": _sql(CELLS, KEPT, select="SELECT tile_id, n_cells, n_valid FROM kept"),
    "masked_cells": _sql(CELLS, KEPT, select="SELECT pid, r, c, tile_id FROM cells WHERE mask > 0 AND mask != 255 AND tile_id IN (SELECT tile_id FROM kept)"),
    "masked_cells_strict": _sql(CELLS, select="SELECT pid, r, c, tile_id FROM cells WHERE mask > 0 AND tile_id IN (SELECT tile_id FROM cells GROUP BY 1 HAVING count(*) FILTER (mask > 0) >= 0.01 * count(*))"),
    "em_sample": _sql(CELLS, "chosen AS (SELECT tile_id FROM (SELECT DISTINCT tile_id FROM cells) ORDER BY md5(tile_id || ':42'), tile_id LIMIT 5)", "ranked AS (SELECT pid, tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY md5(pid || ':42'), pid) AS rn FROM cells WHERE tile_id IN (SELECT tile_id FROM chosen))", select="SELECT pid, tile_id FROM ranked WHERE rn <= 20 // (SELECT count(*) FROM chosen) + 1 ORDER BY md5(pid || ':42'), pid LIMIT 20"),
    "seed_distance": _sql(PANEL, CELLS, _NEAR, select="SELECT g.pid, g.t, round(coalesce(min(30 * sqrt((g.r - s.r) ^ 2 + (g.c - s.c) ^ 2)) FILTER (s.x >= 0.04), 50000.0), 6) AS near, round(coalesce(min(30 * sqrt((g.r - s.r) ^ 2 + (g.c - s.c) ^ 2)) FILTER (s.x >= 0.5), 50000.0), 6) AS far FROM tiled g JOIN tiled s USING (tile_id, t) GROUP BY g.pid, g.t"),
    "focal_mean": _sql(PANEL, CELLS, _NEAR, "o AS (SELECT unnest(range(-5, 6)) AS o)", "n AS (SELECT g.pid, g.t, g.tile_id, ((g.r + a.o) % (2 * h) + 2 * h) % (2 * h) AS mr, ((g.c + b.o) % (2 * w) + 2 * w) % (2 * w) AS mc, h, w FROM tiled g JOIN size USING (tile_id), o a, o b)", select="SELECT n.pid, n.t, round(avg(s.x), 6) AS fm FROM n JOIN tiled s ON s.tile_id = n.tile_id AND s.t = n.t AND s.r = CASE WHEN mr < h THEN mr ELSE 2 * h - 1 - mr END AND s.c = CASE WHEN mc < w THEN mc ELSE 2 * w - 1 - mc END GROUP BY n.pid, n.t"),
    "covariate_join": _sql(PANEL, COV, select="SELECT pid, t, fire_severity, round(spei, 6) AS spei, round(elevation, 6) AS elevation, round(chili, 6) AS chili, round(aridity, 6) AS aridity FROM cov"),
    "covariate_stack": _sql(PANEL, COV, select="SELECT pid, t, CAST(d AS INTEGER) AS d, round(x[d + 1], 6) AS v FROM x, range(0, 6) q(d) WHERE t < 29"),
    "covariate_lag": _sql(PANEL, COV, select="SELECT pid, t, lag(fire_severity) OVER (PARTITION BY pid ORDER BY t) AS fire_severity FROM cov"),
    "dynamic_log_trans": _sql(PANEL, COV, DTR, select="SELECT pid, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(la, 6) AS la FROM dtr"),
    "dynamic_log_trans_sql": _sql(PANEL, COV, DTR, select="SELECT pid, CAST(t AS INTEGER) AS t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(la, 6) AS la FROM dtr"),
    "dynamic_viterbi": _sql(PANEL, PRM, E, COV, DTR, V.format(tr="dtr tr ON tr.pid = v.pid AND tr.t = v.t AND tr.i = v.k AND tr.j = e.k"), select="SELECT pid, t, state FROM decoded"),
    "grid_offset": "SELECT CAST(r_regionkey AS BIGINT) AS grid_id, CAST(r_regionkey * 3 AS INTEGER) AS row_off, CAST(-2 * r_regionkey AS INTEGER) AS col_off FROM region",
    "zero_fill": _sql(CELLS, select="SELECT pid, y AS year, 0 AS fire_severity FROM cells, (VALUES (2023), (2024)) AS q(y)"),
    "mosaic": "SELECT pid, t, max(v) AS v FROM (SELECT user_id AS pid, datediff('day', TIMESTAMP '2024-01-01', ts) AS t, event_id AS v FROM events WHERE user_id % 3 <= 1 UNION ALL SELECT user_id, datediff('day', TIMESTAMP '2024-01-01', ts), event_id FROM events WHERE user_id % 3 >= 1) GROUP BY pid, t",
    "alignment_check": "SELECT CAST(r_regionkey AS BIGINT) AS grid_id, r_regionkey = 0 AS aligned FROM region",
    "work_items": _sql(CELLS, select="SELECT tile_id FROM (SELECT DISTINCT tile_id FROM cells) WHERE tile_id NOT IN (SELECT tile_id FROM cells WHERE mask = 255)"),
    "memory_estimate": "SELECT CAST(n AS INTEGER) AS n_pixels, pairs, round(n * 156 / 1048576.0, 6) AS observations_mb, round(n * 936 / 1048576.0, 6) AS emissions_mb, round(n * 936 / 1048576.0, 6) AS posteriors_mb, round(n * 1520 / 1048576.0, 6) AS covariates_mb, round(n * 156 / 1048576.0, 6) AS states_out_mb, round(n * 936 / 1048576.0, 6) AS posteriors_out_mb, round(n * (2 * 156 + 5 * 936 + 1520 + CASE WHEN pairs THEN 5472 ELSE 0 END) / 1048576.0, 6) AS total_mb FROM (SELECT CAST(v AS BIGINT) AS n FROM (VALUES (1000), (500000)) AS q0(v)) AS q, (VALUES (true), (false)) AS p(pairs)",
    "weight_gradient": _sql(PANEL, PRM, E, COV, DTR, _DFB, _XI, select="SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS target, CAST(dd AS INTEGER) AS d, round(sum(miss * x[dd + 1]) + 2 * 0.001::DOUBLE * any_value(w), 4) AS gradient, round((SELECT loss FROM loss), 4) AS loss FROM slope JOIN x USING (pid, t) JOIN w USING (i, j) WHERE i != j GROUP BY i, j, dd"),
    "pipeline_features": _sql(PANEL, CELLS, KEPT, _NEAR, _KEPT_NEAR, select="SELECT g.pid, CAST(g.t AS INTEGER) AS t, CAST(d AS INTEGER) AS d, round([1.0::DOUBLE, CAST(least(4, coalesce(s.errors, 0)) AS DOUBLE), CASE WHEN g.pid % 11 = 0 THEN 0 ELSE g.pid / 8.0::DOUBLE END, near, fm][d + 1], 6) AS v FROM ktiled g JOIN near USING (pid, t) JOIN focal USING (pid, t) LEFT JOIN s ON s.user_id = g.pid AND s.t = g.t, range(0, 5) q(d) WHERE g.valid AND g.t < 29"),
    "mosaic_plan": """WITH cat(product, expected, lastyear, gap) AS (VALUES ('tree_cover', 4, 2024, NULL), ('fire_severity', 4, 2022, 2023), ('spei', 12, 2024, NULL), ('spei1y', 12, 2024, NULL)),
n AS (SELECT CAST(n_nationkey AS INTEGER) AS y FROM nation),
found AS (SELECT DISTINCT y * 2 + 1986 AS year, p AS product, CASE WHEN (y * 2 + 1986) % 3 = 0 THEN 3 ELSE 12 END AS tiles FROM n, (VALUES ('tree_cover'), ('fire_severity'), ('spei')) AS q(p) WHERE y < 20),
made AS (SELECT product, year FROM cat JOIN found USING (product) WHERE year <= lastyear AND tiles >= expected AND NOT (product = 'spei' AND year IN (SELECT y + 1990 FROM n WHERE y < 5)))
SELECT product, CAST(year AS INTEGER) AS year, 'mosaic' AS action FROM made
UNION ALL SELECT 'fire_severity', unnest([2023, 2024]), 'zero_fill' FROM (SELECT 1 FROM made WHERE product = 'fire_severity' LIMIT 1)
UNION ALL SELECT 'aridity', NULL, 'mosaic' UNION ALL SELECT 'mask', NULL, 'mosaic'""",
}
