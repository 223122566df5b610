"""What the SQL oracle computes in its own way: windows by a range join with literal bounds, recursion by rounds, plain formulas.

Nothing here goes through the texts or the library that Spark runs.
"""



def square(x: str, times: int = 4) -> str:
    """Squaring modulo the Mersenne prime 2^31 - 1, a few times over."""
    for _ in range(times):
        x = f"list_transform([CAST(({x}) % 2147483647 AS BIGINT)], lambda z: (z * z + 12345) % 2147483647)[1]"
    return x


VIEWS = {
    "wins": "SELECT unnest(generate_series(0, (SELECT (count(*) - 104) // 13 FROM (SELECT DISTINCT d FROM px)))) AS w",
    "rolled": "SELECT q.w, p.r, p.d, p.name, p.role, p.v FROM wins q JOIN panel p ON p.r >= 13 * q.w AND p.r < 13 * q.w + 104",
    "pairs": "SELECT a.w, a.name AS a, b.name AS b, a.role AS ra, b.role AS rb, corr(a.v, b.v) AS rho, covar_samp(a.v, b.v) AS cov, CAST(count(*) AS BIGINT) AS n FROM rolled a JOIN rolled b ON a.w = b.w AND a.r = b.r WHERE a.name < b.name GROUP BY ALL",
    "lagged": "SELECT a.w, a.name AS src, b.name AS dst, a.role AS rs, b.role AS rd, corr(a.v, b.v) AS rho FROM rolled a JOIN rolled b ON a.w = b.w AND b.r = a.r + 1 GROUP BY ALL",
    "cumcorr": """SELECT w, name, @r(sum(abs(rho))) AS score FROM (SELECT a.w, a.name, b.name AS asset, s.lag, corr(a.v, b.v) AS rho FROM rolled a CROSS JOIN (VALUES (0), (1)) s(lag) JOIN rolled b ON b.w = a.w AND b.r = a.r + s.lag
  WHERE a.role = 'driver' AND b.role = 'asset' GROUP BY ALL HAVING count(*) >= 10) c GROUP BY 1, 2""",
    "placed": f"""SELECT w, r, name, b, v, {square("r * 7919 + b * 104729 + CAST(substr(name, 2) AS BIGINT) * 1299709 + w * 15485863 + 1")} AS h
  FROM rolled CROSS JOIN (SELECT unnest(generate_series(1, 19)) AS b) WHERE role = 'driver'""",
    "mixed": """SELECT t.w, t.r, t.name, t.b, s.v FROM (SELECT *, row_number() OVER (PARTITION BY w, name, b ORDER BY r) AS k FROM placed) t
  JOIN (SELECT *, row_number() OVER (PARTITION BY w, name, b ORDER BY h, r) AS k FROM placed) s ON s.w = t.w AND s.name = t.name AND s.b = t.b AND s.k = t.k""",
    "nulls": """SELECT w, name, b, sum(abs(rho)) AS score FROM (SELECT a.w, a.name, a.b, s.lag, y.name AS asset, corr(a.v, y.v) AS rho FROM mixed a CROSS JOIN (VALUES (0), (1)) s(lag) JOIN rolled y ON y.w = a.w AND y.r = a.r + s.lag
  WHERE y.role = 'asset' GROUP BY ALL HAVING count(*) >= 10) c GROUP BY 1, 2, 3""",
    "pvals": "SELECT c.w, c.name, @r((1e0 + count(*) FILTER (WHERE round(n.score, 9) >= round(c.score, 9))) / (1 + count(*))) AS p FROM cumcorr c JOIN nulls n ON n.w = c.w AND n.name = c.name GROUP BY 1, 2",
    "reward": """SELECT q.w, CASE WHEN stddev_pop(x.g) < 1e-12 THEN 0e0 ELSE sqrt(52e0) * avg(x.g) / stddev_pop(x.g) END AS reward FROM wins q
  JOIN (SELECT c.r, p.g FROM port p JOIN cal c ON c.d = p.d) x ON x.r >= 13 * q.w + 104 AND x.r < 13 * q.w + 117 GROUP BY 1""",
    "infl": "SELECT l.w, l.src AS name, sum(abs(l.rho) / (SELECT count(*) FROM names)) AS influence FROM lagged l JOIN score s ON s.w = l.w AND s.name = l.src WHERE s.k <= 3 AND l.rs = 'driver' AND l.rd = 'asset' GROUP BY 1, 2",
    "cred": "SELECT i.w, i.name, i.influence, r.reward * i.influence / sum(i.influence) OVER (PARTITION BY i.w) AS credit FROM infl i JOIN reward r ON r.w = i.w",
    "util": """SELECT g.w, g.name, coalesce(sum(0.3e0 * power(0.7e0, c.later) * c.credit), 0e0) AS u FROM (SELECT q.w, n.name FROM wins q CROSS JOIN (SELECT DISTINCT name FROM cred) n) g
  LEFT JOIN (SELECT a.w AS upto, b.w, b.name, b.credit, (SELECT count(*) FROM cred x WHERE x.name = b.name AND x.w > b.w AND x.w <= a.w) AS later FROM wins a JOIN cred b ON b.w <= a.w) c ON c.upto = g.w AND c.name = g.name GROUP BY 1, 2""",
    "wt": "SELECT c.r AS t, x.name, x.w FROM capw x JOIN cal c ON c.d = x.d WHERE c.r % 21 = 0",
    "rt": "SELECT c.r, x.name, exp(x.v) - 1 AS v FROM ret x JOIN cal c ON c.d = x.d WHERE x.v IS NOT NULL",
    "turn": "SELECT t, turnover FROM (SELECT coalesce(a.t, b.t + 21) AS t, 0.5e0 * sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover FROM wt a FULL OUTER JOIN wt b ON a.name = b.name AND a.t = b.t + 21 GROUP BY 1) x WHERE t IN (SELECT t FROM wt)",
    "held": """SELECT g.r, k.t AS reb, sum(k.w * coalesce(x.v, 0)) AS gross, avg(coalesce(x.v, 0)) AS equal FROM (SELECT DISTINCT r FROM rt) g JOIN wt k ON g.r > k.t AND g.r <= k.t + 21 LEFT JOIN rt x ON x.r = g.r AND x.name = k.name GROUP BY 1, 2""",
    "netted": "SELECT h.r, h.reb, h.gross, h.equal, h.gross - CASE WHEN h.r = min(h.r) OVER (PARTITION BY h.reb) THEN k.turnover * 0.0005e0 ELSE 0e0 END AS net, k.turnover FROM held h JOIN turn k ON k.t = h.reb",
    "two": "SELECT a.d, a.g, b.g AS h FROM capport a JOIN port b ON b.d = a.d",
    "edge": "SELECT w, src, dst, weight FROM edges",
}


def _u(salt: int) -> str:
    return f"({square(f'b * 1103515245 + k * 12345 + {salt}')} + 0.5e0) / 2147483647e0"


def _draws(source: str, columns: str, replicates: int) -> str:
    """Stationary-bootstrap replicates: blocks of 1 + Geometric(1/10) rows from a congruential hash."""
    return f"""rows AS (SELECT {columns}, row_number() OVER (ORDER BY d) - 1 AS r FROM {source}), sz AS (SELECT count(*) AS n FROM {source}),
bk AS (SELECT b, k, n, CAST(floor({_u(7)} * n) AS BIGINT) AS start, least(1 + greatest(1, CAST(ceil(ln({_u(7926)}) / ln(0.9e0)) AS BIGINT)), n) AS size
  FROM (SELECT unnest(generate_series(1, {replicates})) AS b) x CROSS JOIN sz CROSS JOIN LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k) y),
pl AS (SELECT *, CAST(sum(size) OVER (PARTITION BY b ORDER BY k) - size AS BIGINT) AS went FROM bk),
dr AS (SELECT b, went + i AS pos, (start + i) % n AS r FROM (SELECT *, unnest(range(0, least(size, n - went))) AS i FROM pl WHERE went < n) z),
got AS (SELECT dr.b, rows.* FROM dr JOIN rows ON rows.r = dr.r)"""


_S = "CASE WHEN stddev_pop({0}) < 1e-12 THEN 0e0 ELSE sqrt(52e0) * avg({0}) / stddev_pop({0}) END"
_WALK = """-- recursive
WITH walk AS (SELECT w, src, dst, weight AS effect, CAST(1 AS BIGINT) AS n, 1 AS depth FROM dag UNION ALL
SELECT p.w, p.src, e.dst, sum(p.effect * e.weight), CAST(sum(p.n) AS BIGINT), p.depth + 1 FROM walk p JOIN dag e ON e.w = p.w AND e.src = p.dst GROUP BY p.w, p.src, e.dst, p.depth),
total AS (SELECT w, src, dst, sum(effect) AS effect, CAST(sum(n) AS BIGINT) AS paths FROM walk GROUP BY w, src, dst)
"""
_FROM_A0 = """-- recursive
WITH walk AS (SELECT w, dst, concat(src, '>', dst) AS path, weight AS effect FROM dag WHERE src = 'A0' UNION ALL
SELECT p.w, e.dst, concat(p.path, '>', e.dst), p.effect * e.weight FROM walk p JOIN dag e ON e.w = p.w AND e.src = p.dst WHERE p.dst <> 'D5')
"""

TEXTS = {
    "level_passthrough": "SELECT d, name, @r(price) AS v FROM px WHERE price IS NOT NULL",
    "asof_macro_daily": "SELECT c.d, c.name, @r(m.v) AS v FROM (SELECT cal.d, n.name FROM cal CROSS JOIN (SELECT DISTINCT name FROM monthly) n) c ASOF LEFT JOIN monthly m ON m.name = c.name AND m.m <= c.d",
    "asof_gap_lookup": "SELECT c.d, c.name, @r(m.v) AS v FROM (SELECT cal.d, CAST(cal.d - INTERVAL 21 DAY AS DATE) AS k, n.name FROM cal CROSS JOIN (SELECT DISTINCT name FROM monthly) n) c ASOF LEFT JOIN monthly m ON m.name = c.name AND m.m <= c.k",
    "asof_forward_leak": "SELECT c.d, c.name, @r(m.v) AS v FROM (SELECT cal.d, CAST(cal.d + INTERVAL 21 DAY AS DATE) AS k, n.name FROM cal CROSS JOIN (SELECT DISTINCT name FROM monthly) n) c ASOF LEFT JOIN monthly m ON m.name = c.name AND m.m <= c.k",
    "joint_eligibility": "SELECT f.d, n.name, coalesce(x.price, 0e0) + 0e0 AS raw_price, x.price IS NOT NULL AS eligible FROM (SELECT d FROM raw GROUP BY d HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM raw)) f CROSS JOIN names n LEFT JOIN px x ON x.d = f.d AND x.name = n.name",
    "eligible_in_window": "SELECT q.w, n.name, count(x.price) = 40 AS eligible FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 40) // 20 FROM days))) AS w) q JOIN days t ON t.r >= 20 * q.w AND t.r < 20 * q.w + 40 CROSS JOIN names n LEFT JOIN daily x ON x.d = t.d AND x.name = n.name GROUP BY 1, 2",
    "rolling_windows": "SELECT q.w, min(c.r) AS start_row, max(c.r) + 1 AS end_row, min(c.d) AS start_date, max(c.d) AS end_date FROM wins q JOIN cal c ON c.r >= 13 * q.w AND c.r < 13 * q.w + 104 WHERE EXISTS (SELECT 1 FROM panel p WHERE p.r = c.r) GROUP BY 1",
    "ticker_normalise": "SELECT DISTINCT s_name, replace(upper(trim(replace(s_name, '#', '.'))), '.', '-') AS ticker FROM supplier",
    "symbol_clean": "SELECT DISTINCT split_part(split_part(trim(replace(s_name, '#', '[')), ' ', 1), '[', 1) AS symbol, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "trailing_window": "SELECT q.reb, p.name, @r(avg(p.v)) AS mean, @r(stddev_samp(p.v)) AS sd, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 1) // 21 FROM cal))) AS reb) q JOIN panel p ON p.r >= 21 * q.reb - 52 AND p.r < 21 * q.reb GROUP BY 1, 2",
    "cumcorr_topk": "SELECT w, name, score, k FROM (SELECT w, name, score, row_number() OVER (PARTITION BY w ORDER BY score DESC, name) AS k FROM cumcorr) x WHERE k <= 3",
    "alpha_blend_pool": """SELECT w, name, @r(a * CASE WHEN s1 < 1e-12 THEN 0e0 ELSE (score - m1) / s1 END + (1 - a) * CASE WHEN s2 < 1e-12 THEN 0e0 ELSE (u - m2) / s2 END) AS blended FROM (
  SELECT *, CASE WHEN w < 6 THEN 1e0 ELSE 0.7e0 END AS a, avg(score) OVER (PARTITION BY w) AS m1, stddev_pop(score) OVER (PARTITION BY w) AS s1, avg(u) OVER (PARTITION BY w) AS m2, stddev_pop(u) OVER (PARTITION BY w) AS s2
  FROM (SELECT s.w, s.name, s.abs_sum AS score, coalesce(u.u, 0e0) AS u FROM score s LEFT JOIN util u ON u.name = s.name AND u.w = s.w - 1) x) y WHERE score > 0""",
    "mc_pvalues": "SELECT w, name, p FROM pvals",
    "bh_fdr": "SELECT a.w, a.name, a.p, EXISTS (SELECT 1 FROM pvals b WHERE b.w = a.w AND b.p >= a.p AND b.p <= 0.1e0 * (SELECT count(*) FROM pvals c WHERE c.w = a.w AND c.p <= b.p) / (SELECT count(*) FROM pvals c WHERE c.w = a.w) + 1e-12) AS selected FROM pvals a",
    "selected_jaccard": "SELECT a.w, @r(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s)))) AS jaccard FROM (SELECT w, list(name) AS s FROM score WHERE k <= 2 GROUP BY w) a JOIN (SELECT w, list(name) AS s FROM score WHERE k <= 2 GROUP BY w) b ON b.w = a.w - 1",
    "checkpoint_resume": "SELECT w FROM wins WHERE w NOT IN (SELECT w FROM edges WHERE w % 2 = 0)",
    "holding_returns": "SELECT q.reb, x.d, @r(avg(exp(x.v) - 1)) AS gross FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 27) // 21 FROM cal))) AS reb) q JOIN cal c ON c.r > 26 + 21 * q.reb AND c.r <= 47 + 21 * q.reb JOIN ret x ON x.d = c.d WHERE x.v IS NOT NULL GROUP BY 1, 2",
    "holding_reward": f"SELECT reb, @r({_S.format('g')}) AS reward FROM (SELECT q.reb, x.d, avg(exp(x.v) - 1) AS g FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 27) // 21 FROM cal))) AS reb) q JOIN cal c ON c.r > 26 + 21 * q.reb AND c.r <= 47 + 21 * q.reb JOIN ret x ON x.d = c.d WHERE x.v IS NOT NULL GROUP BY 1, 2) y GROUP BY reb",
    "turnover": "SELECT t AS r, @r(turnover) AS turnover FROM turn",
    "net_of_costs": "SELECT r, reb, @r(gross) AS gross, @r(net) AS net FROM netted",
    "backtest_summary": f"SELECT reb, CAST(count(*) AS BIGINT) AS days, @r(exp(sum(ln(1 + gross))) - 1) AS gross, @r(exp(sum(ln(1 + net))) - 1) AS net, @r(max(turnover)) AS turnover, @r({_S.format('net')} - {_S.format('equal')}) AS reward FROM netted GROUP BY reb",
    "performance_summary": f"""SELECT s.n, s.sharpe, @r(s.sortino) AS sortino, @r(s.cagr) AS cagr, @r(s.vol) AS vol, @r(s.downside) AS downside, @r(52 * (s.m - 0.5e0 * s.v)) AS cer_1, @r(52 * (s.m - 1.5e0 * s.v)) AS cer_3, @r(52 * (s.m - 2.5e0 * s.v)) AS cer_5,
  @r(f.mdd) AS mdd, @r(s.cagr / abs(f.mdd)) AS calmar, @r(z.hhi) AS hhi, @r(z.e) AS effective_n, @r(z.mw) AS max_weight, @r(k.t * 52 / s.n) AS turnover, u.longest AS underwater
  FROM (SELECT CAST(count(*) AS BIGINT) AS n, @r({_S.format('g')}) AS sharpe, sqrt(52e0) * avg(g) / sqrt(avg(g * g) FILTER (WHERE g < 0)) AS sortino, power(product(1 + g), 52e0 / count(*)) - 1 AS cagr, stddev_pop(g) * sqrt(52e0) AS vol, sqrt(avg(g * g) FILTER (WHERE g < 0)) * sqrt(52e0) AS downside, avg(g) AS m, var_pop(g) AS v FROM port) s
  CROSS JOIN (SELECT min(nav / peak - 1) AS mdd FROM (SELECT nav, max(nav) OVER (ORDER BY d) AS peak FROM nav) x) f
  CROSS JOIN (SELECT avg(h) AS hhi, avg(1 / h) AS e, avg(mw) AS mw FROM (SELECT t, sum(w * w) AS h, max(w) AS mw FROM wt GROUP BY t) y) z CROSS JOIN (SELECT sum(turnover) AS t FROM turn) k
  CROSS JOIN (SELECT CAST(coalesce(max(c), 0) AS BIGINT) AS longest FROM (SELECT count(*) AS c FROM (SELECT r, r - row_number() OVER (ORDER BY r) AS g FROM (SELECT row_number() OVER (ORDER BY d) AS r, nav < max(nav) OVER (ORDER BY d) - 1e-12 AS under FROM nav) a WHERE under) b GROUP BY g) c) u""",
    "sortino": "SELECT @r(CASE WHEN count(*) FILTER (WHERE g < 0) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE sqrt(52e0) * avg(g) / sqrt(avg(g * g) FILTER (WHERE g < 0)) END) AS sortino FROM port",
    "stationary_bootstrap": f"WITH {_draws('port', 'g', 40)}\nSELECT b, @r(avg(g)) AS mean FROM got GROUP BY b",
    "bootstrap_sharpe_ci": f"WITH {_draws('port', 'g', 200)},\neach AS (SELECT b, {_S.format('g')} AS s FROM got GROUP BY b)\nSELECT (SELECT @r({_S.format('g')}) FROM port) AS estimate, @r(quantile_cont(s, 0.025)) AS lo, @r(quantile_cont(s, 0.975)) AS hi FROM each",
    "bootstrap_sharpe_difference": f"WITH {_draws('two', 'g, h', 200)},\neach AS (SELECT b, {_S.format('g')} - {_S.format('h')} AS s FROM got GROUP BY b), est AS (SELECT {_S.format('g')} - {_S.format('h')} AS e FROM two)\nSELECT @r(max(e)) AS estimate, @r(quantile_cont(s, 0.025)) AS lo, @r(quantile_cont(s, 0.975)) AS hi, @r(least(1e0, 2e0 * CASE WHEN max(e) >= 0 THEN count(*) FILTER (WHERE s <= 0) ELSE count(*) FILTER (WHERE s >= 0) END / count(*))) AS p FROM each CROSS JOIN est",
    "credit_attribution": "SELECT w, name, @r(influence) AS influence, @r(credit) AS credit FROM cred",
    "ema_utility": "SELECT w, name, @r(u) AS u FROM util",
    "graph_density": "SELECT w, CAST(count(*) AS BIGINT) AS n_edges, @r(count(*) / (SELECT count(DISTINCT name) * (count(DISTINCT name) - 1e0) FROM panel)) AS density, @r(avg(abs(weight))) AS mean_weight FROM edges GROUP BY w",
    "graph_distance": "SELECT q.w, @r(sqrt(sum(power(coalesce(a.weight, 0e0) - coalesce(b.weight, 0e0), 2)))) AS dist FROM wins q CROSS JOIN (SELECT DISTINCT src, dst FROM edge) e LEFT JOIN edge a ON a.w = q.w AND a.src = e.src AND a.dst = e.dst LEFT JOIN edge b ON b.w = q.w - 1 AND b.src = e.src AND b.dst = e.dst WHERE q.w > 0 AND (a.w IS NOT NULL OR b.w IS NOT NULL) GROUP BY 1",
    "edge_jaccard": "SELECT q.w, @r(CAST(count(*) FILTER (WHERE a.w IS NOT NULL AND b.w IS NOT NULL) AS DOUBLE) / count(*)) AS jaccard FROM wins q CROSS JOIN (SELECT DISTINCT src, dst FROM edge) e LEFT JOIN edge a ON a.w = q.w AND a.src = e.src AND a.dst = e.dst LEFT JOIN edge b ON b.w = q.w - 1 AND b.src = e.src AND b.dst = e.dst WHERE q.w > 0 AND (a.w IS NOT NULL OR b.w IS NOT NULL) GROUP BY 1",
    "graph_compare": """SELECT w, @r(sqrt(sum(power(x - y, 2)))) AS frobenius, @r(CAST(count(*) FILTER (WHERE x <> 0 AND y <> 0) AS DOUBLE) / count(*)) AS jaccard, @r(CAST(count(*) FILTER (WHERE x * y > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE x <> 0 AND y <> 0), 0)) AS sign_agreement, @r(corr(x, y)) AS weight_corr
  FROM (SELECT coalesce(a.w, b.w) AS w, coalesce(a.weight, 0e0) AS x, coalesce(b.rho, 0e0) AS y FROM edge a FULL OUTER JOIN (SELECT w, a AS src, b AS dst, round(rho, 6) AS rho FROM pairs WHERE abs(round(rho, 6)) >= 0.12e0) b ON a.w = b.w AND a.src = b.src AND a.dst = b.dst) z GROUP BY w""",
    "edge_probability": "SELECT src, dst, @r(count(*) FILTER (WHERE abs(rho) > 0.12e0) / (SELECT CAST(count(*) AS DOUBLE) FROM wins)) AS prob FROM lagged WHERE src <> dst GROUP BY 1, 2 HAVING count(*) FILTER (WHERE abs(rho) > 0.12e0) > 0",
    "total_effect_paths": _WALK + "SELECT w, src, dst, @r(effect) AS effect, paths FROM total",
    "total_effect_summary": _WALK + "SELECT src, dst, @r(count(*) FILTER (WHERE abs(effect) > 0.01e0) / (SELECT CAST(count(*) AS DOUBLE) FROM wins)) AS prob, @r(quantile_cont(effect, 0.5) FILTER (WHERE effect <> 0)) AS median FROM total GROUP BY 1, 2",
    "intervention_effect": _WALK + "SELECT t.w, t.src, t.dst, @r(m.mean + s.sd * t.effect) AS raised, @r(m.mean - s.sd * t.effect) AS lowered FROM total t JOIN (SELECT w, name, stddev_pop(v) AS sd FROM rolled GROUP BY 1, 2) s ON s.w = t.w AND s.name = t.src JOIN (SELECT w, name, avg(v) AS mean FROM rolled GROUP BY 1, 2) m ON m.w = t.w AND m.name = t.dst",
    "distance_from_roots": "-- recursive\nWITH walk AS (SELECT DISTINCT d.w, d.src AS node, 0 AS depth FROM dag d LEFT JOIN dag p ON p.w = d.w AND p.dst = d.src WHERE p.src IS NULL UNION SELECT e.w, e.dst, p.depth + 1 FROM walk p JOIN dag e ON e.w = p.w AND p.node = e.src)\nSELECT w, node, max(depth) AS depth FROM walk GROUP BY 1, 2",
    "markov_blanket": "SELECT w, node, other FROM (SELECT w, dst AS node, src AS other FROM dag UNION SELECT w, src, dst FROM dag UNION SELECT a.w, a.src, b.src FROM dag a JOIN dag b ON a.w = b.w AND a.dst = b.dst WHERE a.src <> b.src) x",
    "shd_accuracy": """SELECT w, CAST(x AS BIGINT) AS extra, CAST(m AS BIGINT) AS missing, CAST(v AS BIGINT) AS reversed, CAST(x + v + m AS BIGINT) AS shd, @r((x + v) / n) AS fdr, @r(tp / k) AS tpr, @r((x + v) / greatest(d * (d - 1) / 2 - k, 1)) AS fpr, @r(tp / n) AS precision, CAST(n AS BIGINT) AS nnz FROM (
  SELECT e.w, CAST(count(*) AS DOUBLE) AS n, CAST(count(t.src) AS DOUBLE) AS tp, count(*) FILTER (WHERE t.src IS NULL AND r.src IS NOT NULL) AS v, count(*) FILTER (WHERE t.src IS NULL AND r.src IS NULL) AS x,
    (SELECT count(*) FROM dag z WHERE z.w = 0 AND NOT EXISTS (SELECT 1 FROM found y WHERE y.w = e.w AND ((y.src = z.src AND y.dst = z.dst) OR (y.src = z.dst AND y.dst = z.src)))) AS m, (SELECT CAST(count(*) AS DOUBLE) FROM dag WHERE w = 0) AS k, (SELECT CAST(count(DISTINCT name) AS DOUBLE) FROM panel) AS d
  FROM found e LEFT JOIN dag t ON t.w = 0 AND t.src = e.src AND t.dst = e.dst LEFT JOIN dag r ON r.w = 0 AND r.src = e.dst AND r.dst = e.src GROUP BY e.w) q""",
    "path_probability": _FROM_A0 + "SELECT path, @r(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM wins)) AS prob, @r(quantile_cont(effect, 0.5)) AS effect FROM walk WHERE dst = 'D5' GROUP BY path",
    "path_total_effect": _FROM_A0 + "SELECT w, path, @r(effect) AS effect FROM walk WHERE dst = 'D5'",
    "common_edge_across": "SELECT src, dst, @r(CASE WHEN count(*) < 3 THEN 0e0 ELSE product(p) END) AS prob FROM (SELECT y.g, y.src, y.dst, y.k / z.n AS p FROM (SELECT w % 3 AS g, src, dst, CAST(count(*) AS DOUBLE) AS k FROM edge GROUP BY 1, 2, 3) y JOIN (SELECT w % 3 AS g, count(*) AS n FROM wins GROUP BY 1) z ON z.g = y.g) x GROUP BY 1, 2",
    "common_edge_per": "SELECT src, dst, @r(count(*) FILTER (WHERE n = 3) / (SELECT CAST(count(*) // 3 AS DOUBLE) FROM wins)) AS prob FROM (SELECT w // 3 AS i, src, dst, count(*) AS n FROM edge WHERE w < 3 * (SELECT count(*) // 3 FROM wins) GROUP BY 1, 2, 3) x GROUP BY 1, 2",
    "exogenous_and_sinks": "SELECT w, node, bool_and(NOT p) AS exogenous, bool_and(NOT c) AS sink FROM (SELECT w, src AS node, false AS p, true AS c FROM dag UNION ALL SELECT w, dst, true, false FROM dag) x GROUP BY 1, 2",
    "target_subgraph": "-- recursive\nWITH strong AS (SELECT w, src, dst, weight FROM edges WHERE abs(weight) >= 0.25e0), seen AS (SELECT DISTINCT w, 'A0' AS node FROM strong WHERE src = 'A0' OR dst = 'A0' UNION SELECT e.w, CASE WHEN e.src = s.node THEN e.dst ELSE e.src END FROM seen s JOIN strong e ON e.w = s.w AND (e.src = s.node OR e.dst = s.node))\nSELECT e.w, e.src, e.dst, @r(e.weight) AS weight FROM strong e JOIN seen s ON s.w = e.w AND s.node = e.src",
    "discretise_percentiles": "SELECT CAST((l_extendedprice >= q[1])::INT + (l_extendedprice >= q[2])::INT + (l_extendedprice >= q[3])::INT AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem CROSS JOIN (SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.1, 0.5, 0.9]) AS q FROM lineitem) t GROUP BY 1",
}
TEXTS["joint_eligibility"] = "SELECT d, name, @r(raw_price) AS price, eligible FROM (" + TEXTS["joint_eligibility"] + ") x"
VIEWS["found"] = "SELECT w, src, dst FROM edges WHERE src < dst OR weight > 0.2e0"
