"""The engine's SQL-expressible operators as catalogue queries, by family."""

from __future__ import annotations

from . import oracle
from .fixtures import VIEWS
from .runs import RUNS
from .sql import Catalogue

_SHARPE = "CASE WHEN stddev_pop({0}) < 1e-12 THEN 0e0 ELSE sqrt(52e0) * avg({0}) / stddev_pop({0}) END"

PANEL = {
    "log_return_panel": "SELECT d, name, @r(v) AS v FROM ret WHERE v IS NOT NULL",
    "simple_return_panel": "SELECT d, name, @r(v) AS v FROM (SELECT d, name, price / lag(price) OVER (PARTITION BY name ORDER BY d) - 1 AS v FROM px) x WHERE v IS NOT NULL",
    "first_difference": "SELECT d, name, @r(v) AS v FROM (SELECT d, name, price - lag(price) OVER (PARTITION BY name ORDER BY d) AS v FROM px) x WHERE v IS NOT NULL",
    "yoy_pct_monthly": "SELECT a.m, a.name, @r(a.v / b.v - 1) AS yoy FROM monthly a JOIN monthly b ON a.name = b.name AND b.m = CAST(a.m - INTERVAL '12' MONTH AS DATE)",
    "yoy_diff_monthly": "SELECT a.m, a.name, @r(a.v - b.v) AS yoy FROM monthly a JOIN monthly b ON a.name = b.name AND b.m = CAST(a.m - INTERVAL '12' MONTH AS DATE)",
    "ffill_limit5": "SELECT d, name, @r(@known(price) OVER (PARTITION BY name ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) AS price FROM (SELECT t.d, n.name, x.price FROM days t CROSS JOIN names n LEFT JOIN daily x ON x.d = t.d AND x.name = n.name) g",
    "spine_join": "SELECT t.d, n.name, @r(x.price) AS price FROM days t CROSS JOIN names n LEFT JOIN daily x ON x.d = t.d AND x.name = n.name",
    "derived_spread_ratio": "SELECT a.d, @r(a.price - b.price) AS spread, @r(a.price / b.price) AS ratio FROM px a JOIN px b ON a.d = b.d AND a.name = 'A0' AND b.name = 'A1'",
    "availability_gate": "SELECT d, name, CASE WHEN d >= DATE '1997-01-01' THEN @r(price) END AS price FROM px",
    "backend_cascade": "SELECT d, name, @r(price) AS price, src FROM (SELECT d, name, price, src, row_number() OVER (PARTITION BY d, name ORDER BY src) AS k FROM (SELECT d, name, price, 0 AS src FROM px WHERE volume > 500 UNION ALL SELECT d, name, price, 1 AS src FROM px) u) x WHERE k = 1",
    "joint_drop_any": "SELECT t.d, t.name, @r(t.price) AS price FROM daily t JOIN (SELECT d FROM daily GROUP BY d HAVING count(*) = (SELECT count(*) FROM names)) f ON f.d = t.d",
    "sparse_asset_drop": "SELECT x.name, @n(count(*)) AS n FROM daily x CROSS JOIN (SELECT count(*) AS t FROM days) s GROUP BY x.name, s.t HAVING count(*) >= 0.95 * s.t",
    "coverage_report": "SELECT x.d, @n(count(*)) AS resolved, @r(count(*) / max(s.n)) AS coverage, count(*) / max(s.n) < 0.95 AS short FROM daily x CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM names) s GROUP BY x.d",
    "zscore_window": "SELECT w, r, name, @r((v - avg(v) OVER (PARTITION BY w, name)) / greatest(stddev_pop(v) OVER (PARTITION BY w, name), 1e-12)) AS z FROM rolled",
    "standardise_global": "SELECT d, name, @r((v - avg(v) OVER (PARTITION BY name)) / nullif(stddev_pop(v) OVER (PARTITION BY name), 0e0)) AS z FROM ret WHERE v IS NOT NULL",
    "rolling_cov": "SELECT w, a, b, @r(cov) AS cov FROM pairs",
    "rolling_corr": "SELECT w, a, b, @r(rho) AS rho FROM pairs",
    "pairwise_complete_corr": "SELECT a.name AS a, b.name AS b, @r(@corr(a.v; b.v)) AS rho, @n(count(*)) AS n FROM panel a JOIN panel b ON a.r = b.r AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 10",
    "lagged_design": "SELECT r, name, k, @r(lagged_v) AS lagged_v FROM (SELECT r, name, 1 AS k, lag(v, 1) OVER (PARTITION BY name ORDER BY r) AS lagged_v FROM panel UNION ALL SELECT r, name, 2 AS k, lag(v, 2) OVER (PARTITION BY name ORDER BY r) AS lagged_v FROM panel) x WHERE lagged_v IS NOT NULL",
    "var_moments": "SELECT a.w, a.name AS a, b.name AS b, @r(sum(a.v * b.v) * 1000) AS xy FROM rolled a JOIN rolled b ON a.w = b.w AND b.r = a.r + 1 GROUP BY 1, 2, 3",
    "realisation_cut": "SELECT name, min(d) AS first_d, max(d) AS last_d, @n(count(*)) AS n FROM (SELECT name, d, sum(cut) OVER (PARTITION BY name ORDER BY r) AS g FROM (SELECT x.name, x.d, t.r, CASE WHEN t.r - lag(t.r) OVER (PARTITION BY x.name ORDER BY t.r) > 1 THEN 1 ELSE 0 END AS cut FROM daily x JOIN days t ON x.d = t.d) a) b GROUP BY name, g",
    "chronological_split": "SELECT name, r, row_number() OVER (PARTITION BY name ORDER BY r) <= floor(0.8e0 * count(*) OVER (PARTITION BY name)) AS train FROM panel",
    "every_nth_row": "SELECT d, r FROM cal WHERE r >= 26 AND (r - 26) % 13 = 0",
    "overlap_guard": "SELECT a.name AS asset, b.name AS driver, @n(count(*)) AS common FROM ret a JOIN dret b ON a.d = b.d WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2",
    "hourly_events": "SELECT h, event_type, n, @r(v) AS v FROM hourly",
    "interval_overlap": "SELECT a.q AS qa, b.q AS qb, a.name FROM member a JOIN member b ON a.name = b.name AND b.q > a.q AND @days(a.q; b.q) <= 100",
}

UNIVERSE = {
    "membership_snapshots": "SELECT q, @list(name) AS names FROM member GROUP BY q",
    "membership_asof": "SELECT d, @list(m.name) AS names FROM (SELECT c.d, max(s.q) AS q FROM cal c JOIN snaps s ON s.q <= c.d GROUP BY c.d) x JOIN member m ON m.q = x.q GROUP BY d",
    "top_n_by_mcap": "SELECT d, name, @r(mcap / 1e6) AS mcap_millions, @n(k) AS k FROM (SELECT x.d, x.name, x.price * s.shares AS mcap, row_number() OVER (PARTITION BY x.d ORDER BY round(x.price * s.shares, 6) DESC, x.name) AS k FROM px x JOIN shares s ON x.name = s.name) y WHERE k <= 3",
    "union_of_universes": "SELECT DISTINCT name FROM member WHERE q IN (SELECT q FROM snaps WHERE month(q) = 1)",
    "ever_members": "SELECT DISTINCT m.name FROM member m WHERE m.q >= (SELECT max(q) FROM snaps WHERE q <= DATE '1996-05-15') AND m.q <= DATE '1997-05-15'",
    "intersection_universe": "SELECT name FROM member WHERE q = (SELECT max(q) FROM snaps WHERE q <= DATE '1996-05-15') EXCEPT SELECT name FROM changes WHERE added = 0 AND q > DATE '1996-05-15' AND q <= DATE '1996-12-31'",
    "membership_changes": "SELECT q, name, added FROM changes",
    "replay_undo_membership": "SELECT n.name, coalesce(x.member, CASE WHEN l.name IS NULL THEN 0 ELSE 1 END) = 1 AS member FROM names n LEFT JOIN (SELECT name, 1 - added AS member FROM (SELECT name, added, row_number() OVER (PARTITION BY name ORDER BY q) AS k FROM changes WHERE q > DATE '1998-01-01') y WHERE k = 1) x ON x.name = n.name LEFT JOIN (SELECT name FROM member WHERE q = (SELECT max(q) FROM snaps)) l ON l.name = n.name",
    "latest_row_per_key": "SELECT name, d, @r(price) AS price FROM (SELECT name, d, price, row_number() OVER (PARTITION BY name ORDER BY d DESC) AS k FROM px WHERE d <= DATE '1998-06-30') x WHERE k = 1",
    "cap_weights": "SELECT d, name, @r(w) AS w FROM capw",
}

SELECTION = {
    "stage_a_scores": "SELECT e.w, e.src, @r(sum(CASE WHEN abs(e.rho) >= t.thr THEN abs(e.rho) ELSE 0e0 END)) AS score FROM lagged e JOIN (SELECT w, @pct(abs(rho); 0.9) - 1e-9 AS thr FROM lagged WHERE rs = 'driver' AND rd = 'asset' AND rho <> 0 GROUP BY w) t ON t.w = e.w WHERE e.rs = 'driver' AND e.rd = 'asset' GROUP BY 1, 2",
    "kneedle_k": "SELECT w, min(k) AS knee FROM (SELECT w, k, gap, max(gap) OVER (PARTITION BY w) AS top FROM (SELECT w, k, round(abs((k - 1e0) / (count(*) OVER (PARTITION BY w) - 1) + (abs_sum - min(abs_sum) OVER (PARTITION BY w)) / nullif(max(abs_sum) OVER (PARTITION BY w) - min(abs_sum) OVER (PARTITION BY w), 0e0) - 1) / sqrt(2e0), 9) AS gap FROM score) x) y WHERE gap = top GROUP BY w",
    "tabu_edges": "SELECT a.name AS src, b.name AS dst, lag FROM (SELECT name FROM names) a CROSS JOIN (SELECT DISTINCT name FROM raw) b CROSS JOIN (SELECT @seq(0; 2) AS lag) l",
}

PORTFOLIO = {
    "equal_weight_nav": "SELECT d, @r(g) AS g, @r(nav) AS nav FROM nav",
    "cap_weight_nav": "SELECT d, @r(g) AS g, @r(exp(sum(ln(1 + g)) OVER (ORDER BY d))) AS nav FROM capport",
    "certainty_equivalent": "SELECT gamma, @r(52 * (avg(g) - 0.5e0 * gamma * var_pop(g))) AS cer FROM port CROSS JOIN (SELECT @seq(1; 5) AS gamma) x WHERE gamma IN (1, 3, 5) GROUP BY gamma",
    "max_drawdown": "SELECT @r(min(nav / peak - 1)) AS mdd FROM (SELECT nav, max(nav) OVER (ORDER BY d) AS peak FROM nav) x",
    "calmar": "SELECT @r((exp(sum(ln(1 + g)) * 52 / count(*)) - 1) / nullif(abs(min(nav / peak - 1)), 0e0)) AS calmar FROM (SELECT g, nav, max(nav) OVER (ORDER BY d) AS peak FROM nav) x",
    "time_underwater": "SELECT @n(coalesce(max(n), 0)) AS longest FROM (SELECT g, count(*) AS n FROM (SELECT under, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY under ORDER BY d) AS g FROM (SELECT d, CASE WHEN nav < max(nav) OVER (ORDER BY d) - 1e-12 THEN 1 ELSE 0 END AS under FROM nav) a) b WHERE under = 1 GROUP BY g) c",
    "hhi_effective_n": "SELECT d, @r(sum(w * w)) AS hhi, @r(1 / nullif(sum(w * w), 0e0)) AS effective_n, @r(max(w)) AS max_weight FROM capw GROUP BY d",
    "regime_masks": "SELECT p.d, p.g <= t.lo AS low, p.g >= t.hi AS high FROM (SELECT d, round(g, 9) AS g FROM port) p CROSS JOIN (SELECT @pct(round(g, 9); 0.2) AS lo, @pct(round(g, 9); 0.8) AS hi FROM port) t",
    "regime_summary": f"SELECT regime, @n(count(*)) AS n, @r({_SHARPE.format('g')}) AS sharpe FROM (SELECT 'all' AS regime, g FROM port UNION ALL SELECT CASE WHEN v > m THEN 'busy' ELSE 'calm' END AS regime, p.g FROM port p JOIN (SELECT d, sum(volume) AS v FROM px GROUP BY d) x ON x.d = p.d CROSS JOIN (SELECT @pct(v; 0.5) AS m FROM (SELECT sum(volume) AS v FROM px GROUP BY d) y) z) u GROUP BY regime",
    "sharpe_difference": f"SELECT @r(a.s - b.s) AS diff FROM (SELECT {_SHARPE.format('g')} AS s FROM capport) a CROSS JOIN (SELECT {_SHARPE.format('g')} AS s FROM port WHERE d IN (SELECT d FROM capport)) b",
    "sensitivity_distance": "SELECT a.label AS a, b.label AS b, @r(sqrt(sum((a.s - b.s) * (a.s - b.s)))) AS dist FROM dims a JOIN dims b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2",
    "cosine_corr": "SELECT a, b, @r(c) AS rho, @r(sqrt(0.5e0 * greatest(1 - c, 0e0))) AS dist FROM (SELECT a.label AS a, b.label AS b, sum(a.s * b.s) / greatest(sqrt(sum(a.s * a.s) * sum(b.s * b.s)), 1e-12) AS c FROM dims a JOIN dims b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2) x",
    "distance_concentration": "SELECT @r(stddev_pop(dist) / avg(dist)) AS concentration FROM (SELECT sqrt(sum((a.s - b.s) * (a.s - b.s))) AS dist FROM dims a JOIN dims b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label) x",
}

GRAPH = {
    "edge_threshold": "SELECT w, src, dst, @r(weight) AS weight FROM edges WHERE abs(weight) >= 0.2e0",
    "regime_change_flags": "SELECT w, dist > avg(dist) OVER () + 1.5e0 * stddev_pop(dist) OVER () AS flagged FROM (SELECT a.w, sqrt(sum(power(a.rho - b.rho, 2))) AS dist FROM lagged a JOIN lagged b ON a.w = b.w + 1 AND a.src = b.src AND a.dst = b.dst GROUP BY a.w) x",
    "sector_flow": "SELECT e.w, a.sector AS sector_from, b.sector AS sector_to, @r(sum(abs(e.weight)) / max(p.n)) AS flow FROM edges e JOIN sectors a ON a.name = e.src JOIN sectors b ON b.name = e.dst JOIN (SELECT x.sector AS sf, y.sector AS st, count(*) AS n FROM sectors x JOIN sectors y ON x.name <> y.name GROUP BY 1, 2) p ON p.sf = a.sector AND p.st = b.sector GROUP BY 1, 2, 3",
    "kendall_drift": "SELECT a.w, @r(avg(CASE WHEN (a.k - b.k) * (c.k - e.k) > 0 THEN 1e0 ELSE -1e0 END)) AS tau FROM score a JOIN score b ON a.w = b.w AND a.name < b.name JOIN score c ON c.w = a.w - 1 AND c.name = a.name JOIN score e ON e.w = a.w - 1 AND e.name = b.name GROUP BY a.w",
    "direction_counts": "SELECT src, dst, sgn, n FROM (SELECT src, dst, CAST(sign(weight) AS INT) AS sgn, @n(count(*)) AS n FROM edges GROUP BY 1, 2, 3) x WHERE n >= 3",
    "dag_counts": "SELECT pattern, @n(count(*)) AS n FROM (SELECT w, @list(concat(src, '>', dst)) AS pattern FROM edges WHERE abs(weight) >= 0.2e0 GROUP BY w) x GROUP BY pattern",
    "common_edges": "SELECT src, dst, min(sgn) AS sgn FROM (SELECT src, dst, w, CAST(sign(weight) AS INT) AS sgn FROM edges) x GROUP BY 1, 2 HAVING count(*) >= 5 AND min(sgn) = max(sgn)",
    "block_slice": "SELECT w, rs, rd, @n(count(*)) AS n, @r(sum(abs(weight))) AS total FROM edges GROUP BY 1, 2, 3",
    "pairwise_direction_score": "SELECT w, a, b, @r(avg(ln((exp(u) + exp(-u)) / 2)) - avg(ln((exp(t) + exp(-t)) / 2))) AS score FROM (SELECT a.w, a.name AS a, b.name AS b, (a.v - avg(a.v) OVER p) / stddev_pop(a.v) OVER p AS u, (b.v - avg(b.v) OVER p) / stddev_pop(b.v) OVER p AS t FROM rolled a JOIN rolled b ON a.w = b.w AND a.r = b.r AND a.name < b.name WINDOW p AS (PARTITION BY a.w, a.name, b.name)) x GROUP BY w, a, b",
}

BAYES = {
    "discretise_uniform": "SELECT least(@idiv((l_quantity - lo) * 4; (hi - lo)), 3) AS bin, @n(count(*)) AS n FROM lineitem CROSS JOIN (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) t GROUP BY 1",
    "discretise_quantile": "SELECT CASE WHEN l_extendedprice < q1 THEN 0 WHEN l_extendedprice < q2 THEN 1 ELSE 2 END AS bin, @n(count(*)) AS n FROM lineitem CROSS JOIN (SELECT @pct(l_extendedprice; 0.333) AS q1, @pct(l_extendedprice; 0.667) AS q2 FROM lineitem) t GROUP BY 1",
    "discretise_outlier": "SELECT CASE WHEN l_extendedprice < q1 THEN 0 WHEN l_extendedprice < q2 THEN 1 ELSE 2 END AS bin, @n(count(*)) AS n FROM lineitem CROSS JOIN (SELECT @pct(l_extendedprice; 0.05) AS q1, @pct(l_extendedprice; 0.95) AS q2 FROM lineitem) t GROUP BY 1",
    "discretise_fixed": "SELECT qty, disc, @n(sum(n)) AS n FROM bn GROUP BY 1, 2",
    "unique_row_counts": "SELECT flag, status, qty, disc, n FROM bn",
    "cpd_mle": "SELECT qty, disc, flag, @r(p) AS p FROM cpd",
    "cpd_k2": "SELECT qty, disc, flag, @r((n + 1e0) / (sum(n) OVER (PARTITION BY qty, disc) + count(*) OVER (PARTITION BY qty, disc))) AS p FROM cell",
    "cpd_bdeu": "SELECT qty, disc, flag, @r((n + 10e0 / 27) / (sum(n) OVER (PARTITION BY qty, disc) + 10e0 / 9)) AS p FROM cell",
    "bn_predict": "SELECT qty, disc, flag FROM (SELECT qty, disc, flag, row_number() OVER (PARTITION BY qty, disc ORDER BY round(p, 9) DESC, flag) AS k FROM cpd) x WHERE k = 1",
    "bn_marginal": "SELECT s.status, @r(sum(m.p * c.p * s.p)) AS p FROM cpd c JOIN marg m ON m.qty = c.qty AND m.disc = c.disc JOIN stat s ON s.flag = c.flag GROUP BY s.status",
    "bn_conditional": "SELECT qty, @r(p / sum(p) OVER ()) AS p FROM (SELECT c.qty, sum(m.p * c.p * s.p) AS p FROM cpd c JOIN marg m ON m.qty = c.qty AND m.disc = c.disc JOIN stat s ON s.flag = c.flag WHERE s.status = 'F' GROUP BY c.qty) x",
    "bn_do": "SELECT flag, @r(sum(p * pd)) AS p FROM (SELECT c.flag, c.p, d.p AS pd FROM cpd c JOIN (SELECT disc, sum(p) AS p FROM marg GROUP BY disc) d ON d.disc = c.disc WHERE c.qty = 2) x GROUP BY flag",
    "classification_report": "SELECT flag, @r(CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN said THEN n ELSE 0 END), 0)) AS prec, @r(CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN actual THEN n ELSE 0 END), 0)) AS recall FROM (SELECT f.flag, c.n, c.flag = f.flag AND b.flag = f.flag AS hit, b.flag = f.flag AS said, c.flag = f.flag AS actual FROM cell c JOIN (SELECT qty, disc, flag FROM (SELECT qty, disc, flag, row_number() OVER (PARTITION BY qty, disc ORDER BY round(p, 9) DESC, flag) AS k FROM cpd) x WHERE k = 1) b ON b.qty = c.qty AND b.disc = c.disc CROSS JOIN (SELECT DISTINCT flag FROM bn) f) y GROUP BY flag",
    "roc_auc": "SELECT @r((sum(CASE WHEN pos THEN rk * n ELSE 0 END) - np * (np + 1) / 2) / (np * nn)) AS auc FROM (SELECT pos, n, below + (tied + 1e0) / 2 AS rk, sum(CASE WHEN pos THEN n ELSE 0 END) OVER () AS np, sum(CASE WHEN pos THEN 0 ELSE n END) OVER () AS nn FROM (SELECT c.flag = 'R' AS pos, c.n, t.below, t.tied FROM cell c JOIN (SELECT qty, disc, s, tied, coalesce(sum(g) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT c.qty, c.disc, round(max(CASE WHEN p.flag = 'R' THEN p.p END), 9) AS s, sum(c.n) / 3 AS tied, sum(c.n) / 3 AS g FROM cell c JOIN cpd p ON p.qty = c.qty AND p.disc = c.disc GROUP BY 1, 2) u) t ON t.qty = c.qty AND t.disc = c.disc) x) y GROUP BY np, nn",
    "lewis_scores": "SELECT @r(greatest(0e0, least(1e0, sum((p2 - p0) * pc)))) AS nesuf FROM (SELECT d.disc, d.p AS pc, max(CASE WHEN c.qty = 2 THEN c.p END) AS p2, max(CASE WHEN c.qty = 0 THEN c.p END) AS p0 FROM cpd c JOIN (SELECT disc, sum(p) AS p FROM marg GROUP BY disc) d ON d.disc = c.disc WHERE c.flag = 'R' GROUP BY 1, 2) x",
}

#: Uniform numbers from (id, node) by squaring modulo a prime, the same in both engines: x is what the step before left.
_US = ["(CAST(id AS BIGINT) * 1103515245 + {0}) % 2147483647"] + ["(x{0} * x{0} + 12345) % 2147483647"] * 4


def _scrambled(source: str, salts: dict[int, int]) -> str:
    for step in _US:
        source = "(SELECT id, " + ", ".join(f"{step.format(salts[k] if step is _US[0] else k)} AS x{k}" for k in salts) + f" FROM {source}) s"
    return source


_DRAW = """WITH qd AS (SELECT x AS qty, cum - p AS lo, cum AS hi FROM (SELECT qty AS x, sum(p) AS p, sum(sum(p)) OVER (ORDER BY qty) AS cum FROM marg GROUP BY qty) a),
dd AS (SELECT x AS disc, cum - p AS lo, cum AS hi FROM (SELECT disc AS x, sum(p) AS p, sum(sum(p)) OVER (ORDER BY disc) AS cum FROM marg GROUP BY disc) a),
fd AS (SELECT qty, disc, flag, cum - p AS lo, cum AS hi FROM (SELECT qty, disc, flag, p, sum(p) OVER (PARTITION BY qty, disc ORDER BY flag) AS cum FROM cpd) a),
ids AS (SELECT @seq(1; 2000) AS id),
us AS (SELECT id, """ + ", ".join(f"(x{k} + 0.5e0) / 2147483647e0 AS u{k}" for k in (1, 2, 3)) + f" FROM {_scrambled('ids', {k: k * 7919 for k in (1, 2, 3)})}" + """),
drawn AS (SELECT us.id, qd.qty, dd.disc, fd.flag FROM us JOIN qd ON u1 > qd.lo AND u1 <= qd.hi JOIN dd ON u2 > dd.lo AND u2 <= dd.hi JOIN fd ON fd.qty = qd.qty AND fd.disc = dd.disc AND u3 > fd.lo AND u3 <= fd.hi)
"""

MORE = {
    "inner_on_date": "SELECT x.d, x.name AS asset, y.name AS driver, @r(x.price) AS price, @r(y.price) AS level FROM px x JOIN raw y ON x.d = y.d",
    "full_outer_concat": "SELECT coalesce(a.d, b.d) AS d, @r(a.price) AS first_price, @r(b.price) AS second_price FROM (SELECT d, price FROM daily WHERE name = 'A0') a FULL OUTER JOIN (SELECT d, price FROM daily WHERE name = 'A1') b ON a.d = b.d",
    "month_end_last": "SELECT CAST(date_trunc('month', d) AS DATE) AS m, name, @r(max_by(price, d)) AS price FROM daily GROUP BY 1, 2",
    "weekday_rows": "SELECT d, name, @r(price) AS price FROM daily WHERE @weekday(d) < 5",
    "asof_within_5_rows": "SELECT d, name, @r(@known(price) OVER (PARTITION BY name ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS price FROM (SELECT t.d, n.name, x.price FROM days t CROSS JOIN names n LEFT JOIN daily x ON x.d = t.d AND x.name = n.name) g",
    "semi_members": "SELECT x.d, x.name, @r(x.price) AS price FROM px x WHERE EXISTS (SELECT 1 FROM member m WHERE m.name = x.name AND m.q = CAST(date_trunc('quarter', x.d) AS DATE))",
    "anti_members": "SELECT DISTINCT x.q, x.name FROM quarterly x WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.name = x.name AND m.q = x.q)",
    "missing_names": "SELECT t.d, @list(n.name) AS missing FROM days t CROSS JOIN names n LEFT JOIN daily x ON x.d = t.d AND x.name = n.name WHERE x.name IS NULL GROUP BY t.d",
    "share_class_sum": "SELECT concat('A', CAST(l_suppkey % 8 AS STRING)) AS name, @r(sum(l_quantity)) AS shares FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS k FROM lineitem) x WHERE k = 1 GROUP BY 1",
    "type_expansion": "SELECT o_orderstatus, sum(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN 1 ELSE 0 END) AS p2, sum(CASE WHEN substr(o_orderpriority, 1, 1) NOT IN ('1', '2') THEN 1 ELSE 0 END) AS rest FROM orders GROUP BY 1",
    "remove_effect": "SELECT y.r, y.name, @r(y.v - s.slope * x.v) AS residual FROM panel x JOIN panel y ON x.r = y.r AND x.name = 'D1' AND y.name <> 'D1' JOIN (SELECT b.name, covar_pop(a.v, b.v) / var_pop(a.v) AS slope FROM panel a JOIN panel b ON a.r = b.r AND a.name = 'D1' GROUP BY b.name) s ON s.name = y.name",
    "moment_tau": "SELECT a.w, a.name AS pa, b.name AS ch, @r(1e6 * abs(avg(a.v * a.v * a.v * b.v) * avg(a.v * a.v) - avg(a.v * a.v * a.v * a.v) * avg(a.v * b.v))) AS tau FROM rolled a JOIN rolled b ON a.w = b.w AND a.r = b.r AND a.name <> b.name GROUP BY 1, 2, 3",
    "bn_sample": _DRAW + "SELECT id, qty, disc, flag FROM drawn",
    "bn_sample_frequencies": _DRAW + "SELECT qty, disc, flag, @r(count(*) / 2000e0) AS freq FROM drawn GROUP BY 1, 2, 3",
    "bn_predict_incomplete": "SELECT qty, flag, @r(p) AS p FROM (SELECT qty, flag, p, row_number() OVER (PARTITION BY qty ORDER BY round(p, 9) DESC, flag) AS k FROM (SELECT c.qty, c.flag, sum(c.p * d.p) AS p FROM cpd c JOIN (SELECT disc, sum(p) AS p FROM marg GROUP BY disc) d ON d.disc = c.disc GROUP BY 1, 2) x) y WHERE k = 1",
    "bn_classifier_accuracy": "SELECT @r(CAST(sum(CASE WHEN b.flag = p.flag THEN b.n ELSE 0 END) AS DOUBLE) / sum(b.n)) AS accuracy FROM bn b JOIN (SELECT qty, disc, flag FROM (SELECT qty, disc, flag, row_number() OVER (PARTITION BY qty, disc ORDER BY round(p, 9) DESC, flag) AS k FROM cpd) x WHERE k = 1) p ON p.qty = b.qty AND p.disc = b.disc",
    "lewis_necessity_sufficiency": "SELECT @r(greatest(0e0, least(1e0, sum((p0n - p2n) * pc) / nullif(sum(p2 * pc), 0e0)))) AS nec, @r(greatest(0e0, least(1e0, sum((p2 - p0) * pc) / nullif(sum(p0n * pc), 0e0)))) AS suf FROM (SELECT d.disc, d.p AS pc, max(CASE WHEN c.qty = 2 AND c.flag = 'N' THEN c.p END) AS p2, max(CASE WHEN c.qty = 0 AND c.flag = 'N' THEN c.p END) AS p0, 1 - max(CASE WHEN c.qty = 2 AND c.flag = 'N' THEN c.p END) AS p2n, 1 - max(CASE WHEN c.qty = 0 AND c.flag = 'N' THEN c.p END) AS p0n FROM cpd c JOIN (SELECT disc, sum(p) AS p FROM marg GROUP BY disc) d ON d.disc = c.disc GROUP BY d.disc, d.p) x",
}

CATALOGUE = Catalogue(VIEWS, PANEL | UNIVERSE | SELECTION | PORTFOLIO | GRAPH | BAYES | MORE, oracle.VIEWS, oracle.TEXTS, RUNS)
