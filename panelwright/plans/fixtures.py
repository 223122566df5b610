"""Panels, universes, graphs and tables that the catalogue's queries share."""

W, STEP = 104, 13

VIEWS = {
    "px": """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d, concat('A', CAST(l_suppkey % 8 AS STRING)) AS name,
  CAST(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS DOUBLE) AS price, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2""",
    "daily": """SELECT CAST(l_shipdate AS DATE) AS d, concat('A', CAST(l_suppkey % 8 AS STRING)) AS name,
  CAST(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2""",
    "raw": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, concat('D', substr(o_orderpriority, 1, 1)) AS name,
  CAST(avg(o_totalprice) AS DOUBLE) AS price FROM orders GROUP BY 1, 2""",
    "monthly": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_orderstatus AS name,
  CAST(avg(o_totalprice) AS DOUBLE) AS v FROM orders GROUP BY 1, 2""",
    "cal": "SELECT d, @n(row_number() OVER (ORDER BY d) - 1) AS r FROM (SELECT DISTINCT d FROM px) x",
    "days": "SELECT d, @n(row_number() OVER (ORDER BY d) - 1) AS r FROM (SELECT DISTINCT d FROM daily) x",
    "names": "SELECT DISTINCT name FROM px",
    "ret": "SELECT d, name, ln(price / lag(price) OVER (PARTITION BY name ORDER BY d)) AS v FROM px",
    "dret": "SELECT d, name, ln(price / lag(price) OVER (PARTITION BY name ORDER BY d)) AS v FROM raw",
    "panel": """SELECT c.r, c.d, x.name, 'asset' AS role, x.v FROM cal c JOIN ret x ON c.d = x.d WHERE x.v IS NOT NULL
  UNION ALL SELECT c.r, c.d, x.name, 'driver' AS role, x.v FROM cal c JOIN dret x ON c.d = x.d WHERE x.v IS NOT NULL""",
    "size": "SELECT @n(max(r) + 1) AS n FROM cal",
    # A row belongs to windows ceil((r - W + 1) / step) .. floor(r / step), clamped: no range join.
    "spread": f"""SELECT p.*, greatest(0, @idiv(p.r - {W} + {STEP}; {STEP})) AS lo, least(@idiv(p.r; {STEP}), @idiv(s.n - {W}; {STEP})) AS hi
  FROM panel p CROSS JOIN size s""",
    "rolled": "SELECT @seq(lo; hi) AS w, r, d, name, role, v FROM spread WHERE lo <= hi",
    "pairs": """SELECT a.w, a.name AS a, b.name AS b, a.role AS ra, b.role AS rb, @corr(a.v; b.v) AS rho, covar_samp(a.v, b.v) AS cov, @n(count(*)) AS n
  FROM rolled a JOIN rolled b ON a.w = b.w AND a.r = b.r WHERE a.name < b.name GROUP BY 1, 2, 3, 4, 5""",
    # Lag-1 correlations make a graph that SQL can check.
    "lagged": "SELECT a.w, a.name AS src, b.name AS dst, a.role AS rs, b.role AS rd, @corr(a.v; b.v) AS rho FROM rolled a JOIN rolled b ON a.w = b.w AND b.r = a.r + 1 GROUP BY 1, 2, 3, 4, 5",
    "edges": "SELECT w, src, dst, rs, rd, round(rho, 6) AS weight FROM lagged WHERE src <> dst AND abs(round(rho, 6)) >= 0.12e0",
    "dag": "SELECT w, src, dst, weight FROM edges WHERE src < dst",
    "shares": "SELECT concat('A', CAST(s_suppkey % 8 AS STRING)) AS name, CAST(sum(abs(s_acctbal)) AS DOUBLE) AS shares FROM supplier GROUP BY 1",
    "sectors": """SELECT name, sector FROM (SELECT concat('A', CAST(s_suppkey % 8 AS STRING)) AS name, r_name AS sector, row_number() OVER (PARTITION BY s_suppkey % 8 ORDER BY s_suppkey) AS k
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x WHERE k = 1""",
    "quarterly": "SELECT CAST(date_trunc('quarter', d) AS DATE) AS q, name, sum(volume) AS volume FROM px GROUP BY 1, 2",
    "member": "SELECT a.q, a.name FROM quarterly a JOIN (SELECT q, @pct(volume; 0.5) AS mid FROM quarterly GROUP BY q) b ON a.q = b.q WHERE a.volume > b.mid",
    "snaps": "SELECT q, lead(q) OVER (ORDER BY q) AS next_q FROM (SELECT DISTINCT q FROM member) x",
    "changes": """SELECT s.next_q AS q, b.name, 1 AS added FROM snaps s JOIN member b ON b.q = s.next_q LEFT JOIN member a ON a.q = s.q AND a.name = b.name WHERE a.name IS NULL
  UNION ALL SELECT s.next_q AS q, a.name, 0 AS added FROM snaps s JOIN member a ON a.q = s.q LEFT JOIN member b ON b.q = s.next_q AND b.name = a.name WHERE b.name IS NULL AND s.next_q IS NOT NULL""",
    "port": "SELECT d, avg(exp(v) - 1) AS g FROM ret WHERE v IS NOT NULL GROUP BY d",
    "capw": """SELECT x.d, x.name, x.price * s.shares / sum(x.price * s.shares) OVER (PARTITION BY x.d) AS w FROM px x JOIN shares s ON x.name = s.name""",
    "capport": "SELECT c.r, c.d, sum(w.w * (exp(x.v) - 1)) AS g FROM cal c JOIN ret x ON c.d = x.d JOIN cal p ON p.r = c.r - 1 JOIN capw w ON w.d = p.d AND w.name = x.name WHERE x.v IS NOT NULL GROUP BY 1, 2",
    "nav": "SELECT d, g, exp(sum(ln(1 + g)) OVER (ORDER BY d)) AS nav FROM port",
    # Networks count rows, so the table of counts stands for them.
    "bn": """SELECT l_returnflag AS flag, l_linestatus AS status, CAST(CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS INT) AS qty,
  CAST(CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS INT) AS disc, @n(count(*)) AS n FROM lineitem GROUP BY 1, 2, 3, 4""",
    "pa": "SELECT qty, disc FROM (SELECT DISTINCT qty FROM bn) a CROSS JOIN (SELECT DISTINCT disc FROM bn) b",
    "cell": "SELECT p.qty, p.disc, f.flag, @n(coalesce(sum(bn.n), 0)) AS n FROM pa p CROSS JOIN (SELECT DISTINCT flag FROM bn) f LEFT JOIN bn ON bn.qty = p.qty AND bn.disc = p.disc AND bn.flag = f.flag GROUP BY 1, 2, 3",
    "cpd": "SELECT qty, disc, flag, coalesce(n / nullif(sum(n) OVER (PARTITION BY qty, disc), 0), 1e0 / count(*) OVER (PARTITION BY qty, disc)) AS p FROM cell",
    "marg": "SELECT q.qty, d.disc, q.p * d.p AS p FROM (SELECT qty, CAST(sum(n) AS DOUBLE) / (sum(sum(n)) OVER ()) AS p FROM bn GROUP BY qty) q CROSS JOIN (SELECT disc, CAST(sum(n) AS DOUBLE) / (sum(sum(n)) OVER ()) AS p FROM bn GROUP BY disc) d",
    "stat": "SELECT flag, status, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY flag) AS p FROM bn GROUP BY 1, 2",
    "vecs": "SELECT vec_id, label, embedding FROM embeddings",
    "dims": "SELECT label, i, avg(CAST(x AS DOUBLE)) AS s FROM (SELECT label, @each(embedding) FROM vecs) e GROUP BY 1, 2",
    "score": "SELECT name, w, abs_sum, @n(row_number() OVER (PARTITION BY w ORDER BY abs_sum DESC, name)) AS k FROM (SELECT src AS name, w, @r(sum(abs(rho))) AS abs_sum FROM lagged WHERE rs = 'driver' AND rd = 'asset' GROUP BY 1, 2) x",
    "hourly": "SELECT date_trunc('hour', ts) AS h, event_type, @n(count(*)) AS n, CAST(sum(value) AS DOUBLE) AS v FROM events GROUP BY 1, 2",
}
