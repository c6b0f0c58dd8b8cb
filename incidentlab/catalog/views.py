"""SQL text of the fixture views: name -> (views it needs, SELECT)."""

VIEWS: dict[str, tuple[str, str]] = {}


def _view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view("inc", "", """
SELECT o_orderkey AS id, n_name AS unit, r_name AS state, n_nationkey AS unit_key, o_orderdate AS dt,
       CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(quarter(o_orderdate) AS INTEGER) AS quarter, c_mktsegment AS category,
       'PS-' || lpad(CAST(c_custkey % 47 + 1 AS VARCHAR), 3, '0') AS station, o_totalprice AS loss,
       CAST(1.0 AS DOUBLE) AS weight, o_orderpriority AS channel
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")

_view("inc_nulls", "inc", """
SELECT id, unit, state, year, month, CASE WHEN id % 17 <> 0 THEN loss END AS loss,
       CASE WHEN id % 23 <> 0 THEN category END AS category,
       CASE WHEN id % 19 <> 0 THEN month IN (10, 11, 1) END AS festival,
       CASE WHEN id % 5 = 0 THEN loss / 2 END AS sparse
FROM inc""")

_view("pts", "inc", """
SELECT *, CASE WHEN id % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE 8 + (id * 7919 % 29000) / CAST(1000 AS DOUBLE) END AS lat,
       CASE WHEN id % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE 69 + (id * 104729 % 28000) / CAST(1000 AS DOUBLE) END AS lon
FROM inc""")

_view("unit_month", "inc", """
SELECT unit, state, year, month, round(sum(loss), 2) AS loss, sum(weight) AS weight,
       CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter, CAST(count(*) AS BIGINT) AS n
FROM inc GROUP BY unit, state, year, month""")

_view("unit_year", "inc", """
SELECT state, unit, unit_key, year, CAST(count(*) AS BIGINT) AS n, round(sum(loss), 2) AS loss,
       CASE WHEN unit_key % 5 <> 0 THEN CAST(100000 + 37000 * unit_key AS BIGINT) END AS population
FROM inc GROUP BY state, unit, unit_key, year""")

_view("edges", "", """
SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b
  ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey
WHERE a.n_nationkey <> 7 AND b.n_nationkey <> 7""")

_view("boxes", "", """
SELECT n_name AS name, n_nationkey AS key, n_regionkey AS region_key,
       CAST(68 + 6 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(6 + 6 * (n_nationkey // 5) AS DOUBLE) AS y0,
       CAST(74 + 6 * (n_nationkey % 5) AS DOUBLE) AS x1, CAST(12 + 6 * (n_nationkey // 5) AS DOUBLE) AS y1
FROM nation""")

_view("plots", "", """
SELECT *, x0 + (key % 7 + 1) / CAST(8 AS DOUBLE) AS x1, y0 + (key % 5 + 1) / CAST(16 AS DOUBLE) AS y1 FROM (
  SELECT c_name AS name, c_custkey AS key, 69 + (c_custkey * 7919 % 28000) / CAST(1000 AS DOUBLE) AS x0,
         8 + (c_custkey * 104729 % 29000) / CAST(1000 AS DOUBLE) AS y0 FROM customer)""")

_view("scored", "unit_month", "SELECT *, loss / 1000 AS p FROM unit_month")

_view("score", "scored", """
SELECT *, CASE WHEN hi > lo THEN (p - lo) / (hi - lo) * 100 ELSE 0 END AS raw_score,
       CAST(row_number() OVER (ORDER BY p DESC, unit, year, month) AS BIGINT) AS priority_rank
FROM scored, (SELECT min(p) AS lo, max(p) AS hi FROM scored)""")

# --- unit-year chain ---

_view("uy_growth", "unit_year", """
SELECT *, CASE WHEN prev IS NULL OR (prev = 0 AND n = 0) THEN CAST(0 AS DOUBLE)
               WHEN prev = 0 THEN NULL ELSE CAST(n - prev AS DOUBLE) / CAST(prev AS DOUBLE) END AS growth_rate
FROM (SELECT *, lag(n) OVER (PARTITION BY state, unit ORDER BY year) AS prev FROM unit_year)""")

_view("uy_feat", "uy_growth", """
SELECT *, avg(n) OVER (PARTITION BY state, unit ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend_3y,
       coalesce(avg(growth_rate) OVER (PARTITION BY state, unit ORDER BY year
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS historical_growth,
       coalesce(lag(growth_rate) OVER (PARTITION BY state, unit ORDER BY year), growth_rate) AS expected_growth,
       CASE WHEN population > 0 THEN CAST(n AS DOUBLE) / population * 100000 END AS rate_100k
FROM uy_growth""")

_view("uy_near", "uy_feat edges", """
SELECT f.*, near.neighbor_risk, near.spatial_lag FROM uy_feat f LEFT JOIN
  (SELECT src, year, avg(n) AS neighbor_risk, avg(rate_100k) AS spatial_lag
   FROM edges JOIN uy_feat ON dst = unit GROUP BY src, year) near
  ON f.unit = near.src AND f.year = near.year""")

_view("uy_risk", "uy_near", """
SELECT *, CAST(round(CAST(least(greatest(
    CAST(0.5 AS DOUBLE) * least(coalesce(rate_100k, n / CAST(1000 AS DOUBLE)) / CAST(50 AS DOUBLE), CAST(1 AS DOUBLE))
  + CAST(0.3 AS DOUBLE) * greatest(greatest(CAST(-0.5 AS DOUBLE), least(CAST(2 AS DOUBLE), growth_rate)), CAST(0 AS DOUBLE))
  + CAST(0.2 AS DOUBLE) * (coalesce(neighbor_risk, 0) / (SELECT CAST(max(n) AS DOUBLE) FROM unit_year)),
  CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS risk_index
FROM uy_near""")

# --- panel features ---

_view("um_growth", "unit_month", """
SELECT *, coalesce((n - lag12) / CAST(lag12 + 1 AS DOUBLE), CAST(0 AS DOUBLE)) AS crime_growth
FROM (SELECT *, lag(n, 12) OVER (PARTITION BY unit ORDER BY year, month) AS lag12 FROM unit_month)""")

_view("um_momentum", "um_growth", """
SELECT *, avg(crime_growth) OVER (PARTITION BY unit ORDER BY year, month
          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS momentum FROM um_growth""")

_view("um_accel", "um_momentum", """
SELECT *, coalesce(momentum - lag(momentum) OVER (PARTITION BY unit ORDER BY year, month), CAST(0 AS DOUBLE))
          AS acceleration FROM um_momentum""")

_view("um_roll", "um_accel", """
SELECT *, avg(n) OVER w3 AS rolling_mean_3m, avg(n) OVER w6 AS rolling_mean_6m FROM um_accel
WINDOW w3 AS (PARTITION BY unit ORDER BY year, month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       w6 AS (PARTITION BY unit ORDER BY year, month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")

# --- cells: axial hexagons, edge 32 / 2^resolution degrees ---

_AXIAL = """
SELECT *, CASE WHEN dq > dr AND dq > ds THEN -nr - nt ELSE nq END AS cq,
       CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -nq - nt ELSE nr END AS cr
FROM (SELECT *, abs(nq - q) AS dq, abs(nr - r) AS dr, abs(nt - t) AS ds
  FROM (SELECT *, floor(q + CAST(0.5 AS DOUBLE)) AS nq, floor(r + CAST(0.5 AS DOUBLE)) AS nr,
               floor(t + CAST(0.5 AS DOUBLE)) AS nt
    FROM (SELECT *, -q - r AS t
      FROM (SELECT *, (CAST(0.5773502691896257 AS DOUBLE) * lon - lat / 3) / size AS q,
                   (CAST(0.6666666666666666 AS DOUBLE) * lat) / size AS r
        FROM (SELECT *, CAST(0.5 AS DOUBLE) AS size FROM pts)))))"""

_view("cells", "pts", f"""
SELECT *, '6:' || CAST(CAST(cq AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(cr AS BIGINT) AS VARCHAR) AS cell
FROM ({_AXIAL})""")

_view("cell_month", "cells", """
SELECT cell, year, month, round(sum(loss), 2) AS crime_count, avg(lat) AS latitude, avg(lon) AS longitude
FROM cells GROUP BY cell, year, month""")

_view("cell_hot", "cell_month", """
SELECT * FROM (SELECT *, (crime_count - lo) / (hi - lo) * 100 AS raw_score,
  CAST(row_number() OVER (ORDER BY crime_count DESC, cell, year, month) AS BIGINT) AS hotspot_rank
  FROM cell_month, (SELECT min(crime_count) AS lo, max(crime_count) AS hi FROM cell_month))""")

# --- application tables ---

_view("ev", "", "SELECT * FROM events")

_view("requests", "", """
SELECT event_id, ts, value, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '/api/auth/register' ELSE '/api/auth/login' END
    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '/api/reports/generate' ELSE '/api/reports/download/7' END
    WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN '/ws/dashboard' ELSE '/api/auth/logout' END
    WHEN 'click' THEN '/api/items' ELSE '/api/dashboard' END AS path,
  CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'POST'
    WHEN event_type = 'click' THEN CASE event_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'PATCH' ELSE 'DELETE' END
    ELSE 'GET' END AS method,
  CASE WHEN event_id % 10 < 7 THEN 200 ELSE 401 END AS status,
  CASE WHEN event_id % 5 = 0 THEN ' 172.16.0.' || CAST(user_id % 9 AS VARCHAR) || ' , 10.1.1.1'
       WHEN event_id % 5 = 1 THEN '' END AS forwarded,
  CASE WHEN event_id % 7 <> 0 THEN '10.0.0.' || CAST(user_id % 20 AS VARCHAR) END AS host
FROM events""")

_view("request_ip", "requests", """
SELECT *, CASE WHEN trim(split_part(coalesce(forwarded, ''), ',', 1)) <> '' THEN trim(split_part(forwarded, ',', 1))
               WHEN host IS NOT NULL THEN host ELSE 'unknown' END AS ip_address FROM requests""")

_view("users", "", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS department,
  CASE WHEN c_custkey % 20 = 0 THEN 'admin' WHEN c_custkey % 20 <= 3 THEN 'officer' ELSE 'analyst' END AS role,
  CASE WHEN c_custkey % 9 = 4 THEN 'inactive' ELSE 'active' END AS status, c_custkey % 50 = 7 AS is_deleted
FROM customer""")

_view("reports", "", """
SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  o_orderdate AS created_at, o_orderdate + INTERVAL 7 DAY AS expires_at FROM orders""")
