"""The fixture views of FIXTURES.md §3 as DuckDB ``WITH`` clauses.

The driver's oracle only registers base tables, so every oracle query starts
with these common table expressions. ``with_fixtures(body)`` prepends them;
``body`` is either a ``SELECT`` or ``, name AS (...) SELECT ...`` adding more
CTEs.
"""

FIXTURE_CTES = """
WITH truth AS (
  SELECT o.o_orderkey AS obs_id,
         CASE WHEN o.o_orderkey % 10 = 0 THEN 'val' WHEN o.o_orderkey % 10 = 1 THEN 'test' ELSE 'train' END AS dataset,
         CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS building_id,
         CAST(substr(o.o_orderpriority, 1, 1) AS INT) - 1 AS floor,
         CAST(-7600 + 120 * (CASE o.o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS DOUBLE)
           + CAST(o.o_custkey % 400 AS DOUBLE) / 4 AS longitude,
         CAST(4864750 AS DOUBLE) + CAST(o.o_custkey % 37 AS DOUBLE) * 2.5 AS latitude,
         CAST(o.o_custkey % 250 AS INT) AS space_id,
         CAST(1 + o.o_orderkey % 2 AS INT) AS relative_position,
         CAST(o.o_custkey % 18 AS INT) AS user_id,
         CAST(c.c_nationkey AS INT) AS phone_id,
         o.o_orderdate AS ts
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
),
ap AS (
  SELECT s_suppkey AS ap_no, 'WAP' || lpad(CAST(s_suppkey + 1 AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey + 1 AS VARCHAR))) AS INT), '0') AS ap_id
  FROM supplier
),
reading AS (
  SELECT t.obs_id, a.ap_id,
         MAX(CAST(-l.l_quantity AS INT) - 12 * abs(t.floor - CAST(floor(a.ap_no / 4.0) AS INT) % 5)) AS rssi
  FROM lineitem l JOIN truth t ON t.obs_id = l.l_orderkey JOIN ap a ON a.ap_no = l.l_suppkey
  WHERE (a.ap_no % 4 = 0 OR a.ap_no % 4 = t.building_id + 1)
    AND NOT (t.dataset = 'test' AND a.ap_no % 5 = 3)
    AND NOT (t.dataset = 'val' AND a.ap_no % 7 = 2)
  GROUP BY t.obs_id, a.ap_id
),
obs AS (
  SELECT obs_id, dataset,
         CASE WHEN dataset <> 'test' THEN building_id END AS building_id,
         CASE WHEN dataset <> 'test' THEN floor END AS floor,
         CASE WHEN dataset <> 'test' THEN longitude END AS longitude,
         CASE WHEN dataset <> 'test' THEN latitude END AS latitude,
         space_id, relative_position, user_id, phone_id, ts
  FROM truth
),
panels AS (
  SELECT obs_id, CAST(ap_no // 64 AS INT) AS panel, /*PANEL_MAX*/
  FROM (SELECT obs_id, rssi, CAST(substr(ap_id, 4) AS BIGINT) - 1 AS ap_no FROM reading) GROUP BY obs_id, CAST(ap_no // 64 AS INT)
),
scan_wide AS (
  SELECT o.obs_id, o.dataset, o.space_id, n.panel, /*PANEL_FILL*/
  FROM obs o CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(ap_no) // 64 + 1 FROM ap))) AS INT) AS panel) n
  LEFT JOIN panels p ON p.obs_id = o.obs_id AND p.panel = n.panel
)
"""


PANEL_COLUMNS = [f"AP_{i:02d}" for i in range(64)]
FIXTURE_CTES = FIXTURE_CTES.replace("/*PANEL_MAX*/", ", ".join(
    f"max(CASE WHEN ap_no % 64 = {i} THEN rssi END) AS {c}" for i, c in enumerate(PANEL_COLUMNS)))
FIXTURE_CTES = FIXTURE_CTES.replace("/*PANEL_FILL*/", ", ".join(f"coalesce(p.{c}, 100) AS {c}" for c in PANEL_COLUMNS))


def with_fixtures(body: str) -> str:
    return FIXTURE_CTES.strip() + "\n" + body.strip()
