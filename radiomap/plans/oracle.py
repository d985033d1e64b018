"""Oracle SQL (DuckDB) for the registered queries; same column names and types."""

from __future__ import annotations

from radiomap.plans.oracle_fixtures import PANEL_COLUMNS, with_fixtures

_BODIES: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    _BODIES[name] = body


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(v) for k, v in _BODIES.items()}


# Common pieces --------------------------------------------------------------------
RD = ", rd AS (SELECT r.obs_id, r.ap_id, r.rssi, o.dataset FROM reading r JOIN obs o USING (obs_id))"
GRID = ", grid AS (SELECT a.ap_id, d.dataset FROM ap a CROSS JOIN (VALUES ('train'), ('val'), ('test')) d(dataset))"
EXTENT = """, ext AS (
  SELECT r.ap_id, min(o.latitude) AS min_lat, max(o.latitude) AS max_lat,
         min(o.longitude) AS min_lon, max(o.longitude) AS max_lon
  FROM reading r JOIN obs o USING (obs_id) GROUP BY r.ap_id),
extent AS (
  SELECT *, max_lat - min_lat AS lat_diff, max_lon - min_lon AS long_diff,
         greatest(max_lat - min_lat, max_lon - min_lon) AS max_diff FROM ext)"""
SIGCOUNT = """, sc AS (
  SELECT o.obs_id, CAST(count(r.rssi) AS BIGINT) AS sig_count
  FROM obs o LEFT JOIN reading r USING (obs_id) GROUP BY o.obs_id)"""
PROFILE = RD + """, st AS (
  SELECT ap_id, avg(CASE WHEN dataset = 'train' THEN rssi END) AS avg_rssi,
         count(CASE WHEN dataset = 'train' THEN 1 END) AS obs,
         count(CASE WHEN dataset IN ('train', 'val') AND rssi > -30 THEN 1 END) AS above30
  FROM rd WHERE dataset IN ('train', 'val') GROUP BY ap_id),
profile AS (
  SELECT a.ap_id, round(st.avg_rssi, 6) AS avg_rssi, CAST(coalesce(st.obs, 0) AS BIGINT) AS obs,
         CAST(CASE WHEN st.above30 > 0 THEN st.above30 END AS BIGINT) AS above30,
         round(CASE WHEN coalesce(st.obs, 0) > 0 AND st.above30 > 0
                    THEN CAST(st.above30 AS DOUBLE) / st.obs END, 6) AS above30_rate,
         round(CASE WHEN coalesce(st.obs, 0) > 0 THEN ln(CAST(st.obs AS DOUBLE)) END, 6) AS ln_obs
  FROM ap a LEFT JOIN st USING (ap_id))"""

sql("signal_count", SIGCOUNT + " SELECT obs_id, sig_count FROM sc")
sql("ap_extent", EXTENT + " SELECT * FROM extent")
sql("noisy_aps", EXTENT + " SELECT * FROM extent WHERE max_diff > 190")

sql("drop_empty_scans", """SELECT obs_id, dataset, building_id, floor FROM obs o
WHERE EXISTS (SELECT 1 FROM reading r WHERE r.obs_id = o.obs_id)""")
sql("strong_signals", "SELECT obs_id, ap_id, rssi FROM reading WHERE rssi > -30")
sql("scans_with_outlier", """SELECT obs_id, dataset, user_id, phone_id FROM obs o
WHERE EXISTS (SELECT 1 FROM reading r WHERE r.obs_id = o.obs_id AND r.rssi > -29)""")
sql("unheard_aps", RD + GRID + """ SELECT g.dataset, g.ap_id FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.dataset = g.dataset AND rd.ap_id = g.ap_id)""")
sql("ap_null_counts", RD + GRID + """, sizes AS (SELECT dataset, count(*) AS n FROM obs GROUP BY dataset),
heard AS (SELECT dataset, ap_id, count(*) AS h FROM rd GROUP BY dataset, ap_id)
SELECT g.dataset, g.ap_id, CAST(coalesce(s.n, 0) - coalesce(h.h, 0) AS BIGINT) AS n_null
FROM grid g LEFT JOIN heard h ON h.dataset = g.dataset AND h.ap_id = g.ap_id
LEFT JOIN sizes s ON s.dataset = g.dataset""")
sql("varying_aps", RD + """, sizes AS (SELECT dataset, count(*) AS n FROM obs GROUP BY dataset),
per_ap AS (SELECT dataset, ap_id, count(*) AS n_heard, count(DISTINCT rssi) AS n_values,
                  max(CASE WHEN rssi = -110 THEN 1 ELSE 0 END) AS has_fill
           FROM rd GROUP BY dataset, ap_id),
v AS (SELECT p.dataset, p.ap_id,
             CAST(p.n_values + CASE WHEN p.n_heard < s.n AND p.has_fill = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_distinct
      FROM per_ap p JOIN sizes s USING (dataset))
SELECT dataset, ap_id, n_distinct FROM v WHERE n_distinct > 1""")
sql("restrict_to_known_aps", RD + """ SELECT obs_id, ap_id, rssi FROM rd
WHERE dataset = 'test' AND ap_id IN (SELECT ap_id FROM rd WHERE dataset = 'train')""")
sql("prepare_survey", RD + """, kept AS (SELECT DISTINCT ap_id FROM rd WHERE dataset = 'test'),
r2 AS (SELECT * FROM reading WHERE ap_id IN (SELECT ap_id FROM kept)),
o2 AS (SELECT * FROM obs WHERE obs_id IN (SELECT obs_id FROM r2))
SELECT o2.obs_id, CAST(count(r2.rssi) AS BIGINT) AS sig_count
FROM o2 LEFT JOIN r2 USING (obs_id) GROUP BY o2.obs_id""")

sql("ap_profile", PROFILE + " SELECT * FROM profile")
sql("ap_label", PROFILE + """ SELECT ap_id, ap_id || ', ' || CAST(obs AS VARCHAR) || ' observations' AS label,
lower(substr(ap_id, 1, 3)) AS prefix FROM profile""")
sql("ap_dataset_coverage", RD + """, h AS (SELECT dataset, ap_id, count(*) AS n FROM rd GROUP BY dataset, ap_id),
a AS (SELECT ap_id, n FROM h WHERE dataset = 'train'), b AS (SELECT ap_id, n FROM h WHERE dataset = 'val')
SELECT coalesce(a.ap_id, b.ap_id) AS ap_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_train,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n_val
FROM a FULL OUTER JOIN b ON a.ap_id = b.ap_id""")
sql("ap_frequency", "SELECT ap_id, count(*) AS n FROM reading GROUP BY ap_id ORDER BY n DESC, ap_id")
sql("outlier_phones", """SELECT phone_id, count(*) AS n FROM obs o
WHERE dataset = 'train' AND EXISTS (SELECT 1 FROM reading r WHERE r.obs_id = o.obs_id AND r.rssi > -29)
GROUP BY phone_id ORDER BY n DESC, phone_id""")
sql("distinct_aps_by_building", """SELECT DISTINCT o.building_id, r.ap_id FROM reading r JOIN obs o USING (obs_id)
WHERE o.building_id IS NOT NULL""")
sql("missing_ap_summary", RD + GRID + """, un AS (
  SELECT g.dataset, count(*) AS n FROM grid g
  WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.dataset = g.dataset AND rd.ap_id = g.ap_id) GROUP BY g.dataset),
he AS (SELECT dataset, count(DISTINCT ap_id) AS n FROM rd WHERE dataset IN ('train', 'val', 'test') GROUP BY dataset)
SELECT coalesce(he.dataset, un.dataset) AS dataset, CAST(coalesce(he.n, 0) AS BIGINT) AS n_heard,
       CAST(coalesce(un.n, 0) AS BIGINT) AS n_unheard,
       CAST(coalesce(he.n, 0) + coalesce(un.n, 0) AS BIGINT) AS n_catalogue
FROM he FULL OUTER JOIN un ON he.dataset = un.dataset""")
sql("rssi_histogram", RD + """ SELECT dataset, CAST(floor(rssi / 5) * 5 AS INT) AS bin_lo, count(*) AS n
FROM rd GROUP BY dataset, CAST(floor(rssi / 5) * 5 AS INT)""")
sql("signal_count_histogram", SIGCOUNT + " SELECT sig_count, count(*) AS n FROM sc GROUP BY sig_count")
sql("rssi_boxplot", """, r AS (SELECT o.phone_id, r.rssi FROM reading r JOIN obs o USING (obs_id) WHERE o.dataset = 'train'),
q AS (SELECT phone_id, quantile_cont(rssi, 0.25) AS q1, quantile_cont(rssi, 0.5) AS median,
             quantile_cont(rssi, 0.75) AS q3 FROM r GROUP BY phone_id),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.phone_id, count(*) AS n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       min(CASE WHEN r.rssi >= f.lo_fence AND r.rssi <= f.hi_fence THEN r.rssi END) AS lower_whisker,
       max(CASE WHEN r.rssi >= f.lo_fence AND r.rssi <= f.hi_fence THEN r.rssi END) AS upper_whisker,
       CAST(count(CASE WHEN NOT (r.rssi >= f.lo_fence AND r.rssi <= f.hi_fence) THEN 1 END) AS BIGINT) AS n_outliers
FROM r JOIN f USING (phone_id) GROUP BY f.phone_id, f.q1, f.median, f.q3""")
sql("ap_by_mean_signal", RD + """ SELECT ap_id, round(avg(rssi), 6) AS avg_rssi, count(*) AS obs
FROM rd WHERE dataset = 'train' GROUP BY ap_id ORDER BY avg_rssi DESC, ap_id""")
sql("locations_by_user", """, d AS (SELECT DISTINCT user_id, latitude, longitude FROM obs
  WHERE dataset = 'train' AND latitude IS NOT NULL AND longitude IS NOT NULL),
nl AS (SELECT user_id, count(*) AS n_locations FROM d GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n_scans, min(latitude) AS min_lat, max(latitude) AS max_lat,
             min(longitude) AS min_lon, max(longitude) AS max_lon FROM obs WHERE dataset = 'train' GROUP BY user_id)
SELECT b.user_id, b.n_scans, coalesce(nl.n_locations, 0) AS n_locations, b.min_lat, b.max_lat, b.min_lon, b.max_lon
FROM b LEFT JOIN nl USING (user_id)""")


# --- sources, projections, filters, row-wise ---------------------------------------

from radiomap.functions.hashing import sql_hash_key, sql_hash_uniform  # noqa: E402
from radiomap.operators.sampling import poisson_cdf_steps  # noqa: E402

WAPS = tuple(PANEL_COLUMNS)


def _h(seed: int, salt: str | None = None, key: str = "obs_id") -> str:
    return sql_hash_key(seed, *([f"'{salt}'"] if salt else []), key)


def _u(seed: int, salt: str | None = None, key: str = "obs_id") -> str:
    return sql_hash_uniform(seed, *([f"'{salt}'"] if salt else []), key)


def _strat(src: str, n: int, seed: int, salt: str, cols: str = "obs_id, building_id, floor") -> str:
    return (f"SELECT {cols} FROM {src} QUALIFY row_number() OVER "
            f"(PARTITION BY building_id, floor ORDER BY {_h(seed, salt)}, obs_id) <= {n}")


def _sample_n(src: str, n: int, seed: int, salt: str, cols: str = "obs_id, building_id, floor") -> str:
    return f"SELECT {cols} FROM {src} ORDER BY {_h(seed, salt)}, obs_id LIMIT {n}"


def _sample_frac(src: str, frac: float, seed: int, salt: str, cols: str = "obs_id, building_id, floor") -> str:
    return (f"SELECT {cols} FROM {src} QUALIFY row_number() OVER (ORDER BY {_h(seed, salt)}, obs_id) <= "
            f"(SELECT round_even({frac} * count(*), 0) FROM {src})")


def _copies(seed: int, salt: str, mean: float) -> str:
    u = _u(seed, salt)
    return "(" + " + ".join(f"CASE WHEN {u} >= {c:.17e} THEN 1 ELSE 0 END"
                            for c in poisson_cdf_steps(mean)) + ")"


def _bootstrap(src: str, mean: float, seed: int, salt: str) -> str:
    return (f"SELECT obs_id, CAST(c AS INT) AS copy_no FROM (SELECT obs_id, unnest(range(1, copies + 1)) AS c "
            f"FROM (SELECT obs_id, {_copies(seed, salt, mean)} AS copies FROM {src}) WHERE copies > 0)")


LAB = """, tr AS (SELECT obs_id, building_id, floor FROM obs WHERE dataset = 'train'),
val AS (SELECT obs_id, building_id, floor FROM obs WHERE dataset = 'val')"""

sql("load_survey", "SELECT * FROM obs")
sql("tag_dataset", "SELECT obs_id, dataset FROM obs")
sql("select_ap_columns", f"SELECT obs_id, panel, {', '.join(WAPS)} FROM scan_wide")
sql("select_first_columns", f"SELECT obs_id, panel, {', '.join(WAPS[:8])} FROM scan_wide")
sql("survey_csv", f"SELECT obs_id, dataset, panel, {', '.join(WAPS)} FROM scan_wide")
sql("sentinel_to_fill", "SELECT obs_id, dataset, space_id, panel, "
    + ", ".join(f"CASE WHEN {w} = 100 THEN -110 ELSE {w} END AS {w}" for w in WAPS) + " FROM scan_wide")
sql("encode_floor", """, codes AS (SELECT floor, CAST(row_number() OVER (ORDER BY first, floor) - 1 AS INT) AS code
  FROM (SELECT floor, min(obs_id) AS first FROM obs WHERE dataset = 'train' AND floor IS NOT NULL GROUP BY floor))
SELECT o.obs_id, o.floor, c.code FROM obs o LEFT JOIN codes c USING (floor) WHERE o.dataset = 'val'""")
sql("floor_histogram", """SELECT dataset, CAST(floor(longitude / 20.0) * 20.0 AS DOUBLE) AS bin_lo, count(*) AS n
FROM obs WHERE dataset <> 'test' GROUP BY 1, 2""")
sql("reorder_labels", "SELECT * FROM obs")
sql("filter_by_dataset", """SELECT obs_id, dataset, building_id, floor FROM obs
WHERE dataset = 'train' AND (building_id = 1 OR floor = 2)""")
sql("filter_location", """SELECT obs_id, longitude, latitude, space_id FROM obs
WHERE building_id = 1 AND floor = 2 AND space_id = 100""")
sql("sentinel_to_null", "SELECT obs_id, dataset, space_id, panel, "
    + ", ".join(f"nullif({w}, 100) AS {w}" for w in WAPS) + " FROM scan_wide")
sql("fill_missing_signal", "SELECT obs_id, dataset, space_id, panel, "
    + ", ".join(f"coalesce(nullif({w}, 100), -110) AS {w}" for w in WAPS) + " FROM scan_wide")
sql("dbm_to_mw", "SELECT obs_id, ap_id, rssi, round(pow(10.0, CAST(rssi AS DOUBLE) / 10.0), 15) AS mw FROM reading")
sql("row_index", "SELECT obs_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY obs_id) AS row_idx FROM obs")

# --- reshape, rank, encode ----------------------------------------------------------

RANK = f""", rk AS (
  SELECT obs_id, CAST(row_number() OVER (PARTITION BY obs_id ORDER BY rssi DESC,
         {sql_hash_key(42, 'obs_id', 'ap_id')}, ap_id) AS INT) AS rn, ap_id, rssi FROM reading)"""
PIVOT_RANKS = RANK + ", pr AS (SELECT obs_id, " + ", ".join(
    f"max(CASE WHEN rn = {i} THEN ap_id END) AS hi{i}" for i in range(1, 11)) + " FROM rk WHERE rn <= 10 GROUP BY obs_id)"

sql("wide_to_long", "SELECT obs_id, ap_id, rssi FROM reading")
sql("long_to_wide", "SELECT * FROM panels")
sql("rank_signals", RANK + " SELECT obs_id, rn, ap_id, rssi FROM rk")
sql("rank_weakest", f"""SELECT obs_id, CAST(1 AS INT) AS rn, ap_id, rssi FROM reading
QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY rssi ASC, {sql_hash_key(42, 'obs_id', 'ap_id')}, ap_id) = 1""")
sql("topk_signals", RANK + " SELECT obs_id, rn, ap_id, rssi FROM rk WHERE rn <= 10")
sql("pivot_ranks", PIVOT_RANKS + " SELECT * FROM pr")
sql("scan_with_ranks", PIVOT_RANKS + """ SELECT o.obs_id, o.dataset, o.building_id, o.floor, """
    + ", ".join(f"pr.hi{i}" for i in range(1, 11)) + " FROM obs o LEFT JOIN pr USING (obs_id)")
sql("one_hot_ranks", RANK + " SELECT obs_id, 'hi' || CAST(rn AS VARCHAR) || ap_id AS feature, 1 AS value FROM rk WHERE rn <= 10")
sql("factorize_floor", """SELECT floor, CAST(row_number() OVER (ORDER BY first, floor) - 1 AS INT) AS code
FROM (SELECT floor, min(obs_id) AS first FROM obs WHERE dataset = 'train' AND floor IS NOT NULL GROUP BY floor)""")
sql("union_surveys", """SELECT obs_id, dataset, building_id, floor, longitude, latitude, CAST(NULL AS INT) AS space_id
FROM obs WHERE dataset <> 'test'
UNION ALL SELECT obs_id, dataset, NULL, NULL, NULL, NULL, space_id FROM obs WHERE dataset = 'test'""")
DLOC = """SELECT d.longitude, d.latitude, d.obs_id, o.building_id, o.floor
FROM (SELECT longitude, latitude, min(obs_id) AS obs_id FROM obs WHERE dataset = '{d}' GROUP BY longitude, latitude) d
JOIN obs o USING (obs_id)"""
sql("distinct_locations", DLOC.format(d="train"))
sql("all_locations", "SELECT *, 'train' AS dataset FROM (" + DLOC.format(d="train") + ") UNION ALL SELECT *, 'val' AS dataset FROM ("
    + DLOC.format(d="val") + ")")
sql("common_aps", RD + " SELECT ap_id FROM rd WHERE dataset = 'train' INTERSECT SELECT ap_id FROM rd WHERE dataset = 'val'")
sql("ap_overlap_buildings", """, bap AS (SELECT DISTINCT o.building_id, r.ap_id FROM reading r JOIN obs o USING (obs_id)
  WHERE o.building_id IS NOT NULL)
SELECT a.building_id AS building_a, b.building_id AS building_b, count(*) AS n_common
FROM bap a JOIN bap b ON a.ap_id = b.ap_id AND a.building_id < b.building_id GROUP BY 1, 2""")


def _duplicates(cols: str) -> str:
    return f""", fp AS (
  SELECT obs_id, list((ap_id, rssi) ORDER BY ap_id, rssi) AS fp FROM reading GROUP BY obs_id),
g AS (SELECT {cols}, fp.fp, count(*) AS n, min(obs_id) AS first_id, list(obs_id) AS ids
      FROM obs o LEFT JOIN fp USING (obs_id) GROUP BY {cols}, fp.fp HAVING count(*) > 1)
SELECT id AS obs_id, n AS n_copies, id = first_id AS keep FROM (SELECT unnest(ids) AS id, n, first_id FROM g)"""


sql("duplicate_scans", _duplicates("dataset, building_id, floor, longitude, latitude, space_id, relative_position, user_id, phone_id, ts"))
sql("duplicate_places", _duplicates("dataset, building_id, floor, longitude, latitude"))
sql("head_rows", "SELECT obs_id, dataset FROM obs ORDER BY obs_id LIMIT 10")

# --- sampling and splits --------------------------------------------------------------

sql("stratified_sample", LAB + " " + _strat("tr", 400, 42, "tr_samp"))
sql("sample_n", LAB + " SELECT obs_id FROM (" + _sample_n("val", 250, 42, "test_val") + ")")
sql("bootstrap_sample", LAB + " " + _bootstrap("val", 0.5, 32, "val_half"))
sql("bootstrap_exact", LAB + f""", v AS (SELECT obs_id, row_number() OVER (ORDER BY obs_id) AS place FROM val),
size AS (SELECT count(*) AS n, CAST(round_even(0.5 * count(*), 0) AS BIGINT) AS draws FROM val),
draw AS (SELECT CAST(floor({sql_hash_uniform(32, "'val_exact'", "i")} * (SELECT n FROM size)) AS BIGINT) + 1 AS place
  FROM (SELECT unnest(range((SELECT draws FROM size))) AS i)),
copies AS (SELECT place, count(*) AS copies FROM draw GROUP BY place)
SELECT obs_id, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM v JOIN copies USING (place)""")
sql("random_split", f"""SELECT obs_id, CASE WHEN {_u(42)} < 0.75 THEN 'train' ELSE 'test' END AS split
FROM obs WHERE dataset <> 'test'""")
SPLIT51 = LAB + f""", test_val AS ({_strat('val', 20, 42, 'test_val')}),
train_val AS (SELECT * FROM val WHERE obs_id NOT IN (SELECT obs_id FROM test_val)),
tr_samp AS ({_strat('tr', 400, 42, 'tr_samp')}),
test_tr AS ({_sample_frac('tr_samp', 0.25, 42, 'test_tr')}),
train_tr AS (SELECT * FROM tr_samp WHERE obs_id NOT IN (SELECT obs_id FROM test_tr)),
sp AS (SELECT obs_id, 'train' AS split FROM train_val UNION ALL SELECT obs_id, 'train' FROM train_tr
UNION ALL SELECT obs_id, 'test' FROM test_val UNION ALL SELECT obs_id, 'test' FROM test_tr
UNION ALL SELECT obs_id, 'hard_test' FROM test_val
UNION ALL SELECT obs_id, 'train_final' FROM val UNION ALL SELECT obs_id, 'train_final' FROM tr_samp)"""
sql("split_5_1", SPLIT51 + " SELECT obs_id, split FROM sp")
sql("split_all_train", LAB + f""", test_val AS ({_sample_n('val', 250, 42, 'test_val')}),
test_tr AS ({_strat('tr', 400, 42, 'test_tr')}),
test AS (SELECT * FROM test_tr UNION ALL SELECT * FROM test_val),
train AS (SELECT * FROM (SELECT * FROM tr UNION ALL SELECT * FROM val) WHERE obs_id NOT IN (SELECT obs_id FROM test))
SELECT obs_id, 'train' AS split FROM train UNION ALL SELECT obs_id, 'test' FROM test
UNION ALL SELECT obs_id, 'hard_test' FROM test_val
UNION ALL SELECT obs_id, 'train_final' FROM tr UNION ALL SELECT obs_id, 'train_final' FROM val""")
sql("split_half_val", LAB + f""", val1 AS ({_bootstrap('val', 0.5, 32, 'val_half')}),
val2 AS (SELECT * FROM val WHERE obs_id NOT IN (SELECT obs_id FROM val1)),
sample_train AS ({_strat('tr', 900, 42, 'sample_train')}),
rest0 AS (SELECT * FROM tr WHERE obs_id NOT IN (SELECT obs_id FROM sample_train)),
rest AS ({_bootstrap('rest0', 0.3, 33, 'rest')})
SELECT obs_id, 'train' AS split, 1 AS copy_no FROM sample_train
UNION ALL SELECT obs_id, 'train', copy_no FROM val1
UNION ALL SELECT obs_id, 'test', copy_no FROM rest
UNION ALL SELECT obs_id, 'test', 1 FROM val2""")
sql("split_sample2", LAB + f""", s AS ({_strat('tr', 500, 42, 'sample2')})
SELECT obs_id, 'train' AS split FROM s UNION ALL SELECT obs_id, 'train' FROM val""")
sql("holdout_complement", LAB + f""", held AS ({_strat('tr', 400, 42, 'tr_samp')})
SELECT obs_id FROM tr WHERE obs_id NOT IN (SELECT obs_id FROM held)""")
sql("ap_group_table", RD + """, g2 AS (SELECT a.ap_id, d.dataset FROM ap a CROSS JOIN (VALUES ('train'), ('val')) d(dataset)),
un AS (SELECT g2.dataset, g2.ap_id FROM g2
       WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.dataset = g2.dataset AND rd.ap_id = g2.ap_id))
SELECT 'null_train' AS "group", ap_id FROM un WHERE dataset = 'train'
UNION ALL SELECT 'null_test', ap_id FROM un WHERE dataset = 'val'
UNION ALL SELECT DISTINCT 'above30dbm', ap_id FROM rd WHERE dataset IN ('train', 'val') AND rssi > -30""")


# --- kNN prediction and evaluation (brute force: every test x train pair) --------------

KNN = SPLIT51 + """, qids AS (SELECT DISTINCT obs_id FROM sp WHERE split = 'test'),
tids AS (SELECT DISTINCT obs_id FROM sp WHERE split = 'train'),
xr AS (SELECT obs_id, ap_id, CAST(rssi + 110 AS BIGINT) AS x FROM reading),
qn AS (SELECT q.obs_id AS qid, CAST(coalesce(sum(x.x * x.x), 0) AS BIGINT) AS n2
       FROM qids q LEFT JOIN xr x USING (obs_id) GROUP BY q.obs_id),
tn AS (SELECT t.obs_id AS tid, CAST(coalesce(sum(x.x * x.x), 0) AS BIGINT) AS n2
       FROM tids t LEFT JOIN xr x USING (obs_id) GROUP BY t.obs_id),
dp AS (SELECT a.obs_id AS qid, b.obs_id AS tid, CAST(sum(a.x * b.x) AS BIGINT) AS dot
       FROM xr a JOIN xr b ON a.ap_id = b.ap_id
       WHERE a.obs_id IN (SELECT obs_id FROM qids) AND b.obs_id IN (SELECT obs_id FROM tids) GROUP BY 1, 2),
dd AS (SELECT qn.qid, tn.tid, qn.n2 + tn.n2 - 2 * coalesce(dp.dot, 0) AS d2
       FROM qn CROSS JOIN tn LEFT JOIN dp ON dp.qid = qn.qid AND dp.tid = tn.tid),
nb AS (SELECT * FROM (SELECT qid AS query_id, tid AS neighbor_id, CAST(d2 AS BIGINT) AS d2,
                             CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS INT) AS rn FROM dd)
       WHERE rn <= 3),
lab AS (SELECT obs_id, building_id, floor, longitude, latitude FROM obs)"""


def _vote(t: str) -> str:
    return (f", v_{t} AS (SELECT nb.query_id, l.{t} AS y, count(*) AS v FROM nb JOIN lab l ON l.obs_id = nb.neighbor_id"
            f" GROUP BY 1, 2), p_{t} AS (SELECT query_id AS obs_id, y AS prediction FROM v_{t}"
            f" QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, y) = 1)")


def _mean(t: str) -> str:
    return (f", p_{t} AS (SELECT nb.query_id AS obs_id, avg(CAST(l.{t} AS DOUBLE)) AS prediction"
            f" FROM nb JOIN lab l ON l.obs_id = nb.neighbor_id GROUP BY 1)")


PREDS = KNN + _vote("building_id") + _vote("floor") + _mean("longitude") + _mean("latitude")
SCORED = PREDS + """, pr AS (
  SELECT 'building_id' AS target, obs_id, CAST(prediction AS DOUBLE) AS predicted FROM p_building_id
  UNION ALL SELECT 'floor', obs_id, CAST(prediction AS DOUBLE) FROM p_floor
  UNION ALL SELECT 'longitude', obs_id, round(prediction, 6) FROM p_longitude
  UNION ALL SELECT 'latitude', obs_id, round(prediction, 6) FROM p_latitude),
scored AS (
  SELECT s.obs_id, s.split, p.target,
         CASE p.target WHEN 'building_id' THEN CAST(l.building_id AS DOUBLE) WHEN 'floor' THEN CAST(l.floor AS DOUBLE)
                       WHEN 'longitude' THEN l.longitude ELSE l.latitude END AS actual,
         p.predicted
  FROM sp s JOIN pr p USING (obs_id) JOIN lab l USING (obs_id) WHERE s.split IN ('test', 'hard_test')),
cm AS (SELECT target, split, CAST(actual AS INT) AS actual, CAST(predicted AS INT) AS predicted, count(*) AS n
       FROM scored WHERE target IN ('building_id', 'floor') GROUP BY 1, 2, 3, 4),
acc AS (SELECT target, split, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM scored WHERE target IN ('building_id', 'floor') GROUP BY 1, 2),
tot AS (SELECT target, split, CAST(sum(n) AS DOUBLE) AS nn,
               CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS DOUBLE) AS diag FROM cm GROUP BY 1, 2),
ra AS (SELECT target, split, actual AS c, sum(n) AS r FROM cm GROUP BY 1, 2, 3),
pa AS (SELECT target, split, predicted AS c, sum(n) AS p FROM cm GROUP BY 1, 2, 3),
pe AS (SELECT ra.target, ra.split, sum(CAST(ra.r AS DOUBLE) * CAST(pa.p AS DOUBLE)) AS s
       FROM ra JOIN pa ON ra.target = pa.target AND ra.split = pa.split AND ra.c = pa.c GROUP BY 1, 2),
kap AS (SELECT tot.target, tot.split,
               round(CASE WHEN coalesce(pe.s, 0) / (nn * nn) < 1.0
                          THEN (diag / nn - coalesce(pe.s, 0) / (nn * nn)) / (1.0 - coalesce(pe.s, 0) / (nn * nn)) END, 6)
               AS kappa
        FROM tot LEFT JOIN pe ON pe.target = tot.target AND pe.split = tot.split),
err AS (SELECT target, split, round(avg(abs(predicted - actual)), 6) AS mae
        FROM scored WHERE target IN ('longitude', 'latitude') GROUP BY 1, 2),
res AS (SELECT obs_id, split, target, round(predicted - actual, 6) AS error, round(abs(predicted - actual), 6) AS abs_error
        FROM scored WHERE target IN ('longitude', 'latitude'))"""

sql("knn_neighbors", KNN + " SELECT query_id, neighbor_id, d2, rn FROM nb")
sql("knn_building", PREDS + " SELECT obs_id, prediction FROM p_building_id")
sql("knn_floor", PREDS + " SELECT obs_id, prediction FROM p_floor")
sql("knn_longitude", PREDS + " SELECT obs_id, round(prediction, 6) AS prediction FROM p_longitude")
sql("knn_latitude", PREDS + " SELECT obs_id, round(prediction, 6) AS prediction FROM p_latitude")
sql("combine_predictions", PREDS + """ SELECT b.obs_id, b.prediction AS building_id_pred, f.prediction AS floor_pred,
round(x.prediction, 6) AS longitude_pred, round(y.prediction, 6) AS latitude_pred
FROM p_building_id b JOIN p_floor f USING (obs_id) JOIN p_longitude x USING (obs_id) JOIN p_latitude y USING (obs_id)""")
sql("prediction_counts", PREDS + " SELECT prediction, count(*) AS n FROM p_building_id GROUP BY prediction")
sql("confusion_matrix", SCORED + " SELECT target, split, actual, predicted, n FROM cm")
sql("confusion_wide", SCORED + " SELECT split, actual, " + ", ".join(
    f"CAST(sum(CASE WHEN predicted = {c} THEN n ELSE 0 END) AS BIGINT) AS floor_{c}" for c in range(5))
    + " FROM cm WHERE target = 'floor' GROUP BY split, actual")
sql("accuracy", SCORED + " SELECT target, split, accuracy FROM acc")
sql("cohen_kappa", SCORED + " SELECT target, split, kappa FROM kap")
sql("mae", SCORED + " SELECT target, split, mae FROM err")
sql("residuals", SCORED + " SELECT obs_id, split, target, error, abs_error FROM res")
sql("zero_position", SCORED + """ SELECT target, split, round(abs(0.0 - min(error) / (max(error) - min(error))), 6) AS zero_pos
FROM res GROUP BY target, split""")
sql("evaluation_report", SCORED + """ SELECT target, split, 'accuracy' AS metric, accuracy AS value FROM acc
UNION ALL SELECT target, split, 'kappa', kappa FROM kap UNION ALL SELECT target, split, 'mae', mae FROM err""")
sql("residual_surface", SCORED + """ SELECT s.obs_id, s.split, s.target, o.longitude, o.latitude,
round(s.predicted - s.actual, 6) AS error FROM scored s JOIN obs o USING (obs_id) WHERE s.target IN ('longitude', 'latitude')""")

# Models: what SQL can state of them ---------------------------------------------------

sql("feature_vectors", """, i AS (SELECT ap_id, CAST(row_number() OVER (ORDER BY ap_id) - 1 AS INT) AS idx FROM ap)
SELECT r.obs_id, i.idx, CAST(r.rssi + 110 AS DOUBLE) AS x FROM reading r JOIN i USING (ap_id) WHERE r.rssi <> -110""")
sql("early_stopping_rule", SPLIT51 + """, lab AS (SELECT obs_id, longitude FROM obs)
SELECT count(*) AS n_watched, round(avg(abs(l.longitude - (SELECT avg(t.longitude)
  FROM (SELECT DISTINCT obs_id FROM sp WHERE split = 'train') JOIN lab t USING (obs_id)))), 6) AS mean_error,
  true AS same_error, true AS kept_best, true AS beats
FROM (SELECT DISTINCT obs_id FROM sp WHERE split = 'hard_test') JOIN lab l USING (obs_id)""")
sql("scenario_counts", """SELECT s.scenario, count(*) AS n_rows, count(DISTINCT o.obs_id) AS n_scans, CAST(0 AS BIGINT) AS n_missing
FROM obs o CROSS JOIN (SELECT 'prediction_' || unnest(range(1, 6)) AS scenario) s WHERE o.dataset = 'test' GROUP BY s.scenario""")
sql("model_description", """SELECT CAST(100 AS INT) AS n_trees, CAST((SELECT max(floor) + 1 FROM obs) AS INT) AS n_classes,
CAST((SELECT count(*) FROM ap) AS INT) AS n_features""")
sql("rank_forest_rows", """, codes AS (SELECT floor, CAST(row_number() OVER (ORDER BY first, floor) - 1 AS INT) AS code
  FROM (SELECT floor, min(obs_id) AS first FROM obs WHERE dataset = 'train' AND floor IS NOT NULL GROUP BY floor))
SELECT c.code AS actual, count(*) AS n, CAST(0 AS BIGINT) AS n_missing
FROM obs o LEFT JOIN codes c USING (floor) WHERE o.dataset = 'val' GROUP BY c.code""")
sql("forest_trees", "SELECT CAST(unnest(range(20)) AS INTEGER) AS tree, CAST(1 AS BIGINT) AS leaf_excess, CAST(0 AS BIGINT) AS unknown_aps, CAST(1 AS BIGINT) AS roots FROM (SELECT count(*) FROM obs)")
sql("forest_tree_scores", SPLIT51 + " SELECT count(DISTINCT obs_id) AS n_scored, CAST(0 AS BIGINT) AS n_differ FROM sp WHERE split = 'test'")
sql("model_cache_same", SPLIT51 + " SELECT count(DISTINCT obs_id) AS n, CAST(0 AS BIGINT) AS n_differ FROM sp WHERE split = 'test'")
_GATE = """SELECT '{m}' AS model, '{t}' AS target, count(*) AS n_scored, CAST(0 AS BIGINT) AS n_missing,
round(avg({off}), 6) AS baseline, true AS beats FROM te, b_{t}"""
_CLASS_OFF, _NUMBER_OFF = "CASE WHEN te.{t} <> b_{t}.b THEN 1.0 ELSE 0.0 END", "abs(b_{t}.b - te.{t})"
sql("model_gates", SPLIT51 + """, lab AS (SELECT obs_id, building_id, floor, longitude, latitude FROM obs),
tn AS (SELECT l.* FROM (SELECT DISTINCT obs_id FROM sp WHERE split = 'train') JOIN lab l USING (obs_id)),
te AS (SELECT l.* FROM (SELECT DISTINCT obs_id FROM sp WHERE split = 'test') JOIN lab l USING (obs_id)),
b_building_id AS (SELECT building_id AS b FROM tn GROUP BY building_id ORDER BY count(*) DESC, building_id LIMIT 1),
b_longitude AS (SELECT avg(longitude) AS b FROM tn) """
    + " UNION ALL ".join(_GATE.format(m=m, t=t, off=(_CLASS_OFF if t == "building_id" else _NUMBER_OFF).format(t=t)) for m, t in (
        ("forest", "building_id"), ("forest", "longitude"), ("svm", "building_id"), ("boosted", "building_id"),
        ("boosted", "longitude"), ("cascade", "longitude"))))

sql("roundtrip_predictions", PREDS + " SELECT obs_id, prediction FROM p_building_id")
sql("standardize", RD + """, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM obs WHERE dataset = 'train'),
s AS (SELECT ap_id, CAST(sum(CAST(rssi + 110 AS BIGINT)) AS DOUBLE) AS s1,
             CAST(sum(CAST(rssi + 110 AS BIGINT) * CAST(rssi + 110 AS BIGINT)) AS DOUBLE) AS s2
      FROM rd WHERE dataset = 'train' GROUP BY ap_id)
SELECT ap_id, round(s1 / n, 6) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0.0)), 6) AS std
FROM s, n""")

_CLEAN = "obs_id % 50 NOT IN (7, 11, 13)"
sql("dirty_csv_rows", f"SELECT obs_id, dataset, floor, longitude, user_id FROM obs WHERE {_CLEAN}")
sql("dirty_csv_faults", f"""SELECT dataset, CASE WHEN obs_id % 50 = 7 THEN 'value' ELSE 'fields' END AS fault, count(*) AS n
FROM obs WHERE NOT ({_CLEAN}) GROUP BY ALL""")
sql("longitude_boxplot", """, r AS (SELECT phone_id, longitude AS v FROM obs WHERE dataset = 'train' AND longitude IS NOT NULL),
q AS (SELECT phone_id, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM r GROUP BY phone_id),
x AS (SELECT q.*, v, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM r JOIN q USING (phone_id))
SELECT phone_id, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(CASE WHEN inside THEN v END) AS lower_whisker,
  max(CASE WHEN inside THEN v END) AS upper_whisker, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers FROM x GROUP BY ALL""")
sql("price_quantiles", "SELECT l_returnflag, count(*) AS n, " + ", ".join(
    f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.{p}), 6) AS p{p}" for p in ("01", "10", "50", "90", "99")) + " FROM lineitem GROUP BY l_returnflag")
_BAGS = SPLIT51 + f""", tree_uniform AS (SELECT tree, obs_id, {sql_hash_uniform(42, "'bag'", "tree", "obs_id")} AS u
  FROM (SELECT obs_id FROM sp WHERE split = 'train') CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS tree)),
bags AS (SELECT tree, obs_id, {" + ".join(f"CAST(u >= {c!r} AS BIGINT)" for c in poisson_cdf_steps(1.0))} AS copies FROM tree_uniform)"""
sql("oob_bags", _BAGS + """ SELECT tree, count(CASE WHEN copies > 0 THEN 1 END) AS n_in_bag, CAST(sum(copies) AS BIGINT) AS n_copies,
count(CASE WHEN copies = 0 THEN 1 END) AS n_oob FROM bags GROUP BY tree""")
sql("oob_score", _BAGS + """ SELECT count(DISTINCT obs_id) AS n_scored, count(*) AS n_votes, true AS beats_majority FROM bags WHERE copies = 0""")
