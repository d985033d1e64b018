"""Invariants and hand-made edge cases (small inputs built in the test)."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from radiomap.functions import signal as sig
from radiomap.operators import clean, features, indexing, knn, rank, reshape, sampling, search, splits
from radiomap.sources import fixtures as fx
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def survey_mid(spark):
    return fx.survey(spark, SF_MID)


def test_stratified_exact_n_and_small_groups(spark, survey_mid):
    obs, _ = survey_mid
    tr = obs.filter(F.col("dataset") == "train")
    sizes = {(r.building_id, r.floor): r["count"] for r in tr.groupBy("building_id", "floor").count().collect()}
    for n in (400, 100000):
        got = {(r.building_id, r.floor): r["count"] for r in
               sampling.stratified_sample(tr, ["building_id", "floor"], n).groupBy("building_id", "floor")
               .count().collect()}
        assert got == {k: min(n, v) for k, v in sizes.items()}


def test_large_n_path_equals_window(spark, survey_mid):
    obs, _ = survey_mid
    tr = obs.filter(F.col("dataset") == "train").select("obs_id", "building_id", "floor")
    big = sampling.stratified_sample(tr, ["building_id", "floor"], 1200, salt="s")
    w = Window.partitionBy("building_id", "floor").orderBy(sampling.draw_order(42, "obs_id", "s"), "obs_id")
    ref = tr.withColumn("rn", F.row_number().over(w)).filter("rn <= 1200").drop("rn")
    assert sorted(big.select("obs_id").collect()) == sorted(ref.select("obs_id").collect())


def test_sample_stable_under_repartition(spark, survey_mid):
    obs, _ = survey_mid
    a = sampling.sample_n(obs.repartition(3), 250).select("obs_id").collect()
    b = sampling.sample_n(obs.repartition(7, "dataset"), 250).select("obs_id").collect()
    assert sorted(a) == sorted(b) and len(a) == 250


def test_split_5_1_sets(spark, survey_mid):
    obs, _ = survey_mid
    sp = splits.split_5_1(obs)
    by = {}
    for r in sp.collect():
        by.setdefault(r.split, set()).add(r.obs_id)
    assert not (by["train"] & by["test"])
    assert by["hard_test"] <= by["test"]
    val = {r.obs_id for r in obs.filter(F.col("dataset") == "val").select("obs_id").collect()}
    assert val <= by["train_final"]
    assert by["hard_test"] <= val


def test_rank_invariants(spark, survey_mid):
    _, r = survey_mid
    ranked = rank.rank_signals(r).toPandas().sort_values(["obs_id", "rn"])
    for _, g in ranked.groupby("obs_id"):
        assert list(g.rn) == list(range(1, len(g) + 1))
        assert (np.diff(g.rssi.to_numpy()) <= 0).all()


def test_rank_all_ties_deterministic(spark):
    r = spark.createDataFrame([(1, f"WAP{i:04d}", -50) for i in range(1, 8)], "obs_id long, ap_id string, rssi int")
    a = [x.ap_id for x in rank.rank_signals(r).orderBy("rn").collect()]
    b = [x.ap_id for x in rank.rank_signals(r.repartition(4)).orderBy("rn").collect()]
    assert a == b and sorted(a) == sorted(f"WAP{i:04d}" for i in range(1, 8))


def test_one_hot_row_sum(spark, survey_mid):
    obs, r = survey_mid
    k = 2
    oh = reshape.one_hot_ranks(rank.topk_signals(r, k=k), k=k).groupBy("obs_id").agg(F.sum("value").alias("s"))
    sc = clean.signal_count(obs, r)
    bad = sc.join(oh, "obs_id", "left").filter(F.coalesce("s", F.lit(0)) != F.least("sig_count", F.lit(k)))
    assert bad.count() == 0


def test_wide_long_roundtrip(spark, survey_mid):
    _, r = survey_mid
    names = [x.ap_id for x in r.select("ap_id").distinct().orderBy("ap_id").collect()]
    wide = reshape.long_to_wide(r, names)
    back = reshape.wide_to_long(wide, ["obs_id"], [c for c in wide.columns if c != "obs_id"], sentinel=None)
    assert back.exceptAll(r.select("obs_id", "ap_id", "rssi")).count() == 0
    assert r.select("obs_id", "ap_id", "rssi").exceptAll(back).count() == 0


def test_row_index_matches_row_number(spark, survey_mid):
    obs, _ = survey_mid
    o = obs.select("obs_id", "dataset")
    got = indexing.row_index(o, ["obs_id"], group_cols=["dataset"], name="i")
    ref = o.withColumn("i", F.row_number().over(Window.partitionBy("dataset").orderBy("obs_id")).cast("bigint"))
    assert got.exceptAll(ref).count() == 0 and got.count() == ref.count()


def test_sentinel_only_in_signal_columns(spark):
    df = spark.createDataFrame([(1, 100, 100, -50), (2, 7, -60, 100)],
                               "obs_id long, space_id int, WAP0001 int, WAP0002 int")
    out = sig.sentinel_to_null(df, ["WAP0001", "WAP0002"]).orderBy("obs_id").collect()
    assert out[0].space_id == 100 and out[0].WAP0001 is None and out[0].WAP0002 == -50
    filled = sig.fill_missing(sig.sentinel_to_null(df, ["WAP0001", "WAP0002"]), ["WAP0001", "WAP0002"])
    assert [r.WAP0002 for r in filled.orderBy("obs_id").collect()] == [-50, -110]


def test_varying_aps_counts_fill_value(spark):
    obs = spark.createDataFrame([(1, "train"), (2, "train"), (3, "train")], "obs_id long, dataset string")
    r = spark.createDataFrame([(1, "A", -110), (2, "B", -50), (3, "B", -50), (1, "C", -40), (2, "C", -41)],
                              "obs_id long, ap_id string, rssi int")
    got = {x.ap_id: x.n_distinct for x in clean.varying_aps(obs, r).collect()}
    # A: -110 heard + -110 fill -> constant; B: -50, -50, fill -> 2; C: -40, -41, fill -> 3
    assert got == {"B": 2, "C": 3}


def test_unheard_and_empty_scans(spark):
    obs = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "obs_id long, dataset string")
    r = spark.createDataFrame([(1, "A", -50)], "obs_id long, ap_id string, rssi int")
    ap = spark.createDataFrame([(0, "A"), (1, "B")], "ap_no long, ap_id string")
    un = {(x.dataset, x.ap_id) for x in clean.unheard_aps(obs, r, ap).collect()}
    assert un == {("train", "B"), ("val", "A"), ("val", "B"), ("test", "A"), ("test", "B")}
    assert {x.obs_id: x.sig_count for x in clean.signal_count(obs, r).collect()} == {1: 1, 2: 0, 3: 0}
    assert [x.obs_id for x in clean.drop_empty_scans(obs, r).collect()] == [1]


def _dense(rows, ids, aps):
    pos = {a: i for i, a in enumerate(aps)}
    m = {i: np.zeros(len(aps)) for i in ids}
    for o, a, v in rows:
        if o in m:
            m[o][pos[a]] = v + 110
    return m


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_knn_equals_brute_force(spark, sf):
    obs, r = fx.survey(spark, sf)
    q = obs.filter(F.col("dataset") == "val").select("obs_id")
    t = obs.filter(F.col("dataset") == "train").select("obs_id")
    got = sorted((x.query_id, x.rn, x.neighbor_id, x.d2) for x in knn.knn_neighbors(q, t, r, k=3).collect())
    rows = [(x.obs_id, x.ap_id, x.rssi) for x in r.collect()]
    aps = sorted({a for _, a, _ in rows})
    qids = [x.obs_id for x in q.collect()]
    tids = sorted(x.obs_id for x in t.collect())
    if sf == SF_MID:
        qids = qids[:150]
        got = [g for g in got if g[0] in set(qids)]
    qm, tm = _dense(rows, qids, aps), _dense(rows, tids, aps)
    T = np.stack([tm[i] for i in tids])
    ref = []
    for qi in qids:
        d2 = ((T - qm[qi]) ** 2).sum(axis=1).astype(np.int64)
        order = sorted(range(len(tids)), key=lambda j: (d2[j], tids[j]))[:3]
        ref += [(qi, n + 1, tids[j], int(d2[j])) for n, j in enumerate(order)]
    assert got == sorted(ref)


def test_knn_vote_tie_goes_to_smallest(spark):
    nb = spark.createDataFrame([(9, 1, 0, 1), (9, 2, 0, 2)], "query_id long, neighbor_id long, d2 long, rn int")
    lab = spark.createDataFrame([(1, 2), (2, 1)], "obs_id long, floor int")
    assert knn.knn_classify(nb, lab, "floor").collect()[0].prediction == 1


def test_bootstrap_zero_share(spark, survey_mid):
    obs, _ = survey_mid
    val = obs.filter(F.col("dataset") == "val").select("obs_id")
    n = val.count()
    drawn = sampling.bootstrap(val, 0.5, seed=32).select("obs_id").distinct().count()
    assert abs((n - drawn) / n - math.exp(-0.5)) < 0.05


def test_poisson_steps_and_patience():
    steps = sampling.poisson_cdf_steps(0.5)
    assert all(a < b for a, b in zip(steps, steps[1:])) and 1 - steps[-1] < 1e-15
    assert abs(steps[0] - math.exp(-0.5)) < 1e-15
    assert search.patience_stop([5, 4, 3, 3.5, 3.2, 3.1], patience=3) == (3, 6)
    assert search.patience_stop([5, 4, 3, 2], patience=3) == (4, 4)


def test_feature_vectors_ignore_unseen_ap(spark):
    scans = spark.createDataFrame([(1,), (2,)], "obs_id long")
    r = spark.createDataFrame([(1, "A", -10), (1, "Z", -20), (2, "B", -110)], "obs_id long, ap_id string, rssi int")
    idx = spark.createDataFrame([("A", 0), ("B", 1)], "ap_id string, idx int")
    got = {x.obs_id: list(x.features) for x in features.feature_vectors(scans, r, idx, 2).collect()}
    assert got == {1: [100.0, 0.0], 2: [0.0, 0.0]}


def test_duplicate_scans_groups(spark):
    obs = spark.createDataFrame([(1, "train", 0), (2, "train", 0), (3, "train", 1), (4, "train", 0)],
                                "obs_id long, dataset string, floor int")
    r = spark.createDataFrame([(1, "A", -50), (2, "A", -50), (3, "A", -50), (4, "A", -51)],
                              "obs_id long, ap_id string, rssi int")
    got = {x.obs_id: (x.n_copies, x.keep) for x in reshape.duplicate_scans(obs, r, cols=("dataset", "floor")).collect()}
    assert got == {1: (2, True), 2: (2, False)}
    assert sorted(x.obs_id for x in reshape.drop_duplicate_scans(obs, r, cols=("dataset", "floor")).collect()) == [1, 3, 4]


def test_sample_n_large_path_matches_take_ordered(spark, survey_mid, monkeypatch):
    obs, _ = survey_mid
    val = obs.filter(F.col("dataset") == "val").select("obs_id")
    small = sorted(sampling.sample_n(val, 300, salt="x").collect())
    monkeypatch.setattr(sampling, "TAKE_ORDERED_MAX_N", 10)
    large = sorted(sampling.sample_n(val, 300, salt="x").collect())
    assert small == large and len(small) == 300


def test_survey_csv_roundtrip(spark):
    from radiomap.sources import survey

    schema = survey.survey_schema(n_aps=3)
    rows = [(100, -50, 100, -7400.5, 4864800.25, 1, 0, 100, 2, 3, 11, 1371713733),
            (-60, 100, -70, -7300.0, 4864790.0, 2, 1, 7, 1, 4, 13, 1371713800)]
    df = spark.createDataFrame(rows, schema)
    back = survey.roundtrip_csv(spark, df, "survey-csv-test")
    assert sorted(back.collect()) == sorted(df.collect())
    long = reshape.wide_to_long(back.withColumn("obs_id", F.col("TIMESTAMP")), ["obs_id"],
                                ["WAP001", "WAP002", "WAP003"])
    assert sorted((r.ap_id, r.rssi) for r in long.collect()) == [("WAP001", -60), ("WAP002", -50), ("WAP003", -70)]


def test_stratified_equals_a_plain_window(spark, survey_mid):
    obs, _ = survey_mid
    rows = obs.filter(F.col("dataset") == "train").select("obs_id", "building_id", "floor")
    rows = rows.union(rows.limit(300).withColumn("floor", F.lit(None).cast("int")).withColumn("obs_id", -F.col("obs_id")))
    w = Window.partitionBy("building_id", "floor").orderBy(sampling.draw_order(42, "obs_id", "n"), "obs_id")
    for n in (1, 100, 750):
        ref = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
        got = sampling.stratified_sample(rows, ["building_id", "floor"], n, salt="n")
        assert got.exceptAll(ref).count() == 0 and got.count() == ref.count()


def test_ap_names_beyond_four_digits(spark):
    numbers = [0, 9, 9998, 9999, 10_000, 99_999, 100_000, 123_456_789]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").withColumn("name", fx.ap_name(F.col("n")))
    got = rows.select("n", "name", fx.ap_number(F.col("name")).alias("back")).orderBy("n").collect()
    assert [r.name for r in got[:5]] == ["WAP0001", "WAP0010", "WAP9999", "WAP10000", "WAP10001"]
    assert len({r.name for r in got}) == len(numbers) and all(r.n == r.back for r in got)


def test_wide_panels_hold_every_reading(spark):
    wide = fx.scan_wide(spark, SF_MID)
    heard = sum(F.when(F.col(c) != 100, 1).otherwise(0) for c in fx.WIDE_APS)
    assert wide.agg(F.sum(heard)).first()[0] == fx.reading(spark, SF_MID).count()


def test_knn_below_the_fill_value(spark):
    r = spark.createDataFrame([(1, "A", -50), (2, "A", -115), (3, "B", -104)], "obs_id long, ap_id string, rssi int")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "obs_id long")
    got = knn.knn_neighbors(ids.filter("obs_id = 1"), ids.filter("obs_id in (2, 3)"), r, k=1).collect()
    assert [(x.neighbor_id, x.d2) for x in got] == [(3, 3636)]
    got = knn.knn_neighbors(ids.filter("obs_id = 1"), ids.filter("obs_id <> 1"), r, k=3).collect()
    assert sorted((x.rn, x.neighbor_id, x.d2) for x in got) == [(1, 4, 3600), (2, 3, 3636), (3, 2, 4225)]


def test_knn_over_many_tiles(spark, monkeypatch):
    obs, r = fx.survey(spark, SF_SMALL)
    q, t = (obs.filter(F.col("dataset") == d).select("obs_id") for d in ("val", "train"))
    whole = sorted(knn.knn_neighbors(q, t, r).collect())
    monkeypatch.setattr(knn, "TILE_SCANS", 60)
    monkeypatch.setattr(knn, "_ROWS", 7)
    monkeypatch.setattr(knn, "_COLUMNS", 3)
    assert sorted(knn.knn_neighbors(q, t, r).collect()) == whole


def test_duplicates_by_every_column(spark):
    cols = "obs_id long, dataset string, floor int, user_id int, note string"
    rows = [(1, "train", 0, 5, "a|b"), (2, "train", 0, 5, "a|b"), (3, "train", 0, 6, "a|b"), (4, "test", None, 5, None),
            (5, "test", None, 5, None), (6, "test", None, 5, "null"), (7, "train", 0, 5, "a|b")]
    r = spark.createDataFrame([(i, "A", -50) for i in (1, 2, 3, 7)] + [(7, "B", -60)], "obs_id long, ap_id string, rssi int")
    got = {x.obs_id: (x.n_copies, x.keep) for x in reshape.duplicate_scans(spark.createDataFrame(rows, cols), r).collect()}
    assert got == {1: (2, True), 2: (2, False), 4: (2, True), 5: (2, False)}


def test_feature_vectors_take_repeated_readings(spark):
    from pyspark.ml.linalg import SparseVector

    scans = spark.createDataFrame([(1,), (2,)], "obs_id long")
    r = spark.createDataFrame([(1, "B", -50), (1, "B", -40), (1, "A", -110), (1, "Z", -1)], "obs_id long, ap_id string, rssi int")
    index = features.ap_index(spark.createDataFrame([("A",), ("B",), ("C",)], "ap_id string"))
    got = {x.obs_id: x.features for x in features.feature_vectors(scans, r, index, 3).collect()}
    assert all(isinstance(v, SparseVector) and v.size == 3 for v in got.values())
    assert got[1].toArray().tolist() == [0, 70, 0] and got[2].toArray().tolist() == [0, 0, 0]


def test_survey_tables_from_wide(spark):
    from radiomap.sources import survey

    schema = survey.survey_schema(n_aps=3)
    rows = [(100, -50, 100, -7400.5, 4864800.25, 1, 0, 100, 2, 3, 11, 1371713733),
            (100, 100, 100, -7300.0, 4864790.0, 2, 1, 7, 1, 4, 13, 1371713800)]
    obs, reading = survey.survey_tables(spark.createDataFrame(rows, schema), "train", name="survey-test")
    assert obs.count() == 2 and {"building_id", "floor", "space_id"} <= set(obs.columns)
    assert [(r.ap_id, r.rssi) for r in reading.collect()] == [("WAP002", -50)]
    assert {r.sig_count for r in clean.signal_count(obs, reading).collect()} == {0, 1}
    assert [r.space_id for r in obs.orderBy("ts").collect()] == [100, 7]


def test_empty_inputs(spark):
    obs = spark.createDataFrame([], "obs_id long, dataset string, building_id int, floor int, "
                                    "longitude double, latitude double")
    r = spark.createDataFrame([], "obs_id long, ap_id string, rssi int")
    ap = spark.createDataFrame([(0, "A")], "ap_no long, ap_id string")
    assert clean.signal_count(obs, r).count() == 0
    assert clean.varying_aps(obs, r).count() == 0
    assert clean.unheard_aps(obs, r, ap).count() == 3
    assert rank.rank_signals(r).count() == 0
    assert sampling.sample_n(obs, 5).count() == 0
    assert sampling.stratified_sample(obs, ["building_id", "floor"], 5).count() == 0
    assert indexing.row_index(obs.select("obs_id"), ["obs_id"]).count() == 0
    one = spark.createDataFrame([(1, "val", 0, 0, 1.0, 1.0)], obs.schema)
    r1 = spark.createDataFrame([(1, "A", -50)], r.schema)
    assert knn.knn_neighbors(one.select("obs_id"), obs.select("obs_id"), r1).count() == 0
    got = knn.knn_neighbors(one.select("obs_id"), one.select("obs_id"), r1).collect()
    assert [(x.query_id, x.neighbor_id, x.d2, x.rn) for x in got] == [(1, 1, 0, 1)]


def test_knn_stable_under_repartition(spark):
    obs, r = fx.survey(spark, SF_SMALL)
    q = obs.filter(F.col("dataset") == "val").select("obs_id")
    t = obs.filter(F.col("dataset") == "train").select("obs_id")
    a = knn.knn_neighbors(q, t, r).collect()
    b = knn.knn_neighbors(q.repartition(5), t.repartition(3), r.repartition(7)).collect()
    assert sorted(a) == sorted(b) and len(a) > 0
