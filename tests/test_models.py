import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalops.operators import decode as d, features as f, inference as i, resampling as m, reliability as rel


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({"id": range(n), "c": r.normal(9, 1, n), "x1": r.normal(size=n), "x2": r.normal(50, 3, n), "x3": r.normal(size=n)})
    pdf["y"] = 2 + 0.3 * pdf.c - 0.8 * pdf.x1 + 0.05 * pdf.x2 + r.normal(0, 0.5, n)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def _lstsq(pdf, xs):
    a = np.column_stack([np.ones(len(pdf)), pdf[xs]])
    b, *_ = np.linalg.lstsq(a, pdf.y, rcond=None)
    e = pdf.y - a @ b
    s2 = (e @ e) / (len(pdf) - a.shape[1])
    return a, b, np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a))), 1 - (e @ e) / ((pdf.y - pdf.y.mean()) ** 2).sum()


def test_ols_matches_lstsq(table):
    pdf, df = table
    xs = ["c", "x1", "x2"]
    got = i.ols(df, "y", xs).toPandas().set_index("term").loc[["const", *xs]]
    _, b, se, r2 = _lstsq(pdf, xs)
    assert np.allclose(got.beta, b) and np.allclose(got.se, se) and np.allclose(got.r2, r2)


def test_ols_p_values_match_spark_ml(spark, table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    _, df = table
    got = i.ols(df, "y", ["c", "x1"]).toPandas().set_index("term")
    s = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["c", "x1"], outputCol="features").transform(df)).summary
    assert np.allclose(got.loc[["c", "x1", "const"], "p_two_sided"], s.pValues, atol=1e-9)


def test_loo_equals_refits(table):
    pdf, df = table
    got = i.loo_predict(df, "y", ["c", "x1"]).toPandas().set_index("id").sort_index().loo
    for k in (0, 7, 59):
        a, b, *_ = _lstsq(pdf.drop(index=k), ["c", "x1"])
        assert np.isclose(got[k], b @ [1, pdf.c[k], pdf.x1[k]])


def test_block_f_and_directional_rows(table):
    pdf, df = table
    r = i.block_f(df, "y", ["c"], ["x1", "x2"]).first()
    full, cov = _lstsq(pdf, ["c", "x1", "x2"])[3], _lstsq(pdf, ["c"])[3]
    assert np.isclose(r.f_stat, ((full - cov) / 2) / ((1 - full) / 56)) and r.p_value < 1e-6
    h = i.hypothesis_test(df, "y", ["c"], ["x1", "x2"], {"x1": "negative", "x2": "negative"}, "id", reps=20).toPandas().set_index("term")
    assert h.loc["x1", "sign_matches"] and not h.loc["x2", "sign_matches"] and h.loc["x2", "p_one_sided"] > 0.5
    assert (h.n_iter == 20).all() and (h.ci_lo < h.beta).all() and (h.beta < h.ci_hi).all()


def test_infeasible_cells_are_named(spark, table):
    _, df = table
    h = i.run_tests(df.limit(4), ["y"], {"s": ["x1", "x2"]}, ["c"], {}, "id").first()
    assert h.skipped == "insufficient_complete_rows" and h.full_r2 is None


def test_bh_matches_hand_calculation(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "term string, p double")
    got = {r.term: r.p_corrected for r in i.adjust_p(t, "p", method="fdr_bh").collect()}
    assert np.isclose(got["a"], 0.03) and np.isclose(got["c"], 0.04) and np.isclose(got["b"], 0.04) and got["d"] is None


def test_univariate_scan_uses_each_features_own_rows(spark, table):
    pdf, df = table
    gaps = df.withColumn("x1", F.when(F.col("id") >= 10, F.col("x1"))).withColumn("x3", F.when(F.col("id") < 3, F.col("x3")))
    got = i.univariate_scan(gaps, "y", ["c"], ["x1", "x2", "x3"]).toPandas().set_index("term")
    assert got.n_used.to_dict() == {"x1": 50, "x2": 60, "x3": 3} and got.loc["x3", "note"] == "insufficient N"
    assert np.isclose(got.loc["x1", "beta"], _lstsq(pdf[pdf.id >= 10], ["c", "x1"])[1][2]) and np.isclose(got.loc["x2", "f_1df"], got.loc["x2", "t"] ** 2)


@pytest.mark.parametrize("parts", [1, 6])
def test_bootstrap_does_not_depend_on_partitions(table, parts):
    _, df = table
    got = i.bootstrap_ols(df.repartition(parts), "y", ["c", "x1"], "id", 40).toPandas().set_index("predictor").sort_index()
    want = i.bootstrap_ols(df, "y", ["c", "x1"], "id", 40).toPandas().set_index("predictor").sort_index()
    assert np.allclose(got.astype(float), want.astype(float))


def test_folds_are_balanced_and_stratified(table):
    pdf, df = table
    sizes = m.repeated_folds(df, "id", 7, 2).groupBy("rep", "fold").count().toPandas()["count"]
    assert len(sizes) == 14 and sizes.max() - sizes.min() <= 1
    s = m.assign_folds(df.withColumn("g", F.col("id") % 3), "id", 5, keys=["g"]).groupBy("g", "fold").count().toPandas()["count"]
    assert set(s) == {4}


def test_oof_scores_match_refits(table):
    pdf, df = table
    folded = m.assign_folds(df.select("id", "y", "x1"), "id", 5)
    got = m.oof_scores(m.oof_simple(folded, "y", "x1", "id"), "y").first()
    p, r2 = folded.toPandas(), []
    for k in range(5):
        tr, te = p[p.fold != k], p[p.fold == k]
        b, a = np.polyfit(tr.x1, tr.y, 1)
        r2.append(1 - ((te.y - a - b * te.x1) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum())
    assert np.isclose(got.oof_r2, np.mean(r2))


def test_permutation_keeps_every_target_value(table):
    pdf, df = table
    got = m.permuted_target(df, "y", "id", 3).toPandas()
    for _, g in got.groupby("rep"):
        assert np.allclose(sorted(g.y_perm), sorted(pdf.y)) and not np.allclose(g.sort_values("id").y_perm, pdf.y)
    assert m.permutation_p(df, "y", ["x1", "x3"], "id", 30).toPandas().set_index("feature").loc["x1", "p_max"] == 0.0


def test_elastic_net_solution_is_stationary():
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 4))
    y = x @ [1.0, 0.0, -0.5, 0.0] + r.normal(size=200)
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
    (w,), ok = m._enet((x.T @ x / 200)[None], (x.T @ y / 200)[None], np.array([0.1]), np.array([0.7]), np.zeros((1, 4)))
    assert ok.all()
    g = x.T @ (y - x @ w) / 200 - 0.1 * 0.3 * w
    near = 1e-4 * np.abs(x.T @ y / 200).max()
    assert np.allclose(g[w != 0], 0.07 * np.sign(w[w != 0]), atol=near) and (np.abs(g[w == 0]) <= 0.07 + near).all()


def test_elastic_net_of_nearly_equal_columns_is_stationary():
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 1)) + 0.03 * r.normal(size=(300, 8))
    y = x @ r.normal(size=8) + r.normal(size=300)
    x, y = (x - x.mean(0)) / x.std(0), y - y.mean()
    b = x.T @ y / 300
    for alpha in (0.5, 0.05, 0.005):
        (w,), ok = m._enet((x.T @ x / 300)[None], b[None], np.array([alpha]), np.array([0.5]), np.zeros((1, 8)))
        g = x.T @ (y - x @ w) / 300 - alpha * 0.5 * w
        near = 1e-4 * np.abs(b).max()
        assert ok.all() and np.allclose(g[w != 0], alpha * 0.5 * np.sign(w[w != 0]), atol=near) and (np.abs(g[w == 0]) <= alpha * 0.5 + near).all()


def test_elastic_net_predicts_out_of_fold(table):
    _, df = table
    p = m.elastic_net_oof(m.repeated_folds(df, "id", 5, 2), "y", ["c", "x1", "x2", "x3"], "id")
    s = m.oof_scores(p.withColumn("k", F.col("rep") * 5 + F.col("fold")), "y", fold="k").first()
    assert p.count() == 120 and s.oof_r2 > 0.5 and s.oof_mae < s.baseline_mae


def test_ml_grid_shape(table):
    _, df = table
    g = m.ml_grid(df, ["y"], {"theory": ["x1"], "hybrid": ["x1", "x2", "x3"]}, ["c"], "id", models=["elastic_net", "random_forest"], k=2, repeats=1, trees=5, kbest_k=2)
    rows = {(r.scheme, r.model): r for r in g.collect()}
    assert len(rows) == 4 and rows["hybrid", "random_forest"].use_kbest and not rows["theory", "random_forest"].use_kbest


# ---------------------------------------------------------------- decoder

@pytest.fixture(scope="module")
def windows(spark):
    r = np.random.default_rng(7)
    rows = []
    for s, n in (("hot", 300), ("cold", 40)):
        y = r.integers(0, 4, n)
        x = r.normal(size=(n, 2)) + np.array([[2, 0], [0, 2], [-2, 0], [0, -2]])[y]
        rows += [(s, int(len(rows) + k), int(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(n)]
    pdf = pd.DataFrame(rows, columns=["subject_id", "w", "label", "v", "a"])
    pdf["w"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("block", [16, 512])
def test_silhouette_matches_brute_force(windows, block):
    pdf, df = windows
    got = d.silhouette(df, block=block).toPandas().set_index("subject_id").silhouette
    for s, g in pdf.groupby("subject_id"):
        xy, y = g[["v", "a"]].to_numpy(), g.label.to_numpy()
        dist = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        out = []
        for k in range(len(y)):
            own = (y == y[k]) & (np.arange(len(y)) != k)
            a, b = dist[k, own].mean(), min(dist[k, y == c].mean() for c in set(y) - {y[k]})
            out.append((b - a) / max(a, b))
        assert np.isclose(got[s], np.mean(out))


def test_silhouette_needs_two_classes(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 0, 2.0, 2.0)], "subject_id string, label bigint, v double, a double")
    assert d.silhouette(t).first().silhouette is None


def test_lda_predicts_each_window_once_out_of_fold(windows):
    pdf, df = windows
    p = d.lda_oof(d.stratified_folds(df, "w"), ["v", "a"]).toPandas()
    assert sorted(p.w) == sorted(pdf.w) and (p.label == p.pred).mean() > 0.8
    assert np.allclose([sum(x.values()) for x in p.posterior], 1)


def test_small_classes_are_dropped(spark):
    t = spark.createDataFrame([("a", 0)] * 6 + [("a", 1)] * 7 + [("a", 2)] * 4 + [("b", 0)] * 9, "subject_id string, label int")
    got = d.eligible_classes(t).toPandas()
    assert set(got.subject_id) == {"a"} and set(got.label) == {0, 1} and set(got.folds) == {5}


# ---------------------------------------------------------------- reliability and features

def test_omega_of_equal_loadings(spark):
    r = np.random.default_rng(8)
    g = r.normal(size=4000)
    x = 0.7 * g[:, None] + np.sqrt(0.51) * r.normal(size=(4000, 5))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")))
    o = rel.mcdonald_omega(df, list("abcde")).first().omega
    a = rel.cronbach_alpha(df, list("abcde")).first().alpha
    assert abs(o - (5 * 0.7) ** 2 / ((5 * 0.7) ** 2 + 5 * 0.51)) < 0.02 and abs(o - a) < 0.01


def test_alpha_floors(spark):
    t = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert rel.cronbach_alpha(t, ["a", "b"]).first().alpha is None
    assert rel.subscale_reliability(t, {"s": ["a", "zz"]}).first().interpretation == "insufficient items"


def test_diffusion_is_undefined_at_the_edges(spark):
    t = spark.createDataFrame([(0.5, 0.02, 1.0), (0.5, 0.02, 0.0), (0.5, 0.0, 0.8), (0.5, 0.02, 0.5), (0.723, 0.112, 0.802)], "m double, s double, p double")
    got = rel.ez_diffusion(t, [("m", "s", "p", ("v", "a", "ter"))]).toPandas()
    assert got.v[:4].isna().all() and got.ter[:4].isna().all()
    assert np.allclose(got.loc[4, ["v", "a", "ter"]].astype(float), [0.0999, 0.1399, 0.3000], atol=1e-3)


def test_wrong_answers_keep_their_times_and_outliers_go(spark):
    t = spark.createDataFrame([("a", 1, "congruent", 0.0, 1.0, None), ("a", 2, "Incongruent", 1.0, 3.0, False), ("a", 3, "congruent", 1.0, 9.0, True)],
                              "id string, trial int, condition string, acc double, rt double, outlier boolean")
    r = rel.trial_metrics(t, ["id"]).first()
    assert r.n_trials == 2 and r.rt_mean == 2.0 and r.flanker_effect == 2.0


def test_curation_counts_an_earlier_dropped_feature(spark):
    r = np.random.default_rng(9)
    a = r.normal(size=300)
    b = a + 0.2 * r.normal(size=300)
    c = b + 0.2 * r.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "k": 1.0, "z": a})).repartition(4)
    # b falls to a; c is close only to b, which is itself dropped, and falls as well.
    rc = lambda x, y: abs(np.corrcoef(x, y)[0, 1])
    cutoff = (rc(b, c) + rc(a, c)) / 2
    assert rc(a, b) > cutoff
    assert {x.feature for x in f.collinear(df, list("abckz"), cutoff).collect()} == {"b", "c", "z"}
    assert {x.feature for x in f.collinear(df, list("abckz"), cutoff, protected=["z"]).collect()} == {"a", "b", "c"}
    assert {x.feature for x in f.low_variance(df, list("abckz")).collect()} == {"k"}
    rep = f.curation_report(df, list("abckz"), ["z"], threshold=cutoff).first()
    assert (rep.n_before, rep.n_after, rep.dropped_low_variance) == (5, 1, "k")


def test_pair_correlations_are_pairwise_complete(spark):
    r = np.random.default_rng(10)
    p = pd.DataFrame(r.normal(size=(100, 3)), columns=list("abc"))
    p.loc[::7, "a"] = np.nan
    p.loc[::5, "b"] = np.nan
    got = f.pair_correlations(spark.createDataFrame(p).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abc"]), list("abc")).toPandas()
    want = p.corr().abs()
    assert all(np.isclose(x.abs_r, want.loc[x.feature_i, x.feature_j]) for x in got.itertuples())


def test_ids_and_merge_guard(spark):
    ids = spark.createDataFrame([("00795",), (" 795 ",), ("D0000795",), ("795.0",), ("7.5",), (None,)], "id string")
    assert [r.k for r in ids.select(f.normalise_id("id").alias("k")).collect()] == ["795", "795", "D0000795", "795", "7.5", None]
    feats = spark.createDataFrame([(795, 1.0)], "subject_id bigint, x double")
    assert f.merge_behaviour(feats, ids.limit(1), min_matched=1).count() == 1
    with pytest.raises(ValueError, match="only 1 matched"):
        f.merge_behaviour(feats, ids.limit(1))


def test_missing_tail_leaves_only_its_pair(spark):
    mk = lambda rows: spark.createDataFrame(rows, "subject_id string, emotion string, valence double, arousal double")
    rest = spark.createDataFrame([("a", 0.5, 1.0)], "subject_id string, valence double, arousal double")
    r = f.baseline_delta(mk([("a", "1_Happy", 2.0, 3.0)]), mk([]), rest, {"H": "1_Happy", "C": "2_Calm"}).first()
    assert r.within_Hv is None and r.rest_Hv == 1.5 and r.rest_Ha == 2.0 and r.rest_Cv is None


def test_wide_gram_blocks_match_numpy(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 300)) + 7.0
    cols = [f"g{i}" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(fold=np.arange(60) % 2))
    t = m.gram_table(df, cols, ["fold"]).toPandas()
    assert len(t) == 4  # two blocks a fold
    z = np.hstack([np.ones((60, 1)), x - x.mean(0)])
    for (f,), q in m._cells(t, ["fold"], 301).items():
        assert np.allclose(q, z[f::2].T @ z[f::2])


def test_permuted_nets_match_a_net_per_replicate(table):
    _, df = table
    d = df.select("id", "y", "c", "x1", "x2").na.drop()
    folded = m.assign_folds(d, "id", 3, 1, 42)
    targets = m.permuted_target(d.select("id", "y"), "y", "id", 2).select("rep", "id", "y_perm")
    got = m.permuted_nets(folded.select("id", "fold", "c", "x1", "x2"), targets, ["c", "x1", "x2"], "id", 2, 3, chunk=2).toPandas().set_index(["rep", "fold"])
    both = targets.join(folded, "id").select("rep", "fold", "id", "y_perm", "c", "x1", "x2")
    want = m.elastic_net_models(both, "y_perm", ["c", "x1", "x2"], "id").toPandas().set_index(["rep", "fold"])
    assert len(got) == len(want) == 6
    for k in want.index:
        assert np.allclose(got.loc[k, "beta"], want.loc[k, "beta"], atol=1e-8) and np.isclose(got.loc[k, "alpha"], want.loc[k, "alpha"])
