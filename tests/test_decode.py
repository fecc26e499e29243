"""Fold-wise imputation, scaling and discriminants against plain NumPy; grids by missingness; folders of an application."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalops.functions import lineage
from signalops.functions.ordering import complement_medians
from signalops.operators import decode as d, inference as i

P = 6


@pytest.fixture(scope="module")
def windows():
    r = np.random.default_rng(3)
    rows = []
    for n in range(160):
        subject, label = ("hot", "cold")[n % 5 == 0], int(r.integers(0, 3))
        x = r.normal(size=P) + label * np.arange(P) / 3 + 1000.0
        rows.append((n, subject, label, n % 4, [None if r.random() < 0.15 else float(v) for v in x]))
    return rows


@pytest.fixture(scope="module")
def folded(spark, windows):
    return spark.createDataFrame(windows, "id long, subject_id string, label long, fold long, x array<double>").cache()


def prepared(train, test):
    med = np.nanmedian(train, axis=0)
    a, b = (np.where(np.isnan(v), med, v) for v in (train, test))
    m, s = a.mean(0), a.std(0)
    return (a - m) / s, (b - m) / s


def plain(windows, full):
    """id -> (posterior, nearest class)."""
    out = {}
    for subject in ("hot", "cold"):
        rows = [r for r in windows if r[1] == subject]
        for fold in range(4):
            tr, te = [r for r in rows if r[3] != fold], [r for r in rows if r[3] == fold]
            a, b = prepared(np.array([r[4] for r in tr], float), np.array([r[4] for r in te], float))
            y = np.array([r[2] for r in tr])
            classes = sorted(set(y.tolist()))
            m = np.array([a[y == c].mean(0) for c in classes])
            n = np.array([(y == c).sum() for c in classes])
            s = sum((a[y == c] - m[k]).T @ (a[y == c] - m[k]) for k, c in enumerate(classes)) / (len(y) - len(classes))
            w = m @ np.linalg.inv(s) if full else m / np.diag(s)
            z = b @ w.T - 0.5 * (w * m).sum(1) + np.log(n / n.sum())
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            near = ((b[:, None] - m[None]) ** 2).sum(2).argmin(1)
            for r, q, c in zip(te, p, near):
                out[r[0]] = (dict(zip(classes, q)), classes[c])
    return out


@pytest.mark.parametrize("full", [True, False])
def test_discriminants_impute_and_scale_by_training_fold(folded, windows, full):
    want = plain(windows, full)
    for r in d.lda_oof(folded, "x", full=full).collect():
        p = want[r["id"]][0]
        assert r["posterior"] == pytest.approx(p, abs=1e-6) and r["pred"] == max(p, key=p.get)


def test_nearest_centroid_imputes_and_scales_by_training_fold(folded, windows):
    want = plain(windows, False)
    wide = folded.select("*", *[F.col("x")[j].alias(f"f{j}") for j in range(P)])
    assert {r["id"]: r["pred"] for r in d.nearest_centroid_oof(wide, [f"f{j}" for j in range(P)], "id").collect()} == {n: w[1] for n, w in want.items()}


def test_medians_outside_each_fold(spark):
    r = np.random.default_rng(1)
    rows = [("hot" if r.random() < 0.8 else "cold", int(r.integers(0, 3)), None if r.random() < 0.1 else float(np.round(r.normal(), 1))) for _ in range(900)]
    got = {x["k"]: x["medians"] for x in complement_medians(spark.createDataFrame(rows, "k string, f int, v double"), "k", "v", "f", 3).collect()}
    for k in ("hot", "cold"):
        own = [(f, v) for a, f, v in rows if a == k and v is not None]
        assert np.allclose(got[k], [np.median([v for f, v in own if f != o]) for o in range(3)] + [np.median([v for _, v in own])])


def test_a_training_set_of_one_class_gives_null(spark):
    rows = [(0, "a", 1, 0, [1.0, 2.0]), (1, "a", 1, 0, [2.0, 1.0]), (2, "a", 0, 1, [0.0, None]), (3, "a", 0, 1, [None, 3.0])]
    df = spark.createDataFrame(rows, "id long, subject_id string, label long, fold long, x array<double>")
    assert [r["pred"] for r in d.lda_oof(df, "x").collect()] == [None] * 4


def test_chain_lists_skipped_subjects(spark, windows):
    rows = [r for r in windows] + [(1000 + n, "few", n % 2, 0, [1.0] * P) for n in range(4)]
    df = spark.createDataFrame(rows, "id long, subject_id string, label long, fold long, x array<double>").drop("fold")
    got = {r["subject_id"]: r for r in d.decoder_chain(df, df.where("label = 0").select("subject_id", "id", "x"), "x", "id", {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (-1.0, 0.0)}).collect()}
    assert got["few"]["status"] == "skip_insufficient_classes" and got["few"]["n_classes"] == 0 and got["few"]["acc_mean"] is None
    assert got["hot"]["status"] == "ok" and got["hot"]["classes"] == "0,1,2" and got["hot"]["acc_mean"] > 0.5 and got["hot"]["precursor_offset"] is not None


def test_grid_cells_use_the_rows_that_have_their_columns(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(80, 3)) + [50.0, 0.0, -9.0]
    y = x @ [0.5, 1.0, 0.0] + r.normal(size=80)
    rows = [(n, float(y[n]), *[None if r.random() < 0.2 else float(v) for v in x[n]]) for n in range(80)]
    df = spark.createDataFrame(rows, "id long, y double, c double, a double, b double")
    got = {(q["feature_set"], q["term"]): q for q in i.hypothesis_grid(df, ["y"], {"both": ["a", "b"], "one": ["a"], "none": ["zz"]}, ["c"], {"a": "positive"}, "id", {"a": ["a", "b"]}).collect()}
    for name, feats in (("both", ["a", "b"]), ("one", ["a"])):
        for f in feats:
            own = i.ols(df.na.drop(subset=["y", "c", *feats]), "y", ["c", *feats]).where(F.col("term") == f).first()
            assert got[name, f]["beta"] == pytest.approx(own["beta"]) and got[name, f]["p_two_sided"] == pytest.approx(own["p_two_sided"]) and got[name, f]["n"] == own["n"]
    assert set(got) == {("both", "a"), ("both", "b"), ("one", "a")} and got["both", "b"]["pass_gate"] is None


def test_clear_leaves_the_tables_of_other_applications(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda s: str(tmp_path))
    other = tmp_path / "signalops" / "other-app" / "table"
    other.mkdir(parents=True)
    lineage.cut(spark.range(3))
    own = lineage.own_folder(spark)
    assert os.listdir(own)
    lineage.clear(spark)
    assert not os.path.exists(own) and other.exists()
