import json

import pytest
from pyspark.sql import functions as F

from signalops.functions.lineage import cut, shared_folder
from signalops.operators import behaviour as b, quality as q
from signalops.sources import catalog as c


def test_catalog_from_a_folder(spark, tmp_path):
    for p in ("D001/rec_IGS_Eyes_Open.edf", "D001/rec_igs_2_IGS_1_Happy.edf", "D001/notes.edf", "X9/rec_IGS_Eyes_Open.edf"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"0")
    got = {(r.subject_id, r.condition) for r in c.recording_catalog(c.list_files(spark, str(tmp_path), "*.edf")).collect()}
    assert got == {("D001", "Eyes_Open"), ("D001", "1_Happy")}


def test_run_round_trip_reads_the_newest_well_formed_run(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0)], "subject_id string, x double")
    c.write_run(d, str(tmp_path), "features", "2026-01-01_000000")
    c.write_run(d.withColumn("x", F.lit(2.0)), str(tmp_path), "features", "2026-02-01_000000")
    c.write_run(d.withColumn("x", F.lit(3.0)), str(tmp_path), "features", "zz_manual")
    assert [r.x for r in c.read_latest(spark, str(tmp_path), "features").collect()] == [2.0]
    with pytest.raises(Exception):
        c.write_run(d, str(tmp_path), "features", "2026-01-01_000000")


def test_csv_sheets_and_optional_inputs(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0)], "id string, x double")
    for s in ("Aaa", "Features"):
        d.withColumn("x", F.lit(1.0 if s == "Aaa" else 2.0)).write.option("header", "true").csv(str(tmp_path / "book" / f"{s}.csv"))
    assert c.read_sheet(spark, str(tmp_path / "book"), "id string, x double", ["id"]).first().x == 2.0
    assert c.read_sheet(spark, str(tmp_path / "book"), "id string, x double", preferred="None").first().x == 1.0
    with pytest.raises(ValueError):
        c.read_sheet(spark, str(tmp_path / "book"), "id string, x double", ["rt"])
    assert c.read_if_exists(spark, str(tmp_path / "none.csv"), "id string, x double").count() == 0
    d.write.parquet(str(tmp_path / "some"))
    for path in (str(tmp_path / "some"), f"file://{tmp_path}/some"):
        assert c.read_if_exists(spark, path, "id string, x double").count() == 1
    assert c.read_if_exists(spark, f"file://{tmp_path}/none", "id string, x double").count() == 0
    assert c.read_sheet(spark, f"file://{tmp_path}/book", "id string, x double", ["id"]).first().x == 2.0


def test_ragged_qc(spark, tmp_path):
    (tmp_path / "qc.json").write_text(json.dumps([
        {"subject": "a", "condition": "eo", "status": "OK", "bad_channels": ["F3"], "n_epochs_after_reject": 70},
        {"subject": "a", "condition": "1_Happy", "kind": "emotion", "status": "OK", "viable": True},
        {"subject": "b", "condition": "eo", "status": "ERROR: ValueError: x"}]))
    qc = c.read_qc(spark, str(tmp_path / "qc.json"))
    r = c.qc_rollup(qc).first()
    assert (r.n_records, r.n_ok, r.n_errors, r.n_emotion_viable) == (3, 1, 1, 1)
    rows = {x.condition + x.subject: x for x in q.quality_rows(qc).collect()}
    assert rows["eoa"].n_bad_channels == 1 and rows["eob"].n_bad_channels == 0 and rows["eob"].bad_channels == ""


def test_quarantine_loses_nothing(spark):
    d = spark.range(10).withColumn("v", F.when(F.col("id") != 3, F.col("id")))
    good, bad = c.split_valid(d, {"present": F.col("v").isNotNull(), "small": F.col("v") < 8})
    assert good.count() == 7 and {r.status for r in bad.collect()} == {"ERROR: present", "ERROR: small"}


def test_lineage_row(spark):
    r = c.lineage_row(spark.range(3).withColumn("s", F.lit("a")), "features", "run1", ["t"], "s").first()
    assert (r.n_rows, r.n_subjects, r.outputs) == (3, 1, ["t"]) and r.written_at is not None


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    class Named:
        conf = {"spark.checkpoint.dir": str(tmp_path)}

    assert shared_folder(Named()) == str(tmp_path)
    monkeypatch.setattr("signalops.functions.lineage.shared_folder", lambda s: str(tmp_path))
    assert cut(spark.range(5)).count() == 5 and any((tmp_path / "signalops").iterdir())


def test_bad_birth_dates_are_missing(spark):
    d = b.compute_age(spark.createDataFrame([("31/02/2015",), ("9/3/2016",)], "dob string"), "dob", "2026-03-09").collect()
    assert d[0].age_years is None and d[1].age_years == 10.0 and d[1].age_months == 120.0


def test_reaction_time_columns(spark):
    assert b.audit_rt_columns(["rt_mean", "rt_cv", "rt_iqr", "acc"]) == ["rt_mean", "rt_iqr"]
    d = spark.createDataFrame([(500.0, 1.0), (1500.0, 2.0)], "rt_mean double, rt_iqr double")
    got = b.autoscale(d, ["rt_mean", "rt_iqr", "absent"]).collect()
    assert [(r.rt_mean, r.rt_iqr) for r in got] == [(0.5, 1.0), (1.5, 2.0)]


def test_wide_items_tolerate_absent_columns(spark):
    d = spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double")
    r = b.score_items_wide(d, {"S": ["a", "b", "zz"], "T": ["c"]}, ["c"]).first()
    assert r.global_score == 1.0 and r.S_score == 1.0 and "T_score" not in r.asDict()


def test_flags_ignore_missing_values(spark):
    d = spark.createDataFrame([("a", None, None, None), ("b", 1.0, 0.4, 0.2)], "id string, acc_overall double, acc_incongruent double, rt_mean double")
    r = q.subject_flags(d).collect()
    assert len(r) == 1 and r[0].id == "b" and r[0].exclude_candidate and r[0].ddm_undefined


def test_audit_ladder(spark):
    rows = [("rt_cv", 20, 0.9), ("rt_cv2", 6, 0.9), ("m", 20, 0.6), ("u", 20, 0.1), ("x", 3, None), ("flanker_effect", 20, 0.2)]
    got = {r.metric: r for r in q.reliability_audit(spark.createDataFrame(rows, "metric string, n bigint, spearman_brown double")).collect()}
    assert got["rt_cv"].recommendation == "candidate target (verify replication)" and got["rt_cv2"].recommendation.startswith("high SB but n=6")
    assert got["m"].recommendation == "marginal; not preferred target" and got["u"].recommendation == "unreliable"
    assert got["x"].recommendation == "reliability not estimable" and got["x"].flags == "n=3: uninterpretable"
    assert got["flanker_effect"].recommendation == "DO NOT USE as target" and "unusable" in got["flanker_effect"].flags
