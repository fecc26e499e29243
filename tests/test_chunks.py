"""The conditioning chain and window epochs on chunk arrays against plain NumPy."""

import numpy as np
import pytest

from signalops.operators import chunks as k, windows as w

CH = ["A", "B", "C", "D"]
WEIGHTS = {"A": {"B": 0.5, "C": 0.5}, "D": {"C": 1.0}}


def frame(spark, recordings, gaps=()):
    rows = [(s, "eo", CH[c], t, float(x[c, t])) for s, x in recordings.items() for c in range(len(x)) for t in range(x.shape[1]) if (s, c, t) not in gaps]
    return spark.createDataFrame(rows, "subject_id string, condition string, channel string, t bigint, value double")


def plain(x, bad, first, last, length, step, limit):
    """(n_before, n_after, mean |v|, sd) of a recording."""
    y = x.copy()
    if bad:
        y = y - y[[c for c in range(4) if c not in bad]].mean(0)
        fixed = y.copy()
        for c in bad:
            near = [(CH.index(g), v) for g, v in WEIGHTS.get(CH[c], {}).items() if CH.index(g) not in bad]
            if near:
                fixed[c] = sum(v * y[g] for g, v in near) / sum(v for _, v in near)
        y = fixed
    y = y - y.mean(0)
    e = [y[:, s:s + length] for s in range(first, last - length + 2, step)]
    kept = np.array([a for a in e if (a.max(1) - a.min(1)).max() <= limit])
    return len(e), len(kept), np.abs(kept).mean() * 1e6 if len(kept) else 0.0, kept.std() * 1e6 if len(kept) else 0.0


@pytest.fixture(scope="module")
def recordings():
    r = np.random.default_rng(2)
    base = r.normal(size=(1, 300))
    out = {s: base + 0.5 * r.normal(size=(4, 300)) for s in "xy"}
    out["x"][0] *= 40  # bad by variance
    out["y"][3] = 0.0  # flat
    out["short"] = base[:, :40] + 0.5 * r.normal(size=(4, 40))
    return out


@pytest.mark.parametrize("size", [32, 4096])
def test_qc_matches_a_plain_chain_at_any_chunk_size(spark, recordings, size):
    recs = spark.createDataFrame([(s, "eo") for s in [*recordings, "none"]], "subject_id string, condition string")
    qc = k.preprocess_qc(frame(spark, recordings), recs, CH, WEIGHTS, 10.0, 20, 1.8, 10, 2.0, 5, z=30.0, corr=0.02, size=size)
    got = {r["subject_id"]: r for r in qc.collect()}
    assert got["x"]["bad"] == "A" and got["y"]["by_flatline"] == "D" and got["short"]["bad"] == ""
    for s, bad, first, last in (("x", [0], 20, 279), ("y", [3], 20, 279), ("short", [], 0, 39)):
        want = plain(recordings[s], bad, first, last, 20, 10, 1.8)
        assert (got[s]["n_before"], got[s]["n_after"]) == want[:2]
        assert np.allclose((got[s]["mean_amplitude_uv"], got[s]["std_amplitude_uv"]), want[2:])
    assert 0 < got["x"]["n_after"] < got["x"]["n_before"]
    assert (got["none"]["n_before"], got["none"]["status"], got["none"]["mean_amplitude_uv"]) == (0, "LOW_EPOCH_COUNT", 0.0)


def test_an_epoch_with_a_missing_sample_is_left_out(spark, recordings):
    data = {"short": recordings["short"]}
    chunks = k.pack(frame(spark, data, {("short", 2, 25)}), CH, size=16, halo=9)
    ranges = k.crop_range(chunks, 10.0)
    e = k.cleaned_epochs(chunks, ranges, spark.createDataFrame([], "subject_id string, condition string, bad string"), CH, {}, 10, 0, 99.0, 16, 9, with_data=True).collect()
    assert sorted(r["epoch_id"] for r in e) == [0, 1, 3]
    x = recordings["short"] - recordings["short"].mean(0)
    assert all(np.allclose(r["x"], x[:, 10 * r["epoch_id"]:10 * r["epoch_id"] + 10]) for r in e)


def test_one_shuffle_of_sample_rows(spark, recordings):
    chunks = k.pack(frame(spark, recordings), CH, size=64, halo=19)
    ranges, bads = k.crop_range(chunks, 10.0), spark.createDataFrame([("x", "eo", "A")], "subject_id string, condition string, bad string")
    plan = k.cleaned_epochs(chunks, ranges, bads, CH, WEIGHTS, 20, 0, 3.0, 64, 19)._jdf.queryExecution().executedPlan().toString()
    arrays = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "pos" in x]
    assert not arrays


def test_windows_take_their_epochs_from_the_chunks_they_touch(spark, recordings):
    x = recordings["x"]
    sm = frame(spark, {"x": x}).drop("condition")
    win = spark.createDataFrame([("x", "1_A", 29.9, 2.0, 9.5, 20.0, 29.0, 2.0, 29.0), ("x", "2_B", 29.9, None, None, None, None, None, None)],
                                "subject_id string, condition string, rec_end double, r_start double, r_end double, b_start double, b_end double, d_start double, d_end double")
    got = {r["condition"]: r for r in w.window_qc(sm, win, 10.0, CH, 2.5, ["subject_id"], 2.0, 1.0, 1.5, {"response": 1, "base": 1, "decode": 20}, size=32).collect()}

    def count(start, end, step):
        e = [x[:, s:s + 20] for s in (round((start + i * step) * 10) for i in range(int((end - start - 2) / step + 1e-9) + 1))]
        return len(e), sum((a.max(1) - a.min(1)).max() <= 2.5 for a in e)
    for name, (start, end, step) in {"response": (2.0, 9.5, 1.0), "base": (20.0, 29.0, 1.0), "decode": (2.0, 29.0, 0.5)}.items():
        assert (got["1_A"][f"{name}_n_before"], got["1_A"][f"{name}_n_after"]) == count(start, end, step)
    assert got["2_B"]["status"] == "WINDOW_TOO_SHORT" and not got["2_B"]["decode_viable"] and got["2_B"]["base_n_before"] == 0
