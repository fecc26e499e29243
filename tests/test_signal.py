import numpy as np
import pytest
from pyspark.sql import functions as F

from signalops.operators import conditioning as c, spectral as s, windows as w


def _rec(spark, x, channel="Fz"):
    return spark.createDataFrame([("a", "eo", channel, i, float(v)) for i, v in enumerate(x)],
                                 "subject_id string, condition string, channel string, t bigint, value double")


@pytest.mark.parametrize("chunk", [8, 64, 4096])
def test_fir_chunks_agree_with_one_convolution(spark, chunk):
    x = np.random.default_rng(0).normal(size=200)
    taps = [0.1, 0.2, 0.4, 0.25, 0.05]
    got = c.fir_filter(_rec(spark, x), taps, c.REC, chunk).orderBy("t").toPandas()
    want = np.convolve(x, taps[::-1], "valid")
    assert len(got) == 200 and got.filtered[:2].isna().all() and got.filtered[-2:].isna().all()
    assert np.allclose(got.filtered[2:-2], want)


def test_band_pass_taps_keep_the_band():
    h = np.array(s_taps := c.sinc_taps(250.0, 8.0, 13.0, 250))
    gain = lambda f: abs(np.sum(h * np.exp(-2j * np.pi * f / 250 * np.arange(len(h)))))
    assert len(s_taps) == 501 and gain(10.5) > 0.95 and gain(2) < 0.01 and gain(40) < 0.01
    n = np.array(c.notch_taps(250.0, 50.0, 250))
    assert abs(np.sum(n * np.exp(-2j * np.pi * 50 / 250 * np.arange(len(n))))) < 0.1


def test_channel_check_names_both_lists(spark):
    d = _rec(spark, [1.0, 2.0], "Fz").unionByName(_rec(spark, [1.0, 2.0], "Xx"))
    assert {r.channel for r in c.check_channels(d, ["Fz"]).collect()} == {"Fz"}
    with pytest.raises(ValueError, match=r"missing \[Cz\], unknown \[Xx\]"):
        c.check_channels(d, ["Fz", "Cz"])


@pytest.mark.parametrize("n,overlap,epochs", [(16, 0, 2), (17, 0, 2), (15, 0, 1), (7, 0, 0), (16, 4, 3), (8, 4, 1)])
def test_incomplete_tail_is_dropped(spark, n, overlap, epochs):
    e = c.pack_epochs(c.epoch_ids(_rec(spark, range(n)), 8, overlap), [*c.REC, "channel"], 8).collect()
    assert len(e) == epochs and all(len(r.x) == 8 for r in e)
    assert sorted(r.x[0] for r in e) == [i * (8 - overlap) for i in range(epochs)]


def test_peak_to_peak_drops_the_whole_epoch(spark):
    d = spark.createDataFrame([("a", "eo", 0, "F3", [0.0, 9.0]), ("a", "eo", 0, "F4", [0.0, 1.0]), ("a", "eo", 1, "F3", [0.0, 1.0])],
                              "subject_id string, condition string, epoch_id int, channel string, x array<double>")
    keys = ["subject_id", "condition", "epoch_id"]
    assert [r.epoch_id for r in c.reject_peak_to_peak(d, 5.0, keys).collect()] == [1]
    st = c.rejection_stats(c.mark_peak_to_peak(d, 5.0, keys)).first()
    assert (st.n_before, st.n_after, st.pct_dropped, st.warn) == (2, 1, 0.5, True)


def test_window_families_are_a_switch(spark):
    e = spark.createDataFrame([("a", 0, "F3", [float(i % 7) for i in range(64)])], "subject_id string, epoch_id int, channel string, x array<double>")
    both = s.window_features(e, ["F3"], 64.0, 64, ["subject_id", "epoch_id"])
    kde = s.window_features(e, ["F3"], 64.0, 64, ["subject_id", "epoch_id"], families=("kde",))
    assert kde.columns == ["subject_id", "epoch_id", "kde_mean_F3", "kde_sd_F3"] and len(both.columns) == 12
    assert kde.first().kde_mean_F3 == both.first().kde_mean_F3
    with pytest.raises(ValueError, match="families"):
        s.window_features(e, ["F3"], 64.0, 64, ["subject_id"], families=("wavelet",))


def test_epoch_floor_boundary(spark):
    d = spark.createDataFrame([(59,), (60,)], "n int").select(c.epoch_floor(F.col("n")).alias("s"))
    assert [r.s for r in d.collect()] == ["LOW_EPOCH_COUNT", "OK"]


def _windows(spark, rec_end, onsets):
    r = spark.createDataFrame([("a", "1_Happy", float(rec_end))], "subject_id string, condition string, rec_end double")
    a = spark.createDataFrame([("a", "1_Happy", float(o), t) for o, t in onsets],
                              "subject_id string, condition string, onset double, description string")
    return w.event_windows(r, a).first()


def test_markers_stay_in_their_recording(spark):
    r = spark.createDataFrame([("a", "1_Happy", 60.0), ("a", "2_Calm", 60.0)], "subject_id string, condition string, rec_end double")
    a = spark.createDataFrame([("a", "1_Happy", 7.0, "happy"), ("a", "2_Calm", 50.0, "calm happy")],
                              "subject_id string, condition string, onset double, description string")
    got = {x.condition: x for x in w.event_windows(r, a).collect()}
    assert got["1_Happy"].onset == 7 and got["1_Happy"].block_end == 59 and got["2_Calm"].onset == 50


def test_windows_without_epochs_keep_their_rows(spark):
    r = spark.createDataFrame([("a", "1_Happy", 10.0)], "subject_id string, condition string, rec_end double")
    a = spark.createDataFrame([], "subject_id string, condition string, onset double, description string")
    win = w.event_windows(r, a)
    sm = _rec(spark, range(11)).drop("channel", "condition")
    got = w.window_viability(w.window_epochs(w.samples_in_windows(sm, win, 1.0, ["subject_id"]), 1.0), w.REC, windows=win).collect()
    assert sorted((x.window, x.n_epochs, x.viable) for x in got) == [("base", 0, False), ("decode", 0, False), ("response", 0, False)]


def test_epochs_with_gaps_and_empty_recordings(spark):
    e = c.pack_epochs(c.epoch_ids(_rec(spark, range(24)), 8, 0).where("t <> 10"), [*c.REC, "channel"], 8)
    assert sorted(x.epoch_id for x in e.collect()) == [0, 2]
    rec = spark.createDataFrame([("a", "gone")], "subject_id string, condition string")
    got = c.amplitude_summary(e, recordings=rec).collect()
    assert [(x.condition, x.mean_amplitude_uv, x.std_amplitude_uv) for x in got] == [("gone", 0.0, 0.0)]


def test_windows(spark):
    r = _windows(spark, 100, [(10, "1_Happy"), (3, "BAD happy"), (80, "2_Calm")])
    assert (r.onset, r.r_start, r.r_end, r.block_end, r.b_start, r.b_end, r.d_end) == (10, 10, 25, 80, 65, 80, 80)
    # A tail that starts exactly where the response ends still counts.
    r = _windows(spark, 100, [(10, "happy"), (40, "2_Calm")])
    assert (r.b_start, r.b_end) == (25, 40)
    r = _windows(spark, 100, [(10, "happy"), (39.9, "2_Calm")])
    assert r.b_start is None
    # Overrun slides back when the recording is long enough, else there is no window.
    r = _windows(spark, 22, [(15, "happy")])
    assert (r.r_start, r.r_end, r.slid_back) == (7, 22, True)
    r = _windows(spark, 19, [(15, "happy")])
    assert r.window_status == "WINDOW_TOO_SHORT" and r.d_start is None and r.block_end is None


def test_window_ending_on_the_recording_end(spark):
    sm = _rec(spark, range(31)).drop("channel", "condition")
    win = spark.createDataFrame([("a", "x", 30.0, 10.0, 25.0, None, None, 10.0, 30.0)],
                                "subject_id string, condition string, rec_end double, r_start double, r_end double, b_start double, b_end double, d_start double, d_end double")
    got = w.window_viability(w.window_epochs(w.samples_in_windows(sm, win, 1.0, ["subject_id"]), 1.0), ["subject_id"]).toPandas().set_index("window")
    assert got.loc["response", "n_epochs"] == 14 and got.loc["decode", "n_epochs"] == 19 and not got.loc["decode", "viable"]


# ---------------------------------------------------------------- spectra

def _epochs(spark, x, ch="Fz"):
    return spark.createDataFrame([("a", "eo", i, ch, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "subject_id string, condition string, epoch_id int, channel string, x array<double>")


def test_welch_integrates_to_the_variance(spark):
    fs, n = 128.0, 256
    x = np.sin(2 * np.pi * 10 * np.arange(n) / fs)[None, :]
    p = np.array(s.welch_psd(_epochs(spark, x), fs, 128).first().psd)
    assert p.argmax() == 10 and abs(p.sum() * 1.0 - 0.5) < 0.01


def test_short_epoch_has_no_density(spark):
    assert s.welch_psd(_epochs(spark, [[1.0, 2.0]]), 64.0, 64).first().psd is None


def test_band_without_bins_is_zero(spark):
    d = s.mean_psd(_epochs(spark, np.random.default_rng(0).normal(size=(2, 64))), 64.0, 64, ["subject_id"])
    got = s.band_power(d, 64.0, 64, ["subject_id"], {"none": (40, 44), "alpha": (8, 13)}).toPandas().set_index("band")
    psd = np.array(d.first().psd)
    assert got.loc["none", "abs_power"] == 0.0
    assert np.isclose(got.loc["alpha", "abs_power"], np.trapezoid(psd[8:13]))


def test_aperiodic_recovers_a_power_law_with_a_peak(spark):
    f = np.arange(65) * 1.0
    p = 10 ** (1.5 - 1.2 * np.log10(np.maximum(f, 1)))
    p[9:12] *= [1.5, 4.0, 1.5]
    d = spark.createDataFrame([("a", p.tolist())], "subject_id string, psd array<double>")
    r = s.aperiodic_fit(d, 128.0, 128).first()
    assert abs(r.exponent - 1.2) < 1e-6 and abs(r.offset - 1.5) < 1e-6
    per = s.periodic_power(s.aperiodic_fit(d, 128.0, 128), 128.0, 128, ["subject_id"]).toPandas().set_index("band").periodic_power
    assert abs(per["theta"] - 3.0) < 1e-6 and per["alpha"] > 6


def test_non_positive_density_has_no_aperiodic_fit(spark):
    d = spark.createDataFrame([("a", [1.0] * 5 + [0.0] + [1.0] * 59)], "subject_id string, psd array<double>")
    assert s.aperiodic_fit(d, 128.0, 128).first().exponent is None


@pytest.mark.parametrize("bins,expect", [
    ([1, 1, 1, 9, 1, 1, 1], 10.0),                       # sharp peak near the centroid
    ([5, 4, 3, 2, 3, 4, 5], 10.0),                       # no peak: centroid
    ([1, 9, 1, 1, 1, 8, 9.5], None),                     # peak at 8 is too far from the centroid
])
def test_peak_frequency(spark, bins, expect):
    psd = [1.0] * 7 + [float(b) for b in bins] + [1.0] * 19
    r = s.peak_frequency(spark.createDataFrame([("a", psd)], "subject_id string, psd array<double>"), 64.0, 64).first()
    cen = np.average(np.arange(7, 14), weights=bins)
    assert np.isclose(r.centroid, cen) and np.isclose(r.paf, cen if expect is None else expect)


def test_coherence_of_a_copy_is_one(spark):
    x = np.random.default_rng(2).normal(size=(3, 64))
    d = _epochs(spark, x, "F3").unionByName(_epochs(spark, 2 * x, "F4"))
    got = s.coherence(d, [("F3", "F4"), ("F3", "Zz")], 64.0, 32, 64, ["subject_id", "condition", "epoch_id"], ["subject_id"])
    rows = got.collect()
    assert len(rows) == 4 and all(np.isclose(r.coherence, 1.0) for r in rows)


def test_hjorth_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(2, 50))
    r = s.hjorth(_epochs(spark, x), ["subject_id"]).first()
    v = [np.var(np.diff(x, k, axis=1), axis=1) for k in range(3)]
    assert np.isclose(r.activity, v[0].mean()) and np.isclose(r.mobility, np.sqrt(v[1] / v[0]).mean())


def test_wavelet_responds_at_twice_the_listed_frequency(spark):
    fs, n, i = 250.0, 500, 12
    f = s.wavelet_frequencies()[i]
    rows = {k: s.wavelet_power(_epochs(spark, [np.sin(2 * np.pi * k * f * np.arange(n) / fs)]), fs, n, ["subject_id"], [i]).first().power for k in (1, 2)}
    assert rows[2] > 20 * rows[1]


def test_kde_of_a_constant_is_missing(spark):
    r = s.kde_features(_epochs(spark, [[1.0] * 10])).first()
    assert r.kde_mean is None and r.kde_sd is None


def test_all_primitive_families(spark):
    r = np.random.default_rng(4)
    d = None
    for ch in ("F3", "F4"):
        e = _epochs(spark, r.normal(size=(4, 128)), ch)
        d = e if d is None else d.unionByName(e)
    got = s.build_primitives(d, ["F3", "F4"], [("F3", "F4")], 64.0, 128).toPandas()
    # psd 16, aperiodic 4, periodic 8, paf 2, entropy 2, coherence 4, wavelet 30, hjorth 6, pac 2, covariance 12
    assert len(got) == 86 and got.feature.is_unique and got.value.notna().all()
