"""Queries: spectral and time-domain primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalops.functions.present import shown_sql as r
from signalops.operators import spectral as s
from signalops.plans import fixtures as fx
from signalops.plans.registry import out, query

KEY = [*fx.REC, "channel"]
PAIRS = [("F3", "O1"), ("F4", "O2")]
KEPT = [0, 5, 10, 15, 20, 25]

# Three half-overlapping segments of 32 samples: bins of 2 Hz.
SEG = """sg as (select subject_id, condition, epoch_id, channel, vec_id, s, n - 16 * s as m, v
    from FX_LONG, (select unnest(range(0, 3)) as s) where n >= 16 * s and n < 16 * s + 32),
  sw as (select * replace ((v - avg(v) over (partition by vec_id, s)) * (0.5 - 0.5 * cos(2 * pi() * m / 32)) as v) from sg),
  sd as (select subject_id, condition, epoch_id, channel, vec_id, s, k, sum(v * cos(2 * pi() * k * m / 32)) as re,
    -sum(v * sin(2 * pi() * k * m / 32)) as im from sw, (select unnest(range(0, 17)) as k) group by all)"""


@query("welch_psd", f"""
    with {SEG} select vec_id, k, {r('avg((re * re + im * im) * (case when k in (0, 16) then 1 else 2 end) / (64 * 12.0::double)) * 1e6', 3)} as power
    from sd group by 1, 2""", "FX_LONG")
def _(spark, sf):
    d = s.welch_psd(fx.epochs(spark, sf), fx.FS, 32).select("vec_id", F.posexplode("psd").alias("k", "p"))
    return out(d.select("vec_id", "k", (F.col("p") * 1e6).alias("power")), "vec_id k", power=3)


@query("mean_psd", f"select subject_id, condition, channel, freq, {r('p * 1e6', 3)} as power from FX_MPSD where freq between 0.5 and 45", "FX_MPSD")
def _(spark, sf):
    d = fx.mean_psd(spark, sf).select(*KEY, F.posexplode("psd").alias("k", "p"))
    d = d.select(*KEY, (F.col("k") * (fx.FS / fx.N)).alias("freq"), (F.col("p") * 1e6).alias("power")).where("freq between 0.5 and 45")
    return out(d, "subject_id condition channel freq", power=3)


@query("band_power_abs", f"select subject_id, condition, channel, band, {r('abs_power * 1e6', 3)} as abs_power from FX_BP", "FX_BP")
def _(spark, sf):
    return out(fx.band_power(spark, sf).withColumn("abs_power", F.col("abs_power") * 1e6), "subject_id condition channel band", abs_power=3)


@query("band_power_rel", f"select subject_id, condition, channel, band, {r('rel_power', 6)} as rel_power from FX_BP", "FX_BP")
def _(spark, sf):
    return out(fx.band_power(spark, sf), "subject_id condition channel band", rel_power=6)


@query("aperiodic_fit", f'select subject_id, condition, channel, {r("exponent", 5)} as exponent, {r(chr(34) + "offset" + chr(34), 5)} as "offset" from FX_APER', "FX_APER")
def _(spark, sf):
    return out(s.aperiodic_fit(fx.mean_psd(spark, sf), fx.FS, fx.N), "subject_id condition channel", exponent=5, offset=5)


@query("band_power_periodic", f"select subject_id, condition, channel, band, {r('periodic_power', 4)} as periodic_power from FX_PER", "FX_PER")
def _(spark, sf):
    d = s.periodic_power(s.aperiodic_fit(fx.mean_psd(spark, sf), fx.FS, fx.N), fx.FS, fx.N, KEY)
    return out(d, "subject_id condition channel band", periodic_power=4)


@query("spectral_centroid", f"select subject_id, condition, channel, {r('centroid', 5)} as centroid from FX_PAF", "FX_PAF")
def _(spark, sf):
    d = fx.mean_psd(spark, sf).withColumn("centroid", s.spectral_centroid(fx.FS, fx.N))
    return out(d, "subject_id condition channel", centroid=5)


@query("peak_frequency", f"select subject_id, condition, channel, {r('paf', 5)} as paf from FX_PAF", "FX_PAF")
def _(spark, sf):
    return out(s.peak_frequency(fx.mean_psd(spark, sf), fx.FS, fx.N), "subject_id condition channel", paf=5)


@query("coherence", f"""
    with {SEG}, x as (select a.subject_id, a.condition, a.epoch_id, a.channel as ch_a, b.channel as ch_b, a.k,
        (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.im * b.re - a.re * b.im), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) as c
      from sd a join sd b on a.subject_id = b.subject_id and a.condition = b.condition and a.epoch_id = b.epoch_id and a.s = b.s and a.k = b.k
      where (a.channel, b.channel) in (('F3', 'O1'), ('F4', 'O2')) group by all)
    select subject_id, condition, ch_a, ch_b, band, {r('avg(c)', 5)} as coherence from x join {fx.BAND_ROWS} on 2 * k >= lo and 2 * k < hi group by 1, 2, 3, 4, 5""", "FX_LONG")
def _(spark, sf):
    d = s.coherence(fx.epochs(spark, sf), PAIRS, fx.FS, 32, fx.N, fx.EPOCH, fx.REC)
    return out(d, "subject_id condition ch_a ch_b band", coherence=5)


@query("wavelet_power", f"""
    with sc as (select i, 64 / (2 * pow(22.5, i / 29.0) * 2) as s from (values {', '.join(f'({i})' for i in KEPT)}) v(i)),
    kern as (select i, d, exp(-(d / s) * (d / s) / 1.5) / sqrt(pi() * 1.5 * s) * cos(2 * pi() * d / s) as kc,
      exp(-(d / s) * (d / s) / 1.5) / sqrt(pi() * 1.5 * s) * sin(2 * pi() * d / s) as ks from sc, (select unnest(range(-63, 64)) as d)),
    pw as (select subject_id, condition, channel, vec_id, i, b, pow(sum(v * kc), 2) + pow(sum(v * ks), 2) as p
      from FX_LONG, (select unnest(range(0, 64)) as b) join kern on d = n - b group by all),
    mp as (select subject_id, condition, channel, i, b, avg(p) as p from pw group by all)
    select subject_id, condition, channel, i::bigint as scale, {r('avg(p)', 6)} as power, {r('var_pop(p)', 7)} as variance,
      {r('ln(1 + avg(p) filter (b >= 32)) - ln(1 + avg(p) filter (b < 32))', 6)} as late_early from mp group by 1, 2, 3, 4""", "FX_LONG")
def _(spark, sf):
    d = s.wavelet_power(fx.epochs(spark, sf), fx.FS, fx.N, KEY, KEPT)
    return out(d, "subject_id condition channel scale", power=6, variance=7, late_early=6)


@query("hjorth", f"""
    with d1 as (select *, v - lag(v) over w as d from FX_LONG window w as (partition by vec_id order by n)),
    d2 as (select *, d - lag(d) over w as dd from d1 window w as (partition by vec_id order by n)),
    e as (select subject_id, condition, channel, vec_id, var_pop(v) as a, var_pop(d) as b, var_pop(dd) as c from d2 group by all)
    select subject_id, condition, channel, {r('avg(a) * 1e3', 6)} as activity, {r('avg(sqrt(b / (a + 1e-10)))', 6)} as mobility,
      {r('avg(sqrt(c / (b + 1e-10)) / (sqrt(b / (a + 1e-10)) + 1e-10))', 6)} as complexity from e group by 1, 2, 3""", "FX_LONG")
def _(spark, sf):
    d = s.hjorth(fx.epochs(spark, sf), KEY).withColumn("activity", F.col("activity") * 1e3)
    return out(d, "subject_id condition channel", activity=6, mobility=6, complexity=6)


@query("spectral_entropy", f"""
    with p as (select *, p / (sum(p) over w + 1e-10) as q from FX_MPSD window w as (partition by subject_id, condition, channel)),
    m as (select *, q / sum(q) over w as z from p window w as (partition by subject_id, condition, channel))
    select subject_id, condition, channel, {r('-sum(z * ln(z)) filter (z > 0)', 6)} as entropy from m group by 1, 2, 3""", "FX_MPSD")
def _(spark, sf):
    d = fx.mean_psd(spark, sf).withColumn("entropy", s.spectral_entropy(F.col("psd")))
    return out(d, "subject_id condition channel", entropy=6)


def _analytic_sql(lo, hi):
    return f"""(select subject_id, condition, epoch_id, channel, vec_id, n, sum(re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)) / 32 as re,
        sum(re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64)) / 32 as im
      from FX_DFT, (select unnest(range(0, 64)) as n) where k >= {lo} and k < {hi} group by all)"""


@query("analytic_signal", f"select vec_id, n, {r('re', 6)} as re, {r('im', 6)} as im, {r('sqrt(re * re + im * im)', 6)} as amplitude from {_analytic_sql(8, 13)}", "FX_DFT")
def _(spark, sf):
    return out(s.analytic_signal(fx.epochs(spark, sf), fx.FS, (8, 13), fx.N, ["vec_id"]), "vec_id n", re=6, im=6, amplitude=6)


@query("pac_mi", f"""
    with a as (select p.subject_id, p.condition, p.channel, p.vec_id, floor((atan2(p.im, p.re) + pi()) / (2 * pi()) * 18) as bin, sqrt(q.re * q.re + q.im * q.im) as am
      from {_analytic_sql(4, 8)} p join {_analytic_sql(13, 30)} q using (vec_id, n)),
    b as (select subject_id, condition, channel, vec_id, bin, avg(am) as m from a where bin < 18 group by all),
    s as (select *, m / sum(m) over (partition by vec_id) as z from b),
    e as (select subject_id, condition, channel, vec_id, (ln(18) + sum(z * ln(z))) / ln(18) as mi from s where z > 0 group by all)
    select subject_id, condition, channel, {r('avg(mi)', 6)} as pac_mi from e group by 1, 2, 3""", "FX_DFT")
def _(spark, sf):
    d = s.pac_modulation_index(fx.epochs(spark, sf), fx.FS, KEY)
    return out(d, "subject_id condition channel", pac_mi=6)


@query("band_covariance", f"""
    with y as (select subject_id, condition, epoch_id, channel, band, n, sum(re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64)) / 32 as v
      from FX_DFT join {fx.BAND_ROWS} on k >= lo and k < hi, (select unnest(range(0, 64)) as n) group by all),
    c as (select a.subject_id, a.condition, a.epoch_id, a.band, a.channel as ch_i, b.channel as ch_j, covar_samp(a.v, b.v) as c
      from y a join y b using (subject_id, condition, epoch_id, band, n) where a.channel <= b.channel group by all)
    select subject_id, condition, band, ch_i, ch_j, {r('avg(c) * 1e6', 3)} as cov from c group by 1, 2, 3, 4, 5""", "FX_DFT")
def _(spark, sf):
    d = s.band_covariance(fx.epochs(spark, sf), fx.CHANNELS, fx.FS, fx.N, fx.EPOCH, fx.REC)
    return out(d.withColumn("cov", F.col("cov") * 1e6), "subject_id condition band ch_i ch_j", cov=3)


KDE = """kb as (select vec_id, min(v) as lo, max(v) as hi, stddev_samp(v) * pow(64, -0.2) as h from FX_LONG group by 1),
  kd as (select l.vec_id, i, avg(exp(-0.5 * pow((lo + (hi - lo) * i / 99.0 - v) / h, 2))) / (max(h) * sqrt(2 * pi())) as dens
    from FX_LONG l join kb on l.vec_id = kb.vec_id, (select unnest(range(0, 100)) as i) group by 1, 2),
  kf as (select vec_id, avg(dens) as kde_mean, stddev_pop(dens) as kde_sd from kd group by 1)"""


@query("kde_features", f"with {KDE} select vec_id, {r('kde_mean', 5)} as kde_mean, {r('kde_sd', 5)} as kde_sd from kf", "FX_LONG")
def _(spark, sf):
    return out(s.kde_features(fx.epochs(spark, sf)), "vec_id", kde_mean=5, kde_sd=5)


WF = [f"{n}_{c}" for c in fx.CHANNELS for n in (*[f"bp_{k}_{b}" for b in s.BANDS for k in ("abs", "rel")], "kde_mean", "kde_sd")]


def _wf_sql():
    cols = []
    for w in WF:
        n, ch = w.rsplit("_", 1)
        scale = " * 1e6" if n.startswith("bp_abs") else ""
        cols.append(f"{r(f'''max(case when channel = '{ch}' then {n} end){scale}''', 3 if scale else 5)} as {w}")
    band = lambda lo, hi: f"sum((p + q) / 2) filter (k >= {lo} and k + 1 < {hi})"
    return f"""with {KDE}, w as (select *, lead(p) over (partition by vec_id order by k) as q from FX_PSD),
      b as (select subject_id, condition, epoch_id, channel, vec_id, {', '.join(f"{band(lo, hi)} as bp_abs_{n}, {band(lo, hi)} / sum((p + q) / 2) as bp_rel_{n}" for n, (lo, hi) in s.BANDS.items())}
        from w group by all)
      select subject_id, condition, epoch_id, {', '.join(cols)} from b join kf using (vec_id) group by 1, 2, 3"""


@query("window_features", _wf_sql(), ("FX_PSD",))
def _(spark, sf):
    d = s.window_features(fx.epochs(spark, sf), fx.CHANNELS, fx.FS, fx.N, fx.EPOCH)
    d = d.withColumns({c: F.col(c) * 1e6 for c in WF if c.startswith("bp_abs")})
    return out(d, "subject_id condition epoch_id", **{w: 3 if w.startswith("bp_abs") else 5 for w in WF})


WIDE = [f"{b}_{c}" for b in s.BANDS for c in fx.CHANNELS]


@query("features_wide", "select subject_id, " + ", ".join(
    r(f"max(case when condition = '{p}' and band || '_' || channel = '{w}' then abs_power end) * 1e6", 3) + f" as {p}_{w}"
    for p in ("eo", "ec") for w in WIDE) + " from FX_BP group by 1", "FX_BP")
def _(spark, sf):
    long = fx.band_power(spark, sf).select(*fx.REC, F.concat_ws("_", "band", "channel").alias("feature"), (F.col("abs_power") * 1e6).alias("value"))
    d = s.to_wide(long, {"eo": "eo", "ec": "ec"}, WIDE)
    return out(d, "subject_id", **{f"{p}_{w}": 3 for p in ("eo", "ec") for w in WIDE})


@query("primitives_long", f"""
    with p as (select subject_id, f, value from FX_PRIM) select left(f, 2) as condition, substr(f, 4) as feature, count(*) as n_subjects, {r('avg(value)', 4)} as mean
    from p group by 1, 2""", "FX_PRIM")
def _(spark, sf):
    d = s.build_primitives(fx.epochs(spark, sf), fx.CHANNELS, PAIRS, fx.FS, fx.N,
                           families=["psd", "aperiodic", "periodic", "paf"])
    d = d.groupBy("condition", "feature").agg(
        F.count("value").alias("n_subjects"), F.avg("value").alias("mean"))
    return out(d, "condition feature n_subjects", mean=4)
