"""Spectral and time-domain primitives on epochs(keys..., channel, x array<double>).

An epoch is one row, so a transform of it is row-local: the Fourier step runs as a small
NumPy function over Arrow batches and costs no shuffle. Band sums, ratios, averages over
epochs and channel pairs are Spark expressions and aggregates on its output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalops.functions.lineage import cut
from signalops.functions.nulls import EPS, add_all, safe_div

# Fixed value: the late/early ratio is kept at every tenth wavelet scale.
RATIO_STEP = 10

# Frequency bands (half-open, Hz) and the wavelet bank.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30)}
WAVELET_N_FREQS, WAVELET_RANGE, WAVELET_BANDWIDTH, WAVELET_CENTRE = 30, (2.0, 45.0), 1.5, 1.0
PHASE_BINS = 18

Bands = dict[str, tuple[float, float]]


def _by_length(x: pd.Series, width: int, fn) -> pd.Series:
    """Apply a 2-D NumPy function to the equal-length arrays of a batch; too short gives None."""
    out: list = [None] * len(x)
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        if v is not None and len(v) >= width:
            lengths.setdefault(len(v), []).append(i)
    for idx in lengths.values():
        block = fn(np.stack([x.iloc[i] for i in idx]).astype("float64"))
        for i, row in zip(idx, block):
            out[i] = row
    return pd.Series(out, dtype=object)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _segments(x: np.ndarray, nperseg: int) -> np.ndarray:
    """(rows, segments, nperseg) with half overlap, mean removed, periodic Hann applied."""
    starts = range(0, x.shape[1] - nperseg + 1, nperseg - nperseg // 2)
    s = np.stack([x[:, i:i + nperseg] for i in starts], axis=1)
    return (s - s.mean(axis=2, keepdims=True)) * hann(nperseg)


def welch_udf(fs: float, nperseg: int):
    win = hann(nperseg)
    scale = np.full(nperseg // 2 + 1, 2.0 / (fs * (win ** 2).sum()))
    scale[0] /= 2
    if nperseg % 2 == 0:
        scale[-1] /= 2

    @F.pandas_udf("array<double>")
    def welch(x: pd.Series) -> pd.Series:
        return _by_length(x, nperseg, lambda b: (np.abs(np.fft.rfft(_segments(b, nperseg))) ** 2).mean(axis=1) * scale)

    return welch


def frequencies(fs: float, nperseg: int) -> list[float]:
    return [k * fs / nperseg for k in range(nperseg // 2 + 1)]


def welch_psd(epochs: DataFrame, fs: float, nperseg: int) -> DataFrame:
    """Add ``psd``: Welch density with half-overlapping Hann segments and constant detrend."""
    return epochs.withColumn("psd", welch_udf(fs, nperseg)(F.col("x")))


def mean_psd(epochs: DataFrame, fs: float, nperseg: int, by: list[str]) -> DataFrame:
    """Density averaged over the epochs of each group: one shuffle of one array per group."""
    bins = nperseg // 2 + 1
    return (welch_psd(epochs, fs, nperseg).groupBy(*by)
            .agg(F.array(*[F.avg(F.col("psd")[k]) for k in range(bins)]).alias("psd")))


def trapezoid(values: Column, freqs: list[float], lo: float, hi: float, closed: bool = False) -> Column:
    """Trapezoid over the bins in [lo, hi) (or [lo, hi]); 0.0 when the band has under two bins.

    Bins are evenly spaced, so it is the slice's sum less half of its two ends.
    """
    ks = [k for k, f in enumerate(freqs) if lo <= f and (f <= hi if closed else f < hi)]
    if len(ks) < 2:
        return F.lit(0.0)
    inner = F.aggregate(F.slice(values, ks[0] + 1, len(ks)), F.lit(0.0), lambda acc, p: acc + p)
    return (inner - (values[ks[0]] + values[ks[-1]]) / 2) * (freqs[1] - freqs[0])


def flattened(fs: float, nperseg: int, lo: float = 1.0, hi: float = 40.0) -> Column:
    """Density over its aperiodic line, per bin; NULL outside the fitted range.

    The line's two numbers are zipped to the bins, so they are evaluated once per row and not
    once per bin.
    """
    n = nperseg // 2 + 1
    bins = F.arrays_zip(F.col("psd").alias("p"), F.array_repeat("offset", n).alias("o"), F.array_repeat("exponent", n).alias("e"))

    def bin_(b: Column, k: Column) -> Column:
        f = k * (fs / nperseg)
        return F.when((f >= lo) & (f <= hi) & (b["p"] > 0), F.pow(F.lit(10.0), F.log10(b["p"]) - b["o"] + b["e"] * F.log10(f)))

    return F.transform(bins, bin_)


def band_power(psd: DataFrame, fs: float, nperseg: int, keys: list[str], bands: Bands = BANDS,
               total: tuple[float, float] = (0.5, 45.0)) -> DataFrame:
    """Long (keys, band, abs_power, rel_power): row-local over the density array."""
    f = frequencies(fs, nperseg)
    whole = trapezoid(F.col("psd"), f, total[0], total[1], closed=True)
    base = psd.select(*keys, "psd", whole.alias("__total"))
    rows = F.array(*[F.struct(F.lit(b).alias("band"), trapezoid(F.col("psd"), f, lo, hi).alias("abs_power"))
                     for b, (lo, hi) in bands.items()])
    return (base.select(*keys, "__total", F.inline(rows))
            .withColumn("rel_power", F.when(F.col("__total") > 0, F.col("abs_power") / F.col("__total")).otherwise(0.0))
            .drop("__total"))


# ---------------------------------------------------------------- aperiodic component

def _line(points: Column) -> Column:
    """Least-squares (slope, icept) struct over an array of (u, v) structs: one scan of the array."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "u", "v", "uv", "uu")])
    sums = F.aggregate(points, zero, lambda a, p: F.struct(
        (a["n"] + 1).alias("n"), (a["u"] + p["u"]).alias("u"), (a["v"] + p["v"]).alias("v"),
        (a["uv"] + p["u"] * p["v"]).alias("uv"), (a["uu"] + p["u"] * p["u"]).alias("uu")),
        lambda a: F.struct(a["n"].alias("n"), a["u"].alias("u"), a["v"].alias("v"),
                           ((a["n"] * a["uv"] - a["u"] * a["v"]) / F.nullif(a["n"] * a["uu"] - a["u"] * a["u"], F.lit(0.0))).alias("slope")))
    return sums


def _intercept(line: Column) -> Column:
    return (line["v"] - line["slope"] * line["u"]) / F.nullif(line["n"], F.lit(0.0))


def aperiodic_fit(psd: DataFrame, fs: float, nperseg: int, lo: float = 1.0, hi: float = 40.0,
                  percent: float = 2.5) -> DataFrame:
    """Offset and exponent of log10 P = offset - exponent * log10 f.

    A first line is fitted to all bins; residuals below it are clipped to zero; bins whose
    residual is at most the low percentile are refitted, which ignores spectral peaks. When
    fewer than three bins are left the first line stands. NULL when a bin is not positive.
    """
    ks = [k for k, f in enumerate(frequencies(fs, nperseg)) if lo <= f <= hi]
    fr = frequencies(fs, nperseg)
    pts = F.array(*[F.struct(F.lit(math.log10(fr[k])).alias("u"), F.log10(F.col("psd")[k]).alias("v")) for k in ks])
    good = F.forall(F.array(*[F.col("psd")[k] for k in ks]), lambda p: F.coalesce(p > 0, F.lit(False)))
    s1 = psd.withColumn("__p", F.when(good, pts))
    s2 = s1.withColumn("__l", _line(F.col("__p")))
    s2 = s2.withColumn("__a", F.col("__l")["slope"]).withColumn("__b", _intercept(F.col("__l")))
    resid = F.transform("__p", lambda p: F.struct(
        p["u"].alias("u"), p["v"].alias("v"),
        F.greatest(p["v"] - F.col("__b") - F.col("__a") * p["u"], F.lit(0.0)).alias("r")))
    s3 = s2.withColumn("__r", resid).withColumn("__s", F.array_sort(F.transform("__r", lambda p: p["r"])))
    h = (len(ks) - 1) * percent / 100.0
    k0 = int(math.floor(h))
    k1 = min(k0 + 1, len(ks) - 1)
    cut = F.get("__s", F.lit(k0)) + (h - k0) * (F.get("__s", F.lit(k1)) - F.get("__s", F.lit(k0)))
    s4 = s3.withColumn("__cut", cut).withColumn("__k", F.filter("__r", lambda p: p["r"] <= F.col("__cut")))
    few = F.size("__k") < 3
    return (s4.withColumn("__m", _line(F.col("__k")))
            .withColumn("exponent", -F.when(few, F.col("__a")).otherwise(F.col("__m")["slope"]))
            .withColumn("offset", F.when(few, F.col("__b")).otherwise(_intercept(F.col("__m"))))
            .drop("__p", "__l", "__a", "__b", "__r", "__s", "__cut", "__k", "__m"))


def periodic_power(fitted: DataFrame, fs: float, nperseg: int, keys: list[str], bands: Bands = BANDS,
                   lo: float = 1.0, hi: float = 40.0) -> DataFrame:
    """Band power after removing the aperiodic line, from the observed density.

    (Taken on the observed spectrum; no peak model is fitted.) NULL when a bin is undefined.
    """
    f = frequencies(fs, nperseg)
    rows = F.array(*[F.struct(F.lit(b).alias("band"), trapezoid(
        F.col("__per"), f, max(a, lo), z if z <= hi else hi, closed=z > hi).alias("periodic_power")) for b, (a, z) in bands.items()])
    return fitted.select(*keys, flattened(fs, nperseg, lo, hi).alias("__per")).select(*keys, F.inline(rows))


# ---------------------------------------------------------------- peak frequency

def spectral_centroid(fs: float, nperseg: int, lo: float = 7.0, hi: float = 13.0) -> Column:
    """Power-weighted mean frequency over the closed band; NULL when the band has no power."""
    f = frequencies(fs, nperseg)
    ks = [k for k, x in enumerate(f) if lo <= x <= hi]
    total = add_all([F.col("psd")[k] for k in ks])
    return F.when(total > 0, add_all([F.col("psd")[k] * f[k] for k in ks]) / F.when(total > 0, total))


def peak_frequency(psd: DataFrame, fs: float, nperseg: int, lo: float = 7.0, hi: float = 13.0,
                   share: float = 0.30, within: float = 2.0) -> DataFrame:
    """Adds centroid and paf: the highest prominent local peak if near the centroid, else the centroid.

    A peak's prominence is its height above the higher of its two bases; a base is the lowest
    value going outward until a higher bin. The band is a short slice, scanned in place.
    """
    f = frequencies(fs, nperseg)
    ks = [k for k, x in enumerate(f) if lo <= x <= hi]
    out = psd.withColumn("centroid", spectral_centroid(fs, nperseg, lo, hi)).withColumn(
        "__b", F.slice("psd", ks[0] + 1, len(ks)))
    top = F.array_max("__b")

    def base(outward: Column, height: Column) -> Column:
        start = F.struct(F.lit(float("inf")).alias("low"), F.lit(False).alias("done"))
        return F.aggregate(outward, start, lambda s, v: F.struct(
            F.when(s["done"] | (v > height), s["low"]).otherwise(F.least(s["low"], v)).alias("low"),
            (s["done"] | (v > height)).alias("done")))["low"]

    def peak(v: Column, i: Column) -> Column:
        left, right = F.get("__b", i - 1), F.get("__b", i + 1)
        lowest = F.greatest(base(F.reverse(F.slice("__b", F.lit(1), i)), v),
                            base(F.slice("__b", i + 2, F.size("__b") - i - 1), v))
        hit = (v > left) & (v > right) & (v - lowest >= top * share)
        return F.when(hit, F.struct(v.alias("h"), (-i).alias("o"), (F.lit(f[ks[0]]) + i * (fs / nperseg)).alias("f")))

    # Edge bins have a NULL neighbour and so are never peaks; ties go to the lower frequency.
    out = out.withColumn("__peak", F.array_max(F.transform("__b", peak))["f"])
    near = F.abs(F.col("__peak") - F.col("centroid")) < within
    return out.withColumn("paf", F.when(near, F.col("__peak")).otherwise(F.col("centroid"))).drop("__peak", "__b")


# ---------------------------------------------------------------- cross-channel measures

def fourier_udf(nperseg: int | None = None):
    """Raw (or segmented, windowed) transform as re/im arrays, segments laid end to end."""

    def transform(b: np.ndarray) -> np.ndarray:
        z = np.fft.rfft(b) if nperseg is None else np.fft.rfft(_segments(b, nperseg)).reshape(len(b), -1)
        return np.concatenate([z.real, z.imag], axis=1)

    @F.pandas_udf("array<double>")
    def fourier(x: pd.Series) -> pd.Series:
        return _by_length(x, nperseg or 2, transform)

    return fourier


def channel_columns(df: DataFrame, keys: list[str], channels: list[str], value: str) -> DataFrame:
    """One row per epoch with one column per channel; a group holds one montage."""
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(value), F.when(F.col("channel") == c, F.lit(1))).alias(f"ch_{c}") for c in channels])


def coherence(epochs: DataFrame, pairs: list[tuple[str, str]], fs: float, nperseg: int, n_samples: int,
              epoch_keys: list[str], by: list[str], bands: Bands = BANDS) -> DataFrame:
    """Mean over epochs and band bins of |Sxy|^2 / (Sxx Syy), segment-averaged within the epoch.

    Channels of an epoch meet in one shuffle of their transforms; the pair list is configuration.
    """
    bins = nperseg // 2 + 1
    segs = (n_samples - nperseg) // (nperseg - nperseg // 2) + 1
    z = epochs.withColumn("z", fourier_udf(nperseg)(F.col("x")))
    channels = sorted({c for p in pairs for c in p})
    wide = channel_columns(z, epoch_keys, channels, "z")
    f = frequencies(fs, nperseg)

    used = [k for k, x in enumerate(f) if any(lo <= x < hi for lo, hi in bands.values())]
    za, zb, imag = F.col("za"), F.col("zb"), segs * bins

    def over_segments(k: Column, term) -> Column:
        # Position of bin k in each segment; real parts come first, imaginary parts after.
        return F.aggregate(F.sequence(F.lit(0), F.lit(segs - 1)), F.lit(0.0), lambda acc, s: acc + term(s * bins + k))

    def coh(k: Column) -> Column:
        re = over_segments(k, lambda i: F.get(za, i) * F.get(zb, i) + F.get(za, i + imag) * F.get(zb, i + imag))
        im = over_segments(k, lambda i: F.get(za, i + imag) * F.get(zb, i) - F.get(za, i) * F.get(zb, i + imag))
        pa = over_segments(k, lambda i: F.get(za, i) * F.get(za, i) + F.get(za, i + imag) * F.get(za, i + imag))
        pb = over_segments(k, lambda i: F.get(zb, i) * F.get(zb, i) + F.get(zb, i + imag) * F.get(zb, i + imag))
        return safe_div(re * re + im * im, pa * pb)

    rows = F.array(*[F.struct(F.lit(a).alias("ch_a"), F.lit(b).alias("ch_b"),
                              F.col(f"ch_{a}").alias("za"), F.col(f"ch_{b}").alias("zb")) for a, b in pairs])
    each = wide.select(*epoch_keys, F.inline(rows)).where(F.col("za").isNotNull() & F.col("zb").isNotNull())
    each = each.withColumn("c", F.transform(F.array(*[F.lit(k) for k in used]), coh))
    per_band = F.array(*[
        F.struct(F.lit(n).alias("band"), (add_all([F.col("c")[i] for i in at]) / len(at)).alias("c"))
        for n, (lo, hi) in bands.items() if (at := [i for i, k in enumerate(used) if lo <= f[k] < hi])])
    return (each.select(*epoch_keys, "ch_a", "ch_b", F.inline(per_band))
            .groupBy(*by, "ch_a", "ch_b", "band").agg(F.avg("c").alias("coherence")))


def band_covariance(epochs: DataFrame, channels: list[str], fs: float, n_samples: int, epoch_keys: list[str],
                    by: list[str], bands: Bands = BANDS) -> DataFrame:
    """Upper-triangle covariance of band-limited signals, mean over epochs.

    By Parseval's identity the covariance of two band-limited signals is a sum over the
    band's Fourier bins, so nothing is filtered or inverted in the time domain.
    """
    nb = n_samples // 2 + 1
    z = epochs.withColumn("z", fourier_udf()(F.col("x")))
    wide = channel_columns(z, epoch_keys, channels, "z")
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    rows = F.array(*[F.struct(F.lit(a).alias("ch_i"), F.lit(b).alias("ch_j"),
                              F.col(f"ch_{a}").alias("za"), F.col(f"ch_{b}").alias("zb")) for a, b in pairs])
    each = wide.select(*epoch_keys, F.inline(rows)).where(F.col("za").isNotNull() & F.col("zb").isNotNull())

    def cov(lo: float, hi: float) -> Column:
        ks = [k for k in range(1, nb) if lo <= k * fs / n_samples < hi]
        twice = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1.0 if 2 * k == n_samples else 2.0).alias("d")) for k in ks])
        za, zb = F.col("za"), F.col("zb")
        s = F.aggregate(twice, F.lit(0.0), lambda acc, b: acc + b["d"] * (
            F.get(za, b["k"]) * F.get(zb, b["k"]) + F.get(za, b["k"] + nb) * F.get(zb, b["k"] + nb)))
        return s / float(n_samples * (n_samples - 1))

    per_band = F.array(*[F.struct(F.lit(b).alias("band"), cov(lo, hi).alias("c")) for b, (lo, hi) in bands.items()])
    return (each.select(*epoch_keys, "ch_i", "ch_j", F.inline(per_band))
            .groupBy(*by, "band", "ch_i", "ch_j").agg(F.avg("c").alias("cov")))


# ---------------------------------------------------------------- wavelet

def wavelet_frequencies() -> np.ndarray:
    return np.logspace(math.log10(WAVELET_RANGE[0]), math.log10(WAVELET_RANGE[1]), WAVELET_N_FREQS)


def wavelet_scale(freq: float, fs: float) -> float:
    """Scale used for a listed frequency; with centre frequency 1 it responds at twice that value."""
    return fs / (freq * 2)


def _morlet(n: int, scale: float) -> np.ndarray:
    u = (np.arange(n)[:, None] - np.arange(n)[None, :]) / scale
    env = np.exp(-u ** 2 / WAVELET_BANDWIDTH) / math.sqrt(math.pi * WAVELET_BANDWIDTH * scale)
    return env * np.exp(-2j * np.pi * WAVELET_CENTRE * u)


HELD_GROUPS = 256  # groups whose power sums a task holds before it hands them on


def wavelet_power(epochs: DataFrame, fs: float, n_samples: int, by: list[str], kept: list[int]) -> DataFrame:
    """Per scale: mean power, temporal variance of the epoch-mean power, log1p late minus early.

    Only the kept scales are computed. Each task adds up the (scale x time) power arrays of its epochs by group in NumPy and
    hands on one array a group; groups then meet as arrays, so nothing is exploded. Epochs of another length or with a missing
    sample are left out.
    """
    freqs = wavelet_frequencies()
    bank = np.concatenate([_morlet(n_samples, wavelet_scale(freqs[i], fs)) for i in kept], axis=1)
    half, k = n_samples // 2, len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            keys = list(zip(*held))
            made = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types)], pa.array([v.tobytes() for v in held.values()], pa.binary())], [*by, "v"])
            held.clear()
            return made

        for b in batches:
            types = [b.schema.field(i).type for i in range(k)]
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(k)), n_samples), False))
            x = b.column(k).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, n_samples)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[b.column(c).to_pylist() for c in range(k)])):
                if not np.isnan(x[i]).any():
                    places.setdefault(key, []).append(i)
            for key, at in places.items():
                part = sum((np.abs(x[at[i:i + 256]] @ bank) ** 2).sum(0) for i in range(0, len(at), 256))
                part = np.append(part, len(at))
                held[key] = held[key] + part if key in held else part
                if len(held) >= HELD_GROUPS:
                    yield out()
        if held:
            yield out()

    def scales(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        p = (total[:-1] / total[-1]).reshape(len(kept), n_samples)
        late = np.log1p(p[:, half:].mean(1)) - np.log1p(p[:, :half].mean(1))
        return pd.DataFrame([[*pdf[by].iloc[0], *row] for row in zip(kept, p.mean(1), p.var(1), late)], columns=[*by, "scale", "power", "variance", "late_early"])

    keys = ", ".join(f"`{c}` {epochs.schema[c].dataType.simpleString()}" for c in by)
    return (epochs.select(*by, "x").mapInArrow(run, f"{keys}, v binary").groupBy(*by)
            .applyInPandas(scales, f"{keys}, scale bigint, power double, variance double, late_early double"))


# ---------------------------------------------------------------- time domain

@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("activity", "mobility", "complexity")]))
def hjorth_parts(x: pd.Series) -> pd.DataFrame:
    def three(b: np.ndarray) -> np.ndarray:
        d1 = np.diff(b, axis=1)
        v0, v1, v2 = b.var(axis=1), d1.var(axis=1), np.diff(d1, axis=1).var(axis=1)
        mob = np.sqrt(v1 / (v0 + EPS))
        return np.stack([v0, mob, np.sqrt(v2 / (v1 + EPS)) / (mob + EPS)], axis=1)

    rows = _by_length(x, 3, three)
    return pd.DataFrame([r if r is not None else (None, None, None) for r in rows],
                        columns=["activity", "mobility", "complexity"], dtype="float64")


def hjorth(epochs: DataFrame, by: list[str]) -> DataFrame:
    """Activity, mobility and complexity, averaged over epochs."""
    return (epochs.select(*by, hjorth_parts(F.col("x")).alias("h")).groupBy(*by)
            .agg(*[F.avg(f"h.{c}").alias(c) for c in ("activity", "mobility", "complexity")]))


def spectral_entropy(psd: Column) -> Column:
    """Natural-log entropy of the density as shares of its sum.

    The guarded normalisation and the renormalisation cancel, so S = sum p and sum p ln p suffice.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l"))
    return F.aggregate(psd, zero, lambda a, p: F.struct(
        (a["s"] + p).alias("s"), (a["l"] + F.when(p > 0, p * F.ln(p)).otherwise(0.0)).alias("l")),
        lambda a: F.when(a["s"] > 0, F.ln(a["s"]) - a["l"] / a["s"]))


def analytic_udf(fs: float, lo: float, hi: float):
    """Band-limited analytic signal: keep the bins in [lo, hi), double them, invert one-sided."""

    def analytic(b: np.ndarray) -> np.ndarray:
        n = b.shape[1]
        z = np.fft.fft(b)
        f = np.arange(n) * fs / n
        z[:, ~((f >= lo) & (f < hi) & (f < fs / 2))] = 0
        a = np.fft.ifft(2 * z)
        return np.concatenate([a.real, a.imag], axis=1)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return _by_length(x, 2, analytic)

    return run


def analytic_signal(epochs: DataFrame, fs: float, band: tuple[float, float], n_samples: int,
                    keys: list[str]) -> DataFrame:
    """Long (keys, n, re, im, phase, amplitude)."""
    a = epochs.select(*keys, analytic_udf(fs, *band)(F.col("x")).alias("a"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda i: F.struct(
        i.cast("bigint").alias("n"), F.get("a", i).alias("re"), F.get("a", i + n_samples).alias("im")))
    return (a.select(*keys, F.inline(parts))
            .withColumn("phase", F.atan2("im", "re")).withColumn("amplitude", F.hypot("re", "im")))


def pac_udf(fs: float, phase_band: tuple[float, float] = (4, 8), amp_band: tuple[float, float] = (13, 30), bins: int = PHASE_BINS):
    """Modulation index of one epoch: how unevenly the mean amplitude is spread over the phase bins."""

    def band(b: np.ndarray, lo: float, hi: float) -> np.ndarray:
        f = np.arange(b.shape[1]) * fs / b.shape[1]
        z = np.fft.fft(b)
        z[:, ~((f >= lo) & (f < hi) & (f < fs / 2))] = 0
        return np.fft.ifft(2 * z)

    def index(b: np.ndarray) -> np.ndarray:
        k = np.floor((np.angle(band(b, *phase_band)) + math.pi) / (2 * math.pi) * bins).astype(int)
        amp, row = np.abs(band(b, *amp_band)), np.arange(len(b))[:, None]
        inside = k < bins
        cell = (row * bins + k)[inside]
        n = np.bincount(cell, minlength=len(b) * bins).reshape(-1, bins)
        m = np.bincount(cell, amp[inside], len(b) * bins).reshape(-1, bins) / np.maximum(n, 1)
        s, sl = m.sum(1), (m * np.log(np.where(m > 0, m, 1.0))).sum(1)
        safe = np.where(s > 0, s, 1.0)
        return np.where(s > 0, (math.log(bins) + sl / safe - np.log(safe)) / math.log(bins), 0.0)[:, None]

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else float(v[0]) for v in _by_length(x, 2, index)], dtype="float64")

    return run


def pac_modulation_index(epochs: DataFrame, fs: float, by: list[str], phase_band: tuple[float, float] = (4, 8), amp_band: tuple[float, float] = (13, 30),
                         bins: int = PHASE_BINS) -> DataFrame:
    """Modulation index of beta amplitude over theta phase, mean over epochs: row-local, then one number a row is shuffled."""
    return epochs.select(*by, pac_udf(fs, phase_band, amp_band, bins)(F.col("x")).alias("mi")).groupBy(*by).agg(F.avg("mi").alias("pac_mi"))


# ---------------------------------------------------------------- density features

def kde_udf(points: int):
    def both(b: np.ndarray) -> np.ndarray:
        n = b.shape[1]
        h = b.std(axis=1, ddof=1) * n ** -0.2
        lo, hi = b.min(axis=1), b.max(axis=1)
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, points)
        with np.errstate(divide="ignore", invalid="ignore"):
            dens = np.empty_like(grid)
            for j in range(points):
                z = (grid[:, j:j + 1] - b) / h[:, None]
                dens[:, j] = np.exp(-0.5 * z * z).mean(axis=1) / (h * math.sqrt(2 * math.pi))
        out = np.stack([dens.mean(axis=1), dens.std(axis=1)], axis=1)
        out[~np.isfinite(out).all(axis=1)] = np.nan
        return out

    @F.pandas_udf("struct<kde_mean double, kde_sd double>")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = _by_length(x, 2, both)
        return pd.DataFrame([r if r is not None else (None, None) for r in rows],
                            columns=["kde_mean", "kde_sd"], dtype="float64")

    return run


def kde_features(epochs: DataFrame, points: int = 100) -> DataFrame:
    """Mean and population sd of a Gaussian density (Scott bandwidth) over a min-max grid."""
    out = epochs.withColumn("__k", kde_udf(points)(F.col("x")))
    none = F.lit(None).cast("double")
    return out.withColumn("kde_mean", F.nanvl("__k.kde_mean", none)).withColumn("kde_sd", F.nanvl("__k.kde_sd", none)).drop("__k")


def window_features(epochs: DataFrame, channels: list[str], fs: float, nperseg: int, keys: list[str],
                    bands: Bands = BANDS, kde_points: int = 100, families: tuple[str, ...] = ("band_power", "kde")) -> DataFrame:
    """One wide row per window and channel set: absolute and relative band power (``band_power``) and density features (``kde``).

    A family that is not asked for is not computed.
    """
    unknown = set(families) - {"band_power", "kde"}
    if unknown or not families:
        raise ValueError(f"families are band_power and kde, not {sorted(unknown)}")
    e, names = epochs, []
    if "band_power" in families:
        f = frequencies(fs, nperseg)
        e = welch_psd(e, fs, nperseg).withColumn("__total", trapezoid(F.col("psd"), f, f[0], f[-1], closed=True))
        e = e.withColumns({f"bp_abs_{b}": trapezoid(F.col("psd"), f, lo, hi) for b, (lo, hi) in bands.items()})
        e = e.withColumns({f"bp_rel_{b}": F.when(F.col("__total") > 0, F.col(f"bp_abs_{b}") / F.nullif("__total", F.lit(0.0))).otherwise(0.0)
                           for b in bands})
        names += [f"bp_{k}_{b}" for b in bands for k in ("abs", "rel")]
    if "kde" in families:
        e = kde_features(e, kde_points)
        names += ["kde_mean", "kde_sd"]
    return e.groupBy(*keys).agg(*[F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{n}_{c}")
                                  for c in channels for n in names])


def to_wide(features: DataFrame, prefixes: dict[str, str], names: list[str], key: str = "subject_id") -> DataFrame:
    """Long (subject, condition, feature, value) to one wide row; a missing condition gives NULLs."""
    return features.groupBy(key).agg(*[
        F.max(F.when((F.col("condition") == c) & (F.col("feature") == n), F.col("value"))).alias(f"{p}_{n}")
        for c, p in prefixes.items() for n in names])


def build_primitives(epochs: DataFrame, channels: list[str], pairs: list[tuple[str, str]], fs: float,
                     n_samples: int, bands: Bands = BANDS, kept: list[int] | None = None,
                     families: list[str] | None = None) -> DataFrame:
    """Primitives of every subject and condition as long (subject, condition, feature, value).

    ``families`` limits the work to some of: psd, aperiodic, periodic, paf, entropy, coherence,
    wavelet, hjorth, pac, covariance.
    """
    rec = ["subject_id", "condition"]
    keys, ep, nps = [*rec, "channel"], [*rec, "epoch_id"], int(fs)
    kept = kept if kept is not None else list(range(0, WAVELET_N_FREQS, 5))
    chosen = list(families or ("psd", "aperiodic", "periodic", "paf", "entropy", "coherence", "wavelet", "hjorth", "pac", "covariance"))
    # All that is one channel's own comes from one pass: density, time-domain and phase-amplitude parts are columns of the epoch's row.
    row, means = welch_psd(epochs, fs, nps), [F.array(*[F.avg(F.col("psd")[k]) for k in range(nps // 2 + 1)]).alias("psd")]
    if "hjorth" in chosen:
        row = row.withColumn("__h", hjorth_parts(F.col("x")))
        means += [F.avg(f"__h.{c}").alias(c) for c in ("activity", "mobility", "complexity")]
    if "pac" in chosen:
        row = row.withColumn("__mi", pac_udf(fs)(F.col("x")))
        means.append(F.avg("__mi").alias("pac_mi"))
    own = cut(row.groupBy(*keys).agg(*means))
    psd = own.select(*keys, "psd")
    line = aperiodic_fit(psd, fs, nps)

    def long(df: DataFrame, pairs_: list[tuple[Column, str]]) -> DataFrame:
        cells = F.array(*[F.struct(n.alias("feature"), F.col(v).cast("double").alias("value")) for n, v in pairs_])
        return df.select(*rec, F.inline(cells))

    def name(prefix: str, *cols: str) -> Column:
        return F.concat_ws("_", F.lit(prefix), *cols)

    parts = {
        "psd": lambda: long(band_power(psd, fs, nps, keys, bands), [
            (name("psd_abs", "band", "channel"), "abs_power"), (name("psd_rel", "band", "channel"), "rel_power")]),
        "aperiodic": lambda: long(line, [(name("aperiodic_exponent", "channel"), "exponent"), (name("aperiodic_offset", "channel"), "offset")]),
        "periodic": lambda: long(periodic_power(line, fs, nps, keys, bands), [(name("psd_periodic", "band", "channel"), "periodic_power")]),
        "paf": lambda: long(peak_frequency(psd, fs, nps), [(name("paf", "channel"), "paf")]),
        "entropy": lambda: long(psd.withColumn("e", spectral_entropy(F.col("psd"))), [(name("spectral_entropy", "channel"), "e")]),
        "coherence": lambda: long(coherence(epochs, pairs, fs, nps, n_samples, ep, rec, bands), [(name("coh", "band", "ch_a", "ch_b"), "coherence")]),
        "wavelet": lambda: long(
            wavelet_power(epochs, fs, n_samples, keys, kept).withColumn("f", F.concat(F.lit("f"), "scale")),
            [(name("cwt_pow", "channel", "f"), "power"), (name("cwt_var", "channel", "f"), "variance"),
             (F.when(F.col("scale") % RATIO_STEP == 0, name("cwt_ratio", "channel", "f")), "late_early")]).where("feature is not null"),
        "hjorth": lambda: long(own, [(name(f"hjorth_{h}", "channel"), h) for h in ("activity", "mobility", "complexity")]),
        "pac": lambda: long(own, [(name("pac_theta_beta", "channel"), "pac_mi")]),
        "covariance": lambda: long(band_covariance(epochs, channels, fs, n_samples, ep, rec, bands), [(name("cov", "band", "ch_i", "ch_j"), "cov")]),
    }
    return reduce(DataFrame.unionByName, [parts[f]() for f in chosen])
