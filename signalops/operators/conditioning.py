"""Signal conditioning on the long table samples(subject_id, condition, channel, t, value)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.nulls import safe_div

REC = ["subject_id", "condition"]

# Old to new electrode names, and the detection thresholds.
CHANNEL_RENAMES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
BAD_Z, BAD_MAX_CORR, FLATLINE_SD = 3.5, 0.2, 1e-7
EXCLUDED_LABELS = ["eye blink", "muscle artifact", "heart beat", "line noise", "channel noise"]


def rename_channels(samples: DataFrame, mapping: Mapping[str, str] = CHANNEL_RENAMES,
                    channel: str = "channel") -> DataFrame:
    new = F.coalesce(*[F.when(F.col(channel) == old, F.lit(n)) for old, n in mapping.items()], F.col(channel))
    return samples.withColumn(channel, new)


def channel_report(samples: DataFrame, expected: list[str], by: list[str] = REC) -> DataFrame:
    """Missing and unknown channels of each recording."""
    want = F.array(*[F.lit(c) for c in sorted(expected)])
    got = samples.groupBy(*by).agg(F.collect_set("channel").alias("got"))
    return got.select(
        *by, F.array_join(F.array_sort(F.array_except(want, "got")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("got", want)), ",").alias("unknown"),
        F.when((F.size(F.array_except(want, "got")) == 0) & (F.size("got") >= len(expected)), "OK")
        .otherwise("ERROR: channels").alias("status"))


def check_channels(samples: DataFrame, expected: list[str], by: list[str] = REC) -> DataFrame:
    """Keep the expected channels; raise with both lists when a recording lacks any."""
    bad = channel_report(samples.where(F.col("channel").isin(expected)), expected, by)
    first = bad.where(F.col("missing") != "").take(1)
    if first:
        full = channel_report(samples, expected, by)
        for k in by:
            full = full.where(F.col(k).eqNullSafe(F.lit(first[0][k])))
        r = full.first()
        raise ValueError(f"recording {[r[k] for k in by]}: missing [{r['missing']}], unknown [{r['unknown']}]")
    return samples.where(F.col("channel").isin(expected))


def bucket_resample(samples: DataFrame, fs: float, fs_out: float, by: list[str]) -> DataFrame:
    """Time-bucket mean at the target rate (a bucket average, not a band-limited resampler)."""
    return (samples.withColumn("t_out", F.floor(F.col("t") * fs_out / fs).cast("bigint"))
            .groupBy(*by, "t_out").agg(F.avg("value").alias("value")).withColumnRenamed("t_out", "t"))


def sinc_taps(fs: float, low: float | None, high: float | None, half: int) -> list[float]:
    """Windowed-sinc taps of a zero-phase band-pass (Hamming window, odd length 2*half+1)."""
    n = np.arange(-half, half + 1)

    def lowpass(f: float) -> np.ndarray:
        h = 2 * f / fs * np.sinc(2 * f / fs * n) * np.hamming(2 * half + 1)
        return h / h.sum()

    h = lowpass(high) if high else (n == 0).astype(float)
    return (h - lowpass(low) if low else h).tolist()


def notch_taps(fs: float, freq: float, half: int, width: float = 1.0) -> list[float]:
    """Band-stop taps around ``freq``: identity minus a band-pass."""
    band = np.array(sinc_taps(fs, freq - width, freq + width, half))
    return ((np.arange(-half, half + 1) == 0).astype(float) - band).tolist()


def fir_filter(samples: DataFrame, taps: list[float], by: list[str], chunk: int = 4096) -> DataFrame:
    """Zero-phase FIR over regularly sampled ``t``; NULL within K samples of an end or a gap.

    Each recording is cut into chunks of fixed length and every chunk borrows K samples from
    its neighbours, so one long recording is filtered by many tasks and no sample list is
    larger than chunk + 2K. The dot products run as one NumPy convolution per chunk.
    """
    k = len(taps) // 2
    if len(taps) % 2 == 0 or chunk < 2 * k:
        raise ValueError("taps must be odd in number and shorter than a chunk")
    kernel = np.asarray(taps, dtype="float64")[::-1]

    @F.pandas_udf("array<double>")
    def convolve(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.convolve(np.asarray(v, dtype="float64"), kernel, "valid")
                     if len(v) >= len(kernel) else np.empty(0))

    lo, hi = F.floor((F.col("t") - k) / F.lit(chunk)), F.floor((F.col("t") + k) / F.lit(chunk))
    spread = samples.select(*by, "t", "value", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("chunk"))
    packed = (spread.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
              .withColumn("y", convolve(F.transform("s", lambda s: s["value"]))))
    # The i-th valid output belongs to the (i+K)-th sample of the chunk.
    body = F.transform("s", lambda s, i: F.struct(
        s["t"].alias("t"), s["value"].alias("value"),
        F.when((i >= k) & (i < F.size("s") - k) & (F.get("s", i + k)["t"] - F.get("s", i - k)["t"] == 2 * k),
               F.get("y", i - k)).alias("filtered")))
    return (packed.select(*by, "chunk", F.inline(body))
            .where(F.floor(F.col("t") / F.lit(chunk)) == F.col("chunk")).drop("chunk"))


def crop_edges(samples: DataFrame, fs: float, edge_sec: float = 5.0, by: list[str] = REC) -> DataFrame:
    """Drop both edges when the recording is longer than two edges plus one second."""
    last = samples.groupBy(*by).agg(F.max("t").alias("__last"))
    sec, end = F.col("t") / F.lit(float(fs)), F.col("__last") / F.lit(float(fs))
    keep = (end <= 2 * edge_sec + 1) | ((sec >= edge_sec) & (sec <= end - edge_sec))
    return samples.join(last, by).where(keep).drop("__last")


def channel_stats(samples: DataFrame, by: list[str] = REC) -> DataFrame:
    """Population variance and sd per channel: the only pass over samples that C6 and C8 need."""
    return samples.groupBy(*by, "channel").agg(F.var_pop("value").alias("var"), F.stddev_pop("value").alias("sd"))


def robust_z(stats: DataFrame, by: list[str] = REC) -> DataFrame:
    """Add the robust z of each channel's ``var`` within its recording (groups are montage-sized)."""
    w = W.partitionBy(*by)
    return (stats.withColumn("med", F.expr("percentile(var, 0.5)").over(w))
            .withColumn("mad", F.percentile(F.abs(F.col("var") - F.col("med")), 0.5).over(w))
            .withColumn("z", 0.6745 * (F.col("var") - F.col("med")) / (F.col("mad") + 1e-20)))


def variance_z(samples: DataFrame, by: list[str] = REC) -> DataFrame:
    """Robust z of each channel's variance within its recording."""
    return robust_z(channel_stats(samples, by), by)


def bad_by_variance(samples: DataFrame, protect: list[str] | None = None, threshold: float = BAD_Z,
                    by: list[str] = REC) -> DataFrame:
    """|z| above the threshold; protected channels are exempt but still shape median and MAD."""
    z = variance_z(samples, by).where(F.abs("z") > threshold)
    return z.where(~F.col("channel").isin(protect)) if protect else z


def max_abs_corr(samples: DataFrame, channels: list[str], by: list[str] = REC) -> DataFrame:
    """Largest |r| of each channel with any other, from one covariance aggregate.

    Samples are laid out one row per time point with a column per channel, and all pair
    moments are partial sums, so no pair rows are produced.
    """
    wide = samples.groupBy(*by, "t").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{i}") for i, c in enumerate(channels)])
    n = len(channels)
    both = {(i, j): F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull() for i in range(n) for j in range(i, n)}
    aggs = []
    for i in range(n):
        aggs.append(F.stddev_samp(f"c{i}").alias(f"s{i}"))
        aggs += [F.covar_samp(F.when(both[i, j], F.col(f"c{i}")), F.col(f"c{j}")).alias(f"v{i}_{j}")
                 for j in range(i + 1, n)]
    m = wide.groupBy(*by).agg(*aggs)

    def r(i: int, j: int) -> Column:
        a, b = min(i, j), max(i, j)
        return F.abs(F.col(f"v{a}_{b}") / F.nullif(F.col(f"s{i}") * F.col(f"s{j}"), F.lit(0.0)))

    rows = [F.struct(F.lit(c).alias("channel"), F.col(f"s{i}").alias("sd"),
                     F.array_max(F.array(*[F.coalesce(r(i, j), F.lit(0.0)) for j in range(n) if j != i])).alias("max_r"))
            for i, c in enumerate(channels)]
    return m.select(*by, F.inline(F.array(*rows))).where(F.col("sd").isNotNull()).drop("sd")


def bad_by_correlation(samples: DataFrame, channels: list[str], threshold: float = BAD_MAX_CORR,
                       by: list[str] = REC) -> DataFrame:
    return max_abs_corr(samples, channels, by).where(F.col("max_r") < threshold)


def bad_by_flatline(samples: DataFrame, threshold: float = FLATLINE_SD, by: list[str] = REC) -> DataFrame:
    return channel_stats(samples, by).where(F.col("sd") < threshold)


def bad_channels(samples: DataFrame, channels: list[str], protect: list[str] | None = None,
                 z: float = BAD_Z, corr: float = BAD_MAX_CORR, flat: float = FLATLINE_SD,
                 by: list[str] = REC) -> DataFrame:
    """Union of the three methods per recording, with the per-method lists kept.

    Variance and flatness share one pass over the samples; correlation takes the other. The
    verdicts then meet on channel-sized tables.
    """
    return verdict_lists(variance_z(samples, by).join(max_abs_corr(samples, channels, by), [*by, "channel"], "left"), protect, z, corr, flat, by)


def verdict_lists(stats: DataFrame, protect: list[str] | None, z: float, corr: float, flat: float, by: list[str] = REC) -> DataFrame:
    """Lists of bad channels per recording from rows (by, channel, z, max_r, sd); recordings without any have no row."""
    free = ~F.col("channel").isin(protect) if protect else F.lit(True)
    verdict = stats.select(
        *by, "channel", (free & (F.abs("z") > z)).alias("variance"), (F.col("max_r") < corr).alias("correlation"),
        (F.col("sd") < flat).alias("flatline"))
    verdict = verdict.where(F.col("variance") | F.col("correlation") | F.col("flatline"))

    def listing(hit: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("channel")))), ",")

    return verdict.groupBy(*by).agg(listing(F.lit(True)).alias("bad"), *[
        listing(F.col(m)).alias(f"by_{m}") for m in ("variance", "correlation", "flatline")])


def with_bads(samples: DataFrame, bads: DataFrame | list[str] | None, by: list[str] = REC) -> DataFrame:
    """Add ``__bad``: the channel is listed for its recording (rows of ``by`` and channel), or for all recordings."""
    if bads is None or isinstance(bads, list):
        return samples.withColumn("__bad", F.col("channel").isin(bads) if bads else F.lit(False))
    listed = bads.select(*by, "channel").distinct().withColumn("__hit", F.lit(True))
    return samples.join(listed, [*by, "channel"], "left").withColumn("__bad", F.col("__hit").isNotNull()).drop("__hit")


def average_reference(samples: DataFrame, bads: DataFrame | list[str] | None = None, by: list[str] = REC) -> DataFrame:
    """Subtract the mean over the recording's good channels at each time point."""
    good = F.when(~F.col("__bad"), F.col("value"))
    return (with_bads(samples, bads, by).withColumn("value", F.col("value") - F.avg(good).over(W.partitionBy(*by, "t")))
            .select(*samples.columns))


def exclude_components(labels: DataFrame, exclude: list[str] = EXCLUDED_LABELS, threshold: float = 0.7,
                       by: list[str] | None = None) -> DataFrame:
    """Components with an excluded label and a probability strictly above the threshold."""
    hit = F.col("label").isin(exclude) & (F.col("prob") > threshold)
    return labels.withColumn("excluded", F.coalesce(hit, F.lit(False)))


def excluded_lists(labels: DataFrame, by: list[str], exclude: list[str] = EXCLUDED_LABELS,
                   threshold: float = 0.7) -> DataFrame:
    """QC lists of excluded components per recording (as many entries as components)."""
    hit = exclude_components(labels, exclude, threshold).where("excluded")
    return hit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("component_id", "label", "prob"))).alias("excluded"))


def interpolate_channels(samples: DataFrame, weights: Mapping[str, Mapping[str, float]],
                         by: list[str] = REC, bads: DataFrame | list[str] | None = None) -> DataFrame:
    """Replace the recording's bad channels by a weighted mean of its good ones at the same time point.

    ``bads`` as in ``average_reference``; by default every channel with weights. A bad neighbour feeds no repair. The
    weights are montage-sized configuration, so they are expressions and the whole repair is one
    window over (recording, t).
    """
    w = W.partitionBy(*by, "t")
    columns = samples.columns
    samples = with_bads(samples, list(weights) if bads is None else bads, by)
    value = F.col("value")
    for bad, good in weights.items():
        wt = F.coalesce(*[F.when((F.col("channel") == g) & ~F.col("__bad"), F.lit(float(x))) for g, x in good.items()])
        num, den = F.sum(wt * F.col("value")).over(w), F.sum(F.when(F.col("value").isNotNull(), wt)).over(w)
        value = F.when((F.col("channel") == bad) & F.col("__bad"), F.coalesce(safe_div(num, den), F.col("value"))).otherwise(value)
    return samples.withColumn("value", value).select(*columns)


def epoch_ids(samples: DataFrame, length: int, overlap: int = 0, by: list[str] = REC) -> DataFrame:
    """Fixed-length epoching on the sample index; samples of the incomplete tail are dropped.

    Adds ``epoch_id`` and the offset ``n`` inside the epoch; overlapping epochs repeat samples.
    """
    step = length - overlap
    if step <= 0:
        raise ValueError("overlap must be shorter than the epoch")
    size = samples.groupBy(*by).agg((F.max("t") + 1).alias("__size"))
    full = F.floor((F.col("__size") - length) / F.lit(step)) + 1
    first = F.greatest(F.ceil((F.col("t") - length + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col("t") / F.lit(step)), full - 1)
    return (samples.join(size, by).where((F.col("__size") >= length) & (last >= first))
            .withColumn("epoch_id", F.explode(F.sequence(first, last).cast("array<bigint>")))
            .withColumn("n", (F.col("t") - F.col("epoch_id") * step).cast("bigint")).drop("__size"))


def pack_epochs(epoched: DataFrame, by: list[str], length: int) -> DataFrame:
    """One array per epoch and channel (epoch-sized groups); an epoch with a gap is left out."""
    return (epoched.groupBy(*by, "epoch_id")
            .agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("s"))
            .where(F.size("s") == length)
            .select(*by, "epoch_id", F.transform("s", lambda s: s["value"]).alias("x")))


def mark_peak_to_peak(epochs: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    """Flag every channel of an epoch in which any channel's max - min exceeds the limit."""
    over = (F.array_max("x") - F.array_min("x")) > F.lit(float(limit))
    return epochs.withColumn("rejected", F.max(over).over(W.partitionBy(*keys)))


def reject_peak_to_peak(epochs: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    return mark_peak_to_peak(epochs, limit, keys).where(~F.col("rejected")).drop("rejected")


def rejection_stats(marked: DataFrame, by: list[str] = REC, warn_above: float = 0.30) -> DataFrame:
    """Epochs before and after rejection, dropped share, and the warning above the share."""
    per = marked.groupBy(*by).agg(
        F.countDistinct("epoch_id").alias("n_before"),
        F.countDistinct(F.when(~F.col("rejected"), F.col("epoch_id"))).alias("n_after"))
    dropped = F.col("n_before") - F.col("n_after")
    pct = F.coalesce(dropped / F.nullif(F.col("n_before"), F.lit(0)), F.lit(0.0))
    return per.select(*by, "n_before", "n_after", dropped.alias("n_dropped"), pct.alias("pct_dropped"),
                      (pct > warn_above).alias("warn"))


def amplitude_summary(epochs: DataFrame, by: list[str] = REC, recordings: DataFrame | None = None) -> DataFrame:
    """Mean |amplitude| and population sd over all samples, in micro-units; 0 without epochs.

    ``recordings`` (rows of ``by``) adds those of which no epoch is left.
    """
    v = epochs.select(*by, F.explode_outer("x").alias("v"))
    if recordings is not None:
        v = recordings.select(*by).join(v, by, "left")
    return v.groupBy(*by).agg((F.coalesce(F.avg(F.abs("v")), F.lit(0.0)) * 1e6).alias("mean_amplitude_uv"),
                              (F.coalesce(F.stddev_pop("v"), F.lit(0.0)) * 1e6).alias("std_amplitude_uv"))


def epoch_floor(n_epochs: Column, floor: int = 60) -> Column:
    return F.when(n_epochs < floor, "LOW_EPOCH_COUNT").otherwise("OK")
