"""The conditioning chain on chunk arrays: samples are shuffled once, all later steps are row-local or meet tables of recordings.

``pack`` turns samples(by, channel, t, value) into one row per (recording, chunk of ``size`` samples) that also holds the first
``halo`` samples of the next chunk, so an epoch that starts in a chunk lies inside it. Each step then reads the stored chunks:
pair moments of all channels (bad channels), and mask, reference, repair, second reference and epochs in one pass. A recording of any
length is spread over its chunks; what meets per recording is one row per channel pair and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.lineage import cut
from signalops.operators.conditioning import BAD_MAX_CORR, BAD_Z, FLATLINE_SD, REC, robust_z, verdict_lists

CHUNK = 4096


def pack(samples: DataFrame, channels: list[str], by: list[str] = REC, size: int = CHUNK, halo: int = 0) -> DataFrame:
    """Stored rows (by, chunk, last, pos, v): position channel * (size + halo) + offset, and value, of the samples that are there.

    Channels outside the montage and null values are left out; of samples with one position the largest counts.
    """
    if halo > size:
        raise ValueError("the halo may not exceed a chunk")
    index = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")) - 1
    s = samples.where(F.col("channel").isin(channels) & F.col("value").isNotNull()).select(
        *by, "t", F.col("value").cast("double").alias("value"), index.cast("int").alias("ch"), F.floor(F.col("t") / size).alias("own"))
    offset = F.col("t") - F.col("own") * size
    home = F.array(F.struct(F.col("own").alias("chunk"), offset.alias("at")))
    before = F.array(F.struct((F.col("own") - 1).alias("chunk"), (offset + size).alias("at")))
    where = F.when((offset < halo) & (F.col("own") > 0), F.concat(home, before)).otherwise(home)
    s = s.select(*by, "ch", "value", F.inline(where))
    cell = F.struct((F.col("ch") * (size + halo) + F.col("at")).cast("int").alias("pos"), "value")
    packed = s.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(cell)).alias("s"), F.max(F.when(F.col("at") < size, F.col("chunk") * size + F.col("at"))).alias("last"))
    # A chunk that holds nothing but a halo starts no epoch.
    return cut(packed.where(F.col("last").isNotNull()).select(*by, "chunk", "last", F.col("s.pos").alias("pos"), F.col("s.value").alias("v")))


def crop_range(chunks: DataFrame, fs: float, edge_sec: float = 0.0, by: list[str] = REC) -> DataFrame:
    """(by, first, last): the sample range that is left after both edges go, if the recording is longer than two edges plus one second."""
    end, edge = F.max("last"), edge_sec * fs
    crops = end / F.lit(float(fs)) > 2 * edge_sec + 1
    return chunks.groupBy(*by).agg(F.when(crops, F.lit(int(np.ceil(edge)))).otherwise(0).cast("bigint").alias("first"),
                                   F.when(crops, F.floor(end - edge)).otherwise(end).cast("bigint").alias("last"))


def _grid(pos: pa.Scalar, v: pa.Scalar, p: int, width: int) -> np.ndarray:
    g = np.full(p * width, np.nan)
    g[pos.values.to_numpy(zero_copy_only=False)] = v.values.to_numpy(zero_copy_only=False)
    return g.reshape(p, width)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def pair_moments(chunks: DataFrame, ranges: DataFrame, p: int, size: int, halo: int, by: list[str] = REC) -> DataFrame:
    """(by, i, j, n, c): count and centred co-moment of channels i <= j over the range, from chunk moments merged pairwise."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    at_i, at_j = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by)
        for b in batches:
            rows, out = [], []
            for r, (chunk, first, last) in enumerate(zip(*[b.column(k + i).to_pylist() for i in range(3)])):
                x = _grid(b.column(k + 3)[r], b.column(k + 4)[r], p, size + halo)
                x = x[:, max(0, first - chunk * size):max(0, min(size, last + 1 - chunk * size))]
                there = ~np.isnan(x)
                counts = there.sum(1)
                mean = np.where(there, x, 0).sum(1) / np.maximum(counts, 1)
                d, m = np.where(there, x - mean[:, None], 0.0), there.astype(float)
                n = m @ m.T
                part = (d @ m.T) / np.maximum(n, 1)  # mean of i over the samples where j is there
                c = d @ d.T - n * part * part.T
                full = part + mean[:, None]
                rows += [r] * len(pairs)
                out.append((at_i, at_j, n[at_i, at_j], full[at_i, at_j], full[at_j, at_i], c[at_i, at_j]))
            cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(6)]
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(pa.array(rows, pa.int32())) for i in range(k)] + [pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32))]
                + [pa.array(c.astype(float)) for c in cols[2:]], [*by, "i", "j", "n", "mi", "mj", "c"])

    rows = chunks.join(ranges.withColumnRenamed("last", "stop"), by).select(*by, "chunk", "first", "stop", "pos", "v")
    w = W.partitionBy(*by, "i", "j")
    total = F.nullif(F.sum("n").over(w), F.lit(0.0))
    shifted = (rows.mapInArrow(run, _types(chunks, by) + ", i int, j int, n double, mi double, mj double, c double")
               .withColumn("di", F.col("mi") - F.sum(F.col("n") * F.col("mi")).over(w) / total)
               .withColumn("dj", F.col("mj") - F.sum(F.col("n") * F.col("mj")).over(w) / total))
    return shifted.groupBy(*by, "i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("c") + F.col("n") * F.col("di") * F.col("dj")).alias("c"))


def channel_statistics(moments: DataFrame, channels: list[str], by: list[str] = REC) -> DataFrame:
    """(by, channel, var, sd, max_r): population variance and sd, and the largest |r| with another channel; channels without samples are left out."""
    m = cut(moments.where("n > 0"))
    own = m.where("i = j").select(*by, "i", F.col("n").alias("own_n"), F.col("c").alias("own_c"))
    both = m.where("i < j").select(*by, "i", "j", "n", "c")
    both = both.union(both.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "n", "c"))
    sd = F.sqrt(F.col("own_c") / F.nullif(F.col("own_n") - 1, F.lit(0.0)))
    side = own.select(*by, F.col("i").alias("j"), sd.alias("sd_j"))
    r = F.abs(F.col("c") / F.nullif(F.col("n") - 1, F.lit(0.0)) / F.nullif(F.col("sd_i") * F.col("sd_j"), F.lit(0.0)))
    best = (both.join(side, [*by, "j"]).join(own.select(*by, "i", sd.alias("sd_i")), [*by, "i"])
            .groupBy(*by, "i").agg(F.max(F.coalesce(r, F.lit(0.0))).alias("max_r")))
    name = F.get(F.array(*[F.lit(c) for c in channels]), F.col("i"))
    return (own.join(best, [*by, "i"], "left")
            .select(*by, name.alias("channel"), (F.col("own_c") / F.col("own_n")).alias("var"), F.sqrt(F.col("own_c") / F.col("own_n")).alias("sd"),
                    F.coalesce("max_r", F.lit(0.0 if len(channels) > 1 else None)).alias("max_r")))


def bad_lists(statistics: DataFrame, protect: list[str] | None = None, z: float = BAD_Z, corr: float = BAD_MAX_CORR, flat: float = FLATLINE_SD,
              by: list[str] = REC) -> DataFrame:
    """(by, bad, by_variance, by_correlation, by_flatline) of recordings with a bad channel."""
    return verdict_lists(robust_z(statistics, by), protect, z, corr, flat, by)


def _clean(x: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Average reference without bad channels, weighted repair of them, average reference over all; NaN is missing.

    A bad channel keeps its value at times where none of its neighbours is there.
    """
    def centred(y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        there = ~np.isnan(y[rows])
        n = there.sum(0)
        return y - np.where(n > 0, np.where(there, y[rows], 0).sum(0) / np.maximum(n, 1), np.nan)

    if bad.any() and not bad.all():
        x = centred(x, ~bad)
        w = weights * (~bad)[None, :]
        there = ~np.isnan(x)
        num, den = w @ np.where(there, x, 0), w @ there
        fixed = np.where(den > 0, num / np.where(den > 0, den, 1), x)
        x = np.where(bad[:, None] & there, fixed, x)
    return centred(x, np.ones(len(x), bool))


def _summary(e: np.ndarray, limit: float) -> tuple:
    """Rejected, count, mean |v|, mean and centred square sum of an epoch (channels x samples)."""
    m = e.mean()
    return bool((e.max(1) - e.min(1)).max() > limit), e.size, np.abs(e).mean(), m, ((e - m) ** 2).sum()


STATS = "rejected boolean, n bigint, mean_abs double, mean double, m2 double"


def _emit(b: pa.RecordBatch, carry: int, names: list[str], rows: list, ids: list, stats: list, data: list, with_data: bool) -> pa.RecordBatch:
    cols = [b.column(i).take(pa.array(rows, pa.int32())) for i in range(carry)] + [pa.array(ids, pa.int64())]
    cols += [pa.array([s[i] for s in stats], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
    if with_data:
        cols.append(pa.array([e.tolist() for e in data], pa.list_(pa.list_(pa.float64()))))
    return pa.RecordBatch.from_arrays(cols, names)


def cleaned_epochs(chunks: DataFrame, ranges: DataFrame, bads: DataFrame, channels: list[str], weights: Mapping[str, Mapping[str, float]], length: int,
                   overlap: int, limit: float, size: int, halo: int, by: list[str] = REC, with_data: bool = False) -> DataFrame:
    """One row per full epoch of the cleaned range: by, epoch_id, rejected, n, mean_abs, mean, m2 and, if asked for, x (channels x samples).

    An epoch with a missing sample is left out.
    """
    p, step = len(channels), length - overlap
    if step <= 0 or halo < length - 1:
        raise ValueError("overlap must be shorter than the epoch, and the halo hold the rest of one")
    table = np.array([[float(weights.get(c, {}).get(g, 0.0)) for g in channels] for c in channels])
    names = [*by, "epoch_id", *[x.split()[0] for x in STATS.split(", ")]] + ["x"] * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by)
        for b in batches:
            rows, ids, stats, data = [], [], [], []
            for r, (chunk, first, stop, bad) in enumerate(zip(*[b.column(k + i).to_pylist() for i in range(4)])):
                begin, origin = max(0, -(-(chunk * size - first) // step)), chunk * size
                starts = range(first + begin * step, min(origin + size, stop + 2 - length), step)
                if not len(starts):
                    continue
                x = _clean(_grid(b.column(k + 4)[r], b.column(k + 5)[r], p, size + halo), np.array(bad, bool), table)
                for e, s in enumerate(starts, begin):
                    part = x[:, s - origin:s - origin + length]
                    if not np.isnan(part).any():
                        rows.append(r), ids.append(e), stats.append(_summary(part, limit)), data.append(part)
            yield _emit(b, k, names, rows, ids, stats, data, with_data)

    hit = lambda c: F.coalesce(F.array_contains(F.split("bad", ","), c), F.lit(False))
    rows = (chunks.join(ranges.withColumnRenamed("last", "stop"), by).join(bads.select(*by, "bad"), by, "left")
            .select(*by, "chunk", "first", "stop", F.array(*[hit(c) for c in channels]).alias("bad"), "pos", "v"))
    return rows.mapInArrow(run, f"{_types(chunks, by)}, epoch_id bigint, {STATS}" + ", x array<array<double>>" * with_data)


def epoch_counts(epochs: DataFrame, by: list[str]) -> DataFrame:
    """Epochs before and after rejection, and mean |amplitude| and population sd of what is kept, in micro-units.

    Means of re-referenced epochs lie near 0, so the square sums are added around 0.
    """
    kept = lambda c: F.sum(F.when(~F.col("rejected"), c))
    n = F.nullif(kept(F.col("n")), F.lit(0))
    mean = kept(F.col("n") * F.col("mean")) / n
    var = F.greatest(kept(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean, F.lit(0.0))
    return epochs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(~F.col("rejected")).alias("n_after"),
        (F.coalesce(kept(F.col("n") * F.col("mean_abs")) / n, F.lit(0.0)) * 1e6).alias("mean_amplitude_uv"),
        (F.coalesce(F.sqrt(var), F.lit(0.0)) * 1e6).alias("std_amplitude_uv"))


def preprocess_qc(samples: DataFrame, recordings: DataFrame, channels: list[str], weights: Mapping[str, Mapping[str, float]], fs: float, length: int, limit: float,
                  overlap: int = 0, edge_sec: float = 5.0, floor: int = 60, protect: list[str] | None = None, z: float = BAD_Z, corr: float = BAD_MAX_CORR,
                  flat: float = FLATLINE_SD, size: int = CHUNK, by: list[str] = REC) -> DataFrame:
    """The conditioning chain with one QC row for each of ``recordings`` (rows of ``by``), also for those without samples.

    Crop, bad channels, average reference, repair, second reference, fixed epochs, rejection, amplitude and status.
    """
    halo = length - 1
    chunks = pack(samples, channels, by, size, halo)
    ranges = cut(crop_range(chunks, fs, edge_sec, by))
    statistics = cut(channel_statistics(pair_moments(chunks, ranges, len(channels), size, halo, by), channels, by))
    bads = cut(bad_lists(statistics, protect, z, corr, flat, by))
    epochs = cleaned_epochs(chunks, ranges, bads, channels, weights, length, overlap, limit, size, halo, by)
    have = statistics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_channels"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    seconds = (F.col("last") - F.col("first")) / F.lit(float(fs))
    d = (recordings.select(*by).distinct().join(ranges, by, "left").join(have, by, "left").join(bads, by, "left").join(epoch_counts(epochs, by), by, "left")
         .select(*by, F.coalesce(seconds, F.lit(0.0)).alias("duration_after_crop_sec"), zero("n_channels", "bigint"),
                 *[text(c) for c in ("bad", "by_variance", "by_correlation", "by_flatline")], zero("n_before", "bigint"), zero("n_after", "bigint"),
                 zero("mean_amplitude_uv", "double"), zero("std_amplitude_uv", "double")))
    dropped = F.col("n_before") - F.col("n_after")
    return d.select("*", dropped.alias("n_dropped"), F.coalesce(dropped / F.nullif("n_before", F.lit(0)), F.lit(0.0)).alias("pct_dropped"),
                    F.when(F.col("n_after") < floor, "LOW_EPOCH_COUNT").otherwise("OK").alias("status"))


def epochs_in_windows(chunks: DataFrame, rows: DataFrame, fs: float, channels: list[str], length_sec: float, overlap_sec: Mapping[str, float], limit: float,
                      size: int, halo: int, keys: list[str], with_data: bool = False) -> DataFrame:
    """One row per full epoch inside each window: columns of ``rows``, epoch_id, rejected, n, mean_abs, mean, m2 (, x).

    ``rows`` (keys, window, w_start, w_end in seconds, further columns): a window meets the chunks it touches by equality on the chunk number, so
    nothing is copied to every partition; an epoch is read from the chunk in which it starts. ``overlap_sec`` goes by the window's name.
    """
    p, count = len(channels), round(length_sec * fs)
    if halo < count - 1:
        raise ValueError("the halo must hold the rest of an epoch")
    carried = [c for c in rows.columns if c not in ("w_start", "w_end")]
    names = [*carried, "epoch_id", *[x.split()[0] for x in STATS.split(", ")]] + ["x"] * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at = len(carried), carried.index("window")
        for b in batches:
            rows, ids, stats, data = [], [], [], []
            for r, (name, chunk, start, end) in enumerate(zip(b.column(at).to_pylist(), *[b.column(k + i).to_pylist() for i in range(3)])):
                step, origin, x = length_sec - overlap_sec[name], chunk * size, None
                full = int(np.floor((end - start - length_sec) / step + 1e-9)) + 1
                e = max(0, int(np.floor((origin / fs - start) / step)))
                while e < full:
                    s = int(np.ceil((start + e * step) * fs - 1e-9))
                    if s >= origin + size:
                        break
                    if s >= origin:
                        x = _grid(b.column(k + 3)[r], b.column(k + 4)[r], p, size + halo) if x is None else x
                        part = x[:, s - origin:s - origin + count]
                        if not np.isnan(part).any():
                            rows.append(r), ids.append(e), stats.append(_summary(part, limit)), data.append(part)
                    e += 1
            yield _emit(b, k, names, rows, ids, stats, data, with_data)

    index = lambda sec: F.floor(sec * F.lit(float(fs)) / size)
    spread = rows.where("w_end > w_start").withColumn("chunk", F.explode(F.sequence(index(F.col("w_start")), index(F.col("w_end")))))
    met = chunks.select(*keys, "chunk", "pos", "v").join(spread, [*keys, "chunk"]).select(*carried, "chunk", "w_start", "w_end", "pos", "v")
    return met.mapInArrow(run, f"{_types(rows, carried)}, epoch_id bigint, {STATS}" + ", x array<array<double>>" * with_data)
