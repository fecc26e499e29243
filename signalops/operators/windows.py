"""Event-anchored windows: onsets, block ends and sample assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalops.operators import chunks

# Fixed values (seconds): window length, earliest start, margin at the block end, block-end gap.
WINDOW_SEC, MIN_START_SEC, END_MARGIN_SEC, BLOCK_GAP_SEC = 15.0, 5.0, 1.0, 1.0
SHORT_FLOOR, DECODE_FLOOR = 4, 20


def good_markers(ann: DataFrame) -> DataFrame:
    text = F.lower(F.trim("description"))
    return ann.withColumn("__text", text).where(~F.contains(F.col("__text"), F.lit("bad")))


REC = ["subject_id", "condition"]


def event_onset(recordings: DataFrame, ann: DataFrame, keys: list[str] = REC) -> DataFrame:
    """Earliest good marker of the recording that names its condition word; 0.0 when there is none.

    Markers are first reduced to one row per (keys, text), so a recording with very many markers
    never multiplies in the join.
    """
    firsts = good_markers(ann).groupBy(*keys, "__text").agg(F.min("onset").alias("__on"))
    word = F.lower(F.trim(F.regexp_replace("condition", "^[^_]*_", "")))
    cols = recordings.columns
    joined = recordings.withColumn("__word", word).join(firsts, keys, "left")
    hit = (F.col("__word") != "") & F.contains(F.col("__text"), F.col("__word"))
    return joined.groupBy(*cols).agg(F.coalesce(F.min(F.when(hit, F.col("__on"))), F.lit(0.0)).cast("double").alias("onset"))


def last_marker(ann: DataFrame, keys: list[str] = REC) -> DataFrame:
    return good_markers(ann).groupBy(*keys).agg(F.max("onset").cast("double").alias("last_onset"))


def block_end(rec_end: Column, last_onset: Column, response_end: Column) -> Column:
    """Last good marker after the response window, capped at the recording end.

    The largest candidate past the response is simply the last marker if that lies past it,
    so the interval join collapses to one comparison.
    """
    return (F.when(last_onset > response_end + BLOCK_GAP_SEC, F.least(last_onset, rec_end))
            .otherwise(rec_end - END_MARGIN_SEC))


def response_window(df: DataFrame, window: float = WINDOW_SEC, skip: float = 0.0,
                    min_start: float = MIN_START_SEC) -> DataFrame:
    """Window after the onset; slid back to the recording end when it overruns and still fits."""
    start = F.greatest(F.col("onset") + skip, F.lit(min_start))
    overrun, fits = start + window > F.col("rec_end"), F.col("rec_end") - min_start >= window
    return (df.withColumn("__s", start)
            .withColumn("r_start", F.when(~overrun, F.col("__s")).when(fits, F.col("rec_end") - window))
            .withColumn("r_end", F.col("r_start") + window)
            .withColumn("slid_back", overrun & fits)
            .withColumn("window_status", F.when(F.col("r_start").isNull(), "WINDOW_TOO_SHORT").otherwise("OK"))
            .drop("__s"))


def event_windows(recordings: DataFrame, ann: DataFrame, window: float = WINDOW_SEC,
                  min_decode: float = 2.0) -> DataFrame:
    """Response, tail-baseline and whole-block windows of every recording, one row each."""
    base = response_window(event_onset(recordings, ann), window)
    df = base.join(last_marker(ann), REC, "left")
    df = df.withColumn("block_end", block_end(F.col("rec_end"), F.col("last_onset"), F.col("r_end")))
    b_end = F.least(F.col("block_end"), F.col("rec_end"))
    fits = b_end - window >= F.col("r_end")
    d_end = F.greatest(F.col("block_end"), F.col("r_end"))
    ok = F.col("r_start").isNotNull()
    long_enough = d_end - F.col("r_start") >= min_decode
    return df.select(
        *recordings.columns, "onset", "r_start", "r_end", "slid_back", "window_status",
        F.when(ok, F.col("block_end")).alias("block_end"),
        F.when(ok & fits, b_end - window).alias("b_start"), F.when(ok & fits, b_end).alias("b_end"),
        F.when(ok & long_enough, F.col("r_start")).alias("d_start"), F.when(ok & long_enough, d_end).alias("d_end"))


def window_rows(windows: DataFrame, undefined: bool = False) -> DataFrame:
    """One row per defined window, or per window of every recording."""
    cols = [c for c in ("subject_id", "condition", "rec_end") if c in windows.columns]
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"{p}_start").alias("w_start"),
                              F.col(f"{p}_end").alias("w_end"))
                     for n, p in (("response", "r"), ("base", "b"), ("decode", "d"))])
    rows = windows.select(*cols, F.inline(each))
    return rows if undefined else rows.where(F.col("w_start").isNotNull())


def clamped(windows: DataFrame) -> DataFrame:
    """Rows of the defined windows, cut to [0, rec_end]."""
    return (window_rows(windows).withColumn("w_start", F.greatest(F.col("w_start"), F.lit(0.0)))
            .withColumn("w_end", F.least("w_end", "rec_end")).drop("rec_end"))


def samples_in_windows(samples: DataFrame, windows: DataFrame, fs: float, keys: list[str],
                       cell_sec: float = WINDOW_SEC) -> DataFrame:
    """Interval join of samples to windows by cells: both sides are cut into cells of ``cell_sec`` and meet by equality on the cell.

    A window has as many rows as it touches cells, a sample one, so nothing is replicated and one huge
    recording is joined by as many tasks as it has cells.
    """
    cell = lambda sec: F.floor(sec / F.lit(float(cell_sec)))
    w = clamped(windows).where("w_end > w_start").withColumn("__cell", F.explode(F.sequence(cell(F.col("w_start")), cell(F.col("w_end")))))
    sec = F.col("t") / F.lit(float(fs))
    return (samples.withColumn("__cell", cell(sec)).join(w, [*keys, "__cell"])
            .where((sec >= F.col("w_start")) & (sec < F.col("w_end"))).drop("__cell"))


def window_epochs(assigned: DataFrame, fs: float, length_sec: float = 2.0, overlap_sec: float = 1.0) -> DataFrame:
    """Epoch number of each sample inside its window; only epochs that end inside it are kept."""
    step = length_sec - overlap_sec
    pos = F.col("t") / F.lit(float(fs)) - F.col("w_start")
    full = F.floor((F.col("w_end") - F.col("w_start") - length_sec) / F.lit(step) + 1e-9) + 1
    # Sample n of an epoch satisfies start <= pos < start + length.
    first = F.greatest(F.floor((pos - length_sec) / F.lit(step) + 1e-9) + 1, F.lit(0))
    last = F.least(F.floor(pos / F.lit(step) + 1e-9), full - 1)
    return (assigned.where((full >= 1) & (last >= first))
            .withColumn("epoch_id", F.explode(F.sequence(first, last).cast("array<bigint>"))))


def window_viability(epoched: DataFrame, keys: list[str], floors: dict[str, int] | None = None,
                     windows: DataFrame | None = None) -> DataFrame:
    """Epoch count per window against its floor.

    With ``windows`` every window of every recording has a row; those without epochs, or never
    defined, have 0 and are not viable.
    """
    floors = floors or {"response": SHORT_FLOOR, "base": SHORT_FLOOR, "decode": DECODE_FLOOR}
    floor = F.coalesce(*[F.when(F.col("window") == w, F.lit(n)) for w, n in floors.items()])
    n = epoched.groupBy(*keys, "window").agg(F.countDistinct("epoch_id").alias("n_epochs"))
    if windows is not None:
        n = (window_rows(windows, True).select(*keys, "window").join(n, [*keys, "window"], "left")
             .withColumn("n_epochs", F.coalesce("n_epochs", F.lit(0)).cast("bigint")))
    return n.withColumn("viable", F.col("n_epochs") >= floor)


def window_qc(samples: DataFrame, windows: DataFrame, fs: float, channels: list[str], limit: float, keys: list[str] = REC, length_sec: float = 2.0,
              overlap_sec: float = 1.0, decode_overlap_sec: float = 1.0, floors: dict[str, int] | None = None, size: int = chunks.CHUNK) -> DataFrame:
    """One QC row per recording: epochs of its three windows before and after peak-to-peak rejection, viability flags and status.

    The samples are packed into chunks once; each window takes its epochs from the chunks it touches, with an overlap of its own for the
    decoder's window. An undefined window has no epochs and is not viable.
    """
    floors = floors or {"response": SHORT_FLOOR, "base": SHORT_FLOOR, "decode": DECODE_FLOOR}
    halo = round(length_sec * fs) - 1
    packed = chunks.pack(samples, channels, keys, size, halo)
    overlaps = {"response": overlap_sec, "base": overlap_sec, "decode": decode_overlap_sec}
    epochs = chunks.epochs_in_windows(packed, clamped(windows), fs, channels, length_sec, overlaps, limit, size, halo, keys)
    of = lambda w, hit: F.count_if((F.col("window") == w) & hit)
    n = epochs.groupBy(*REC).agg(*[of(w, F.lit(True)).alias(f"{w}_n_before") for w in floors], *[of(w, ~F.col("rejected")).alias(f"{w}_n_after") for w in floors])
    d = windows.select(*REC, "r_start", "b_start", "d_start").join(n, REC, "left")
    count = lambda w, k: F.coalesce(f"{w}_n_{k}", F.lit(0).cast("bigint"))
    viable = {w: (count(w, "after") >= f) & F.col(f"{w[0]}_start").isNotNull() for w, f in floors.items()}
    status = F.when(F.col("r_start").isNull(), "WINDOW_TOO_SHORT").when(viable["response"], "OK").otherwise("LOW_EPOCH_COUNT")
    return d.select(*REC, *[count(w, k).alias(f"{w}_n_{k}") for w in floors for k in ("before", "after")],
                    *[v.alias(f"{w}_viable") for w, v in viable.items()], status.alias("status"))
