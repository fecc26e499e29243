"""Within-subject window decoding and affective-space geometry."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.lineage import cut
from signalops.functions.nulls import add_all
from signalops.functions.ordering import complement_medians
from signalops.operators import inference
from signalops.operators.resampling import assign_folds

# Anchor (valence, arousal) of each emotion on the unit circle.
ANCHORS = {"1_Happy": (0.7071, 0.7071), "2_Calm": (0.7071, -0.7071),
           "3_Sad": (-0.7071, -0.7071), "4_Scare": (-0.7071, 0.7071)}
EMOTION_CODES = {"1_Happy": "H", "2_Calm": "C", "3_Sad": "S", "4_Scare": "F"}


def eligible_classes(windows: DataFrame, subject: str = "subject_id", label: str = "label", minimum: int = 5,
                     max_folds: int = 5) -> DataFrame:
    """Classes with enough windows, of subjects with two such classes, and the fold count."""
    per = windows.groupBy(subject, label).agg(F.count(F.lit(1)).alias("n_windows")).where(F.col("n_windows") >= minimum)
    # A subject has as many rows here as there are classes.
    w = W.partitionBy(subject)
    folds = F.greatest(F.lit(2), F.least(F.lit(max_folds), F.min("n_windows").over(w)))
    return (per.withColumn("n_classes", F.count(F.lit(1)).over(w)).withColumn("folds", folds.cast("bigint"))
            .where(F.col("n_classes") >= 2))


def stratified_folds(windows: DataFrame, row_id: str, k: int | Column = 5, subject: str = "subject_id",
                     label: str = "label", seed: int = 42) -> DataFrame:
    """Shuffled folds inside each (subject, class)."""
    return assign_folds(windows, row_id, k, 0, seed, [subject, label])


# ---------------------------------------------------------------- nearest centroid and LDA

PARTIALS = 128  # class moments a task holds before it hands them on


def _vectors(df: DataFrame, features: list[str] | str) -> DataFrame:
    """Add ``__x``: the features as one array of doubles, missing cells null. ``features``: columns, or the name of an array column."""
    x = F.transform(features, lambda v: v.cast("double")) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn("__x", F.transform(x, lambda v: F.when(~F.isnan(v), v)))


def fold_medians(vectors: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """(keys, medians): for each feature the medians outside each fold and over all rows; exact, of the cells that are there."""
    long = vectors.select(*keys, "fold", F.posexplode("__x").alias("feature", "value")).select(
        F.struct(*keys, "feature").alias("key"), "fold", "value")
    m = complement_medians(long, "key", "value", "fold", folds)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("key.feature").alias("i"), F.col("medians").alias("m"))))
    return m.groupBy(*[F.col(f"key.{k}").alias(k) for k in keys]).agg(ordered.alias("medians"))


def class_moments(vectors: DataFrame, keys: list[str], label: str, p: int, center: np.ndarray, full: bool) -> DataFrame:
    """(keys, fold, label, v): additive moments about ``center`` per class and fold, with those that imputation needs.

    v holds n, missing cells, sums; then, of all pairs of features (of the diagonal if not ``full``), products where both are there,
    sums of one where the other is missing, and counts where both are. Each task adds up its rows in NumPy.
    """
    names = [*keys, "fold", label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cols = list(zip(*held)) or [[] for _ in names]
            made = pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], pa.array([v.tobytes() for v in held.values()], pa.binary())], [*names, "v"])
            held.clear()
            return made

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(names))]
            x = b.column(len(names)).values.to_numpy(zero_copy_only=False).reshape(-1, p) - center if b.num_rows else np.empty((0, p))
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[b.column(c).to_pylist() for c in range(len(names))])):
                places.setdefault(k, []).append(i)
            for k, at in places.items():
                miss = np.isnan(x[at])
                there, gap = np.where(miss, 0.0, x[at]), miss.astype(float)
                second = [there.T @ there, gap.T @ there, gap.T @ gap] if full else [(there * there).sum(0)]
                part = np.concatenate([[len(at)], gap.sum(0), there.sum(0), *[m.ravel() for m in second]])
                held[k] = held[k] + part if k in held else part
                if len(held) >= PARTIALS:
                    yield out()
        if held:
            yield out()

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names) + ", v binary"
    parts = vectors.select(*names, "__x").mapInArrow(run, schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[sum(np.frombuffer(v) for v in pdf["v"]).tobytes()])

    return parts.groupBy(*names).applyInPandas(add, schema)


def _model(own: dict, total: dict, medians: np.ndarray, p: int, full: bool) -> dict | None:
    """Imputation, scaling, class centroids and linear discriminants of total minus own moments; None with under two classes."""
    classes, n, means, scatter = [], [], [], np.zeros((p, p) if full else p)
    medians = np.where(np.isnan(medians), 0.0, medians)  # a feature that is missing throughout stands at the center
    for c in sorted(total):
        v = total[c] - own.get(c, 0.0)
        if v[0] < 0.5:
            continue
        gap, s = v[1:p + 1], v[p + 1:2 * p + 1] + v[1:p + 1] * medians
        if full:
            q, u, both = v[2 * p + 1:].reshape(3, p, p)
            cross = medians[:, None] * u
            q = q + cross + cross.T + medians[:, None] * both * medians[None, :]
            square = q - np.outer(s, s) / v[0]
        else:
            square = v[2 * p + 1:] + gap * medians ** 2 - s * s / v[0]
        classes.append(c), n.append(v[0]), means.append(s / v[0])
        scatter = scatter + square
    if len(classes) < 2:
        return None
    n, means = np.array(n), np.array(means)
    mean = n @ means / n.sum()
    var = ((np.diag(scatter) if full else scatter) + n @ (means - mean) ** 2) / n.sum()
    sd = np.where(var > 1e-20, np.sqrt(np.maximum(var, 0)), 1.0)
    z, pooled = (means - mean) / sd, scatter / (np.outer(sd, sd) if full else sd * sd) / max(n.sum() - len(n), 1.0)
    if full:
        w = z @ np.linalg.pinv(pooled, hermitian=True)
    else:
        w = z * np.where(pooled > 1e-12, 1 / np.where(pooled > 1e-12, pooled, 1.0), 0.0)
    const = np.log(n / n.sum()) - 0.5 * (w * z).sum(axis=1)
    return {"labels": classes, "centroids": z.ravel(), "weights": w.ravel(), "const": const, "mean": mean, "sd": sd, "fill": medians}


def fold_models(folded: DataFrame, features: list[str] | str, keys: list[str], label: str = "label", full: bool = True, folds: int = 5) -> DataFrame:
    """One model per (keys, fold) from the rows outside the fold, and one with fold -1 from all rows, as ``__model``.

    Missing cells are filled with the training rows' medians and the features scaled by their mean and sd. All training sets are differences
    of the same class moments and value positions, so the rows are read once for each whatever the number of folds. ``full``: discriminants with the whole pooled
    covariance (pseudo-inverse where it is singular), else with its diagonal.
    """
    v = cut(_vectors(folded, features).select(*keys, "fold", label, "__x"))
    first = v.select(F.size("__x")).first()
    p = first[0] if first else 0
    center = np.array([c or 0.0 for c in v.agg(*[F.avg(F.col("__x")[i]) for i in range(p)]).first()]) if p else np.empty(0)
    kind = v.schema[label].dataType.simpleString()
    numbers = ("centroids", "weights", "const", "mean", "sd", "fill")
    columns = ["fold", "labels", *numbers]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict = {}
        for f, c, m in zip(pdf["fold"], pdf[label], pdf["v"]):
            own.setdefault(int(f), {})[c] = np.frombuffer(m)
        total: dict = {}
        for rows in own.values():
            for c, m in rows.items():
                total[c] = total.get(c, 0.0) + m
        med = np.full((p, folds + 1), np.nan)
        for cell in pdf["medians"].iloc[0]:
            med[cell["i"]] = [np.nan if x is None else x for x in cell["m"]]
        out = []
        for f in [*sorted(own), -1]:
            m = _model(own.get(f, {}), total, med[:, f] - center, p, full)
            if m:
                m["mean"], m["fill"] = m["mean"] + center, m["fill"] + center
                out.append([*pdf[keys].iloc[0], f, m["labels"], *[m[k].tolist() for k in numbers]])
        return pd.DataFrame(out, columns=[*keys, *columns])

    moments = class_moments(v, keys, label, p, center, full).join(fold_medians(v, keys, folds), keys, "left")
    schema = ", ".join(f"`{k}` {v.schema[k].dataType.simpleString()}" for k in keys) + f", fold bigint, labels array<{kind}>, " + ", ".join(f"{k} array<double>" for k in numbers)
    return cut(moments.groupBy(*keys).applyInPandas(fit, schema)).select(*keys, "fold", F.struct(*columns[1:]).alias("__model"))


def _scaled(x: Column) -> Column:
    """The row's features, filled and scaled by its model."""
    m = F.col("__model")
    return F.transform(x, lambda v, i: (F.coalesce(v, F.get(m["fill"], i)) - F.get(m["mean"], i)) / F.get(m["sd"], i))


def _by_class(flat: Column, combine) -> Column:
    """One number per class: the sum over features of ``combine(row value, class value)``."""
    p = F.size("__z")
    dot = lambda k: F.aggregate(F.zip_with("__z", F.slice(flat, k * p + 1, p), combine), F.lit(0.0), lambda a, v: a + v)
    return F.transform("__model.labels", lambda _, k: dot(k))


def _first_of(best: Column, values: str) -> Column:
    return F.get(F.col("__model.labels"), (F.array_position(values, best) - 1).cast("int"))


def nearest_centroid_oof(folded: DataFrame, features: list[str] | str, row_id: str, keys: list[str] = ("subject_id",),
                         label: str = "label") -> DataFrame:
    """Class of the nearest training centroid for every held-out window (ties: lowest label); null without a model."""
    keys = list(keys)
    j = _vectors(folded, features).join(fold_models(folded, features, keys, label, False), [*keys, "fold"], "left").withColumn("__z", _scaled(F.col("__x")))
    j = j.withColumn("__d", _by_class(F.col("__model.centroids"), lambda a, b: (a - b) * (a - b)))
    return j.withColumn("pred", _first_of(F.array_min("__d"), "__d")).drop("__x", "__model", "__z", "__d")


def _posteriors(j: DataFrame) -> DataFrame:
    j = j.withColumn("__z", _scaled(F.col("__x")))
    j = j.withColumn("__s", F.zip_with(_by_class(F.col("__model.weights"), lambda a, b: a * b), "__model.const", lambda a, b: a + b))
    j = j.withColumn("__e", F.transform("__s", lambda s: F.exp(s - F.array_max("__s"))))
    j = j.withColumn("__t", F.aggregate("__e", F.lit(0.0), lambda a, e: a + e))
    post = F.map_from_arrays("__model.labels", F.transform("__e", lambda e: e / F.col("__t")))
    return j.withColumn("posterior", post).withColumn("pred", _first_of(F.array_max("__s"), "__s")).drop("__x", "__model", "__z", "__s", "__e", "__t")


def lda_oof(folded: DataFrame, features: list[str] | str, keys: list[str] = ("subject_id",), label: str = "label", full: bool = True) -> DataFrame:
    """Out-of-fold linear discriminant posteriors and class (ties: lowest label); null where a training set has under two classes.

    A subject with a third of all windows costs its map-side sums only; rows meet their model in a join of size subjects x folds.
    """
    keys = list(keys)
    return _posteriors(_vectors(folded, features).join(fold_models(folded, features, keys, label, full), [*keys, "fold"], "left"))


def project_rest(windows: DataFrame, rest: DataFrame, features: list[str] | str, keys: list[str] = ("subject_id",),
                 label: str = "label", full: bool = True) -> DataFrame:
    """Resting windows scored by a classifier trained on all of the subject's labelled windows."""
    keys = list(keys)
    whole = fold_models(windows.withColumn("fold", F.lit(0)), features, keys, label, full, 1).where("fold = -1").drop("fold")
    return _posteriors(_vectors(rest, features).join(whole, keys))


def decoder_chain(windows: DataFrame, rest: DataFrame | None, features: list[str] | str, row_id: str, anchors: dict, full: bool = True, minimum: int = 5,
                  max_folds: int = 5, subject: str = "subject_id", label: str = "label") -> DataFrame:
    """One row per subject: eligibility, out-of-fold accuracy, affective-space geometry and the resting offset; skipped subjects are listed.

    Folds are clamped to the smallest eligible class of each subject.
    """
    array = features if isinstance(features, str) else "__features"
    w = _vectors(windows, features).select(subject, label, row_id, F.col("__x").alias(array))
    w = cut(w)
    classes = cut(eligible_classes(w, subject, label, minimum, max_folds))
    folded = cut(stratified_folds(w.join(classes.select(subject, label, "folds"), [subject, label]), row_id, F.col("folds"), subject, label))
    models = fold_models(folded, array, [subject], label, full, max_folds)
    pred = cut(posterior_va(_posteriors(_vectors(folded, array).join(models, [subject, "fold"], "left")), anchors))
    names = F.array_join(F.array_sort(F.collect_list(F.col(label).cast("string"))), ",")
    per = classes.groupBy(subject).agg(F.max("folds").alias("cv_folds"), names.alias("classes"))
    d = (w.select(subject).distinct().join(per, subject, "left").join(fold_accuracy(pred, [subject], label), subject, "left")
         .join(va_geometry(pred, list(anchors), subject, label), subject, "left").join(silhouette(pred, subject, label), subject, "left"))
    if rest is not None:
        whole = models.where("fold = -1").drop("fold")
        offset = rest_offset(posterior_va(_posteriors(_vectors(rest, features).join(whole, subject)), anchors), subject)
        d = d.join(offset, subject, "left")
    # Subjects without two eligible classes: how many they have.
    few = w.groupBy(subject, label).count().groupBy(subject).agg(F.count_if(F.col("count") >= minimum).alias("__few"))
    return (d.join(few, subject).withColumn("status", F.when(F.col("cv_folds").isNull(), "skip_insufficient_classes").otherwise("ok"))
            .withColumn("n_classes", F.coalesce("n_classes", "__few")).drop("__few"))


# ---------------------------------------------------------------- scores

def confusion(pred: DataFrame, classes: list, keys: list[str], label: str = "label") -> DataFrame:
    """Counts on the full true x predicted grid, zero cells kept."""
    n = pred.groupBy(*keys).agg(*[F.count_if((F.col(label) == a) & (F.col("pred") == b)).alias(f"c{i}_{j}")
                                  for i, a in enumerate(classes) for j, b in enumerate(classes)])
    cells = F.array(*[F.struct(F.lit(a).alias("true"), F.lit(b).alias("pred"), F.col(f"c{i}_{j}").alias("count"))
                      for i, a in enumerate(classes) for j, b in enumerate(classes)])
    return n.select(*keys, F.inline(cells))


def fold_accuracy(pred: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Mean and population sd of fold accuracy, and the chance level."""
    hit = (F.col(label) == F.col("pred")).cast("double")
    per = pred.groupBy(*keys, "fold").agg(F.avg(hit).alias("acc"), F.count(F.lit(1)).alias("n"),
                                          F.collect_set(label).alias("labels"))
    return per.groupBy(*keys).agg(F.avg("acc").alias("acc_mean"), F.stddev_pop("acc").alias("acc_sd"), F.sum("n").alias("n_windows"),
                                  F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).cast("bigint").alias("n_classes")
                                  ).withColumn("chance", 1.0 / F.col("n_classes"))


def decoder_rollup(acc: DataFrame, model: str = "model") -> DataFrame:
    return acc.groupBy(model).agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("acc_mean").alias("mean_accuracy"))


# ---------------------------------------------------------------- affective space

def project_va(df: DataFrame, probabilities: dict[str, str], anchors: dict[str, tuple[float, float]] = ANCHORS) -> DataFrame:
    """Posterior-weighted anchor position; ``probabilities`` maps class to column."""
    return df.withColumn("v", add_all([F.col(c) * anchors[k][0] for k, c in probabilities.items()])).withColumn(
        "a", add_all([F.col(c) * anchors[k][1] for k, c in probabilities.items()]))


def posterior_va(df: DataFrame, anchors: dict[str, tuple[float, float]] = ANCHORS) -> DataFrame:
    """The same from a posterior map keyed by class name."""
    p = lambda k: F.coalesce(F.element_at("posterior", F.lit(k)), F.lit(0.0))
    return df.withColumn("v", add_all([p(k) * xy[0] for k, xy in anchors.items()])).withColumn(
        "a", add_all([p(k) * xy[1] for k, xy in anchors.items()]))


def va_geometry(df: DataFrame, classes: list, subject: str = "subject_id", label: str = "label") -> DataFrame:
    """Centroid, its offset, mean distance between class centroids, mean distance within classes."""
    cents = df.groupBy(subject, label).agg(F.avg("v").alias("cv"), F.avg("a").alias("ca"), F.sum("v").alias("sv"),
                                           F.sum("a").alias("sa"), F.count(F.lit(1)).alias("n"))
    disp = (df.join(cents.select(subject, label, "cv", "ca"), [subject, label])
            .groupBy(subject).agg(F.avg(F.hypot(F.col("v") - F.col("cv"), F.col("a") - F.col("ca"))).alias("dispersion")))
    at = lambda c, x: F.max(F.when(F.col(label) == c, F.col(x)))
    one = cents.groupBy(subject).agg((F.sum("sv") / F.sum("n")).alias("centroid_v"), (F.sum("sa") / F.sum("n")).alias("centroid_a"),
                                     *[at(c, x).alias(f"{x}{i}") for i, c in enumerate(classes) for x in ("cv", "ca")])
    pairs = F.array(*[F.hypot(F.col(f"cv{i}") - F.col(f"cv{j}"), F.col(f"ca{i}") - F.col(f"ca{j}"))
                      for i, j in combinations(range(len(classes)), 2)])
    known = F.filter(pairs, lambda d: d.isNotNull())
    sep = F.aggregate(known, F.lit(0.0), lambda s, d: s + d) / F.nullif(F.size(known), F.lit(0))
    return one.select(subject, "centroid_v", "centroid_a", F.hypot("centroid_v", "centroid_a").alias("centroid_offset"),
                      sep.alias("separation")).join(disp, subject)


def class_centroids(df: DataFrame, codes: dict, subject: str = "subject_id", label: str = "label", prefix: str = "va_") -> DataFrame:
    """Per-class decoded centroid columns; a missing class leaves NULLs."""
    return df.groupBy(subject).agg(*[F.avg(F.when(F.col(label) == c, F.col(x))).alias(f"{prefix}{s}{x}")
                                     for c, s in codes.items() for x in ("v", "a")])


def silhouette(df: DataFrame, subject: str = "subject_id", label: str = "label", block: int = 512) -> DataFrame:
    """Exact mean Euclidean silhouette in the plane, per subject.

    Distances need every point against every point of the subject, but no pair rows are made.
    Equal points are merged into one weighted point first; points are packed into blocks of
    bounded size, block meets block in a join on (subject, block pair), and each meeting yields one
    partial sum per point and class. A huge subject is spread over (n / block)^2 small tasks.
    NULL with fewer than two classes or no more windows than classes.
    """
    kind = df.schema[label].dataType.simpleString()
    pts = cut(df.groupBy(subject, F.col("v").cast("double").alias("v"), F.col("a").cast("double").alias("a"), F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("w")))
    sizes = pts.groupBy(subject).agg(F.count(F.lit(1)).alias("__p"), F.sum("w").alias("__n"), F.countDistinct("c").alias("__k"))
    pts = pts.join(sizes, subject).withColumn("__m", F.ceil(F.col("__p") / F.lit(block)))
    slot = F.pmod(F.xxhash64("v", "a", "c"), F.col("__m"))
    blocks = pts.withColumn("__b", slot).groupBy(subject, "__b", "__n", "__k", "__m").agg(
        F.collect_list(F.struct("v", "a", "c", "w")).alias("p"))
    # Every block goes to each of its pairs, so the pairs are separate shuffle keys.
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__m") - 1))
    left = blocks.select(subject, F.col("__b").alias("__b1"), every.alias("__b2"), "__n", "__k", F.col("p").alias("p1"))
    right = blocks.select(subject, every.alias("__b1"), F.col("__b").alias("__b2"), F.col("p").alias("p2"))

    @F.pandas_udf(f"array<struct<v double, a double, own {kind}, w bigint, c {kind}, d double, m bigint>>")
    def sums(p1: pd.Series, p2: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(p1, p2):
            xa, xb = (np.array([[r["v"], r["a"]] for r in s]) for s in (one, two))
            cb, wb = np.array([r["c"] for r in two]), np.array([r["w"] for r in two])
            d = np.sqrt(((xa[:, None, :] - xb[None, :, :]) ** 2).sum(axis=2)) * wb
            rows = []
            for c in np.unique(cb):
                tot = d[:, cb == c].sum(axis=1)
                rows += [{"v": r["v"], "a": r["a"], "own": r["c"], "w": r["w"], "c": c.item() if hasattr(c, "item") else c,
                          "d": float(t), "m": int(wb[cb == c].sum())} for r, t in zip(one, tot)]
            out.append(rows)
        return pd.Series(out)

    part = left.join(right, [subject, "__b1", "__b2"]).select(subject, "__n", "__k", F.inline(sums("p1", "p2")))
    point = [subject, "v", "a", "own", "w", "__n", "__k"]
    per = part.groupBy(*point, "c").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    mine = F.col("own") == F.col("c")
    pt = per.groupBy(*point).agg(F.max(F.when(mine, F.col("d"))).alias("ds"), F.max(F.when(mine, F.col("m"))).alias("ms"),
                                 F.min(F.when(~mine, F.col("d") / F.col("m"))).alias("b"))
    within = F.when(F.col("ms") > 1, F.col("ds") / F.nullif(F.col("ms") - 1, F.lit(0)))
    s = F.when(within.isNull(), 0.0).otherwise((F.col("b") - within) / F.nullif(F.greatest(within, F.col("b")), F.lit(0.0)))
    ok = (F.col("__k") >= 2) & (F.col("__n") > F.col("__k"))
    return pt.groupBy(subject, "__n", "__k").agg((F.sum(F.coalesce(s, F.lit(0.0)) * F.col("w")) / F.sum("w")).alias("s")).select(
        subject, F.when(ok, F.col("s")).alias("silhouette"))


def rest_offset(rest_va: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Centroid and offset of the projected resting windows."""
    return rest_va.groupBy(subject).agg(F.avg("v").alias("precursor_v"), F.avg("a").alias("precursor_a")).withColumn(
        "precursor_offset", F.hypot("precursor_v", "precursor_a"))


def predict_from_geometry(full: DataFrame, geometry: DataFrame, target: str, covariates: list[str], row_id: str,
                          correction: str = "fdr_bh") -> tuple[DataFrame, DataFrame]:
    """Scan and block test of the two geometry sets, kept apart; infeasible blocks are named, not run."""
    merged, sets = geometry_predictors(full, geometry, row_id)
    merged = cut(merged)
    scans = [inference.univariate_scan(merged, target, covariates, cols, correction).withColumn("feature_set", F.lit(s))
             for s, cols in sets.items()]
    return reduce(DataFrame.unionByName, scans), inference.run_tests(merged, [target], sets, covariates, {}, row_id)


def geometry_predictors(full: DataFrame, geometry: DataFrame, subject: str = "subject_id", prefix: str = "va_"
                        ) -> tuple[DataFrame, dict[str, list[str]]]:
    """Left-join geometry to the subjects and name the two sets, which are tested apart."""
    cols = [c for c in geometry.columns if c != subject]
    sets = {"asm_va": [c for c in cols if c.startswith(prefix)], "asm_geometry": [c for c in cols if not c.startswith(prefix)]}
    return full.join(geometry, subject, "left"), {k: v for k, v in sets.items() if v}
