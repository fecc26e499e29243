"""Folds, permutations and resampled scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.hashing import draw
from signalops.functions.lineage import cut
from signalops.functions.nulls import add_all, corr_agg, safe_div
from signalops.functions.ordering import exact_quantiles, hash_row_number
from signalops.operators.inference import index_rows


def long_features(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.inline(cells))


def median_impute(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact column medians for missing cells; medians come from bucketed positions, not one sort."""
    med = exact_quantiles(long_features(df, features, []), "feature", "value", {"median": 0.5})
    row = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    t = df.withColumn("__m", row)
    return t.withColumns({f: F.coalesce(F.col(f), F.element_at("__m", F.lit(f))) for f in features}).drop("__m")


def assign_folds(df: DataFrame, row_id: str, k: int = 5, rep: int | Column = 0, seed: int = 42,
                 keys: list[str] = (), name: str = "fold") -> DataFrame:
    """Balanced shuffled folds 0..k-1, within ``keys`` when given (stratified)."""
    h = df.withColumn("__h", draw(row_id, rep, seed))
    r = hash_row_number(h, list(keys), "__h", row_id, name="__rn")
    return r.withColumn(name, ((F.col("__rn") - 1) % k).cast("bigint")).drop("__h", "__rn")


def repeated_folds(df: DataFrame, row_id: str, k: int = 5, repeats: int = 3, seed: int = 42) -> DataFrame:
    """One row per (row, repeat) with its fold."""
    r = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<bigint>")))
    return assign_folds(r, row_id, k, F.col("rep"), seed, ["rep"])


# ---------------------------------------------------------------- fold-wise statistics

def training_stats(folded: DataFrame, features: list[str], fold: str = "fold", by: list[str] = ()) -> DataFrame:
    """Mean and population sd of the training rows of each fold, from per-fold sums.

    Sums are taken about the overall mean, so complement = total - own fold stays exact.
    """
    mid = folded.agg(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    c = folded.withColumn("__c", mid)
    aggs = []
    for i, f in enumerate(features):
        d = F.col(f) - F.col(f"__c.{f}")
        aggs += [F.count(f).alias(f"n{i}"), F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}"), F.max(f"__c.{f}").alias(f"c{i}")]
    own = c.groupBy(*by, fold).agg(*aggs)
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    rest = lambda n: F.sum(n).over(w) - F.col(n)
    rows = []
    for i, f in enumerate(features):
        n = F.nullif(rest(f"n{i}"), F.lit(0))
        m = rest(f"s{i}") / n
        rows.append(F.struct(F.lit(f).alias("feature"), (F.col(f"c{i}") + m).alias("mean"),
                             F.sqrt(rest(f"q{i}") / n - m * m).alias("sd")))
    return own.select(*by, fold, F.array(*rows).alias("r")).select(*by, fold, F.inline("r"))


def zscore_by_fold(folded: DataFrame, features: list[str], row_id: str, fold: str = "fold") -> DataFrame:
    """Each row standardised with the statistics of the rows outside its fold."""
    st = training_stats(folded, features, fold).groupBy(fold).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "sd")))).alias("__s"))
    j = folded.join(st, fold)
    at = lambda f, part: F.element_at("__s", F.lit(f))[part]
    return j.select(row_id, fold, *[safe_div(F.col(f) - at(f, "mean"), at(f, "sd")).alias(f) for f in features])


def kbest(df: DataFrame, y: str, features: list[str], k: int = 10) -> DataFrame:
    """The k features with the largest one-predictor F, from one aggregate."""
    one = df.agg(*[corr_agg(f, y).alias(f"r{i}") for i, f in enumerate(features)],
                 *[F.count_if(F.col(f).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}") for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
                     for i, f in enumerate(features)])
    r2 = F.col("r") * F.col("r")
    return (one.select(F.inline(rows)).withColumn("f_score", r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
            .orderBy(F.col("f_score").desc_nulls_last(), "feature").limit(k))


def oof_simple(folded: DataFrame, y: str, x: str, row_id: str, fold: str = "fold", by: list[str] = ()) -> DataFrame:
    """Out-of-fold predictions of y ~ x: training moments are total minus own fold."""
    mid = folded.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y"))).scalar()
    d = folded.withColumn("__c", mid)
    dx, dy = F.col(x) - F.col("__c.x"), F.col(y) - F.col("__c.y")
    own = d.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(dx).alias("sx"), F.sum(dy).alias("sy"),
                                   F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"),
                                   F.max("__c.x").alias("cx"), F.max("__c.y").alias("cy"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    t = own.select(*by, fold, "cx", "cy", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "xx", "xy")])
    b = safe_div(F.col("xy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"))
    m = t.withColumn("slope", b).withColumn("icept", F.col("cy") + F.col("sy") / F.col("n") - b * (F.col("cx") + F.col("sx") / F.col("n")))
    return folded.join(m.select(*by, fold, "slope", "icept"), [*by, fold]).withColumn(
        "pred", F.col("icept") + F.col("slope") * F.col(x)).drop("slope", "icept")


def oof_scores(predicted: DataFrame, y: str, pred: str = "pred", fold: str = "fold", by: list[str] = ()) -> DataFrame:
    """Mean of fold R2 (constant folds skipped), mean fold MAE, baseline MAE about the grand mean."""
    grand = predicted.agg(F.avg(y).alias("m")).scalar()
    p = predicted.withColumn("__g", grand)
    e = F.col(y) - F.col(pred)
    per = p.groupBy(*by, fold).agg(
        F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.avg(F.abs(e)).alias("mae"),
        F.sum(F.abs(F.col(y) - F.col("__g"))).alias("base"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst")))
    return per.groupBy(*by).agg(F.avg(r2).alias("oof_r2"), F.avg("mae").alias("oof_mae"),
                                (F.sum("base") / F.sum("n")).alias("baseline_mae"))


# ---------------------------------------------------------------- permutations

def permuted_target(df: DataFrame, y: str, row_id: str, reps: int, seed: int = 42) -> DataFrame:
    """(rep, original columns, y_perm): one permutation per replicate, shared by every statistic.

    A replicate's permutation pairs row i with the row whose index equals i's hash rank.
    """
    idx = index_rows(df, row_id, seed)
    r = idx.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)).cast("array<bigint>")))
    r = hash_row_number(r.withColumn("__h", draw("idx", F.col("rep"), seed)), ["rep"], "__h", "idx", name="__rn")
    return r.join(idx.select(F.col("idx").alias("__rn"), F.col(y).alias("y_perm")), "__rn").drop("__h", "__rn", "idx")


def _null(df: DataFrame, y: str, features: list[str], row_id: str, reps: int, seed: int) -> tuple[DataFrame, Column]:
    d = df.select(row_id, y, *features).na.drop()
    null = permuted_target(d, y, row_id, reps, seed).groupBy("rep").agg(
        *[F.abs(corr_agg(f, "y_perm")).alias(f"s{i}") for i, f in enumerate(features)])
    obs = d.agg(F.struct(*[F.abs(corr_agg(f, y)).alias(f"o{i}") for i, f in enumerate(features)])).scalar()
    return null, obs


def permutation_p(df: DataFrame, y: str, features: list[str], row_id: str, reps: int = 100, seed: int = 42) -> DataFrame:
    """Share of replicates whose |r| reaches the observed one, and the same against the maximum
    over all features of the replicate (selection-corrected). No +1 correction."""
    null, obs = _null(df, y, features, row_id, reps, seed)
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(features))]) if len(features) > 1 else F.col("s0")
    t = null.withColumn("__o", obs).withColumn("__top", top)
    one = t.agg(F.count(F.lit(1)).alias("n"), F.max("__o").alias("o"),
                *[F.avg((F.col(f"s{i}") >= F.col(f"__o.o{i}")).cast("double")).alias(f"p{i}") for i in range(len(features))],
                *[F.avg((F.col("__top") >= F.col(f"__o.o{i}")).cast("double")).alias(f"m{i}") for i in range(len(features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"o.o{i}").alias("observed"), F.col(f"p{i}").alias("p_perm"),
                              F.col(f"m{i}").alias("p_max"), F.col("n").alias("n_perm")) for i, f in enumerate(features)])
    return one.select(F.inline(rows))


# ---------------------------------------------------------------- model grid

def _enet(g: np.ndarray, b: np.ndarray, alpha: np.ndarray, l1: np.ndarray, start: np.ndarray, sweeps: int = 10000,
          tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent on standardised Grams g = X'X/n and b = X'y/n, many problems at once.

    Shapes (problems, p, p), (problems, p), (problems,). A problem has converged when a sweep moves no weight by
    more than ``tol`` of its largest one and the optimality conditions hold within ``tol`` of the largest X'y, or when the exact
    solution for its present signs meets the conditions, which is tried every 20 sweeps. Returns the weights and which problems converged within ``sweeps``.
    """
    w, done = start.copy(), np.zeros(len(start), bool)
    size, pull = g.diagonal(axis1=1, axis2=2), alpha * l1
    shrink = size + (alpha * (1 - l1))[:, None] + 1e-12
    exact = np.zeros(len(w), bool)
    for t in range(1, sweeps + 1):
        step = np.zeros(len(w))
        for j in range(w.shape[1]):
            r = b[:, j] - np.einsum("ij,ij->i", g[:, j], w) + size[:, j] * w[:, j]
            new = np.sign(r) * np.maximum(np.abs(r) - pull, 0.0) / shrink[:, j]
            step = np.maximum(step, np.abs(new - w[:, j]))
            w[:, j] = new
        if t % 20 == 0:
            for i in np.flatnonzero(~exact):
                found = _signed_solution(g[i], b[i], alpha[i], l1[i], w[i])
                if found is not None:
                    w[i], exact[i] = found, True
        small = exact | (step <= tol * np.abs(w).max(axis=1))
        if not small.all():
            continue
        # Small steps alone may be slow progress: the optimality conditions must hold as well.
        rest = b - np.einsum("ijk,ik->ij", g, w) - (alpha * (1 - l1))[:, None] * w
        off = np.where(w != 0, np.abs(rest - pull[:, None] * np.sign(w)), np.maximum(np.abs(rest) - pull[:, None], 0.0)).max(axis=1)
        done = exact | (off <= tol * np.abs(b).max(axis=1))
        if done.all():
            break
    return w, done


def _signed_solution(g: np.ndarray, b: np.ndarray, alpha: float, l1: float, w: np.ndarray) -> np.ndarray | None:
    """The optimum if the support and signs of w are those of the optimum, else None."""
    on = w != 0
    out = np.zeros_like(w)
    if on.any():
        system = g[np.ix_(on, on)] + alpha * (1 - l1) * np.eye(int(on.sum()))
        out[on] = np.linalg.lstsq(system, b[on] - alpha * l1 * np.sign(w[on]), rcond=None)[0]
    rest = b - g @ out - alpha * (1 - l1) * out
    fits = (np.sign(out[on]) == np.sign(w[on])).all() and (np.abs(rest[~on]) <= alpha * l1 + 1e-9).all() and np.allclose(
        rest[on], alpha * l1 * np.sign(w[on]), atol=1e-9)
    return out if fits else None


# The mixing ratios tried inside each training fold, the length of the penalty path and its ratio.
L1_RATIOS = [0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
N_ALPHAS, ALPHA_RATIO, SWEEPS = 100, 1e-3, 10000


GRAM_ROWS, GRAM_BYTES = 256, 1 << 26  # rows of a block; what a task holds before it hands sums on


def gram_table(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Stored rows (keys, block, c, v): sums of products of (1, columns) with one another, blocks of ``GRAM_ROWS`` of their rows.

    Columns are centred on their means (c); missing cells are not allowed. Each task multiplies its rows of a key in NumPy, so the plan does not
    grow with the square of the width.
    """
    p = len(columns) + 1
    cen = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    d = df.withColumn("__c", cen)
    d = d.select(*keys, F.array(*[F.col(f"__c.{c}") for c in columns]).alias("c"), F.array(F.lit(1.0), *[F.col(c) - F.col(f"__c.{c}") for c in columns]).alias("z"))
    k, starts = len(keys), range(0, p, GRAM_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types, centre = [], None

        def out() -> pa.RecordBatch:
            rows = [(key, b, q[b:b + GRAM_ROWS].tobytes()) for key, q in held.items() for b in starts]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types)], pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([centre] * len(rows), pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.binary())], [*keys, "block", "c", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            types, centre = [b.schema.field(i).type for i in range(k)], b.column(k)[0].as_py()
            z = b.column(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[b.column(c).to_pylist() for c in range(k)])):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                q = z[at].T @ z[at]
                held[key] = held[key] + q if key in held else q
                if len(held) * q.nbytes > GRAM_BYTES:
                    yield out()
        if held:
            yield out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[sum(np.frombuffer(v) for v in pdf["v"]).tobytes()])

    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys) + ", block bigint, c array<double>, v binary"
    return cut(d.mapInArrow(run, schema).groupBy(*keys, "block").applyInPandas(add, schema))


def _cells(pdf: pd.DataFrame, key: list[str], p: int) -> dict[tuple, np.ndarray]:
    """The whole matrix of each key from its blocks."""
    parts: dict[tuple, dict[int, np.ndarray]] = {}
    for row in pdf[[*key, "block", "v"]].itertuples(index=False):
        parts.setdefault(tuple(row[:-2]), {})[row[-2]] = np.frombuffer(row[-1]).reshape(-1, p)
    return {k: np.concatenate([v[b] for b in sorted(v)]) for k, v in sorted(parts.items())}


def _best_net(cells: dict[int, np.ndarray], centre: np.ndarray, n_alphas: int, sweeps: int) -> dict:
    """The elastic net of one training set given as moment matrices of (1, x..., y) by inner fold, penalties chosen on the inner folds."""
    p = len(centre) - 1

    def std(q):
        n, s = q[0, 0], q[0, 1:]
        m = s / n
        cov = q[1:, 1:] / n - np.outer(m, m)
        sd = np.sqrt(np.maximum(np.diag(cov)[:p], 1e-24))
        return m, sd, cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd

    whole = sum(cells.values())
    m, sd, g, b = std(whole)
    sets = [(std(whole - q), q) for _, q in sorted(cells.items()) if whole[0, 0] > q[0, 0]]
    ratio = np.array(L1_RATIOS)
    path = np.abs(b).max() / ratio[:, None] * np.geomspace(1, ALPHA_RATIO, n_alphas)[None, :]
    k, r = len(sets), len(ratio)
    gi, bi = np.repeat([t[0][2] for t in sets], r, axis=0), np.repeat([t[0][3] for t in sets], r, axis=0)
    w, err, fine = np.zeros((k * r, p)), np.zeros((r, n_alphas)), True
    for a in range(n_alphas):
        w, ok = _enet(gi, bi, np.tile(path[:, a], k), np.tile(ratio, k), w, sweeps)
        fine &= bool(ok.all())
        for e, ((mi, sdi, _, _), q) in enumerate(sets):
            u = np.hstack([-w[e * r:(e + 1) * r] / sdi, np.ones((r, 1))])
            u = np.hstack([-(u @ mi)[:, None], u])  # residual of (1, x, y)
            err[:, a] += np.einsum("ij,jk,ik->i", u, q, u)
    i, a = np.unravel_index(err.argmin(), err.shape)
    w, ok = _enet(g[None], b[None], path[i, a:a + 1], ratio[i:i + 1], np.zeros((1, p)), sweeps)
    beta = w[0] / sd
    icept = centre[p] + m[p] - beta @ (centre[:p] + m[:p])
    return {"beta": np.append(icept, beta).tolist(), "l1": float(ratio[i]), "alpha": float(path[i, a]), "converged": fine and bool(ok.all())}


NET = "beta array<double>, l1 double, alpha double, converged boolean"


def elastic_net_models(folded: DataFrame, y: str, xs: list[str], row_id: str, by: list[str] = ("rep",), fold: str = "fold",
                       inner: int = 5, n_alphas: int = N_ALPHAS, sweeps: int = SWEEPS) -> DataFrame:
    """One elastic net per (by, fold): beta (intercept first), l1, alpha, converged.

    One pass yields a moment matrix per (repeat, fold, inner fold), at any width of the design. Every training
    set, inner or outer, is a sum of matrices. Each (repeat, fold) is solved in a task of its own, which
    receives those of the other folds; its inner folds and mixing ratios run down the penalty path together.
    """
    by = list(by)
    p = len(xs) + 2
    cells = gram_table(folded.withColumn("__i", draw(row_id, 7919, 7) % inner), [*xs, y], [*by, fold, "__i"])
    folds = cells.select(*by, F.col(fold).alias("__f")).distinct()
    training = cells.join(folds, by).where(F.col(fold) != F.col("__f"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[int, np.ndarray] = {}
        for (_, i), q in _cells(pdf, [fold, "__i"], p).items():
            total[i] = total.get(i, 0.0) + q
        net = _best_net(total, np.array(pdf["c"].iloc[0]), n_alphas, sweeps)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, fold: pdf["__f"].iloc[0], **net}])

    types = {f.name: f.dataType.simpleString() for f in folded.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*by, fold]] + [NET])
    return training.groupBy(*by, "__f").applyInPandas(solve, schema)


def permuted_nets(rows: DataFrame, targets: DataFrame, xs: list[str], row_id: str, reps: int, folds: int, inner: int = 5, chunk: int = 8, n_alphas: int = N_ALPHAS,
                  sweeps: int = SWEEPS) -> DataFrame:
    """Elastic nets per (rep, fold) where replicates differ in the target only.

    ``rows`` (row_id, xs, fold) give X'X once per (fold, inner fold); ``targets`` (rep, row_id, y_perm) joined to them give X'y and y'y, the only
    table that grows with the replicates. A task solves ``chunk`` replicates of a fold from one copy of X'X.
    """
    p = len(xs) + 1
    rows = cut(rows.withColumn("__i", draw(row_id, 7919, 7) % inner))
    gram = gram_table(rows, xs, ["fold", "__i"])
    mean = targets.agg(F.avg("y_perm").alias("m")).scalar()
    cen = rows.agg(F.struct(*[F.avg(c).alias(c) for c in xs])).scalar()
    t = targets.withColumn("__m", mean).withColumn("__y", F.col("y_perm") - F.col("__m")).join(rows.withColumn("__c", cen), row_id)
    y = F.col("__y")
    ys = cut(t.groupBy("rep", "fold", "__i").agg(F.array(F.sum(y), *[F.sum(y * (F.col(c) - F.col(f"__c.{c}"))) for c in xs]).alias("xy"), F.sum(y * y).alias("yy"),
                                                 F.max("__m").alias("m")))
    chunks = -(-(reps + 1) // chunk)
    spread = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>"))
    others = F.filter(F.array(*[F.lit(f).cast("bigint") for f in range(folds)]), lambda f: f != F.col("fold"))
    left = gram.withColumn("__f", F.explode(others)).withColumn("__k", spread)
    right = ys.withColumn("__f", F.explode(others)).withColumn("__k", F.floor(F.col("rep") / chunk))

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame([], columns=["rep", "fold", "beta", "l1", "alpha", "converged"])
        x, out = _cells(a, ["fold", "__i"], p), []
        for rep, part in b.groupby("rep"):
            total: dict[int, np.ndarray] = {}
            for f, i, xy, yy in zip(part["fold"], part["__i"], part["xy"], part["yy"]):
                q = np.zeros((p + 1, p + 1))
                q[:p, :p], q[:p, p], q[p, :p], q[p, p] = x[f, i], xy, xy, yy
                total[i] = total.get(i, 0.0) + q
            net = _best_net(total, np.append(a["c"].iloc[0], part["m"].iloc[0]), n_alphas, sweeps)
            out.append({"rep": rep, "fold": b["__f"].iloc[0], **net})
        return pd.DataFrame(out)

    return left.groupBy("__f", "__k").cogroup(right.groupBy("__f", "__k")).applyInPandas(solve, f"rep bigint, fold bigint, {NET}")


def elastic_net_oof(folded: DataFrame, y: str, xs: list[str], row_id: str, by: list[str] = ("rep",), fold: str = "fold",
                    inner: int = 5, n_alphas: int = N_ALPHAS, sweeps: int = SWEEPS) -> DataFrame:
    """Out-of-fold elastic net with inner cross-validation; ``converged`` tells whether every fit of the row's model did."""
    models = elastic_net_models(folded, y, xs, row_id, by, fold, inner, n_alphas, sweeps)
    j = folded.join(models.select(*by, fold, "beta", "converged"), [*by, fold])
    return j.withColumn("pred", F.col("beta")[0] + add_all([F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)])).drop("beta")


def _tree_oof(folded: DataFrame, y: str, xs: list[str], model: str, k: int, repeats: int, trees: int,
              kbest_k: int | None, seed: int) -> DataFrame:
    """Spark ML ensembles, one distributed fit per (repeat, fold)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    outs = []
    for rep, f in product(range(repeats), range(k)):
        train = folded.where((F.col("rep") == rep) & (F.col("fold") != f))
        test = folded.where((F.col("rep") == rep) & (F.col("fold") == f))
        stages = [VectorAssembler(inputCols=xs, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__z", withMean=True)]
        source = "__z"
        if kbest_k and len(xs) > kbest_k:
            sel = UnivariateFeatureSelector(featuresCol="__z", labelCol=y, outputCol="__k", selectionMode="numTopFeatures")
            stages.append(sel.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(kbest_k))
            source = "__k"
        if model == "random_forest":
            est = RandomForestRegressor(featuresCol=source, labelCol=y, predictionCol="pred", numTrees=trees, maxDepth=3,
                                        minInstancesPerNode=3, seed=seed)
        else:
            est = GBTRegressor(featuresCol=source, labelCol=y, predictionCol="pred", maxIter=trees, maxDepth=3,
                               stepSize=0.05, seed=seed)
        fitted = Pipeline(stages=[*stages, est]).fit(train)
        outs.append(fitted.transform(test).select("rep", "fold", y, "pred"))
    return reduce(DataFrame.unionByName, outs)


def ml_grid(df: DataFrame, targets: list[str], schemes: dict[str, list[str]], covariates: list[str], row_id: str,
            models: list[str] = ("elastic_net", "random_forest", "gradient_boosting"), k: int = 5, repeats: int = 3,
            trees: int = 300, kbest_k: int = 10, seed: int = 42) -> DataFrame:
    """Out-of-fold R2 and MAE per target x scheme x model. The grid is configuration; data stay in Spark."""
    rows = []
    for target, (scheme, cols) in product(targets, schemes.items()):
        xs = list(dict.fromkeys([*covariates, *[c for c in cols if c in df.columns]]))
        d = df.select(row_id, target, *xs).na.drop()
        folded = cut(repeated_folds(d, row_id, k, repeats, seed))
        for m in models:
            pick = kbest_k if scheme in ("data_driven", "hybrid") and m != "elastic_net" else None
            if m == "elastic_net":
                pred = elastic_net_oof(folded, target, xs, row_id)
            else:
                pred = _tree_oof(folded, target, xs, m, k, repeats, trees, pick, seed)
            s = oof_scores(pred.withColumn("__f", F.col("rep") * k + F.col("fold")), target, "pred", "__f")
            rows.append(s.select(F.lit(target).alias("target"), F.lit(scheme).alias("scheme"), F.lit(m).alias("model"),
                                 F.lit(len(xs)).cast("bigint").alias("n_features"), F.lit(bool(pick)).alias("use_kbest"),
                                 "oof_r2", "oof_mae", "baseline_mae"))
    return reduce(DataFrame.unionByName, rows)


def grid_permutation(df: DataFrame, target: str, schemes: dict[str, list[str]], covariates: list[str], row_id: str,
                     reps: int = 100, k: int = 5, seed: int = 42) -> DataFrame:
    """Permutation p of the elastic-net grid, per scheme and against the best scheme per replicate.

    Replicate 0 is the observed order; replicates share one permutation across schemes. X'X is
    computed once a scheme; a replicate adds its X'y.
    """
    cols = list(dict.fromkeys([*covariates, *[c for s in schemes.values() for c in s]]))
    d = cut(df.select(row_id, target, *cols).na.drop())
    perm = permuted_target(d.select(row_id, target), target, row_id, reps, seed).select("rep", row_id, "y_perm")
    targets = cut(perm.unionByName(d.select(F.lit(0).cast("bigint").alias("rep"), row_id, F.col(target).alias("y_perm"))))
    rows = cut(assign_folds(d.select(row_id, *cols), row_id, k, 1, seed))
    scored = []
    for name, members in schemes.items():
        xs = list(dict.fromkeys([*covariates, *members]))
        nets = permuted_nets(rows.select(row_id, "fold", *xs), targets, xs, row_id, reps, k).select("rep", "fold", "beta")
        j = targets.join(rows, row_id).join(nets, ["rep", "fold"])
        p = j.withColumn("pred", F.col("beta")[0] + add_all([F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)]))
        scored.append(oof_scores(p, "y_perm", "pred", "fold", ["rep"]).select("rep", F.lit(name).alias("scheme"), "oof_r2"))
    s = reduce(DataFrame.unionByName, scored)
    best = F.max("oof_r2").over(W.partitionBy("rep"))
    s = s.withColumn("best", best)
    obs = F.max(F.when(F.col("rep") == 0, F.col("oof_r2"))).over(W.partitionBy("scheme"))
    n = s.withColumn("obs", obs).where("rep > 0")
    return n.groupBy("scheme").agg(F.max("obs").alias("oof_r2"), F.avg((F.col("oof_r2") >= F.col("obs")).cast("double")).alias("perm_p"),
                                   F.avg((F.col("best") >= F.col("obs")).cast("double")).alias("perm_p_selection_corrected"),
                                   F.count(F.lit(1)).alias("n_perm"))
