"""Least squares from sufficient statistics.

Every model is fitted from one aggregate (counts, means, covariances), which combines on the
map side; only a p x p system per group is solved, in a NumPy function over result-sized rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.dist import f_pvalue, t_critical, t_pvalue
from signalops.functions.hashing import draw, unit
from signalops.functions.lineage import cut
from signalops.functions.nulls import add_all, corr_agg
from signalops.functions.ordering import average_rank_pct, hash_row_number
from signalops.operators.reliability import subscale_reliability

FIT_TYPE = ("struct<beta array<double>, se array<double>, inv array<double>, r2 double, r2_cov double, "
            "df_resid double, sigma2 double>")


def moments(df: DataFrame, y: str, xs: list[str], by: list[str] = ()) -> DataFrame:
    """n, means and population covariances of (xs..., y) per group, as arrays."""
    cols = [*xs, y]
    k = len(cols)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i in range(k) for j in range(i, k)]).alias("cov"))


def weighted_moments(df: DataFrame, y: str, xs: list[str], weight: str, by: list[str]) -> DataFrame:
    """The same with integer row weights (bootstrap counts); columns should be centred."""
    cols = [F.col(c) for c in [*xs, y]]
    k, w = len(cols), F.col(weight)
    s = df.groupBy(*by).agg(F.sum(w).alias("n"), *[F.sum(w * c).alias(f"s{i}") for i, c in enumerate(cols)],
                            *[F.sum(w * cols[i] * cols[j]).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(k)]
    return s.select(*by, "n", F.array(*mean).alias("means"),
                    F.array(*[F.col(f"q{i}_{j}") / F.col("n") - mean[i] * mean[j]
                              for i in range(k) for j in range(i, k)]).alias("cov"))


def fit_udf(p: int, q: int = 0):
    """Solve the intercept model on p predictors; the first q of them form the restricted model.

    All NULL when no residual degrees of freedom are left or the target is constant.
    """
    iu = np.triu_indices(p + 1)

    def one(n, means, cov):
        if n is None or means is None or any(c is None or not np.isfinite(c) for c in cov):
            return (None,) * 7
        s = np.zeros((p + 1, p + 1))
        s[iu] = cov
        s = s + np.triu(s, 1).T
        m = np.asarray(means, dtype="float64")
        inv = np.linalg.pinv(s[:p, :p], hermitian=True)
        b = inv @ s[:p, p]
        tss = s[p, p]
        df = n - p - 1
        if tss <= 0 or df <= 0:
            return (None,) * 7
        r2 = float(b @ s[:p, p] / tss)
        r2c = float(s[:q, p] @ np.linalg.pinv(s[:q, :q], hermitian=True) @ s[:q, p] / tss) if q else 0.0
        sigma2 = n * tss * (1 - r2) / df
        inv = inv / n
        icept = m[p] - b @ m[:p]
        se = np.sqrt(np.maximum(sigma2 * np.concatenate([[1.0 / n + m[:p] @ inv @ m[:p]], np.diag(inv)]), 0))
        return (np.concatenate([[icept], b]).tolist(), se.tolist(), inv.ravel().tolist(), r2, r2c, float(df), float(sigma2))

    @F.pandas_udf(FIT_TYPE)
    def fit(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        rows = [one(a, b, c) for a, b, c in zip(n, means, cov)]
        return pd.DataFrame(rows, columns=["beta", "se", "inv", "r2", "r2_cov", "df_resid", "sigma2"])

    return fit


def fit_ols(df: DataFrame, y: str, xs: list[str], by: list[str] = (), q: int = 0) -> DataFrame:
    """One row per group: n, means and the ``fit`` struct. Incomplete rows are dropped."""
    m = moments(df.na.drop(subset=[*xs, y]), y, xs, by)
    return m.withColumn("fit", fit_udf(len(xs), q)("n", "means", "cov")).drop("cov")


def coefficients(fitted: DataFrame, xs: list[str], by: list[str] = ()) -> DataFrame:
    """Long (by..., term, beta, se, t, df_resid, r2, n)."""
    rows = F.array(*[F.struct(F.lit(x).alias("term"), F.col("fit.beta")[i].alias("beta"), F.col("fit.se")[i].alias("se"))
                     for i, x in enumerate(["const", *xs])])
    out = fitted.select(*by, "n", F.col("fit.r2").alias("r2"), F.col("fit.r2_cov").alias("r2_cov"),
                        F.col("fit.df_resid").alias("df_resid"), F.inline(rows))
    return out.withColumn("t", F.col("beta") / F.nullif("se", F.lit(0.0)))


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] = ()) -> DataFrame:
    """Coefficient table with two-sided p."""
    return coefficients(fit_ols(df, y, xs, by), xs, by).withColumn("p_two_sided", t_pvalue("t", "df_resid"))


# ---------------------------------------------------------------- tests

def complete_case_report(df: DataFrame, y: str, covariates: list[str], features: list[str]) -> DataFrame:
    """Rows used and dropped, and whether they reach predictors + 3."""
    need = len(covariates) + len(features) + 3
    full = F.lit(True)
    for c in dict.fromkeys([*covariates, *features, y]):
        full = full & F.col(c).isNotNull()
    m = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(full).alias("n_used"))
    return m.select("n_total", "n_used", (F.col("n_total") - F.col("n_used")).alias("n_dropped"),
                    F.lit(need).cast("bigint").alias("n_needed"),
                    F.when(F.col("n_used") < need, "insufficient_complete_rows").alias("skipped"))


def complete_cases(df: DataFrame, y: str, covariates: list[str], features: list[str]) -> DataFrame:
    return df.na.drop(subset=list(dict.fromkeys([*covariates, *features, y])))


def block_f(df: DataFrame, y: str, covariates: list[str], features: list[str], by: list[str] = ()) -> DataFrame:
    """Gain of the feature block over the covariates: both models from one aggregate."""
    q, k = len(covariates), len(features)
    f = fit_ols(df, y, [*covariates, *features], by, q)
    r2f, r2r, den = F.col("fit.r2"), F.col("fit.r2_cov"), F.col("fit.df_resid")
    stat = F.when(r2f < 1, ((r2f - r2r) / k) / ((1 - r2f) / den))
    out = f.select(*by, "n", r2r.alias("covariate_r2"), r2f.alias("full_r2"), (r2f - r2r).alias("delta_r2"),
                   stat.alias("f_stat"), F.lit(float(k)).alias("df_num"), den.alias("df_den"))
    return out.withColumn("p_value", f_pvalue("f_stat", "df_num", "df_den"))


def directional_p(beta: Column, p_two: Column, direction: Column) -> tuple[Column, Column, Column]:
    """(direction used, one-sided p, sign match); without a prior the two-sided p stands."""
    prior = direction.isin("positive", "negative") & beta.isNotNull() & p_two.isNotNull()
    match = ((direction == "positive") & (beta > 0)) | ((direction == "negative") & (beta < 0))
    p1 = F.when(prior, F.when(match, p_two / 2).otherwise(1 - p_two / 2)).otherwise(p_two)
    return (F.when(prior, direction).otherwise("two_sided"), p1, F.when(prior, match))


def adjust_p(df: DataFrame, p: str, by: list[str] = (), method: str = "bonferroni", name: str = "p_corrected",
             family_order: str = "term") -> DataFrame:
    """Corrected p within each family of tests (families are as small as a feature list)."""
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    if method == "bonferroni":  # by the number of tests in the family, also those without a p
        return df.withColumn(name, F.least(F.col(p) * F.count(F.lit(1)).over(whole), F.lit(1.0)))
    n = F.count(p).over(whole)
    if method not in ("fdr_bh", "bh"):
        return df.withColumn(name, F.col(p))
    rank = F.row_number().over(whole.orderBy(F.col(p).asc_nulls_last(), family_order))
    t = df.withColumn("__i", rank).withColumn("__q", F.col(p) * n / F.col("__i"))
    down = whole.orderBy(F.col("__i").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("__q").over(down), F.lit(1.0)))).drop("__i", "__q")


def reliability_gate(df: DataFrame, composites: list[str], components: dict[str, list[str]],
                     minimum: float = 0.50) -> DataFrame:
    """Alpha of each composite's components and a tri-state pass, in one scan; all_pass ignores ungated ones."""
    table = subscale_reliability(df, {c: components.get(c) or [] for c in composites})
    gated = F.col("subscale").isin([c for c in composites if components.get(c)])
    passed = F.when(gated, F.coalesce(F.col("alpha") >= minimum, F.lit(False)))
    out = table.select(F.col("subscale").alias("composite"), F.when(gated, F.col("k_items")).alias("k_items"),
                       F.when(gated, F.col("n_obs")).alias("n_obs"), "alpha", passed.alias("pass_gate"))
    every = W.partitionBy(F.lit(1))
    return out.withColumn("all_pass", F.coalesce(F.min("pass_gate").over(every), F.lit(False)))


# ---------------------------------------------------------------- bootstrap

def index_rows(df: DataFrame, row_id: str, seed: int = 42, name: str = "idx") -> DataFrame:
    """Contiguous 1..n index in hash order, without sorting in one task."""
    return hash_row_number(df.withColumn("__h", draw(row_id, 0, seed)), [], "__h", row_id, name=name).drop("__h")


def bootstrap_counts(indexed: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, idx, w): how often each row is drawn when n rows are drawn with replacement."""
    n = indexed.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = indexed.select("idx", n.alias("n"), F.explode(F.sequence(F.lit(1), F.lit(reps)).cast("array<bigint>")).alias("rep"))
    return (d.select("rep", (draw("idx", F.col("rep"), seed) % F.col("n") + 1).alias("idx"))
            .groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("w")))


# Cumulative probabilities of a Poisson(1) count, 0 to 12.
POISSON_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
               0.9994058151824183, 0.9999167588507119, 0.9999898050903252, 0.9999988747974149, 0.9999998885745217,
               0.9999999899522336, 0.9999999991683892, 0.9999999999363615]


def poisson_counts(df: DataFrame, row_id: str, reps: int, seed: int) -> DataFrame:
    """Bootstrap weights decided row by row: no index, no join, no shuffle of draws."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)).cast("array<bigint>")))
    u = unit(row_id, F.col("rep"), seed)
    cdf = F.array(*[F.lit(c) for c in POISSON_CDF])
    return d.withColumn("__u", u).withColumn("w", F.size(F.filter(cdf, lambda c: c <= F.col("__u"))).cast("bigint")).where("w > 0").drop("__u")


def bootstrap_ols(df: DataFrame, y: str, xs: list[str], row_id: str, reps: int = 5000, seed: int = 42,
                  method: str = "multinomial") -> DataFrame:
    """Median and 95 % interval of every coefficient over subject resamples.

    Draws are counted per (replicate, row), joined once and reduced to one moment row per
    replicate with map-side sums; no replicate is ever gathered as rows. ``method="poisson"``
    draws independent Poisson(1) weights instead, for tables too long to exchange n x reps draws.
    The input is read more than once: pass a stored table.
    """
    d = df.select(row_id, *xs, y).na.drop()
    stats = d.agg(F.struct(*[F.avg(c).alias(c) for c in [*xs, y]])).scalar()
    d = d.withColumn("__m", stats).select(row_id, *[(F.col(c) - F.col(f"__m.{c}")).alias(c) for c in [*xs, y]],
                                          *[F.col(f"__m.{c}").alias(f"__m_{c}") for c in [*xs, y]])
    if method == "poisson":
        w = poisson_counts(d, row_id, reps, seed)
    else:
        idx = index_rows(d, row_id, seed)
        w = bootstrap_counts(idx.select("idx"), reps, seed).join(idx, "idx")
    back = [f"__m_{c}" for c in [*xs, y]]
    m = weighted_moments(w, y, xs, "w", ["rep", *back]).withColumn("fit", fit_udf(len(xs))("n", "means", "cov"))
    shift = F.col(f"__m_{y}") - add_all([F.col("fit.beta")[i + 1] * F.col(f"__m_{x}") for i, x in enumerate(xs)])
    rows = F.array(F.struct(F.lit("const").alias("predictor"), (F.col("fit.beta")[0] + shift).alias("b")),
                   *[F.struct(F.lit(x).alias("predictor"), F.col("fit.beta")[i + 1].alias("b")) for i, x in enumerate(xs)])
    return (m.select("rep", F.inline(rows)).groupBy("predictor")
            .agg(F.percentile("b", 0.5).alias("median"), F.percentile("b", 0.025).alias("ci_lo"),
                 F.percentile("b", 0.975).alias("ci_hi"), F.count("b").alias("n_iter")))


def bootstrap_mean_ci(df: DataFrame, y: str, row_id: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap interval of a mean, with the same draws."""
    idx = index_rows(df.select(row_id, y).na.drop(), row_id, seed)
    w = bootstrap_counts(idx.select("idx"), reps, seed).join(idx, "idx")
    return (w.groupBy("rep").agg((F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("m"))
            .agg(F.percentile("m", 0.5).alias("median"), F.percentile("m", 0.025).alias("ci_lo"),
                 F.percentile("m", 0.975).alias("ci_hi"), F.count("m").alias("n_iter")))


# ---------------------------------------------------------------- composite tests

def hypothesis_test(df: DataFrame, y: str, covariates: list[str], features: list[str], directions: dict[str, str],
                    row_id: str, correction: str = "bonferroni", alpha_level: float = 0.05, reps: int = 0,
                    seed: int = 42) -> DataFrame:
    """One (target, feature set): coefficient rows with block F, priors, correction, bootstrap.

    No rows unless complete cases reach covariates + features + 3.
    """
    xs = [*covariates, *features]
    whole = df.na.drop(subset=[y, *xs])
    df = df.where(whole.agg(F.count(F.lit(1)) >= len(xs) + 3).scalar())
    f = fit_ols(df, y, xs, (), len(covariates))
    co = coefficients(f, xs).where(F.col("term").isin(features)).withColumn("p_two_sided", t_pvalue("t", "df_resid"))
    prior = F.coalesce(*[F.when(F.col("term") == k, F.lit(v)) for k, v in directions.items()], F.lit("two_sided"))
    d, p1, ok = directional_p(F.col("beta"), F.col("p_two_sided"), prior)
    co = co.withColumn("direction", d).withColumn("p_one_sided", p1).withColumn("sign_matches", ok)
    co = adjust_p(co, "p_one_sided", (), correction).withColumn("significant", F.coalesce(F.col("p_corrected") < alpha_level, F.lit(False)))
    # The block test rides along on the coefficient rows, so the data are read once.
    k, gain = len(features), F.col("r2") - F.col("r2_cov")
    out = co.withColumns({"covariate_r2": F.col("r2_cov"), "delta_r2": gain, "df_num": F.lit(float(k)),
                          "block_f": (gain / k) / ((1 - F.col("r2")) / F.col("df_resid"))})
    out = out.withColumn("block_p", f_pvalue("block_f", "df_num", "df_resid"))
    if reps:
        boot = bootstrap_ols(df, y, xs, row_id, reps, seed).withColumnRenamed("predictor", "term")
        out = out.join(boot, "term", "left")
    return out


def masked_moments(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Moments keyed by which of ``columns`` a row has: one scan serves every model over any of them.

    Returns a stored table (mask: one 0/1 a column; n, and sums and products about the columns' means) and the place of each column. The
    table has as many rows as there are patterns of missing cells, not rows of data.
    """
    place = {c: str(i) for i, c in enumerate(columns)}
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    named = df.select(*[v.alias(f"v{place[c]}") for c, v in value.items()])
    mid = named.agg(F.struct(*[F.avg(f"v{i}").alias(f"v{i}") for i in place.values()])).scalar()
    d = named.withColumn("m", mid)
    k = range(len(columns))
    x = [F.col(f"v{i}") - F.col(f"m.v{i}") for i in k]
    mask = F.concat(*[F.col(f"v{i}").isNotNull().cast("int").cast("string") for i in k])
    return cut(d.groupBy(mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in k], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in k for j in range(i, len(columns))],
        *[F.max(f"m.v{i}").alias(f"m{i}") for i in k])), place


def _cell_moments(table: DataFrame, place: dict[str, str], names: list[str]) -> DataFrame:
    """One row: n, means and population covariances of ``names`` over the rows that have all of them; n_total counts all rows."""
    at = [int(place[c]) for c in names]
    whole = F.lit(True)
    for i in at:
        whole = whole & (F.substring("mask", i + 1, 1) == "1")
    of = lambda c: F.sum(F.when(whole, F.col(c)))
    n = F.coalesce(of("n"), F.lit(0))
    mean = [of(f"s{i}") / F.nullif(n, F.lit(0)) for i in at]
    pair = lambda i, j: f"q{min(i, j)}_{max(i, j)}"
    k = range(len(names))
    return table.agg(n.alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.array(*[F.max(f"m{i}") + m for i, m in zip(at, mean)]).alias("means"),
                     F.array(*[of(pair(at[i], at[j])) / F.nullif(n, F.lit(0)) - mean[i] * mean[j] for i in k for j in range(i, len(names))]).alias("cov"))


def run_tests(df: DataFrame, targets: list[str], sets: dict[str, list[str]], covariates: list[str],
              directions: dict[str, dict[str, str]], row_id: str, **kw) -> DataFrame:
    """Headline over the target x set grid (both are configuration) from one scan; infeasible cells are named."""
    have = {name: [c for c in feats if c in df.columns] for name, feats in sets.items()}
    table, place = masked_moments(df, list(dict.fromkeys([*targets, *covariates, *[c for f in have.values() for c in f]])))
    out, q = None, len(covariates)
    for t in targets:
        for name, feats in have.items():
            xs = [*covariates, *feats]
            m = _cell_moments(table, place, [*xs, t]).withColumn("fit", fit_udf(len(xs), q)("n", "means", "cov"))
            r2f, r2r, den = F.col("fit.r2"), F.col("fit.r2_cov"), F.col("fit.df_resid")
            skipped = F.when(F.col("n") < len(xs) + 3, "insufficient_complete_rows")
            cell = m.select(
                F.lit(t).alias("target"), F.lit(name).alias("feature_set"), F.col("n").alias("n_used"), (F.col("n_total") - F.col("n")).alias("n_dropped"),
                skipped.alias("skipped"), *[F.when(skipped.isNull(), v).alias(c) for c, v in (
                    ("full_r2", r2f), ("covariate_r2", r2r), ("delta_r2", r2f - r2r),
                    ("f_stat", F.when(r2f < 1, ((r2f - r2r) / F.nullif(F.lit(float(len(feats))), F.lit(0.0))) / ((1 - r2f) / den))))],
                F.lit(float(len(feats))).alias("__k"), den.alias("__den"))
            cell = cell.withColumn("p_value", f_pvalue("f_stat", "__k", "__den")).drop("__k", "__den")
            out = cell if out is None else out.unionByName(cell)
    return out


def hypothesis_grid(df: DataFrame, targets: list[str], sets: dict[str, list[str]], covariates: list[str], directions: dict[str, str], row_id: str,
                    components: dict[str, list[str]] | None = None, correction: str = "bonferroni", alpha_level: float = 0.05, reps: int = 0, seed: int = 42,
                    alpha_min: float = 0.50) -> DataFrame:
    """Coefficient rows of every (target, feature set) cell: block F, priors, correction, reliability gate and bootstrap interval.

    All least-squares cells come from one scan keyed by missingness; the gate is one more. Cells without enough complete rows have none. ``reps``: bootstrap
    replicates a cell, each a resample of the cell's complete rows, so ``df`` should be a stored table.
    """
    have = {name: [c for c in feats if c in df.columns] for name, feats in sets.items()}
    table, place = masked_moments(df, list(dict.fromkeys([*targets, *covariates, *[c for f in have.values() for c in f]])))
    prior = F.coalesce(*[F.when(F.col("term") == k, F.lit(v)) for k, v in directions.items()], F.lit("two_sided"))
    cells, boots, q = None, None, len(covariates)
    for t in targets:
        for name, feats in have.items():
            xs = [*covariates, *feats]
            m = _cell_moments(table, place, [*xs, t]).where(F.col("n") >= len(xs) + 3).withColumn("fit", fit_udf(len(xs), q)("n", "means", "cov"))
            one = coefficients(m, xs).where(F.col("term").isin(feats)).select(F.lit(t).alias("target"), F.lit(name).alias("feature_set"), "*",
                                                                               F.lit(float(len(feats))).alias("df_num"))
            cells = one if cells is None else cells.unionByName(one)
            if reps:
                boot = bootstrap_ols(df, t, xs, row_id, reps, seed).where(F.col("predictor").isin(feats)).select(
                    F.lit(t).alias("target"), F.lit(name).alias("feature_set"), F.col("predictor").alias("term"), "median", "ci_lo", "ci_hi", "n_iter")
                boots = boot if boots is None else boots.unionByName(boot)
    co = cells.withColumn("p_two_sided", t_pvalue("t", "df_resid"))
    d, p1, ok = directional_p(F.col("beta"), F.col("p_two_sided"), prior)
    co = co.withColumn("direction", d).withColumn("p_one_sided", p1).withColumn("sign_matches", ok)
    by = ["target", "feature_set"]
    co = adjust_p(co, "p_one_sided", by, correction).withColumn("significant", F.coalesce(F.col("p_corrected") < alpha_level, F.lit(False)))
    gain = F.col("r2") - F.col("r2_cov")
    co = co.withColumns({"covariate_r2": F.col("r2_cov"), "delta_r2": gain, "block_f": (gain / F.col("df_num")) / ((1 - F.col("r2")) / F.col("df_resid"))})
    co = co.withColumn("block_p", f_pvalue("block_f", "df_num", "df_resid"))
    if components is not None:
        every = list(dict.fromkeys(c for f in have.values() for c in f))
        gate = reliability_gate(df, every, components, alpha_min).select(F.col("composite").alias("term"), "alpha", "pass_gate")
        w = W.partitionBy(*by)
        co = co.join(gate, "term", "left").withColumn("all_pass", F.coalesce(F.min("pass_gate").over(w), F.lit(False)))
    return co.join(boots, [*by, "term"], "left") if boots is not None else co


def univariate_scan(df: DataFrame, y: str, covariates: list[str], features: list[str],
                    correction: str = "fdr_bh", alpha_level: float = 0.05,
                    directions: dict[str, str] | None = None) -> DataFrame:
    """y ~ covariates + one feature, each on its own complete rows: one aggregate keyed by feature."""
    cells = F.array(*[F.struct(F.lit(f).alias("term"), F.col(f).cast("double").alias("__x")) for f in features])
    long = df.select(*covariates, y, F.inline(cells))
    q = len(covariates)
    f = fit_ols(long, y, [*covariates, "__x"], ["term"], q)
    b, se, r2f, r2r = F.col("fit.beta")[q + 1], F.col("fit.se")[q + 1], F.col("fit.r2"), F.col("fit.r2_cov")
    df_r = F.col("fit.df_resid")
    enough = F.col("n") >= q + 4
    t = b / F.nullif(se, F.lit(0.0))
    out = f.select("term", F.col("n").alias("n_used"), *[F.when(enough, c).alias(n) for n, c in (
        ("beta", b), ("se", se), ("t", t), ("partial_r", F.signum(t) * F.sqrt(t * t / (t * t + df_r))),
        ("delta_r2", r2f - r2r), ("f_1df", (r2f - r2r) / ((1 - r2f) / df_r)), ("df_resid", df_r))],
        F.when(enough, "").otherwise("insufficient N").alias("note"))
    out = out.withColumn("p_two_sided", t_pvalue("t", "df_resid"))
    prior = F.coalesce(*[F.when(F.col("term") == k, F.lit(v)) for k, v in (directions or {}).items()], F.lit("two_sided"))
    d, p1, _ = directional_p(F.col("beta"), F.col("p_two_sided"), prior)
    out = out.withColumn("direction", d).withColumn("p_one_sided", p1)
    out = adjust_p(out, "p_two_sided", (), correction)
    return out.withColumn("significant", F.coalesce(F.col("p_corrected") < alpha_level, F.lit(False)))


# ---------------------------------------------------------------- leave-one-out

def loo_predict(df: DataFrame, y: str, xs: list[str], name: str = "loo", fitted: str = "fitted") -> DataFrame:
    """Adds the fitted value and the leave-one-out prediction y - e / (1 - h).

    One aggregate gives the inverse Gram; predictions are then row-local, with no refits.
    """
    p = len(xs)
    f = fit_ols(df, y, xs)
    s = f.agg(F.struct(F.max("n").alias("n"), F.max("means").alias("means"), F.max("fit.beta").alias("beta"),
                       F.max("fit.inv").alias("inv"))).scalar()
    d = df.na.drop(subset=[*xs, y]).withColumn("__s", s)
    dx = [F.col(x) - F.col("__s.means")[i] for i, x in enumerate(xs)]
    fit = F.col("__s.beta")[0] + add_all([F.col("__s.beta")[i + 1] * F.col(x) for i, x in enumerate(xs)])
    h = 1.0 / F.col("__s.n") + add_all([dx[i] * dx[j] * F.col("__s.inv")[i * p + j] for i in range(p) for j in range(p)])
    return d.withColumn(fitted, fit).withColumn(
        name, F.col(y) - (F.col(y) - fit) / F.nullif(1 - h, F.lit(0.0))).drop("__s")


def _loo_summary(d: DataFrame, y: str) -> Column:
    e, e0 = F.col(y) - F.col("loo"), F.col(y) - F.col("loo_cov")
    sst = F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    return d.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(e).alias("sigma"), F.var_samp("loo").alias("tau2"),
        (1 - F.sum(e * e) / sst).alias("r2"), (1 - F.sum(e0 * e0) / sst).alias("r2_cov"))).scalar()


def screening_index(df: DataFrame, y: str, covariates: list[str], features: list[str], row_id: str) -> DataFrame:
    """Shrunken leave-one-out score with interval, percentile and a sample-wide confidence flag.

    No rows for fewer than five complete cases.
    """
    d = cut(df.select(row_id, y, *covariates, *features).na.drop())
    d = d.where(d.agg(F.count(F.lit(1)) >= 5).scalar())
    d = loo_predict(d, y, [*covariates, *features], "loo", "__f")
    d = loo_predict(d, y, covariates, "loo_cov", "__f2").select(row_id, y, "loo", "loo_cov")
    s = d.withColumn("__s", _loo_summary(d, y))
    g = lambda c: F.col(f"__s.{c}")
    k = float(len(features))
    den = g("n") - len(covariates) - len(features) - 1
    s = s.withColumn("f_inc", F.when((g("r2") < 1) & (g("r2_cov") < 1) & (den > 0),
                                     ((g("r2") - g("r2_cov")) / k) / ((1 - g("r2")) / den)))
    v = g("tau2") + g("sigma") * g("sigma")
    s = s.withColumn("shrinkage", F.when(v > 0, g("tau2") / v).otherwise(1.0))
    s = s.withColumn("shrunk", F.col("shrinkage") * F.col("loo") + (1 - F.col("shrinkage")) * g("mean"))
    # One row of totals carries the two tail lookups; the rows only read them.
    s = cut(s.select(row_id, y, "loo", "shrunk", "shrinkage", "f_inc", den.cast("double").alias("den"),
                     g("n").alias("n"), g("sigma").alias("sigma"), g("r2").alias("loo_r2_full"), g("r2_cov").alias("loo_r2_cov")))
    tails = s.agg(F.max("f_inc").alias("f"), F.max("den").alias("den"), F.max("n").alias("n")).select(
        F.struct(f_pvalue(F.col("f"), F.lit(k), F.col("den")).alias("p"),
                 t_critical(F.lit(0.975), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")).alias("t")).alias("x")).scalar()
    ranks = average_rank_pct(s.select(F.lit("shrunk").alias("k"), F.col("shrunk").alias("v")), "k", "v").select(
        F.col("v").alias("shrunk"), (F.col("pct_rank") * 100).alias("percentile"))
    s = s.join(ranks, "shrunk").withColumn("__t", tails)
    half = F.col("__t.t") * F.col("sigma")
    return s.select(row_id, y, "loo", "shrunk", "percentile", (F.col("shrunk") - half).alias("pi_lo"),
                    (F.col("shrunk") + half).alias("pi_hi"), "shrinkage", "loo_r2_full", "loo_r2_cov", "f_inc",
                    F.col("__t.p").alias("p_inc"),
                    F.when(F.col("__t.p") < 0.05, "incremental_eeg_signal").otherwise("score_approximates_age_only_proxy").alias("confidence_flag"))


def fit_points(df: DataFrame, y: str, xs: list[str], row_id: str) -> DataFrame:
    """Observed and fitted values, z-scored on the observed scale, with both R2."""
    d = loo_predict(df.select(row_id, y, *xs), y, xs)
    e, l = F.col(y) - F.col("fitted"), F.col(y) - F.col("loo")
    sst = F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    s = d.agg(F.struct(F.avg(y).alias("m"), F.stddev_samp(y).alias("sd"), (1 - F.sum(e * e) / sst).alias("r2"),
                       (1 - F.sum(l * l) / sst).alias("loo_r2"))).scalar()
    z = lambda c: (F.col(c) - F.col("__s.m")) / F.nullif("__s.sd", F.lit(0.0))
    return d.withColumn("__s", s).where(F.col("__s.sd") > 0).select(
        row_id, z(y).alias("observed_z"), z("fitted").alias("fitted_z"), F.col("__s.r2").alias("r2"), F.col("__s.loo_r2").alias("loo_r2"))


def baseline_consistency(primary: DataFrame, sensitivity: DataFrame, strip: str, by: str = "target") -> DataFrame:
    """Agreement of two coefficient tables (by, term, beta, t) after stripping a name prefix.

    Ranks are average ranks of |t| within a target: groups are as small as a feature set.
    (Betas are compared unrounded.)
    """
    key = F.regexp_replace("term", strip, "")
    a = primary.select(by, key.alias("key"), F.col("beta").alias("b1"), F.abs("t").alias("t1"))
    b = sensitivity.select(by, key.alias("key"), F.col("beta").alias("b2"), F.abs("t").alias("t2"))
    j = a.join(b, [by, "key"])

    def avg_rank(c: str) -> Column:
        return F.rank().over(W.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(by, c)) - 1) / 2.0

    j = j.withColumn("r1", avg_rank("t1")).withColumn("r2", avg_rank("t2"))
    m = j.groupBy(by).agg(F.count(F.lit(1)).alias("n_features"), corr_agg("r1", "r2").alias("rho"),
                          F.avg((F.signum("b1") == F.signum("b2")).cast("double")).alias("sign_agreement"),
                          corr_agg("b1", "b2").alias("beta_r"))
    three = F.col("n_features") >= 3
    m = m.where(F.col("n_features") >= 2).withColumn("spearman_abs_t", F.when(three, F.col("rho"))).withColumn(
        "beta_pearson_r", F.when(three, F.col("beta_r")))
    dfr = (F.col("n_features") - 2).cast("double")
    t = F.when(F.abs("spearman_abs_t") < 1, F.col("spearman_abs_t") * F.sqrt(dfr / (1 - F.pow("spearman_abs_t", F.lit(2)))))
    ok = (F.col("spearman_abs_t") >= 0.5) & (F.col("sign_agreement") >= 0.75)
    return m.withColumn("spearman_p", t_pvalue(t, dfr)).withColumn("consistent", F.coalesce(ok, F.lit(False))).drop("rho", "beta_r")
