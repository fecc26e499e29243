"""Psychometric reliability: internal consistency, split halves, diffusion parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalops.functions.hashing import draw
from signalops.functions.nulls import add_all, corr_agg, spearman_brown
from signalops.functions.ordering import hash_row_number

# Thresholds and the metric list of the split-half table.
ALPHA_MIN, ALPHA_PREFERRED = 0.50, 0.70
SPLIT_METRICS = ["acc_overall", "acc_congruent", "acc_incongruent", "rt_mean", "rt_congruent", "rt_incongruent",
                 "rt_cv", "flanker_effect", "ddm_v", "ddm_a", "ddm_t",
                 "ddm_v_congruent", "ddm_v_incongruent", "ddm_delta_v"]


# ---------------------------------------------------------------- internal consistency

def _alpha(k: int, n: Column, item_var: Column, total_var: Column) -> Column:
    if k < 2:
        return F.lit(None).cast("double")
    ok = (n >= 3) & (total_var > 0)
    return F.when(ok, (k / (k - 1.0)) * (1 - item_var / F.when(ok, total_var)))


def cronbach_alpha(wide: DataFrame, items: list[str], by: list[str] = ()) -> DataFrame:
    """Listwise alpha from one aggregate of variances: (by..., k_items, n_obs, alpha)."""
    k = len(items)
    g = wide.na.drop(subset=items).withColumn("__t", add_all([F.col(i).cast("double") for i in items]))
    m = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_obs"), F.var_samp("__t").alias("__tv"),
                           add_all([F.var_samp(i) for i in items]).alias("__iv"))
    return m.select(*by, F.lit(k).cast("bigint").alias("k_items"), "n_obs",
                    _alpha(k, F.col("n_obs"), F.col("__iv"), F.col("__tv")).alias("alpha"))


def alpha_band(alpha: Column, k: Column, minimum: float = ALPHA_MIN, preferred: float = ALPHA_PREFERRED) -> Column:
    return (F.when(k < 2, "insufficient items").when(alpha.isNull(), "undefined")
            .when(alpha >= preferred, "good").when(alpha >= minimum, "marginal").otherwise("inadequate"))


def subscale_reliability(wide: DataFrame, subscales: dict[str, list[str]]) -> DataFrame:
    """Alpha and its band for every subscale in one aggregate (listwise within the subscale)."""
    aggs, rows = [F.count(F.lit(1)).alias("__all")], []
    for j, (name, items) in enumerate(subscales.items()):
        present = [i for i in items if i in wide.columns]
        k = len(present)
        n, alpha = F.lit(0).cast("bigint"), F.lit(None).cast("double")
        if k >= 2:
            full = F.lit(True)
            for i in present:
                full = full & F.col(i).isNotNull()
            total = F.when(full, add_all([F.col(i).cast("double") for i in present]))
            aggs += [F.count_if(full).alias(f"n{j}"), F.var_samp(total).alias(f"t{j}"),
                     add_all([F.var_samp(F.when(full, F.col(i))) for i in present]).alias(f"i{j}")]
            n, alpha = F.col(f"n{j}"), _alpha(k, F.col(f"n{j}"), F.col(f"i{j}"), F.col(f"t{j}"))
        rows.append(F.struct(F.lit(name).alias("subscale"), F.lit(k).cast("bigint").alias("k_items"),
                             n.alias("n_obs"), alpha.alias("alpha"),
                             alpha_band(alpha, F.lit(k)).alias("interpretation")))
    return wide.agg(*aggs).select(F.inline(F.array(*rows)))


def item_total(wide: DataFrame, items: list[str]) -> DataFrame:
    """Per item: correlation with the rest, alpha without it, alpha of all: one aggregate."""
    k = len(items)
    t = F.col("__t")
    g = wide.na.drop(subset=items).withColumn("__t", add_all([F.col(i).cast("double") for i in items]))
    aggs = [F.count(F.lit(1)).alias("n"), F.var_samp("__t").alias("tv")]
    for i, c in enumerate(items):
        rest = t - F.col(c)
        aggs += [F.var_samp(c).alias(f"v{i}"), F.var_samp(rest).alias(f"r{i}"), corr_agg(F.col(c), rest).alias(f"c{i}")]
    m = g.agg(*aggs)
    total = add_all([F.col(f"v{i}") for i in range(k)])
    base = _alpha(k, F.col("n"), total, F.col("tv"))
    rows = [F.struct(F.lit(c).alias("item"), F.col(f"c{i}").alias("corrected_item_total_r"),
                     _alpha(k - 1, F.col("n"), total - F.col(f"v{i}"), F.col(f"r{i}")).alias("alpha_if_deleted"),
                     base.alias("alpha_baseline")) for i, c in enumerate(items)]
    return m.select(F.inline(F.array(*rows)))


def correlation_matrix(wide: DataFrame, items: list[str], by: list[str] = ()) -> DataFrame:
    """Listwise correlation matrix as one flat array per group."""
    g = wide.na.drop(subset=items)
    k = len(items)
    aggs = [F.count(F.lit(1)).alias("n_obs")]
    aggs += [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(items)]
    aggs += [F.covar_samp(items[i], items[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    m = g.groupBy(*by).agg(*aggs)

    def r(i: int, j: int) -> Column:
        if i == j:
            return F.lit(1.0)
        a, b = min(i, j), max(i, j)
        return F.col(f"v{a}_{b}") / F.nullif(F.col(f"s{i}") * F.col(f"s{j}"), F.lit(0.0))

    return m.select(*by, "n_obs", F.array(*[r(i, j) for i in range(k) for j in range(k)]).alias("r"))


@F.pandas_udf(T.DoubleType())
def omega_from_correlations(r: pd.Series) -> pd.Series:
    """One-factor omega of a k x k matrix by iterated principal axes (the minres fixed point)."""
    def one(flat):
        a = np.asarray(flat, dtype="float64")
        k = int(round(len(a) ** 0.5))
        if not np.isfinite(a).all():
            return None
        a = a.reshape(k, k)
        h = np.abs(a - np.eye(k)).max(axis=1)
        load = None
        for _ in range(2000):
            b = a.copy()
            np.fill_diagonal(b, h)
            w, v = np.linalg.eigh(b)
            load = v[:, -1] * np.sqrt(max(w[-1], 0.0))
            new = np.clip(load ** 2, 0.0, 0.995)
            if np.abs(new - h).max() < 1e-12:
                break
            h = new
        num = load.sum() ** 2
        den = num + (1 - load ** 2).sum()
        return float(num / den) if den > 0 else None
    return r.map(one).astype("float64")


def mcdonald_omega(wide: DataFrame, items: list[str], by: list[str] = ()) -> DataFrame:
    """Omega where at least five complete rows and three items exist, else NULL."""
    m = correlation_matrix(wide, items, by)
    enough = (F.col("n_obs") >= 5) & F.lit(len(items) >= 3)
    return m.select(*by, F.lit(len(items)).cast("bigint").alias("k_items"), "n_obs",
                    F.when(enough, omega_from_correlations("r")).alias("omega"))


# ---------------------------------------------------------------- diffusion model

def ez_diffusion(df: DataFrame, sets: list[tuple[str, str, str, tuple[str, str, str]]], s: float = 0.1) -> DataFrame:
    """Adds (drift, boundary, non-decision time) in closed form; NULL where undefined.

    ``sets`` lists (mean rt, variance of rt, accuracy, output names); all sets are computed
    together in a few projection steps, so the expressions stay small.
    """
    n = range(len(sets))
    valid = lambda m, v, p: (F.col(p) > 0) & (F.col(p) < 1) & (F.col(v) > 0) & (F.col(m) > 0)
    d = df.withColumns({f"__p{i}": F.when(valid(*sets[i][:3]), F.least(F.greatest(F.col(sets[i][2]), F.lit(0.01)), F.lit(0.99))) for i in n})
    d = d.withColumns({f"__l{i}": F.ln(F.col(f"__p{i}") / (1 - F.col(f"__p{i}"))) for i in n})
    p, lg = (lambda i: F.col(f"__p{i}")), (lambda i: F.col(f"__l{i}"))
    d = d.withColumns({f"__x{i}": lg(i) * (lg(i) * p(i) * p(i) - lg(i) * p(i) + p(i) - 0.5) / F.nullif(sets[i][1], F.lit(0.0)) for i in n})
    d = d.withColumns({sets[i][3][0]: F.when(F.col(f"__x{i}") > 0, F.nullif(
        F.signum(p(i) - 0.5) * s * F.pow(f"__x{i}", F.lit(0.25)), F.lit(0.0))) for i in n})
    d = d.withColumns({sets[i][3][1]: s * s * lg(i) / F.col(sets[i][3][0]) for i in n})
    d = d.withColumns({f"__e{i}": F.exp(-F.col(sets[i][3][0]) * F.col(sets[i][3][1]) / (s * s)) for i in n})
    d = d.withColumns({sets[i][3][2]: F.col(sets[i][0]) - F.col(sets[i][3][1]) / (2 * F.col(sets[i][3][0]))
                       * (1 - F.col(f"__e{i}")) / (1 + F.col(f"__e{i}")) for i in n})
    return d.drop(*[f"__{k}{i}" for k in "plxe" for i in n])


# ---------------------------------------------------------------- trial metrics

def valid_trials(trials: DataFrame) -> DataFrame:
    """Complete, non-outlier trials. Reaction times of wrong answers stay in, by design."""
    t = trials.na.drop(subset=["acc", "rt"])
    return t.where(~F.coalesce(F.col("outlier"), F.lit(False))) if "outlier" in t.columns else t


def trial_metrics(trials: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, reaction time, congruency effect and diffusion parameters: one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_trials"), F.avg("acc").alias("acc_overall"), F.avg("rt").alias("rt_mean"),
            F.var_samp("rt").alias("__var"), F.stddev_samp("rt").alias("__sd")]
    for c in ("congruent", "incongruent"):
        here = F.lower("condition") == c
        aggs += [F.avg(F.when(here, F.col("acc"))).alias(f"acc_{c}"), F.avg(F.when(here, F.col("rt"))).alias(f"rt_{c}"),
                 F.var_samp(F.when(here, F.col("rt"))).alias(f"__var_{c}")]
    m = valid_trials(trials).groupBy(*by).agg(*aggs)
    m = (m.withColumn("rt_cv", F.when(F.col("rt_mean") > 0, F.col("__sd") / F.nullif("rt_mean", F.lit(0.0))))
         .withColumn("flanker_effect", F.col("rt_incongruent") - F.col("rt_congruent")))
    m = ez_diffusion(m, [("rt_mean", "__var", "acc_overall", ("ddm_v", "ddm_a", "ddm_t"))] + [
        (f"rt_{c}", f"__var_{c}", f"acc_{c}", (f"ddm_v_{c}", f"ddm_a_{c}", f"ddm_t0_{c}")) for c in ("congruent", "incongruent")])
    m = m.withColumn("ddm_delta_v", F.col("ddm_v_congruent") - F.col("ddm_v_incongruent"))
    return m.drop("__var", "__sd", "__var_congruent", "__var_incongruent")


def split_halves(trials: DataFrame, mode: str = "odd_even", min_per_half: int = 15, seed: int = 42,
                 key: str = "id") -> DataFrame:
    """Adds ``half`` (1 = even trial numbers); people short of trials in a half are dropped.

    Random mode cuts each person's hash order in the middle and drops an odd remainder. The
    sizes come from a count per person, so no person's trials are gathered in one place.
    """
    if mode == "odd_even":
        tagged = trials.withColumn("half", F.when(F.col("trial") % 2 == 0, 1).otherwise(2).cast("bigint"))
        sizes = tagged.groupBy(key).agg(F.count_if(F.col("half") == 1).alias("__h1"), F.count_if(F.col("half") == 2).alias("__h2"))
        out = tagged.join(sizes, key).where((F.col("__h1") >= min_per_half) & (F.col("__h2") >= min_per_half))
        return out.drop("__h1", "__h2")
    hashed = trials.withColumn("__h", draw("trial", F.pmod(F.col(key).cast("bigint"), F.lit(1000003)), seed))
    ranked = hash_row_number(hashed, [key], "__h", "trial", name="__rn")
    mid = trials.groupBy(key).agg(F.floor(F.count(F.lit(1)) / 2).alias("__mid"))
    return (ranked.join(mid, key).where((F.col("__mid") >= min_per_half) & (F.col("__rn") <= 2 * F.col("__mid")))
            .withColumn("half", F.when(F.col("__rn") <= F.col("__mid"), 1).otherwise(2).cast("bigint"))
            .drop("__h", "__rn", "__mid"))


def split_half_reliability(halves: DataFrame, metrics: list[str] = SPLIT_METRICS, key: str = "id") -> DataFrame:
    """Half-to-half r and Spearman-Brown per metric over people with both halves defined."""
    m = trial_metrics(halves, [key, "half"])
    side = m.groupBy(key).agg(*[F.max(F.when(F.col("half") == h, F.col(c))).alias(f"{c}_{h}")
                                for c in metrics for h in (1, 2)])
    aggs = []
    for c in metrics:
        a, b = F.col(f"{c}_1"), F.col(f"{c}_2")
        aggs += [F.count_if(a.isNotNull() & b.isNotNull()).alias(f"n_{c}"), corr_agg(a, b).alias(f"r_{c}")]
    one = side.agg(*aggs)
    rows = []
    for c in metrics:
        enough = F.col(f"n_{c}") >= 4
        r = F.when(enough, F.col(f"r_{c}"))
        rows.append(F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n"), r.alias("r_halves"),
                             spearman_brown(r).alias("spearman_brown"),
                             F.when(enough, "").otherwise("n<4 after dropping undefined halves").alias("note")))
    return one.select(F.inline(F.array(*rows)))


def parallel_forms(df: DataFrame, form_a: str, form_b: str, measure: str) -> DataFrame:
    """Two forms as approximate halves: r and Spearman-Brown, from four pairs up."""
    a, b = F.col(form_a).cast("double"), F.col(form_b).cast("double")
    m = df.na.drop(subset=[form_a, form_b]).agg(F.count(F.lit(1)).alias("n"), corr_agg(a, b).alias("r"))
    r = F.when(F.col("n") >= 4, F.col("r"))
    return m.select(F.lit(measure).alias("measure"), "n", r.alias("r_halves"), spearman_brown(r).alias("spearman_brown"))


def pass_summary(qc: DataFrame, conditions: list[str]) -> DataFrame:
    """Records, counts by status, subjects with one OK and with two OK listed conditions.

    (The two-condition count looks only at the listed conditions.)
    """
    ok = F.col("status") == "OK"
    listed = ok & F.col("condition").isin(conditions)
    per = qc.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"),
                                    F.count_if(F.col("status") == "LOW_EPOCH_COUNT").alias("low"),
                                    F.countDistinct(F.when(listed, F.col("condition"))).alias("conds"))
    return per.agg(F.sum("n").alias("n_records"), F.sum("ok").alias("n_ok"), F.sum("low").alias("n_low"),
                   (F.sum("n") - F.sum("ok") - F.sum("low")).alias("n_other"),
                   F.count_if(F.col("ok") > 0).alias("n_subjects_one_ok"),
                   F.count_if(F.col("conds") >= 2).alias("n_subjects_both"))
