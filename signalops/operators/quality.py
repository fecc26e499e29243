"""Audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.functions.nulls import row_mean
from signalops.functions.ordering import exact_quantiles
from signalops.operators.resampling import long_features

# Audit thresholds.
CEILING_ACC, SUBCHANCE_ACC, RT_FLOOR_SEC, EFFECT_MIN_MS = 0.95, 0.50, 0.25, 30.0
PERFECT_ACC, ZERO_ACC, DIFFERENCE_SB_FLOOR, SD_SHARE_FLOOR = 0.9999, 1e-4, 0.30, 0.10
DIFFERENCE_SCORES = ["flanker_effect", "ddm_delta_v"]


def quality_rows(qc: DataFrame) -> DataFrame:
    """One row per recording with list sizes and joined labels."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return qc.select("subject", "condition", "status", "n_epochs_before_reject", "n_epochs_after_reject", "pct_epochs_dropped",
                     F.when(F.col("bad_channels").isNull(), 0).otherwise(size("bad_channels")).cast("bigint").alias("n_bad_channels"),
                     text("bad_channels").alias("bad_channels"),
                     F.when(F.col("ica_excluded_labels").isNull(), 0).otherwise(size("ica_excluded_labels")).cast("bigint").alias("n_ica_excluded"),
                     text("ica_excluded_labels").alias("ica_labels"))


def quality_summary(rows: DataFrame) -> DataFrame:
    """Per condition over OK rows, with low and error counts; conditions without OK rows are absent."""
    ok = F.col("status") == "OK"
    v = lambda c: F.when(ok, F.col(c))
    out = rows.groupBy("condition").agg(
        F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "LOW_EPOCH_COUNT").alias("n_low"),
        F.count_if(F.startswith("status", F.lit("ERROR"))).alias("n_errors"),
        F.avg(v("n_epochs_after_reject")).alias("epochs_kept_mean"), F.stddev_samp(v("n_epochs_after_reject")).alias("epochs_kept_sd"),
        F.min(v("n_epochs_after_reject")).alias("epochs_kept_min"), F.max(v("n_epochs_after_reject")).alias("epochs_kept_max"),
        F.avg(v("pct_epochs_dropped")).alias("pct_dropped_mean"), F.max(v("pct_epochs_dropped")).alias("pct_dropped_max"),
        F.avg(v("n_bad_channels")).alias("bad_ch_mean"), F.max(v("n_bad_channels")).alias("bad_ch_max"),
        F.avg(v("n_ica_excluded")).alias("ica_excl_mean"), F.max(v("n_ica_excluded")).alias("ica_excl_max"))
    return out.where(F.col("n_ok") > 0)


def scale_descriptives(wide: DataFrame, subscales: dict[str, list[str]], low: float = 1.0, high: float = 4.0,
                       sd_share: float = SD_SHARE_FLOOR) -> DataFrame:
    """Subscale scores: spread as share of the range, restriction flag, people at the ends."""
    have = {s: [i for i in its if i in wide.columns] for s, its in subscales.items()}
    have = {s: its for s, its in have.items() if its}
    scored = wide.select(*[row_mean(its).alias(s) for s, its in have.items()])
    long = cut(long_features(scored, list(have), []))
    span = high - low
    base = long.groupBy("feature").agg(
        F.count("value").alias("n_obs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count_if(F.col("value") >= high - 1e-9).alias("n_at_max"),
        F.count_if(F.col("value") <= low + 1e-9).alias("n_at_min"))
    med = exact_quantiles(long, "feature", "value", {"median": 0.5})
    k = F.coalesce(*[F.when(F.col("feature") == s, F.lit(len(its))) for s, its in have.items()]).cast("bigint")
    return base.join(med, "feature").select(
        F.col("feature").alias("subscale"), k.alias("k_items"), "n_obs", "mean", "sd", (100 * F.col("sd") / span).alias("sd_pct_of_range"),
        (F.col("sd") < sd_share * span).alias("variance_restricted"), "min", "max", "median", "n_at_max", "n_at_min")


def item_ceiling_floor(items: DataFrame, low: float = 1.0, high: float = 4.0, item: str = "item", score: str = "score") -> DataFrame:
    """Share of answers at either end per item, with the flag text."""
    at = items.groupBy(item).agg(
        F.count(score).alias("n_obs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.count_if(F.col(score) >= high - 1e-9).alias("top"), F.count_if(F.col(score) <= low + 1e-9).alias("bottom"))
    n = F.nullif(F.col("n_obs"), F.lit(0))
    flag = (F.when((F.col("n_obs") > 0) & (F.col("top") == F.col("n_obs")), "at-ceiling (zero variance)")
            .when(F.col("top") / n >= 0.8, "heavy ceiling >=80%").when(F.col("bottom") / n >= 0.8, "heavy floor >=80%").otherwise(""))
    return at.select(item, "n_obs", "mean", "sd", "min", "max", (100 * F.col("top") / n).alias("pct_at_ceiling"),
                     (100 * F.col("bottom") / n).alias("pct_at_floor"), flag.alias("flag"))


def describe_long(df: DataFrame, measures: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles and max per measure; quartiles are exact."""
    long = cut(long_features(df, [m for m in measures if m in df.columns], []))
    base = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, "feature", "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return base.join(q, "feature", "left").withColumnRenamed("feature", "measure")


def validity_indicators(metrics: DataFrame, effect_min: float = EFFECT_MIN_MS, ceiling: float = CEILING_ACC) -> DataFrame:
    """Construct-validity indicators of the congruency task as rows."""
    metrics = cut(metrics.select("flanker_effect", "rt_congruent", "rt_incongruent", "acc_overall"))
    one = metrics.agg(
        (F.avg("flanker_effect") * 1000).alias("mean_fx"), (F.avg("rt_congruent") * 1000).alias("rc"),
        (F.avg("rt_incongruent") * 1000).alias("ri"), F.count("acc_overall").alias("n"),
        F.count_if(F.col("acc_overall") >= ceiling).alias("top"), F.count_if(F.col("acc_overall") >= PERFECT_ACC).alias("perfect"))
    med = exact_quantiles(long_features(metrics, ["flanker_effect"], []), "feature", "value", {"m": 0.5}).select(
        (F.col("m") * 1000).alias("m"))
    one = one.withColumn("median_fx", med.scalar())
    n = F.nullif(F.col("n"), F.lit(0))
    share_top, share_perfect = F.col("top") / n, F.col("perfect") / n
    weak = lambda c: F.abs(c) < effect_min
    diff = F.col("ri") - F.col("rc")
    rows = [
        ("flanker_effect_mean_ms", F.col("mean_fx"), F.when(weak(F.col("mean_fx")), "FAIL: no detectable congruency effect").otherwise("passes literature floor")),
        ("flanker_effect_median_ms", F.col("median_fx"), F.when(weak(F.col("median_fx")), "FAIL: median ~0").otherwise("")),
        ("rt_congruent_mean_ms", F.col("rc"), F.lit("")), ("rt_incongruent_mean_ms", F.col("ri"), F.lit("")),
        ("rt_inc_minus_rt_con_ms", diff, F.when(weak(diff), "FAIL: conflict not induced").otherwise("induced congruency effect")),
        ("pct_subjects_at_ceiling", 100 * share_top, F.when(share_top > 0.5, "WARN: >50% at ceiling").otherwise("")),
        ("pct_at_perfect_acc", 100 * share_perfect, F.when(share_perfect > 0.2, "WARN: large degenerate subsample").otherwise("")),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n_).alias("indicator"), v.cast("double").alias("value"), t.alias("interpretation"))
                                         for n_, v, t in rows])))


def subject_flags(metrics: DataFrame, key: str = "id", ceiling: float = CEILING_ACC, subchance: float = SUBCHANCE_ACC,
                  rt_floor: float = RT_FLOOR_SEC) -> DataFrame:
    """People with any flag; a missing value never flags. Sub-chance accuracy is the exclusion case."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    acc = F.col("acc_overall")
    t = metrics.select(key, "acc_overall", "acc_incongruent", "rt_mean", yes(acc >= ceiling).alias("at_ceiling"),
                       yes(F.col("acc_incongruent") < subchance).alias("sub_chance"), yes(F.col("rt_mean") < rt_floor).alias("fast_rt"),
                       yes((acc >= PERFECT_ACC) | (acc <= ZERO_ACC)).alias("ddm_undefined"))
    return t.where(F.col("at_ceiling") | F.col("sub_chance") | F.col("fast_rt") | F.col("ddm_undefined")).withColumn(
        "exclude_candidate", F.col("sub_chance"))


def reliability_audit(rel: DataFrame, sb_floor: float = DIFFERENCE_SB_FLOOR) -> DataFrame:
    """Kind, flags and recommendation for each measured reliability (metric, n, spearman_brown)."""
    n, sb = F.coalesce("n", F.lit(0)), F.col("spearman_brown")
    diff = F.col("metric").isin(DIFFERENCE_SCORES)
    tag = F.concat(F.lit("n="), n.cast("string"))
    flags = F.concat_ws(
        "; ", F.when(n < 4, F.concat(tag, F.lit(": uninterpretable"))).when(n < 10, F.concat(tag, F.lit(": small subsample"))),
        F.when(diff, "difference score: reliability typically << components"),
        F.when(diff & (sb.isNull() | (sb < sb_floor)), f"SB<{sb_floor} or undefined: unusable as target"))
    advice = (F.when(diff, "DO NOT USE as target").when(sb.isNull(), "reliability not estimable")
              .when((sb >= 0.80) & (n >= 10), "candidate target (verify replication)")
              .when(sb >= 0.80, F.concat(F.lit("high SB but "), tag, F.lit("; replicate in larger sample")))
              .when(sb >= 0.50, "marginal; not preferred target").otherwise("unreliable"))
    return rel.select("metric", F.when(diff, "difference_score").otherwise("single_measure").alias("kind"), n.alias("n"),
                      "spearman_brown", flags.alias("flags"), advice.alias("recommendation"))


def at_max_counts(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    have = {c: x for c, x in limits.items() if c in df.columns}
    return df.agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(F.col(c) >= x).alias(f"{c}_at_max") for c, x in have.items()])


def lost_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The ids lost between two layers, as rows: the list grows with the loss, so it stays distributed."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def missing_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows a listwise analysis drops, and the missing cells by column among them."""
    gone = F.lit(False)
    for c in columns:
        gone = gone | F.col(c).isNull()
    one = df.where(gone).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.array(F.struct(F.lit("(rows dropped)").alias("column"), F.col("n").alias("n_missing")),
                   *[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def attrition_funnel(layers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """People per layer, and how many of the layer before are gone: one shuffle on the key.

    Every layer's ids are tagged and reduced to one presence flag per (id, layer).
    """
    tagged = None
    for i, (_, df) in enumerate(layers):
        one = df.select(F.col(key).alias("__id"), F.lit(i).alias("__layer"))
        tagged = one if tagged is None else tagged.unionByName(one)
    seen = tagged.groupBy("__id").agg(*[F.max(F.col("__layer") == i).alias(f"in{i}") for i in range(len(layers))])
    counts = seen.agg(*[F.count_if(F.col(f"in{i}")).alias(f"n{i}") for i in range(len(layers))],
                      *[F.count_if(F.col(f"in{i - 1}") & ~F.col(f"in{i}")).alias(f"lost{i}") for i in range(1, len(layers))])
    rows = [F.struct(F.lit(name).alias("layer"), F.col(f"n{i}").alias("n"),
                     (F.col(f"lost{i}") if i else F.lit(0).cast("bigint")).alias("n_lost"), F.lit(i).cast("bigint").alias("position"))
            for i, (name, _) in enumerate(layers)]
    return counts.select(F.inline(F.array(*rows)))


def demographics(df: DataFrame, age: str, group: str) -> DataFrame:
    """Sample size, age statistics and group counts; a missing group is its own row."""
    one = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(age).alias("m"), F.stddev_samp(age).alias("s"),
                 F.min(age).cast("double").alias("lo"), F.max(age).cast("double").alias("hi"))
    rows = [("n_subjects", "n"), ("age_mean", "m"), ("age_sd", "s"), ("age_min", "lo"), ("age_max", "hi")]
    stats = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("variable"), F.col(b).alias("value")) for a, b in rows])))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("group_"), F.coalesce(F.col(group).cast("string"), F.lit("missing"))).alias("variable"), "value")
    return stats.unionByName(counts)
