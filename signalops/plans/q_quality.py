"""Queries: audit and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalops.functions.present import shown_sql as r
from signalops.operators import quality as q, reliability as rel, reports
from signalops.plans import fixtures as fx
from signalops.plans.q_behaviour import _split_sql, metrics_sql
from signalops.plans.registry import out, query

SUB = {"A": ["click", "view"], "B": ["error", "purchase", "signup"]}
TM = f"tm as ({metrics_sql('FX_TRIALS', 'id')})"


@query("quality_rows", f"select subject, condition, status, n as n_epochs_before_reject, a as n_epochs_after_reject, {r('pct', 6)} as pct_epochs_dropped, n_bad as n_bad_channels, bad as bad_channels, n_ica as n_ica_excluded, ica as ica_labels from FX_QCLOG", "FX_QCLOG")
def _(spark, sf):
    return out(q.quality_rows(fx.qc_log(spark, sf)), "subject condition status n_epochs_before_reject n_epochs_after_reject n_bad_channels bad_channels n_ica_excluded ica_labels", pct_epochs_dropped=6)


@query("quality_summary", f"""
    select condition, count(*) filter (status = 'OK') as n_ok, count(*) filter (status = 'LOW_EPOCH_COUNT') as n_low, count(*) filter (starts_with(status, 'ERROR')) as n_errors,
      {r("avg(a) filter (status = 'OK')", 5)} as epochs_kept_mean, {r("stddev_samp(a) filter (status = 'OK')", 5)} as epochs_kept_sd, min(a) filter (status = 'OK') as epochs_kept_min, max(a) filter (status = 'OK') as epochs_kept_max,
      {r("avg(pct) filter (status = 'OK')", 6)} as pct_dropped_mean, {r("max(pct) filter (status = 'OK')", 6)} as pct_dropped_max, {r("avg(n_bad) filter (status = 'OK')", 5)} as bad_ch_mean, max(n_bad) filter (status = 'OK') as bad_ch_max,
      {r("avg(n_ica) filter (status = 'OK')", 5)} as ica_excl_mean, max(n_ica) filter (status = 'OK') as ica_excl_max from FX_QCLOG group by 1 having count(*) filter (status = 'OK') > 0""", "FX_QCLOG")
def _(spark, sf):
    s = q.quality_summary(q.quality_rows(fx.qc_log(spark, sf)))
    return out(s, "condition n_ok n_low n_errors epochs_kept_min epochs_kept_max bad_ch_max ica_excl_max", epochs_kept_mean=5, epochs_kept_sd=5,
               pct_dropped_mean=6, pct_dropped_max=6, bad_ch_mean=5, ica_excl_mean=5)


def _scale_sql(name, items):
    s = f"(select ({' + '.join(items)}) / {len(items)}.0::double as s from FX_IWIDE)"
    return f"""select '{name}' as subscale, {len(items)}::bigint as k_items, count(*) as n_obs, {r('avg(s)', 6)} as mean, {r('stddev_samp(s)', 6)} as sd, {r('100 * stddev_samp(s) / 3', 4)} as sd_pct_of_range,
      stddev_samp(s) < 0.3 as variance_restricted, {r('min(s)', 4)} as "min", {r('max(s)', 4)} as "max", {r('median(s)', 4)} as median, count(*) filter (s >= 4 - 1e-9) as n_at_max, count(*) filter (s <= 1 + 1e-9) as n_at_min from {s}"""


@query("scale_descriptives", " union all ".join(_scale_sql(n, i) for n, i in SUB.items()), "FX_IWIDE")
def _(spark, sf):
    d = q.scale_descriptives(fx.items_wide(spark, sf), SUB)
    return out(d, "subscale k_items n_obs variance_restricted n_at_max n_at_min", mean=6, sd=6, sd_pct_of_range=4, min=4, max=4, median=4)


@query("item_ceiling_floor", f"""
    select item, count(score) as n_obs, {r('avg(score)', 6)} as mean, {r('stddev_samp(score)', 6)} as sd, min(score) as "min", max(score) as "max",
      {r('100.0 * count(*) filter (score >= 4) / count(*)', 3)} as pct_at_ceiling, {r('100.0 * count(*) filter (score <= 1) / count(*)', 3)} as pct_at_floor,
      case when count(*) filter (score >= 4) = count(*) then 'at-ceiling (zero variance)' when count(*) filter (score >= 4) / count(*) >= 0.8 then 'heavy ceiling >=80%'
        when count(*) filter (score <= 1) / count(*) >= 0.8 then 'heavy floor >=80%' else '' end as flag from FX_ITEMS group by 1""", "FX_ITEMS")
def _(spark, sf):
    return out(q.item_ceiling_floor(fx.items(spark, sf)), "item n_obs min max flag", mean=6, sd=6, pct_at_ceiling=3, pct_at_floor=3)


MEAS = ["f_click", "f_view", "y_cv", "covariate"]


@query("describe_measures", " union all ".join(
    f"""select '{c}' as measure, count({c}) as "count", {r(f'avg({c})', 5)} as mean, {r(f'stddev_samp({c})', 5)} as std, {r(f'min({c})', 5)} as "min", {r(f'quantile_cont({c}, 0.25)', 5)} as q1,
      {r(f'median({c})', 5)} as median, {r(f'quantile_cont({c}, 0.75)', 5)} as q3, {r(f'max({c})', 5)} as "max" from FX_GAPS""" for c in MEAS), "FX_GAPS")
def _(spark, sf):
    return out(q.describe_long(fx.subjects_gaps(spark, sf), [*MEAS, "absent"]), "measure count", mean=5, std=5, min=5, q1=5, median=5, q3=5, max=5)


@query("validity_indicators", f"""
    with {TM}, s as (select avg(flanker_effect) * 1000 as m, median(flanker_effect) * 1000 as md, avg(rt_congruent) * 1000 as rc, avg(rt_incongruent) * 1000 as ri, count(acc_overall) as n,
      count(*) filter (acc_overall >= 0.95) as top, count(*) filter (acc_overall >= 0.9999) as perf from tm),
    u as (select 'flanker_effect_mean_ms' as indicator, m as v, case when abs(m) < 30 then 'FAIL: no detectable congruency effect' else 'passes literature floor' end as interpretation from s
      union all select 'flanker_effect_median_ms', md, case when abs(md) < 30 then 'FAIL: median ~0' else '' end from s union all select 'rt_congruent_mean_ms', rc, '' from s union all select 'rt_incongruent_mean_ms', ri, '' from s
      union all select 'rt_inc_minus_rt_con_ms', ri - rc, case when abs(ri - rc) < 30 then 'FAIL: conflict not induced' else 'induced congruency effect' end from s
      union all select 'pct_subjects_at_ceiling', 100.0 * top / n, case when top / n > 0.5 then 'WARN: >50% at ceiling' else '' end from s
      union all select 'pct_at_perfect_acc', 100.0 * perf / n, case when perf / n > 0.2 then 'WARN: large degenerate subsample' else '' end from s)
    select indicator, {r('v', 4)} as value, interpretation from u""", "FX_TRIALS")
def _(spark, sf):
    return out(q.validity_indicators(fx.trial_metrics(spark, sf)), "indicator interpretation", value=4)


FLAGS = f"""{TM}, fg as (select id, acc_overall, acc_incongruent, rt_mean, coalesce(acc_overall >= 0.85, false) as at_ceiling, coalesce(acc_incongruent < 0.7, false) as sub_chance,
    coalesce(rt_mean < 0.24, false) as fast_rt, coalesce(acc_overall >= 0.9999 or acc_overall <= 1e-4, false) as ddm_undefined from tm)"""


def _flags(spark, sf):
    return q.subject_flags(fx.trial_metrics(spark, sf), "id", 0.85, 0.7, 0.24)


@query("subject_flags", f"with {FLAGS} select id, at_ceiling, sub_chance, fast_rt, ddm_undefined, sub_chance as exclude_candidate, {r('acc_overall', 6)} as acc_overall, {r('acc_incongruent', 6)} as acc_incongruent, {r('rt_mean', 6)} as rt_mean from fg where at_ceiling or sub_chance or fast_rt or ddm_undefined", "FX_TRIALS")
def _(spark, sf):
    return out(_flags(spark, sf), "id at_ceiling sub_chance fast_rt ddm_undefined exclude_candidate", acc_overall=6, acc_incongruent=6, rt_mean=6)


def _audit_sql():
    base = _split_sql()
    head, tail = base.rsplit("select metric, n,", 1)
    return f"""{head}, rl as (select metric, n,{tail})
      select metric, case when metric in ('flanker_effect', 'ddm_delta_v') then 'difference_score' else 'single_measure' end as kind, n, spearman_brown,
        concat_ws('; ', case when n < 4 then 'n=' || n || ': uninterpretable' when n < 10 then 'n=' || n || ': small subsample' end,
          case when metric in ('flanker_effect', 'ddm_delta_v') then 'difference score: reliability typically << components' end,
          case when metric in ('flanker_effect', 'ddm_delta_v') and coalesce(spearman_brown < 0.3, true) then 'SB<0.3 or undefined: unusable as target' end) as flags,
        case when metric in ('flanker_effect', 'ddm_delta_v') then 'DO NOT USE as target' when spearman_brown is null then 'reliability not estimable' when spearman_brown >= 0.8 and n >= 10 then 'candidate target (verify replication)'
          when spearman_brown >= 0.8 then 'high SB but n=' || n || '; replicate in larger sample' when spearman_brown >= 0.5 then 'marginal; not preferred target' else 'unreliable' end as recommendation from rl"""


@query("reliability_audit", _audit_sql(), "FX_TRIALS")
def _(spark, sf):
    rl = rel.split_half_reliability(rel.split_halves(fx.trials(spark, sf), "odd_even", 30))
    return out(q.reliability_audit(out(rl, "metric n", spearman_brown=5)), "metric kind n spearman_brown flags recommendation")


@query("at_max_counts", """
    select count(*) as n_total, count(*) filter (fw >= 4) as fw_span_at_max, count(*) filter (bw >= 5) as bw_span_at_max from (
      select conv_id, coalesce(max(turn // 2 + 2) filter (role = 'user' and length(text) % 3 <> 0), 0) as fw, coalesce(max(turn // 2 + 2) filter (role = 'assistant' and length(text) % 3 <> 0), 0) as bw from conversations group by 1)""")
def _(spark, sf):
    from signalops.operators.behaviour import digit_span_scores
    from signalops.plans.q_behaviour import _conv
    return q.at_max_counts(digit_span_scores(_conv(spark, sf), "conv_id", "user", "assistant"), {"fw_span": 4, "bw_span": 5, "absent": 1})


def _layers(spark, sf):
    c = fx.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    qc = fx.qc_log(spark, sf).withColumnRenamed("subject", "id")
    full = fx.subjects_gaps(spark, sf).withColumnRenamed("subject_id", "id")
    return [("registered", c), ("recorded", qc), ("one_ok", qc.where("status = 'OK'")), ("complete", full.na.drop(subset=["f_click", "f_view"]))]


LAY = """l0 as (select distinct c_custkey as id from customer), l1 as (select distinct subject as id from FX_QCLOG), l2 as (select distinct subject as id from FX_QCLOG where status = 'OK'),
  l3 as (select distinct subject_id as id from FX_GAPS where f_click is not null and f_view is not null)"""


@query("attrition_funnel", f"""with {LAY} select 'registered' as layer, count(*) as n, 0::bigint as n_lost, 0::bigint as position from l0
    union all select 'recorded', count(*), (select count(*) from l0 anti join l1 using (id)), 1 from l1 union all select 'one_ok', count(*), (select count(*) from l1 anti join l2 using (id)), 2 from l2
    union all select 'complete', count(*), (select count(*) from l2 anti join l3 using (id)), 3 from l3""", ("FX_QCLOG", "FX_GAPS"))
def _(spark, sf):
    return q.attrition_funnel(_layers(spark, sf), "id")


@query("attrition_ids", f"with {LAY} select id from l2 anti join l3 using (id)", ("FX_QCLOG", "FX_GAPS"))
def _(spark, sf):
    lay = _layers(spark, sf)
    return q.lost_ids(lay[2][1], lay[3][1], "id")


@query("missing_by_column", """with d as (select * from FX_GAPS where f_click is null or f_view is null or y_cv is null)
    select '(rows dropped)' as "column", count(*) as n_missing from d union all select 'f_click', count(*) - count(f_click) from d union all select 'f_view', count(*) - count(f_view) from d union all select 'y_cv', count(*) - count(y_cv) from d""", "FX_GAPS")
def _(spark, sf):
    return q.missing_by_column(fx.subjects_gaps(spark, sf), ["f_click", "f_view", "y_cv"])


@query("demographics", f"""
    with d as (select covariate, case when subject_id % 11 <> 0 then sex end as sex from FX_SUBJECT),
    u as (select 'n_subjects' as variable, count(*)::double as v from d union all select 'age_mean', avg(covariate) from d union all select 'age_sd', stddev_samp(covariate) from d
      union all select 'age_min', min(covariate) from d union all select 'age_max', max(covariate) from d union all select 'group_' || coalesce(sex, 'missing'), count(*) from d group by sex)
    select variable, {r('v', 5)} as value from u""", "FX_SUBJECT")
def _(spark, sf):
    d = fx.subjects(spark, sf).withColumn("sex", F.when(F.col("subject_id") % 11 != 0, F.col("sex")))
    return out(q.demographics(d, "covariate", "sex"), "variable", value=5)


@query("facts_long", f"""
    with a as (select count(*)::double as n_records, count(*) filter (status = 'OK')::double as n_ok from FX_QCLOG), b as (select count(*)::double as n_subjects, avg(y_cv) as mean_target from FX_SUBJECT),
    u as (select 'quality' as section, 'n_records' as name, n_records as v from a union all select 'quality', 'n_ok', n_ok from a union all select 'sample', 'n_subjects', n_subjects from b union all select 'sample', 'mean_target', mean_target from b)
    select section, name, {r('v', 6)} as value from u""", ("FX_QCLOG", "FX_SUBJECT"))
def _(spark, sf):
    a = fx.qc_log(spark, sf).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("status") == "OK").alias("n_ok"))
    b = fx.subjects(spark, sf).agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("y_cv").alias("mean_target"))
    return out(reports.collect_facts({"quality": a, "sample": b}), "section name", value=6)


@query("exclusions", f"with {FLAGS} select id, sub_chance, {r('acc_overall', 6)} as acc_overall, {r('acc_incongruent', 6)} as acc_incongruent, {r('rt_mean', 6)} as rt_mean from fg where sub_chance", "FX_TRIALS")
def _(spark, sf):
    e = reports.exclusions(_flags(spark, sf), ["id", "acc_overall", "acc_incongruent", "rt_mean", "sub_chance"])
    return out(e, "id sub_chance", acc_overall=6, acc_incongruent=6, rt_mean=6)


@query("top_n_rows", f"select subject_id, {r('y_cv', 6)} as y_cv from FX_SUBJECT order by subject_id limit 20", "FX_SUBJECT")
def _(spark, sf):
    return out(reports.head_rows(fx.subjects(spark, sf).select("subject_id", "y_cv"), ["subject_id"], 20), "subject_id", y_cv=6)
