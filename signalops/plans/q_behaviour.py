"""Queries: scoring and reliability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from signalops.functions.ordering import bucketed_row_number
from signalops.functions.present import shown_sql as r
from signalops.operators import behaviour as b, reliability as rel
from signalops.plans import fixtures as fx
from signalops.plans.registry import out, query

SUBSCALES = {"A": ["click", "view"], "B": ["error", "purchase", "signup"], "C": ["absent", "view"]}


@query("trial_scoring", """
    with e as (select user_id, (rn - 1) // 3 as trial, rn, case when event_type <> 'signup' then event_type end as key from FX_RANKED),
    g as (select user_id, trial, arg_max(key, rn) filter (key is not null) as response,
      case trial % 4 when 0 then 'click' when 1 then 'view' when 2 then 'none' else 'error' end as expected from e group by 1, 2)
    select *, coalesce(case when response is null then expected = 'none' else response = expected end, false)::bigint as corr from g""", "FX_RANKED")
def _(spark, sf):
    t = F.floor((F.col("rn") - 1) / 3)
    want = F.when(F.col("trial") % 4 == 0, "click").when(F.col("trial") % 4 == 1, "view").when(F.col("trial") % 4 == 2, "none").otherwise("error")
    e = fx.ranked_events(spark, sf).select("user_id", t.alias("trial"), "rn", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("key"))
    return b.score_trials(e.withColumn("want", want), ["user_id", "trial"], "key", ["rn"], "want")


CONV = "cv as (select conv_id, turn, role as condition, turn // 2 + 1 as level, turn // 2 + 2 as span, length(text) % 3 <> 0 as correct, length(text) as n from conversations)"


def _conv(spark, sf):
    lvl = F.floor(F.col("turn") / 2)
    return fx.load(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("condition"), (lvl + 1).alias("level"), (lvl + 2).alias("span"),
        (F.length("text") % 3 != 0).alias("correct"), F.length("text").alias("n"))


@query("span_scores", f"""
    with {CONV} select conv_id, coalesce(max(span) filter (condition = 'user' and correct), 0) as fw_span,
      coalesce(max(span) filter (condition = 'assistant' and correct), 0) as bw_span, count(*) filter (condition = 'user' and correct) as fw_raw,
      count(*) filter (condition = 'assistant' and correct) as bw_raw,
      coalesce(max(span) filter (condition = 'user' and correct), 0) + coalesce(max(span) filter (condition = 'assistant' and correct), 0) as total_span,
      count(*) filter (condition in ('user', 'assistant') and correct) as total_raw from cv group by 1""")
def _(spark, sf):
    return b.digit_span_scores(_conv(spark, sf), "conv_id", "user", "assistant")


@query("trial_detail", f"""
    with {CONV}, q as (select *, row_number() over (partition by conv_id, condition order by turn) - 1 as i from cv where condition in ('user', 'assistant'))
    select conv_id, case condition when 'user' then 'Forward' else 'Backward' end as condition, i // 2 + 1 as level, i % 2 + 1 as trial, span,
      array_to_string(string_split(n::varchar, ''), ' - ') as digits, correct::bigint as score from q where n % 5 <> 0""")
def _(spark, sf):
    # The administered form stores each condition as a short nested list in presentation order;
    # longer sessions are stored in blocks of sixteen, so no list grows with a session.
    c = _conv(spark, sf).where(F.col("condition").isin("user", "assistant"))
    c = bucketed_row_number(c, ["conv_id", "condition"], ["turn"], F.floor(F.col("turn") / 64))
    t = F.struct("rn", F.col("span"), F.regexp_extract_all(F.col("n").cast("string"), F.lit(r"\d"), F.lit(0)).alias("digits"),
                 F.when(F.col("n") % 5 != 0, F.col("correct").cast("bigint")).alias("correct"))
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("condition") == k, t)))
    block = (F.floor((F.col("rn") - 1) / 16) * 16).alias("start")
    nested = c.groupBy("conv_id", block).agg(pick("user").alias("fw"), pick("assistant").alias("bw"))
    return b.trial_detail(nested, "conv_id", {"Forward": "fw", "Backward": "bw"}, "start")


@query("discontinue_rule", f"""
    with {CONV}, stop as (select conv_id, min(level) as s from (select conv_id, level from cv group by 1, 2 having count(*) = 2 and not bool_or(correct)) group by 1)
    select cv.conv_id, count(*) as n_kept, max(level) as last_level, max(s) as stop_level from cv left join stop on cv.conv_id = stop.conv_id
    where s is null or level <= s group by 1""")
def _(spark, sf):
    return b.apply_discontinue(_conv(spark, sf), ["conv_id"]).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max("level").alias("last_level"), F.max("stop_level").alias("stop_level"))


@query("compute_age", """
    select o_orderkey, round(d / 365.25, 1)::double as age_years, round(d / 30.4375, 1)::double as age_months from (
      select o_orderkey, date_diff('day', try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')::date, date '2026-03-09')::double as d from orders)""")
def _(spark, sf):
    o = fx.load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("dob"))
    return b.compute_age(o, "dob", "2026-03-09").drop("dob")


@query("item_scores", f"""
    select id, {r("avg(score) filter (item in ('click', 'view', 'error', 'signup'))", 6)} as global_score, {r("avg(score) filter (item in ('click', 'view'))", 6)} as "A_score",
      {r("avg(score) filter (item in ('error', 'signup'))", 6)} as "B_score" from FX_ITEMS group by 1""", "FX_ITEMS")
def _(spark, sf):
    d = b.score_items(fx.items(spark, sf), {"A": ["click", "view"], "B": ["error", "purchase", "signup"]}, ["purchase"])
    return out(d, "id", global_score=6, A_score=6, B_score=6)


@query("unit_autoscale", f"""
    select c_custkey, {r('case when (select max(abs(c_acctbal)) from customer) > 1000 then c_acctbal / 1000 else c_acctbal end', 6)} as rt_mean,
      {r('c_nationkey::double', 6)} as rt_iqr from customer""")
def _(spark, sf):
    c = fx.load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("rt_mean"), F.col("c_nationkey").cast("double").alias("rt_iqr"))
    return out(b.autoscale(c, b.audit_rt_columns(c.columns)), "c_custkey", rt_mean=6, rt_iqr=6)


def _alpha_sql(items, src, by=""):
    tot = " + ".join(items)
    k = len(items)
    var = " + ".join(f"var_samp({i})" for i in items)
    b_ = f"{by}, " if by else ""
    return f"""select {b_}{k}::bigint as k_items, count(*) as n_obs, case when count(*) >= 3 and var_samp({tot}) > 0
      then {k} / {k - 1.0} * (1 - ({var}) / var_samp({tot})) end as alpha from {src} {('group by ' + by) if by else ''}"""


@query("cronbach_alpha", f"select sex, k_items, n_obs, {r('alpha', 5)} as alpha from ({_alpha_sql(fx.ITEMS, '(select w.*, c_mktsegment as sex from FX_IWIDE w join customer on id = c_custkey)', 'sex')})", "FX_IWIDE")
def _(spark, sf):
    c = fx.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("sex"))
    return out(rel.cronbach_alpha(fx.items_wide(spark, sf).join(c, "id"), fx.ITEMS, ["sex"]), "sex k_items n_obs", alpha=5)


@query("alpha_bands", f"""
    select subscale, k_items, n_obs, {r('alpha', 5)} as alpha, case when k_items < 2 then 'insufficient items' when alpha is null then 'undefined'
      when alpha >= 0.7 then 'good' when alpha >= 0.5 then 'marginal' else 'inadequate' end as interpretation from (
      select 'A' as subscale, * from ({_alpha_sql(SUBSCALES['A'], 'FX_IWIDE')}) union all select 'B', * from ({_alpha_sql(SUBSCALES['B'], 'FX_IWIDE')})
      union all select 'C', 1, 0, null)""", "FX_IWIDE")
def _(spark, sf):
    return out(rel.subscale_reliability(fx.items_wide(spark, sf), SUBSCALES), "subscale k_items n_obs interpretation", alpha=5)


@query("alpha_global", f"""select k_items, n_obs, {r('alpha', 5)} as alpha, case when alpha is null then 'undefined' when alpha >= 0.7 then 'good'
      when alpha >= 0.5 then 'marginal' else 'inadequate' end as interpretation from ({_alpha_sql(fx.ITEMS, 'FX_IWIDE')})""", "FX_IWIDE")
def _(spark, sf):
    d = rel.cronbach_alpha(fx.items_wide(spark, sf), fx.ITEMS)
    return out(d.withColumn("interpretation", rel.alpha_band(F.col("alpha"), F.col("k_items"))), "k_items n_obs interpretation", alpha=5)


def _item_total_sql():
    parts = []
    for i in fx.ITEMS:
        rest = [x for x in fx.ITEMS if x != i]
        t = " + ".join(rest)
        parts.append(f"""select '{i}' as item, covar_samp({i}, {t}) / nullif(stddev_samp({i}) * stddev_samp({t}), 0) as rr,
          4 / 3.0 * (1 - ({' + '.join(f'var_samp({x})' for x in rest)}) / var_samp({t})) as dd, (select alpha from ({_alpha_sql(fx.ITEMS, 'FX_IWIDE')})) as bb from FX_IWIDE""")
    return f"select item, {r('rr', 5)} as corrected_item_total_r, {r('dd', 5)} as alpha_if_deleted, {r('bb', 5)} as alpha_baseline from ({' union all '.join(parts)})"


@query("item_total", _item_total_sql(), "FX_IWIDE")
def _(spark, sf):
    return out(rel.item_total(fx.items_wide(spark, sf), fx.ITEMS), "item", corrected_item_total_r=5, alpha_if_deleted=5, alpha_baseline=5)


@query("mcdonald_omega")
def _(spark, sf):
    return out(rel.mcdonald_omega(fx.items_wide(spark, sf), fx.ITEMS), "k_items n_obs", omega=5)


TRIPLES = [(1, 2, 3), (1, 2, 4), (2, 3, 4)]


def _triple_sql(a, b, c):
    return f"""select condition, '{a}{b}{c}' as triple, n, pow(l1 + l2 + l3, 2) / (pow(l1 + l2 + l3, 2) + 3 - l1 * l1 - l2 * l2 - l3 * l3) as omega from (
      select *, sqrt(r12 * r13 / r23) as l1, sqrt(r12 * r23 / r13) as l2, sqrt(r13 * r23 / r12) as l3 from (
        select condition, count(*) as n, corr(i{a}, i{b}) as r12, corr(i{a}, i{c}) as r13, corr(i{b}, i{c}) as r23 from it group by 1))"""


@query("omega_triples", f"""
    with it as (select condition, {', '.join(f'x[1]::double + x[{k + 1}]::double as i{k}' for k in range(1, 5))} from FX_EPOCH),
    tr as ({' union all '.join(_triple_sql(*t) for t in TRIPLES)})
    select condition, triple, 3::bigint as k_items, n as n_obs, {r('omega', 5)} as omega from tr""", "FX_EPOCH")
def _(spark, sf):
    # Three items that share one part: there a one-factor solution has a closed form.
    wide = fx.epochs(spark, sf).select("condition", *[(F.col("x")[0] + F.col("x")[k]).alias(f"i{k}") for k in range(1, 5)])
    each = [rel.mcdonald_omega(wide, [f"i{k}" for k in t], ["condition"]).withColumn("triple", F.lit("".join(map(str, t)))) for t in TRIPLES]
    return out(reduce(DataFrame.unionByName, each), "condition triple k_items n_obs", omega=5)


def ez_sql(m, v, p, tag):
    """Column list defining v, a, ter with the given suffix, from names of mean, variance and accuracy."""
    pc = f"least(greatest({p}, 0.01), 0.99)"
    lg = f"ln({pc} / (1 - {pc}))"
    x = f"({lg} * ({lg} * {pc} * {pc} - {lg} * {pc} + {pc} - 0.5) / {v})"
    dv = f"case when {p} > 0 and {p} < 1 and {v} > 0 and {m} > 0 then case when {x} > 0 then nullif(sign({pc} - 0.5) * 0.1 * pow({x}, 0.25), 0) end end"
    da = f"0.01 * {lg} / ({dv})"
    e = f"exp(-({dv}) * ({da}) / 0.01)"
    return f"{dv} as ddm_v{tag}, {da} as ddm_a{tag}, {m} - (({da}) / (2 * ({dv}))) * (1 - {e}) / (1 + {e}) as ddm_t{tag}"


def metrics_sql(src, by):
    agg = f"""select {by}, count(*) as n_trials, avg(acc) as acc_overall, avg(rt) as rt_mean, var_samp(rt) as var_all, stddev_samp(rt) as sd_all,
      {', '.join(f"avg(acc) filter (condition = '{c}') as acc_{c}, avg(rt) filter (condition = '{c}') as rt_{c}, var_samp(rt) filter (condition = '{c}') as var_{c}" for c in ('congruent', 'incongruent'))}
      from {src} where not coalesce(outlier, false) and acc is not null and rt is not null group by {by}"""
    m = f"""select *, sd_all / rt_mean as rt_cv, rt_incongruent - rt_congruent as flanker_effect, {ez_sql('rt_mean', 'var_all', 'acc_overall', '')},
      {ez_sql('rt_congruent', 'var_congruent', 'acc_congruent', '_congruent')}, {ez_sql('rt_incongruent', 'var_incongruent', 'acc_incongruent', '_incongruent')} from ({agg})"""
    return f"select *, ddm_v_congruent - ddm_v_incongruent as ddm_delta_v from ({m})"


METRICS = [m for m in rel.SPLIT_METRICS]


@query("ez_diffusion", f"select id, {r('ddm_v', 6)} as v, {r('ddm_a', 6)} as a, {r('ddm_t', 6)} as ter from (select *, {ez_sql('m', 's2', 'p', '')} from (select id, avg(rt) as m, var_samp(rt) as s2, avg(acc) as p from FX_TRIALS group by 1))", "FX_TRIALS")
def _(spark, sf):
    t = fx.trials(spark, sf).groupBy("id").agg(F.avg("rt").alias("m"), F.var_samp("rt").alias("s2"), F.avg("acc").alias("p"))
    return out(rel.ez_diffusion(t, [("m", "s2", "p", ("v", "a", "ter"))]), "id", v=6, a=6, ter=6)


@query("trial_metrics", f"select id, n_trials, {', '.join(r(m, 6) + f' as {m}' for m in METRICS)} from ({metrics_sql('FX_TRIALS', 'id')})", "FX_TRIALS")
def _(spark, sf):
    return out(fx.trial_metrics(spark, sf), "id n_trials", **{m: 6 for m in METRICS})


HALVES = "hv as (select *, case when trial % 2 = 0 then 1 else 2 end::bigint as half from FX_TRIALS qualify least(count(*) filter (trial % 2 = 0) over (partition by id), count(*) filter (trial % 2 = 1) over (partition by id)) >= 30)"


@query("split_halves", f"with {HALVES} select id, half, count(*) as n, {r('sum(rt)', 6)} as rt_total from hv group by 1, 2", "FX_TRIALS")
def _(spark, sf):
    h = rel.split_halves(fx.trials(spark, sf), "odd_even", 30)
    return out(h.groupBy("id", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("rt").alias("rt_total")), "id half n", rt_total=6)


@query("split_halves_random", f"""
    with h as (select *, row_number() over (partition by id order by {fx.draw_sql('trial', 'id % 1000003')}, trial) as rn, count(*) over (partition by id) // 2 as mid from FX_TRIALS)
    select id, case when rn <= mid then 1 else 2 end::bigint as half, count(*) as n, {r('sum(rt)', 6)} as rt_total from h where mid >= 30 and rn <= 2 * mid group by 1, 2""", "FX_TRIALS")
def _(spark, sf):
    h = rel.split_halves(fx.trials(spark, sf), "random", 30)
    return out(h.groupBy("id", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("rt").alias("rt_total")), "id half n", rt_total=6)


def _split_sql():
    rows = " union all ".join(f"""select '{m}' as metric, count(*) filter (a.{m} is not null and b.{m} is not null) as n,
      covar_samp(a.{m}, b.{m}) / nullif(stddev_samp(a.{m}) filter (b.{m} is not null) * stddev_samp(b.{m}) filter (a.{m} is not null), 0) as r from ma a join mb b using (id)""" for m in METRICS)
    return f"""with {HALVES}, mm as ({metrics_sql('hv', 'id, half')}), ma as (select * from mm where half = 1), mb as (select * from mm where half = 2), rr as ({rows})
      select metric, n, {r('case when n >= 4 then r end', 5)} as r_halves, {r('case when n >= 4 then 2 * r / nullif(1 + r, 0) end', 5)} as spearman_brown,
        case when n >= 4 then '' else 'n<4 after dropping undefined halves' end as note from rr"""


@query("split_half", _split_sql(), "FX_TRIALS")
def _(spark, sf):
    d = rel.split_half_reliability(rel.split_halves(fx.trials(spark, sf), "odd_even", 30))
    return out(d, "metric n note", r_halves=5, spearman_brown=5)


@query("parallel_forms", f"""select 'click+view' as measure, n, {r('r', 5)} as r_halves, {r('2 * r / (1 + r)', 5)} as spearman_brown from (
      select count(*) as n, covar_samp(f_click, f_view) / (stddev_samp(f_click) * stddev_samp(f_view)) as r from FX_GAPS where f_click is not null and f_view is not null)""", "FX_GAPS")
def _(spark, sf):
    return out(rel.parallel_forms(fx.subjects_gaps(spark, sf), "f_click", "f_view", "click+view"), "measure n", r_halves=5, spearman_brown=5)


@query("pass_summary", """
    select count(*) as n_records, count(*) filter (status = 'OK') as n_ok, count(*) filter (status = 'LOW_EPOCH_COUNT') as n_low,
      count(*) filter (status not in ('OK', 'LOW_EPOCH_COUNT')) as n_other, count(distinct subject) filter (status = 'OK') as n_subjects_one_ok,
      (select count(*) from (select subject from FX_QCLOG where status = 'OK' and condition in ('click', 'view') group by 1 having count(distinct condition) = 2)) as n_subjects_both
    from FX_QCLOG""", "FX_QCLOG")
def _(spark, sf):
    return rel.pass_summary(fx.qc_log(spark, sf), ["click", "view"])
