"""Queries: least squares, tests, leave-one-out, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalops.functions.ordering import average_rank_pct
from signalops.functions.present import shown_sql as r
from signalops.operators import inference as i
from signalops.plans import fixtures as fx
from signalops.plans.registry import out, query

Y, COV = "y_cv", ["covariate"]
FEATS = ["f_click", "f_view"]
PRIORS = {"f_click": "positive", "f_view": "negative"}
SCAN = ["f_click", "f_view", "f_signup", "f_error", "f_purchase"]


def t_p(t: str, nu: str) -> str:
    """Two-sided t tail by Simpson integration of the density."""
    dens = f"pow(1 + pow(abs({t}) * i / 400, 2) / ({nu}), -(({nu}) + 1) / 2)"
    const = f"exp(lgamma((({nu}) + 1) / 2) - lgamma(({nu}) / 2)) / sqrt(({nu}) * pi())"
    return (f"(1 - 2 * {const} * abs({t}) / 1200 * (select sum((case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end) * {dens}) "
            f"from (select unnest(range(0, 401))::double as i)))")


def ols2(src: str, y: str, a: str, b: str, by: str = "", intercept: bool = True, extra: int = 0) -> str:
    """Two-predictor least squares by Cramer's rule: n, b0, b1, b2, se1, se2, r2 and parts."""
    g = f"{by}, " if by else ""
    return f"""select *, b1 / se1 as t1, b2 / se2 as t2 from (select *, sqrt(s2 * s22 / det) as se1, sqrt(s2 * s11 / det) as se2,
        sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) as se0, my - b1 * m1 - b2 * m2 as b0 from (
      select *, (syy - b1 * s1y - b2 * s2y) / (n - 3 - {extra}) as s2, n - 3 - {extra} as df, (b1 * s1y + b2 * s2y) / syy as r2 from (
        select *, (s1y * s22 - s2y * s12) / det as b1, (s2y * s11 - s1y * s12) / det as b2 from (
          select *, s11 * s22 - s12 * s12 as det from (
            select {g}count(*) as n, avg({y}) as my, avg({a}) as m1, avg({b}) as m2, var_pop({y}) * count(*) as syy, var_pop({a}) * count(*) as s11,
              var_pop({b}) * count(*) as s22, covar_pop({a}, {b}) * count(*) as s12, covar_pop({a}, {y}) * count(*) as s1y, covar_pop({b}, {y}) * count(*) as s2y
            from {src} where {y} is not null and {a} is not null and {b} is not null {('group by ' + by) if by else ''})))))"""


SIMPLE = """sm as (select sex, count(*) as n, regr_slope(y_cv, covariate) as b, regr_intercept(y_cv, covariate) as a, regr_r2(y_cv, covariate) as r2,
    var_pop(covariate) * count(*) as sxx, avg(covariate) as mx, var_pop(y_cv) * count(*) * (1 - regr_r2(y_cv, covariate)) / (count(*) - 2) as s2 from FX_SUBJECT group by 1),
  sc as (select sex, n, r2, 'covariate' as term, b as beta, sqrt(s2 / sxx) as se from sm union all select sex, n, r2, 'const', a, sqrt(s2 * (1.0 / n + mx * mx / sxx)) from sm)"""


@query("ols_simple", f"with {SIMPLE} select sex, term, n, {r('beta', 6)} as beta, {r('se', 6)} as se, {r('beta / se', 4)} as t, {r('r2', 6)} as r2, {r(t_p('beta / se', 'n - 2'), 5)} as p_two_sided from sc", "FX_SUBJECT")
def _(spark, sf):
    return out(i.ols(fx.subjects(spark, sf), Y, COV, ["sex"]), "sex term n", beta=6, se=6, t=4, r2=6, p_two_sided=5)


@query("ols_multi", f"""
    with o as ({ols2('FX_SUBJECT', 'y_cv', 'covariate', 'f_click', 'sex')}),
    l as (select sex, n, r2, df, 'const' as term, b0 as beta, se0 as se from o union all select sex, n, r2, df, 'covariate', b1, se1 from o union all select sex, n, r2, df, 'f_click', b2, se2 from o)
    select sex, term, n, {r('beta', 6)} as beta, {r('se', 6)} as se, {r('beta / se', 4)} as t, {r('r2', 6)} as r2, {r(t_p('beta / se', 'df'), 5)} as p_two_sided from l where df > 0""", "FX_SUBJECT")
def _(spark, sf):
    return out(i.ols(fx.subjects(spark, sf), Y, ["covariate", "f_click"], ["sex"]).where("df_resid > 0"), "sex term n", beta=6, se=6, t=4, r2=6, p_two_sided=5)


@query("complete_cases", """select count(*) as n_total, count(*) filter (f_click is not null and f_view is not null) as n_used,
    count(*) filter (f_click is null or f_view is null) as n_dropped, 6::bigint as n_needed, null::varchar as skipped from FX_GAPS""", "FX_GAPS")
def _(spark, sf):
    return i.complete_case_report(fx.subjects_gaps(spark, sf), Y, COV, FEATS)


# Frisch-Waugh: sweep the covariate out of target and features, then two predictors.
FW = """cc as (select * from FX_GAPS where f_click is not null and f_view is not null),
  fw as (select y_cv, covariate, y_cv - regr_intercept(y_cv, covariate) over () - regr_slope(y_cv, covariate) over () * covariate as ry,
    f_click - regr_intercept(f_click, covariate) over () - regr_slope(f_click, covariate) over () * covariate as r1,
    f_view - regr_intercept(f_view, covariate) over () - regr_slope(f_view, covariate) over () * covariate as r2 from cc)"""
def block_sql(fw: str, y: str) -> str:
    """Block F of two swept features; ``fw`` defines cc (rows) and fw (residuals)."""
    return f"""{fw}, o as (select *, r2 as part from ({ols2('fw', 'ry', 'r1', 'r2', '', True, 1)})),
      bl as (select n, rc, rc + (1 - rc) * part as rf, df, b1, b2, se1, se2, t1, t2 from o, (select regr_r2({y}, covariate) as rc from cc)),
      bf as (select *, ((rf - rc) / 2) / ((1 - rf) / df) as f_stat from bl)"""


BLOCK = block_sql(FW, "y_cv")
F2P = "pow(1 + 2 * f_stat / df, -df / 2)"


@query("block_f", f"with {BLOCK} select n, {r('rc', 6)} as covariate_r2, {r('rf', 6)} as full_r2, {r('rf - rc', 6)} as delta_r2, {r('f_stat', 4)} as f_stat, 2.0::double as df_num, df::double as df_den, {r(F2P, 5)} as p_value from bf", "FX_GAPS")
def _(spark, sf):
    return out(i.block_f(fx.subjects_gaps(spark, sf), Y, COV, FEATS), "n df_num df_den", covariate_r2=6, full_r2=6, delta_r2=6, f_stat=4, p_value=5)


@query("directional_p", f"""
    with o as ({ols2('FX_SUBJECT', 'y_cv', 'f_click', 'f_view')}), l as (select 'f_click' as term, b1 as beta, t1 as t, df, 'positive' as d from o union all select 'f_view', b2, t2, df, 'negative' from o),
    p as (select *, {t_p('t', 'df')} as p2, (d = 'positive' and beta > 0) or (d = 'negative' and beta < 0) as ok from l)
    select term, d as direction, ok as sign_matches, {r('case when ok then p2 / 2 else 1 - p2 / 2 end', 5)} as p_one_sided from p""", "FX_SUBJECT")
def _(spark, sf):
    o = i.ols(fx.subjects(spark, sf), Y, FEATS).where("term <> 'const'")
    d, p, ok = i.directional_p(F.col("beta"), F.col("p_two_sided"), F.when(F.col("term") == "f_click", "positive").otherwise("negative"))
    return out(o.select("term", d.alias("direction"), ok.alias("sign_matches"), p.alias("p_one_sided")), "term direction sign_matches", p_one_sided=5)


PV = f"{SIMPLE}, pv as (select sex, {t_p('beta / se', 'n - 2')} as p from sc where term = 'covariate' and n > 2)"


def _family(spark, sf):
    return i.ols(fx.subjects(spark, sf), Y, COV, ["sex"]).where("term = 'covariate' and df_resid > 0")


@query("p_bonferroni", f"with {PV} select sex, {r('least(p * count(*) over (), 1)', 5)} as p_corrected from pv", "FX_SUBJECT")
def _(spark, sf):
    return out(i.adjust_p(_family(spark, sf), "p_two_sided", family_order="sex"), "sex", p_corrected=5)


BH = "least(1, min(p * n / i) over (order by i desc rows between unbounded preceding and current row))"


@query("p_bh", f"with {PV}, k as (select *, row_number() over (order by p, sex) as i, count(*) over () as n from pv) select sex, {r(BH, 5)} as p_corrected from k", "FX_SUBJECT")
def _(spark, sf):
    return out(i.adjust_p(_family(spark, sf), "p_two_sided", method="fdr_bh", family_order="sex"), "sex", p_corrected=5)


@query("reliability_gate", f"""
    with a as (select 2 * (1 - (var_samp(f_click) + var_samp(f_dup)) / var_samp(f_click + f_dup)) as alpha, count(*) as n from FX_GAPS where f_click is not null),
    b as (select 2 * (1 - (var_samp(f_error) + var_samp(f_view)) / var_samp(f_error + f_view)) as alpha, count(*) as n from FX_GAPS where f_view is not null),
    u as (select 'pair_a' as composite, 2::bigint as k_items, n as n_obs, alpha, alpha >= 0.5 as pass_gate from a union all select 'pair_b', 2, n, alpha, alpha >= 0.5 from b
      union all select 'lone', 1, 0, null, false union all select 'open', null, null, null, null)
    select composite, k_items, n_obs, {r('alpha', 5)} as alpha, pass_gate, bool_and(pass_gate) over () as all_pass from u""", "FX_GAPS")
def _(spark, sf):
    parts = {"pair_a": ["f_click", "f_dup"], "pair_b": ["f_error", "f_view"], "lone": ["f_error", "absent"]}
    return out(i.reliability_gate(fx.gaps_table(spark, sf), ["pair_a", "pair_b", "lone", "open"], parts), "composite k_items n_obs pass_gate all_pass", alpha=5)


def boot_sql(cols, reps, seed=42):
    return f"""rw as (select *, row_number() over (order by {fx.draw_sql('subject_id')}, subject_id) as idx, count(*) over () as n from (select subject_id, {cols} from FX_SUBJECT)),
      dr as (select rep, {fx.draw_sql('idx', 'rep', seed)} % n + 1 as pick from rw, (select unnest(range(1, {reps + 1})) as rep)),
      bs as (select rep, rw.* from dr join rw on rw.idx = dr.pick)"""


@query("bootstrap_mean_ci", f"""
    with {boot_sql('y_cv', 60)}, m as (select rep, avg(y_cv) as m from bs group by 1)
    select {r('median(m)', 6)} as median, {r('quantile_cont(m, 0.025)', 6)} as ci_lo, {r('quantile_cont(m, 0.975)', 6)} as ci_hi, count(*) as n_iter from m""", "FX_SUBJECT")
def _(spark, sf):
    return out(i.bootstrap_mean_ci(fx.subject_table(spark, sf), Y, "subject_id", 60), "n_iter", median=6, ci_lo=6, ci_hi=6)


@query("bootstrap_ols", f"""
    with {boot_sql('y_cv, covariate, f_click', 60)}, o as ({ols2('bs', 'y_cv', 'covariate', 'f_click', 'rep')}),
    l as (select 'const' as predictor, b0 as b from o union all select 'covariate', b1 from o union all select 'f_click', b2 from o)
    select predictor, {r('median(b)', 6)} as median, {r('quantile_cont(b, 0.025)', 6)} as ci_lo, {r('quantile_cont(b, 0.975)', 6)} as ci_hi, count(*) as n_iter from l group by 1""", "FX_SUBJECT")
def _(spark, sf):
    return out(i.bootstrap_ols(fx.subject_table(spark, sf), Y, ["covariate", "f_click"], "subject_id", 60), "predictor n_iter", median=6, ci_lo=6, ci_hi=6)


@query("hypothesis_test", f"""
    with {BLOCK}, l as (select 'f_click' as term, b1 as beta, se1 as se, t1 as t, 'positive' as direction from bf union all select 'f_view', b2, se2, t2, 'negative' from bf),
    p as (select l.*, bf.rc, bf.rf, bf.f_stat, bf.df, {t_p('l.t', 'bf.df')} as p2, (direction = 'positive' and beta > 0) or (direction = 'negative' and beta < 0) as ok from l, bf),
    q as (select *, case when ok then p2 / 2 else 1 - p2 / 2 end as p1 from p)
    select term, direction, ok as sign_matches, least(p1 * 2, 1) < 0.05 as significant, {r('beta', 6)} as beta, {r('se', 6)} as se, {r('t', 4)} as t, {r('p2', 5)} as p_two_sided,
      {r('p1', 5)} as p_one_sided, {r('least(p1 * 2, 1)', 5)} as p_corrected, {r('rc', 6)} as covariate_r2, {r('rf - rc', 6)} as delta_r2, {r('f_stat', 4)} as block_f, {r(F2P, 5)} as block_p from q""", "FX_GAPS")
def _(spark, sf):
    d = i.hypothesis_test(fx.subjects_gaps(spark, sf), Y, COV, FEATS, PRIORS, "subject_id")
    return out(d, "term direction sign_matches significant", beta=6, se=6, t=4, p_two_sided=5, p_one_sided=5, p_corrected=5,
               covariate_r2=6, delta_r2=6, block_f=4, block_p=5)


GRID = {"pair": ("f_click", "f_view"), "other": ("f_error", "f_purchase")}
GRID_PARTS = {"f_click": ["f_click", "f_dup"], "f_view": ["f_error", "f_view"], "f_purchase": ["f_purchase", "absent"]}


def _swept(src, over):
    """Target and both features of ``src`` without what the covariate explains."""
    rest = lambda c: f"{c} - regr_intercept({c}, covariate) over ({over}) - regr_slope({c}, covariate) over ({over}) * covariate"
    return f"select *, {rest('y_cv')} as ry, {rest('x1')} as r1, {rest('x2')} as r2 from {src}"


def _cell_sql(s, x1, x2):
    """CTEs of one cell: l_{s} with a row per feature."""
    boot = boot_sql("y_cv, covariate, x1, x2", 60).replace("FX_SUBJECT", f"cc_{s}")
    for name in ("rw", "dr", "bs"):
        boot = boot.replace(f"{name} as (", f"{name}_{s} as (").replace(f"from {name} ", f"from {name}_{s} ").replace(f"from {name},", f"from {name}_{s},").replace(f"join {name} on {name}.", f"join {name}_{s} on {name}_{s}.").replace(f"{name}.*", f"{name}_{s}.*").replace(f"= {name}.", f"= {name}_{s}.").replace(f"= dr.pick", f"= dr_{s}.pick")
    term = lambda i, x: f"select '{s}' as feature_set, '{x}' as term, b{i} as beta, se{i} as se, t{i} as t, rc, rf, df, f_stat, n from bf_{s}"
    conf = lambda i, x: (f"select '{s}' as feature_set, '{x}' as term, median(b{i}) as median, quantile_cont(b{i}, 0.025) as ci_lo, quantile_cont(b{i}, 0.975) as ci_hi, count(*) as n_iter from ob_{s}")
    return f"""cc_{s} as (select subject_id, y_cv, covariate, {x1} as x1, {x2} as x2 from FX_GAPS where {x1} is not null and {x2} is not null and y_cv is not null),
      fw_{s} as ({_swept(f'cc_{s}', '')}), o_{s} as (select *, r2 as part from ({ols2(f'fw_{s}', 'ry', 'r1', 'r2', '', True, 1)})),
      bl_{s} as (select *, rc + (1 - rc) * part as rf from o_{s}, (select regr_r2(y_cv, covariate) as rc from cc_{s})),
      bf_{s} as (select *, ((rf - rc) / 2) / ((1 - rf) / df) as f_stat from bl_{s}), l_{s} as ({term(1, x1)} union all {term(2, x2)}),
      {boot}, fb_{s} as ({_swept(f'bs_{s}', 'partition by rep')}), ob_{s} as ({ols2(f'fb_{s}', 'ry', 'r1', 'r2', 'rep')}), c_{s} as ({conf(1, x1)} union all {conf(2, x2)})"""


@query("hypothesis_grid", f"""
    with {', '.join(_cell_sql(s, *xs) for s, xs in GRID.items())},
    l as ({' union all '.join(f'select * from l_{s}' for s in GRID)}), cf as ({' union all '.join(f'select * from c_{s}' for s in GRID)}),
    al as (select 'f_click' as term, 2 * (1 - (var_samp(f_click) + var_samp(f_dup)) / var_samp(f_click + f_dup)) as alpha from FX_GAPS where f_click is not null
      union all select 'f_view', 2 * (1 - (var_samp(f_error) + var_samp(f_view)) / var_samp(f_error + f_view)) from FX_GAPS where f_view is not null and f_error is not null),
    ga as (select term, alpha, case when term = 'f_purchase' then false when term <> 'f_error' then alpha >= 0.5 end as pass_gate from l left join al using (term)),
    p as (select l.*, {t_p('l.t', 'df')} as p2, case term when 'f_click' then 'positive' when 'f_view' then 'negative' else 'two_sided' end as direction from l),
    q as (select *, case direction when 'positive' then beta > 0 when 'negative' then beta < 0 end as ok from p),
    w as (select *, case when ok then p2 / 2 when not ok then 1 - p2 / 2 else p2 end as p1 from q)
    select 'y_cv' as target, w.feature_set, w.term, direction, ok as sign_matches, least(p1 * 2, 1) < 0.05 as significant, pass_gate,
      coalesce(bool_and(pass_gate) over (partition by w.feature_set), false) as all_pass, n::bigint as n, n_iter, {r('beta', 6)} as beta, {r('se', 6)} as se, {r('p2', 5)} as p_two_sided,
      {r('p1', 5)} as p_one_sided, {r('least(p1 * 2, 1)', 5)} as p_corrected, {r('rc', 6)} as covariate_r2, {r('rf - rc', 6)} as delta_r2, {r('f_stat', 4)} as block_f, {r(F2P, 5)} as block_p,
      {r('alpha', 5)} as alpha, {r('median', 6)} as median, {r('ci_lo', 6)} as ci_lo, {r('ci_hi', 6)} as ci_hi
    from w join ga using (term) join cf using (feature_set, term)""", "FX_GAPS")
def _(spark, sf):
    sets = {s: list(xs) for s, xs in GRID.items()} | {"empty": ["f_none"]}
    d = fx.gaps_table(spark, sf).withColumn("f_none", F.lit(None).cast("double"))
    g = i.hypothesis_grid(d, [Y], {k: v for k, v in sets.items()}, COV, PRIORS, "subject_id", GRID_PARTS, reps=60)
    return out(g, "target feature_set term direction sign_matches significant pass_gate all_pass n n_iter", beta=6, se=6, p_two_sided=5, p_one_sided=5,
               p_corrected=5, covariate_r2=6, delta_r2=6, block_f=4, block_p=5, alpha=5, median=6, ci_lo=6, ci_hi=6)


@query("headline", f"""
    with {BLOCK} select 'y_cv' as target, 'pair' as feature_set, n as n_used, (select count(*) from FX_GAPS) - n as n_dropped, null::varchar as skipped,
      {r('rf', 6)} as full_r2, {r('rc', 6)} as covariate_r2, {r('f_stat', 4)} as f_stat, {r(F2P, 5)} as p_value from bf
    union all select 'y_cv', 'empty', 0, count(*), 'insufficient_complete_rows', null, null, null, null from FX_GAPS""", "FX_GAPS")
def _(spark, sf):
    d = fx.gaps_table(spark, sf).withColumn("f_none", F.lit(None).cast("double"))
    h = i.run_tests(d, [Y], {"pair": FEATS, "empty": ["f_none"]}, COV, {}, "subject_id")
    return out(h, "target feature_set n_used n_dropped skipped", full_r2=6, covariate_r2=6, f_stat=4, p_value=5)


LONG = " union all ".join(f"select '{x}' as term, y_cv, covariate, {x} as x from FX_GAPS where {x} is not null" for x in SCAN)
SCANQ = f"""lg as ({LONG}), o as ({ols2('lg', 'y_cv', 'covariate', 'x', 'term')}), rc as (select term, regr_r2(y_cv, covariate) as rc from lg group by 1),
  sc as (select *, {t_p('t2', 'df')} as p from o join rc using (term)), k as (select *, row_number() over (order by p, term) as i, count(*) over () as nt from sc)"""


@query("univariate_scan", f"""
    with {SCANQ} select term, n as n_used, {r('b2', 6)} as beta, {r('se2', 6)} as se, {r('t2', 4)} as t, {r('sign(t2) * sqrt(t2 * t2 / (t2 * t2 + df))', 5)} as partial_r,
      {r('r2 - rc', 6)} as delta_r2, {r('(r2 - rc) / ((1 - r2) / df)', 4)} as f_1df, {r('p', 5)} as p_two_sided,
      {r(BH.replace('* n /', '* nt /'), 5)} as p_corrected from k""", "FX_GAPS")
def _(spark, sf):
    d = i.univariate_scan(fx.subjects_gaps(spark, sf), Y, COV, SCAN)
    return out(d, "term n_used", beta=6, se=6, t=4, partial_r=5, delta_r2=6, f_1df=4, p_two_sided=5, p_corrected=5)


@query("loo_ols", f"""
    with s as (select *, count(*) over () as n, avg(covariate) over () as mx, var_pop(covariate) over () * count(*) over () as sxx,
      regr_intercept(y_cv, covariate) over () + regr_slope(y_cv, covariate) over () * covariate as fit from FX_SUBJECT)
    select subject_id, {r('fit', 6)} as fitted, {r('y_cv - (y_cv - fit) / (1 - 1.0 / n - (covariate - mx) * (covariate - mx) / sxx)', 6)} as loo from s""", "FX_SUBJECT")
def _(spark, sf):
    return out(i.loo_predict(fx.subject_table(spark, sf), Y, COV), "subject_id", fitted=6, loo=6)


LOO2 = f"""o as ({ols2('FX_SUBJECT', 'y_cv', 'covariate', 'f_click')}),
  lf as (select subject_id, y_cv, b0 + b1 * covariate + b2 * f_click as fit, 1.0 / n + ((covariate - m1) * (covariate - m1) * s22 - 2 * (covariate - m1) * (f_click - m2) * s12
      + (f_click - m2) * (f_click - m2) * s11) / det as h, regr_intercept(y_cv, covariate) over () + regr_slope(y_cv, covariate) over () * covariate as fc,
      1.0 / n + (covariate - m1) * (covariate - m1) / s11 as hc from FX_SUBJECT, o),
  lo as (select *, y_cv - (y_cv - fit) / (1 - h) as loo, y_cv - (y_cv - fc) / (1 - hc) as loo_cov from lf),
  ag as (select count(*) as n, avg(y_cv) as m, stddev_samp(y_cv) as sd, stddev_samp(y_cv - loo) as sigma, var_samp(loo) as tau2, 1 - sum(pow(y_cv - loo, 2)) / (var_pop(y_cv) * count(*)) as r2,
    1 - sum(pow(y_cv - loo_cov, 2)) / (var_pop(y_cv) * count(*)) as r2c, 1 - sum(pow(y_cv - fit, 2)) / (var_pop(y_cv) * count(*)) as r2_in from lo)"""
TCRIT = ("(1.959963984540054 + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3))"
         " + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(v, 4))"
         " + (27 * pow(z, 11) + 339 * pow(z, 9) + 930 * pow(z, 7) - 1782 * pow(z, 5) - 765 * pow(z, 3) + 17955 * z) / (368640 * pow(v, 5)))")


@query("screening_index", f"""
    with {LOO2}, g as (select *, tau2 / (tau2 + sigma * sigma) as w, (r2 - r2c) / ((1 - r2) / (n - 3)) as f_inc, 1.959963984540054::double as z, (n - 1)::double as v from ag),
    p as (select *, case when f_inc > 0 then {t_p('sqrt(greatest(f_inc, 0))', 'n - 3')} else 1 end as p_inc, {TCRIT} as tc from g),
    s as (select subject_id, lo.y_cv, loo, w * loo + (1 - w) * m as shrunk, p.* from lo, p),
    k as (select *, (rank() over (order by shrunk) + (count(*) over (partition by shrunk) - 1) / 2.0) / count(*) over () * 100 as pct from s)
    select subject_id, {r('loo', 6)} as loo, {r('shrunk', 6)} as shrunk, {r('pct', 3)} as percentile, {r('shrunk - tc * sigma', 5)} as pi_lo, {r('shrunk + tc * sigma', 5)} as pi_hi,
      {r('w', 6)} as shrinkage, {r('r2', 6)} as loo_r2_full, {r('r2c', 6)} as loo_r2_cov, {r('f_inc', 4)} as f_inc, {r('p_inc', 5)} as p_inc,
      case when p_inc < 0.05 then 'incremental_eeg_signal' else 'score_approximates_age_only_proxy' end as confidence_flag from k""", "FX_SUBJECT")
def _(spark, sf):
    d = i.screening_index(fx.subjects(spark, sf), Y, COV, ["f_click"], "subject_id")
    return out(d, "subject_id confidence_flag", loo=6, shrunk=6, percentile=3, pi_lo=5, pi_hi=5, shrinkage=6, loo_r2_full=6, loo_r2_cov=6, f_inc=4, p_inc=5)


@query("pct_rank_avg", f"""select c_custkey, {r('(rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0) / count(*) over () * 100', 5)} as percentile from customer""")
def _(spark, sf):
    c = fx.load(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("c_acctbal").alias("k"))
    ranks = average_rank_pct(c, "k", "c_acctbal").select("c_acctbal", (F.col("pct_rank") * 100).alias("percentile"))
    return out(c.join(ranks, "c_acctbal"), "c_custkey", percentile=5)


@query("fit_points", f"""with {LOO2} select subject_id, {r('(lo.y_cv - m) / sd', 5)} as observed_z, {r('(fit - m) / sd', 5)} as fitted_z, {r('ag.r2_in', 6)} as r2, {r('ag.r2', 6)} as loo_r2 from lo, ag""", "FX_SUBJECT")
def _(spark, sf):
    return out(i.fit_points(fx.subject_table(spark, sf), Y, ["covariate", "f_click"], "subject_id"), "subject_id", observed_z=5, fitted_z=5, r2=6, loo_r2=6)


def _scan_by(src, tag):
    rows = " union all ".join(f"select '{x}' as term, y_cv, covariate, {x} as x from {src} where {x} is not null" for x in SCAN)
    return f"lg{tag} as ({rows}), o{tag} as ({ols2(f'lg{tag}', 'y_cv', 'covariate', 'x', 'term')})"


@query("baseline_consistency", f"""
    with {_scan_by('FX_SUBJECT', '1')}, {_scan_by('FX_GAPS', '2')}, j as (select o1.b2 as b1, abs(o1.t2) as t1, o2.b2 as b2, abs(o2.t2) as t2 from o1 join o2 using (term)),
    k as (select *, rank() over (order by t1) + (count(*) over (partition by t1) - 1) / 2.0 as r1, rank() over (order by t2) + (count(*) over (partition by t2) - 1) / 2.0 as r2 from j),
    m as (select count(*) as n, corr(r1, r2) as rho, avg((sign(b1) = sign(b2))::int) as sa, corr(b1, b2) as br from k)
    select 'y_cv' as target, n as n_features, {r('rho', 5)} as spearman_abs_t, {r('sa', 5)} as sign_agreement, {r('br', 5)} as beta_pearson_r, rho >= 0.5 and sa >= 0.75 as consistent from m""", ("FX_SUBJECT", "FX_GAPS"))
def _(spark, sf):
    a = i.univariate_scan(fx.subjects(spark, sf), Y, COV, SCAN).select(F.lit("y_cv").alias("target"), "term", "beta", "t")
    b = i.univariate_scan(fx.subjects_gaps(spark, sf), Y, COV, SCAN).select(
        F.lit("y_cv").alias("target"), F.concat(F.lit("rest_"), "term").alias("term"), "beta", "t")
    return out(i.baseline_consistency(a, b, "^rest_"), "target n_features consistent", spearman_abs_t=5, sign_agreement=5, beta_pearson_r=5)
