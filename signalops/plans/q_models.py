"""Queries: resampling, model grid, decoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalops.functions.lineage import cut
from signalops.functions.present import shown_sql as r
from signalops.operators import decode as d, resampling as m
from signalops.plans import fixtures as fx
from signalops.plans.q_inference import F2P, block_sql, ols2, t_p
from signalops.plans.registry import out, query

Y = "y_cv"
CLASSES = [0, 1, 2, 3]
ANCHORS = {0: (0.7071, 0.7071), 1: (0.7071, -0.7071), 2: (-0.7071, -0.7071), 3: (-0.7071, 0.7071)}
CODES = {0: "H", 1: "C", 2: "S", 3: "F"}
SCHEMES = {"theory": ["f_click", "f_view"], "data_driven": fx.FEATURES, "hybrid": fx.FEATURES}


# ---------------------------------------------------------------- preparation

@query("median_impute", f"""select subject_id, {r('coalesce(f_click, (select median(f_click) from FX_GAPS))', 6)} as f_click,
    {r('coalesce(f_view, (select median(f_view) from FX_GAPS))', 6)} as f_view from FX_GAPS""", "FX_GAPS")
def _(spark, sf):
    return out(m.median_impute(fx.gaps_table(spark, sf), ["f_click", "f_view"]), "subject_id", f_click=6, f_view=6)


FOLD = f"fl as (select *, (row_number() over (order by {fx.draw_sql('subject_id')}, subject_id) - 1) % 5 as fold from FX_SUBJECT)"


@query("zscore_by_fold", f"""
    with {FOLD}, st as (select f.fold, avg(f_click) as m1, stddev_pop(f_click) as s1, avg(covariate) as m2, stddev_pop(covariate) as s2
      from (select unnest(range(0, 5)) as fold) f join fl on fl.fold <> f.fold group by 1)
    select subject_id, fold, {r('(f_click - m1) / s1', 5)} as f_click, {r('(covariate - m2) / s2', 5)} as covariate from fl join st using (fold)""", "FX_SUBJECT")
def _(spark, sf):
    f = m.assign_folds(fx.subject_table(spark, sf), "subject_id", 5)
    return out(m.zscore_by_fold(f, ["f_click", "covariate"], "subject_id"), "subject_id fold", f_click=5, covariate=5)


@query("kbest_f", f"""select feature, n, {r('rr / (1 - rr) * (n - 2)', 5)} as f_score from ({' union all '.join(
    f"select '{x}' as feature, count({x}) as n, regr_r2(y_cv, {x}) as rr from FX_GAPS" for x in fx.FEATURES)}) order by rr / (1 - rr) * (n - 2) desc, feature limit 3""", "FX_GAPS")
def _(spark, sf):
    return out(m.kbest(fx.subjects_gaps(spark, sf), Y, fx.FEATURES, 3), "feature n", f_score=5)


@query("kfold_assign", f"""
    select c_custkey, rep, (row_number() over (partition by rep order by {fx.draw_sql('c_custkey', 'rep')}, c_custkey) - 1) % 5 as fold
    from customer, (select unnest(range(0, 3)) as rep)""")
def _(spark, sf):
    return m.repeated_folds(fx.load(spark, sf, "customer").select("c_custkey"), "c_custkey", 5, 3).select("c_custkey", "rep", "fold")


@query("oof_scores", f"""
    with {FOLD}, md as (select f.fold, regr_slope(y_cv, f_click) as b, regr_intercept(y_cv, f_click) as a from (select unnest(range(0, 5)) as fold) f join fl on fl.fold <> f.fold group by 1),
    pr as (select fold, y_cv, a + b * f_click as p from fl join md using (fold)),
    fs as (select fold, 1 - sum(pow(y_cv - p, 2)) / (var_pop(y_cv) * count(*)) as r2, avg(abs(y_cv - p)) as mae from pr group by 1)
    select {r('avg(r2)', 6)} as oof_r2, {r('avg(mae)', 6)} as oof_mae, {r('(select avg(abs(y_cv - (select avg(y_cv) from fl))) from fl)', 6)} as baseline_mae from fs""", "FX_SUBJECT")
def _(spark, sf):
    f = m.assign_folds(fx.subject_table(spark, sf).select("subject_id", Y, "f_click"), "subject_id", 5)
    return out(m.oof_scores(m.oof_simple(f, Y, "f_click", "subject_id"), Y), "", oof_r2=6, oof_mae=6, baseline_mae=6)


def _perm_sql(feats, reps):
    o = ", ".join(f"abs(corr({x}, y_cv)) as o_{x}" for x in feats)
    n = ", ".join(f"abs(corr({x}, yp)) as n_{x}" for x in feats)
    return f"""with rw as (select subject_id, y_cv, {', '.join(feats)}, row_number() over (order by {fx.draw_sql('subject_id')}, subject_id) as idx from FX_SUBJECT),
      rk as (select rw.*, rep, row_number() over (partition by rep order by {fx.draw_sql('idx', 'rep')}, idx) as rn from rw, (select unnest(range(1, {reps + 1})) as rep)),
      pm as (select rk.*, b.y_cv as yp from rk join rw b on b.idx = rk.rn), nl as (select rep, {n}, greatest({', '.join(f'abs(corr({x}, yp))' for x in feats)}, 0) as top from pm group by 1),
      ob as (select {o} from FX_SUBJECT) """ + " union all ".join(
        f"""select '{x}' as feature, {r(f'max(o_{x})', 6)} as observed, {r(f'avg((n_{x} >= o_{x})::int)', 6)} as p_perm, {r(f'avg((top >= o_{x})::int)', 6)} as p_max, count(*) as n_perm from nl, ob""" for x in feats)


@query("perm_p_corr", _perm_sql(["f_click"], 60), "FX_SUBJECT")
def _(spark, sf):
    return out(m.permutation_p(fx.subject_table(spark, sf), Y, ["f_click"], "subject_id", 60), "feature n_perm", observed=6, p_perm=6, p_max=6)


@query("perm_maxstat", _perm_sql(["f_click", "f_view", "f_error"], 60), "FX_SUBJECT")
def _(spark, sf):
    return out(m.permutation_p(fx.subject_table(spark, sf), Y, ["f_click", "f_view", "f_error"], "subject_id", 60), "feature n_perm", observed=6, p_perm=6, p_max=6)


@query("elastic_net_oof")
def _(spark, sf):
    f = m.repeated_folds(fx.subject_table(spark, sf).select("subject_id", Y, "covariate", *fx.FEATURES), "subject_id", 5, 2)
    return out(m.elastic_net_oof(f, Y, ["covariate", *fx.FEATURES], "subject_id"), "subject_id rep fold", pred=5)


@query("ml_grid")
def _(spark, sf):
    g = m.ml_grid(fx.subject_table(spark, sf), [Y], {"theory": SCHEMES["theory"], "data_driven": SCHEMES["data_driven"]}, ["covariate"], "subject_id",
                  k=2, repeats=1, trees=5, kbest_k=3)
    return out(g, "target scheme model n_features use_kbest", oof_r2=4, oof_mae=4, baseline_mae=4)


@query("grid_permutation")
def _(spark, sf):
    g = m.grid_permutation(fx.subject_table(spark, sf), Y, SCHEMES, ["covariate"], "subject_id", reps=100, k=3)
    return out(g, "scheme n_perm", oof_r2=4, perm_p=4, perm_p_selection_corrected=4)


# ---------------------------------------------------------------- decoder

ELIG = """el as (select *, greatest(2, least(5, min(n_windows) over (partition by subject_id))) as folds, count(*) over (partition by subject_id) as n_classes
    from (select subject_id, label, count(*) as n_windows from FX_WINDOWS group by 1, 2 having count(*) >= 7))"""


@query("eligible_classes", f"with {ELIG} select subject_id, label, n_windows, n_classes, folds::bigint as folds from el where n_classes >= 2", "FX_WINDOWS")
def _(spark, sf):
    return d.eligible_classes(fx.windows(spark, sf), minimum=7).select("subject_id", "label", "n_windows", "n_classes", "folds")


SFOLD = f"wf as (select *, (row_number() over (partition by subject_id, label order by {fx.draw_sql('vec_id')}, vec_id) - 1) % 5 as fold from FX_WINDOWS)"


def _folded(spark, sf):
    # Model and rows both read the folded windows, so they are stored once.
    return cut(d.stratified_folds(fx.windows(spark, sf), "vec_id", 5))


@query("stratified_folds", f"with {SFOLD} select subject_id, label, vec_id, fold from wf", "FX_WINDOWS")
def _(spark, sf):
    return _folded(spark, sf).select("subject_id", "label", "vec_id", "fold")


def scaled_sql(train, keys):
    """CTEs md (medians), sc (mean, sd), tz (scaled training rows) and ct (class means) of the training rows ``train``."""
    return f"""md as (select {keys}, median(w0) as d0, median(w1) as d1 from {train} group by {keys}),
  im as (select {train}.*, coalesce(w0, d0) as i0, coalesce(w1, d1) as i1 from {train} join md using ({keys})),
  sc as (select {keys}, avg(i0) as a0, stddev_pop(i0) as s0, avg(i1) as a1, stddev_pop(i1) as s1 from im group by {keys}),
  tz as (select * exclude (w0, w1), (i0 - a0) / s0 as w0, (i1 - a1) / s1 as w1 from im join sc using ({keys})),
  ct as (select {keys}, label as c, avg(w0) as m0, avg(w1) as m1, count(*) as n from tz group by {keys}, label)"""


NC = f"""{SFOLD}, fk as (select distinct subject_id, fold from wf),
  tr as (select f.subject_id, f.fold, w.label, w.w0, w.w1 from fk f join wf w on f.subject_id = w.subject_id and f.fold <> w.fold), {scaled_sql('tr', 'subject_id, fold')},
  hz as (select wf.subject_id, wf.vec_id, wf.fold, wf.label, (coalesce(w0, d0) - a0) / s0 as w0, (coalesce(w1, d1) - a1) / s1 as w1
    from wf join md using (subject_id, fold) join sc using (subject_id, fold))"""


@query("nearest_centroid_oof", f"""
    with {NC}, ds as (select hz.vec_id, hz.subject_id, hz.fold, hz.label, c, row_number() over (partition by vec_id order by pow(w0 - m0, 2) + pow(w1 - m1, 2), c) as i from hz join ct using (subject_id, fold))
    select subject_id, vec_id, fold, label, c as pred from ds where i = 1""", "FX_WINDOWS")
def _(spark, sf):
    p = d.nearest_centroid_oof(_folded(spark, sf), ["w0", "w1"], "vec_id")
    return p.select("subject_id", "vec_id", "fold", "label", "pred")


def lda_sql(keys):
    """CTEs cv (pooled covariance) and wt (weights of the classes) after ``scaled_sql``."""
    on = " and ".join(f"ct.{k} = tz.{k}" for k in keys.split(", "))
    scatter = lambda x, y: f"sum((tz.w{x} - m{x}) * (tz.w{y} - m{y})) / (count(*) - count(distinct ct.c))"
    tk = ", ".join(f"tz.{k}" for k in keys.split(", "))
    return f"""cv as (select {tk}, {scatter(0, 0)} as a, {scatter(0, 1)} as b, {scatter(1, 1)} as d, count(*) as nt from tz join ct on {on} and ct.c = tz.label group by {tk}),
  wt as (select ct.*, nt, (d * m0 - b * m1) / (a * d - b * b) as k0, (a * m1 - b * m0) / (a * d - b * b) as k1 from ct join cv using ({keys}))"""


LDA = f"""{NC}, {lda_sql('subject_id, fold')},
  ll as (select hz.subject_id, hz.vec_id, hz.fold, hz.label, c, k0 * w0 + k1 * w1 - 0.5 * (k0 * m0 + k1 * m1) + ln(n / nt) as s from hz join wt using (subject_id, fold)),
  ps as (select *, exp(s - max(s) over (partition by vec_id)) as e from ll), po as (select *, e / sum(e) over (partition by vec_id) as p, row_number() over (partition by vec_id order by s desc, c) as i from ps)"""


@query("lda_oof", f"with {LDA} select subject_id, vec_id, fold, label, c as pred, {r('p', 5)} as confidence from po where i = 1", "FX_WINDOWS")
def _(spark, sf):
    p = d.lda_oof(_folded(spark, sf), ["w0", "w1"])
    return out(p.withColumn("confidence", F.element_at("posterior", F.col("pred"))), "subject_id vec_id fold label pred", confidence=5)


def _top_pred(w):
    """Class with the largest of the four probability columns."""
    best = F.greatest("p0", "p1", "p2", "p3")
    return F.when(F.col("p0") == best, 0).when(F.col("p1") == best, 1).when(F.col("p2") == best, 2).otherwise(3).cast("bigint")


PRED = "case when p0 >= greatest(p1, p2, p3) then 0 when p1 >= greatest(p2, p3) then 1 when p2 >= p3 then 2 else 3 end"


@query("confusion_matrix", f"""
    with g as (select s.subject_id, t."true", p.pred from (select distinct subject_id from FX_WINDOWS) s, (select unnest(range(0, 4)) as "true") t, (select unnest(range(0, 4)) as pred) p)
    select g.subject_id, "true", g.pred, count(vec_id) as "count" from g left join (select subject_id, vec_id, label, {PRED} as pred from FX_WINDOWS) w
      on w.subject_id = g.subject_id and w.label = g."true" and w.pred = g.pred group by 1, 2, 3""", "FX_WINDOWS")
def _(spark, sf):
    w = fx.windows(spark, sf)
    c = d.confusion(w.withColumn("pred", _top_pred(w)), CLASSES, ["subject_id"])
    return out(c, "subject_id true pred count")


@query("fold_accuracy", f"""
    with {SFOLD}, a as (select subject_id, fold, avg((label = {PRED})::int) as acc, count(*) as n from wf group by 1, 2)
    select subject_id, {r('avg(acc)', 6)} as acc_mean, {r('stddev_pop(acc)', 6)} as acc_sd, sum(n)::bigint as n_windows, k as n_classes, {r('1.0 / k', 6)} as chance
    from a join (select subject_id, count(distinct label) as k from FX_WINDOWS group by 1) using (subject_id) group by 1, k""", "FX_WINDOWS")
def _(spark, sf):
    w = _folded(spark, sf)
    return out(d.fold_accuracy(w.withColumn("pred", _top_pred(w)), ["subject_id"]), "subject_id n_windows n_classes", acc_mean=6, acc_sd=6, chance=6)


def _va(spark, sf):
    return d.project_va(fx.windows(spark, sf), {k: f"p{k}" for k in CLASSES}, ANCHORS)


@query("project_va", f"select vec_id, {r('va_v', 6)} as v, {r('va_a', 6)} as a from FX_VA", "FX_VA")
def _(spark, sf):
    return out(_va(spark, sf), "vec_id", v=6, a=6)


@query("va_geometry", f"""
    with ce as (select subject_id, label, avg(va_v) as cv, avg(va_a) as ca from FX_VA group by 1, 2),
    sp as (select a.subject_id, avg(sqrt(pow(a.cv - b.cv, 2) + pow(a.ca - b.ca, 2))) as sep from ce a join ce b on a.subject_id = b.subject_id and a.label < b.label group by 1),
    ds as (select f.subject_id, avg(sqrt(pow(va_v - cv, 2) + pow(va_a - ca, 2))) as disp, avg(va_v) as v, avg(va_a) as a from FX_VA f join ce using (subject_id, label) group by 1)
    select subject_id, {r('v', 6)} as centroid_v, {r('a', 6)} as centroid_a, {r('sqrt(v * v + a * a)', 6)} as centroid_offset, {r('sep', 6)} as separation, {r('disp', 6)} as dispersion from ds left join sp using (subject_id)""", "FX_VA")
def _(spark, sf):
    return out(d.va_geometry(_va(spark, sf), CLASSES), "subject_id", centroid_v=6, centroid_a=6, centroid_offset=6, separation=6, dispersion=6)


@query("silhouette", f"""
    with pr as (select a.subject_id, a.vec_id, a.label as own, b.label as other, sum(sqrt(pow(a.va_v - b.va_v, 2) + pow(a.va_a - b.va_a, 2))) as s, count(*) as n
      from FX_VA a join FX_VA b on a.subject_id = b.subject_id group by 1, 2, 3, 4),
    ab as (select subject_id, vec_id, max(case when own = other and n > 1 then s / (n - 1) end) as a, min(case when own <> other then s / n end) as b from pr group by 1, 2),
    k as (select subject_id, count(distinct label) as k, count(*) as n from FX_VA group by 1)
    select subject_id, {r('case when max(k) >= 2 and max(n) > max(k) then avg(case when a is null then 0 else (b - a) / greatest(a, b) end) end', 6)} as silhouette from ab join k using (subject_id) group by 1""", "FX_VA")
def _(spark, sf):
    return out(d.silhouette(_va(spark, sf), block=16), "subject_id", silhouette=6)


CENT = {f"va_{s}{x}": (c, x) for c, s in CODES.items() for x in ("v", "a")}


@query("class_centroids", "select subject_id, " + ", ".join(r(f"avg(case when label = {c} then va_{x} end)", 6) + f' as "{n}"' for n, (c, x) in CENT.items()) + " from FX_VA group by 1", "FX_VA")
def _(spark, sf):
    return out(d.class_centroids(_va(spark, sf), CODES), "subject_id", **{n: 6 for n in CENT})


REST = f"""lw as (select subject_id, label, w0, w1 from FX_WINDOWS where condition = 'ec'), {scaled_sql('lw', 'subject_id')}, {lda_sql('subject_id')},
  rw as (select subject_id, vec_id, (coalesce(w0, d0) - a0) / s0 as w0, (coalesce(w1, d1) - a1) / s1 as w1 from FX_WINDOWS join md using (subject_id) join sc using (subject_id) where condition = 'eo'),
  ll as (select rw.subject_id, vec_id, c, exp(k0 * w0 + k1 * w1 - 0.5 * (k0 * m0 + k1 * m1) + ln(n / nt)) as e from rw join wt using (subject_id)),
  po as (select *, e / sum(e) over (partition by vec_id) as p from ll),
  va as (select subject_id, vec_id, sum(p * case c when 0 then 0.7071 when 1 then 0.7071 else -0.7071 end) as v, sum(p * case c when 0 then 0.7071 when 3 then 0.7071 else -0.7071 end) as a from po group by 1, 2)"""


@query("project_rest", f"with {REST} select subject_id, {r('avg(v)', 5)} as precursor_v, {r('avg(a)', 5)} as precursor_a, {r('sqrt(pow(avg(v), 2) + pow(avg(a), 2))', 5)} as precursor_offset from va group by 1", "FX_WINDOWS")
def _(spark, sf):
    w = fx.windows(spark, sf)
    p = d.project_rest(w.where("condition = 'ec'"), w.where("condition = 'eo'").select("subject_id", "vec_id", "w0", "w1"), ["w0", "w1"])
    return out(d.rest_offset(d.posterior_va(p, ANCHORS)), "subject_id", precursor_v=5, precursor_a=5, precursor_offset=5)


GEO = ["va_Hv", "va_Ha", "va_Cv", "va_Ca"]


GEO_VIEW = f"""ce as (select subject_id, label, avg(va_v) as cv, avg(va_a) as ca from FX_VA group by 1, 2),
  sp as (select a.subject_id, avg(sqrt(pow(a.cv - b.cv, 2) + pow(a.ca - b.ca, 2))) as separation from ce a join ce b on a.subject_id = b.subject_id and a.label < b.label group by 1),
  ds as (select f.subject_id, avg(sqrt(pow(va_v - cv, 2) + pow(va_a - ca, 2))) as dispersion, avg(w5) as target, avg(w4) as covariate from FX_VA f join ce using (subject_id, label) group by 1),
  cc0 as (select subject_id, {', '.join(f'max(case when label = {c} then {col} end) as "va_{s}{x}"' for c, s in ((0, 'H'), (1, 'C')) for x, col in (('v', 'cv'), ('a', 'ca')))} from ce group by 1),
  mg as (select * from ds left join sp using (subject_id) left join cc0 using (subject_id))"""


def _geometry_sql():
    feats = [("asm_va", g) for g in GEO] + [("asm_geometry", g) for g in ("separation", "dispersion")]
    rows = " union all ".join(f"""select '{s}' as feature_set, '{g}' as term, target, covariate, "{g}" as x from mg where "{g}" is not null""" for s, g in feats)
    return f"""with {GEO_VIEW}, lg as ({rows}),
      o as ({ols2('lg', 'target', 'covariate', 'x', 'feature_set, term')}), pv as (select *, {t_p('t2', 'df')} as p from o),
      k as (select *, row_number() over (partition by feature_set order by p, term) as i, count(*) over (partition by feature_set) as nt from pv)
      select feature_set, term, n as n_used, {r('b2', 5)} as beta, {r('t2', 4)} as t, {r('p', 5)} as p_two_sided,
        {r('least(1, min(p * nt / i) over (partition by feature_set order by i desc rows between unbounded preceding and current row))', 5)} as p_corrected from k"""


def _geometry(spark, sf):
    """Geometry per subject; the target is the subject mean of an embedding column not used in it."""
    va = cut(_va(spark, sf))
    geo = d.class_centroids(va, {0: "H", 1: "C"}).join(d.va_geometry(va, CLASSES).select("subject_id", "separation", "dispersion"), "subject_id")
    full = va.groupBy("subject_id").agg(F.avg("w5").alias("target"), F.avg("w4").alias("covariate"))
    return d.predict_from_geometry(full, geo, "target", ["covariate"], "subject_id")


@query("predict_from_geometry", _geometry_sql(), "FX_VA")
def _(spark, sf):
    return out(_geometry(spark, sf)[0], "feature_set term n_used", beta=5, t=4, p_two_sided=5, p_corrected=5)


GEO_FW = GEO_VIEW + """, cc as (select * from mg where separation is not null and dispersion is not null),
  fw as (select target, covariate, target - regr_intercept(target, covariate) over () - regr_slope(target, covariate) over () * covariate as ry,
    separation - regr_intercept(separation, covariate) over () - regr_slope(separation, covariate) over () * covariate as r1,
    dispersion - regr_intercept(dispersion, covariate) over () - regr_slope(dispersion, covariate) over () * covariate as r2 from cc)"""


@query("predict_from_geometry_block", f"""with {block_sql(GEO_FW, 'target')} select 'asm_geometry' as feature_set, n as n_used, {r('rf', 5)} as full_r2, {r('rc', 5)} as covariate_r2,
    {r('f_stat', 4)} as f_stat, {r(F2P, 5)} as p_value from bf""", "FX_VA")
def _(spark, sf):
    h = _geometry(spark, sf)[1].where("feature_set = 'asm_geometry'")
    return out(h, "feature_set n_used", full_r2=5, covariate_r2=5, f_stat=4, p_value=5)


@query("decoder_rollup", f"""
    with {NC}, ds as (select hz.vec_id, hz.subject_id, hz.fold, hz.label, c, row_number() over (partition by vec_id order by pow(w0 - m0, 2) + pow(w1 - m1, 2), c) as i from hz join ct using (subject_id, fold)),
    pr as (select 'centroid' as model, subject_id, fold, (label = c)::int as hit from ds where i = 1 union all select 'softmax', subject_id, fold, (label = {PRED})::int from wf),
    ac as (select model, subject_id, avg(a) as acc from (select model, subject_id, fold, avg(hit) as a from pr group by 1, 2, 3) group by 1, 2)
    select model, count(*) as n_subjects, {r('avg(acc)', 6)} as mean_accuracy from ac group by 1""", "FX_WINDOWS")
def _(spark, sf):
    w = _folded(spark, sf)
    a = d.nearest_centroid_oof(w, ["w0", "w1"], "vec_id").select(F.lit("centroid").alias("model"), "subject_id", "fold", "label", "pred")
    b = w.select(F.lit("softmax").alias("model"), "subject_id", "fold", "label", _top_pred(w).alias("pred"))
    return out(d.decoder_rollup(d.fold_accuracy(a.unionByName(b), ["model", "subject_id"])), "model n_subjects", mean_accuracy=6)


CHAIN = f"""rows_ as (select distinct subject_id, vec_id, label from FX_CELLS where condition = 'ec'),
  per as (select subject_id, label, count(*) as n from rows_ group by 1, 2),
  el as (select *, greatest(2, least(5, min(n) over (partition by subject_id))) as folds, count(*) over (partition by subject_id) as k from per where n >= 5),
  wf as (select r.subject_id, r.vec_id, r.label, folds, (row_number() over (partition by r.subject_id, r.label order by {fx.draw_sql('vec_id')}, vec_id) - 1) % folds as fold
    from rows_ r join el using (subject_id, label) where k >= 2),
  fk as (select distinct subject_id, fold from wf union all select distinct subject_id, -1 from wf),
  tr as (select f.subject_id, f.fold, w.vec_id, w.label, c.i, c.v from fk f join wf w on w.subject_id = f.subject_id and w.fold <> f.fold join FX_CELLS c on c.vec_id = w.vec_id),
  md as (select subject_id, fold, i, median(v) as d from tr group by all),
  im as (select tr.*, coalesce(v, d) as x from tr join md using (subject_id, fold, i)),
  sc as (select subject_id, fold, i, avg(x) as a, stddev_pop(x) as s from im group by all),
  tz as (select im.subject_id, im.fold, im.i, label, (x - a) / s as z from im join sc using (subject_id, fold, i)),
  cm as (select subject_id, fold, i, label as c, avg(z) as m, count(*) as n from tz group by all),
  pv as (select tz.subject_id, tz.fold, tz.i, sum((z - m) * (z - m)) / (count(*) - count(distinct c)) as pv, count(*) as nt from tz join cm
    on cm.subject_id = tz.subject_id and cm.fold = tz.fold and cm.i = tz.i and cm.c = tz.label group by all),
  k0 as (select subject_id, fold, c, ln(max(n) / max(nt)) - 0.5 * sum(m * m / pv) as k0 from cm join pv using (subject_id, fold, i) group by all),
  al as (select subject_id, vec_id, label, fold, false as rest from wf union all
    select distinct subject_id, vec_id, label, -1, true from FX_CELLS where condition = 'eo' and subject_id in (select subject_id from wf)),
  az as (select al.subject_id, al.vec_id, al.fold, al.label, rest, c.i, (coalesce(c.v, d) - a) / s as z from al join FX_CELLS c on c.vec_id = al.vec_id
    join md on md.subject_id = al.subject_id and md.fold = al.fold and md.i = c.i join sc on sc.subject_id = al.subject_id and sc.fold = al.fold and sc.i = c.i),
  ss as (select az.subject_id, vec_id, label, rest, az.fold, cm.c, sum(z * m / pv) + max(k0) as s from az join cm on cm.subject_id = az.subject_id and cm.fold = az.fold and cm.i = az.i
    join pv on pv.subject_id = az.subject_id and pv.fold = az.fold and pv.i = az.i join k0 on k0.subject_id = az.subject_id and k0.fold = az.fold and k0.c = cm.c group by all),
  ee as (select *, exp(s - max(s) over (partition by vec_id)) as e, row_number() over (partition by vec_id order by s desc, c) as place from ss),
  po as (select *, e / sum(e) over (partition by vec_id) as p from ee),
  va as (select subject_id, vec_id, label, rest, fold, sum(p * case c when 0 then 0.7071 when 1 then 0.7071 else -0.7071 end) as v,
    sum(p * case c when 0 then 0.7071 when 3 then 0.7071 else -0.7071 end) as a, max(case when place = 1 then c end) as pred from po group by all),
  fa as (select subject_id, fold, avg((pred = label)::int) as acc, count(*) as n from va where not rest group by 1, 2),
  ac as (select subject_id, avg(acc) as acc_mean, stddev_pop(acc) as acc_sd, sum(n) as n_windows from fa group by 1),
  ce as (select subject_id, label, avg(v) as cv, avg(a) as ca from va where not rest group by 1, 2),
  sp as (select x.subject_id, avg(sqrt(pow(x.cv - y.cv, 2) + pow(x.ca - y.ca, 2))) as separation from ce x join ce y on x.subject_id = y.subject_id and x.label < y.label group by 1),
  ds as (select subject_id, avg(v) as centroid_v, avg(a) as centroid_a, avg(sqrt(pow(v - cv, 2) + pow(a - ca, 2))) as dispersion from va join ce using (subject_id, label) where not rest group by 1),
  pr as (select x.subject_id, x.vec_id, x.label as own, y.label as other, sum(sqrt(pow(x.v - y.v, 2) + pow(x.a - y.a, 2))) as t, count(*) as n
    from va x join va y on x.subject_id = y.subject_id where not x.rest and not y.rest group by all),
  ab as (select subject_id, vec_id, max(case when own = other and n > 1 then t / (n - 1) end) as w, min(case when own <> other then t / n end) as b from pr group by 1, 2),
  si as (select subject_id, avg(case when w is null then 0 else (b - w) / greatest(w, b) end) as silhouette from ab group by 1),
  re as (select subject_id, avg(v) as precursor_v, avg(a) as precursor_a from va where rest group by 1),
  st as (select subject_id, max(folds) as cv_folds, count(*) as k, string_agg(label::varchar, ',' order by label) as classes from el where k >= 2 group by 1),
  sk as (select subject_id, count(*) filter (n >= 5) as few from per group by 1)"""
CHAIN_NUMBERS = ["acc_mean", "acc_sd", "centroid_v", "centroid_a", "separation", "dispersion", "silhouette", "precursor_v", "precursor_a"]


@query("decoder_chain", f"""with {CHAIN} select sk.subject_id, case when cv_folds is null then 'skip_insufficient_classes' else 'ok' end as status, coalesce(k, few)::bigint as n_classes, classes,
    cv_folds::bigint as cv_folds, n_windows::bigint as n_windows, {', '.join(f'{r(c, 4)} as {c}' for c in CHAIN_NUMBERS)}
    from sk left join st using (subject_id) left join ac using (subject_id) left join sp using (subject_id) left join ds using (subject_id)
    left join si using (subject_id) left join re using (subject_id)""", "FX_CELLS")
def _(spark, sf):
    w = fx.windows(spark, sf)
    c = d.decoder_chain(w.where("condition = 'ec'"), w.where("condition = 'eo'").select("subject_id", "vec_id", "x"), "x", "vec_id", ANCHORS, False, 5)
    return out(c, "subject_id status n_classes classes cv_folds n_windows", **{k: 4 for k in CHAIN_NUMBERS})
