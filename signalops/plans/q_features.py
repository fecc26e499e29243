"""Queries: composites, curation, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalops.functions.lineage import cut
from signalops.functions.present import shown_sql as r
from signalops.operators import features as f, spectral
from signalops.plans import fixtures as fx
from signalops.plans.registry import out, query

ALL = [*fx.FEATURES, "f_const", "f_dup"]
CODES = {"H": "0", "C": "1", "S": "2", "F": "3"}


def _cell(band, ch, v="abs_power", extra=""):
    return f"max(case when band = '{band}' and channel = '{ch}'{extra} then {v} end)"


@query("band_ratio", f"""
    select subject_id, condition, {r('a', 5)} as "ratio_F3", {r('b', 5)} as "ratio_F4", {r('(a + b) / 2', 5)} as ratio_mean from (
      select subject_id, condition, {_cell('theta', 'F3')} / nullif({_cell('beta', 'F3')}, 0) as a, {_cell('theta', 'F4')} / nullif({_cell('beta', 'F4')}, 0) as b from FX_BP group by 1, 2)""", "FX_BP")
def _(spark, sf):
    return out(f.band_ratio(fx.band_power(spark, sf), "theta", "beta", ["F3", "F4"], fx.REC), "subject_id condition", ratio_F3=5, ratio_F4=5, ratio_mean=5)


@query("log_asymmetry", f"select subject_id, condition, {r('ln(' + _cell('alpha', 'F4') + ' + 1e-10) - ln(' + _cell('alpha', 'F3') + ' + 1e-10)', 5)} as asymmetry from FX_BP group by 1, 2", "FX_BP")
def _(spark, sf):
    return out(f.log_asymmetry(fx.band_power(spark, sf), "alpha", "F3", "F4", fx.REC), "subject_id condition", asymmetry=5)


def _react(where):
    ec, eo = (f"avg(case when condition = '{c}'{where} then abs_power end)" for c in ("ec", "eo"))
    return r(f"({ec} - {eo}) / ({ec} + 1e-10)", 5)


@query("reactivity", f"""select subject_id, {_react('')} as reactivity_global, {_react(" and channel = 'O1'")} as "reactivity_O1", {_react(" and channel = 'O2'")} as "reactivity_O2"
    from FX_BP where band = 'alpha' group by 1""", "FX_BP")
def _(spark, sf):
    return out(f.reactivity(fx.band_power(spark, sf), "alpha", ["O1", "O2"]), "subject_id", reactivity_global=5, reactivity_O1=5, reactivity_O2=5)


def _z(c, src):
    return f"({c} - (select avg({c}) from {src})) / nullif((select stddev_pop({c}) from {src}), 0)"


def mean_sql(parts):
    n = " + ".join(f"({p} is not null)::int" for p in parts)
    return f"({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({n}, 0)"


@query("zmean_composite", f"""select subject_id, {r(mean_sql([_z('f_click', 'FX_GAPS'), _z('f_view', 'FX_GAPS'), _z('f_const', 'FX_GAPS')]), 5)} as z from FX_GAPS""", "FX_GAPS")
def _(spark, sf):
    return out(f.zmean(fx.gaps_table(spark, sf), ["f_click", "f_view", "f_const"], "z"), "subject_id", z=5)


def _wide_sql(names):
    return "pw as (select subject_id, " + ", ".join(f"""max(case when f = '{n}' then value end) as "{n}" """ for n in names) + " from FX_PRIM group by 1)"


def _tier1_sql(fam, tail):
    th, al, be = ([f"{c}_{fam}_{b}_{ch}" for ch in chs] for c, b, chs in (("eo", "theta", ["F3", "F4"]), ("ec", "alpha", ["O1", "O2"]), ("eo", "beta", ["F3", "F4"])))
    q = lambda ns: [f'"{n}"' for n in ns]
    return {f"fm_theta_eo{tail}": mean_sql([_z(x, "pw") for x in q(th)]), f"posterior_alpha_ec{tail}": mean_sql([_z(x, "pw") for x in q(al)]),
            f"tbr_frontal_eo_log{tail}": f"ln({mean_sql(q(th))} / nullif({mean_sql(q(be))}, 0) + 1e-10)"}, th + al + be


T1, T1N = _tier1_sql("psd_abs", "")
T1P, T1PN = _tier1_sql("psd_periodic", "_periodic")


@query("tier1_composites", f"with {_wide_sql(T1N)} select subject_id, {', '.join(r(e, 5) + f' as {n}' for n, e in T1.items())} from pw", "FX_PRIM")
def _(spark, sf):
    d = f.tier1_composites(fx.primitives_wide(spark, sf), ["F3", "F4"], ["O1", "O2"], ["F3", "F4"])
    return out(d, "subject_id", **{n: 5 for n in T1})


def _region_sql():
    exprs, names = {}, set()
    for n, (cond, fam, reg) in f.REGION_COMPOSITES.items():
        cols = [f"{cond}_{fam}_{c}" for c in fx.REGIONS[reg]]
        names |= set(cols)
        exprs[n] = mean_sql([f'"{c}"' for c in cols])
    eo, ec = ([f"{c}_psd_abs_alpha_{ch}" for ch in fx.REGIONS["PO"]] for c in ("eo", "ec"))
    names |= set(eo + ec)
    a, b = (mean_sql([f'"{c}"' for c in cs]) for cs in (eo, ec))
    exprs[f.REACTIVITY_COMPOSITE] = f"({b} - {a}) / ({b} + 1e-10)"
    return exprs, sorted(names)


RC, RCN = _region_sql()


@query("region_composites", f"""with {_wide_sql(RCN)} select subject_id, {', '.join(r(e, 5) + f' as "{n}"' for n, e in RC.items())} from pw""", "FX_PRIM")
def _(spark, sf):
    return out(f.region_composites(fx.primitives_wide(spark, sf), fx.REGIONS), "subject_id", **{n: 5 for n in RC})


ENG = {"eo_tbr_F3": '"eo_psd_abs_theta_F3" / nullif("eo_psd_abs_beta_F3", 0)',
       "ec_tbr_frontal_mean": mean_sql(['"ec_psd_abs_theta_F3" / nullif("ec_psd_abs_beta_F3", 0)', '"ec_psd_abs_theta_F4" / nullif("ec_psd_abs_beta_F4", 0)']),
       "eo_faa_F4_F3": 'ln("eo_psd_abs_alpha_F4" + 1e-10) - ln("eo_psd_abs_alpha_F3" + 1e-10)',
       "alpha_reactivity_O1": '("ec_psd_abs_alpha_O1" - "eo_psd_abs_alpha_O1") / ("ec_psd_abs_alpha_O1" + 1e-10)', **RC, **T1, **T1P}
ENGN = sorted({*RCN, *T1N, *T1PN, *(f"{c}_psd_abs_{b}_{ch}" for c in ("eo", "ec") for b in ("theta", "beta", "alpha") for ch in ("F3", "F4"))})


@query("engineered_all", f"""with {_wide_sql(ENGN)} select subject_id, {', '.join(r(e, 5) + f' as "{n}"' for n, e in ENG.items())} from pw""", "FX_PRIM")
def _(spark, sf):
    d = f.engineer_all(fx.primitives_wide(spark, sf), ["F3", "F4"], "F3", "F4", ["O1", "O2"], ["F3", "F4"], ["O1", "O2"], ["F3", "F4"], fx.REGIONS)
    return out(d, "subject_id", **{n: 5 for n in ENG})


# ---------------------------------------------------------------- curation

@query("curate_low_variance", f"""select feature, {r('variance', 6)} as variance from ({' union all '.join(f"select '{x}' as feature, var_pop({x}) as variance from FX_SUBJECT" for x in ALL if x != 'f_view')})
    where variance is null or variance < 20""", "FX_SUBJECT")
def _(spark, sf):
    return out(f.low_variance(fx.subjects(spark, sf), ALL, 20.0, ["f_view"]), "feature", variance=6)


ORDER = f.ordered_features(ALL, ["f_view"])
PAIRS = " union all ".join(f"""select '{b}' as feature, abs(covar_samp({a}, {b}) / nullif(stddev_samp({a}) filter ({b} is not null) * stddev_samp({b}) filter ({a} is not null), 0)) as r from FX_GAPS"""
                           for i, a in enumerate(ORDER) for b in ORDER[i + 1:] if a != "f_const" and b not in ("f_const", "f_view"))


@query("curate_collinear", f"select feature, {r('max(r)', 5)} as max_abs_r from ({PAIRS}) where r > 0.1 group by 1", "FX_GAPS")
def _(spark, sf):
    return out(f.collinear(fx.gaps_table(spark, sf), ALL, 0.1, ["f_view"]), "feature", max_abs_r=5)


@query("curation_report", f"""
    with c as (select feature from ({PAIRS}) where r > 0.1 group by 1)
    select {len(ALL)}::bigint as n_before, {len(ALL) - 1} - (select count(*) from c) as n_after, 1::bigint as n_protected, 'f_const' as dropped_low_variance,
      (select coalesce(string_agg(feature, ',' order by feature), '') from c) as dropped_collinear from (select count(*) from FX_GAPS)""", "FX_GAPS")
def _(spark, sf):
    return f.curation_report(fx.gaps_table(spark, sf), ALL, ["f_view"], threshold=0.1)


@query("resolve_schemes", f"""
    with c as (select feature from ({PAIRS}) where r > 0.1 group by 1), o as (select * from (values {', '.join(f"({i}, '{n}')" for i, n in enumerate(ORDER))}) v(i, feature)),
    k as (select * from o where feature <> 'f_const' and feature not in (select feature from c)),
    t as (select coalesce(string_agg(feature, ',' order by case feature when 'f_click' then 0 else 1 end), '') as m, count(*) as n from k where feature in ('f_click', 'f_view')),
    x as (select coalesce(string_agg(feature, ',' order by i), '') as m, count(*) as n from k where feature not in ('f_click', 'f_view')),
    p as (select string_agg(feature, ',' order by i) as m, count(*) as n from k)
    select 'theory' as scheme, m as members, '' as rest_pool, n as n_features from t union all select 'data_driven', m, '', n from p
    union all select 'hybrid', t.m, x.m, t.n + x.n from t, x""", "FX_GAPS")
def _(spark, sf):
    return f.resolve_schemes(f.kept_features(fx.gaps_table(spark, sf), ALL, ["f_view"], threshold=0.1), ["f_click", "f_view"])


@query("direction_priors", f"""
    with {_wide_sql(RCN)}, w as (select subject_id, {', '.join(f'{e} as "{n}"' for n, e in RC.items())} from pw),
    l as (select * from w unpivot include nulls (value for composite in ({', '.join(f'"{n}"' for n in RC)}))),
    p(composite, construct, up, down) as (values
      ('rel_theta_FC', 'frontal theta (cognitive control)', 'positive', 'negative'), ('rel_beta_FC', 'frontal beta (vigilance / readiness)', 'positive', 'negative'),
      ('rel_alpha_PO', 'posterior alpha (attentional reserve)', 'positive', 'negative'), ('aperiodic_exponent_FC', 'frontal 1/f slope (E/I; maturation)', 'positive', 'negative'),
      ('aperiodic_exponent_PO', 'posterior 1/f slope (E/I; maturation)', 'positive', 'negative'), ('aperiodic_offset_FC', 'frontal broadband offset', 'two_sided', 'two_sided'),
      ('aperiodic_offset_PO', 'posterior broadband offset', 'two_sided', 'two_sided'), ('paf_PO', 'individual alpha frequency (processing)', 'positive', 'negative'),
      ('alpha_reactivity_PO', 'alpha system reactivity', 'positive', 'negative')),
    d as (select composite, construct, value, target, case when target = 'rt_cv' then down else up end as direction
      from l join p using (composite), (values ('ddm_v_incongruent'), ('BW_Span'), ('Global_EF'), ('rt_cv')) t(target))
    select composite, construct, target, direction, count(value) as n_subjects, {r('avg(value)', 4)} as mean from d group by 1, 2, 3, 4""", "FX_PRIM")
def _(spark, sf):
    w = f.region_composites(fx.primitives_wide(spark, sf), fx.REGIONS).select("subject_id", *RC)
    d = f.direction_priors(w.unpivot("subject_id", list(RC), "composite", "value"))
    return out(d.groupBy("composite", "construct", "target", "direction").agg(F.count("value").alias("n_subjects"), F.avg("value").alias("mean")),
               "composite construct target direction n_subjects", mean=4)


# ---------------------------------------------------------------- merge

RAW_ID = """case c_custkey % 4 when 0 then '00' || c_custkey when 1 then ' ' || c_custkey || ' ' when 2 then c_custkey || '.0' else ' D' || c_custkey end"""


def _raw_id():
    k = F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 4
    return F.when(m == 0, F.concat(F.lit("00"), k)).when(m == 1, F.concat(F.lit(" "), k, F.lit(" "))).when(
        m == 2, F.concat(k, F.lit(".0"))).otherwise(F.concat(F.lit(" D"), k))


@query("normalise_id", f"""select c_custkey, case when x is not null and x = floor(x) then x::bigint::varchar else trim(raw) end as id
    from (select c_custkey, raw, try_cast(trim(raw) as double) as x from (select c_custkey, {RAW_ID} as raw from customer))""")
def _(spark, sf):
    return fx.load(spark, sf, "customer").select("c_custkey", f.normalise_id(_raw_id()).alias("id"))


def _scores(spark, sf):
    """A questionnaire table keyed by untidy customer ids, and two narrower tables."""
    c = fx.load(spark, sf, "customer")
    a = c.select(_raw_id().alias("id"), "c_acctbal")
    b = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    d = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("nation"))
    return a, b, d


@query("merge_behaviour", f"""
    select subject_id::varchar as subject_id, {r('f_click', 5)} as f_click, c_acctbal, case when c_custkey % 3 = 0 then c_mktsegment end as segment,
      case when c_custkey % 5 <> 0 then c_nationkey::bigint end as nation from FX_SUBJECT join customer on c_custkey = subject_id and c_custkey % 4 <> 3""", "FX_SUBJECT")
def _(spark, sf):
    a, b, d = _scores(spark, sf)
    return out(f.merge_behaviour(fx.subjects(spark, sf), a, b, d, min_matched=5), "subject_id c_acctbal segment nation", f_click=5)


@query("unmatched_left", "select subject_id::varchar as id from FX_SUBJECT where subject_id % 4 = 3", "FX_SUBJECT")
def _(spark, sf):
    return f.unmatched(fx.subjects(spark, sf), _scores(spark, sf)[0], "subject_id", "id")


@query("unmatched_right", f"select case when c_custkey % 4 = 3 then 'D' || c_custkey else c_custkey::varchar end as id from customer where c_custkey % 4 = 3 or c_custkey not in (select subject_id from FX_SUBJECT)", "FX_SUBJECT")
def _(spark, sf):
    return f.unmatched(_scores(spark, sf)[0], fx.subjects(spark, sf), "id", "subject_id")


# ---------------------------------------------------------------- valence and arousal

def _va_cols(extra=""):
    m = lambda b: f"avg(case when band = '{b}' and channel in ('F3', 'F4') then abs_power end)"
    return f"ln({_cell('alpha', 'F4')} + 1e-10) - ln({_cell('alpha', 'F3')} + 1e-10) as valence, {m('beta')} / {m('alpha')} as arousal"


@query("valence_arousal", f"select subject_id, condition, {r('valence', 5)} as valence, {r('arousal', 5)} as arousal from (select subject_id, condition, {_va_cols()} from FX_BP group by 1, 2)", "FX_BP")
def _(spark, sf):
    return out(f.valence_arousal(fx.band_power(spark, sf), fx.REC, arousal=["F3", "F4"]), "subject_id condition", valence=5, arousal=5)


def _delta(spark, sf):
    """Emotion = epoch number mod 4; late epochs respond, early ones are the tail, eo is rest."""
    e = fx.epochs(spark, sf).withColumn("emotion", (F.col("epoch_id") % 4).cast("string")).withColumn(
        "part", F.when(F.col("epoch_id") >= 6, "response").when(F.col("epoch_id") < 3, "tail"))
    def va(d, by):
        psd = spectral.mean_psd(d, fx.FS, fx.N, [*by, "channel"])
        return f.valence_arousal(spectral.band_power(psd, fx.FS, fx.N, [*by, "channel"]), by, arousal=["F3", "F4"])
    emo = cut(va(e.where("part is not null"), ["subject_id", "emotion", "part"]))
    rest = va(e.where("condition = 'eo'"), ["subject_id"])
    return f.baseline_delta(emo.where("part = 'response'").drop("part"), emo.where("part = 'tail'").drop("part"), rest, CODES)


def _bp_sql(name, by, where):
    return f"""{name} as (select {by}, {_va_cols()} from (select {by}, channel, band, sum((p + q) / 2) as abs_power from (
      select *, lead(p) over (partition by {by}, channel, band order by k) as q from (select {by}, channel, k, avg(p) as p from
        (select *, (epoch_id % 4)::varchar as emotion, case when epoch_id >= 6 then 'response' when epoch_id < 3 then 'tail' end as part from FX_PSD) where {where} group by all)
      join {fx.BAND_ROWS} on k >= lo and k < hi) group by all) group by {by})"""


DELTA = f"""{_bp_sql('em', 'subject_id, emotion, part', 'part is not null')}, {_bp_sql('rs', 'subject_id', "condition = 'eo'")},
  dl as (select e.subject_id, e.emotion, e.valence - t.valence as wv, e.arousal - t.arousal as wa, e.valence - rs.valence as rv, e.arousal - rs.arousal as ra
    from (select * from em where part = 'response') e left join (select * from em where part = 'tail') t on e.subject_id = t.subject_id and e.emotion = t.emotion left join rs on e.subject_id = rs.subject_id)"""
DCOLS = {f"{fam}_{c}{m}": (e, fam[0] + m) for c, e in CODES.items() for fam in ("within", "rest") for m in ("v", "a")}


@query("baseline_delta", f"""with {DELTA} select subject_id, {', '.join(r(f"max(case when emotion = '{e}' then {c} end)", 5) + f' as "{n}"' for n, (e, c) in DCOLS.items())} from dl group by 1""", "FX_PSD")
def _(spark, sf):
    return out(_delta(spark, sf), "subject_id", **{n: 5 for n in DCOLS})


@query("baseline_counts", f"""with {DELTA} select code, count(rv) as n_response, count(wv) as n_with_tail
    from (values {', '.join(f"('{c}', '{e}')" for c, e in CODES.items())}) v(code, e) left join dl on emotion = e group by 1""", "FX_PSD")
def _(spark, sf):
    return f.baseline_counts(_delta(spark, sf), list(CODES))
