"""Queries: sources, conditioning, event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalops.functions import nulls
from signalops.functions.lineage import own_folder
from signalops.functions.present import shown_sql as r
from signalops.operators import chunks, conditioning as c, windows as w
from signalops.plans import fixtures as fx
from signalops.plans.registry import out, query
from signalops.sources import catalog

DAY = r"^\d{4}-\d{2}-\d{2}$"
NAMES = ["click", "a_click", "view", "a_view", "error", "purchase"]


# ---------------------------------------------------------------- sources

@query("catalog_paths", r"""
    select subject_id, regexp_replace(raw, '[?#].*$', '') as condition, max(url) as path from (
      select url, regexp_extract(url, '^https?://([^/]+)/', 1) as subject_id,
        regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(.+)$', 1) as raw from pages)
    where subject_id <> '' and raw <> '' group by 1, 2""")
def _(spark, sf):
    paths = fx.load(spark, sf, "pages").select(F.col("url").alias("path"))
    return catalog.recording_catalog(paths, "path", r"^https?://([^/]+)/", r"^https?://[^/]+/[a-z]{2}/(.+)$", r"[?#].*$")


@query("longest_suffix_match", """
    with names as (select distinct 'D' || user_id || '_' || case when event_id % 3 = 0 then 'a_' else '' end || event_type as name from events),
    hits as (select name, c, row_number() over (partition by name order by length(c) desc) as i
      from names, (values ('click'), ('a_click'), ('view'), ('a_view'), ('error'), ('purchase')) v(c) where ends_with(name, '_' || c))
    select name, c as condition, left(name, length(name) - length(c) - 1) as subject_id
    from names left join (select * from hits where i = 1) using (name)""")
def _(spark, sf):
    name = F.concat(F.lit("D"), F.col("user_id"), F.lit("_"), F.when(F.col("event_id") % 3 == 0, "a_").otherwise(""), F.col("event_type"))
    return catalog.match_longest_suffix(fx.load(spark, sf, "events").select(name.alias("name")).distinct(), "name", NAMES)


@query("json_props_extract", """
    select event_type, count(*) as n_rows, count(k) as n_with_k, sum(k)::bigint as sum_k, max(k) as max_k
    from (select event_type, json_extract_string(props, '$.k')::bigint as k from events) group by 1""")
def _(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    e = fx.load(spark, sf, "events").select("event_type", k.alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("n_with_k"),
                                       F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


@query("required_columns", 'select c_custkey as "ID", c_acctbal, c_mktsegment from customer')
def _(spark, sf):
    d = nulls.require_columns(fx.load(spark, sf, "customer"), ["c_custkey", "c_acctbal"])
    return nulls.keep_columns(d, ["ID", "c_acctbal", "absent", "c_mktsegment"], {"c_custkey": "ID"})


@query("read_table", f"select c_mktsegment, count(*) as n, {r('sum(c_acctbal)', 2)} as total from customer group by 1")
def _(spark, sf):
    c = catalog.read_table(spark, f"{sf}/customer.parquet", required=["c_custkey", "c_acctbal", "c_mktsegment"])
    return out(c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")), "c_mktsegment n", total=2)


def _two_runs(spark, sf, name, df, older):
    """Write an older and a newer run of a table into this application's folder and return its root."""
    root = f"{own_folder(spark)}/runs-{uuid.uuid4().hex}"
    catalog.write_run(older, root, name, "2024-12-31_235959")
    catalog.write_run(df, root, name, "2025-01-01_000000")
    return root


@query("written_epochs", f"""select subject_id, condition, count(*) as n_rows, {r('sum(list_sum(x::double[]))', 4)} as total, '2025-01-01_000000' as run_ts from FX_EPOCH group by 1, 2""", "FX_EPOCH")
def _(spark, sf):
    e = fx.epochs(spark, sf).select(*fx.EPOCH, "channel", "x")
    root = _two_runs(spark, sf, "epochs", e, e.where("subject_id = 0"))
    newest = catalog.read_latest(spark, root, "epochs").select(*fx.REC, "run_ts").distinct()
    back = catalog.read_epochs(spark, f"{root}/epochs/run_ts=2025-01-01_000000")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    d = back.groupBy(*fx.REC).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(total).alias("total")).join(newest, fx.REC)
    return out(d.withColumn("run_ts", F.col("run_ts").cast("string")), "subject_id condition n_rows run_ts", total=4)


@query("written_samples", f"select channel, count(*) as n_rows, {r('sum(value)', 4)} as total from FX_SAMPLES group by 1", "FX_SAMPLES")
def _(spark, sf):
    s = fx.samples(spark, sf)
    root = _two_runs(spark, sf, "samples", s, s.where("subject_id = 0"))
    back = catalog.read_samples(spark, f"{root}/samples/run_ts=2025-01-01_000000")
    return out(back.groupBy("channel").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")), "channel n_rows", total=4)


@query("latest_run", "select stage, max(run_ts) as run_ts from FX_RUNS where regexp_full_match(run_ts, '\\d{4}-\\d{2}-\\d{2}') group by 1", "FX_RUNS")
def _(spark, sf):
    return catalog.latest_run(fx.runs(spark, sf), ["stage"], pattern=DAY)


@query("pinned_or_latest", """
    with pins as (select stage, case when stage = 'error' then '1999-01-01' else min(run_ts) end as pinned from FX_RUNS group by 1),
    latest as (select stage, max(run_ts) as latest from FX_RUNS group by 1)
    select stage, pinned, latest, coalesce(f.run_ts, latest) as resolved
    from latest join pins using (stage) left join FX_RUNS f using (stage) where f.run_ts = pinned or
      (not exists (select 1 from FX_RUNS g where g.stage = stage and g.run_ts = pinned) and f.run_ts = latest)""", "FX_RUNS")
def _(spark, sf):
    runs = fx.runs(spark, sf)
    pins = runs.groupBy("stage").agg(F.when(F.col("stage") == "error", "1999-01-01").otherwise(F.min("run_ts")).alias("pinned"))
    return catalog.pinned_or_latest(runs, pins, ["stage"], pattern=DAY)


@query("run_counts", """
    select event_type as stage, count(*) as n_rows, count(distinct user_id) as n_subjects,
      min(cast(cast(ts as date) as varchar)) as first_input, max(cast(cast(ts as date) as varchar)) as last_input from events group by 1""")
def _(spark, sf):
    e = fx.load(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return catalog.run_counts(e, "event_type", "user_id", "day")


@query("qc_rollup", """
    select count(*) as n_records, count(*) filter (kind is null and status = 'OK') as n_ok,
      count(*) filter (kind is null and status = 'LOW_EPOCH_COUNT') as n_low_epoch, count(*) filter (contains(status, 'ERROR')) as n_errors,
      count(*) filter (kind = 'emotion') as n_emotion, count(*) filter (kind = 'emotion' and viable) as n_emotion_viable,
      count(*) filter (kind = 'emotion' and base_viable) as n_emotion_base_viable,
      count(*) filter (kind = 'emotion' and decode_viable) as n_emotion_decode_viable from FX_QCLOG""", "FX_QCLOG")
def _(spark, sf):
    return catalog.qc_rollup(fx.qc_log(spark, sf))


@query("quarantine_split", f"""
    select status, count(*) as n_rows, {r('sum(value)', 2)} as total from (
      select value, case when not value <= 150 then 'ERROR: amplitude' when event_type = 'error' then 'ERROR: label'
        when not coalesce(json_extract_string(props, '$.k')::bigint > 10, false) then 'ERROR: props' else 'OK' end as status from events) group by 1""")
def _(spark, sf):
    rules = {"amplitude": F.col("value") <= 150, "label": F.col("event_type") != "error",
             "props": F.get_json_object("props", "$.k").try_cast("bigint") > 10}
    good, bad = catalog.split_valid(fx.load(spark, sf, "events").select("event_type", "value", "props"), rules)
    return out(good.unionByName(bad).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")),
               "status n_rows", total=2)


# ---------------------------------------------------------------- conditioning

@query("channel_rename", f"""
    select subject_id, condition, case channel when 'F3' then 'AF3' when 'O1' then 'PO1' else channel end as channel,
      count(*) as n, {r('sum(value)')} as total from FX_SAMPLES group by 1, 2, 3""", "FX_SAMPLES")
def _(spark, sf):
    d = c.rename_channels(fx.samples(spark, sf), {"F3": "AF3", "O1": "PO1", "T3": "T7"})
    return out(d.groupBy(*fx.REC, "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")),
               "subject_id condition channel n", total=4)


@query("channel_completeness", """
    with recs as (select distinct subject_id, condition from FX_EPOCH), got as (select distinct subject_id, condition, channel from FX_EPOCH),
    want as (select * from recs, (values ('F3'), ('F4'), ('O1'), ('Oz')) v(channel)),
    miss as (select subject_id, condition, string_agg(channel, ',' order by channel) as missing from (from want anti join got using (subject_id, condition, channel)) group by all),
    unk as (select subject_id, condition, string_agg(channel, ',' order by channel) as unknown from (from got anti join want using (subject_id, condition, channel)) group by all)
    select subject_id, condition, coalesce(missing, '') as missing, coalesce(unknown, '') as unknown,
      case when missing is null then 'OK' else 'ERROR: channels' end as status
    from recs left join miss using (subject_id, condition) left join unk using (subject_id, condition)""", "FX_EPOCH")
def _(spark, sf):
    return c.channel_report(fx.samples(spark, sf), ["F3", "F4", "O1", "Oz"])


@query("bucket_resample", f"select subject_id, floor(t * 2.5 / 10.0)::bigint as t, {r('avg(value)', 6)} as value from FX_SIGNAL group by 1, 2", "FX_SIGNAL")
def _(spark, sf):
    return out(c.bucket_resample(fx.signal(spark, sf), 10.0, 2.5, ["subject_id"]), "subject_id t", value=6)


@query("fir_filter", f"""
    select subject_id, t, {r('0.1::double * lag(value, 2) over w + 0.2::double * lag(value) over w + 0.4::double * value + 0.25::double * lead(value) over w + 0.05::double * lead(value, 2) over w', 6)} as filtered
    from FX_SIGNAL window w as (partition by subject_id order by t)""", "FX_SIGNAL")
def _(spark, sf):
    return out(c.fir_filter(fx.signal(spark, sf), [0.1, 0.2, 0.4, 0.25, 0.05], ["subject_id"], chunk=16), "subject_id t", filtered=6)


@query("crop_edges", f"""
    select subject_id, count(*) as n, min(t) as first_t, max(t) as last_t, {r('sum(value)', 3)} as total from (
      select *, max(t) over (partition by subject_id) / 4.0 as e from FX_SIGNAL)
    where e <= 2 * 8 + 1 or (t / 4.0 >= 8 and t / 4.0 <= e - 8) group by 1""", "FX_SIGNAL")
def _(spark, sf):
    d = c.crop_edges(fx.signal(spark, sf), 4.0, 8.0, ["subject_id"]).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("value").alias("total"))
    return out(d, "subject_id n first_t last_t", total=3)


STATS = "st as (select subject_id, condition, channel, var_pop(value) as var, stddev_pop(value) as sd from FX_SAMPLES group by all)"
ZS = STATS + """, md as (select *, median(var) over (partition by subject_id, condition) as med from st),
    zs as (select *, 0.6745 * (var - med) / (median(abs(var - med)) over (partition by subject_id, condition) + 1e-20) as z from md)"""
MAXR = """pr as (select a.subject_id, a.condition, a.channel, b.channel as other,
        covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0) as r
      from FX_SAMPLES a join FX_SAMPLES b on a.subject_id = b.subject_id and a.condition = b.condition and a.t = b.t and a.channel <> b.channel group by all),
    mr as (select subject_id, condition, channel, max(abs(coalesce(r, 0))) as max_r from pr group by all)"""


@query("bad_variance_madz", f"with {ZS} select subject_id, condition, channel, {r('z', 3)} as z from zs where abs(z) > 1.2 and channel <> 'F4'", "FX_SAMPLES")
def _(spark, sf):
    return out(c.bad_by_variance(fx.samples(spark, sf), ["F4"], 1.2), "subject_id condition channel", z=3)


@query("bad_max_corr", f"with {MAXR} select subject_id, condition, channel, {r('max_r', 5)} as max_r from mr where max_r < 0.06", "FX_SAMPLES")
def _(spark, sf):
    return out(c.bad_by_correlation(fx.samples(spark, sf), fx.CHANNELS, 0.06), "subject_id condition channel", max_r=5)


@query("bad_flatline", f"with {STATS} select subject_id, condition, channel, {r('sd', 6)} as sd from st where sd < 0.124", "FX_SAMPLES")
def _(spark, sf):
    return out(c.bad_by_flatline(fx.samples(spark, sf), 0.124), "subject_id condition channel", sd=6)


@query("bad_channels_union", f"""
    with {ZS}, {MAXR}, allm as (select subject_id, condition, channel, 'v' as m from zs where abs(z) > 1.2 and channel <> 'F4'
      union all select subject_id, condition, channel, 'c' from mr where max_r < 0.06
      union all select subject_id, condition, channel, 'f' from st where sd < 0.124)
    select subject_id, condition, string_agg(distinct channel, ',' order by channel) as bad,
      coalesce(string_agg(channel, ',' order by channel) filter (m = 'v'), '') as by_variance,
      coalesce(string_agg(channel, ',' order by channel) filter (m = 'c'), '') as by_correlation,
      coalesce(string_agg(channel, ',' order by channel) filter (m = 'f'), '') as by_flatline from allm group by 1, 2""", "FX_SAMPLES")
def _(spark, sf):
    return c.bad_channels(fx.samples(spark, sf), fx.CHANNELS, ["F4"], 1.2, 0.06, 0.124)


BADS = "s as (select *, (channel = 'O2' and subject_id % 2 = 0) or (channel = 'F4' and condition = 'ec') as bad from FX_SAMPLES)"


def _bads(samples):
    """Per recording: O2 of even subjects, F4 of every ec recording."""
    return samples.select(*fx.REC, "channel").distinct().where("(channel = 'O2' and subject_id % 2 = 0) or (channel = 'F4' and condition = 'ec')")


@query("average_reference", f"""
    with {BADS} select subject_id, condition, channel, {r('avg(v)', 6)} as mean, {r('stddev_pop(v)', 6)} as sd from (
      select subject_id, condition, channel, value - avg(value) filter (not bad) over (partition by subject_id, condition, t) as v from s) group by 1, 2, 3""", "FX_SAMPLES")
def _(spark, sf):
    s = fx.samples(spark, sf)
    d = c.average_reference(s, _bads(s))
    return out(d.groupBy(*fx.REC, "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")),
               "subject_id condition channel", mean=6, sd=6)


@query("exclude_components", f"""
    select source, label, count(*) as n_components, count(*) filter (label in ('fr', 'de') and prob > 0.1) as n_excluded,
      {r("coalesce(sum(prob) filter (label in ('fr', 'de') and prob > 0.1), 0)", 5)} as excluded_mass from FX_COMPONENTS group by 1, 2""", "FX_COMPONENTS")
def _(spark, sf):
    d = c.exclude_components(fx.components(spark, sf), ["fr", "de"], 0.1)
    return out(d.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if("excluded").alias("n_excluded"),
        F.coalesce(F.sum(F.when(F.col("excluded"), F.col("prob"))), F.lit(0.0)).alias("excluded_mass")),
        "source label n_components n_excluded", excluded_mass=5)


@query("weighted_repair", f"""
    with {BADS}, k(target, channel, w) as (values ('O2', 'O1', 0.6::double), ('O2', 'F4', 0.3), ('O2', 'F3', 0.1), ('F4', 'F3', 0.7), ('F4', 'O2', 0.3)),
    g as (select subject_id, condition, t, target, sum(w * value) / sum(w) as fixed from s join k using (channel) where not bad group by all)
    select subject_id, condition, channel, {r('avg(v)', 6)} as mean, {r('stddev_pop(v)', 6)} as sd from (
      select s.subject_id, s.condition, s.channel, case when bad then coalesce(fixed, value) else value end as v from s left join g
        on g.subject_id = s.subject_id and g.condition = s.condition and g.t = s.t and g.target = s.channel) group by 1, 2, 3""", "FX_SAMPLES")
def _(spark, sf):
    s = fx.samples(spark, sf)
    d = c.interpolate_channels(s, {"O2": {"O1": 0.6, "F4": 0.3, "F3": 0.1}, "F4": {"F3": 0.7, "O2": 0.3}}, bads=_bads(s))
    return out(d.groupBy(*fx.REC, "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")),
               "subject_id condition channel", mean=6, sd=6)


def _epoch_sql(length, step):
    return f"""with size as (select subject_id, max(t) + 1 as n from FX_SIGNAL group by 1),
      ep as (select subject_id, unnest(range(0, (n - {length}) // {step} + 1)) as epoch_id from size where n >= {length})
      select subject_id, epoch_id, count(*) as n, {r('avg(value)', 6)} as mean, {r('max(value) - min(value)', 4)} as p2p
      from ep join FX_SIGNAL using (subject_id) where t >= epoch_id * {step} and t < epoch_id * {step} + {length} group by 1, 2"""


def _epoch_rows(spark, sf, overlap):
    packed = c.pack_epochs(c.epoch_ids(fx.signal(spark, sf), 8, overlap, ["subject_id"]), ["subject_id"], 8)
    d = packed.select("subject_id", "epoch_id", F.size("x").alias("n"),
                      (F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")).alias("mean"),
                      (F.array_max("x") - F.array_min("x")).alias("p2p"))
    return out(d, "subject_id epoch_id n", mean=6, p2p=4)


@query("epochs_tumbling", _epoch_sql(8, 8), "FX_SIGNAL")
def _(spark, sf):
    return _epoch_rows(spark, sf, 0)


@query("epochs_sliding", _epoch_sql(8, 4), "FX_SIGNAL")
def _(spark, sf):
    return _epoch_rows(spark, sf, 4)


MARKED = """m as (select *, bool_or(list_max(x) - list_min(x) > 0.65) over (partition by subject_id, condition, epoch_id) as bad from FX_EPOCH)"""


@query("reject_peak_to_peak", f"with {MARKED} select subject_id, condition, epoch_id, count(*) as n_channels from m where not bad group by 1, 2, 3", "FX_EPOCH")
def _(spark, sf):
    return c.reject_peak_to_peak(fx.epochs(spark, sf), 0.65, fx.EPOCH).groupBy(*fx.EPOCH).agg(F.count(F.lit(1)).alias("n_channels"))


@query("rejection_stats", f"""
    with {MARKED}, s as (select subject_id, condition, count(distinct epoch_id) as n_before, count(distinct epoch_id) filter (not bad) as n_after from m group by 1, 2)
    select *, n_before - n_after as n_dropped, {r('(n_before - n_after) / n_before', 6)} as pct_dropped, (n_before - n_after) / n_before > 0.3 as warn from s""", "FX_EPOCH")
def _(spark, sf):
    s = c.rejection_stats(c.mark_peak_to_peak(fx.epochs(spark, sf), 0.65, fx.EPOCH))
    return out(s, "subject_id condition n_before n_after n_dropped warn", pct_dropped=6)


@query("amplitude_summary", f"""
    with {MARKED} select subject_id, condition, {r('coalesce(avg(abs(v)), 0) * 1e6', 2)} as mean_amplitude_uv, {r('coalesce(stddev_pop(v), 0) * 1e6', 2)} as std_amplitude_uv
    from (select distinct subject_id, condition from m) left join (select subject_id, condition, unnest(x)::double as v from m where not bad)
      using (subject_id, condition) group by 1, 2""", "FX_EPOCH")
def _(spark, sf):
    all_ = fx.epochs(spark, sf)
    e = c.reject_peak_to_peak(all_, 0.65, fx.EPOCH)
    return out(c.amplitude_summary(e, recordings=all_.select(*fx.REC).distinct()), "subject_id condition", mean_amplitude_uv=2, std_amplitude_uv=2)


@query("epoch_floor", f"""
    with {MARKED} select subject_id, condition, n_epochs, case when n_epochs < 3 then 'LOW_EPOCH_COUNT' else 'OK' end as status
    from (select subject_id, condition, count(distinct epoch_id) filter (not bad) as n_epochs from m group by 1, 2)""", "FX_EPOCH")
def _(spark, sf):
    s = c.rejection_stats(c.mark_peak_to_peak(fx.epochs(spark, sf), 0.65, fx.EPOCH))
    return s.select(*fx.REC, F.col("n_after").alias("n_epochs"), c.epoch_floor(F.col("n_after"), 3).alias("status"))


WEIGHTS = {"F3": {"F4": 0.6, "O1": 0.3, "O2": 0.1}, "F4": {"F3": 0.7, "O2": 0.3}, "O1": {"O2": 1.0}, "O2": {"O1": 0.6, "F4": 0.3, "F3": 0.1}}
WEIGHT_ROWS = ", ".join(f"('{a}', '{b}', {x}::double)" for a, ws in WEIGHTS.items() for b, x in ws.items())


@query("preprocess_qc", f"""
    with raw as (select subject_id, condition, channel, t % 320 as t, value from FX_SAMPLES),
    ends as (select subject_id, condition, max(t) as e from raw group by 1, 2),
    rg as (select *, case when e / 64.0 > 2 then 32 else 0 end as first, case when e / 64.0 > 2 then e - 32 else e end as last from ends),
    x as (select raw.*, first, last from raw join rg using (subject_id, condition) where t between first and last),
    st as (select subject_id, condition, channel, var_pop(value) as var, stddev_pop(value) as sd from x group by all),
    md as (select *, median(var) over (partition by subject_id, condition) as med from st),
    zs as (select *, 0.6745 * (var - med) / (median(abs(var - med)) over (partition by subject_id, condition) + 1e-20) as z from md),
    pr as (select a.subject_id, a.condition, a.channel, covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0) as r
      from x a join x b on a.subject_id = b.subject_id and a.condition = b.condition and a.t = b.t and a.channel <> b.channel group by a.subject_id, a.condition, a.channel, b.channel),
    mr as (select subject_id, condition, channel, max(abs(coalesce(r, 0))) as max_r from pr group by all),
    fl as (select zs.subject_id, zs.condition, zs.channel, abs(z) > 1.2 and zs.channel <> 'F4' as v, coalesce(max_r, 0) < 0.03 as c, sd < 0.118 as f from zs left join mr using (subject_id, condition, channel)),
    bl as (select subject_id, condition, count(*) as n_channels, coalesce(string_agg(channel, ',' order by channel) filter (v or c or f), '') as bad,
      coalesce(string_agg(channel, ',' order by channel) filter (v), '') as by_variance, coalesce(string_agg(channel, ',' order by channel) filter (c), '') as by_correlation,
      coalesce(string_agg(channel, ',' order by channel) filter (f), '') as by_flatline, bool_and(v or c or f) as none_good from fl group by 1, 2),
    b as (select x.*, v or c or f as bad, bl.bad <> '' and not none_good as repairs from x join fl using (subject_id, condition, channel) join bl using (subject_id, condition)),
    r1 as (select *, case when repairs then value - avg(value) filter (not bad) over (partition by subject_id, condition, t) else value end as y from b),
    k(target, channel, w) as (values {WEIGHT_ROWS}),
    fx as (select subject_id, condition, t, target, sum(w * y) / sum(w) as y2 from r1 join k using (channel) where not bad group by all),
    r2 as (select r1.subject_id, r1.condition, r1.channel, r1.t, first, last, case when repairs and bad then coalesce(y2, y) else y end as y from r1 left join fx
      on fx.subject_id = r1.subject_id and fx.condition = r1.condition and fx.t = r1.t and fx.target = r1.channel),
    r3 as (select *, y - avg(y) over (partition by subject_id, condition, t) as u, count(*) over (partition by subject_id, condition, t) as p from r2),
    ep as (select subject_id, condition, first, unnest(range(0, (last - first + 1 - 48) // 32 + 1)) as epoch_id from rg where last - first + 1 >= 48),
    ex as (select ep.subject_id, ep.condition, epoch_id, channel, max(u) - min(u) > 0.47 as over, count(*) filter (p = 4) as n, sum(u) as s, sum(u * u) as q, sum(abs(u)) as a
      from ep join r3 on r3.subject_id = ep.subject_id and r3.condition = ep.condition and t >= ep.first + epoch_id * 32 and t < ep.first + epoch_id * 32 + 48 group by 1, 2, 3, 4),
    ee as (select subject_id, condition, epoch_id, bool_or(over) as bad, sum(n) as n, sum(s) as s, sum(q) as q, sum(a) as a from ex group by 1, 2, 3 having sum(n) = 192),
    ec as (select subject_id, condition, count(*) as n_before, count(*) filter (not bad) as n_after, sum(a) filter (not bad) / sum(n) filter (not bad) * 1e6 as m,
      sqrt(sum(q) filter (not bad) / sum(n) filter (not bad) - pow(sum(s) filter (not bad) / sum(n) filter (not bad), 2)) * 1e6 as sd from ee group by 1, 2),
    recs as (select subject_id, condition from ends union all select -1, 'eo'),
    qc as (select recs.subject_id, recs.condition, coalesce((last - first) / 64.0::double, 0) as duration_after_crop_sec, coalesce(n_channels, 0) as n_channels,
      coalesce(bad, '') as bad, coalesce(by_variance, '') as by_variance, coalesce(by_correlation, '') as by_correlation, coalesce(by_flatline, '') as by_flatline,
      coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after, coalesce(m, 0) as m, coalesce(sd, 0) as sd
      from recs left join rg using (subject_id, condition) left join bl using (subject_id, condition) left join ec using (subject_id, condition))
    select subject_id, condition, n_channels, bad, by_variance, by_correlation, by_flatline, n_before, n_after, n_before - n_after as n_dropped,
      case when n_after < 4 then 'LOW_EPOCH_COUNT' else 'OK' end as status, {r('duration_after_crop_sec', 4)} as duration_after_crop_sec,
      {r('coalesce((n_before - n_after) / nullif(n_before, 0), 0)', 6)} as pct_dropped, {r('m', 2)} as mean_amplitude_uv, {r('sd', 2)} as std_amplitude_uv from qc""", "FX_SAMPLES")
def _(spark, sf):
    s = fx.samples(spark, sf).withColumn("t", F.col("t") % 320)
    recs = s.select(*fx.REC).union(spark.sql("select -1L, 'eo'"))
    d = chunks.preprocess_qc(s, recs, fx.CHANNELS, WEIGHTS, fx.FS, 48, 0.47, 16, 0.5, 4, ["F4"], 1.2, 0.03, 0.118, size=64)
    return out(d, "subject_id condition n_channels bad by_variance by_correlation by_flatline n_before n_after n_dropped status",
               duration_after_crop_sec=4, pct_dropped=6, mean_amplitude_uv=2, std_amplitude_uv=2)


# ---------------------------------------------------------------- event windows

WIN = """good as (select * from FX_ANN where not contains(lower(description), 'bad')),
  ons as (select r.subject_id, r.condition, rec_end, coalesce(min(onset) filter (contains(lower(description), lower(split_part(r.condition, '_', 2)))), 0) as onset
    from FX_REC r left join good g on r.subject_id = g.subject_id and r.condition = g.condition group by 1, 2, 3),
  st as (select *, greatest(onset, 5.0) as s from ons),
  rw as (select *, case when s + 15 <= rec_end then s when rec_end - 5 >= 15 then rec_end - 15 end as r_start,
    (s + 15 > rec_end and rec_end - 5 >= 15) as slid_back from st),
  rx as (select *, r_start + 15 as r_end, case when r_start is null then 'WINDOW_TOO_SHORT' else 'OK' end as window_status from rw),
  be as (select x.*, (select max(onset) from good g where g.subject_id = x.subject_id and g.condition = x.condition and g.onset > x.r_end + 1) as cand from rx x),
  bl as (select *, case when r_start is not null then case when cand is not null then least(cand, rec_end) else rec_end - 1 end end as block_end from be),
  wn as (select *, case when block_end - 15 >= r_end then block_end - 15 end as b_start, case when block_end - 15 >= r_end then block_end end as b_end,
    r_start as d_start, greatest(block_end, r_end) as d_end from bl),
  wr as (select subject_id, condition, rec_end, 'response' as "window", r_start as w_start, r_end as w_end from wn where r_start is not null
    union all select subject_id, condition, rec_end, 'base', b_start, b_end from wn where b_start is not null
    union all select subject_id, condition, rec_end, 'decode', d_start, d_end from wn where d_start is not null)"""


def _windows(spark, sf):
    return w.event_windows(fx.recordings(spark, sf), fx.annotations(spark, sf))


@query("event_onset", f"with {WIN} select subject_id, condition, onset from ons", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    return w.event_onset(fx.recordings(spark, sf), fx.annotations(spark, sf)).select("subject_id", "condition", "onset")


@query("block_end", f"with {WIN} select subject_id, condition, block_end from bl", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    return _windows(spark, sf).select("subject_id", "condition", "block_end")


@query("response_window", f"with {WIN} select subject_id, condition, r_start, r_end, slid_back, window_status from rx", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    d = w.response_window(w.event_onset(fx.recordings(spark, sf), fx.annotations(spark, sf)))
    return d.select("subject_id", "condition", "r_start", "r_end", "slid_back", "window_status")


@query("baseline_window", f"with {WIN} select subject_id, condition, b_start, b_end from wn", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    return _windows(spark, sf).select("subject_id", "condition", "b_start", "b_end")


@query("decode_window", f"with {WIN} select subject_id, condition, d_start, d_end from wn", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    return _windows(spark, sf).select("subject_id", "condition", "d_start", "d_end")


@query("window_assign", f"""
    with {WIN} select r.subject_id, condition, "window", count(*) as n, min(t) as first_t, max(t) as last_t, {r('sum(value)', 3)} as total
    from wr r join FX_SIGNAL s on r.subject_id = s.subject_id and t >= greatest(w_start, 0) and t < least(w_end, rec_end) group by 1, 2, 3""", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    d = w.samples_in_windows(fx.signal(spark, sf), _windows(spark, sf), 1.0, ["subject_id"])
    d = d.groupBy("subject_id", "condition", "window").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"),
                                                           F.max("t").alias("last_t"), F.sum("value").alias("total"))
    return out(d, "subject_id condition window n first_t last_t", total=3)


@query("window_viability", f"""
    with {WIN}, n as (select subject_id, condition, "window", (floor(least(w_end, rec_end) - w_start - 2) + 1)::bigint as n_epochs from wr)
    select *, n_epochs >= case "window" when 'decode' then 20 else 4 end as viable from (
      select r.subject_id, r.condition, k."window", greatest(coalesce(n_epochs, 0), 0)::bigint as n_epochs
      from FX_REC r cross join (values ('response'), ('base'), ('decode')) k("window") left join n
        on n.subject_id = r.subject_id and n.condition = r.condition and n."window" = k."window")""", ("FX_ANN", "FX_REC"))
def _(spark, sf):
    win = _windows(spark, sf)
    d = w.samples_in_windows(fx.signal(spark, sf), win, 1.0, ["subject_id"])
    return w.window_viability(w.window_epochs(d, 1.0), ["subject_id", "condition"], windows=win)


@query("window_qc", f"""
    with {WIN}, w as (select subject_id, condition, "window", greatest(w_start, 0) as w_start, least(w_end, rec_end) as w_end, case when "window" = 'decode' then 2 else 1 end as step from wr),
    ep as (select *, unnest(range(0, greatest(floor((w_end - w_start - 2) / step)::bigint + 1, 0))) as e from w),
    ex as (select ep.subject_id, condition, "window", e, max(value) - min(value) > 150 as bad from ep join FX_SIGNAL s
      on s.subject_id = ep.subject_id and t >= w_start + e * step and t < w_start + e * step + 2 group by 1, 2, 3, 4 having count(*) = 2),
    n as (select subject_id, condition, {', '.join(f"""count(*) filter ("window" = '{x}') as {x}_n_before, count(*) filter ("window" = '{x}' and not bad) as {x}_n_after""" for x in ('response', 'base', 'decode'))}
      from ex group by 1, 2)
    select *, response_n_after >= 4 as response_viable, base_n_after >= 4 as base_viable, decode_n_after >= 20 as decode_viable,
      case when short then 'WINDOW_TOO_SHORT' when response_n_after >= 4 then 'OK' else 'LOW_EPOCH_COUNT' end as status from (
      select subject_id, condition, r_start is null as short, {', '.join(f'coalesce({x}_n_{k}, 0) as {x}_n_{k}' for x in ('response', 'base', 'decode') for k in ('before', 'after'))}
      from wn left join n using (subject_id, condition))""".replace("select *, response_n_after >=", "select * exclude (short), response_n_after >="), ("FX_ANN", "FX_REC"))
def _(spark, sf):
    s = fx.signal(spark, sf).withColumn("channel", F.lit("X"))
    return w.window_qc(s, _windows(spark, sf), 1.0, ["X"], 150.0, ["subject_id"], decode_overlap_sec=0.0, size=32)
