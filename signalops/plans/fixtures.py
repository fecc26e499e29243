"""Views over the given tables that stand in for recordings, trials, items and subjects.

Each view exists twice: as a DataFrame, and as SQL text for the independent check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalops.functions.lineage import cut
from signalops.functions.hashing import ID_STEP, MODULUS, REP_STEP, SEED_STEP
from signalops.functions.nulls import safe_div
from signalops.functions.ordering import bucketed_row_number, minute_bucket
from signalops.operators import behaviour, reliability, spectral

FS, N = 64.0, 64
CHANNELS = ["F3", "F4", "O1", "O2"]
ITEMS = ["click", "error", "purchase", "signup", "view"]
FEATURES = ["f_click", "f_view", "f_signup", "f_error", "f_purchase"]
REC = ["subject_id", "condition"]
EPOCH = [*REC, "epoch_id"]
REGIONS = {"FC": ["F3", "F4"], "PO": ["O1", "O2"]}


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# ---------------------------------------------------------------- DataFrames

def ranked_events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return bucketed_row_number(e, ["user_id"], ["ts", "event_id"], minute_bucket("ts"))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    e = ranked_events(spark, sf)
    return e.select(
        F.col("user_id").alias("id"), F.col("rn").alias("trial"),
        F.when(F.col("event_id") % 2 == 0, "congruent").otherwise("incongruent").alias("condition"),
        F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(1.0).alias("acc"),
        (0.2 + F.col("value") / 1000).alias("rt"), (F.col("value") > 200).alias("outlier"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    e = ranked_events(spark, sf)
    return e.select(F.col("user_id").alias("subject_id"), (F.col("rn") - 1).alias("t"), F.col("event_type").alias("tag"), "value")


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    ch = F.get(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("vec_id") % 4).cast("int"))
    ep = F.floor(F.col("vec_id") / 4) % 10
    return v.select(F.floor(F.col("vec_id") / 40).alias("subject_id"), F.when(ep < 5, "eo").otherwise("ec").alias("condition"),
                    ep.alias("epoch_id"), ch.alias("channel"), "vec_id", F.col("label").cast("bigint").alias("label"),
                    F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf).select(*EPOCH, "channel", F.posexplode("x").alias("n", "value"))
    return e.select(*REC, "channel", (F.col("epoch_id") * N + F.col("n")).alias("t"), "value")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("item")).agg(
        (1 + F.count(F.lit(1)) % 4).cast("double").alias("score"))


def items_wide(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.items_wide(items(spark, sf), ITEMS)


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Per-subject features; events are reduced before they meet the customers."""
    e = load(spark, sf, "events").groupBy("user_id").agg(
        *[F.avg(F.when(F.col("event_type") == f[2:], F.col("value"))).alias(f) for f in FEATURES],
        safe_div(F.stddev_samp("value"), F.avg("value")).alias("y_cv"))
    c = load(spark, sf, "customer")
    return e.join(c, e.user_id == c.c_custkey).select(
        F.col("user_id").alias("subject_id"), (F.col("c_acctbal") / 1000).alias("covariate"), F.col("c_mktsegment").alias("sex"),
        *FEATURES, "y_cv", F.lit(1.0).alias("f_const"), (F.col("f_click") * 2 + 1).alias("f_dup"))


def subjects_gaps(spark: SparkSession, sf: str) -> DataFrame:
    s = subjects(spark, sf)
    return s.withColumns({"f_click": F.when(F.col("subject_id") % 7 != 0, F.col("f_click")),
                          "f_view": F.when(F.col("subject_id") % 5 != 0, F.col("f_view"))})


def subject_table(spark: SparkSession, sf: str) -> DataFrame:
    """The subject rows as a stored table, for operators that read their input more than once."""
    return cut(subjects(spark, sf))


def gaps_table(spark: SparkSession, sf: str) -> DataFrame:
    return cut(subjects_gaps(spark, sf))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).where(F.col("tag").isin("error", "signup"))
    return s.select("subject_id", F.when(F.col("t") % 2 == 0, "1_Signup").otherwise("2_View").alias("condition"), F.col("t").cast("double").alias("onset"),
                    F.when(F.col("tag") == "error", "BAD_ACQ_SKIP").otherwise(F.col("tag")).alias("description"))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    ends = load(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(
        (F.count(F.lit(1)) - 1).cast("double").alias("rec_end"))
    return ends.select("subject_id", F.explode(F.array(F.lit("1_Signup"), F.lit("2_View"))).alias("condition"), "rec_end")


def components(spark: SparkSession, sf: str) -> DataFrame:
    d, l = load(spark, sf, "documents"), load(spark, sf, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("component_id"), F.col("lang").alias("label"),
                                      (F.col("n_chars") / 20000.0).alias("prob"), "source")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(F.col("event_type").alias("stage"), F.to_date("ts").cast("string").alias("run_ts")).distinct()


def qc_log(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "events").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("condition")).agg(
        F.count(F.lit(1)).alias("n_epochs_before_reject"), F.count_if(F.col("value") <= 100).alias("n_epochs_after_reject"))
    n, a = F.col("n_epochs_before_reject"), F.col("n_epochs_after_reject")
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    return g.select("*", (1 - a / n).alias("pct_epochs_dropped"),
                    F.when(F.col("condition").isin("purchase", "signup"), "emotion").alias("kind"),
                    F.when(a < 3, "ERROR: ValueError").when(a < 8, "LOW_EPOCH_COUNT").otherwise("OK").alias("status"),
                    some(F.when(n % 2 == 0, "F3"), F.when(n % 3 == 0, "F4"), F.when(n % 5 == 0, "O1")).alias("bad_channels"),
                    some(F.when(a % 2 == 0, "eye blink"), F.when(a % 3 == 0, "line noise")).alias("ica_excluded_labels"),
                    (a >= 8).alias("viable"), ((a >= 10) & (n % 2 == 0)).alias("base_viable"), (a >= 12).alias("decode_viable"))


def mean_psd(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.mean_psd(epochs(spark, sf), FS, N, [*REC, "channel"])


def band_power(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.band_power(mean_psd(spark, sf), FS, N, [*REC, "channel"])


def primitives_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Wide subject row with the primitives the composites read, from one shared density.

    The density array carries every family, so each is a row-local expression on it and the
    whole row costs one aggregate over epochs and one over channels.
    """
    f = spectral.frequencies(FS, N)
    psd = spectral.peak_frequency(spectral.aperiodic_fit(mean_psd(spark, sf), FS, N), FS, N)
    psd = psd.withColumn("__per", spectral.flattened(FS, N)).withColumn("__total", spectral.trapezoid(F.col("psd"), f, 0.5, 45.0, closed=True))
    psd = psd.withColumns({f"psd_abs_{b}": spectral.trapezoid(F.col("psd"), f, lo, hi) for b, (lo, hi) in spectral.BANDS.items()})
    psd = psd.withColumns({
        **{f"psd_rel_{b}": F.when(F.col("__total") > 0, F.col(f"psd_abs_{b}") / F.nullif("__total", F.lit(0.0))).otherwise(0.0) for b in spectral.BANDS},
        **{f"psd_periodic_{b}": spectral.trapezoid(F.col("__per"), f, lo, hi) for b, (lo, hi) in spectral.BANDS.items()},
        "aperiodic_exponent": F.col("exponent"), "aperiodic_offset": F.col("offset")})
    families = ["aperiodic_exponent", "aperiodic_offset", "paf"] + [
        f"psd_{k}_{b}" for b in spectral.BANDS for k in ("abs", "rel", "periodic")]
    at = lambda c, ch, m: F.max(F.when((F.col("condition") == c) & (F.col("channel") == ch), F.col(m))).alias(f"{c}_{m}_{ch}")
    wide = psd.groupBy("subject_id").agg(*[at(c, ch, m) for c in ("eo", "ec") for m in families for ch in CHANNELS])
    # Stage boundary: composites read these few rows more than once, so they are written once.
    return cut(wide)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Decoder windows: four classes, a few feature columns (two with missing cells), all values with missing cells, four probability columns."""
    e = epochs(spark, sf)
    x = [F.col("x")[i] for i in range(8)]
    z = [F.exp(4 * x[i]) for i in range(4)]
    return e.select("subject_id", "condition", "vec_id", (F.col("label") % 4).alias("label"),
                    *[F.when(gap != 0, x[i]).alias(f"w{i}") for i, gap in enumerate((F.col("vec_id") % 9, (F.col("vec_id") + 8) % 11))],
                    *[x[i].alias(f"w{i}") for i in range(2, 6)],
                    F.transform("x", lambda v, i: F.when((F.col("vec_id") * 7 + i * 13) % 17 != 0, v)).alias("x"),
                    *[(z[i] / (z[0] + z[1] + z[2] + z[3])).alias(f"p{i}") for i in range(4)])


def trial_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reliability.trial_metrics(trials(spark, sf), ["id"])


# ---------------------------------------------------------------- SQL twins

def draw_sql(row_id: str, rep: str = "0", seed: int = 42) -> str:
    """The deterministic draw as text."""
    i = f"(({row_id}) % {MODULUS})"
    h0 = f"(({i} * {ID_STEP} + ({rep}) * {REP_STEP} + {seed * SEED_STEP}) % {MODULUS})"
    h1 = f"(({h0} * {h0} + {i}) % {MODULUS})"
    return f"((({h1} * {h1}) + {h0}) % {MODULUS})"


def _bands(select: str, sep: str = " union all ") -> str:
    return sep.join(select.format(b=b, lo=lo, hi=hi) for b, (lo, hi) in spectral.BANDS.items())


BAND_ROWS = "(values " + ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in spectral.BANDS.items()) + ") as b(band, lo, hi)"

# name -> (names it reads, SQL body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "FX_RANKED": ([], "select *, row_number() over (partition by user_id order by ts, event_id)::bigint as rn from events"),
    "FX_TRIALS": (["FX_RANKED"], """select user_id as id, rn as trial,
        case when event_id % 2 = 0 then 'congruent' else 'incongruent' end as condition,
        case when event_id % 5 = 0 then 0.0::double else 1.0::double end as acc,
        0.2::double + value / 1000 as rt, value > 200 as outlier from FX_RANKED"""),
    "FX_SIGNAL": (["FX_RANKED"], "select user_id as subject_id, rn - 1 as t, event_type as tag, value from FX_RANKED"),
    "FX_EPOCH": ([], """select vec_id // 40 as subject_id, case when (vec_id // 4) % 10 < 5 then 'eo' else 'ec' end as condition,
        (vec_id // 4) % 10 as epoch_id, case vec_id % 4 when 0 then 'F3' when 1 then 'F4' when 2 then 'O1' else 'O2' end as channel,
        vec_id, label::bigint as label, embedding as x from embeddings"""),
    "FX_LONG": (["FX_EPOCH"], """select subject_id, condition, epoch_id, channel, vec_id, unnest(range(0, 64)) as n,
        unnest(x)::double as v from FX_EPOCH"""),
    "FX_SAMPLES": (["FX_LONG"], "select subject_id, condition, channel, epoch_id * 64 + n as t, v as value from FX_LONG"),
    "FX_ITEMS": ([], "select user_id as id, event_type as item, (1 + count(*) % 4)::double as score from events group by 1, 2"),
    "FX_IWIDE": (["FX_ITEMS"], "select id, " + ", ".join(f"max(case when item = '{i}' then score end) as {i}" for i in ITEMS) + " from FX_ITEMS group by id"),
    "FX_SUBJECT": ([], """select *, 1.0::double as f_const, f_click * 2 + 1 as f_dup from (
        select e.user_id as subject_id, max(c.c_acctbal) / 1000 as covariate, max(c.c_mktsegment) as sex, """
                   + ", ".join(f"avg(case when event_type = '{f[2:]}' then value end) as {f}" for f in FEATURES) +
                   """, stddev_samp(value) / nullif(avg(value), 0) as y_cv
        from events e join customer c on e.user_id = c.c_custkey group by e.user_id)"""),
    "FX_GAPS": (["FX_SUBJECT"], """select * replace (case when subject_id % 7 <> 0 then f_click end as f_click,
        case when subject_id % 5 <> 0 then f_view end as f_view) from FX_SUBJECT"""),
    "FX_ANN": (["FX_SIGNAL"], """select subject_id, case when t % 2 = 0 then '1_Signup' else '2_View' end as condition, t::double as onset, case when tag = 'error' then 'BAD_ACQ_SKIP' else tag end as description
        from FX_SIGNAL where tag in ('error', 'signup')"""),
    "FX_REC": ([], """select subject_id, condition, rec_end from (select user_id as subject_id, (count(*) - 1)::double as rec_end
        from events group by 1), (values ('1_Signup'), ('2_View')) c(condition)"""),
    "FX_COMPONENTS": ([], """select doc_id as component_id, lang as label, n_chars / 20000.0::double as prob, source
        from documents join labels using (doc_id)"""),
    "FX_RUNS": ([], "select distinct event_type as stage, cast(cast(ts as date) as varchar) as run_ts from events"),
    "FX_QCLOG": ([], """select *, 1 - a / n as pct, case when condition in ('purchase', 'signup') then 'emotion' end as kind,
        case when a < 3 then 'ERROR: ValueError' when a < 8 then 'LOW_EPOCH_COUNT' else 'OK' end as status,
        concat_ws(',', case when n % 2 = 0 then 'F3' end, case when n % 3 = 0 then 'F4' end, case when n % 5 = 0 then 'O1' end) as bad,
        ((n % 2 = 0)::bigint + (n % 3 = 0)::bigint + (n % 5 = 0)::bigint) as n_bad,
        concat_ws(',', case when a % 2 = 0 then 'eye blink' end, case when a % 3 = 0 then 'line noise' end) as ica,
        ((a % 2 = 0)::bigint + (a % 3 = 0)::bigint) as n_ica, a >= 8 as viable, (a >= 10 and n % 2 = 0) as base_viable, a >= 12 as decode_viable
        from (select user_id as subject, event_type as condition, count(*) as n, count(*) filter (value <= 100) as a from events group by 1, 2)"""),
    # raw transform, one-segment density, group means, band power
    "FX_DFT": (["FX_LONG"], """select subject_id, condition, epoch_id, channel, vec_id, k, sum(v * cos(2 * pi() * k * n / 64)) as re,
        -sum(v * sin(2 * pi() * k * n / 64)) as im from FX_LONG, (select unnest(range(0, 33)) as k) group by all"""),
    "FX_PSD": (["FX_LONG"], """select subject_id, condition, epoch_id, channel, vec_id, k, k::double as freq,
        (case when k in (0, 32) then 1 else 2 end) * (pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2)) / (64 * 24.0::double) as p
        from (select * replace ((v - avg(v) over (partition by vec_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) as v) from FX_LONG),
             (select unnest(range(0, 33)) as k) group by subject_id, condition, epoch_id, channel, vec_id, k"""),
    "FX_MPSD": (["FX_PSD"], "select subject_id, condition, channel, k, freq, avg(p) as p from FX_PSD group by all"),
    "FX_BP": (["FX_MPSD"], f"""select s.subject_id, s.condition, s.channel, band, abs_power, abs_power / total as rel_power from (
        select subject_id, condition, channel, band, sum((p + q) / 2) as abs_power from (
          select *, lead(p) over (partition by subject_id, condition, channel, band order by k) as q
          from FX_MPSD join {BAND_ROWS} on freq >= lo and freq < hi) group by all) s
        join (select subject_id, condition, channel, sum((p + q) / 2) as total from (
          select *, lead(p) over (partition by subject_id, condition, channel order by k) as q from FX_MPSD where k >= 1) group by all) t
        using (subject_id, condition, channel)"""),
    "FX_APER": (["FX_MPSD"], """select subject_id, condition, channel, -regr_slope(lp, lf) as exponent, regr_intercept(lp, lf) as "offset" from (
        select *, quantile_cont(r, 0.025) over (partition by subject_id, condition, channel) as cut from (
          select *, greatest(lp - b - a * lf, 0) as r from (
            select *, regr_slope(lp, lf) over w as a, regr_intercept(lp, lf) over w as b from (
              select subject_id, condition, channel, log10(p) as lp, log10(freq) as lf from FX_MPSD where k >= 1)
            window w as (partition by subject_id, condition, channel)))) where r <= cut group by all"""),
    "FX_PER": (["FX_MPSD", "FX_APER"], f"""select subject_id, condition, channel, band, sum((p + q) / 2) as periodic_power from (
        select *, lead(p) over (partition by subject_id, condition, channel, band order by k) as q from (
          select subject_id, condition, channel, k, freq, pow(10, log10(p) - "offset" + exponent * log10(freq)) as p
          from FX_MPSD join FX_APER using (subject_id, condition, channel) where k >= 1)
        join {BAND_ROWS} on freq >= lo and freq < hi) group by all"""),
    "FX_PAF": (["FX_MPSD"], """with b as (select * from FX_MPSD where freq between 7 and 13),
        c as (select subject_id, condition, channel, sum(p * freq) / sum(p) as centroid, max(p) as top from b group by all),
        peaks as (select m.subject_id, m.condition, m.channel, m.k, m.freq, m.p,
            (select min(x.p) from b x where x.subject_id = m.subject_id and x.condition = m.condition and x.channel = m.channel and x.k < m.k
               and x.k > coalesce((select max(y.k) from b y where y.subject_id = m.subject_id and y.condition = m.condition and y.channel = m.channel and y.k < m.k and y.p > m.p), 0)) as l,
            (select min(x.p) from b x where x.subject_id = m.subject_id and x.condition = m.condition and x.channel = m.channel and x.k > m.k
               and x.k < coalesce((select min(y.k) from b y where y.subject_id = m.subject_id and y.condition = m.condition and y.channel = m.channel and y.k > m.k and y.p > m.p), 99)) as r
          from (select *, lag(p) over w as pl, lead(p) over w as pr from b window w as (partition by subject_id, condition, channel order by k)) m
          where p > pl and p > pr),
        best as (select subject_id, condition, channel, arg_max(freq, p) as pf from peaks join c using (subject_id, condition, channel)
          where p - greatest(l, r) >= 0.3 * top group by all)
        select subject_id, condition, channel, centroid, case when abs(pf - centroid) < 2 then pf else centroid end as paf
        from c left join best using (subject_id, condition, channel)"""),
    "FX_PRIM": (["FX_BP", "FX_APER", "FX_PER", "FX_PAF"], """
        select subject_id, condition || '_psd_abs_' || band || '_' || channel as f, abs_power as value from FX_BP union all
        select subject_id, condition || '_psd_rel_' || band || '_' || channel, rel_power from FX_BP union all
        select subject_id, condition || '_psd_periodic_' || band || '_' || channel, periodic_power from FX_PER union all
        select subject_id, condition || '_aperiodic_exponent_' || channel, exponent from FX_APER union all
        select subject_id, condition || '_aperiodic_offset_' || channel, "offset" from FX_APER union all
        select subject_id, condition || '_paf_' || channel, paf from FX_PAF"""),
    "FX_WINDOWS": (["FX_EPOCH"], "select *, " + ", ".join(f"e{i} / (e0 + e1 + e2 + e3) as p{i}" for i in range(4)) +
                   " from (select subject_id, condition, vec_id, label % 4 as label, "
                   + "case when vec_id % 9 <> 0 then x[1]::double end as w0, case when (vec_id + 8) % 11 <> 0 then x[2]::double end as w1, "
                   + ", ".join(f"x[{i + 1}]::double as w{i}" for i in range(2, 6)) + ", "
                   + ", ".join(f"exp(4 * x[{i + 1}]::double) as e{i}" for i in range(4)) + " from FX_EPOCH)"),
    "FX_CELLS": (["FX_EPOCH"], """select subject_id, condition, vec_id, label, i, case when (vec_id * 7 + i * 13) % 17 <> 0 then v end as v
        from (select subject_id, condition, vec_id, label % 4 as label, unnest(range(0, 64)) as i, unnest(x)::double as v from FX_EPOCH)"""),
    "FX_VA": (["FX_WINDOWS"], """select *, 0.7071 * p0 + 0.7071 * p1 - 0.7071 * p2 - 0.7071 * p3 as va_v,
        0.7071 * p0 - 0.7071 * p1 - 0.7071 * p2 + 0.7071 * p3 as va_a from FX_WINDOWS"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    need: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in need:
            need.append(n)

    for n in names:
        visit(n)
    ctes = ", ".join(f"{n} as materialized ({VIEWS[n][1]})" for n in need)
    # A query that brings its own CTEs continues the list.
    text = body.strip()
    if text.lower().startswith("with "):
        return f"with {ctes}, {text[5:]}" if ctes else text
    return f"with {ctes} {text}" if ctes else text
