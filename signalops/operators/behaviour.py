"""Trial and questionnaire scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalops.functions.nulls import row_mean


def score_trials(events: DataFrame, trial_keys: list[str], key: str, order: list[str], expected: str) -> DataFrame:
    """Last key of a trial wins; no key is correct only when 'none' was expected."""
    last = F.max_by(key, F.when(F.col(key).isNotNull(), F.struct(*order)))
    per = events.groupBy(*trial_keys).agg(last.alias("response"), F.max(expected).alias("expected"))
    ok = F.when(F.col("response").isNull(), F.lower("expected") == "none").otherwise(F.col("response") == F.col("expected"))
    return per.withColumn("corr", F.coalesce(ok, F.lit(False)).cast("bigint"))


def digit_span_scores(trials: DataFrame, session: str, forward: str, backward: str) -> DataFrame:
    """Span of the highest level with a correct trial (0 if none), raw = number correct, totals."""
    def span(c: str) -> Column:
        hit = (F.col("condition") == c) & F.col("correct")
        return F.coalesce(F.max_by("span", F.when(hit, F.col("level"))), F.lit(0)).cast("bigint")

    def raw(c: str) -> Column:
        return F.count_if((F.col("condition") == c) & F.col("correct"))

    return (trials.groupBy(session)
            .agg(span(forward).alias("fw_span"), span(backward).alias("bw_span"),
                 raw(forward).alias("fw_raw"), raw(backward).alias("bw_raw"))
            .withColumn("total_span", F.col("fw_span") + F.col("bw_span"))
            .withColumn("total_raw", F.col("fw_raw") + F.col("bw_raw")))


def trial_detail(sessions: DataFrame, session: str, conditions: dict[str, str], start: str | None = None) -> DataFrame:
    """Flatten nested trials of both conditions; unscored trials are dropped.

    Each nested column is an array of (span, digits, correct) in presentation order. A long
    session may come as several rows; ``start`` then names the position of a row's first trial.
    """
    out = None
    for label, column in conditions.items():
        first = F.col(start) if start else F.lit(0)
        one = sessions.select(session, first.alias("__first"), F.lit(label).alias("condition"), F.posexplode(column).alias("__i", "t"))
        one = one.withColumn("i", F.col("__first") + F.col("__i")).select(
            session, "condition", (F.floor(F.col("i") / 2) + 1).cast("bigint").alias("level"),
            (F.col("i") % 2 + 1).cast("bigint").alias("trial"), F.col("t.span").cast("bigint").alias("span"),
            F.array_join("t.digits", " - ").alias("digits"), F.col("t.correct").cast("bigint").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("score").isNotNull())


def apply_discontinue(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Two wrong trials at one level end the condition: later levels are dropped."""
    stop = (trials.groupBy(*keys, "level")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("ok"))
            .where((F.col("n") == 2) & (F.col("ok") == 0))
            .groupBy(*keys).agg(F.min("level").alias("stop_level")))
    return trials.join(stop, keys, "left").where(F.col("stop_level").isNull() | (F.col("level") <= F.col("stop_level")))


def compute_age(df: DataFrame, dob: str, on: str, fmt: str = "d/M/yyyy") -> DataFrame:
    """Age at a date from a day-first birth date, one decimal; bad dates give NULL."""
    days = F.date_diff(F.lit(on).cast("date"), F.try_to_date(F.col(dob), fmt))
    return df.withColumn("age_years", F.round(days / 365.25, 1)).withColumn("age_months", F.round(days / 30.4375, 1))


def score_items(items: DataFrame, subscales: dict[str, list[str]], drop: list[str] = (), key: str = "id",
                total: str = "global_score") -> DataFrame:
    """Mean over retained items, globally and per subscale; missing items are skipped."""
    kept = {s: [i for i in its if i not in drop] for s, its in subscales.items()}
    every = [i for its in kept.values() for i in its]
    value = lambda its: F.avg(F.when(F.col("item").isin(its), F.col("score")))
    return items.groupBy(key).agg(value(every).alias(total),
                                  *[value(its).alias(f"{s}_score") for s, its in kept.items() if its])


def items_wide(items: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """One row per person, one column per item."""
    return items.groupBy(key).agg(*[F.max(F.when(F.col("item") == n, F.col("score"))).alias(n) for n in names])


def score_items_wide(wide: DataFrame, subscales: dict[str, list[str]], drop: list[str] = (),
                     total: str = "global_score") -> DataFrame:
    """The same scores on a wide sheet; absent columns are tolerated."""
    kept = {s: [i for i in its if i in wide.columns and i not in drop] for s, its in subscales.items()}
    every = [i for its in kept.values() for i in its]
    out = wide.withColumn(total, row_mean(every)) if every else wide
    return out.withColumns({f"{s}_score": row_mean(its) for s, its in kept.items() if its})


def autoscale(df: DataFrame, columns: list[str], limit: float = 1000.0, factor: float = 1000.0) -> DataFrame:
    """Divide a whole column when its largest magnitude exceeds the limit (ms to s).

    The decision is one aggregate row, read as a scalar subquery.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    tops = df.agg(F.struct(*[F.max(F.abs(c)).alias(c) for c in present]).alias("m")).scalar()
    tagged = df.withColumn("__top", tops)
    return tagged.withColumns({
        c: F.when(F.col(f"__top.{c}") > limit, F.col(c) / factor).otherwise(F.col(c)) for c in present}).drop("__top")


def audit_rt_columns(columns: list[str]) -> list[str]:
    """The audit rescales every reaction-time column except the unitless ratio."""
    return [c for c in columns if c.startswith("rt_") and c != "rt_cv"]
