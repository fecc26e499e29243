import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalops.functions import dist, nulls
from signalops.functions.hashing import draw
from signalops.functions.ordering import average_rank_pct, bucketed_row_number, exact_quantiles, hash_row_number


def test_nan_equals_null_and_row_mean(spark):
    d = spark.createDataFrame([(1.0, float("nan")), (None, None), (2.0, 4.0)], "a double, b double")
    got = [r.m for r in nulls.nan_to_null(d).select(nulls.row_mean(["a", "b"]).alias("m")).collect()]
    assert got == [1.0, None, 3.0]


def test_correlation_of_a_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert d.agg(nulls.corr_agg("a", "b").alias("r")).first().r is None


def test_zero_denominator_and_log_guard(spark):
    d = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    r = d.select(nulls.safe_div("a", "b").alias("q"), nulls.log_guard("b").alias("l"), nulls.to_number(F.lit("D01")).alias("n")).first()
    assert r.q is None and r.n is None and math.isclose(r.l, math.log(1e-10))


def test_required_and_kept_columns(spark):
    d = spark.createDataFrame([("a", 1)], "participant_id string, x int")
    assert nulls.keep_columns(d, ["ID", "y", "x"], {"participant_id": "ID"}).columns == ["ID", "x"]
    with pytest.raises(ValueError, match="missing columns"):
        nulls.require_columns(d, ["x", "z"])


def _numbers(spark, parts):
    r = np.random.default_rng(1)
    # One key holds most rows.
    pdf = pd.DataFrame({"k": np.where(r.random(600) < 0.8, "hot", "cold"), "v": np.round(r.normal(size=600), 1), "i": range(600)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_bucketed_row_number(spark, parts):
    pdf, d = _numbers(spark, parts)
    got = bucketed_row_number(d, ["k"], ["v", "i"], F.floor(F.col("v") * 2)).toPandas().sort_values("i")
    want = pdf.sort_values(["v", "i"]).groupby("k").cumcount().sort_index() + 1
    assert (got.set_index("i")["rn"] == want).all()


def test_hash_rank_ignores_partitioning(spark):
    pdf, d = _numbers(spark, 3)
    one = lambda x: hash_row_number(x.withColumn("h", draw("i", 2, 7)), ["k"], "h", "i").toPandas().set_index("i")["rn"].sort_index()
    a, b = one(d), one(d.repartition(11))
    assert (a == b).all() and sorted(a[pdf.k == "cold"]) == list(range(1, (pdf.k == "cold").sum() + 1))


def test_draws_are_spread_and_differ_between_replicates(spark):
    d = spark.range(4000).select(draw("id", 1).alias("a"), draw("id", 2).alias("b")).toPandas() / 2147483647
    assert abs(d.a.mean() - 0.5) < 0.03 and abs(np.corrcoef(d.a, d.b)[0, 1]) < 0.06


def test_average_rank_and_quantiles(spark):
    pdf, d = _numbers(spark, 5)
    got = average_rank_pct(d, "k", "v", 150).toPandas()
    want = pdf.assign(p=pdf.groupby("k")["v"].rank(pct=True)).drop_duplicates(["k", "v"])
    m = got.merge(want, on=["k", "v"])
    assert len(m) == len(want) and np.allclose(m.pct_rank, m.p)
    q = exact_quantiles(d, "k", "v", {"a": 0.025, "b": 0.5, "c": 0.75}, 300).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(q.loc[k, ["a", "b", "c"]].astype(float), np.quantile(g.v, [0.025, 0.5, 0.75]))


def test_tied_percentiles(spark):
    d = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 2.0), ("m", 3.0)], "k string, v double")
    got = {r.v: r.pct_rank for r in average_rank_pct(d, "k", "v").collect()}
    assert got == {1.0: 0.25, 2.0: 0.625, 3.0: 1.0}


def test_tails():
    assert math.isclose(dist.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(dist.f_upper(3.0, 2, 20), (1 + 2 * 3.0 / 20) ** -10, rel_tol=1e-9)
    assert math.isclose(dist.t_quantile(0.975, 25), 2.059539, rel_tol=1e-6)
    assert math.isclose(dist.f_upper(4.0, 1, 12), dist.t_two_sided(2.0, 12), rel_tol=1e-9)
