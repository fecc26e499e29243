from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from signalops.llm import mixing as m


def plain_rake(cells, targets, rounds=200):
    w = {k: float(t) for k, t in cells.items() if t}
    for _ in range(rounds):
        for j, d in enumerate(m.DIMS):
            s = defaultdict(float)
            for k, v in w.items():
                s[k[j]] += v
            w = {k: v * targets[d].get(k[j], 0.0) / s[k[j]] for k, v in w.items()}
    return w


def test_weights_match_plain_raking_and_marginals(documents):
    cells, off = m.probabilities(documents)
    got = cells.collect()
    assert set(off) == set(m.DIMS) and max(off.values()) <= m.TOLERANCE
    cells = {(r["source"], r["lang"], r["topic"]): r["tokens"] for r in got}
    targets = {}
    for j, d in enumerate(m.DIMS):
        s = defaultdict(float)
        for k, v in cells.items():
            s[k[j]] += v
        u = {k: v**m.FLATTEN for k, v in s.items() if v}
        targets[d] = {k: v / sum(u.values()) for k, v in u.items()}
    want = plain_rake(cells, targets)
    for r in got:
        assert r["weight"] == pytest.approx(want.get((r["source"], r["lang"], r["topic"]), 0.0), abs=1e-5)
    ratio = {k: v / cells[k] for k, v in want.items()}
    for r in got:
        k = (r["source"], r["lang"], r["topic"])
        if k in ratio:
            assert r["probability"] == pytest.approx(ratio[k] / max(ratio.values()), rel=1e-3)


def test_given_targets_and_draw(spark, make):
    docs = make([(i, f"w{i} x y z", "en" if i % 3 else "fr", "a" if i % 4 else "b") for i in range(4000)])
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"),
               "lang": spark.createDataFrame([("en", 0.6), ("fr", 0.4)], "lang string, share double")}
    r = m.report(docs, targets=targets).where("sampled").groupBy("source", "lang").agg(F.sum("tokens").alias("t")).collect()
    total = sum(x["t"] for x in r)
    assert sum(x["t"] for x in r if x["source"] == "a") / total == pytest.approx(0.5, abs=0.04)
    assert sum(x["t"] for x in r if x["lang"] == "en") / total == pytest.approx(0.6, abs=0.04)
    again = m.report(docs.repartition(7), targets=targets).where("sampled")
    assert again.count() == m.report(docs, targets=targets).where("sampled").count()


def cells(spark, matrix):
    return spark.createDataFrame([(f"s{i}", f"l{j}", int(x)) for i, r in enumerate(matrix) for j, x in enumerate(r)], "source string, lang string, tokens long")


def shares(spark, dim, values):
    return spark.createDataFrame([(f"{dim[0]}{i}", x) for i, x in enumerate(values)], f"{dim} string, share double")


@pytest.mark.parametrize("matrix, source, lang", [
    ([[10000, 1], [1, 10000]], [0.2, 0.8], [0.6, 0.4])])
def test_slow_raking_reaches_its_targets(spark, matrix, source, lang):
    w, off = m.rake(cells(spark, matrix), {"source": shares(spark, "source", source), "lang": shares(spark, "lang", lang)})
    assert max(off.values()) <= 1e-6
    got = {r["source"]: r["w"] for r in w.groupBy("source").agg(F.sum("weight").alias("w")).collect()}
    assert [got[f"s{i}"] for i in range(len(source))] == pytest.approx(source, abs=2e-6)


def test_targets_that_nothing_meets_are_reported(spark, make):
    docs = make([(i, "a b c", "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(40)])
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"),
               "lang": spark.createDataFrame([("en", 0.8), ("fr", 0.2)], "lang string, share double")}
    r = m.report(docs, targets=targets).select("targets_met", "deviation").distinct().collect()
    assert len(r) == 1 and not r[0]["targets_met"] and r[0]["deviation"] == pytest.approx(0.3, abs=0.01)
    with pytest.raises(ValueError, match="deviations"):
        m.sample(docs, strict=True, targets=targets)


def test_a_larger_share_repeats_documents(spark, make):
    docs = make([(i, "a b c d", "en", "a" if i < 3000 else "b") for i in range(3100)])
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")}
    n = {r["source"]: r["count"] for r in m.sample(docs, targets=targets, share=0.5).groupBy("source").count().collect()}
    assert n["b"] == pytest.approx(775, rel=0.05) and n["a"] == pytest.approx(775, rel=0.1)


def test_clashing_columns(make):
    docs = make([(i, f"t{i} x") for i in range(50)]).selectExpr("*", "'p' as __source", "'q' as tokens", "'r' as weight", "'s' as row", "'t' as copies", "'u' as key")
    assert m.sample(docs).columns == docs.columns
    assert {tuple(r)[6:] for r in m.sample(docs).collect()} == {tuple("pqrstu")}


def test_topic_column_odd_rows_and_empty(odd, make):
    r = m.report(odd)
    assert r.count() == odd.count() and r.where("probability is null or probability < 0 or probability > 1").count() == 0
    same = {x["sampled"] for x in r.where("doc_id = 6").collect()}
    assert len(same) == 1
    given = odd.withColumn("topic", F.lit("t"))
    s = m.sample(given)
    assert s.columns == given.columns and {x["topic"] for x in s.collect()} == {"t"}
    assert m.sample(make([])).count() == 0


def test_kinds_of_text(make):
    rows = [(1, "a | b | c | d"), (2, "A*** b### c$$$"), (3, "ALL CAPITALS HERE"), (4, "a few words"), (5, "word " * 200), (6, "word " * 900)]
    got = {r["doc_id"]: r["topic"] for r in m.report(make(rows)).collect()}
    assert got == {1: "listing", 2: "symbols", 3: "capitals", 4: "note", 5: "article", 6: "long"}
