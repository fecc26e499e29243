import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from signalops.llm import cotrain, langid, linear, toxicity

BIG = "/root/testdata/sf0.01"


def held(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.report(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    out = [r for r in rows if held(r["doc_id"], 4) == 2]
    assert all(got[r["doc_id"]]["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_copies_do_not_cost_a_language_its_sample(spark):
    rows = [("the very same words in every row", "xx")] * 2000 + [(f"ordinary sentence {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(200)]
    rows += [("another text that was copied", "yy")] * 1500 + [(f"etwas anderes {'klmnopqrst'[i] * 3}", "yy") for i in range(10)]
    _, table = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    assert set(table["lang"]) == {"xx", "en", "yy"}
    assert (table["lang"] == "yy").sum() > 1


def test_language_of_odd_rows(odd, make):
    got = langid.report(odd)
    assert got.count() == odd.count()
    assert {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()} == {None, 1, 2, 3, 8}
    assert {r["lang_pred"] for r in langid.report(make([(1, "words", None, "s")])).collect()} == {"und"}
    assert langid.report(make([])).count() == 0


def test_foreign_text_is_rejected(make, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars").union(
        make([(10**6, "中文" * 300, None, "s")]).drop("extra"))
    r = {x["doc_id"]: x for x in langid.report(docs).collect()}
    assert r[10**6]["rejected"] and sum(x["rejected"] for x in r.values()) < 0.1 * len(r)


def test_counts_in_chunks_equal_whole(monkeypatch):
    text = "naïve words and others " * 50
    whole, f = langid.counts(text), linear.feature_set(text, np.zeros(linear.D, bool))
    monkeypatch.setattr(langid, "_CHUNK", 64)
    monkeypatch.setattr(linear, "_CHUNK", 64)
    assert (langid.counts(text) == whole).all()
    assert (linear.feature_set(text, np.zeros(linear.D, bool)) == f).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.97
    assert np.mean((s >= 0.5) == y) > 0.97


def identity_rows(n=400):
    """Toxic texts name one group far more often than clean ones do, but are toxic through other words."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        toxic = i % 2
        filler = " ".join(rng.choice(["house", "river", "green", "walk", "table", "music", "stone", "light"], 12))
        group = "muslims" if rng.random() < (0.9 if toxic else 0.1) else "christians"
        rows.append((f"{filler} {group} {'horrid filth' if toxic and rng.random() < 0.9 else 'fine people'} {filler}", toxic))
    return rows


def test_swapped_identities_do_not_move_the_score(spark):
    rows = spark.createDataFrame(identity_rows(), "text string, y int")
    mark = np.zeros(linear.D, bool)
    gap = {}
    for weight in (0.0, toxicity.PAIR_WEIGHT, 20.0):
        m = toxicity.fit(rows, pair_weight=weight)
        z = lambda t: m.logit(linear.feature_set(t, mark))
        gap[weight] = abs(z("house river muslims fine people walk table") - z("house river christians fine people walk table"))
        assert z("green stone horrid filth light") > z("green stone fine people light")
    assert gap[20.0] < 0.3 * gap[0.0] and gap[toxicity.PAIR_WEIGHT] < 0.3 * gap[0.0]


def test_swaps():
    assert toxicity.swapped("Women and men, WOMENFOLK") == "Men and girls, WOMENFOLK"
    assert toxicity.swapped("no term here") == "no term here"


def test_toxicity_of_odd_rows(spark, odd, make):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    some = labels([(i, 1, i % 2) for i in range(1, 9)] + [(6, 1, 0), (5, None, None), (None, 1, 1)])
    for lab in (some, labels([])):
        got = toxicity.report(odd, lab)
        assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.report(make([]), some).count() == 0


def test_quality_on_rows_that_did_not_teach(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in cotrain.report(docs, labels).join(labels, "doc_id").collect() if held(r["doc_id"], 5) == 0]
    y, p = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert np.mean(y == p) > 0.92 and p[y == 1].mean() > 0.95


def test_the_layer_is_fitted_in_small_memory(monkeypatch):
    rng = np.random.default_rng(3)
    r, y = np.where(rng.random(20000) < 0.8, rng.normal(size=20000), 0.0), np.arange(1001) % 2
    parts = [np.flatnonzero((rng.random(20000) < 0.3) & (r != 0)).astype("<u4") for _ in range(1000)] + [np.empty(0, "<u4")]
    rows = linear.Rows.of(parts)
    tracemalloc.start()
    w, b = linear.logistic(rows, y, r, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows.ids) > 4_000_000 and peak < 60e6
    monkeypatch.setattr(linear, "HELD", 1000)
    few, c = linear.logistic(rows, y, r, steps=3)
    assert np.allclose(w, few, atol=1e-9) and abs(b - c) < 1e-9 and not w[r == 0].any()
    x = np.zeros((1001, 20000))
    for i, p in enumerate(parts):
        x[i, p] = r[p] / np.sqrt((r[p] ** 2).sum() + 1e-9)
    held = linear.UnitRows(rows, r)
    assert np.allclose(held.dot(w), x @ w) and np.allclose(held.back(y - 0.5), x.T @ (y - 0.5))


def test_views_stay_apart_and_odd_rows(spark, odd, make):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = cotrain.report(odd, labels([(i, i % 2, 0) for i in range(1, 9)]))
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {(r["score"], r["predicted"]) for r in cotrain.report(odd, labels([])).collect()} == {(0.5, 1)}
    assert cotrain.report(make([]), labels([(1, 1, 0)])).count() == 0


def plain_rounds(rows, teaching, edges, rounds, sure):
    """Class sums after co-training rounds, with dictionaries over plain rows (text, source, lang, y, held)."""
    mark, views = np.zeros(linear.D, bool), cotrain.Views(edges)
    look = lambda v, r: (linear.feature_set(r[0], mark), v.columns(r[1], r[2], cotrain.numbers(r[0])))

    def sums(pairs):
        text, meta = np.zeros((2, linear.D + 1)), np.zeros((2, cotrain.COLUMNS + 1))
        for (f, m), to_text, to_meta in pairs:
            if to_text is not None:
                text[to_text, f] += 1
                text[to_text, -1] += 1
            if to_meta is not None:
                meta[to_meta, m] += 1
                meta[to_meta, -1] += 1
        return text, meta
    base = sums((look(views, r), r[3], r[3]) for r in rows if not r[4])
    now = base
    for _ in range(rounds):
        v, _, _ = cotrain._ratios(views, *now)
        held = [r for r in rows if r[4]]
        y = np.array([r[3] for r in held])
        zt = np.array([v.text.logit(look(v, r)[0]) for r in held])
        zm = np.array([v.meta.logit(look(v, r)[1]) for r in held])
        a, b, c, d = *linear.platt(zt, y), *linear.platt(zm, y)
        pairs = []
        for r in teaching:
            f, m = look(v, r)
            p, q = linear.sigmoid(a * v.text.logit(f) + b), linear.sigmoid(c * v.meta.logit(m) + d)
            pick = lambda x: 1 if x >= sure else 0 if x <= 1 - sure else None
            pairs.append(((f, m), pick(q), pick(p)))
        now = [x + z for x, z in zip(base, sums(pairs))]
    return now


def test_rounds_match_plain_co_training_over_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    def row(i):
        good = i % 2
        text = " ".join(rng.choice(["calm", "clear", "river", "stone", "the"] if good else ["spam", "click", "offer", "win", "the"], 12))
        return (text if rng.random() < 0.7 or good else text.upper() + " !!!", f"s{good}" if rng.random() < 0.8 else "s2", "en", good, bool(rng.random() < 0.3))
    rows, teaching = [row(i) for i in range(80)], [row(i) for i in range(200)]
    frame = lambda r: spark.createDataFrame(r, "text string, source string, lang string, y int, held boolean")
    got = []
    real = cotrain.class_sums
    monkeypatch.setattr(cotrain, "class_sums", lambda *a: got.append(real(*a)) or got[-1])
    views, _ = cotrain.fit(frame(rows), frame(teaching).drop("held"), rounds=2)
    want = plain_rounds(rows, teaching, views.edges, 2, cotrain.SURE)
    for mine, base, plain in zip(got[2], got[0], want):
        assert np.array_equal(mine + base, plain)
    assert want[0][:, -1].sum() > sum(not r[4] for r in rows)


def test_a_repeated_id_is_sampled_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "s", 6) for i in range(3000)] + [(i, f"other {i}", "en", "s", 7) for i in range(2, 60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(docs, labels, 20).count() <= 60
    assert cotrain.samples(docs, labels, 20)[0].count() <= 60


def test_pseudo_labels_teach_the_other_view(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        good = i % 2
        words = " ".join(rng.choice(["calm", "clear", "river"] if good else ["spamword", "clickbait", "offer"], 20))
        rows.append((i, words if good else words.upper() + " !!! ###", "en", "s1" if good else "s2"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    r = cotrain.report(docs, labels).where("doc_id >= 40").select(F.avg((F.col("predicted") == F.col("doc_id") % 2).cast("int"))).first()
    assert r[0] > 0.98
