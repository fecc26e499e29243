import tracemalloc

import numpy as np

from signalops.llm import tiling as g

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def plain_tiles(doc, item, k):
    """Greedy string tiling by trying every pair of starts, longest first, then smallest positions."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n >= k and (best is None or (-n, d, i) < best):
                    best = (-n, d, i)
        if best is None:
            return tiles
        n, d, i = best
        tiles.append((d, i, -n))
        used_d.update(range(d, d - n))
        used_i.update(range(i, i - n))


def seeds(tokens, k):
    known = {t: hash(t) & (2**63 - 1) for t in tokens}
    h = g.window_hashes(np.array([known[t] for t in tokens], np.uint64), k)
    return np.arange(len(h)), h


def test_tiles_match_a_plain_search():
    rng = np.random.default_rng(5)
    for trial in range(200):
        kinds, k = int(rng.integers(1, 4)), (1, 3, 5)[trial % 3]
        item, doc = [f"t{x}" for x in rng.integers(0, kinds, 14)], [f"t{x}" for x in rng.integers(0, kinds, rng.integers(0, 40))]
        if trial % 2:
            doc[4:4 + 7] = item[2:9]
        assert g.tile(*seeds(doc, k), *seeds(item, k), k) == plain_tiles(doc, item, k)


def test_a_repeated_token_stays_within_memory_linear_in_the_texts():
    tracemalloc.start()
    d, i = seeds(["x"] * 1_000_000, 5), seeds(["x"] * 1000, 5)
    assert g.tile(*d, *i, 5) == [(0, 0, 1000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_long_periodic_texts(spark, make):
    got = run(spark, make, [(1, "x " * 160_000), (2, "x y " * 50_000), (3, "z " * 1000)], [(1, "x " * 200), (2, "x y z " * 60)])
    assert {d: (r["contaminated"], r["coverage"]) for d, r in got.items()} == {1: (True, 1.0), 2: (False, 0.0), 3: (False, 0.0)}


def test_a_template_of_many_items_makes_no_pairs(spark, make):
    head = "answer the question below now"
    bench = items(spark, [(i, head + " " + " ".join(f"i{i}w{k}" for k in range(25))) for i in range(40)])
    s = g.cut(g.item_seeds(bench))
    docs = make([(1, head + " and nothing else"), (2, head + " " + " ".join(f"i3w{k}" for k in range(25)))])
    found = g.seeds_of(docs, s)
    assert [r["item_id"] for r in g._pairs(found, s, 0.5).collect()] == [3]
    assert {r["doc_id"]: r["item_id"] for r in g.report(docs, bench).collect()} == {1: None, 2: 3}


def test_clashing_columns(spark, make):
    docs = make([(1, ITEM), (2, "clean")]).selectExpr("*", "'a' as content", "'b' as __content", "'c' as row", "'d' as coverage", "'e' as item_id")
    out = g.keep_clean(docs, items(spark, [(7, ITEM)]))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [tuple(r) for r in docs.where("doc_id = 2").collect()]
    assert g.report(docs, items(spark, [(7, ITEM)])).where("contaminated").count() == 1


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def run(spark, make, rows, bench):
    return {r["doc_id"]: r for r in g.report(make(rows), items(spark, bench)).collect()}


def test_whole_reordered_and_partial_passages(spark, make):
    w = ITEM.split()
    pad = " ".join(f"p{i}" for i in range(300))
    rows = [(1, f"{pad} {ITEM} {pad}"), (2, f"{pad} {' '.join(w[10:])} middle words {' '.join(w[:10])}"), (3, f"{pad} {' '.join(w[:6])} {pad}"),
            (4, pad), (5, f"{pad} {ITEM.upper().replace(' ', ', ')}!"), (6, " ".join(reversed(w)))]
    got = run(spark, make, rows, [(7, ITEM), (3, "nothing like it is in any of these documents at all")])
    assert {d: r["contaminated"] for d, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    assert got[1]["coverage"] == 1.0 and got[1]["n_tiles"] == 1 and got[2]["n_tiles"] == 2 and got[3]["coverage"] == 0
    low = {r["doc_id"]: r["coverage"] for r in g.report(make(rows), items(spark, [(7, ITEM)]), min_coverage=0.25).collect()}
    assert abs(low[3] - 0.3) < 1e-9
    clean = g.keep_clean(make(rows), items(spark, [(7, ITEM)]))
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 6] and clean.columns == make(rows).columns


def test_short_items_ties_and_odd_rows(spark, make, odd):
    got = run(spark, make, [(1, "say one two three now"), (2, "one two"), (1, "say one two three now")], [(9, "one two three"), (4, "One, two three."), (5, "?!"), (6, None)])
    assert got[1]["contaminated"] and got[1]["item_id"] == 4 and not got[2]["contaminated"]
    assert g.report(odd, items(spark, [(1, ITEM)])).count() == odd.count()
    assert g.report(odd, items(spark, [])).where("contaminated").count() == 0
    assert g.report(make([]), items(spark, [(1, ITEM)])).count() == 0
    assert g.keep_clean(odd, items(spark, [(1, "one two three")])).count() == odd.count() - 1


def test_coverage_matches_plain_tiling_on_given_tables(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    tok = lambda t: t.lower().encode().translate(g._BLANK).split()
    want = set()
    grams = {}
    for r in bench.collect():
        w = tok(r["text"])
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i:i + 5]), set()).add(r["item_id"])
    texts = {r["item_id"]: tok(r["text"]) for r in bench.collect()}
    for r in documents.collect():
        w = tok(r["text"])
        for item in set().union(*[grams.get(tuple(w[i:i + 5]), set()) for i in range(len(w) - 4)] or [set()]):
            if sum(x[2] for x in g.tile(*seeds(w, 5), *seeds(texts[item], 5), 5)) / len(texts[item]) >= g.MIN_COVERAGE:
                want.add(r["doc_id"])
    assert want and {r["doc_id"] for r in g.report(documents, bench).where("contaminated").collect()} == want
