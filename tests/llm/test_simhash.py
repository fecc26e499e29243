import itertools

import numpy as np
import pytest
import xxhash

from signalops.llm import graph, simhash as s


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, fp). Union-find over all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted([(d, f"{f:016x}", least.get(find(f))) for d, f in rows], key=str)


def test_every_pair_within_the_radius_shares_a_table():
    m = s.masks()
    assert len(m) == 15 and all(m)
    for bits in itertools.combinations(range(64), 3):
        d = sum(1 << b for b in bits)
        assert any(d & k == 0 for k in m)


def test_fingerprint_matches_a_plain_count(documents):
    for r in documents.select("text").limit(25).collect():
        assert s.fingerprint(r["text"]) == plain_fingerprint(r["text"])
    assert s.fingerprint(None) == s.fingerprint(" \n") == 0
    assert s.fingerprint("One two") == plain_fingerprint("one TWO")


def test_components_match_all_pairs(documents):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents.collect()]
    got = sorted([tuple(r) for r in s.report(documents).collect()], key=str)
    assert got == plain_components(rows)


@pytest.mark.parametrize("small, cell", [(24, 512), (4, 16)])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, small, cell):
    monkeypatch.setattr(s, "SMALL", small)
    monkeypatch.setattr(s, "CELL", cell)
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 4)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 4), False)) for c in core for _ in range(60)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)} | {2**64 - 1, 2**64 - 2}
    signed = [(f if f < 2**63 else f - 2**64,) for f in fps]
    links = s.links(spark.createDataFrame(signed, "fp long"))
    un = lambda x: x % 2**64
    pairs = [(un(r["a"]), un(r["b"])) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    roots = {un(r["node"]): un(r["root"]) for r in graph.components(links).collect()}
    want = {}
    for d, f, c in plain_components([(f, f) for f in fps]):
        want.setdefault(c, set()).add(d)
    have = {}
    for f in fps:
        have.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = graph.components(chain.union(spark.createDataFrame([(900, 901), (905, 905)], "a long, b long"))).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len(got) == len(roots) == 303 and all(roots[i] == 0 for i in range(301)) and roots[901] == 900


def test_odd_rows(odd, make):
    got = s.report(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {1}
    kept = s.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "6", "7", "8", "None", "None"]
    assert s.report(make([])).count() == 0 and s.keep_first(make([])).count() == 0


def test_one_of_each_group_stays(make):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base) for i in range(9, 3, -1)] + [(20, base + " end"), (30, "other words only here " * 5)]
    assert sorted(r["doc_id"] for r in s.keep_first(make(rows)).collect()) == [4, 30]
