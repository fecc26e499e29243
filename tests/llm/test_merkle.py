import hashlib
import zlib

import pytest

from signalops.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    return H(*[enc(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in merkle.FIELDS])


def plain(rows):
    """[(doc_id, leaf, subroot, root, proof, folded, verified)] by walking plain trees."""
    paths, subroot, langs, subs = {i: [] for i in range(len(rows))}, {}, {}, []
    for i, r in enumerate(rows):
        langs.setdefault(r["lang"], []).append(i)

    def tree(nodes):
        while len(nodes) > 1:
            runs = [nodes[k:k + 2] for k in range(0, len(nodes), 2)]
            for run in runs:
                for j, (members, _) in enumerate(run):
                    for i in members:
                        paths[i].append(("".join(h for _, h in run[:j]), "".join(h for _, h in run[j + 1:])))
            nodes = [([i for m, _ in run for i in m], H(*[h for _, h in run])) for run in runs]
        return nodes[0]

    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        order = sorted(langs[lang], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf(rows[i])))
        subs.append(tree([([i], leaf(rows[i])) for i in order]))
        subroot |= {i: subs[-1][1] for i in subs[-1][0]}
    root, out = tree(subs)[1], []
    for i, r in enumerate(rows):
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        x = leaf(r, int(hit))
        for a, b in paths[i]:
            x = H(a, x, b)
        out.append((r["doc_id"], leaf(r), subroot[i], root, H(*[s for p in paths[i] for s in p]), x, x == root))
    return sorted(out, key=str)


def run(docs):
    return sorted(map(tuple, merkle.report(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_against_plain_trees(documents):
    assert run(documents) == plain(documents.collect())


@pytest.mark.parametrize("height", [1])
def test_many_tiers(documents, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    small = documents.where("doc_id < 60")
    assert run(small) == plain(small.collect())


def test_odd_rows(odd):
    assert run(odd) == plain(odd.collect())


def test_one_row_and_none(make):
    one = make([(3, "x")])
    got = merkle.report(one).collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == H("")
    assert merkle.report(one.where("doc_id < 0")).count() == 0


def test_clashing_columns(make, spark):
    docs = make([(1, "a"), (2, "b"), (3, "c")])
    more = docs.selectExpr("*", "'y' as g", "1 as pos", "2 as node", "3 as r", "4 as offered", "5 as path", "6 as leaf", "7 as __pid")
    assert run(docs) == run(more)


def test_path_leads_to_the_root(documents):
    m = merkle.manifest(documents)
    assert m.where(merkle.folded(m["leaf"], m["path"]) != m["root"]).count() == 0
    assert m.select("lang", "pos").distinct().count() == m.count()
