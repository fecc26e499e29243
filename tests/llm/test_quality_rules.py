import re
from collections import Counter, defaultdict

from signalops.llm import quality_rules as q


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    pos = {p + k for p, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(pos))


def verdicts(rows, limit):
    norm = lambda t: [x for x in (re.sub(r"[ \t\x0B\f\r]+", " ", y.lower()).strip(" ") for y in (t or "").split("\n")) if x]
    found = defaultdict(set)
    for d, t, s in rows:
        for x in norm(t):
            found[s or "", x].add((d is None, d or 0, t or ""))
    freq = {k: min(v) for k, v in found.items() if len(v) > limit}
    out = []
    for d, t, s in rows:
        n, _, _, _, rep = plain(t)
        gone = sum(len(x.split(" ")) for x in norm(t) if freq.get((s or "", x), (d is None, d or 0, t or "")) != (d is None, d or 0, t or ""))
        bad = n < 50 or 100 * rep > 50 * n
        out.append((d, bad, not bad and n - gone >= 50 and n - gone >= 0.5 * n))
    return sorted(out, key=str)


def test_measures_match_a_plain_count(documents):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in q.report(documents).collect()}
    assert got == {r["doc_id"]: plain(r["text"]) for r in documents.select("doc_id", "text").collect()}


def test_lines_above_the_limit_are_removed(make):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line = "the  Common line " * 30
    rows = [(i, body(i) + "\n" + line, "en", "hot") for i in range(6)] + [(10 + i, line + "\n" + body(99)[:200], "en", "hot") for i in range(1)]
    rows += [(20, body(7) + "\n" + line, "en", "cool"), (21, body(8), "en", None), (22, body(8), "en", None)]
    rows += [(30 + i, line + f"\n{i}", "en", "deep") for i in range(5)]
    got = q.report(make(rows), max_docs=3).collect()
    assert sorted([(r["doc_id"], r["base_failed"], r["kept"]) for r in got], key=str) == verdicts([(r[0], r[1], r[3]) for r in rows], 3)
    assert sum(r["n_removed_lines"] for r in got) == 6 + 4


def test_depleted_documents_go_and_the_owner_stays(make):
    shared = [" ".join(f"s{j}w{k}" for k in range(12)) for j in range(8)]
    rows = [(i, "\n".join(shared + [f"own {i} " + " ".join(f"o{i}{k}" for k in range(10))]), "en", "h") for i in range(1, 7)]
    rows.append((1, rows[0][1], "en", "h"))  # a repeated row shares the verdict
    got = sorted((r["doc_id"], r["kept"]) for r in q.report(make(rows), max_docs=4).collect())
    assert got == [(1, True), (1, True)] + [(i, False) for i in range(2, 7)]
    kept = q.keep(make(rows), max_docs=4)
    assert kept.columns == make(rows).columns and kept.count() == 2


def test_odd_rows_and_empty_table(odd, make):
    got = q.report(odd).collect()
    assert len(got) == odd.count() and not any(r["kept"] for r in got)
    assert q.report(make([])).count() == 0 and q.keep(make([])).count() == 0


def without_frequent_lines(rows, limit):
    """doc_id -> text without the lines above the limit, of (doc_id, text, source) rows."""
    norm = lambda x: re.sub(r"[ \t\x0B\f\r]+", " ", x.lower()).strip(" ")
    found = defaultdict(set)
    for d, t, s in rows:
        for x in filter(None, map(norm, (t or "").split("\n"))):
            found[s or "", x].add((d is None, d or 0, t or ""))
    owner = {k: min(v) for k, v in found.items() if len(v) > limit}
    own = lambda d, t: (d is None, d or 0, t or "")
    return {d: "\n".join(x for x in (t or "").split("\n") if owner.get((s or "", norm(x)), own(d, t)) == own(d, t)) for d, t, s in rows}


def test_copies_on_one_host_count_as_documents(make):
    text = " ".join(f"w{k}" for k in range(60)) + "\nshared line"
    got = {r["doc_id"]: (r["n_removed_lines"], r["kept"]) for r in q.report(make([(i, text) for i in range(200)])).collect()}
    assert got == {i: (0, True) if i == 0 else (2, False) for i in range(200)}


def test_clashing_columns(make):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + "\ncommon line") for i in range(6)]
    more = ["'a' as host", "'b' as content", "'c' as __content", "'d' as __text", "'e' as row", "'f' as gone", "'g' as id", "'h' as parts", "'i' as __source"]
    docs = make(rows).selectExpr("*", *more)
    out = q.keep(docs, max_docs=4)
    plain = {r["doc_id"]: r["text"] for r in q.keep(make(rows), max_docs=4).collect()}
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == plain
    assert {tuple(r)[6:] for r in out.collect()} == {tuple("abcdefghi")}


def test_kept_texts_lose_their_frequent_lines(make, documents):
    body = lambda i: "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(30)) for j in range(3))
    rows = [(i, f"Common  LINE\n{body(i)}\n\n common line\nlast {i}", "en", "hot") for i in range(1, 7)]
    rows += [(20, body(20) + "\ncommon line", "en", "cool"), (21, body(21) + "\n", "en", "hot"), (3, rows[2][1], "en", "hot")]
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in q.keep(make(rows), max_docs=4).collect())
    want = without_frequent_lines([(r[0], r[1], r[3]) for r in rows], 4)
    assert want[1] == rows[0][1] and want[2] == f"{body(2)}\n\nlast 2" and want[20] == rows[6][1]
    assert got == sorted((r[0], want[r[0]], len(want[r[0]])) for r in rows)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    want, passed = without_frequent_lines(rows, 2), {d for d, _, k in verdicts(rows, 2) if k}
    assert {r["doc_id"]: r["text"] for r in q.keep(documents, max_docs=2).collect()} == {d: want[d] for d in passed}
    assert any(want[d] != t for d, t, _ in rows if d in passed)
