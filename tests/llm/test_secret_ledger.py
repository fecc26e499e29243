import hashlib
import re

from signalops.llm import secret_ledger as s

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def plain(text):
    out = []
    rules = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    for o, (k, p) in enumerate(rules):
        for m in re.finditer(p, text or ""):
            if (k == "assign" and len(m[2]) >= 6) or (k == "access" and len(m[0]) >= 20) or (k == "hex" and len(m[0]) >= 24):
                out.append((m.start(), o, m.end(), k))
    return [f"{k}:{a}:{b}" for a, o, b, k in sorted(out)]


def agrees(docs):
    got = sorted(((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in s.report(docs).collect()), key=str)
    want = [(r["doc_id"], hashlib.sha256(",".join(b := plain(r["text"])).encode()).hexdigest(), *[sum(x.startswith(k + ":") for x in b) for k in s.BASE])
            for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(want, key=str)


TRICKY = [f"Password = 'hunter2x' {KEY} token==abcdef", "é secret: short api_key:\"abcdef0123\" APIKEY=1234567", "0123456789abcdef01234567 and 0123456789abcdefABCDEF012345",
          "AKIAAKIA" + "Z" * 10 + " AKIA12", "token=token=abcdefgh passwd : x", "f" * 50000]


def test_base_spans_match_plain_patterns(documents, make, odd):
    agrees(documents)
    agrees(make(list(enumerate(TRICKY))).union(odd))


def test_only_unseen_pairs_are_scanned(spark, make, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = make([(1, TRICKY[0]), (2, TRICKY[0]), (3, "clean words")])
    assert {r["doc_id"]: len(r["findings"]) for r in s.scan(first, ledger).collect()} == {1: 3, 2: 3, 3: 0}
    rows = s.read_ledger(spark, ledger)
    assert rows.count() == 2 * len(s.RULES)
    again = s.scan(first.union(make([(9, "clean words")])), ledger)
    assert again.count() == 4 and s.read_ledger(spark, ledger).count() == 2 * len(s.RULES)
    newer = tuple((k, v + (k == "hex"), p) for k, v, p in s.RULES)
    s.scan(first.union(make([(10, "new " + KEY)])), ledger, newer).collect()
    after = s.read_ledger(spark, ledger)
    assert after.count() == 2 * len(s.RULES) + 2 + len(s.RULES)
    assert after.where("rule = 'hex' and version = 2").count() == 3 and after.where("rule = 'access'").count() == 3


def test_added_kinds(make):
    rows = [(1, "x -----BEGIN RSA PRIVATE KEY----- y"), (2, "ghp_" + "a1" * 20), (3, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), (4, "xoxb-123456789012-abcdefghij")]
    got = {r["doc_id"]: r["spans"] for r in s.report(make(rows)).collect()}
    assert [got[i].split(":")[0] for i in (1, 2, 3, 4)] == ["key_block", "vcs_token", "web_token", "chat_token"]


def test_empty_table(make):
    assert s.report(make([])).count() == 0
