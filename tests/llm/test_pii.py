import hashlib
import re

from pyspark.sql import functions as F

from signalops.llm import pii, spans

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d),
                    "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def agrees(docs):
    texts = docs.select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.report(docs).collect()), key=str)
    want = []
    for r in texts:
        b = plain(r["text"])
        want.append((r["doc_id"], hashlib.sha256(",".join(b).encode()).hexdigest(), *[sum(x.startswith(k + ":") for x in b) for k, _ in BASE]))
    assert got == sorted(want, key=str)


TRICKY = ["a@b.c and x.y+z@host-1.example.org, no@dot 😀 q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 then 4111-1111-1111-1112",
          "+1 (555) 123-4567 and +49.30 1234567890123456", "é 4111111111111111 ñ +33 1 23 45 67 89\n+12", "1" * 30000 + " a@b.co", "4111 1111 1111 1111" * 2,
          "a@b.c" * 700, "00000000000000 1.1.1.1" + " 7" * 500]


def test_base_spans_match_plain_patterns(documents, make, odd):
    agrees(documents)
    agrees(make(list(enumerate(TRICKY))).union(odd))


def test_positions_in_long_lists(spark):
    text = "".join(f"é{i:05d}x" for i in range(1500))
    r = spark.createDataFrame([(text,)], "t string").select(spans.found(F.col("t"), "[0-9]{5}").alias("s")).first()["s"]
    assert [(x["start"], x["stop"], x["match"]) for x in r] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]{5}", text)]
    assert r[3]["before"] == "xé" and r[3]["after"] == "x"


def test_looser_spans_are_added_and_base_ones_stay(make):
    cards = ["4111111111111111", "4012888888881881", "5500005555555559", "4222222222222"]
    rows = [(i, f"pay by card {cards[i % 4]} now, id {10**13 + 7 * i} or call +1 555 123 {4000 + i} and mail u{i}@h.org from 10.0.0.{i} not 10.0.0.{300 + i} v +12 3") for i in range(60)]
    rows += [(100, "card 4111.1111.1111.1111 here"), (101, "write joe (at) host (dot) org today"), (102, "nothing to see")]
    agrees(make(rows))
    got = {r["doc_id"]: r["spans"] for r in pii.report(make(rows)).collect()}
    assert got[100] == "card:5:24" and got[101] == "email:6:29" and got[102] == ""
    assert all(set(plain(t)) <= set(got[i].split(",")) for i, t in rows if plain(t))
    clear = {r["doc_id"]: r["text"] for r in pii.redacted(make(rows)).collect()}
    assert clear[100] == "card [card] here" and clear[102] == "nothing to see" and "@" not in clear[5]


def test_empty_table(make):
    assert pii.report(make([])).count() == 0


def test_a_span_beaten_by_a_lost_one_stays(spark):
    of = lambda rows: spark.createDataFrame([(rows,)], "m array<struct<score double, kind_no int, start int, stop int>>").select(pii.apart(F.col("m")).alias("m")).first()["m"]
    chain = [(0.7, 1, 0, 10), (0.8, 2, 8, 20), (0.9, 3, 18, 30), (0.9, 3, 40, 45)]
    assert sorted((x["start"], x["stop"]) for x in of(chain)) == [(0, 10), (18, 30), (40, 45)]
    assert [(x["kind_no"], x["start"], x["stop"]) for x in of([(0.9, 2, 0, 5), (0.9, 1, 0, 5), (0.9, 1, 0, 7)])] == [(1, 0, 7)]
    assert of([]) == []
