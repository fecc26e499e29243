import hashlib
import random
import re
import zlib

import pytest

from signalops.llm import auction, repair

SCHEMA = "conv_id long, turn long, role string, text string, extra string, key string"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
STATE = {"s": 1, "u": 2, "a": 3}


def cheapest(rows):
    """(cost, edits, turns) over rows (role, text, fault): the least of all by dynamic programming on whole strings."""
    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for s, (c, e, t) in list(best.items()):
                role = {"u": "user", "a": "assistant"}[NEXT[s]]
                new = (c + 5, e + "I", t + [role + ":"])
                if STATE[NEXT[s]] not in best or new < best[STATE[NEXT[s]]]:
                    best[STATE[NEXT[s]]] = new
        return best
    best = {0: (0, "", [])}
    for role, text, fault in rows:
        new = {}

        def put(s, v):
            if s not in new or v < new[s]:
                new[s] = v
        for s, (c, e, t) in inserts(best).items():
            put(s, (c + 2, e + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] == NEXT[s] or (s == 0 and role[:1] == "s"):
                put(STATE[role[0]], (c + more, e + "K", t + [f"{role}:{text}"]))
            put(STATE[NEXT[s]], (c + 1 + more, e + "R", t + [{"u": "user", "a": "assistant"}[NEXT[s]] + ":" + text]))
        best = new
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    got = []
    for conv, r in convs.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        seen, judged, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in r:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in r if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, out = cheapest(judged)
        got.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(got, key=str)


@pytest.fixture(scope="module")
def made(spark):
    def frame(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return frame


def run(df, **options):
    return sorted(map(tuple, repair.report(df, **options).collect()), key=str)


def test_auction_finds_the_least_cheapest_path():
    rng = random.Random(5)
    for trial in range(400):
        weights = [rng.random() ** 3 for _ in repair.LETTERS]
        codes = "".join(rng.choices(repair.LETTERS, weights, k=rng.randint(1, 10) if trial < 350 else rng.randint(60, 120)))
        rows = [(repair.INITIALS[i // 3], "t", ("", "blank", "truncated")[i % 3]) for i in map(repair.LETTERS.index, codes)]
        layers = repair._layers(codes, True)
        price = auction.prices(layers, [0] * 4)
        marks, _ = auction.trace(layers, price, 0)
        assert (price[0], "".join(marks)) == cheapest(rows)[:2]


def test_prices_stay_feasible():
    layers = repair._layers("30417:285", True)
    price = auction.prices(layers, [0] * 4)
    for i, layer in enumerate(layers):
        for s, arcs in enumerate(layer):
            assert all(price[4 * i + s] <= cost + price[4 * i + s + step] for _, step, cost in arcs)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert run(df) == plain([tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in df.collect()])


@pytest.mark.parametrize("block", [3])
def test_random_conversations(made, block):
    rng = random.Random(block)
    texts = ["One.", "Two!", "three", "", " \t", "Four? ", None, "Five.\n"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(25) for t in range(rng.randint(1, 12))]
    rows += [(None, t, rng.choice(["user", "assistant"]), f"n{t}.") for t in range(6)] + [(99, None, "user", "a."), (99, None, "assistant", "b."), (99, 7, "user", "c.")]
    rows += [(98, 2, "user", "same.")] * 3
    assert run(made(rows), block=block) == plain(rows)


def test_one_long_conversation(made):
    rng = random.Random(3)
    rows = [(1, t, ("user", "assistant")[t % 2], f"{rng.randint(0, 2000)}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    assert run(made(rows), block=64) == plain(rows)


def test_empty_table_and_dropped_rows(made):
    assert run(made([])) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert run(made([(5, gone, "user", "x.")])) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_rows(made):
    rows = repair.damaged(made([(c, t, "user", f"text {t}.") for c in range(3) for t in range(5)]))
    out = repair.repaired(rows).collect()
    for c in {r["key"] for r in out}:
        roles = [r["role"] for r in sorted((r for r in out if r["key"] == c), key=lambda r: r["seq"])]
        assert roles == ["user", "assistant"] * (len(roles) // 2)
