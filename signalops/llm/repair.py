"""Conversation structure repair: the cheapest edits by an auction over the lattice of (row, state).

States are: nothing yet, after the system turn, after a user turn, after an assistant turn. Keep, Rerole and Delete lead from a row to the
next, Insert stays before a row. The auction (``auction``) settles integer prices and traces the ASCII-least of the cheapest edit strings.

Only one letter a row (role initial and fault) takes part. A conversation is cut into blocks of ``BLOCK`` rows. Where there are several, each block's
costs from entry to exit states are found apart, an auction over these blocks gives every block the exact prices past its end, and the blocks
trace their edits in parallel; one task sees a few dozen numbers a block. Texts are moved once: they meet the edit string in the order of
their turns and stream through in batches, however long the conversation is.

Faults: the first of blank, duplicate (role and text seen earlier) and truncated counts. Defined cases: a null conv_id is a conversation of its own;
null turns come first; rows of one turn go by role, then by the hash of role and text; a null or empty role has an initial that is not
legal; null texts are blank; a conversation without rows has zero counts, no edits and the hash of the empty text; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalops.functions.lineage import cut
from signalops.llm import auction
from signalops.llm.ranks import running

BLOCK = 1024
# The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = ("user", "assistant")
INITIALS, LETTERS = "sua-", "0123456789:;"
_AFTER = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after the user or assistant turn that may come next


def _row_arcs(initial: str, fault: int) -> list[list[tuple]]:
    """Arcs of a row from each state; fault 1 must be deleted, 2 is truncated."""
    layer = []
    for s in range(4):
        arcs = [("D", 4, DELETE), ("I", _AFTER[s] - s, INSERT)]
        more = TRUNCATED if fault == 2 else 0
        to = 1 if initial == "s" and s == 0 else _AFTER[s] if initial == "-ua"[_AFTER[s] - 1] else None
        if fault != 1:
            arcs += [("K", 4 + to - s, KEEP + more)] if to else []
            arcs += [("R", 4 + _AFTER[s] - s, REROLE + more)]
        layer.append(arcs)
    return layer


_ARCS = {c: _row_arcs(INITIALS[i // 3], i % 3) for i, c in enumerate(LETTERS)}
_END = [[("", 4 - s, 0)] * (s in (0, 3)) + [("I", _AFTER[s] - s, INSERT)] for s in range(4)]


def _layers(codes: str, last: bool) -> list:
    return [_ARCS[c] for c in codes] + [_END] * last


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text after the stated damage; h: hash of role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    d = conversations.select(_key().alias("key"), "turn", blank("role").alias("role"), blank("text").alias("text"), k.alias("k")).where("k <> 0")
    d = d.select("key", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                 F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    return d.withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def lettered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored blocks of the given rows (key, turn, role, text, h): key, block, last, codes, their counts and border values."""
    initial = F.substring("role", 1, 1)
    d = rows.select("key", "turn", "role", "h", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
                    (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
                    F.monotonically_increasing_id().alias("r"))
    d = running(cut(d), "key", ["turn", "role", "h", "r"])
    first = cut(d.groupBy("key", "h").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    d = d.join(first, ["key", "h"], "left")
    again, kind = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)), F.col("kind")
    d = d.withColumn("kind", F.when(F.col("blank"), "b").when(again, "d").when(F.col("open"), "t").otherwise("o"))
    fault = F.when(kind.isin("b", "d"), 1).when(kind == "t", 2).otherwise(0)
    code = F.substring(F.lit(LETTERS), 3 * (F.expr(f"locate(initial, '{INITIALS}')") - 1) + fault + 1, F.lit(1))
    d = d.select("key", F.floor(F.col("pos") / block).alias("block"), "kind", F.struct("pos", code.alias("code"), "initial", "turn").alias("row"))
    b = d.groupBy("key", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), *[F.sum((kind == k).cast("bigint")).alias(n) for k, n in
                                                                                          (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    pair = lambda x, i: F.concat(x["initial"], F.get("rows", i + 1)["initial"])
    illegal = F.size(F.filter(F.slice("rows", 1, F.size("rows") - 1), lambda x, i: ~pair(x, i).isin("su", "ua", "au")))
    turns = F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))
    return cut(b.select("key", "block", "blank", "duplicate", "truncated", F.array_join("rows.code", "").alias("codes"),
                        illegal.cast("bigint").alias("illegal"), F.size(turns).cast("bigint").alias("turns"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"),
                        F.struct("block", F.element_at("rows", 1)["initial"].alias("i0"), F.element_at("rows", -1)["initial"].alias("i1"),
                                 F.element_at("rows", 1)["turn"].alias("t0"), F.element_at("rows", -1)["turn"].alias("t1")).alias("edge")))


def counts(blocks: DataFrame) -> DataFrame:
    """key, n_blocks, gaps, blank, duplicate, truncated, illegal per conversation; borders of blocks are joined here."""
    total = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n_blocks"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                                      F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list("edge")).alias("edges"))
    before = lambda i: F.get("edges", i - 1)
    borders = F.size(F.filter("edges", lambda e, i: (i > 0) & ~F.concat(before(i)["i1"], e["i0"]).isin("su", "ua", "au")))
    same = F.size(F.filter("edges", lambda e, i: (i > 0) & (before(i)["t1"] == e["t0"])))
    return total.select("key", "n_blocks", "blank", "duplicate", "truncated", (F.col("illegal") + borders).alias("illegal"),
                        F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - same), F.lit(0)).alias("gaps"))


def _price_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, codes, last): costs from every entry to every exit state; of a last block, to the end."""
    for b in batches:
        costs = []
        for codes, last in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            layers, found = _layers(codes, last), []
            for x in range(4):
                exits = [0 if last or y == x else auction.INF for y in range(4)]
                found.append([None if p == auction.INF else p for p in auction.prices(layers, exits)[:4]])
            costs.append([found[x][q] for q in range(4) for x in range(4)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(costs, pa.list_(pa.int64()))], ["key", "block", "costs"])


def _past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, list of (block, costs)): the exact prices past the end of every block of a conversation."""
    for b in batches:
        for key, blocks in zip(b.column(0), b.column(1).to_pylist()):
            layers = [[[(x, 4 + x - q, m["costs"][4 * q + x]) for x in range(4) if m["costs"][4 * q + x] is not None] for q in range(4)] for m in blocks]
            price = auction.prices(layers[:-1], [arcs[0][2] for arcs in layers[-1]], window=1)
            at = [price[i:i + 4] for i in range(4, len(price), 4)] + [[0] * 4]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n), pa.array([m["block"] for m in blocks], pa.int64()), pa.array(at, pa.list_(pa.int64()))],
                                             ["key", "block", "exits"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, codes, last, exits): for each entry state the cost to the end, the exit state and the edit string."""
    for b in batches:
        cost, out, audit = [], [], []
        for block, codes, last, exits in zip(*[b.column(i).to_pylist() for i in range(1, 5)]):
            layers = _layers(codes, last)
            price = auction.prices(layers, exits or [0] * 4)
            found = [auction.trace(layers, price, q) for q in range(1 if exits is None else 4)]
            cost.append(price[0]), out.append([x for _, x in found]), audit.append(["".join(m) for m, _ in found])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost, pa.int64()), pa.array(out, pa.list_(pa.int32())), pa.array(audit, pa.list_(pa.string()))],
                                         ["key", "block", "cost", "out", "audits"])


def edits(blocks: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """key, cost, audit per conversation."""
    b = blocks.select("key", "block", "codes").join(n_blocks.select("key", "n_blocks"), "key")
    b = cut(b.select("key", "block", "codes", (F.col("block") == F.col("n_blocks") - 1).alias("last"), (F.col("n_blocks") > 1).alias("many")))
    costs = b.where("many").select("key", "block", "codes", "last").mapInArrow(_price_matrices, "key string, block bigint, costs array<bigint>")
    past = (costs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("m"))
            .mapInArrow(_past, "key string, block bigint, exits array<bigint>"))
    b = b.join(cut(past), ["key", "block"], "left").select("key", "block", "codes", "last", "exits")
    e = cut(b.mapInArrow(_edits, "key string, block bigint, cost bigint, out array<int>, audits array<string>"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "cost", "out", "audits")))
    e = e.groupBy("key").agg(ordered.alias("b"))
    start = F.struct(F.lit(0).alias("q"), F.array().cast("array<string>").alias("parts"))
    walk = F.aggregate("b", start, lambda a, x: F.struct(F.get(x["out"], a["q"]).alias("q"), F.concat(a["parts"], F.array(F.get(x["audits"], a["q"]))).alias("parts")))
    return e.select("key", F.element_at("b", 1)["cost"].alias("cost"), F.array_join(walk["parts"], "").alias("audit"))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, role, text), the edit string first: the repaired rows of each conversation, in order."""
    key, audit, at, state, seq = None, "", 0, 0, 0
    for b in batches:
        out = []

        def put(role, text, edit):
            nonlocal state, seq
            state = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
            out.append((key, seq, role, text, edit))
            seq += 1

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(ROLES[_AFTER[state] - 2], "", "I")
                at += 1

        for k, kind, role, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if kind == 0:
                inserts()
                key, audit, at, state, seq = k, text, 0, 0, 0
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role if edit == "K" else ROLES[_AFTER[state] - 2], text, edit)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                                         ["key", "seq", "role", "text", "edit"])
    out = []
    for _ in range(len(audit) - at):
        state = _AFTER[state]
        out.append((key, seq + len(out), ROLES[state - 2], "", "I"))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                                     ["key", "seq", "role", "text", "edit"])


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """key, seq, role, text, edit: the repaired rows, each conversation in order within one partition."""
    plan = audits.select("key", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"),
                         F.col("audit").alias("text"))
    both = plan.union(rows.select("key", F.lit(1).alias("kind"), "turn", "role", "h", "text")).repartition("key")
    return (both.sortWithinPartitions("key", "kind", "turn", "role", "h").select("key", "kind", "role", "text")
            .mapInArrow(_replay, "key string, seq bigint, role string, text string, edit string"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ``role:text`` lines of each run of rows with one key."""
    key, h, names = None, None, ["key", "repaired_sha256"]
    for b in batches:
        done = []
        for k, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if k != key or h is None:
                if h is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], names)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, seq, role, text, edit of the repaired conversations of ``rows`` (key, turn, role, text, h; no damage is done)."""
    blocks = lettered(rows, block)
    return replayed(rows, edits(blocks, counts(blocks)))


def report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per original conv_id: the counts of its damaged rows, the cheapest repair and the hash of what results."""
    rows = damaged(conversations)
    blocks = lettered(rows, block)
    found = cut(counts(blocks))
    audits = cut(edits(blocks, found))
    hashes = replayed(rows, audits).mapInArrow(_digest, "key string, repaired_sha256 string")
    every = conversations.select(_key().alias("key"), "conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (every.join(found, "key", "left").join(audits, "key", "left").join(hashes, "key", "left")
            .select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
