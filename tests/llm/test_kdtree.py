import zlib

import pytest

from signalops.llm import kdtree


def by_shard(df):
    rows, out = df.collect(), {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return rows, out


def test_laws(documents):
    rows, shards = by_shard(kdtree.report(documents))
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "bytes", None)
    assert set(shards) == set(range(8))
    for part in shards.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sums, most = [sum(r["size"] for r in p) for p in shards.values()], max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 3 * most


def test_one_text_in_a_third_of_all_rows(make):
    docs = make([(i, "hot text of some words", "en", f"s{i % 5}") for i in range(3000)] + [(i, f"text {i} " * 4, "fr", f"s{i % 7}") for i in range(3000, 9000)])
    rows, shards = by_shard(kdtree.report(docs))
    sums = [sum(r["size"] for r in p) for p in shards.values()]
    assert max(sums) < 1.03 * min(sums)


def test_copies_stay_together(make):
    docs = make([(i, f"text {i // 4} " * 5, "en", f"s{i % 3}") for i in range(2000)])
    _, shards = by_shard(kdtree.report(docs))
    homes = {}
    for s, p in shards.items():
        for r in p:
            homes.setdefault(r["doc_id"] // 4, set()).add(s)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


@pytest.mark.parametrize("shards", [3])
def test_other_numbers_of_shards(documents, shards):
    rows, got = by_shard(kdtree.report(documents, shards=shards))
    assert set(got) == set(range(shards))
    assert max(sum(r["size"] for r in p) for p in got.values()) <= sum(r["size"] for r in rows) / shards + 3 * max(r["size"] for r in rows)


def test_target_bytes(documents):
    rows, got = by_shard(kdtree.report(documents, shards=None, target_bytes=100_000))
    assert len(got) == -(-sum(r["size"] for r in rows) // 100_000)


def test_odd_rows_and_empty_table(odd):
    rows, got = by_shard(kdtree.report(odd))
    assert len(rows) == odd.count()
    for p in got.values():
        assert sorted(r["slot"] for r in p) == list(range(len(p)))
    assert kdtree.report(odd.where("doc_id < 0")).count() == 0


def test_written_shards(make, spark, tmp_path):
    docs = make([(i, f"text {i} " * (1 + i % 9)) for i in range(200)]).selectExpr("*", "1 as h", "2 as part", "'q' as shard")
    kdtree.write(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in kdtree.report(docs, shards=4).collect()}
    assert {r["doc_id"]: (r["__shard"], r["__slot"]) for r in back.collect()} == want
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
