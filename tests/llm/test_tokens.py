import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from signalops.llm import coder, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 299), max_size=80), max_size=6), st.sampled_from([300, 49408, 200000]))
def test_blocks_come_back(lists, vocab):
    blocks = [np.array(x, np.uint32) for x in lists]
    back = coder.decode(coder.encode(blocks, vocab))
    assert [x.tolist() for x in back] == lists


def test_blocks_are_independent_and_shrink():
    rng = np.random.default_rng(0)
    blocks = [(rng.zipf(1.4, n) % 3000).astype(np.uint32) for n in (4096, 4096, 1000, 17, 1, 0)]
    coded = coder.encode(blocks, 49408)
    assert (coder.decode([coded[1]])[0] == blocks[1]).all()
    assert [c for b in blocks for c in coder.encode([b], 49408)] == coded
    assert sum(map(len, coded)) < 2 * sum(map(len, blocks)) * 0.8


def test_repeats_cost_little():
    phrase = np.random.default_rng(1).integers(0, 49408, 40).astype(np.uint32)
    assert len(coder.encode([np.tile(phrase, 100)], 49408)[0]) < 1500


def test_damage_is_found():
    good = coder.encode([np.arange(500, dtype=np.uint32)], 49408)[0]
    bad = bytearray(good)
    bad[60] ^= 1
    for c in (bytes(bad), b"XXXXX" + good[5:]):
        with pytest.raises(ValueError):
            coder.decode([c])
    with pytest.raises(ValueError):
        coder.encode([np.array([300], np.uint32)], 300)


def plain(docs):
    t = Tokenizer.from_file(PATH)
    rows, at = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        rows.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return rows


def test_digest_matches_the_library(documents):
    got = sorted(tuple(r) for r in tokens.round_trip(documents, PATH).collect())
    assert got == sorted(plain(documents))


def test_odd_rows_and_readers(spark, odd, make, tmp_path):
    more = make([(40, "a<|endoftext|>b I'LL don't ... ok"), (41, "x y　z\x1cq é ΑΣ İ"), (42, "w\r\nv\tu")])
    docs = odd.union(more)
    tokens.write(docs, str(tmp_path / "t"), PATH)
    blocks = spark.read.parquet(str(tmp_path / "t"))
    got = sorted([tuple(r) for r in tokens.digest(blocks).collect()], key=str)
    assert got == sorted(plain(docs), key=str)
    ids = {r["doc_id"]: r["ids"] for r in tokens.ids_of(blocks).where("doc_id in (5, 40)").collect()}
    t = Tokenizer.from_file(PATH)
    assert ids[40] == t.encode("a<|endoftext|>b I'LL don't ... ok", add_special_tokens=False).ids + [1]
    assert len(ids[5]) == 60001
    assert tokens.round_trip(make([]), PATH).count() == 0


def test_new_chunks_go_to_the_library_together(monkeypatch):
    pieces = ["a", "B", "'s", "'", "<|endoftext|>", "<", "|", "0", "9", "_", "é", "É", "e\u0301", "\u0301", "İ", "ß", "\x01", "\x00", "\t", "\x1c", "\u3000", "\xa0", " ", "\n",
              ".", "##", "\x7f", "中", "²", "😀", "'LL", "ﬁ", "ſ", "À", "ÿ", "×", "µ", "über", "Hello"]
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    for size in (tokens.CACHE_BYTES, 2000):
        monkeypatch.setattr(tokens, "CACHE_BYTES", size)
        enc = tokens.Encoder(PATH)
        assert enc.joins and [np.frombuffer(x, "<u4").tolist() for i in range(0, 4000, 64) for x in enc(texts[i:i + 64])] == want
    enc, calls = tokens.Encoder(PATH), []
    monkeypatch.setattr(enc, "_ids", lambda t, real=enc._ids: calls.append(len(t)) or real(t))
    enc([f"слово{i} plain{i}" for i in range(500)])
    assert sum(calls) == 1


def test_latin_words_come_from_slots(monkeypatch):
    """Any Latin-1 characters, contractions, words of one slot, long words, full pools and cut texts: all as the library does."""
    rng = np.random.default_rng(8)
    pieces = [*map(chr, range(256)), *"aAéÉ09.!'' ", *["'s", "'T", "'re", "'Ve", "'ll", "'LX", "'d'm", "l'homme", " don't ", "!'s", "x" * 22, "é" * 23, "y" * 24, "." * 40, "\x00" * 2]]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(1500)] + ["ab cd " * 300, "", " ", "'", "a'", "'r", "x" * 3000, "<|endoftext|>é"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    for slots, pool, span in ((20, 1 << 22, 1 << 18), (2, 64, 50), (6, 4000, 700)):
        for name, value in (("SLOTS", slots), ("POOL", pool), ("SPAN", span)):
            monkeypatch.setattr(tokens, name, value)
        enc = tokens.Encoder(PATH)
        assert enc.joins and [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 64) for x in enc(texts[i:i + 64])] == want
    monkeypatch.undo()
    enc, calls = tokens.Encoder(PATH), []
    monkeypatch.setattr(enc, "_ids", None)
    monkeypatch.setattr(enc.words, "encode", lambda w, real=enc._merged: calls.append(sorted(w)) or real(w))
    for _ in range(2):
        enc(["One word, one time.", "ONE Word; once!"] * 20)
    assert calls == [sorted([b"one", b"word", b",", b"time", b".", b";", b"once", b"!"])]


def test_runs_of_a_block_share_its_tables():
    rng = np.random.default_rng(7)
    sizes = [0, 1, 15, 31, 32, 33, 255, 256, 257, 1000, 4095, 4096]
    blocks = [(rng.zipf(1.3, n) % 49408).astype(np.uint32) for n in sizes]
    coded = coder.encode(blocks, 49408)
    assert [x.tolist() for x in coder.decode(coded[::-1])[::-1]] == [b.tolist() for b in blocks]
    assert [coder._runs(n) for n in (0, 31, 32, 255, 256, 4096)] == [1, 1, 2, 8, 16, 16]
    assert sorted(coder._stepwise(1000).tolist()) == list(range(1000)) and coder._stepwise(4096)[:3].tolist() == [0, 256, 512]
    shared = np.tile(rng.integers(0, 49408, 256).astype(np.uint32), 16)  # all runs alike: what one meets the others know
    assert len(coder.encode([shared], 49408)[0]) < 11000


def test_joined_crc():
    a, b = b"12345678", b"abcd" * 5
    assert tokens.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
