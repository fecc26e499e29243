"""Token-ID output: documents to checksummed, range-coded blocks of token ids, and back.

Writing: documents are dealt by range of doc_id and sorted, each partition encodes its texts with a public
tokenizer, appends the end id to every document and cuts its id stream into blocks of
``coder.BLOCK`` ids that are coded on their own. A row of the output table is one block: shard (the
partition), block number, payload in the coder's format, and the pieces of documents it holds. Spark's
writer commits the table, so a lost executor only repeats its tasks.

Reading: blocks are decoded in groups of rows, in any order and by any task; each block yields the
pieces of its documents with their CRC-32, and the CRCs of a document's pieces are combined by length.

Tokenizing: texts that hold Latin-1 characters only are lower-cased and cut into words, digits and runs of symbols as the file's own rule
cuts them, a group of texts at a time as byte arrays. A word's ids come from a table of slots per worker, compared by all bytes of the word;
only words that their slot does not hold go to the library's merges, together in one call, and take the slot.
Any other text is cut at spaces and line ends, since white space never lies inside a token of this vocabulary, and each distinct chunk is encoded
once per worker: Latin-1 chunks as above, others together through the library, a mark between
them that is a token of its own and parts them again. All this holds for a file with the rules of ``RULES``; any other file gets every chunk encoded on its own.
Table and cache are emptied when they are full, which changes no result.

Defined cases: null and empty texts hold the end id only; null doc_ids come first; equal doc_ids are ordered by text;
an empty table writes an empty table; further columns are ignored. Ids must be below 262144.
"""

from __future__ import annotations

import codecs
import json
import os
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from signalops.functions.lineage import shared_folder
from signalops.llm import coder
from signalops.llm.text import text_or_empty

END_ID, CACHE_BYTES, ENTRY = 1, 1 << 24, 150  # of chunks; about what an entry takes besides its text and ids
SLOTS, POOL, LONGEST, SPAN = 20, 1 << 22, 23, 1 << 18  # bits of a slot's number, ids held, bytes of a word in a slot, bytes of a group of texts
MARK = "\x01"
# How the public file normalises and cuts a text.
RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
_CHARS = [chr(c) for c in range(256)]
# Latin-1 in lower case with spaces for white space, and whether a character is space (0), letter (1), digit (2) or symbol (3).
_LOWER = bytes(32 if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else ord(c.lower()) if c.lower() <= "ÿ" else ord(c) for c in _CHARS)
_KIND = bytes(0 if chr(c) == " " else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in _LOWER)
# What a contraction goes on with after its apostrophe: bytes that end one at once, and first and second byte of the longer ones.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")
# The rule's way to write bytes as characters; words stand between spaces.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = dict(zip([b for b in range(256) if b not in _SHOWN], map(chr, range(256, 512))))
_WRITTEN = "".join(" " if b == 32 else _WRITTEN.get(b, chr(b)) for b in range(256))
# By length: which bytes of three 8-byte numbers belong to a word, and the length in the last byte.
_MASK = np.array([[(1 << 8 * min(max(n - 8 * j, 0), 8)) - 1 for j in range(3)] for n in range(LONGEST + 1)], np.uint64)
_SIZE = np.arange(LONGEST + 1, dtype=np.uint64) << np.uint64(56)
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _starts(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, digit and run of symbols of Latin-1 text in lower case."""
    kind = np.frombuffer(flat.translate(_KIND), np.uint8)
    edge = np.ones(len(kind) + 1, bool)  # before each byte, and at the end
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    if b"'" in flat:
        text = np.frombuffer(flat + b"  ", np.uint8)
        q = np.flatnonzero((text[:-2] == 39) & edge[:-1])
        nxt, then = text[q + 1], text[np.minimum(q + 2, len(text) - 1)]
        one = np.isin(nxt, list(_ONE))
        two = np.logical_or.reduce([(nxt == w[0]) & (then == w[1]) for w in _TWO])
        edge[q[one | two] + 1] = False
        edge[q[one] + 2] = True
        edge[q[two] + 3] = True
    at = np.flatnonzero(edge)
    word = kind[at[:-1]] > 0
    return at[:-1][word], at[1:][word]


class _Words:
    """Ids of words by slot. A slot holds the word met last, so words of one slot replace each other."""

    def __init__(self, encode):
        self.encode = encode  # a list of words to their ids in a row and the number of ids of each
        self.clear()

    def clear(self) -> None:
        # A row holds the word's bytes and length as three numbers, then place in the pool and number of ids.
        self.table, self.owner = np.zeros((1 << SLOTS, 4), np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0
        self.long: dict[bytes, int] = {}

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of new words begin in the pool, times 2**32, plus their number."""
        ids, size = self.encode(words)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(len(ids) + POOL // 4, np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return (at << 32 | size).astype(np.uint64)

    def find(self, flat: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each word."""
        length = stop - start
        n = np.minimum(length, LONGEST)
        row = np.ndarray(len(flat) + 1, "V24", flat + bytes(24), strides=(1,))[start].view("<u8").reshape(-1, 3) & _MASK.take(n, 0)
        one, two, three = row[:, 0], row[:, 1], row[:, 2] | _SIZE.take(n)
        h = one * _MULTIPLY[0] + two * _MULTIPLY[1] + three * _MULTIPLY[2]
        slot = (((h ^ (h >> np.uint64(29))) * _MULTIPLY[3]) >> np.uint64(64 - SLOTS)).view(np.int64)
        held = self.table.take(slot, 0)
        found = held[:, 3].copy()
        same = lambda held, k: (held[:, 0] == one[k]) & (held[:, 1] == two[k]) & (held[:, 2] == three[k])
        todo = np.flatnonzero(~same(held, slice(None)) | (length > LONGEST))
        long = todo[length[todo] > LONGEST]
        if len(long):
            words = [flat[a:b] for a, b in zip(start[long].tolist(), stop[long].tolist())]
            new = list(set(words).difference(self.long))
            if new:
                self.long.update(zip(new, self._add(new).tolist()))
            found[long] = [self.long[w] for w in words]
            todo = todo[length[todo] <= LONGEST]
        while len(todo):
            s = slot[todo]
            self.owner[s] = todo
            new = todo[self.owner[s] == todo]  # one word a slot
            added = self._add([flat[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())])
            self.table[slot[new]] = np.stack([one[new], two[new], three[new], added], 1)
            held = self.table[s]
            hit = same(held, todo)
            found[todo[hit]] = held[hit, 3]
            todo = todo[~hit]
        return (found >> np.uint64(32)).view(np.int64), (found & np.uint64(0xFFFFFFFF)).view(np.int64)


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {"": b""}
        self.held = 0
        state = json.loads(self.tokenizer.to_str())
        self.mark = self._ids([MARK])[0]
        self.joins = [state["normalizer"], state["pre_tokenizer"]] == RULES and state["model"]["type"] == "BPE" and len(self.mark) == 4
        # The merges alone, for words between spaces. A word's last token carries the suffix.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix, ids = state["model"].get("end_of_word_suffix"), state["model"]["vocab"] if self.joins else {}
        self.last = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.last[[i for t, i in ids.items() if suffix and t.endswith(suffix)]] = True
        self.words = _Words(self._merged)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        def ids(some):
            text = codecs.charmap_decode(b" ".join(some).decode("latin-1").encode(), "strict", _WRITTEN)[0]
            return np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        flat = ids(words)
        size = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(size) != len(words):
            each = [ids([w]) for w in words]
            flat, size = np.concatenate(each), np.array([len(x) for x in each])
        return flat, size

    def _group(self, raws: list[bytes]) -> list[bytes]:
        """The ids of Latin-1 texts."""
        if self.words.used > POOL - POOL // 8:
            self.words.clear()
        flat = b" ".join(raws).translate(_LOWER)
        start, stop = _starts(flat)
        at, size = self.words.find(flat, start, stop)
        end = np.cumsum(size)
        ids = self.words.pool[np.repeat(at - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))
        cuts = (4 * np.concatenate([[0], end])[cuts]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _latin(self, raws: list[bytes]) -> list[bytes]:
        """Texts in groups of about ``SPAN`` bytes; longer ones are cut at spaces."""
        out: list[list[bytes]] = [[] for _ in raws]
        owners, group, held = [], [], 0

        def flush() -> None:
            for i, ids in zip(owners, self._group(group)):
                out[i].append(ids)

        for i, raw in enumerate(raws):
            at = 0
            while at < len(raw):
                stop = raw.find(b" ", at + SPAN)
                stop = len(raw) if stop < 0 else stop
                owners.append(i)
                group.append(raw[at:stop])
                at, held = stop, held + stop - at
                if held >= SPAN:
                    flush()
                    owners, group, held = [], [], 0
        if group:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _plain(self, text: str) -> bytes | None:
        """Latin-1 bytes of a text without added tokens."""
        try:
            return text.encode("latin-1") if self.joins and "<|" not in text else None
        except UnicodeEncodeError:
            return None

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without a mark or an added token, from one call of the library."""
        ids = np.frombuffer(self._ids([f" {MARK} ".join(chunks)])[0], "<u4")
        stop = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0])
        if len(stop) != len(chunks) - 1:
            return self._ids(chunks)
        raw, cuts = ids.tobytes(), [-1, *stop.tolist(), len(ids)]
        return [raw[4 * a + 4:4 * b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str]) -> None:
        raws = list(map(self._plain, new))
        plain, rest = [c for c, r in zip(new, raws) if r is not None], [c for c, r in zip(new, raws) if r is None]
        self.cache.update(zip(plain, self._latin([r for r in raws if r is not None])))
        apart = lambda c: not self.joins or MARK in c or "<|" in c
        for some, encode in (([c for c in rest if not apart(c)], self._joined), ([c for c in rest if apart(c)], self._ids)):
            if some:
                self.cache.update(zip(some, encode(some)))
        self.held += sum(map(len, new)) + sum(map(len, map(self.cache.__getitem__, new))) + ENTRY * len(new)

    def _mixed(self, texts: list[str]) -> list[bytes]:
        """The texts share one look for new chunks, so many of those go to the library at once."""
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        new = list(set().union(*cut).difference(self.cache))
        if new:
            self._learn(new)
        out = [b"".join(map(self.cache.__getitem__, chunks)) for chunks in cut]
        if self.held > CACHE_BYTES:
            self.cache, self.held = {"": b""}, 0
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        raws = list(map(self._plain, texts))
        plain = iter(self._latin([r for r in raws if r is not None]))
        mixed = iter(self._mixed([t for t, r in zip(texts, raws) if r is None]))
        return [next(mixed if r is None else plain) for r in raws]


def encoder(path: str) -> Encoder:
    """The process's encoder: it outlives a task, so later tasks of the worker find its cache filled.

    The package is pickled by value, which gives every task its own module globals; a module of
    the process keeps what tasks share.
    """
    held = sys.modules.setdefault("signalops_worker_state", types.ModuleType("signalops_worker_state"))
    found = held.__dict__.setdefault("encoders", {})
    if path not in found:
        found[path] = Encoder(path)
    return found[path]


class _Shard:
    """Cuts one partition's id stream into blocks and codes them by groups."""

    def __init__(self, shard: int, vocab: int, id_type: pa.DataType):
        self.shard, self.vocab, self.id_type = shard, vocab, id_type
        self.block = self.doc_no = 0
        self.parts, self.held, self.pieces, self.ready = [], 0, [], []

    def add(self, doc_id, raw: bytes) -> None:
        ids, done = np.frombuffer(raw, "<u4"), 0
        while done < len(ids):
            n = min(coder.BLOCK - self.held, len(ids) - done)
            self.parts.append(ids[done:done + n])
            self.pieces.append({"doc_no": self.doc_no, "doc_id": doc_id, "at": done, "n": n})
            self.held, done = self.held + n, done + n
            if self.held == coder.BLOCK:
                self.close()
        self.doc_no += 1

    def close(self) -> None:
        if self.held:
            self.ready.append((np.concatenate(self.parts), self.pieces))
            self.parts, self.held, self.pieces = [], 0, []

    def rows(self) -> pa.RecordBatch:
        ready, self.ready = self.ready, []
        coded = coder.encode([x[0] for x in ready], self.vocab)
        first, self.block = self.block, self.block + len(ready)
        piece = pa.list_(pa.struct([("doc_no", pa.int64()), ("doc_id", self.id_type), ("at", pa.int64()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ready), self.shard, np.int32)), pa.array(np.arange(first, self.block, dtype=np.int64)),
             pa.array(coded, pa.binary()), pa.array([x[1] for x in ready], piece)], ["shard", "block", "payload", "pieces"])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write the block table at ``path``."""
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        s = _Shard(TaskContext.get().partitionId(), enc.vocab, id_type)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                for doc_id, raw in zip(part.column(0).to_pylist(), enc(part.column(1).to_pylist())):
                    s.add(doc_id, raw + end)
                    if len(s.ready) >= coder.LANES:
                        yield s.rows()
        s.close()
        if s.ready:
            yield s.rows()

    schema = f"shard int, block bigint, payload binary, pieces array<struct<doc_no:bigint,doc_id:{kind.simpleString()},at:bigint,n:bigint>>"
    (docs.select("doc_id", text_or_empty().alias("text"))
     .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
     .mapInArrow(run, schema).write.parquet(path))


def decoded(blocks: DataFrame, what, schema: str) -> DataFrame:
    """Decode block rows in groups and emit ``what(row index lists, ids)`` batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= coder.LANES:
                yield from group(held)
                held, n = [], 0
        if n:
            yield from group(held)

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        for lo in range(0, t.num_rows, coder.LANES):
            part = t.slice(lo, coder.LANES)
            yield from what(part, coder.decode(part.column("payload").to_pylist()))

    return blocks.mapInArrow(run, schema)


def pieces(blocks: DataFrame) -> DataFrame:
    """(shard, doc_no, doc_id, at, n, crc) of every piece of a document, from the decoded ids."""
    kind = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def what(part: pa.Table, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = part.column("pieces").combine_chunks()
        p = p.chunk(0) if isinstance(p, pa.ChunkedArray) else p
        flat, sizes = p.flatten(), p.value_lengths().to_numpy()
        n = flat.field("n").to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        crc, at, last = np.zeros(len(n), np.int64), 0, -1
        raw = [x.tobytes() for x in ids]
        for k, (o, c) in enumerate(zip(owner.tolist(), n.tolist())):
            at = at if o == last else 0
            crc[k] = zlib.crc32(raw[o][4 * at:4 * (at + c)])
            at, last = at + c, o
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part.column("shard").to_numpy(), sizes)), flat.field("doc_no"), flat.field("doc_id"), flat.field("at"), flat.field("n"),
             pa.array(crc)], ["shard", "doc_no", "doc_id", "at", "n", "crc"])

    return decoded(blocks, what, f"shard int, doc_no bigint, doc_id {kind}, at bigint, n bigint, crc bigint")


def join_crc(a: int, b: int, n_bytes: int) -> int:
    """CRC-32 of a sequence from those of its two parts; ``n_bytes`` is the length of the second."""
    zeros = bytes(n_bytes)
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


def ids_of(blocks: DataFrame) -> DataFrame:
    """(shard, doc_no, doc_id, ids): the ids of every document, for readers that want the tokens."""
    kind = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def what(part: pa.Table, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = [(s, p["doc_no"], p["doc_id"], p["at"], x[o:o + p["n"]])
                for s, ps, x in zip(part.column("shard").to_pylist(), part.column("pieces").to_pylist(), ids)
                for p, o in zip(ps, np.cumsum([0] + [p["n"] for p in ps]).tolist())]
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], part.column("pieces").type.value_type.field("doc_id").type),
             pa.array(cols[3], pa.int64()), pa.array([x.tolist() for x in cols[4]], pa.list_(pa.int64()))], ["shard", "doc_no", "doc_id", "at", "ids"])

    parts = decoded(blocks, what, f"shard int, doc_no bigint, doc_id {kind}, at bigint, ids array<bigint>")
    return (parts.groupBy("shard", "doc_no", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
            .select("shard", "doc_no", "doc_id", F.flatten(F.col("p.ids")).alias("ids")))


def digest(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded blocks alone."""
    @F.pandas_udf("bigint")
    def whole(p):
        def one(x):
            crc = x[0]["crc"]
            for y in x[1:]:
                crc = join_crc(crc, y["crc"], 4 * int(y["n"]))
            return int(crc)
        return p.map(one)

    sizes = blocks.select("shard", F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base = sizes.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = (pieces(blocks).groupBy("shard", "doc_no", "doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p"), F.sum("n").alias("n_tokens")))
    w = W.partitionBy("shard").orderBy("doc_no").rowsBetween(W.unboundedPreceding, -1)
    return (docs.withColumn("within", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(base, "shard")
            .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens",
                    F.when(F.size("p") == 1, F.col("p")[0]["crc"]).otherwise(whole("p")).alias("ids_crc32")))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the block table in the shared folder, read it back, and return its digest."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_folder(spark)}/signalops/{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return digest(spark.read.parquet(path))
