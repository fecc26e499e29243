"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

A block of ids is coded on its own: its model starts fresh, so any block can be decoded alone. Three
predictions compete for each id: the id last seen after the previous two ids (order 2), the id last
seen after the previous id (order 1), and the block's history so far (order 0: an id's chance is its
share of the first n ids, n the last power of two). An id that none of them holds is drawn from
a fixed table that favours low ids. The weights of the four are mixed online: each pair of confidence
levels of orders 2 and 1 has its own adaptive distribution. The chosen interval narrows a 64-bit range.

A block is cut into up to ``STREAMS`` runs of ids that are coded side by side, each into a range of its own, while they share the block's
tables: step t codes id t of every run, so what a run has met helps the others from the next step on, and "so far" means the ids of
all earlier steps. Where runs write one table entry in one step, the last run's stays.

The runs of a group of blocks are the lanes of NumPy arrays: one step codes the next id of every lane, so the
cost of an array call is shared by all lanes. Encoder and decoder run the same ``_Model``.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

BLOCK, LANES, STREAMS = 4096, 256, 16  # ids a block, blocks a group, runs a block
MAGIC = b"CMRC2"
_HEAD = "<5sIII"  # magic, number of ids, crc32 of the ids as <u4, vocabulary size; then the words of each run as <u2
_T1, _T2 = 1024, 2048
_MIX = 4096
# Packed 16-bit fields (a0, a1, a2): the cumulated weights of order 2, order 1, order 0 out of _MIX.
_FIELDS = 0x07FF07FF07FF
_pack = lambda a, b, c: a | b << 16 | c << 32
_PULL = np.array([_pack(*[(_MIX - 32 * (3 - j)) // 32 if j >= c else 32 * (j + 1) // 32 for j in range(3)]) for c in range(4)], np.int64)
_START = np.array([_pack(x * 100 + 200, x * 150 + 500, x * 100 + 2400) for x in range(16)], np.int64)
U = np.uint64
_ID, _FREQ, _BITS = U(18), U(20), U(5)  # widths of the fields of a packed id


def _field(packed: np.ndarray, at: int, width: np.uint64) -> np.ndarray:
    return (packed >> U(at)) & U((1 << int(width)) - 1)


def _packed(ids, start, freq) -> np.ndarray:
    """An id, start and width of its interval in one number."""
    return ids.astype(U) | start.astype(U) << _ID | freq.astype(U) << (_ID + _FREQ)


class _Novel:
    """Fixed distribution over all ids, weight about 1 / (id + 16); shared by every lane."""

    def __init__(self, vocab: int):
        self.bits = max(2, (vocab - 1).bit_length() + 2)
        if self.bits > 20:
            raise ValueError("vocabularies of up to 262144 ids are supported")
        w = 1.0 / (np.arange(vocab) + 16.0)
        f = 1 + np.floor(w / w.sum() * ((1 << self.bits) - vocab)).astype(np.int64)
        f[0] += (1 << self.bits) - f.sum()
        self.freq, self.start = f.astype(np.int32), np.concatenate(([0], np.cumsum(f)[:-1])).astype(np.int32)
        self.at = np.repeat(np.arange(vocab, dtype=np.int32), f)


def _runs(n: int) -> int:
    """How many runs a block of n ids has: a power of two."""
    return next(k for k in (STREAMS, 8, 4, 2, 1) if n >= 16 * k or k == 1)


@functools.lru_cache(64)
def _stepwise(n: int) -> np.ndarray:
    """Where the ids of a block stand in the order of coding: step by step, all runs in turn."""
    k = _runs(n)
    t, run = np.divmod(np.arange(n), k)
    return run * (n // k) + np.minimum(run, n % k) + t


class _Lanes:
    """The runs of a group of blocks, the longest first; those of a block stay in their order."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.runs = np.array([_runs(n) for n in sizes], np.int64)
        block = np.repeat(np.arange(len(sizes)), self.runs)
        run = np.arange(len(block)) - np.repeat(np.cumsum(self.runs) - self.runs, self.runs)
        k, n = self.runs[block], self.sizes[block]
        length = n // k + (run < n % k)
        self.order = np.argsort(-length, kind="stable")
        self.block, self.run, self.stride, self.length = block[self.order], run[self.order], k[self.order], length[self.order]
        self.steps, self.width = int(length.max(initial=0)), int(self.sizes.max(initial=0))
        self.at = self.block * self.width + self.run  # of step 0 in the blocks' rows

    def live(self, t: int) -> int:
        return int(np.searchsorted(-self.length, -t, "left"))


class _Model:
    """Order-1 and order-2 predictions and mixing weights of blocks, looked up by their runs."""

    def __init__(self, lanes: _Lanes):
        blocks = len(lanes.sizes)
        self.one, self.two = np.zeros(blocks * _T1, np.int32), np.zeros(blocks * _T2, np.int32)
        self.mix = np.tile(_START, blocks)
        self.b1, self.b2, self.bm = lanes.block * _T1, lanes.block * _T2, lanes.block * 16
        self.last = np.zeros(len(lanes.block), np.int64)
        self.before = np.zeros(len(lanes.block), np.int64)

    def keep(self, live: int) -> None:
        """Go on with the first lanes only."""
        for name in ("b1", "b2", "bm", "last", "before"):
            setattr(self, name, getattr(self, name)[:live])

    def look(self) -> None:
        self.i1 = self.b1 + (self.last & (_T1 - 1))
        self.i2 = self.b2 + ((self.last * 37 + self.before) & (_T2 - 1))
        self.e1, self.e2 = self.one.take(self.i1), self.two.take(self.i2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.k1, self.k2 = self.e1 & 3, self.e2 & 3
        self.ctx = self.bm + ((self.k2 << 2) + self.k1 * (self.p1 != self.p2))
        self.w = self.mix.take(self.ctx)

    def interval(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sh = part << 4
        lo = ((self.w << 16) >> sh) & 0xFFFF
        return lo, (((self.w | (_MIX << 48)) >> sh) & 0xFFFF) - lo

    def learn(self, ids: np.ndarray, part: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """A right prediction gains confidence up to 3; a wrong one is replaced."""
        self.mix[self.ctx] = self.w - ((self.w >> 5) & _FIELDS) + _PULL.take(part)
        fresh = (ids << 2) | 1
        self.one[self.i1] = np.where(hit1, self.e1 + (self.k1 < 3), fresh)
        self.two[self.i2] = np.where(hit2, self.e2 + (self.k2 < 3), fresh)
        self.before, self.last = self.last, ids.astype(np.int64)


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of each lane: start and count of the id among the first n ids, sorted (count 0: unseen)."""
    rows, steps = ids.shape
    base = np.arange(rows)[:, None]
    order = (np.argsort(ids, axis=1, kind="stable") + base * steps).ravel()
    s = ids.ravel()[order]
    edge = np.ones(s.shape, bool)
    edge[1:] = s[1:] != s[:-1]
    edge[::steps] = True
    rank = np.empty(s.shape, np.int32)
    rank[order] = np.cumsum(edge, dtype=np.int32) - 1
    rank = rank.reshape(rows, steps)
    start, count = np.zeros((rows, steps), np.int32), np.zeros((rows, steps), np.int32)
    tally, done, n = np.zeros(int(edge.sum()), np.int32), 0, 16
    while n < steps:
        tally += np.bincount(rank[:, done:n].ravel(), minlength=len(tally)).astype(np.int32)
        before = np.cumsum(tally, dtype=np.int32) - tally
        part = rank[:, n:2 * n]
        start[:, n:2 * n], count[:, n:2 * n] = before[part] - base * n, tally[part]
        done, n = n, 2 * n
    return start, count


def encode(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Code each block of ids (at most ``BLOCK`` ids below ``vocab``) on its own."""
    if not blocks:
        return []
    lanes = _Lanes([len(b) for b in blocks])
    ids = np.zeros((len(blocks), lanes.width), np.uint32)
    for r, b in enumerate(blocks):
        ids[r, :len(b)] = b[_stepwise(len(b))]
    if lanes.width and int(ids.max()) >= vocab:
        raise ValueError("id outside the vocabulary")
    # What coding an id by order 0, or as a novel id, needs; known for all steps beforehand.
    novel, m = _Novel(vocab), _Model(lanes)
    first, count = _order0(ids.astype(np.uint16) if vocab <= 65536 else ids) if lanes.width else (ids.astype(np.int32), ids.astype(np.int32))
    seen = count > 0
    first, count = np.where(seen, first, novel.start[ids]), np.where(seen, count, novel.freq[ids])
    n0 = np.array([q.bit_length() - 1 if q >= 16 else 0 for q in range(lanes.width)], np.uint8)
    info = _packed(ids, first, count).ravel()
    info |= (np.where(seen, n0, np.uint8(novel.bits)).astype(U) << U(58) | (~seen).astype(U) << U(63)).ravel()
    live = len(lanes.block)
    low, rng = np.zeros(live, U), np.full(live, 2**64 - 1, U)
    words = np.zeros((live, lanes.steps + 4), np.uint32)
    flat, begin = words.ravel(), np.arange(live) * words.shape[1]
    pos = begin.copy()  # where each run's next word goes

    def carry(rows: np.ndarray) -> None:
        """Add one to the words already written."""
        back = 1
        rows = rows[pos[rows] - begin[rows] >= back]
        while len(rows):
            at = pos[rows] - back
            flat[at] += np.uint32(1)
            rows = rows[flat[at] == 0]
            back += 1
            rows = rows[pos[rows] - begin[rows] >= back]

    def put(rows: np.ndarray) -> None:
        at, value = pos.take(rows), low.take(rows)
        flat[at] = value >> U(32)
        pos[rows] = at + 1
        low[rows] = value << U(32)

    def end(rows: np.ndarray) -> None:
        """One word more tells the range: the next multiple of 2**32 lies within it."""
        new = low[rows] + U(2**32 - 1)
        carry(rows[new < low[rows]])
        low[rows] = new
        put(rows)

    for t in range(lanes.steps):
        now = lanes.live(t)
        if now < live:
            end(np.arange(now, live))
            live, low, rng = now, low[:now], rng[:now]
            m.keep(now)
        one = info.take(lanes.at[:live] + t * lanes.stride[:live])
        s = _field(one, 0, _ID).astype(np.int32)
        m.look()
        hit1, hit2 = m.p1 == s, m.p2 == s
        hit = hit1 | hit2
        part = np.where(hit, ~hit2, 2 + (one >> U(63)).astype(np.int8))
        lo, width = m.interval(part)
        r = rng >> U(12)
        new = low + r * lo.view(U)
        over = new < low
        # Orders 2 and 1 name the id; the others go on within their interval.
        one &= hit.astype(U) - U(1)
        r = (r * width.view(U)) >> _field(one, 58, _BITS)
        more = new + r * _field(one, 18, _FREQ)
        over |= more < new
        new, rng = more, r * (_field(one, 38, _FREQ) + hit)
        low = new
        if over.any():
            carry(np.flatnonzero(over))
        m.learn(s, part, hit1, hit2)
        small = np.flatnonzero(rng < U(1 << 32))
        put(small)
        rng[small] <<= U(32)
    end(np.arange(live))
    back = np.argsort(lanes.order)
    size, words = (pos - begin)[back], words[back]
    body = words[np.arange(words.shape[1]) < size[:, None]].astype("<u4")
    stop = np.cumsum(np.concatenate(([0], size)))
    out, lane = [], 0
    for b, n, k in zip(blocks, lanes.sizes.tolist(), lanes.runs.tolist()):
        raw = np.ascontiguousarray(b, dtype="<u4").tobytes()
        out.append(struct.pack(_HEAD, MAGIC, n, zlib.crc32(raw), vocab) + size[lane:lane + k].astype("<u2").tobytes() + body[stop[lane]:stop[lane + k]].tobytes())
        lane += k
    return out


def _history(got: np.ndarray) -> np.ndarray:
    """The ids of every row sorted, each packed with its start and count."""
    s = np.sort(got, axis=1)
    edge = np.ones(s.shape, bool)
    edge[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.flatnonzero(edge)
    count = np.diff(first, append=s.size)
    return np.repeat(_packed(s.ravel()[first], first % s.shape[1], count), count).reshape(s.shape)


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block as <u4 arrays; raises on a wrong header or checksum."""
    if not coded:
        return []
    heads = [struct.unpack_from(_HEAD, c) for c in coded]
    if any(h[0] != MAGIC for h in heads) or len({h[3] for h in heads}) != 1:
        raise ValueError("not a block of this format, or blocks of several vocabularies in one group")
    lanes, vocab = _Lanes([h[1] for h in heads]), heads[0][3]
    if lanes.width > BLOCK:
        raise ValueError("a block holds more ids than this format allows")
    head = struct.calcsize(_HEAD)
    size = np.concatenate([np.frombuffer(c, "<u2", k, head) for c, k in zip(coded, lanes.runs.tolist())]).astype(np.int64)
    body = np.concatenate([np.frombuffer(c, "<u4", offset=head + 2 * k) for c, k in zip(coded, lanes.runs.tolist())])
    if len(body) != size.sum():
        raise ValueError("length of a block does not match")
    words = np.zeros((len(size), max(int(size.max()), 2) + 1), np.uint32)  # each run ends in zeros
    words[np.arange(words.shape[1]) < size[:, None]] = body
    words = words[lanes.order]
    novel, m = _Novel(vocab), _Model(lanes)
    got = np.zeros((len(coded), lanes.width), np.int32)
    flat, live, width_w = words.ravel(), len(lanes.block), words.shape[1]
    pos = np.arange(live) * width_w + 2
    top = pos + width_w - 3
    d = (words[:, 0].astype(U) << U(32)) | words[:, 1].astype(U)
    rng = np.full(live, 2**64 - 1, U)
    # Packed ids: what each block has so far, the fixed table of novel ids, and an entry that leaves a range as it is.
    known = len(coded) * lanes.width
    table = np.concatenate([np.zeros(known, U), _packed(np.arange(vocab), novel.start, novel.freq)[novel.at], np.array([1 << 38], U)])
    hist = table[:known].reshape(len(coded), lanes.width)
    n0, row, novel_bits = np.zeros(live, U), lanes.block * lanes.width, U(novel.bits)
    for t in range(lanes.steps):
        now = lanes.live(t)
        if now < live:
            live = now
            d, rng, n0, pos, top, row = d[:now], rng[:now], n0[:now], pos[:now], top[:now], row[:now]
            m.keep(now)
        if t & (t - 1) == 0:  # blocks whose ids so far are a power of two
            for k in np.unique(lanes.runs):
                n, on = int(t * k), np.flatnonzero((lanes.runs == k) & (lanes.sizes > t * k))
                if n >= 16 and len(on):
                    hist[on, :n] = _history(got[on, :n])
                    n0[lanes.stride[:live] == k] = U(n.bit_length() - 1)
        m.look()
        r = rng >> U(12)
        w = m.w.view(U)
        part = (d >= r * (w & U(0xFFFF))).astype(np.int64) + (d >= r * ((w >> U(16)) & U(0xFFFF))) + (d >= r * (w >> U(32)))
        lo, width = m.interval(part)
        d = d - r * lo.view(U)
        rng = r * width.view(U)
        old, new = part == 2, part == 3
        bits = np.where(old, n0, new * novel_bits)
        r = rng >> bits
        v = np.minimum(d // np.maximum(r, U(1)), (U(1) << bits) - U(1)).view(np.int64)
        one = table.take(v + np.where(old, row, np.where(new, known, len(table) - 1)))
        d = d - r * _field(one, 18, _FREQ)
        rng = r * _field(one, 38, _FREQ)
        s = np.where(part > 1, _field(one, 0, _ID).astype(np.int32), np.where(part == 0, m.p2, m.p1))
        got.ravel()[lanes.at[:live] + t * lanes.stride[:live]] = s
        m.learn(s, part, m.p1 == s, m.p2 == s)
        small = np.flatnonzero(rng < U(1 << 32))
        p = np.minimum(pos[small], top[small])
        d[small] = (d[small] << U(32)) | flat[p].astype(U)
        pos[small] += 1
        rng[small] = np.maximum(rng[small], U(1)) << U(32)
    out = []
    for r, (_, n, crc, _) in enumerate(heads):
        ids = np.empty(n, "<u4")
        ids[_stepwise(n)] = got[r, :n]
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("checksum of a block does not match")
        out.append(ids)
    return out
