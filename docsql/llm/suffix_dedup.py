"""Removal of repeated passages by a distributed merge sort of suffixes that never re-compares known prefixes.

A passage is a string of `length` bytes that starts at two places or more. Its bytes go wherever it stands.

1. Documents are packed into blocks. In every window of `length` bytes the k-gram with the least hash is the window's
   anchor, so equal windows have equal anchors at equal offsets. Anchors are some 1.5 % of all places.
2. Only anchors whose k-gram occurs twice can lie in a passage: their hashes are counted, once for each block.
3. Each task sorts the suffixes that start at these anchors (as long as the windows of the anchor reach), keeps one
   of equal ones, and writes the sorted run front-coded (length of the prefix shared with the run's suffix before,
   and the rest), cut by sampled splitters. A splitter is a whole suffix with the text before it, so that suffixes
   that begin with the same frequent k-gram spread over as many ranges as they fill.
4. Each range merges its runs with a loser tree. Heads carry the length of the prefix they share with the last
   output, so prefixes known to be equal are never compared again. Neighbours that share a k-gram form a class.
5. In a class, the right match of two suffixes is the least of the shared prefixes between them; their left match is
   compared. Both give the windows that two places have in common. Large classes are resolved by the ranks of their
   suffixes and of the texts before them: shared prefixes tell which have a window in common. No hash decides.
6. A window can be in two ranges only if its part from the anchor on is a prefix of a splitter. Suffixes with such
   windows are sorted once more, by the text before the anchor, and merged in the same way. What still is in
   two ranges is a prefix of a splitter on both sides: few different windows, counted by their bytes.
7. The windows go back to their blocks, where the bytes they cover are cut out.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import drop, groups_of, materialize, shuffle_partitions, text_buffer, tidied

LENGTH, GRAM = 200, 64
#: Bytes of text in a block and in a run; regions of a class up to which pairs are compared, beyond which ranks (both exact).
BLOCK, RUN_TEXT, PAIRS = 2 << 20, 16 << 20, 32
#: For splitters: so many blocks at least and anchors for each range are looked at, and so many anchors of each block.
SAMPLE_BLOCKS, SAMPLE_RANGE, SAMPLE_ANCHORS = 12, 40, 4000
#: Hashes with more than a share of 1 / HOT of all rows of hashes, at most HOT of them, are found by a broadcast.
HOT = 20_000
_CHUNK = 1 << 18
_MULT = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


# ---------------------------------------------------------------- blocks


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=1)
    ids, sizes, texts, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, sizes, texts, held, n
        row = [pa.array([task << 32 | n], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int64())), pa.array([squeeze.compress(b"".join(texts))], pa.binary())]
        ids, sizes, texts, held, n = [], [], [], 0, n + 1
        return pa.RecordBatch.from_arrays(row, ["block", "ids", "sizes", "blob"])

    for batch in batches:
        data, off = text_buffer(batch.column(1))
        for i, j in groups_of(off, BLOCK):
            if held and held + off[j] - off[i] > BLOCK:
                yield flush()
            ids.append(batch.column(0).slice(i, j - i))
            sizes.append(np.diff(off[i : j + 1]))
            texts.append(data[off[i] : off[j]].tobytes())
            held += int(off[j] - off[i])
    if ids:
        yield flush()


def _bytes_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all windows inside one document: the anchors' places, their first and last windows, their k-gram hashes."""
    places, los, his, hashes = [], [], [], []
    windows = len(data) - length + 1
    per = length - gram + 1  # k-grams in a window
    for at in range(0, max(windows, 0), _CHUNK):
        stop = min(at + _CHUNK, windows)
        part = data[at : stop + length - 1]
        h, width = _BYTE[part], 1
        acc, have = None, 0
        for bit in range(gram.bit_length()):  # hashes of gram bytes from those of powers of two
            if gram >> bit & 1:
                acc = h if acc is None else acc[: len(part) - have - width + 1] * np.uint64(pow(_MULT, width, 2**64)) + h[have : have + len(part) - have - width + 1]
                have += width
            if gram >> bit > 1:
                h = h[:-width] * np.uint64(pow(_MULT, width, 2**64)) + h[width:]
                width *= 2
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        least = (acc & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(acc), dtype=np.uint64)
        width = 1
        while 2 * width <= per:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < per:
            least = np.minimum(least[: len(least) - (per - width)], least[per - width :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(at, stop)
        inside = np.searchsorted(ends, start, side="right") == np.searchsorted(ends, start + length - 1, side="right") if len(ends) < 64 else _inside(ends, at, stop, length)
        start, place = start[inside], place[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
        places.append(place[new] + at)
        los.append(start[new])
        his.append(start[np.r_[new[1:] - 1, len(start) - 1]])
        hashes.append(acc[place[new]])
    if not places:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return np.concatenate(places), np.concatenate(los), np.concatenate(his), np.concatenate(hashes)


def _inside(ends: np.ndarray, at: int, stop: int, length: int) -> np.ndarray:
    """Whether the windows that start in [at, stop) end before the next document begins."""
    crossing = np.zeros(stop - at + 1, np.int64)
    near = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, stop + length, side="right")]
    lo, hi = np.clip(near - length + 1, at, stop) - at, np.clip(near, at, stop) - at
    np.add.at(crossing, lo, 1)
    np.add.at(crossing, hi, -1)
    return np.cumsum(crossing[:-1]) == 0


# ---------------------------------------------------------------- front-coded runs

# A suffix of a run: (right: text from the anchor on, left: text before it, reversed, block, place or -1 if it stands for several).


def _shared(rights: list[bytes]) -> list[int]:
    return [0, *(extend(a, b, 0) for a, b in zip(rights, rights[1:], strict=False))]


def extend(a: bytes, b: bytes, p: int) -> int:
    """Length of the common prefix of a and b, which is p at least."""
    m = min(len(a), len(b))
    while p < m:
        q = min(p + 32, m)
        x, y = a[p:q], b[p:q]
        if x != y:
            return p + ((q - p) * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
        p = q
    return m


def encode_run(records: list[tuple[bytes, bytes, int, int]], squeeze: zstandard.ZstdCompressor) -> bytes:
    rights = [r[0] for r in records]
    shared = _shared(rights)
    blocks = sorted({r[2] for r in records})
    number = {b: i for i, b in enumerate(blocks)}
    fixed = [np.array(shared, "<u2"), np.array([len(r) for r in rights], "<u2"), np.array([len(r[1]) for r in records], "<u2"), np.array([number[r[2]] for r in records], "<u4"), np.array([r[3] for r in records], "<i4"), np.array(blocks, "<i8")]
    rest = b"".join(r[s:] for r, s in zip(rights, shared, strict=True)) + b"".join(r[1] for r in records)
    return struct.pack("<2I", len(records), len(blocks)) + squeeze.compress(b"".join(x.tobytes() for x in fixed) + rest)


def decode_run(payload: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(shared prefix with the one before, right, left, block, place), in order."""
    n, n_blocks = struct.unpack_from("<2I", payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[8:])
    at, fixed = 0, []
    for kind, count in (("<u2", n), ("<u2", n), ("<u2", n), ("<u4", n), ("<i4", n), ("<i8", n_blocks)):
        fixed.append(np.frombuffer(raw, kind, count, at))
        at += fixed[-1].nbytes
    shared, size, lefts, block, place = (x.tolist() for x in fixed[:5])
    blocks = fixed[5].tolist()
    left_at, right = at + sum(size) - sum(shared), b""
    for s, n_right, n_left, b, p in zip(shared, size, lefts, block, place, strict=True):
        right = right[:s] + raw[at : at + n_right - s]
        at += n_right - s
        yield s, right, raw[left_at : left_at + n_left], blocks[b], p
        left_at += n_left


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges runs of (shared, string, ...) into one; `shared` of each output is the prefix shared with the output before.

    A loser tree. known[r] is the prefix that run r's head shares with the head it last lost to, or with the last
    output: of two heads the one that shares more with the last output is smaller, and only heads that share
    equally much are compared, from there on.
    """
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    known = [0] * k
    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); -1 is no run."""
        if b < 0 or heads[b] is None:
            return a, b
        if a < 0 or heads[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        p = extend(x, y, known[a])
        if p == len(x) and (p < len(y) or a < b) or p < len(x) and p < len(y) and x[p] < y[p]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    level = [r if r < k else -1 for r in range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[node + i // 2] = lost
            nxt.append(w)
        level = nxt
    winner = level[0] if k else -1
    while winner >= 0 and heads[winner] is not None:
        out = heads[winner]
        yield (known[winner], *out[1:])
        head = next(runs[winner], None)
        heads[winner] = head
        known[winner] = head[0] if head else 0  # shared with the output just made: its forerunner in the run
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


# ---------------------------------------------------------------- classes


def resolve(members: list[tuple[int, bytes, bytes, int, int]], length: int, put) -> None:
    """put(block, first window, last window) for the windows that occur twice in a class.

    members: (shared prefix with the member before, right, left, block, place) in sorted order.
    """
    regions: dict[tuple[bytes, bytes], int] = {}
    of: list[list[tuple[int, int]]] = []
    many: list[bool] = []
    step: list[int] = []  # prefix shared with the region before
    least = 1 << 30
    for shared, right, left, block, place in members:
        least = min(least, shared)
        i = regions.setdefault((right, left), len(of))
        if i == len(of):
            of.append([])
            many.append(False)
            step.append(least)
            least = 1 << 30
        many[i] |= bool(of[i]) or place < 0
        if place >= 0:
            of[i].append((block, place))
    keys = list(regions)
    for (right, left), places, twice in zip(keys, of, many, strict=True):
        if twice:
            for block, place in places:
                put(block, place - len(left), place + len(right) - length)
    if len(keys) < 2:
        return
    if len(keys) > PAIRS:
        found = _Found([p[0] if p else (0, -1) for p in of], many, put)
        for before, has, code in ranked([r for r, _ in keys], [x for _, x in keys], step, length, False):
            found.add(before, has, np.unique(code, return_inverse=True)[1])
        found.close()
        return
    for i in range(len(keys)):
        if not of[i] or many[i]:
            continue
        # The region's windows by how far they begin before the anchor: [length - right match, left match].
        found = []
        left = keys[i][1]
        shared = 1 << 30
        for j in range(i - 1, -1, -1):
            shared = min(shared, step[j + 1])
            _meet(found, keys[i][0], keys[j][0], left, keys[j][1], shared, length)
        shared = 1 << 30
        for j in range(i + 1, len(keys)):
            shared = min(shared, step[j])
            _meet(found, keys[i][0], keys[j][0], left, keys[j][1], shared, length)
        block, place = of[i][0]
        for low, high in found:
            put(block, place - high, place - low)


def _meet(found: list, right: bytes, other: bytes, left: bytes, other_left: bytes, shared: int, length: int) -> None:
    low = length - min(shared, len(right), len(other))
    if len(left) >= low and len(other_left) >= low:
        high = extend(left, other_left, 0)
        if high >= low:
            found.append((max(low, 0), high))


def ranked(a: list[bytes], b: list[bytes], step: list[int], length: int, a_is_left: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset before the anchor: the members that have such a window, and numbers that are equal for equal windows.

    a is in order, and step has the prefix each shares with the one before; b has the other side's texts. Members whose
    neighbours between them all share enough of a side agree in that side's part of the window.
    """
    order = sorted(range(len(b)), key=b.__getitem__)
    place = np.empty(len(b), np.int64)
    place[order] = np.arange(len(b))
    step_a = np.array([0, *step[1:]], np.int64)
    step_b = np.array([0, *(extend(b[i], b[j], 0) for i, j in zip(order, order[1:], strict=False))], np.int64)
    len_a, len_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    lefts, rights = (len_a, len_b) if a_is_left else (len_b, len_a)
    for before in range(max(0, length - int(rights.max())), min(length, int(lefts.max())) + 1):
        has = np.flatnonzero((lefts >= before) & (rights >= length - before))
        if len(has):
            need_a, need_b = (before, length - before) if a_is_left else (length - before, before)
            yield before, has, np.cumsum(step_a < need_a)[has] * (len(a) + 1) + np.cumsum(step_b < need_b)[place[has]]


class _Found:
    """Windows that occur twice, gathered offset by offset; members that stand for several places count twice and are put already."""

    def __init__(self, places: list[tuple[int, int]], many: list[bool], put):
        self.places, self.put = places, put
        self.weight = np.where(many, 2, 1)
        self.alone = ~np.array(many, bool) & np.array([p >= 0 for _, p in places])
        self.open: dict[int, tuple[int, int]] = {}

    def add(self, before: int, has: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Returns how often each group occurs."""
        count = np.bincount(group, self.weight[has]).astype(np.int64)
        for i in has[(count[group] > 1) & self.alone[has]].tolist():
            low, high = self.open.get(i, (before, before))
            if before - high > 1:
                self._out(i, low, high)
                low = before
            self.open[i] = (low, before)
        return count

    def _out(self, i: int, low: int, high: int) -> None:
        block, place = self.places[i]
        self.put(block, place - high, place - low)

    def close(self) -> None:
        for i, (low, high) in self.open.items():
            self._out(i, low, high)


# ---------------------------------------------------------------- the operator


class _Intervals:
    """Windows found so far, by block; rows out are packed pairs of int32."""

    def __init__(self):
        self.found: dict[int, list[int]] = defaultdict(list)

    def put(self, block: int, first: int, last: int) -> None:
        self.found[block] += (first, last)

    def packed(self) -> dict[int, bytes]:
        return {b: np.array(x, "<i4").tobytes() for b, x in self.found.items()}


_OUT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("key", pa.binary()), ("n", pa.int32())])
_DDL = "part int, block long, payload binary, key binary, n int"
#: Parts of rows that are no runs: windows found, and windows that other ranges may have too.
_KNOWN, _OPEN = -1, -2


def _rows(part, block, payload) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], schema=_OUT)


def _cut(records: list[tuple[bytes, bytes, int, int]], splitters: list[tuple[bytes, bytes]], squeeze: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    """A sorted run, in one row for each range that it touches."""
    cut = [0, *(bisect_left(records, s) for s in splitters), len(records)]
    for part, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if b > a:
            yield _rows([part], [records[a][2]], [encode_run(records[a:b], squeeze)])


def _regions(row: dict, length: int, gram: int) -> tuple[list[tuple[bytes, bytes, int, int]], int]:
    """A block's suffixes at anchors whose k-gram occurs twice, and the block's size."""
    data = _bytes_of(row["blob"].as_py())
    ends = np.cumsum(np.array(row["sizes"].values, np.int64))
    twice = np.sort(np.array(row["hashes"].values, np.int64).view(np.uint64))
    place, lo, hi, h = anchors(data, ends, length, gram)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    raw, keep, block = data.tobytes(), twice[at] == h, row["block"].as_py()
    return [(raw[p : z + length], raw[a:p][::-1], block, p) for p, a, z in zip(place[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True)], len(data)


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: batch.column(name)[row] for name in batch.schema.names}


def _runs(batches: Iterator[pa.RecordBatch], splitters: list[tuple[bytes, bytes]], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the hashes that occur twice -> front-coded runs (part >= 0) and windows already known."""
    squeeze = zstandard.ZstdCompressor(level=1)
    records: list[tuple[bytes, bytes, int, int]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal records, held
        records.sort()
        known = _Intervals()
        once: list[tuple[bytes, bytes, int, int]] = []
        i = 0
        while i < len(records):
            j = i + 1
            while j < len(records) and records[j][:2] == records[i][:2]:
                j += 1
            right, left, block, place = records[i]
            if j - i > 1:
                for _, _, b, p in records[i:j]:
                    known.put(b, p - len(left), p + len(right) - length)
                place = -1
            once.append((right, left, block, place))
            i = j
        records, held = [], 0
        packed = known.packed()
        if packed:
            yield _rows([_KNOWN] * len(packed), list(packed), list(packed.values()))
        yield from _cut(once, splitters, squeeze)

    for row in _blocks_in(batches):
        more, size = _regions(row, length, gram)
        records += more
        held += size
        if held >= RUN_TEXT:
            yield from flush()
    if records:
        yield from flush()


def _around(part: int, splitters: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The first strings of the splitters below and above a range."""
    return [splitters[i][0] for i in (part - 1, part) if 0 <= i < len(splitters)]


def _depth(text: bytes, around: list[bytes]) -> int:
    """How much of a text other ranges may have too: no text beyond a splitter shares more with it than the splitter does."""
    return max((extend(text, s, 0) for s in around), default=-1)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    part, payloads = None, []
    for batch in batches:
        for p, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part and payloads:
                yield part, payloads
                payloads = []
            part = p
            payloads.append(payload.as_py())
    if payloads:
        yield part, payloads


def _merge(batches: Iterator[pa.RecordBatch], splitters: list[tuple[bytes, bytes]], left_splitters: list[tuple[bytes, bytes]], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by part -> windows found, and runs, by the text before the anchor, of what other ranges may have too."""
    found = _Intervals()
    squeeze = zstandard.ZstdCompressor(level=1)
    for part, payloads in _by_part(batches):
        around = [s for s in _around(part, splitters) if len(s) >= gram]
        members: list[tuple] = []
        opened: list[tuple[bytes, bytes, int, int]] = []

        def finish(members, around=around, opened=opened) -> None:
            if len(members) > 1:
                resolve(members, length, found.put)
            near = [s for s in around if s[:gram] == members[0][1][:gram]]
            for _, right, left, block, place in members if near else ():
                depth = _depth(right, near)
                if depth >= length - len(left):
                    opened.append((left, right[:depth], block, place))

        for rec in merge_runs([decode_run(p) for p in payloads]):
            if rec[0] < gram and members:
                finish(members)
                members = []
            members.append(rec)
        if members:
            finish(members)
        # Windows that two of these have in common have been found: one of them stands for both.
        opened.sort()
        once: list[tuple[bytes, bytes, int, int]] = []
        for left, right, block, place in opened:
            if once and once[-1][:2] == (left, right):
                once[-1] = (left, right, block, -1)
            else:
                once.append((left, right, block, place))
        yield from _cut(once, left_splitters, squeeze)
    packed = found.packed()
    if packed:
        yield _rows([_KNOWN] * len(packed), list(packed), list(packed.values()))


def _merge_left(batches: Iterator[pa.RecordBatch], splitters: list[tuple[bytes, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """Runs by the text before the anchor -> windows found, and windows that other ranges may have too, each once with its count (2 at most)."""
    found = _Intervals()
    for part, payloads in _by_part(batches):
        members = list(merge_runs([decode_run(p) for p in payloads]))
        around = _around(part, splitters)
        lefts, rights = [m[1] for m in members], [m[2] for m in members]
        places, many = [(m[3], m[4]) for m in members], [m[4] < 0 for m in members]
        depth = np.array([_depth(x, around) for x in lefts])
        gathered = _Found(places, many, found.put)
        for before, has, code in ranked(lefts, rights, [m[0] for m in members], length, True):
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            count = gathered.add(before, has, group)
            some = np.flatnonzero(depth[has[first]] >= before)
            if len(some):
                who = has[first[some]].tolist()
                once = (count[some] == 1).tolist()
                key = [lefts[i][:before][::-1] + rights[i][: length - before] for i in who]
                window = [np.array([places[i][1] - before] * 2, "<i4").tobytes() if o else None for i, o in zip(who, once, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([_OPEN] * len(who), pa.int32()), pa.array([places[i][0] for i in who], pa.int64()), pa.array(window, pa.binary()), pa.array(key, pa.binary()), pa.array(np.minimum(count[some], 2).astype(np.int32))], schema=_OUT)
        gathered.close()
    packed = found.packed()
    if packed:
        yield _rows([_KNOWN] * len(packed), list(packed), list(packed.values()))


def _splitters(blocks: DataFrame, lists: DataFrame, parts: int, length: int, gram: int) -> tuple[list[tuple[bytes, bytes]], list[tuple[bytes, bytes]]]:
    """At most parts-1 splitters by suffix and by the text before it, from a sample of anchors bounded by the number of ranges."""
    wanted = max(SAMPLE_BLOCKS, -(-SAMPLE_RANGE * parts // SAMPLE_ANCHORS))
    every = max(1, blocks.count() // wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _blocks_in(batches):
            some = _regions(row, length, gram)[0]
            some = some[:: max(1, len(some) // SAMPLE_ANCHORS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.binary()), pa.array([r[1] for r in some], pa.binary())], ["r", "l"])

    chosen = F.pmod(F.xxhash64("block"), F.lit(every)) == 0
    rows = blocks.filter(chosen).join(lists.filter(chosen), "block").select("block", "sizes", "blob", "hashes").limit(2 * wanted)
    got = sorted((bytes(x.r), bytes(x.l)) for x in rows.mapInArrow(tidied(run), "r binary, l binary").collect())
    right = sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []
    opened = []
    for r, x in got:
        depth = _depth(r, [s for s in _around(bisect_right(right, (r, x)), right) if s[:gram] == r[:gram]])
        if depth >= length - len(x):
            opened.append((x, r[:depth]))
    opened.sort()
    return right, sorted({opened[len(opened) * i // parts] for i in range(1, parts)}) if opened else []


def _twice(text: DataFrame, length: int, gram: int) -> DataFrame:
    """block, hashes: the k-gram hashes of the block's anchors that occur twice in all blocks."""
    spark = text.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _blocks_in(batches):
            ends = np.cumsum(np.array(row["sizes"].values, np.int64))
            h, count = np.unique(anchors(_bytes_of(row["blob"].as_py()), ends, length, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), row["block"].as_py())), pa.array(np.minimum(count, 2).astype(np.int32))], ["h", "block", "n"])

    # A hash has one row for each block at most, whatever its frequency, and is counted with partial sums.
    seen = materialize(text.mapInArrow(tidied(hashes), "h long, block long, n int"), "seen")
    counts = materialize(seen.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("blocks")).filter("all > 1").select("h", "blocks"), "counts")
    most = seen.count() // HOT
    # Fewer than HOT hashes can have more than a HOT-th of the rows each: their list is bounded, and no join gathers their rows.
    hot = spark.createDataFrame([(r.h,) for r in counts.filter(F.col("blocks") > max(most, 1)).select("h").limit(HOT).collect()] if most else [], "h long")
    cold = seen.join(F.broadcast(hot), "h", "left_anti").join(counts.select("h"), "h", "left_semi")
    lists = cold.union(seen.join(F.broadcast(hot), "h", "left_semi")).groupBy("block").agg(F.collect_list("h").alias("hashes"))
    lists = materialize(lists, "anchors")
    drop(seen)
    drop(counts)
    return lists


def find_repeats(blocks: DataFrame, length: int, gram: int, parts: int | None = None) -> DataFrame:
    """block, found: packed pairs of first and last windows that start at two places or more."""
    n = shuffle_partitions(blocks.sparkSession)
    parts = parts or 2 * n
    text = blocks.select("block", "sizes", "blob")
    lists = _twice(text, length, gram)
    splitters, left_splitters = _splitters(text, lists, parts, length, gram)
    dealt = lambda df: df.filter("part >= 0").select("part", "payload").repartition(n, "part").sortWithinPartitions("part")
    runs = text.join(lists, "block").select("block", "sizes", "blob", "hashes").mapInArrow(tidied(lambda b: _runs(b, splitters, length, gram)), _DDL)
    runs = materialize(runs, "runs")
    merged = materialize(dealt(runs).mapInArrow(tidied(lambda b: _merge(b, splitters, left_splitters, length, gram)), _DDL), "merged")
    left = materialize(dealt(merged).mapInArrow(tidied(lambda b: _merge_left(b, left_splitters, length)), _DDL), "left")
    found = runs.union(merged).union(left).filter(F.col("part") == _KNOWN).select("block", "payload")
    windows = left.filter(F.col("part") == _OPEN)
    counted = windows.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1").select("key")
    found = found.union(windows.filter("payload is not null").join(counted, "key").select("block", "payload"))
    found = materialize(found.groupBy("block").agg(F.collect_list("payload").alias("found")), "found")
    for table in (lists, runs, merged, left):
        drop(table)
    return found


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, parts: int | None = None) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary).

    Every byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another,
    is removed; strings are judged on the input and never cross documents. Null counts as empty; texts shorter
    than `length` stay whole; repeated rows remove each other. Cut texts may break a character, so kept is binary.
    An empty table gives no rows; other columns may have any names. A block of some 2 MB, or one longer
    document, is in a task's memory at a time. parts: ranges of sorted suffixes (two for each shuffle partition).
    """
    id_type = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    blocks = materialize(slim.mapInArrow(tidied(_pack), f"block long, ids array<{id_type}>, sizes array<long>, blob binary"), "blocks")
    found = find_repeats(blocks, length, gram, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes = batch.column(0)[row].values, np.array(batch.column(1)[row].values, np.int64)
                data = _bytes_of(batch.column(2)[row].as_py())
                lists = batch.column(3)[row].as_py() or []
                edge = np.zeros(len(data) + 1, np.int32)
                if lists:
                    pairs = np.frombuffer(b"".join(lists), "<i4").reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1].astype(np.int64) + length, -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                off = np.r_[0, np.cumsum(sizes)]
                begins = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
                first = off[:-1][sizes > 0]
                begins[first] = gone[first]
                n_gone, n_spans = (np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])[off] for x in (gone, begins))
                del edge, begins
                kept = data[~gone].tobytes()
                kept_off = (off - n_gone).tolist()
                texts = [kept[a:b] for a, b in zip(kept_off, kept_off[1:], strict=False)]
                out = [ids, pa.array(sizes), pa.array(np.diff(n_gone)), pa.array(np.diff(n_spans)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(texts, pa.binary())] if keep_text else [])], [*names, *(["kept"] if keep_text else [])])

    joined = blocks.join(found, "block", "left").select("ids", "sizes", "blob", "found")
    return joined.mapInArrow(tidied(cut), f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
