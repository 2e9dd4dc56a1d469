"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a few MB of whole documents) gets a suffix array over its words; every suffix of every benchmark
text is binary-searched in it, which gives all places that share at least a window of words with the suffix,
and each place is extended to the longest verbatim match. The benchmark is broadcast in blocks of bounded
size, a bounded number at a time; documents are never shuffled, and read once while the benchmark fits.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.llm.common import LOWER, field_ddl, groups_of, materialize, slices, span_hashes, text_buffer, tidied, word_spans

WINDOW, MIN_ITEMS = 8, 2
#: Bytes of documents in a shard; bytes of benchmark text in one broadcast block; blocks that are broadcast at a time.
SHARD, BLOCK, BLOCKS = 4 << 20, 8 << 20, 8
IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"


def words_of(text: str | None) -> list[bytes]:
    data, off = text_buffer(pa.array([text], pa.string()))
    low = bytes(data).translate(LOWER)
    return [low[a:b] for a, b in zip(*word_spans(data, off, IS_WORD), strict=True)]


class TestBlock:
    """Some benchmark texts as arrays, which executors read without rebuilding them.

    A word has a number by its hash (from 1, 0 is padding), which suffixes are searched by; words that share a hash
    share the number, and every match is confirmed by the words themselves.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        vocabulary = sorted({w for _, ws in items for w in ws})
        word = {w: i for i, w in enumerate(vocabulary)}
        self.text = b"".join(vocabulary)
        self.word_end = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        self.word_start = self.word_end - np.array([len(w) for w in vocabulary], np.int64)
        self.hash, number = np.unique(span_hashes(np.frombuffer(self.text, np.uint8), self.word_start, self.word_end), return_inverse=True)
        self.bits = max(1, (len(self.hash) + 1).bit_length())
        self.names = [name for name, _ in items]
        self.item_end = np.cumsum([len(ws) for _, ws in items], dtype=np.int64)
        self.words = np.array([word[w] for _, ws in items for w in ws], np.int32)
        self.numbers = (number + 1).astype(np.int32)[self.words]
        self.ordered = self.numbers.astype(">u4").tobytes()  # compares as the numbers do
        found: dict[bytes, list[int]] = defaultdict(list)
        for a, b in zip(np.r_[0, self.item_end].tolist(), self.item_end.tolist(), strict=False):
            k = min(window, b - a)
            for p in range(a, b - k + 1 if k else a):
                found[self.words[p : p + k].tobytes()].append(p)
        places = list(found.values())
        self.length = np.array([len(q) // 4 for q in found], np.int64)
        self.shortest = int(self.length.min()) if found else 0
        # Places of a window in the order of what follows it, and the set of items that have it.
        owner = np.searchsorted(self.item_end, np.array([p for x in places for p in x], np.int64), side="right")
        sets: dict[tuple[int, ...], int] = {}
        self.set_of, at = np.zeros(len(places), np.int64), 0
        for q, mine in enumerate(places):
            self.set_of[q] = sets.setdefault(tuple(sorted(set(owner[at : at + len(mine)].tolist()))), len(sets))
            at += len(mine)
            if len(mine) > 1:
                mine.sort(key=self.suffix)
        self.set_end = np.cumsum([len(x) for x in sets], dtype=np.int64)
        self.set_items = np.array([i for x in sets for i in x], np.int64)
        self.place_end = np.cumsum([len(x) for x in places], dtype=np.int64)
        self.place = np.array([p for x in places for p in x], np.int64)
        self.first = np.array([x[0] for x in places], np.int64)
        at = self.first[:, None] + np.arange(window) if places else np.zeros((0, window), np.int64)
        inner = np.arange(window) < self.length[:, None]
        rows = np.where(inner, self.numbers[np.minimum(at, max(len(self.numbers) - 1, 0))], 0).astype(np.uint64) if places else np.zeros((0, window), np.uint64)
        self.low, self.high = self._pack(rows), self._pack(np.where(inner, rows, np.uint64((1 << self.bits) - 1)))

    def end_of(self, place: int) -> int:
        """Where the item of a place ends."""
        return int(self.item_end[np.searchsorted(self.item_end, place, side="right")])

    def suffix(self, place: int) -> bytes:
        return self.ordered[4 * place : 4 * self.end_of(place)]

    def word(self, w: int) -> bytes:
        return self.text[self.word_start[w] : self.word_end[w]]

    def longest(self, q: int, numbers: np.ndarray) -> tuple[int, int]:
        """Of a window's places the one that goes on longest as the numbers (which begin with the window), and how long."""
        b = int(self.place_end[q])
        places = self.place[b - self._places(q) : b]
        at = bisect_left(places, numbers.astype(">u4").tobytes(), key=self.suffix) if len(places) > 1 else 0
        best = (0, int(places[0]))
        for p in places[max(at - 1, 0) : at + 1].tolist():
            m = min(len(numbers), self.end_of(p) - p)
            differs = np.flatnonzero(numbers[:m] != self.numbers[p : p + m])
            best = max(best, (int(differs[0]) if len(differs) else m, p), key=lambda x: x[0])
        return best

    def _places(self, q: int) -> int:
        return int(self.place_end[q] - (self.place_end[q - 1] if q else 0))

    def items(self, sets: set[int]) -> set[str]:
        return {self.names[i] for s in sets for i in self.set_items[self.set_end[s - 1] if s else 0 : self.set_end[s]].tolist()}

    def _pack(self, rows: np.ndarray) -> list[np.ndarray]:
        """Columns of word numbers as few 64-bit keys, the most significant first."""
        per = 64 // self.bits
        out = []
        for at in range(0, self.window, per):
            key = np.zeros(len(rows), np.uint64)
            for c in range(at, min(at + per, self.window)):
                key = (key << np.uint64(self.bits)) | rows[:, c].astype(np.uint64)
            out.append(key)
        return out

    def numbers_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at + 1, 0).astype(np.int32)

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in text and the queries that start there, from a suffix array of text.

        Only suffixes whose first words can begin a match are in the array; it is ordered by `window` words.
        """
        if not len(self.length) or not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.r_[text > 0, np.zeros(self.window, bool)]
        can = known[: len(text)].copy()
        for j in range(1, self.shortest):
            can &= known[j : j + len(text)]
        at = np.flatnonzero(can)
        padded = np.r_[text, np.zeros(self.window, np.int32)]
        keys = self._pack(np.stack([padded[at + j] for j in range(self.window)], axis=1)) if len(at) else []
        if not len(at):
            return at, at
        order = np.lexsort(keys[::-1])
        at, keys = at[order], [k[order] for k in keys]
        lo, hi = self._search(keys, self.low, False), self._search(keys, self.high, True)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        return at[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], which

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search of all wanted key tuples at once."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
            less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                less |= equal & (k[mid] < w)
                equal &= k[mid] == w
            go = open_ & (less | equal & right)
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block: int) -> Iterator[TestBlock]:
    """Reads the benchmark as a stream; no more than one block of it is in the driver's memory in Python form."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    for row in rows.toLocalIterator():
        if row.i is None or not (ws := words_of(row.t)):
            continue
        held.append((row.i, ws))
        size += sum(map(len, ws))
        if size >= block:
            yield TestBlock(held, window)
            held, size = [], 0
    yield TestBlock(held, window)


class _Seen:
    """What has been found in a document: items, places of windows (in words), the longest match."""

    def __init__(self):
        self.items: set[str] = set()
        self.hits: list[tuple[int, int]] = []
        self.longest: tuple[int, int | None, str | None] = (0, None, None)


def _scan(texts: pa.Array, before: pa.Array, blocks: list[Broadcast]) -> tuple[np.ndarray, list[_Seen]]:
    """Words of each document, and what the blocks find in it, added to what was found before."""
    data, off = text_buffer(texts)
    starts, ends = word_spans(data, off, IS_WORD)
    hashes = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, off)  # of each document's words
    seen = [pickle.loads(x) if x else _Seen() for x in before.to_pylist()]
    for b in blocks:
        test: TestBlock = b.value
        for i, j in groups_of(off, SHARD):
            _shard(test, data, starts, ends, hashes, first, i, j, seen)
        if len(blocks) > 1:
            del b._value  # the next block takes its place in memory
    return np.diff(first), seen


def _shard(test: TestBlock, data, starts, ends, hashes, first, i, j, seen) -> None:
    a, b = first[i], first[j]
    numbers = test.numbers_of(hashes[a:b])
    gaps = first[i + 1 : j] - a
    at, which = test.matches(np.insert(numbers, gaps, 0))  # a document's end matches nothing
    if not len(at):
        return
    # Back from places in the text with gaps to words; a row's gap stands before its first word.
    at = at - np.searchsorted(gaps + np.arange(len(gaps)), at, side="right")
    order = np.argsort(at, kind="stable")
    rows = np.searchsorted(first[i : j + 1], a + at[order], side="right") - 1 + i
    sets: dict[int, set[int]] = defaultdict(set)
    same = lambda at_word, w: data[starts[at_word] : ends[at_word]].tobytes().translate(LOWER) == test.word(w)
    for row, word, q in zip(rows.tolist(), at[order].tolist(), which[order].tolist(), strict=True):
        k, p, at_word = int(test.length[q]), int(test.first[q]), int(a + word)
        if not all(same(at_word + n, w) for n, w in enumerate(test.words[p : p + k].tolist())):
            continue  # another word with the same hash
        mine = seen[row]
        mine.hits.append((at_word - int(first[row]), k))
        sets[row].add(int(test.set_of[q]))
        length, place = test.longest(q, numbers[word : first[row + 1] - a])
        if length > mine.longest[0]:
            n = k
            while n < length and same(at_word + n, int(test.words[place + n])):
                n += 1
            if n > mine.longest[0]:
                mine.longest = (n, at_word - int(first[row]), test.names[int(np.searchsorted(test.item_end, place, side="right"))])
    for row, mine in sets.items():
        seen[row].items |= test.items(mine)


def _verdict(n_words: np.ndarray, seen: list[_Seen], min_items: int) -> dict[str, list]:
    lists = [sorted(x.items) for x in seen]
    n_hit = []
    for x in seen:
        covered, reach = 0, 0
        for at, k in sorted(x.hits):
            covered += max(0, at + k - max(at, reach))
            reach = max(reach, at + k)
        n_hit.append(covered)
    return {
        "n_words": n_words.tolist(), "n_hit": n_hit, "n_items": [len(x) for x in lists],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
        "contaminated": [len(x) >= min_items for x in lists],
        "longest_match": [x.longest[0] for x in seen], "longest_at": [x.longest[1] for x in seen], "longest_item": [x.longest[2] for x in seen],
    }


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS, remove: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated and its longest match.

    With remove, the rows of df that are not contaminated (fewer than min_items items) instead, with df's columns. Null
    or wordless texts have no words and are not contaminated; an item of fewer words than the window is one window;
    items with a null id or no words match nothing; items that share an id count once. Repeated rows are judged one
    by one. An empty benchmark contaminates nothing. Other columns may have any names. Memory: a slice of documents
    and one block of the benchmark at a time. BLOCKS blocks are broadcast at a time; a larger benchmark takes more
    passes, between which the documents and what was found in them are written to the shared folder.
    """
    sc = df.sparkSession.sparkContext
    taken = df.columns if remove else [id_col, text_col]
    which = taken.index(text_col)
    names = [*(f"c{i}" for i in range(len(taken))), "seen"]
    cur = df.select(*[(F.col(f"`{c}`").cast("string") if c == text_col and not remove else F.col(f"`{c}`")).alias(n) for c, n in zip(taken, names, strict=False)], F.lit(None).cast("binary").alias("seen"))
    schema = cur.schema
    blocks: list[Broadcast] = []
    for block in blocks_of(benchmark, item_col, item_text_col, window, BLOCK):
        if len(blocks) == BLOCKS:

            def add(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches, which):
                    seen = _scan(batch.column(which), batch.column(len(taken)), blocks)[1]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([pickle.dumps(x) if x.hits else None for x in seen], pa.binary())], names)

            cur = materialize(cur.mapInArrow(tidied(add), schema), "scanned")
            for b in blocks:
                b.destroy()
            blocks = []
        blocks.append(sc.broadcast(block))

    if remove:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, which):
                seen = _scan(batch.column(which), batch.column(len(taken)), blocks)[1]
                some = batch.filter(pa.array([len(x.items) < min_items for x in seen], pa.bool_()))
                yield pa.RecordBatch.from_arrays(some.columns[:-1], taken)

        return cur.mapInArrow(tidied(keep), df.schema)

    types = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_match": pa.int64(), "longest_at": pa.int64(), "longest_item": pa.string()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, which):
            found = _verdict(*_scan(batch.column(which), batch.column(len(taken)), blocks), min_items)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], t) for k, t in types.items())], [id_col, *types])

    return cur.mapInArrow(tidied(judge), f"{field_ddl(df, id_col)}, {RESULT}")
