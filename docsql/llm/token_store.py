"""Token ids in a compressed binary format with random access.

Documents are range-partitioned and sorted by id, encoded, and written as blocks: rows of a Parquet table whose
`payload` holds the block in the format below. A block is compressed by Re-Pair, several pairs a round: the most
frequent id pairs become nonterminals, occurrences that overlap go to the more frequent pair, and rounds follow
until too few pairs repeat. No rule crosses a document's end, so each document decodes by itself; expansion
lengths lead to any token inside it.

Payload (little-endian): 4 bytes magic; uint32 documents, symbols, rules, base, rounds, width (2 or 4 bytes a
symbol); uint32 x rounds: rules after each round; 2 x rules symbols: left and right; uint32 x rules: expansion
lengths; uint32 x documents: symbols of each; symbols. Nonterminal number r is symbol base + r.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsql.llm.common import groups_of, materialize, shuffle_partitions, tidied

END_ID = 2
#: Tokens in a block (a longer document is a block of its own); occurrences that make a rule.
BLOCK, LEAST = 1 << 19, 12
MAGIC = b"RPB1"
_SLOTS = 18
#: Bytes of text encoded at a time, and distinct parts of texts (some 40 bytes each) that a worker process remembers.
GROUP, PARTS = 8 << 20, 1 << 19


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library, each distinct part once while the table of parts holds it.

    A byte-level tokenizer that splits by the usual pattern never joins what a single blank or line feed separates
    from other text, nor a letter and the final comma or full stop after it. Such parts (with the blank or line feed
    before them) are encoded many in one call: the ids' byte lengths tell where each part ends. Parts of Latin letters
    are one word each to the pattern, so the library's model takes them without being cut again. Texts with other
    white space at a blank are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
        if self.by_parts:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():  # a byte-level token has a character for each byte
                self.n_bytes[i] = len(token)
            self.comma, self.stop = (int(x[0]) for x in self._whole([",", "."]))
            self.uncut = Tokenizer.from_str(self.tokenizer.to_str())  # takes words in the characters that stand for their bytes
            self.uncut.pre_tokenizer = None
            self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """As _whole(), of texts that are words of letters with a blank before each."""
        words = [t.encode().decode("latin1").translate(_CHARACTERS).replace(_BLANK, " " + _BLANK)[1:].split(" ") for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.uncut.encode_batch_fast(words, is_pretokenized=True, add_special_tokens=False)]

    def _parts(self, parts: pa.Array, before: str, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts with `before` in front of each, one part after the other, and how many ids each has; letters: the parts are Latin letters alone."""
        cut = np.r_[np.arange(0, len(parts), 1000), len(parts)]
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), parts.cast(pa.string()))
        texts = [before + t for t in pc.binary_join(lists, before).to_pylist()] if len(parts) else []
        size = pc.binary_length(parts).to_numpy(zero_copy_only=False) + len(before)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j, got in zip(cut[:-1].tolist(), cut[1:].tolist(), self._words(texts) if letters else self._whole(texts), strict=False):
            ends, at = np.cumsum(size[i:j]), np.cumsum(self.n_bytes[got])
            last = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[last] == ends).all():
                ids.append(got)
                counts.append(np.diff(np.r_[-1, last]))
            else:  # a file whose ids do not follow the text byte by byte
                each = self._whole([before + p for p in parts[i:j].to_pylist()])
                ids += each
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(counts)

    def _forget(self) -> None:
        """Leaves in the table of parts those met in more than one group of texts, or none if they are too many.

        Of each part: its text, where its ids stand in `flat`, how many there are without a final point, the point, whether
        it stands alone, whether a line feed stands before it, and the groups that it was met in.
        """
        keep = np.flatnonzero(self.uses > 1) if hasattr(self, "uses") else np.zeros(0, np.int64)
        if not len(keep) or len(keep) > PARTS // 2:
            self.words, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
            self.start, self.count, self.point, self.uses = (np.zeros(0, np.int32) for _ in range(4))
            self.stands, self.led = (np.zeros(0, bool) for _ in range(2))
            return
        self.words = self.words.take(pa.array(keep))
        start, self.count, self.point, self.stands, self.led = (x[keep] for x in (self.start, self.count, self.point, self.stands, self.led))
        self.uses = np.ones(len(keep), np.int32)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)
        self.flat = self.flat[np.repeat(start - self.start, self.count) + np.arange(int(self.count.sum()))]

    def _learn(self, words: pa.Array) -> None:
        """Adds parts (a part that a line feed stands before begins with it)."""
        test = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False)
        led = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        core = pc.if_else(pa.array(led), pc.utf8_slice_codeunits(words, 1), words) if led.any() else words
        stands = ~test(core, rf"^{_WHITE}|{_WHITE}$|^$")
        ended = test(core, r"\pL[,.]$")
        point = np.where(ended, np.where(pc.ends_with(core, ",").to_numpy(zero_copy_only=False), self.comma, self.stop), 0).astype(np.int32)
        base = pc.if_else(pa.array(ended), pc.utf8_slice_codeunits(core, 0, -1), core)
        flat, held = [self.flat], len(self.flat)
        start, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        letters = test(base, rf"^{_LATIN}+$")
        for before, mine, whole in ((" ", stands & ~led & letters, True), (" ", stands & ~led & ~letters, False), ("\n", stands & led, False)):
            mine = np.flatnonzero(mine)
            once = base.take(pa.array(mine)).dictionary_encode()
            order = np.array(pc.sort_indices(once.dictionary))  # words with a common beginning next to each other are encoded faster
            ids, n = self._parts(once.dictionary.take(pa.array(order)), before, whole)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            which = place[np.array(once.indices, np.int64)]
            start[mine], count[mine] = held + (np.cumsum(n) - n)[which], n[which]
            flat.append(ids)
            held += len(ids)
        self.flat = np.concatenate(flat)
        self.words = pa.concat_arrays([self.words, words])
        for name, more in (("start", start), ("count", count), ("point", point), ("stands", stands), ("led", led), ("uses", np.zeros(len(words), np.int32))):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _look(self, words: pa.Array) -> np.ndarray:
        """Where the words stand in the table, which is taught those it lacks; a table grown too large forgets."""
        find = lambda: pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = find()
        if len(self.words) + int((at < 0).sum()) > PARTS and len(self.words):
            self._forget()
            at = find()
        new = at < 0
        if new.any():
            at[new] = len(self.words) + np.arange(int(new.sum()))
            self._learn(words.filter(pa.array(new)))
        self.uses[at] += 1
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; no text is null."""
        if not len(texts):
            return []
        if not self.by_parts:
            return self._whole(texts.to_pylist())
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        off = np.array(split.offsets, np.int64)
        off -= off[0]
        coded = split.flatten().dictionary_encode()
        words, where = coded.dictionary, np.array(coded.indices, np.int32)
        del split, coded
        known = self._look(words)
        start, count, point, stands, led = (x[known] for x in (self.start, self.count, self.point, self.stands, self.led))
        held = len(self.flat)
        # Heads have no blank before them; they, and whole texts with a part that does not stand alone, are encoded here.
        first = off[:-1]
        fine = stands[where]
        fine[first] = True
        odd = ~np.logical_and.reduceat(fine, first)
        odd |= led[where[first]] | ~stands[where[first]]
        heads = words.take(pa.array(where[first])).to_pylist()
        own = self._whole([texts[i].as_py() if o else h for i, (h, o) in enumerate(zip(heads, odd.tolist(), strict=True))])
        size = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate([self.flat, *own])
        stay = ~np.repeat(odd, np.diff(off))
        stay[first] = True
        at, n, last = start[where], count[where], point[where]
        at[first], n[first], last[first] = held + np.cumsum(size) - size, size, 0
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
        if not stay.all():
            row, at, n, last = row[stay], at[stay], n[stay], last[stay]
        has = last > 0
        n += has
        ends = np.cumsum(n, dtype=np.int64)
        from_ = np.repeat(at - (ends - n).astype(np.int32), n)
        from_ += np.arange(ends[-1], dtype=np.int32)  # a group has far fewer than 2^31 ids
        final = ends[has] - 1
        from_[final] = 0
        ids = flat[from_] if len(flat) else np.zeros(len(from_), np.uint32)
        ids[final] = last[has]
        return np.split(ids, np.cumsum(np.bincount(row, n, len(texts)).astype(np.int64))[:-1])


#: Any white space, and the control characters that some take for it.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Letters in every version of Unicode.
_LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
#: The character that stands for each byte in a byte-level vocabulary: itself if it shows, else the next from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_CHARACTERS = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
_BLANK = chr(_CHARACTERS[32])


@lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


# ---------------------------------------------------------------- blocks


def _frequent(code: np.ndarray, follows: np.ndarray, least: int) -> np.ndarray:
    """The pairs with `least` occurrences or more that do not overlap, the most frequent first; code: pairs in order, follows: whether each (but the first) begins with the symbol that the one before ends with."""
    ordered = np.sort(code)
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[edge, len(ordered)])
    often = np.flatnonzero(count >= least)
    pairs, count = ordered[edge[often]], count[often]
    # A run of k equal pairs is a run of k + 1 equal symbols and holds (k + 1) // 2 pairs that do not overlap.
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | ~follows])
    runs = np.diff(np.r_[starts, len(code)])
    starts, runs = starts[runs > 1], runs[runs > 1]
    if len(starts) and len(pairs):
        where = np.minimum(np.searchsorted(pairs, code[starts]), len(pairs) - 1)
        mine = pairs[where] == code[starts]
        count = count - np.bincount(where[mine], runs[mine] // 2, len(pairs)).astype(np.int64)
        pairs, count = pairs[count >= least], count[count >= least]
    return pairs[np.argsort(-count, kind="stable")]


def compress(docs: list[np.ndarray], least: int = LEAST) -> bytes:
    """A block of documents, none of them without ids. No pair of its symbols is left that occurs `least` times."""
    seq = np.concatenate(docs).astype(np.uint32)
    base = int(seq.max()) + 1
    last = np.zeros(len(seq), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    left, right, length = [], [], np.ones(0, np.int64)
    after = []
    # Symbols that are gone stay in place; the others are a list in both directions, so that a round costs what it looks at.
    n = len(seq)
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive, mark = np.ones(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(~last)  # places whose pair may be frequent: a pair elsewhere is as rare as it was, or a document's end
    while len(at):
        # Pairs of 16-bit symbols fit into 32 bits, which are sorted and looked up in half the time.
        half, odd = (16, 0x9E3779B1) if base + len(left) <= 1 << 16 else (32, 0x9E3779B97F4A7C15)
        pair_kind = np.uint32 if half == 16 else np.uint64
        shift = pair_kind(half)
        behind = nxt[at]
        code = (seq[at].astype(pair_kind) << shift) | seq[behind].astype(pair_kind)
        pairs = _frequent(code, at[1:] == behind[:-1], least)
        if not len(pairs):
            break
        slot = lambda c: (c * pair_kind(odd)) >> pair_kind(2 * half - _SLOTS)
        none, own = len(pairs), slot(pairs)
        table = np.zeros(1 << _SLOTS, pair_kind)
        rank_of = np.full(1 << _SLOTS, none, np.int32)
        table[own[::-1]] = pairs[::-1]  # of two pairs in a slot the more frequent stays, the other waits for the next round
        rank_of[own[::-1]] = np.arange(none, dtype=np.int32)[::-1]
        near = slot(code)
        rank = rank_of[near]
        known = np.flatnonzero((table[near] == code) & (rank < none))
        spot, rank = at[known], rank[known]
        # In a run of one pair, which overlaps itself, every second one stands for all.
        joined = np.r_[False, spot[1:] == nxt[spot[:-1]]]
        place = np.arange(len(spot))
        begins = np.maximum.accumulate(np.where(joined & np.r_[False, rank[1:] == rank[:-1]], 0, place))
        before = np.where(joined, np.r_[none, rank[:-1]], none)
        before[place > begins] = none
        following = np.where(np.r_[joined[1:], False], np.r_[rank[1:], none], none)
        won = ((place - begins) % 2 == 0) & (rank < before) & (rank <= following)
        used = np.bincount(rank[won], minlength=none)
        chosen = used >= min(3, least)
        won &= chosen[rank]
        pick = spot[won]
        number = np.cumsum(chosen) - 1 + len(left)
        first, second = (pairs[chosen] >> shift).astype(np.int64), (pairs[chosen] & pair_kind((1 << half) - 1)).astype(np.int64)
        span = lambda s: np.where(s < base, 1, length[np.maximum(s - base, 0)] if len(length) else 1)
        length = np.r_[length, span(first) + span(second)]
        left += first.tolist()
        right += second.tolist()
        after.append(len(left))
        seq[pick] = (base + number[rank[won]]).astype(np.uint32)
        gone = nxt[pick]
        last[pick] = last[gone]
        alive[gone] = False
        then = nxt[gone]
        nxt[pick], prv[then] = then, pick
        # Next come the places that lost or waited, and those beside a new symbol: all others' pairs are rare and stay so.
        mark[spot] = True
        waits = pairs[table[own] != pairs]
        if len(waits):
            taken = np.zeros(1 << _SLOTS, bool)
            taken[slot(waits)] = True
            some = np.flatnonzero(taken[near])
            mark[at[some[np.isin(code[some], waits)]]] = True
        mark[pick] = True
        earlier = prv[pick]
        mark[earlier[earlier >= 0]] = True
        mark &= alive & ~last
        at = np.flatnonzero(mark)
        mark[at] = False
    seq, last = seq[alive], last[alive]
    ends = np.flatnonzero(last)
    sizes = np.diff(np.r_[-1, ends])
    width = 2 if base + len(left) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = MAGIC + struct.pack("<6I", len(docs), len(seq), len(left), base, len(after), width)
    return b"".join([head, np.array(after, "<u4").tobytes(), np.array(left, kind).tobytes(), np.array(right, kind).tobytes(), length.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), seq.astype(kind).tobytes()])


class Block:
    """A read block."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        docs, symbols, rules, self.base, rounds, width = struct.unpack_from("<6I", payload, 4)
        at, kind = 28, f"<u{width}"

        def take(n: int, what: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, what, n, at)
            at += out.nbytes
            return out.astype(np.int64)

        self.after = take(rounds, "<u4").tolist()
        self.left, self.right, self.length = take(rules, kind), take(rules, kind), take(rules, "<u4")
        self.sizes, self.seq = take(docs, "<u4"), take(symbols, kind)
        self.first = np.r_[0, np.cumsum(self.sizes)]

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """Each symbol's place in the result is known from the lengths, so only what is still a rule is taken up again.

        Used for a few symbols, and once for all rules where a whole block is read.
        """
        n = self.spans(seq)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        while len(seq):
            plain = seq < self.base
            out[at[plain]] = seq[plain]
            rule, at = seq[~plain] - self.base, at[~plain]
            seq = np.concatenate([self.left[rule], self.right[rule]])
            at = np.concatenate([at, at + self.spans(self.left[rule])])
        return out

    def spans(self, seq: np.ndarray) -> np.ndarray:
        return np.where(seq < self.base, 1, self.length[np.maximum(seq - self.base, 0)] if len(self.length) else 1)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.seq[self.first[k] : self.first[k + 1]]).astype(np.uint32)

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop) of document k; only the symbols that cover them are expanded."""
        seq = self.seq[self.first[k] : self.first[k + 1]]
        ends = np.cumsum(self.spans(seq))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return self._expand(seq[a:b])[skip : skip + stop - start].astype(np.uint32)

    def all(self) -> list[np.ndarray]:
        """All documents: every rule is expanded once, and symbols copy from there."""
        rules, n = self._expand(self.base + np.arange(len(self.left))), self.spans(self.seq)
        ends, own = np.cumsum(n), np.cumsum(self.length)
        begin = len(rules) + np.arange(len(self.seq))  # of what a symbol copies: itself, or its rule
        some = np.flatnonzero(self.seq >= self.base)
        which = self.seq[some] - self.base
        begin[some] = own[which] - self.length[which]
        from_ = np.repeat((begin - (ends - n)).astype(np.int32), n)
        from_ += np.arange(len(from_), dtype=np.int32)  # a block has far fewer than 2^31 ids
        flat = np.concatenate([rules, self.seq]).astype(np.uint32)[from_]
        stops = np.r_[0, ends][self.first].tolist()
        return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)]


# ---------------------------------------------------------------- tables


def write_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes every whole text of df, appends end_id, and writes the blocks; returns the written table.

    Rows: shard, block, start (tokens of the shard before it), n_tokens, ids (of its documents), payload. Shards
    and blocks follow the ids in ascending order, null ids first. A null text is empty and so is its end id alone.
    Rows with equal ids stay next to each other. The ranges are sampled, so a hot range is cut by Spark.
    """
    n = shuffle_partitions(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), encoder_for(tokenizer)
        ids, docs, held, start, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, held, start, block
            of = pa.array([ids]).cast(pa.list_(id_arrow)) if id_arrow else pa.array([ids])
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), of, pa.array([compress(docs)], pa.binary())], ["shard", "block", "start", "n_tokens", "ids", "payload"])
            ids, docs, start, held, block = [], [], start + held, 0, block + 1
            return out

        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            for i, j in groups_of(np.r_[0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)], GROUP):
                part = batch.slice(i, j - i)
                for i, tokens in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    if held and held + len(tokens) + 1 > BLOCK:
                        yield flush()
                    ids.append(i)
                    docs.append(np.append(tokens, np.uint32(end_id)))
                    held += len(tokens) + 1
        if docs:
            yield flush()

    blocks = slim.repartitionByRange(n, F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first())
    return materialize(blocks.mapInArrow(tidied(run), f"shard int, block int, start long, n_tokens long, ids array<{id_type}>, payload binary"), "tokens")


def read_tokens(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From a table of write_tokens(): id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    # One row for each shard; there are as many shards as partitions.
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("start")).alias("start"), "ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, payload in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                docs = Block(payload.as_py()).all()
                n = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(np.ascontiguousarray(d, "<u4")) for d in docs]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(tidied(run), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")
