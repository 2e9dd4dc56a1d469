import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from docsql.llm import token_store
from tokenizers import Tokenizer

from .data import COLUMNS, documents, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("largest", [50000, 70000])
def test_round_trip_and_random_access(largest):
    rnd = random.Random(3)
    docs = [np.array([rnd.choice([5, 6, 7, 7, largest]) for _ in range(rnd.randint(1, 400))] + [2], np.uint32) for _ in range(60)]
    docs += [np.array([2], np.uint32), np.array([7] * 5000 + [2], np.uint32)]
    payload = token_store.compress(docs, least=3)
    block = token_store.Block(payload)
    assert len(payload) < (2 if largest < 1 << 16 else 4) * sum(map(len, docs))
    assert all((a == b).all() for a, b in zip(block.all(), docs, strict=True))
    for k in range(len(docs)):
        assert (block.document(k) == docs[k]).all()
        a = rnd.randrange(len(docs[k]))
        b = rnd.randint(a, len(docs[k]))
        assert (block.tokens(k, a, b) == docs[k][a:b]).all()


def frequent(block):
    """The most occurrences, none overlapping another, of one pair of a block's symbols."""
    n = Counter()
    for a, b in zip(block.first, block.first[1:], strict=False):
        seq, taken = block.seq[a:b].tolist(), {}
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if taken.get(pair) != i - 1:
                taken[pair] = i
                n[pair] += 1
    return max(n.values(), default=0)


def test_no_frequent_pair_is_left():
    rnd = random.Random(4)
    passage = [rnd.randrange(3, 50000) for _ in range(1000)]
    copies = [np.array([*passage, 2], np.uint32)] * 300
    mixed = [np.array([rnd.choice([0, 1, 1, 3]) for _ in range(rnd.randint(1, 300))] + [2], np.uint32) for _ in range(200)]
    runs = [np.array([k] * n + [2], np.uint32) for k in (0, 7) for n in (1, 13, 5000)]
    for docs in (copies, mixed, runs, copies + mixed + runs):
        block = token_store.Block(token_store.compress(docs))
        assert frequent(block) < token_store.LEAST
        assert all((a == b).all() for a, b in zip(block.all(), docs, strict=True))
    block = token_store.Block(token_store.compress(copies))
    assert len(block.seq) <= 2 * len(copies) and block.length.max() >= 1000
    assert (block.tokens(299, 400, 900) == passage[400:900]).all()


def test_encoder_equals_library():
    texts = ["", " ", "a  b", "it's a 'dog' \n\n x", " lead", "trail ", "x y z", "a\tb c\r\n d", "don't  stop\n now", "é è 12 3.4 <|endoftext|> q", "日本 語", "a   b", "\x1c a", "a\x85 b", "\nx", "x\n", "a\nb c.\nD e", "a \nb", "a\n b", "a\n\nb c", "x ab. ab, ab .. ., é. 1. a1, 's. it's, d. y", "x Ġ ĠĠĠ ÿþ ñü× ÷ ßÀÖ, ɏ ɐ Ÿ. łódź Łódź, naïve Ā"] * 2
    texts += [" ".join(chr(c) * (c % 3 + 1) + "ab" for c in range(33, 0x260)), " ".join(chr(c) for c in range(33, 0x260))]
    plain = Tokenizer.from_file(PATH)
    encoder = token_store.Encoder(PATH)
    assert encoder.by_parts
    for got, want in zip(encoder.encode(pa.array(texts)), plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_table_of_parts_forgets(monkeypatch):
    """Texts are encoded alike whatever the table of parts holds at the time."""
    monkeypatch.setattr(token_store, "PARTS", 60)
    rnd = random.Random(5)
    plain, encoder = Tokenizer.from_file(PATH), token_store.Encoder(PATH)
    for _ in range(40):
        texts = [" ".join(rnd.choice(["the", "of", "and,", "\nso"]) + (rnd.choice(["", str(rnd.randrange(99)), ".", "ly"])) for _ in range(rnd.randint(0, 12))) for _ in range(8)]
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.words) <= 60 + 100 and encoder.uses.max() > 1


def test_table(spark):
    rows = documents()
    got = token_store.read_tokens(token_store.write_tokens(table(spark, rows), PATH)).collect()
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[0]) == [(s, i, n, c) for i, s, n, c in want]


def test_empty(spark):
    assert token_store.read_tokens(token_store.write_tokens(spark.createDataFrame([], COLUMNS), PATH)).collect() == []
