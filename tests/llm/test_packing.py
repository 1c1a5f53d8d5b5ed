from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from cases import SCHEMA, documents
from logweir.llm.packing import WordIds, best_fit_plan, packed, word_vocabulary


def check(rows, sequence):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence
    return len(places)


def test_pieces_and_places(spark):
    docs = documents()
    rows = packed(spark.createDataFrame(docs, SCHEMA)).collect()
    tokenizer = Tokenizer.from_file(word_vocabulary())
    expected = []
    for d in docs:
        ids = tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.append((d[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(expected)
    least = -(-sum(e[3] for e in expected) // 2048)
    assert check(rows, 2048) <= least + 1


def test_plan_places_every_piece_once():
    r = random.Random(3)
    for _ in range(50):
        size = r.choice([10, 64, 100])
        counts = {r.randint(1, size): r.randint(0, 40) for _ in range(r.randint(1, 30))}
        rows, seen = [], {}
        for length, first, n, sequence, each, offset in best_fit_plan(counts, size):
            assert seen.get(length, 0) == first
            seen[length] = first + n
            rows += [{"sequence_id": sequence + i // each, "offset": offset + i % each * length, "length": length} for i in range(n)]
        assert {k: v for k, v in seen.items()} == {k: v for k, v in counts.items() if v}
        made = check(rows, size)
        # best fit by falling length, document by document
        bins = []
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fit = min((b for b in bins if b[0] >= length), default=None, key=lambda b: b[0])
            if fit is None:
                bins.append([size - length])
            else:
                fit[0] -= length
        assert made == len(bins)


def test_word_ids_equal_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(word_vocabulary())
    texts = ["It's WE'LL 'RE don't'll a\x1cb a\x00c x\u00a0y ΣΑΣ <|endoftext|>a b<|x İstanbul ﬁ e\u0301 \u0301z ß ŉ ſ ÷ × 12ab,34.", "", "É!é?", "日本語 слово"]
    for text, ids in zip(texts, WordIds(word_vocabulary()).of([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_sizes_and_empty(spark):
    docs = spark.createDataFrame(documents()[:9], SCHEMA)
    rows = packed(docs, sequence=16, end_id=7, with_ids=True).collect()
    assert max(r["length"] for r in rows) == 16
    check(rows, 16)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packed(spark.createDataFrame([], SCHEMA)).collect() == []
