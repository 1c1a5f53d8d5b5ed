from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from cases import SCHEMA, documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from logweir.llm.bpe import Codec, PairIndex, WordIds, decoded, encoded
from logweir.llm.packing import word_vocabulary

PATH = word_vocabulary()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(PATH)
    known.no_truncation()
    known.no_padding()
    return known


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def one_by_one(symbols, ranks, made):
    """The lowest rank first, leftmost first, one merge at a time."""
    now = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(now, now[1:])) if p in ranks), default=None)
        if best is None:
            return now
        rank, i = best
        now[i : i + 2] = [made[rank]]


@pytest.mark.parametrize("seed", range(20))
def test_any_order_of_merges(seed):
    """Also merges whose product is part of an earlier merge, and products made twice."""
    r = random.Random(seed)
    tokens = list("abcd")
    merges = []
    for _ in range(25):
        pair = (r.choice(tokens), r.choice(tokens))
        if len(pair[0] + pair[1]) < 12 and pair not in merges:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    r.shuffle(merges)
    vocabulary = {t: k for k, t in enumerate(dict.fromkeys([*"abcd", *tokens]))}
    index = PairIndex(vocabulary, merges)
    pieces = [[vocabulary[r.choice("abcd")] for _ in range(r.choice([0, 1, 2, 7, 40]))] for _ in range(30)]
    ids, lengths = index.merge(np.array([s for p in pieces for s in p], int), np.array([len(p) for p in pieces]))
    ends = lengths.cumsum()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths)] == [one_by_one(p, index.ranks, index.made) for p in pieces]
    assert index.merge(np.zeros(0, int), np.zeros(0, int))[0].tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "it's  <|startoftext|>x", "aaaaaaaaaaaaa", "ΣΑΣ İ ǅ é̀", "\x1c \x85 a", "１2३", ""]), max_size=6))
def test_any_text(library, codec, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for by_word in (True, False):
        got = [list(memoryview(p).cast("I")) for p in WordIds(codec, by_word).of([t.encode() for t in texts])]
        assert got == want


def test_words_are_dropped_and_learnt_again(library, codec):
    words = WordIds(codec, True, kept=1000)
    texts = [f"word{k} other{k % 7} <|endoftext|>" for k in range(50)]
    for text in texts + texts:
        assert [list(memoryview(p).cast("I")) for p in words.of([text.encode()])] == [library.encode(text, add_special_tokens=False).ids]
        assert words.size < 3000


def test_awkward_rows(spark, library):
    rows = documents() + [(None, "no id", None, None, None, "x"), (500, "z" * 200_000, "en", "a", 1, "x"), (501, "ab " * 100_000, "en", "a", 1, "x")]
    given_rows = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", ids string, `odd.name` int")
    coded = encoded(given_rows, PATH)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "extra", "odd.name", "ids"]
    got = sorted((repr(r["doc_id"]), tuple(r["ids"]), r["text"], r["odd.name"]) for r in decoded(coded, PATH).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((repr(doc_id), tuple(ids), library.decode(ids, skip_special_tokens=False), 3))
    assert got == sorted(want)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert decoded(encoded(none, PATH), PATH).collect() == []


def test_numbers_without_a_token(spark, library):
    lists = [[1, 99_999_999, 2, -5, 49406], None, [], [49408], [320, 321]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>")
    got = {r["k"]: r["text"] for r in decoded(rows, PATH).collect()}
    assert got == {k: library.decode([i for i in x or [] if i >= 0], skip_special_tokens=False) for k, x in enumerate(lists)}


def test_query(spark, library):
    got = sorted(tuple(r) for r in driver.queries()["op12_bpe_codec"](spark, SF).collect())
    want = []
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode(text, add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(want)


def test_full_store_keeps_the_words_still_in_use():
    codec, asked = Codec(PATH), []

    class Told:
        def encode_words(self, words):
            asked.append(sorted(words))
            return codec.encode_words(words)

    words = WordIds(Told(), True, kept=1)
    first = list(words.of([b"a few words", b"a"]))
    again = list(words.of([b"a few more"]))
    assert asked == [["a", "few", "words"], ["more"]] and sorted(words.ids) == [b"a", b"few", b"more"]
    assert again == [words.ids[b"a"] + words.ids[b"few"] + words.ids[b"more"]] and first[1] == words.ids[b"a"]
