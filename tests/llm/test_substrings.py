from __future__ import annotations

import collections
import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from cases import SCHEMA, documents, words
from logweir.llm.substrings import COVERS, without_repeats


def brute(docs, length):
    """(id, words, removed, kept words) of every row."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = collections.Counter(tuple(w[k : k + length]) for _, w in split for k in range(len(w) - length + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("length", [35, 12, 3, 1])
def test_against_brute_force(spark, length):
    docs = documents() + [(None, documents()[0][1], None, None, None, None), (4, "another text of the same id", "en", "a", 1, "x")]
    expected = sorted(((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute([d[:2] for d in docs], length)), key=repr)
    got = without_repeats(spark.createDataFrame(docs, SCHEMA).repartition(4), length, digest=True).collect()
    assert sorted(map(tuple, got), key=repr) == expected


def test_texts_and_other_columns(spark):
    rows = without_repeats(spark.createDataFrame(documents(), SCHEMA), keep=["source", "extra"]).collect()
    expected = {(d, k.decode() if g else None) for d, _, g, k in brute([d[:2] for d in documents()], 35)}
    texts = {d[0]: d[1] or "" for d in documents()}
    assert {(r["doc_id"], r["kept"] if r["n_removed"] else None) for r in rows} == expected
    assert all(r["kept"] == texts[r["doc_id"]] for r in rows if not r["n_removed"])
    assert {(r["doc_id"], r["source"], r["extra"]) for r in rows} == {(d[0], d[3], d[5]) for d in documents()}


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        without_repeats(spark.createDataFrame([], SCHEMA), 0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=6))
def test_few_words_many_repeats(spark, texts):
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    expected = sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute(docs, 13))
    got = without_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), 13, digest=True).collect()
    assert sorted(map(tuple, got)) == expected


def test_rows_that_share_an_id_and_a_checksum(spark):
    """Words of one are not taken for words of the other."""
    from zlib import crc32

    passage = words(50, 40)
    held, other = " ".join(words(51, 5) + passage), " ".join(words(52, 45))
    r = random.Random(1)
    tails = ["".join(r.choices("abcdefghijklmnop", k=10)) for _ in range(600_000)]
    ends = {crc32(f"{held} {t}".encode()): t for t in tails[:300_000]}
    j, k = next((t, known) for t in tails[300_000:] if (known := ends.get(crc32(f"{other} {t}".encode()))) is not None)
    for shared in (7, None):
        rows = [(shared, f"{held} {k}"), (shared, f"{other} {j}"), (9, " ".join(passage))]
        got = without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_words", "n_removed").collect()
        want = [(str(d), n, m) for d, n, m in brute_counts(rows)]
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(want) and sorted(m for *_, m in want) == [0, 40, 40]


def brute_counts(rows, length=35):
    split = [(d, t.split()) for d, t in rows]
    times = {}
    for _, w in split:
        for i in range(len(w) - length + 1):
            times[tuple(w[i : i + length])] = times.get(tuple(w[i : i + length]), 0) + 1
    for d, w in split:
        gone = {i + j for i in range(len(w) - length + 1) if times[tuple(w[i : i + length])] > 1 for j in range(length)}
        yield d, len(w), len(gone)
