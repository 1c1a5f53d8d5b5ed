from __future__ import annotations

import random

import numpy as np
import pytest

from cases import SCHEMA, documents, words
from logweir.llm.common import hash_words, window_hashes
from logweir.llm.licenses import LicenseIndex, TEMPLATES, bands_for, plain_words, scan


def brute(docs, templates, containment=0.75):
    """Every window of every template's class, by exact containment."""
    index = LicenseIndex(templates)
    out = {}
    for k, text in docs:
        w, at = hash_words([plain_words(text or "")])
        for c in index.classes:
            s = window_hashes(w, c.width, 4)
            starts, ends, _ = c.windows(at)
            for name, own in zip(c.names, c.sets):
                shares = [float(np.isin(own, s[i:j]).mean()) for i, j in zip(starts, ends)]
                good = [(x, int(i)) for x, i in zip(shares, starts) if x >= containment]
                if good:
                    out[k, name] = (max(x for x, _ in good), min(i for _, i in good), len(good))
    return out


def notices():
    r = random.Random(2)
    docs = []
    for k in range(120):
        name, text = TEMPLATES[k % len(TEMPLATES)]
        own = text.split()
        for _ in range(k % 4 if len(own) > 12 else 0):  # a few changed words
            own[r.randrange(len(own))] = "other"
        body = words(k, 30 + 40 * (k % 5))
        at = r.randrange(len(body))
        docs.append((k, " ".join(body[:at] + ["\n" + (" ".join(own).upper() if k % 2 else " ".join(own))] + body[at:])))
    return docs


def test_against_brute_force(spark):
    docs = notices() + [d[:2] for d in documents()[:-1]] + [(900, "Released under the MIT License."), (901, " ".join(TEMPLATES[1][1] for _ in range(300)))]
    expected = brute(docs, TEMPLATES)
    rows = scan(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"], r["windows"]) for r in rows}
    assert got == expected
    whole = [k for k, t in notices() if plain_words(TEMPLATES[k % len(TEMPLATES)][1]) .strip() in plain_words(t)]
    assert whole and all((k, TEMPLATES[k % len(TEMPLATES)][0]) in got for k in whole)


def test_bands_keep_their_promise():
    r = np.random.default_rng(3)
    for rows in (1, 2, 3):
        for s in (0.3, 0.5, 0.9):
            b = bands_for(s, rows)
            assert (1 - s**rows) ** b <= 1e-6
            assert b == 1 or (1 - s**rows) ** (b - 1) > 1e-6
    assert r is not None


@pytest.mark.parametrize("rows", [1, 2])
def test_other_bands(spark, rows):
    docs = spark.createDataFrame(notices(), "doc_id bigint, text string")
    got = {(r["doc_id"], r["license"]) for r in scan(docs, rows=rows).collect()}
    assert got == set(brute(notices(), TEMPLATES))


def test_empty_and_repeated(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = [(1, "Released under the MIT License.", "en", "a", 1, "x")] * 2
    assert [tuple(r)[:2] for r in scan(spark.createDataFrame(twice, SCHEMA)).collect()] == [(1, "mit")] * 2
    assert scan(spark.createDataFrame(twice, SCHEMA), []).collect() == []
