from __future__ import annotations

import random

import numpy as np
import pytest

from cases import SCHEMA, documents, words
from logweir.llm import jaccard
from logweir.llm.common import components
from logweir.llm.jaccard import CountTree, Similarity, classes


def brute(docs, width=5, s=(75, 100)):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and s[1] * len(a & b) >= s[0] * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(x), least.get(root(i))) for i, ((d, _), x) in enumerate(zip(docs, sets))), key=repr)


def found(spark, docs, **options):
    rows = classes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), **options).collect()
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark):
    docs = [d[:2] for d in documents()] + [(None, "a null id of its own"), (None, documents()[0][1])]
    assert found(spark, docs) == brute(docs)
    rows = classes(spark.createDataFrame(documents(), SCHEMA)).collect()
    assert sorted(map(tuple, rows), key=repr) == brute([d[:2] for d in documents()])


def chain():
    """Texts that each link with the next but not with those further on, and look-alikes
    near the threshold."""
    base = words(50, 80)
    docs = [(k, " ".join(base[2 * k : 2 * k + 40])) for k in range(15)]
    for k in range(12):  # changed words, one to six of them
        w = list(base)
        for j in range(1 + k % 6):
            w[7 + 11 * j] = f"z{k}"
        docs.append((100 + k, " ".join(w)))
    return docs


@pytest.mark.parametrize("s", [(75, 100), (1, 2), (9, 10), (1, 1)])
def test_chains_and_thresholds(spark, s):
    assert found(spark, chain(), similarity=s) == brute(chain(), s=s)


def test_small_sets_and_ties(spark):
    docs = [(k, t) for k, t in enumerate(["a", "A", "a b", "a b c d e", "a b c d e f g", "a b c d e f g h", "b a", "a  b", "b c d e f g h"])]
    assert found(spark, docs) == brute(docs)
    assert found(spark, docs, width=2, similarity=(3, 5)) == brute(docs, 2, (3, 5))


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_MOST", 6)
    assert found(spark, chain()) == brute(chain())


def test_members_of_near_copies_grow_with_sets_not_with_shared_shingles(spark, monkeypatch):
    """Near copies of a long text share their shingles in hundreds of combinations; each
    combination is not to carry its members' points again."""
    base, r, rows = words(70, 900), random.Random(3), []
    docs = [(50, " ".join(words(71, 40)))]
    for k in range(16):
        w = list(base)
        for j in r.sample(range(900), 30 if k % 4 else 130):
            w[j] = f"z{k}"
        docs.append((k, " ".join(w)))
    units = jaccard._units
    monkeypatch.setattr(jaccard, "_units", lambda m: rows.append(m.count()) or units(m))
    assert found(spark, docs) == brute(docs)
    assert len(rows) > 2 and max(rows) <= 16 * 16


def test_merged_groups_keep_pairs_and_cost_no_more(spark):
    groups = [[1, 2, 3], [1, 3, 4], [1, 2, 3, 4], [2, 4], *[[0, k] for k in range(20, 40)]]
    rows = [(100 + g, min(m), u) for g, m in enumerate(groups) for u in m]
    got = {}
    for row in jaccard._merged(spark.createDataFrame(rows, "gid bigint, least bigint, uid bigint")).collect():
        got.setdefault(row["gid"], []).append(row["uid"])
    pairs = lambda sets: {(a, b) for m in sets for a in m for b in m if a < b}
    assert pairs(got.values()) == pairs(groups)
    assert sorted(got[1]) == [1, 2, 3, 4] and len(got) == 22  # the set 0 stays in its twenty pairs


def test_tree_leaves_out_no_pair(spark):
    r = np.random.default_rng(2)
    similar = Similarity((75, 100))
    base = [r.integers(0, 1 << 40, 300).astype(np.uint64) for _ in range(20)]
    sets = []
    for b in base:
        for keep in (300, 280, 250):
            sets.append(np.unique(np.concatenate([b[:keep], r.integers(0, 1 << 40, 10).astype(np.uint64)])))
    vectors = np.stack([np.bincount((s % np.uint64(64)).astype(int), minlength=64) for s in sets]).astype(np.uint16)
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(sizes, vectors)
    for i, s in enumerate(sets):
        hits = set(tree.search(int(sizes[i]), vectors[i], similar)[0].tolist())
        for j, t in enumerate(sets):
            overlap = len(np.intersect1d(s, t))
            if similar.links(overlap, len(s) + len(t)):
                assert j in hits


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (7, 7)] + [(40, k) for k in range(41, 60)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {5: 3, 9: 3, 21: 20, 22: 20, 23: 20, 24: 20} | {k: 40 for k in range(41, 60)}


def test_empty(spark):
    assert classes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(spark, [(1, None), (2, ""), (3, "x")]) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_rows_without_an_id_link(spark):
    """A near copy without an id, two of them, and two documents that only such a row links."""
    base = words(60, 80)
    text = lambda k: " ".join(base[2 * k : 2 * k + 40])
    docs = [(1, text(0)), (None, text(2)), (2, text(4)), (None, text(15)), (None, text(16)), (None, text(16)), (3, "a b c")]
    assert found(spark, docs[:1] + docs[2:3]) == [(1, 36, 1), (2, 36, 2)]
    expected = brute(docs)
    assert (2, 36, 1) in expected and (None, 36, 1) in expected and (None, 36, None) in expected
    assert found(spark, docs) == expected


def test_components_without_needless_rounds(spark, monkeypatch):
    """Stars are components already; each round of a longer one is a job for the driver."""
    from logweir.llm import common
    from logweir.session import written_table

    tables = []
    monkeypatch.setattr(common, "written_table", lambda df, label: tables.append(label) or written_table(df, label))
    stars = [(1, 5), (7, 1), (1, 9), (2, 4), (4, 2), (3, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {(5, 1), (7, 1), (9, 1), (4, 2)} and len(tables) == 1
    path = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70), (70, 65)]
    got = {tuple(r) for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(60, 50), (65, 50), (70, 50)}


def test_later_rounds_link_on_from_earlier_ones(spark, monkeypatch):
    """Rounds add their links to the components so far, and those without links cost none."""
    given = []
    monkeypatch.setattr(jaccard, "components", lambda edges: given.append(edges.count()) or components(edges))
    docs = [(d, t) for d, t, *_ in documents()]
    out = classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted({(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()}) == sorted(set(brute(docs)))
    assert len(given) == 1 and given[0]  # links of the first round; the others find none
