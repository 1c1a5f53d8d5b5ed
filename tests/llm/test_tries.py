from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as driver
from logweir.llm import tries
from logweir.llm.queries import rebuilt_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, depth int"


def brute(sequences: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    through, ending = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            through[tuple(turns[:d])].append(c)
        ending[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(through, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(through[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ending[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(through[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in through.items()
    )


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts, key=lambda x: (x[0], x[1] or 0, tries_record(x[2], x[3])))] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def tries_record(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + f"{len(text.encode()):016X}"


def plain(df) -> list[tuple]:
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*columns).collect())


def conversations(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in range(120):
        if c % 15 == 10:
            continue  # a base that is absent
        shared = c % 3 == 0
        for k in range(r.choice([1, 3, 8, 12])):
            text = ["hello", "wörld", "", None, "a longer text"][(k if shared else r.randrange(5)) % 5]
            rows.append((c, k, r.choice(["user", None]) if not shared else "user", text, "p", 1))
    rows += [(200 + k, j, "user", f"same {j}", "p", 1) for k in range(60) for j in range(4)]  # a group of copies
    rows += [(c, j, "user", f"deep {min(j, 30 + c % 7)}", "p", 1) for c in range(300, 312) for j in range(50)]  # long ones
    rows += [(400, None, "b", "null turns", "p", 1), (400, None, "a", "tie", "p", 1), (400, 0, "a", "then", "p", 1), (None, 0, "a", "no id", "p", 1)]
    rows += [(1, 0, "user", "again", "p", 1), (405, 5, None, None, None, None), (-3, 1, "user", "negative", "p", 1)]
    return rows + rows[-1:]


@pytest.mark.parametrize("long,shard,seed", [(4096, 1 << 17, 1), (10, 40, 2), (3, 17, 3), (1, 5, 4)])
def test_against_brute_force(spark, monkeypatch, long, shard, seed):
    monkeypatch.setattr(tries, "LONG", long)
    monkeypatch.setattr(tries, "SHARD", shard)
    monkeypatch.setattr(tries, "_STRETCH", 4 if long < 4096 else 4096)
    rows = [r if r[0] != -3 else (1003, *r[1:]) for r in conversations(seed)]
    got = plain(tries.prefix_trie(*rebuilt_conversations(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rebuilt(rows))


def test_small_tables(spark):
    assert plain(tries.prefix_trie(*rebuilt_conversations(spark.createDataFrame([], SCHEMA)))) == []
    one = [(11, 0, "user", "x", "p", 1)]  # its base is absent, and its only turn is cut
    assert plain(tries.prefix_trie(*rebuilt_conversations(spark.createDataFrame(one, SCHEMA)))) == brute(rebuilt(one))
    assert plain(tries.prefix_trie(*rebuilt_conversations(spark.createDataFrame([(None, 1, "a", "b", "p", 1)], SCHEMA)))) == []


def test_tree_is_balanced_by_the_middle():
    tree = tries.TernaryTree()
    for k in tries.middle_first(1023):
        tree.insert([k], 1, k)

    def height(node: int) -> int:
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.same[0]) == 10 and sorted(tries.middle_first(9)) == list(range(9))
    assert tree.count[0] == 1023 and len(tree.walk()) == 1024


def test_query_on_all_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(driver.queries()["op13_prefix_trie"](spark, sf)) == brute(rebuilt(rows))
