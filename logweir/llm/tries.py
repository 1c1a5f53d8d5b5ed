"""Prefix trie of conversations: ternary search trees per shard, merged at their edges.

A turn's record is a 128-bit digest of its role and text and its text's bytes. Equal
sequences are counted once (with their members), sorted, and cut into range shards of at
most ``SHARD`` turns. A shard encodes its records as numbers in sorted order and builds a
ternary search tree, inserting the middle sequence first so that siblings stay balanced.
An iterative walk counts members, leaves and savings from the bottom up.

Only prefixes of a shard's first or last sequence can go on in another shard. Such edge
nodes are told with the sums of the closed subtrees below them, grouped over shards by a
sum of per-turn hashes, and their own sums follow from running sums along the edge paths:
each merged node belongs to one of the paths through it, and a node's total is what its
paths own at its depth or below. Sequences of more than ``LONG`` turns go into the shards
with their first ``LONG`` turns, marked as an edge; their other turns are edge nodes made
by Spark, so that no conversation, however long, is held by one task. The members that end
at a node are hashed as a stream of sorted ids.

Turns are ordered by turn, null first; equal turns by their records. Null roles and texts
are empty. Rows without a conversation id take no part. A conversation of the member list
without turns ends at the root. Repeated rows are turns of their own. No members, no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table
from .common import ranked_within

SHARD = 1 << 17
LONG = 4_096
#: Characters of a turn's record: 32 of the digest and 16 of the number of bytes.
RECORD = 48
#: Consecutive places that are numbered or summed together.
_STRETCH = 4_096
_PART_CHARS = 4 << 20


def ordered_turns(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, idx (from 0), rec of each turn."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))
    rows = table.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.concat(digest, F.lpad(F.hex(F.octet_length(text_).cast("bigint")), 16, "0")).alias("rec"),
    )
    part = F.coalesce(F.floor(F.col("turn") / _STRETCH).cast("bigint"), F.lit(-(1 << 62)))
    ranked = ranked_within(rows.withColumn("__part", part), ["conv_id"], "__part", [F.asc_nulls_first("turn"), "rec"], rank="idx")
    return ranked.select("conv_id", "idx", "rec")


# ------------------------------------------------------------------------------- a shard


def step_hash(place: int, record: str) -> tuple[int, int]:
    told = hashlib.md5(f"{place}/{record}".encode()).hexdigest()
    return int(told[:15], 16), int(told[15:30], 16)


def _node_key(depth: Column, one: Column, two: Column) -> Column:
    return F.concat_ws("/", depth.cast("string"), one.cast("string"), two.cast("string"))


class TernaryTree:
    """Nodes are numbers; node 0 is the root of the trie, and has no code."""

    def __init__(self) -> None:
        self.code, self.low, self.same, self.high = [-1], [-1], [-1], [-1]
        self.count, self.least, self.ends = [0], [None], [None]

    def insert(self, codes: list[int], count: int, least: int) -> int:
        """Add a sequence; returns the node at which it ends."""
        code, low, same, high = self.code, self.low, self.same, self.high
        at = 0
        self._member(0, count, least)
        for c in codes:
            child, above, links = same[at], at, same
            while child >= 0 and code[child] != c:
                links = low if c < code[child] else high
                above, child = child, links[child]
            if child < 0:
                child = links[above] = len(code)
                code.append(c)
                for column in (low, same, high):
                    column.append(-1)
                self.count.append(0)
                self.least.append(None)
                self.ends.append(None)
            at = child
            self._member(at, count, least)
        return at

    def _member(self, node: int, count: int, least: int) -> None:
        self.count[node] += count
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent node, depth), parents first."""
        order, stack = [(0, -1, 0)], [(self.same[0], 0, 1)]
        while stack:
            node, parent, depth = stack.pop()
            if node < 0:
                continue
            order.append((node, parent, depth))
            stack += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.same[node], node, depth + 1)]
        return order


def middle_first(n: int) -> Iterator[int]:
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(middle + 1, b), (a, middle)]


_COLUMNS = [
    ("kind", pa.string()), ("shard", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("path", pa.string()), ("depth", pa.int64()),
    ("least", pa.int64()), ("parent_least", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string()),
]
_DDL = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in _COLUMNS)


def shard_nodes(rows: list[tuple[str, str, int, int, bool, str | None]]) -> list[tuple]:
    """What a shard tells of its sorted sequences (id, records, members, smallest member,
    goes on, digest of the ends): closed nodes, edge nodes and the rows of edge paths."""
    shard = rows[0][0]
    split = [[seq[i : i + RECORD] for i in range(0, len(seq), RECORD)] for _, seq, *_ in rows]
    records = sorted(set().union(*split))
    code_of = {r: k for k, r in enumerate(records)}
    tree = TernaryTree()
    ended: dict[int, str] = {}
    for k in middle_first(len(rows)):
        _, _, count, least, goes_on, ends = rows[k]
        node = tree.insert([code_of[r] for r in split[k]], count, least)
        if not goes_on:
            ended[node] = ends
    order = tree.walk()
    child = {(parent, tree.code[node]): node for node, parent, _ in order[1:]}
    out: list[tuple] = []
    keys: dict[int, str] = {0: "0/0/0"}

    def path_of(k: int) -> list[int]:
        nodes, one, two = [0], 0, 0
        for place, r in enumerate(split[k]):
            x, y = step_hash(place, r)
            one, two = one + x, two + y
            nodes.append(child[nodes[-1], code_of[r]])
            keys[nodes[-1]] = f"{place + 1}/{one}/{two}"
        return nodes

    for k in {0, len(rows) - 1}:
        for depth, node in enumerate(path_of(k)):
            out.append(("path", shard, keys[node], None, f"{shard}/{k}", depth, *[None] * 8))
    for k, row in enumerate(rows):
        if row[4]:
            path_of(k)
    children, leaves, saved = [0] * len(tree.code), [0] * len(tree.code), [0] * len(tree.code)
    for node, parent, depth in reversed(order):
        bytes_ = int(records[tree.code[node]][32:], 16) if depth else 0
        above = keys.get(parent)
        if node in keys:
            out.append(("edge", shard, keys[node], above, None, depth, tree.least[node], None, tree.count[node], children[node], leaves[node], saved[node], bytes_, ended.get(node)))
            continue
        leaves[node] = leaves[node] or 1
        saved[node] += (tree.count[node] - 1) * bytes_
        parent_least = tree.least[parent] if above is None else None
        out.append(("node", shard, None, above, None, depth, tree.least[node], parent_least, tree.count[node], children[node], leaves[node], saved[node], None, ended.get(node)))
        children[parent] += 1
        leaves[parent] += leaves[node]
        saved[parent] += saved[node]
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, turns = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        nodes = shard_nodes(held)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part), _COLUMNS)], names=[n for n, _ in _COLUMNS])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq_id", "seq", "members", "least", "goes_on", "ends"))):
            size = 1 + len(row[1]) // RECORD
            if held and turns + size > most:
                yield from told()
                held, turns = [], 0
            held.append(row)
            turns += size
    if held:
        yield from told()


# ------------------------------------------------------------------------------- members


def member_digests(members: DataFrame, key: str = "end") -> DataFrame:
    """``key`` and ends: SHA-256 of each group's sorted ids, joined by commas, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, ends = [], []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is not None and k == now:
                    digest.update(b",%d" % c)
                    continue
                if digest is not None:
                    keys.append(now)
                    ends.append(digest.hexdigest())
                now, digest = k, hashlib.sha256(b"%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], names=[key, "ends"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=[key, "ends"])

    return members.select(key, "conv_id").repartition(key).sortWithinPartitions(key, "conv_id").mapInArrow(run, f"{key} string, ends string")


def _running(rows: DataFrame, group: str, place: Column, sums: list[str], down: bool) -> DataFrame:
    """Sums of the columns from each row's place on (``down``) or up to it, in its group;
    long groups are cut into stretches."""
    rows = rows.withColumn("__place", place).withColumn("__part", F.floor(F.col("__place") / _STRETCH))
    order = F.desc if down else F.asc
    parts = rows.groupBy(group, "__part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(group).orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy(group, "__part").orderBy(order("__place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("*", *[F.sum(c).over(inside).alias(f"__own_{c}") for c in sums])
    kept = [c for c in rows.columns if c not in (*sums, "__part", "__place")]
    return own.join(parts, [group, "__part"]).select(*kept, *[(F.col(f"__own_{c}") + F.col(f"__{c}")).alias(c) for c in sums])


# -------------------------------------------------------------------------------- the trie


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node. ``turns``: conv_id, idx (from 0, without gaps), rec;
    ``members``: conv_id, once each, also of conversations without turns."""
    most, shard = LONG, SHARD
    turns = written_table(turns.select("conv_id", "idx", "rec"), "trie-turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.where(F.col("idx") < most).groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("idx", "rec"))).getField("rec"), "").alias("seq")  # ``most`` turns
    )
    whole = members.join(lengths, "conv_id", "left").join(heads, "conv_id", "left").select(
        "conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seq", F.lit("")).alias("seq")
    )
    whole = written_table(whole.withColumn("goes_on", F.col("n") > most).withColumn("seq_id", F.concat(F.md5("seq"), F.when(F.col("goes_on"), "+").otherwise(""))), "trie-sequences")
    distinct = whole.groupBy("seq_id").agg(
        F.first("seq").alias("seq"), F.count("*").alias("members"), F.min("conv_id").alias("least"), F.first("goes_on").alias("goes_on")
    )

    # turns of long conversations: the keys of all their nodes
    long_turns = turns.join(whole.where("goes_on").select("conv_id", "n"), "conv_id")
    hashed = F.md5(F.concat(F.col("idx").cast("string"), F.lit("/"), F.col("rec")))
    number = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(28,0)")
    steps = long_turns.select("conv_id", "n", "idx", F.conv(F.substring("rec", 33, 16), 16, 10).cast("bigint").alias("bytes"), number(1).alias("one"), number(16).alias("two"))
    summed = _running(steps, "conv_id", F.col("idx"), ["one", "two"], down=False)
    tails = written_table(
        summed.select("conv_id", "n", (F.col("idx") + 1).alias("depth"), "bytes", "one", "two").withColumn("key", _node_key(F.col("depth"), F.col("one"), F.col("two"))), "trie-long"
    )
    back = Window.partitionBy("conv_id", F.floor(F.col("depth") / _STRETCH)).orderBy("depth")
    shifted = tails.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("first_parent")).where(F.col("depth") % _STRETCH == 0)
    linked = tails.withColumn("parent_key", F.lag("key").over(back)).join(shifted, ["conv_id", "depth"], "left")
    linked = linked.withColumn("parent_key", F.coalesce("parent_key", "first_parent"))

    ends = member_digests(whole.where("not goes_on").select(F.col("seq_id").alias("end"), "conv_id").unionByName(tails.where("depth = n").select(F.col("key").alias("end"), "conv_id")))
    ends = written_table(ends, "trie-ends")
    sequences = written_table(distinct.join(ends.withColumnRenamed("end", "seq_id"), "seq_id", "left"), "trie-distinct")
    parts = 1 + (sequences.agg(F.sum(F.length("seq"))).first()[0] or 0) // _PART_CHARS
    ranged = sequences.withColumn("__start", F.substring("seq", 1, 64 * RECORD)).repartitionByRange(parts, "__start").sortWithinPartitions("seq", "goes_on").drop("__start")
    told = written_table(ranged.mapInArrow(lambda batches: _shards(batches, shard), _DDL), "trie-shards")

    # edge nodes, merged over shards
    edges = told.where("kind = 'edge'").select("key", "parent_key", "depth", "least", "n_convs", "n_children", "n_leaves", "saved", "bytes", "ends")
    zero = F.lit(0).cast("bigint")
    deep = linked.where(F.col("depth") > most).join(ends.withColumnRenamed("end", "key").withColumnRenamed("ends", "e"), "key", "left").select(
        "key", "parent_key", "depth", F.col("conv_id").alias("least"), F.lit(1).cast("bigint").alias("n_convs"), zero.alias("n_children"),
        zero.alias("n_leaves"), zero.alias("saved"), "bytes", F.col("e").alias("ends"),
    )
    merged = edges.unionByName(deep).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("bytes").alias("bytes"), F.max("ends").alias("ends"),
    )
    merged = written_table(merged, "trie-edges")
    joined = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    valued = merged.join(joined, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", zero)).drop("more")
    valued = valued.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"))
    valued = written_table(valued.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")), "trie-values")

    # totals along the edge paths
    long_name = F.concat(F.lit("long/"), F.col("conv_id").cast("string"))
    roots = whole.where("goes_on").select(long_name.alias("path"), zero.alias("depth"), F.lit("0/0/0").alias("key"))
    paths = told.where("kind = 'path'").select("path", "depth", "key").unionByName(tails.select(long_name.alias("path"), "depth", "key")).unionByName(roots)
    paths = written_table(paths, "trie-paths")
    owner = paths.groupBy("key").agg(F.min("path").alias("owner"))
    values = valued.join(owner, "key").select("key", F.col("owner").alias("path"), "n_leaves", "saved")
    owned = paths.join(values, ["key", "path"], "left").select(
        "key", "path", "depth", F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved", zero).alias("saved")
    )
    totals = _running(owned, "path", F.col("depth"), ["n_leaves", "saved"], down=True).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_least"))
    open_nodes = valued.drop("n_leaves", "saved").join(totals, "key").join(parents, "parent_key", "left")

    # closed nodes whose parent is an edge node take its smallest member from the merged one
    closed = told.where("kind = 'node'")
    above = told.where("kind = 'edge'").select("shard", F.col("key").alias("parent_key")).join(parents, "parent_key").withColumnRenamed("parent_least", "above_least")
    below = closed.where("parent_key is not null").join(above, ["shard", "parent_key"]).withColumn("parent_least", F.col("above_least"))
    columns = [
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ]
    return closed.where("parent_key is null").select(*columns).unionByName(below.select(*columns)).unionByName(open_nodes.select(*columns))
