"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of words. A source that must give ``goal`` of its
``size`` words gives all its blocks ``goal div size`` times, and in one more pass the
first blocks of a random permutation, the last of them cut, so that the words add up to
the goal. Each block so taken is a draw. How many draws of each source go to each output
shard is decided first, on counts alone: starting from all shards with all quotas, a node
is halved, and the left half's part of each source is drawn from the multivariate
hypergeometric distribution, until nodes are single shards. Each shard then draws its own
stretch of each source's permuted blocks, so shards are disjoint, and shuffles it locally.
``taken`` and ``shuffled`` say where each draw lands: its shard and its place there.

Everything is DataFrame functions. Permutations and draws come from hashes of the seed,
so reruns agree. Nulls: a null text has no words, a null source is a source of its own
(the last), a null id is an id. Repeated rows are rows of their own; of rows equal in id
and size it does not matter which is drawn. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table
from .common import WORD, digits_for, ranked_within

BLOCK_WORDS = 256
SHARD_DRAWS = 4096
ROW = "__row"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float], epochs: float, most: float) -> DataFrame:
    """source, source_no, source_size, target: sources by code point, null last, weighted
    in turn, share ``epochs`` times all words; none gets above ``most`` times its own,
    and what is over is shared again by weight.

    The level at which the rest are filled is found by ordering sources by size over
    weight. One row per source: the only place where all of a table meets in one window.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    no = F.row_number().over(by_name)
    each = each.select("source", "source_size", no.alias("source_no"), table[(no - 1) % len(weights)].alias("w"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "source_no")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    over_all = Window.partitionBy()
    cap = F.lit(float(most)) * F.col("source_size")
    left = F.lit(float(epochs)) * F.sum("source_size").over(over_all) - F.coalesce(
        F.lit(float(most)) * F.sum("source_size").over(upto), F.lit(0.0)
    )
    leveled = each.select("*", (left / F.sum("w").over(rest)).alias("level"), cap.alias("cap"))
    free = F.col("level") * F.col("w") <= F.col("cap")
    leveled = leveled.withColumn("free", free)
    first = Window.orderBy(F.col("source_size") / F.col("w"), "source_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    at = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(first)
    target = F.when(at.isNull(), F.col("cap")).otherwise(F.least("cap", at * F.col("w")))
    return leveled.select("source", "source_no", "source_size", target.alias("target"))


# ------------------------------------------------------------------- the splitting tree


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash that other engines have too."""
    digits = F.substring(_hash(*parts), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(q: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among ``q``: the exact distribution
    inverted at ``u``. Its terms, each from the one before by their ratio, run over 12
    standard deviations to either side of the mean; the first pass sums them up, the
    second stops where the sum passes ``u`` of it."""

    def bounds(x: Column) -> Column:
        share = x["q"] / F.greatest(x["n"], F.lit(1.0))
        mean = x["d"] * share
        width = 12 * F.sqrt(mean * (1 - share) * F.greatest(x["n"] - x["d"], F.lit(0.0)) / F.greatest(x["n"] - 1, F.lit(1.0))) + 2
        low = F.greatest(F.lit(0.0), x["d"] + x["q"] - x["n"], F.floor(mean - width).cast("double"))
        high = F.least(x["q"], x["d"], F.ceil(mean + width).cast("double"))
        return F.struct(x["q"], x["n"], x["d"], x["u"], low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    def inverted(x: Column) -> Column:
        ks = F.when(x["high"] > x["low"], F.sequence(x["low"] + 1, F.greatest(x["high"], x["low"] + 1))).otherwise(F.array().cast("array<bigint>"))

        def term(p: Column, k: Column) -> Column:
            return p * (x["q"] - k + 1) * (x["d"] - k + 1) / (k * (x["n"] - x["q"] - x["d"] + k))

        whole = F.aggregate(
            ks, F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s")),
            lambda a, k: _let(term(a["p"], k), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s"))),
            lambda a: a["s"] * x["u"],
        )

        def walk(goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s"), x["low"].alias("k"))
            step = lambda a, k: F.when(a["s"] >= goal, a).otherwise(
                _let(term(a["p"], k), lambda p: F.struct(p.alias("p"), (a["s"] + p).alias("s"), k.alias("k")))
            )
            return F.aggregate(ks, start, step, lambda a: a["k"])

        return _let(whole, walk)

    given = F.struct(q.cast("double").alias("q"), total.cast("double").alias("n"), draws.cast("double").alias("d"), u.alias("u"))
    return _let(given, lambda x: _let(bounds(x), inverted))


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source_no, quota to source_no, shard, first, n: each source's draws dealt to the
    shards, ``first`` counted within the source. Shards get equal shares of all draws."""
    listed = quotas.agg(F.array_sort(F.collect_list(F.struct("source_no", "quota"))).alias("held"))
    state = "array<struct<source_no:int,quota:bigint>>"
    total = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])
    nodes = listed.select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("held").cast(state).alias("held"), total.alias("all"),
    )

    def limit(k: Column) -> Column:
        return F.floor(k.cast("decimal(20,0)") * F.col("all") / shards).cast("bigint")

    levels = max(0, (shards - 1).bit_length())
    for _ in range(levels):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        here = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, x: a + x["quota"])

        def split(acc: Column, x: Column) -> Column:
            k = F.when(x["quota"] == 0, F.lit(0).cast("bigint")).otherwise(
                hypergeometric(x["quota"], acc["rest"], acc["draws"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["source_no"]))
            )
            return _let(k, lambda k: F.struct(
                (acc["rest"] - x["quota"]).alias("rest"), (acc["draws"] - k).alias("draws"),
                F.array_append(acc["left"], k).alias("left"),
            ))

        start = F.struct(
            here.alias("rest"), (limit(mid) - limit(F.col("lo"))).alias("draws"), F.array().cast("array<bigint>").alias("left"),
        )
        nodes = nodes.select("*", mid.alias("mid"), F.aggregate("held", start, split)["left"].alias("left"))
        kept = F.transform("held", lambda x, i: F.struct(x["source_no"].alias("source_no"), F.get("left", i).alias("quota")))
        others = F.transform("held", lambda x, i: F.struct(x["source_no"].alias("source_no"), (x["quota"] - F.get("left", i)).alias("quota")))
        single = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("held").alias("held")))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), kept.cast(state).alias("held")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), others.cast(state).alias("held")),
        )
        nodes = nodes.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(single)).alias("e"), "all")
        nodes = nodes.select("e.lo", "e.hi", "e.held", "all")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("held").alias("x")).select("shard", "x.source_no", F.col("x.quota").alias("n"))
    upto = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("source_no", "shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), "n").where("n > 0")


# --------------------------------------------------------------------------- the mixture


class Mixture:
    """A planned mixture of ``docs``.

    ``sized``: rows with their words and their source's target. ``draws``: one row per
    block taken, with its row, block, words, pass, shard and place in the shard.
    """

    def __init__(
        self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), epochs: float = 1.5, most: float = 2.0, seed: int = 7,
        text: str = "text", source: str = "source", doc_id: str = "doc_id", keep_text: bool = False,
        block_words: int = BLOCK_WORDS, shard_draws: int = SHARD_DRAWS,
    ) -> None:
        if most < 1 or not 0 <= epochs <= most:
            raise ValueError("a mixture takes from 0 to `most` times all words, and `most` is 1 or more")
        kept = [F.struct(*docs.columns).alias("__doc")] if keep_text else []
        rows = docs.select(
            F.monotonically_increasing_id().alias(ROW), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            word_count(text).alias("size"), *kept,
        )
        self.block_words, self.seed = block_words, seed
        self.stored = written_table(rows, "mixing-rows")
        self.targets = written_table(source_targets(self.stored, weights, epochs, most), "mixing-targets")
        named = self.stored.drop("__doc").join(
            self.targets.select("source", "source_no", "source_size", "target"),
            self.stored["source"].eqNullSafe(self.targets["source"]),
        )
        self.sized = named.select(ROW, "doc_id", self.stored["source"], "size", "source_no", "source_size", "target")
        self.draws = self._draws(shard_draws)

    def _draws(self, shard_draws: int) -> DataFrame:
        size, b = F.col("size"), self.block_words
        blocks = self.sized.where("size > 0").select(
            ROW, "doc_id", "size", "source_no", "source_size", "target",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / b).cast("bigint"))).alias("block"),
        )
        key = F.md5(F.concat_ws("/", F.lit(str(self.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("block").cast("string")))
        blocks = blocks.select("*", F.least(F.lit(b).cast("bigint"), size - b * F.col("block")).alias("words"), key.alias("key"))
        n = self.stored.agg(F.count("*"), F.sum(F.floor((size + b - 1) / b))).first()
        digits = digits_for(int(n[1] or 0))
        goal = F.round("target").cast("bigint")
        passes = F.floor(goal / F.col("source_size")).cast("bigint")
        ranked = ranked_within(
            blocks.withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit("")),
            ["source_no"], "bucket", ["key", "size", ROW], weight="words",
        )
        whole = passes * F.col("source_size")
        part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("words"), goal - whole - F.col("before")))
        placed = written_table(
            ranked.select(ROW, "block", "source_no", "words", "key", "rank", passes.alias("passes"), part.alias("part")), "mixing-blocks"
        )
        quotas = placed.groupBy("source_no").agg(
            F.count("*").alias("blocks"),
            F.sum(F.col("passes") + (F.col("part") > 0).cast("bigint")).alias("quota"),
        )
        quotas = written_table(quotas, "mixing-quotas")
        total = int(quotas.agg(F.sum("quota")).first()[0] or 0)
        self.shards = max(1, -(-total // shard_draws))
        dealt = shard_quotas(quotas, self.shards, self.seed).join(quotas.select("source_no", "blocks"), "source_no")
        drawn = dealt.select(
            "source_no", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw")
        ).select("source_no", "shard", "draw", F.floor(F.col("draw") / F.col("blocks")).cast("bigint").alias("pass"), (F.col("draw") % F.col("blocks")).alias("rank"))
        words = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part"))
        # the draws are exploded from a few rows, so their size is not known beforehand
        joined = drawn.hint("merge").join(placed, ["source_no", "rank"])
        return joined.select(ROW, "block", "source_no", "shard", "draw", "pass", words.alias("words"))

    def taken(self) -> DataFrame:
        """Every row with the words that the mixture takes of it, repeats counted, and
        ``places``: shard and place of each of its draws, in that order."""
        each = self.shuffled().groupBy(ROW).agg(
            F.sum("words").alias("__taken"), F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("__places")
        )
        return self.sized.join(each.hint("merge"), ROW, "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("__taken", F.lit(0).cast("bigint")).alias("taken"),
            F.coalesce("__places", F.array().cast("array<struct<shard:int,place:int>>")).alias("places"),
        )

    def shuffled(self) -> DataFrame:
        """The draws with their place in their shard, an even shuffle of each shard."""
        mixed = _hash(F.lit(self.seed), F.col("shard"), F.col("source_no"), F.col("draw"))
        order = Window.partitionBy("shard").orderBy(mixed, "source_no", "draw")
        return self.draws.withColumn("place", F.row_number().over(order) - 1)

    def documents(self, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
        """The mixed rows with the columns of ``docs`` (needs ``keep_text``): a row for each
        whole pass, and one with the blocks of the last pass, in the text's own order.
        A text that is taken whole is unchanged; parts are words joined by one blank.
        Texts without words are not drawn, so they go."""
        per = self.draws.groupBy(ROW, "pass").agg(
            F.sum("words").alias("n"), F.array_sort(F.collect_list(F.struct("block", "words"))).alias("blocks")
        )
        rows = self.stored.join(per.hint("merge"), ROW)
        words = F.regexp_extract_all(F.col(f"__doc.{text}"), F.lit(WORD), F.lit(0))
        parts = F.flatten(F.transform("blocks", lambda x: F.slice(F.col("__words"), (x["block"] * self.block_words + 1).cast("int"), x["words"].cast("int"))))
        whole = F.col("n") == F.col("size")
        rows = rows.withColumn("__words", F.when(~whole, words))
        made = F.when(whole, F.col(f"__doc.{text}")).otherwise(F.array_join(parts, " "))
        rows = rows.select("__doc.*", made.alias("__text"))
        columns = [c for c in rows.columns if c != "__text"]
        out = {c: F.col(c) for c in columns} | {text: F.col("__text")}
        if n_chars in columns:
            out[n_chars] = F.length("__text").cast("bigint")
        return rows.select(*[v.alias(k) for k, v in out.items()])
