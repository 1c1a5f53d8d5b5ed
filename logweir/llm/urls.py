"""URL filters: rules on hosts and paths, and a list of blocked addresses of any size.

Listed addresses are looked up in two steps. A split-block Bloom filter of them (a hash
picks one 256-bit block and one bit in each of its eight words) is small enough to send
to every task: it has at most ``2**MOST_BLOCK_BITS`` blocks, 2 MB, however long the list
is; only the share of false hits grows with the list. Addresses that pass are joined with
the list itself on the canonical address, which removes the false hits. Rules, a short
list of the caller's, come before the list.

Canonical form: host (A-Z lower-cased, without the port that its scheme has anyway, or a
dot at its end) and path; scheme, query, fragment, repeated slashes and one at the end
are left off. A null address, or one without ``://``, has an empty host and path, fits no
rule and is not listed. Repeated rows are judged one by one; ties between equally long
rules go to the first. All columns of the input stay, but for those named like a result;
names that start with two underscores are this module's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table

MOST_BLOCK_BITS = 16
#: Odd multipliers that pick a bit in each word of a block (the public split-block filter).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    scheme = F.lower(F.substring_index(url, "://", 1))
    own_port = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", ""))
    host = F.regexp_replace(own_port.otherwise(F.regexp_replace(host, ":$", "")), r"\.$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/$", "")
    return F.when(host != "", F.concat(host, path))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. A rule is
    ``host/path`` and ``allow`` or ``block``; it fits the host and its subdomains."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


# ------------------------------------------------------------------- the blocked filter


def _block(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _bit(h: Column, word: int) -> Column:
    """The bit that a hash sets in a word: the top five bits of a 32-bit product."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits, so that the product stays a long
    return F.shiftrightunsigned((low * F.lit(SALTS[word])).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")


def blocked_bloom(listed: DataFrame, key: str, bits: int) -> DataFrame:
    """__block and its eight words, for the blocks that are not empty: at most 2**bits rows,
    combined before the shuffle by ``bit_or``."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("bigint")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col("__h"), w))).alias(f"__w{w}") for w in range(8)]
    return listed.select(h.alias("__h")).select("__h", _block(F.col("__h"), bits).alias("__block")).groupBy("__block").agg(*words)


def might_hold(h: Column) -> Column:
    """Whether the words joined to a row have all bits of its hash."""
    tests = [F.getbit(F.col(f"__w{w}"), _bit(h, w)) == 1 for w in range(8)]
    held = tests[0]
    for t in tests[1:]:
        held = held & t
    return F.coalesce(held, F.lit(False))


def block_bits(n: int) -> int:
    """log2 of the blocks for ``n`` addresses at about 16 per block, within the bound."""
    return min(MOST_BLOCK_BITS, max(0, (max(1, n) // 16).bit_length()))


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = (), url: str = "url",
    listed_url: str = "url", bits: int | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict.

    ``listed`` holds blocked addresses in column ``listed_url``. Only pages whose
    address passes the filter, and that no rule has settled, take part in the exact join.
    """
    added = ["host", "path", "rule", "listed", "verdict"]
    keep = [c for c in pages.columns if c not in added]
    target = F.col(listed_url)
    names = written_table(
        listed.select(canonical(target).alias("__canon")).where("__canon is not null").distinct(), "listed-urls"
    )
    bits = block_bits(names.count()) if bits is None else min(bits, MOST_BLOCK_BITS)
    bloom = blocked_bloom(names, "__canon", bits)

    rows = pages.select(*keep, F.col(url).alias("__url")).withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))})
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__said": said, "__canon": canonical(F.col("__url"))})
    rows = rows.withColumn("__h", F.xxhash64("__canon")).withColumn("__block", _block(F.col("__h"), bits))
    # bound: 2**MOST_BLOCK_BITS rows of eight words
    rows = rows.join(F.broadcast(bloom), "__block", "left").withColumn("__maybe", might_hold(F.col("__h")) & F.col("__said").isNull())
    plain = [*keep, "host", "path", "rule"]
    settled = rows.where(~F.col("__maybe")).select(*plain, F.lit(False).alias("listed"), F.coalesce("__said", F.lit("allow")).alias("verdict"))
    sure = names.withColumn("__sure", F.lit(True))
    looked_up = rows.where("__maybe").join(sure, "__canon", "left").select(
        *plain, F.coalesce("__sure", F.lit(False)).alias("listed"), F.when(F.col("__sure"), "block").otherwise("allow").alias("verdict"),
    )
    return settled.unionByName(looked_up)
