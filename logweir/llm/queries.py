"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written_table
from . import bpe, extraction, fingerprints, jaccard, licenses, mixing, negatives, neighbours, packing, substrings, toxicity, tries, urls
from .common import table
from .registry import query

# ---------------------------------------------------------------- 4: mixing of sources

_OP4_SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no
  from sized group by source
), weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][((no - 1) % 3 + 1)::int] as w from src
), levels as (
  select *, 2.0::double * source_size as cap,
    (1.5::double * sum(source_size) over () - coalesce(2.0::double * sum(source_size) over (
        order by source_size / w, no rows between unbounded preceding and 1 preceding), 0.0))
    / sum(w) over (order by source_size / w, no rows between current row and unbounded following) as level
  from weighed
), targets as (
  select source, no, source_size, least(cap, (select l.level from levels l where l.level * l.w <= l.cap
      order by l.source_size / l.w, l.no limit 1) * w) as target
  from levels
), blocks as (
  select s.doc_id, s.source, s.size, t.no, t.source_size, t.target, b.block,
    least(256, s.size - 256 * b.block)::bigint as words, md5('7/' || s.doc_id || '/' || b.block) as key
  from sized s join targets t on s.source is not distinct from t.source,
    lateral (select unnest(range(0, (s.size + 255) // 256)) as block) b
), ranked as (
  select *, coalesce(sum(words) over (partition by no order by key, size rows between unbounded preceding and 1 preceding), 0) as before,
    row_number() over (partition by no order by key, size) - 1 as rank, round(target)::bigint // source_size as passes,
    round(target)::bigint % source_size as over_passes
  from blocks
), placed as (
  select *, greatest(0, least(words, over_passes - before))::bigint as part from ranked
), quotas as (
  select no, count(*) as n_blocks, sum(passes + (part > 0)::bigint)::bigint as quota from placed group by no
), whole as (
  select list(no order by no) as nos, list(quota order by no) as held, sum(quota)::bigint as total,
    greatest(1, (sum(quota)::bigint + 4095) // 4096) as shards from quotas
), tree as (
  select 0::bigint as lo, shards as hi, held, []::bigint[] as lefts, nos, total, shards from whole
  union all
  select case when not split then lo when side = 0 then lo else mid end, case when not split then hi when side = 0 then mid else hi end,
    case when not split then held when side = 0 then lefts else list_transform(list_zip(held, lefts), lambda x: x[1] - x[2]) end,
    case when split then []::bigint[] else list_append(lefts, low + case when q = 0 then 0 else
      len(list_filter(range(1, len(p) + 1), lambda i: list_sum(p[1:i]) < u * list_sum(p))) end) end, nos, total, shards
  from (
    select *, list_transform(lp, lambda x: exp(x - list_max(lp))) as p
    from (
      select *, list_transform(range(low, greatest(low, high) + 1), lambda k:
        -lgamma(k + 1) - lgamma(q - k + 1) - lgamma(d - k + 1) - lgamma(n - q - d + k + 1)) as lp
      from (
        select *, case when split or q = 0 then 0 else greatest(0, d + q - n, floor(mean - width)::bigint) end as low,
          case when split or q = 0 then -1 else least(q, d, ceil(mean + width)::bigint) end as high
        from (
          select *, d * (q / n) as mean, 12 * sqrt(d * (q / n) * (1 - q / n) * greatest(n - d, 0) / greatest(n - 1, 1)) + 2 as width
          from (
            select *, (lo + hi) // 2 as mid, len(lefts) = len(held) as split, held[len(lefts) + 1] as q, greatest(1, list_sum(held[len(lefts) + 1:]))::bigint as n,
              (((lo + hi) // 2 * total) // shards - (lo * total) // shards - coalesce(list_sum(lefts), 0))::bigint as d,
              (('0x' || substr(md5('7/' || lo || '/' || hi || '/' || nos[len(lefts) + 1]), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u
            from tree where hi - lo > 1
          )
        )
      )
    )
  ), (values (0), (1)) sides(side)
  where split or side = 0
), leaves as (
  select lo as shard, unnest(nos) as no, unnest(held) as n from tree where hi - lo = 1
), dealt as (
  select *, coalesce(sum(n) over (partition by no order by shard rows between unbounded preceding and 1 preceding), 0) as first from leaves
), drawn as (
  select p.doc_id, p.no, case when d.pass < p.passes then p.words else p.part end as words, d.pass * q.n_blocks + p.rank as draw
  from placed p join quotas q using (no), lateral (select unnest(range(0, p.passes + (p.part > 0)::bigint)) as pass) d
), landed as (
  select w.*, l.shard, row_number() over (partition by l.shard order by md5('7/' || l.shard || '/' || w.no || '/' || w.draw), w.no, w.draw) - 1 as place
  from drawn w join dealt l on l.no = w.no and w.draw >= l.first and w.draw < l.first + l.n
), taken as (
  select doc_id, sum(words)::bigint as taken, count(*) as n_draws, string_agg(shard || ':' || place, ',' order by shard, place) as places
  from landed group by doc_id
)
select s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::bigint as taken, coalesce(k.n_draws, 0)::bigint as n_draws,
  sha256(coalesce(k.places, '')) as places_sha256
from sized s join targets t on s.source is not distinct from t.source left join taken k on k.doc_id = s.doc_id
"""


@query("op4_mixing", _OP4_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the number of draws and a digest of where the shards hold them."""
    return mixing_report(mixing.Mixture(table(spark, sf_dir, "documents")))


def mixing_report(mixture: mixing.Mixture) -> DataFrame:
    places = F.transform("places", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["place"].cast("string")))
    return mixture.taken().select(
        "doc_id", "size", "source_size", "target", "taken", F.size("places").cast("bigint").alias("n_draws"),
        F.sha2(F.array_join(places, ","), 256).alias("places_sha256"),
    )


# ------------------------------------------------------------------ 3: best-fit packing


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------ 1: URL filter

RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]
#: Pages are listed whose host joins words by a hyphen, as names bought for their search
#: words do. Parts that start with xn-- are coded names, not joined words.
CODED_PART = r"(^|\.)xn--[^.]*"
JOINED_WORDS = "[^.:-]-[^.:-]"

_OP1_SQL = r"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest,
    case when instr(url, '://') > 0 then lower(substr(url, 1, instr(url, '://') - 1)) else '' end as scheme from pages
), parts as (
  select page_id, scheme,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from split
), named as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host,
        case scheme when 'http' then ':(80)?$' when 'https' then ':(443)?$' else ':$' end, ''), '\.$', '')
      || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '') end as canon
  from parts
), listed as (
  select distinct canon from named where regexp_matches(regexp_replace(host, '(^|\.)xn--[^.]*', '', 'g'), '[^.:-]-[^.:-]')
), judged as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from named
)
select page_id, host, path, rule, j.canon in (select canon from listed) and rule is null and j.canon is not null as listed,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when j.canon in (select canon from listed) then 'block' else 'allow' end as verdict
from judged j
"""


@query("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: addresses of pages on hosts whose names join words."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    parts = F.regexp_replace(urls.host_of(F.col("url")), CODED_PART, "")
    listed = pages.where(parts.rlike(JOINED_WORDS)).select("url")
    return urls.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


# --------------------------------------------------------------- 9: document fingerprints


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------- 10: HTML extraction


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select("page_id", "url", "text", "n_chars")


# --------------------------------------------------------------------- 8: substring dedup


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


# ------------------------------------------------------------------ 7: n-gram Jaccard join


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


# --------------------------------------------------------- 6: approximate nearest neighbours


@query("op6_neighbours")
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# ----------------------------------------------------------------------- 2: license scans


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------- 5: toxicity

def toxicity_categories() -> dict[str, Column]:
    """The chain's order. ``labels`` has one toxicity label and one of quality: low quality
    comes first, as symbols and junk are labelled unlike prose, then toxicity in any text,
    then in texts of low quality."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}


def toxicity_verdicts(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on ``docs`` by a chain trained on the labelled documents of the tables."""
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity_categories())
    return toxicity.judged(docs, chain, ["toxic"])


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_verdicts(docs, spark, sf_dir).select("doc_id", "p_low_quality", "p_toxic", "p_toxic_low_quality", "toxic")


# -------------------------------------------------------------- 11: hard-negative mining

_OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id))::int as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""


@query("op11_hard_negatives", _OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels moved on by one, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


# --------------------------------------------------------- 12: BPE encoding and decoding


@query("op12_bpe_codec")
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.word_vocabulary()
    coded = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return bpe.decoded(coded, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


# ------------------------------------------------------------ 13: conversation prefix trie

_OP13_SQL = """
with recursive convs as (
  select distinct conv_id from conversations where conv_id is not null
), crc as (
  select conv_id, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: case when x >= 0 then xor(s, x) else xor(s >> 1, 3988292384::bigint * (s & 1)) end) as s
  from convs
), planned as (
  select conv_id, conv_id - conv_id % 5 as base, xor(s, 4294967295::bigint) % 9 as h from crc
), turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as idx
  from conversations where conv_id is not null
), rebuilt as (
  select p.conv_id, 0 as part, t.idx, t.role, t.text from planned p join turns t on t.conv_id = p.base and t.idx < p.h
  union all select p.conv_id, 1, t.idx, t.role, t.text from planned p join turns t on t.conv_id = p.conv_id and t.idx >= p.h
), placed as (
  select conv_id, row_number() over (partition by conv_id order by part, idx) as depth, strlen(text) as bytes,
    md5(length(role) || ':' || role || text) as turn from rebuilt
), paths as (
  select conv_id, depth, bytes, string_agg(turn, '') over (partition by conv_id order by depth) as path from placed
  union all select conv_id, 0, 0, '' from convs
), sized as (
  select *, depth = max(depth) over (partition by conv_id) as ends from paths
), nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from sized group by depth, path
), linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and left(c.path, length(n.path)) = n.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, length(p.path))
), sums as (
  select a.depth, a.path, sum((u.n_children = 0)::bigint) as n_leaves, sum((u.n_convs - 1) * u.bytes) as saved_tokens
  from linked u join paths a on a.conv_id = u.conv_id and a.depth <= u.depth group by a.depth, a.path
)
select conv_id, n.depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from linked n join sums s on s.depth = n.depth and s.path = n.path
"""


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and members of the conversations as the contract rebuilds them: the first
    turns of the one whose id is divisible by five, then the own ones."""
    turns = written_table(tries.ordered_turns(conversations), "ordered-turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), first.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = turns.where(F.col("idx") < 9).select(F.col("conv_id").alias("base"), "idx", "rec")
    given = heads.join(plan, "base").where(F.col("idx") < F.col("h")).select("conv_id", "idx", "rec")
    rest = turns.join(plan, "conv_id").where(F.col("idx") >= F.col("h")).select("conv_id", (F.col("idx") - F.col("h") + F.col("taken")).alias("idx"), "rec")
    return given.unionByName(rest), lengths.select("conv_id")


@query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))
