"""Links of HTML pages, and which of them are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col_of, url_key

# parts of a page that hold no links
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# attributes of an anchor tag; quoted values may hold ">"
ANCHOR = r"""(?is)<a[\s/]((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>"""
# one attribute with its value; a quoted value is taken whole
ATTRIBUTE = r"""(?is)[^\s=>"'/]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = r"""(?is)^href\s*=\s*["']?(.*?)["']?$"""
ARCHIVE = r"\.zip"
# named characters that occur in addresses; the ampersand goes last
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def href_of(attributes: Column | str) -> Column:
    """First non-empty href among the attributes of a tag, else null."""
    found = F.regexp_extract_all(col_of(attributes), F.lit(ATTRIBUTE), F.lit(0))
    values = F.transform(
        F.filter(found, lambda a: a.rlike(r"(?i)^href\s*=")), lambda a: F.regexp_extract(a, HREF, 1)
    )
    return _decoded(F.get(F.filter(values, lambda v: v != ""), F.lit(0)))


def page_links(
    pages: DataFrame, html: str = "html", pattern: str = ARCHIVE, keep: list[str] = ()
) -> DataFrame:
    """One row per anchor whose address matches ``pattern`` anywhere:
    the kept page columns, position on the page, link, link_key."""
    visible = F.regexp_replace(html, HIDDEN, " ")
    tags = F.posexplode(F.regexp_extract_all(visible, F.lit(ANCHOR), F.lit(1)))
    return (
        pages.select(*keep, tags.alias("pos", "__attributes"))
        .withColumn("link", href_of("__attributes"))
        .where(F.col("link").rlike(pattern))
        .select(*keep, "pos", "link", url_key("link").alias("link_key"))
    )


def first_seen_links(links: DataFrame, order: list[str]) -> DataFrame:
    """Each link once, with its first arrival: link_key, link, arrival."""
    if len(order) == 1:
        first = links.groupBy("link").agg(F.min(order[0]).alias(order[0]))
    else:
        first = links.groupBy("link").agg(F.min(F.struct(*order)).alias("__f")).select("link", "__f.*")
    return first.select(url_key("link").alias("link_key"), "link", *order)
