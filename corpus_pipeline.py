"""The corpus pipeline: stages that each write their documents and hand them on.

Toxic documents go, one document of each group of near copies stays, word sequences that
occur again are cut out, sources are mixed to their target weights, and the mixture is
packed into sequences. All but the last stage return the columns of ``documents``.

Null texts are empty documents: never toxic, linked with nothing, without words to mix,
so they end with the mixing. Rows without an id stay through the near-copy stage, as no
id names them; rows that repeat an id count there by their own texts. An empty table
gives no rows at every stage; columns beyond ``documents`` are not handed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import jaccard, mixing, packing, substrings
from logweir.llm.queries import toxicity_verdicts
from logweir.session import written_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity_verdicts(docs.select(*COLUMNS), spark, sf_dir).where("not toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of several texts
    with that id in the group, one."""
    docs = docs.select(*COLUMNS)
    linked = jaccard.keyed_classes(docs).where("class is not null and doc_id is not null")
    stay = linked.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("least.doc_id", "least.key")
    named = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    rows = docs.where(named).withColumn("key", jaccard.row_key())
    first = rows.join(stay.hint("merge"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).drop("key")
    return first.unionByName(docs.where(~named)).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word sequences that occur elsewhere too."""
    kept = substrings.without_repeats(docs, keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each whole pass over a document and one for a part."""
    return mixing.Mixture(docs.select(*COLUMNS), keep_text=True).documents().select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture with their places in the sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Toxicity is a trained model, so SQL cannot express the rows; tests compare each stage
#: with a brute-force version on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
