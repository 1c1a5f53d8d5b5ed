"""Device records: 22 delimited columns to an 8-field document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The columns of the source file, in file order, and the document
# field each used column becomes.
COLUMNS = [
    "KNUMBER", "APPLICANT", "CONTACT", "STREET1", "STREET2", "CITY", "STATE", "COUNTRY_CODE",
    "ZIP", "POSTAL_CODE", "DATERECEIVED", "DECISIONDATE", "DECISION", "REVIEWADVISECOMM",
    "PRODUCTCODE", "STATEORSUMM", "CLASSADVISECOMM", "SSPINDICATOR", "TYPE", "THIRDPARTY",
    "EXPEDITEDREVIEW", "DEVICENAME",
]
FIELDS = {
    "id": "KNUMBER",
    "company": "APPLICANT",
    "person": "CONTACT",
    "device_index_date": "DATERECEIVED",
    "status_date": "DECISIONDATE",
    "status": "DECISION",
    "product": "DEVICENAME",
}
DOCUMENT = [
    "id", "company", "person", "index_date", "device_index_date", "status_date", "status", "product",
]


def split_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Delimited lines to ``fields``; quotes may hold the delimiter. Null marks a
    row with the wrong number of columns."""
    schema = ", ".join(f"`{c}` string" for c in [*COLUMNS, "__bad"])
    row = F.from_csv(
        F.col(line), schema, {"sep": "|", "columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}
    )
    kept = [c for c in lines.columns if c != line]
    # a missing value reads as null and an empty one was written as nothing: both are ""
    fields = F.array(*[F.coalesce(F.col("__row")[c], F.lit("")) for c in COLUMNS])
    # one row each: filters on the fields stay above it, else they parse the line for every column
    return lines.select(*kept, F.explode(F.array(row)).alias("__row")).select(
        *kept, F.when(F.col("__row")["__bad"].isNull(), fields).alias("fields")
    )


def record_stats(records: DataFrame, fields: str = "fields") -> DataFrame:
    """One row: records read, and those a document cannot be made of."""
    bad = F.coalesce(F.size(fields) != len(COLUMNS), F.lit(True))
    return records.agg(F.count("*").alias("records"), F.count_if(bad).alias("bad_records"))


def device_documents(
    records: DataFrame, index_date: Column | None = None, fields: str = "fields", keep: list[str] = ()
) -> DataFrame:
    """The document of every record with all its columns; ``index_date`` in ms."""
    now = F.unix_millis(F.current_timestamp()) if index_date is None else index_date
    values = {n: F.col(fields)[COLUMNS.index(c)] for n, c in FIELDS.items()} | {"index_date": now}
    return records.where(F.size(fields) == len(COLUMNS)).select(
        *keep, *[values[n].alias(n) for n in DOCUMENT]
    )


def as_json(documents: DataFrame, key: str = "id") -> DataFrame:
    """Message rows: the id as key, the document as JSON value."""
    body = F.to_json(F.struct(*DOCUMENT), {"ignoreNullFields": "false"})
    return documents.select(F.col(key).alias("key"), body.alias("value"))
