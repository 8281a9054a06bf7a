"""Training records as JSON lines, read against their schema, with the lines that are none kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["sku", "qty", "exp", "mfg", "batch", "pallet", "box"]
SCHEMA = "document_id string, field string, image string, ocr_text string, label string, verified boolean"
CORRUPT = "_line"


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of the JSON lines below ``path``, and the rejects: line and reason (not_json, no_document,
    unknown_field, not_verified or no_label). Of a record all of document, a known field, its label and the mark that it is
    verified are needed; other keys are ignored, blank lines skipped. One pass without a shuffle over files that may be
    split anywhere; both results read the files again."""
    read = spark.read.schema(f"{SCHEMA}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "not_json")
        .when(blank("document_id"), "no_document")
        .when(~F.coalesce(F.col("field").isin(FIELDS), F.lit(False)), "unknown_field")
        .when(~F.coalesce("verified", F.lit(False)), "not_verified")
        .when(F.col("label").isNull(), "no_label")
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    told = read.withColumn("reason", reason)
    line = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*names)))
    return told.where("reason is null").select(*names), told.where("reason is not null").select(line.alias("line"), "reason")
