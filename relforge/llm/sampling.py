"""Bounded training samples, the same for any partitioning of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def class_counts(rows: DataFrame, label: str) -> dict[object, int]:
    """Rows by non-null label; as many numbers come to the driver as there are labels."""
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows")).orderBy(label)
    return {r[0]: r[1] for r in sizes.collect()}


def chosen(rows: DataFrame, label: str, key: Column, counts: dict[object, int], per_class: int) -> DataFrame:
    """About per_class rows of each class of `counts`, by a hash of `key`; rows of equal key are taken or left together."""
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_STEPS))
    if not counts:
        return rows.where(F.lit(False))
    bounds = [(value, int(_STEPS * min(1.0, per_class / max(n, 1)))) for value, n in counts.items()]
    table = rows.sparkSession.createDataFrame(bounds, f"sample_class {rows.schema[label].dataType.simpleString()}, sample_bound long")
    drawn = rows.join(F.broadcast(table), F.col(label) == F.col("sample_class"))  # as small as `counts`
    return drawn.where(draw < F.col("sample_bound")).select(*rows.columns)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int) -> tuple[DataFrame, dict[object, int]]:
    """(doc_id, text, label) of a bounded sample of labelled documents, and the sizes of the classes.

    `labels` has doc_id and `label`; `training` is a condition on its doc_id.
    Only ids and labels are drawn at first, about per_class of each class; these
    few are sent to all tasks.  An id that comes on several rows counts once,
    with its largest label and its least text.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & training)
    counts = class_counts(rows, "label")
    few = chosen(rows, "label", F.col("doc_id"), counts, per_class).groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "label"), counts
