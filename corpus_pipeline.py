"""The corpus pipeline: five operators, one after the other, over the whole of `documents`.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of `documents` alone, whatever others there are; every stage reads all
rows that its predecessor kept, whole texts, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.llm import decontaminate, langid, mixing, secrets
from relforge.llm.ngram_jaccard import ngram_jaccard_join
from relforge.llm.queries import table
from relforge.llm.runtime import Written

#: Up to so many ids (8 bytes each) are sent to all tasks.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, which becomes their lang; those that are rejected go.

    Null, empty and letterless texts are rejected, and all texts if none is
    labelled.  The text alone decides, so rows that repeat one stay or go together;
    a null doc_id or source stays as it is.
    """
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.train(docs.select("doc_id", "text", "lang")))
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at Jaccard 0.8 over five-word shingles: that with the least doc_id.

    Rows without a doc_id stay; rows that share one stay or go together, and go
    only if none of them comes first in its group.  The ids that go are sent to
    all tasks if they are few, else joined by key.
    """
    docs = docs.select(*COLUMNS)
    groups = ngram_jaccard_join(docs, width=5, num=80, den=100).where("doc_id is not null")
    later = Written(groups.groupBy(F.col("doc_id").alias("gone")).agg(F.min(F.col("doc_id") != F.col("component_id")).alias("later")).where("later").select("gone")).df
    few = later.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(later) if few else later, F.col("doc_id") == F.col("gone"), "left_anti")


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`, whole or edited.

    Null, empty and wordless texts hold none and are held by none; rows that
    repeat a text stay or go together; without items all stay.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows the text.

    Null and empty texts have none; a text without one keeps its n_chars, be it
    null or wrong.  Rows that repeat a text are changed alike.
    """
    found = secrets.scan(docs.select(*COLUMNS))
    text = secrets.redacted("text", "secret_all")
    changed = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("secret_all") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn for the mix, with their weight and probability.

    Null and empty sources and languages are one value each; a text without
    tokens has weight 0 and goes; rows that repeat a doc_id share its draw, a
    null one draws as the empty text does.
    """
    out = mixing.mix(docs.select(*COLUMNS)).where("mix_kept")
    return out.select(*COLUMNS, F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"))


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", remove_test_items),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first and third stage have no equivalent in SQL.
ORACLE_SQL = None
