"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontaminate, langid, mixing, mpeg_audio, quality, secrets, toxicity, url_templates
from .ngram_jaccard import ngram_jaccard_join
from .runtime import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count, component and number of links at Jaccard 0.85 over 4-word shingles."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an MPEG audio stream, read back: digests of payload and stream, and what parsing found."""
    return mpeg_audio.media_features(table(spark, sf_dir, "documents"))


def op3_rake_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, raked weight and probability, and whether it is drawn."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"),
        F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"),
    )


def op4_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by nearest centroids learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, with its path template and that template's purity."""
    return url_templates.filter_urls(table(spark, sf_dir, "pages"))


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document by a classifier learned from labels of those not held out."""
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    return quality.classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under context mixing and, as a base, under word counts."""
    return context_mixing.score_texts(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)


def op9_benchmark_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds, whole or edited."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "seeds")


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a lexicon learned from labels of those not held out."""
    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    return toxicity.score_toxicity(docs, lexicon).select("doc_id", held.alias("held_out"), "score", "predicted", "n_matches")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_rake_sources": op3_rake_sources,
    "op4_nearest_centroid": op4_nearest_centroid,
    "op5_url_templates": op5_url_templates,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_quality_ftrl": op7_quality_ftrl,
    "op8_context_mixing": op8_context_mixing,
    "op9_benchmark_seeds": op9_benchmark_seeds,
    "op10_toxicity_lexicon": op10_toxicity_lexicon,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of a text, A-Z folded.
SQL_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op1_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, y.b FROM r JOIN both_ways y ON y.a = r.c)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = n.doc_id) AS component_id,
  (SELECT count(*) FROM both_ways y WHERE y.a = n.doc_id) AS n_links FROM n
""",
    "op3_rake_sources": mixing.oracle_sql(),
    "op5_url_templates": url_templates.oracle_sql(),
    "op6_linked_secrets": secrets.oracle_sql(),
}
