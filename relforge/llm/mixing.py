"""Operator 3: mixing sources to target weights by iterative proportional fitting.

The tokens of each cell (source, language, topic) are raked, one dimension
after the other, until the totals of each dimension meet its targets.  A
document's weight is its cell's raked share over its share as it came.
Documents are then drawn with probabilities in proportion to their weights, at
most 1, scaled so that the expected tokens are the wanted fraction of all.

Only DataFrame functions are used.  Raking works on the cell table; documents
are read twice and meet it by broadcast only if it is small.  Stated targets that
cannot be met are refused.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .runtime import Written

ROUNDS, SCALINGS = 10, 6
#: Raking stops once every total is as near as this to its target.
TOLERANCE = 1e-10
#: Rows up to which the cell table, or a dimension's totals, are sent to all tasks; larger ones are joined by key.
BROADCAST_CELLS = 20_000
DIMENSIONS = ("source", "lang", "topic")
#: A dimension's targets are its shares to this power, scaled to 1, for values without a stated target.
TEMPERS = {"source": 0.7, "lang": 0.5, "topic": 0.8}
FRACTION = 0.5

# Topics by the first condition that holds, as text that Spark and DuckDB read alike.
TOPICS = (
    ("table", "contains(text, ' | ')"),
    ("shout", "contains(text, '!!')"),
    ("noise", "contains(text, '$$$')"),
    ("short", "tokens < 100"),
    ("long", "tokens >= 1000"),
)
OTHER_TOPIC = "prose"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def described(documents: DataFrame, topics: Sequence[tuple[str, str]] = TOPICS) -> DataFrame:
    """`documents` with mix_tokens, mix_source, mix_lang and mix_topic; null sources and languages are ''."""
    first = documents.withColumn("mix_tokens", token_count(F.col("text")))
    topic = F.lit(None).cast("string")
    for name, condition in reversed(topics):
        topic = F.when(_condition(condition), F.lit(name)).otherwise(F.lit(OTHER_TOPIC) if topic is None else topic)
    topic = F.coalesce(topic, F.lit(OTHER_TOPIC))
    return first.withColumns({
        "mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "mix_topic": topic,
    })


def _condition(text: str) -> Column:
    return F.expr(re.sub(r"\btokens\b", "mix_tokens", re.sub(r"\btext\b", "coalesce(text, '')", text)))


def checked(name: str, stated: Mapping[str, float], shares: DataFrame) -> float:
    """What the stated targets of dimension `name` leave for its other values; ValueError if they can't be met.

    Targets are shares of all: none below 0 and at most 1 in sum, exactly 1
    (within 1e-9) if no value is left for the rest.  A value without tokens
    can't get a share, so stating one for it is an error.
    """
    rest = 1.0 - sum(stated.values())
    if any(not 0 <= x <= 1 for x in stated.values()) or rest < -1e-9:
        raise ValueError(f"the targets of {name} are no shares of 1: {dict(stated)}")
    there = {r[0] for r in shares.where(F.col(f"mix_{name}").isin(list(stated)) & (F.col("share") > 0)).select(f"mix_{name}").collect()} if stated else set()
    if absent := sorted(v for v, x in stated.items() if x > 0 and v not in there):
        raise ValueError(f"no document with tokens has these values of {name}: {absent}")
    if stated and rest > 1e-9 and shares.where((F.col("share") > 0) & ~F.col(f"mix_{name}").isin(list(stated))).isEmpty():
        raise ValueError(f"the targets of {name} leave {rest} for other values, and there are none")
    return max(0.0, rest)


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], tempers: Mapping[str, float], rounds: int) -> tuple[DataFrame, float]:
    """(`cells` (mix_source, mix_lang, mix_topic, base) with raked, which sums up to 1, and ratio; the residual).

    Stated targets are shares of all; a dimension's other values divide what is
    left of 1 by their tempered shares.  Cells without tokens get 0.  A round
    adds up each dimension's values in turn and joins the few totals back, so no
    value's cells ever meet in one task.  It stops after `rounds`, or as soon as
    no total was further than TOLERANCE from its target; the residual is the
    largest distance of the last round (0 without tokens).
    """
    if unknown := set(targets) - set(DIMENSIONS):
        raise ValueError(f"there are no dimensions {sorted(unknown)} to mix by")
    total = float(cells.agg(F.sum("base")).first()[0] or 0)
    out, meet = cells.withColumn("raked", F.col("base") / F.lit(total or 1.0)), {}
    for name in DIMENSIONS if total else ():
        at, stated = f"mix_{name}", dict(targets.get(name, {}))
        shares = cells.groupBy(at).agg((F.sum("base") / F.lit(total)).alias("share"))
        rest = checked(name, stated, shares)
        free = F.pow("share", F.lit(float(tempers.get(name, 1.0))))
        others = ~F.col(at).isin(list(stated)) if stated else F.lit(True)
        norm, values = shares.agg(F.coalesce(F.sum(F.when(others, free)), F.lit(1.0)), F.count("*")).first()
        meet[name] = F.broadcast if values <= BROADCAST_CELLS else (lambda few: few)
        target = free * F.lit(rest / (norm or 1.0))  # 0 if the other values have no tokens: nothing is left for them either
        for value, wanted in stated.items():
            target = F.when(F.col(at) == F.lit(value), F.lit(float(wanted))).otherwise(target)
        out = out.join(meet[name](shares.select(at, target.alias(f"want_{name}"))), at)
    residual = 0.0
    for _ in range(rounds if total else 0):
        gaps = []
        for name in DIMENSIONS:
            now = out.groupBy(f"mix_{name}").agg(F.sum("raked").alias("now"))
            met = F.when(F.col("now") > 0, F.col("raked") * F.col(f"want_{name}") / F.col("now")).otherwise(F.lit(0.0))
            out = out.join(meet[name](now), f"mix_{name}").withColumns({"raked": met, f"gap_{name}": F.abs(F.col("now") - F.col(f"want_{name}"))}).drop("now")
            gaps.append(F.max(f"gap_{name}"))
        seen = Observation()
        out = Written(out.observe(seen, F.greatest(*gaps).alias("residual"))).df
        residual = float(seen.get["residual"])
        if residual <= TOLERANCE:
            break
    ratio = F.when(F.col("base") > 0, F.col("raked") / (F.col("base") / F.lit(total or 1.0))).otherwise(F.lit(0.0))
    return out.select(*cells.columns, "raked", ratio.alias("ratio")), residual


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    text = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    documents: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    tempers: Mapping[str, float] = TEMPERS,
    fraction: float = FRACTION,
    rounds: int = ROUNDS,
    seed: str = "mix",
    topics: Sequence[tuple[str, str]] = TOPICS,
) -> DataFrame:
    """`documents` (doc_id, text, source, lang and any others) with mix_tokens, the three dimensions, mix_weight, mix_probability and mix_kept.

    `targets` states shares for values of source, lang and topic; ones that
    can't be met raise ValueError (see `checked`).  A topic is the name of the
    first condition in `topics` (SQL over the document's columns and `tokens`)
    that holds, else OTHER_TOPIC; the standard ones tell forms of text apart, a
    corpus with topics of its own states e.g. ("law", "topic = 'law'").

    A null text has no tokens; a very long one is counted whole; null and empty sources and languages are one
    value each.  A document without tokens has weight 0 and is kept only if all
    others are (fraction 1 or more).  Rows that repeat an id share its draw; a
    null id draws as the empty text does.  An empty table stays empty.  Columns
    that begin with mix_ are the operator's own and replace those of that name.
    """
    rows = described(documents, topics)
    cells = Written(rows.groupBy(*(f"mix_{d}" for d in DIMENSIONS)).agg(F.sum("mix_tokens").alias("base")))
    raked, residual = rake(cells.df, targets or {}, tempers, rounds)
    raked = Written(raked.withColumn("residual", F.lit(residual))).df
    scale = scaling(raked, fraction)
    few = raked.count() <= BROADCAST_CELLS
    own = raked.select(*(F.col(f"mix_{d}").alias(f"mix_cell_{d}") for d in DIMENSIONS), F.col("ratio").alias("mix_weight"))
    meet = [F.col(f"mix_{d}") == F.col(f"mix_cell_{d}") for d in DIMENSIONS]
    names = [c for c in rows.columns if c not in ("mix_weight", "mix_probability", "mix_kept")]
    out = rows.select(*names).join(F.broadcast(own) if few else own, meet, "left").drop(*(f"mix_cell_{d}" for d in DIMENSIONS))
    probability = F.lit(1.0) if fraction >= 1 else F.least(F.lit(1.0), F.col("mix_weight") * F.lit(scale))
    return out.withColumn("mix_probability", probability).withColumn("mix_kept", draw(F.col("doc_id"), seed) < F.col("mix_probability"))


def scaling(raked: DataFrame, fraction: float) -> float:
    """The factor of the weights at which the expected tokens are `fraction` of all, by SCALINGS corrections."""
    scale = float(fraction)
    for _ in range(SCALINGS):
        got = raked.agg(F.try_divide(F.sum(F.col("base") * F.least(F.lit(1.0), F.col("ratio") * F.lit(scale))), F.sum("base")).alias("got")).first().got
        if not got:
            break
        scale = scale * fraction / got
    return scale


def oracle_sql(documents: str = "documents", tempers: Mapping[str, float] = TEMPERS, fraction: float = FRACTION, rounds: int = ROUNDS, seed: str = "mix", select: str | None = None) -> str:
    """DuckDB SQL for `mix` with tempered targets alone."""
    topic = "CASE " + " ".join(f"WHEN {c.replace('text', 't')} THEN '{n}'" for n, c in TOPICS) + f" ELSE '{OTHER_TOPIC}' END"
    steps = [
        f"w AS (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM {documents})",
        f"d AS (SELECT *, coalesce(source, '') AS mix_source, coalesce(lang, '') AS mix_lang, {topic} AS mix_topic FROM w)",
        "c AS (SELECT mix_source, mix_lang, mix_topic, sum(tokens)::DOUBLE AS base FROM d GROUP BY ALL)",
        "t AS (SELECT greatest(sum(base), 1) AS total FROM c)",
    ]
    for name in DIMENSIONS:
        steps.append(f"s_{name} AS (SELECT mix_{name}, pow(sum(base) / (SELECT total FROM t), {tempers[name]}) AS free FROM c GROUP BY ALL)")
        steps.append(f"w_{name} AS (SELECT mix_{name}, free / (SELECT sum(free) FROM s_{name}) AS want FROM s_{name})")
    steps.append("r0 AS MATERIALIZED (SELECT *, base / (SELECT total FROM t) AS raked FROM c)")
    k = 0
    for _ in range(rounds):
        for name in DIMENSIONS:
            now = f"sum(raked) OVER (PARTITION BY mix_{name})"
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN raked * (SELECT want FROM w_{name} w WHERE w.mix_{name} = r{k}.mix_{name}) / {now} ELSE 0 END AS raked) FROM r{k})")
            k += 1
    steps.append(f"ratio AS MATERIALIZED (SELECT *, CASE WHEN base > 0 THEN raked / (base / (SELECT total FROM t)) ELSE 0 END AS ratio FROM r{k})")
    steps.append(f"f0 AS (SELECT {fraction}::DOUBLE AS f)")
    for i in range(SCALINGS):
        steps.append(f"f{i + 1} AS MATERIALIZED (SELECT f * {fraction} / (SELECT sum(base * least(1, ratio * f)) / sum(base) FROM ratio) AS f FROM f{i})")
    u = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0"
    steps.append(
        f"m AS (SELECT d.*, ratio AS mix_weight, least(1, ratio * (SELECT f FROM f{SCALINGS})) AS p, {u} AS u FROM d JOIN ratio USING (mix_source, mix_lang, mix_topic))"
    )
    columns = select or "doc_id, mix_source AS source, mix_lang AS lang, mix_topic AS topic, tokens, round(mix_weight, 6) AS weight, round(p, 6) AS probability, u < p AS kept FROM m"
    return "WITH " + ",\n".join(steps) + f"\nSELECT {columns}"
