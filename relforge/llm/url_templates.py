"""Operator 5: URL filters by a path-template tree.

Rules decide the URLs that they fit.  The others make a tree for each host, of
DEPTH levels: a path's segments, those beyond the last level with it.  Segments
that vary by their looks (numbers, hexadecimal names, long tokens) are wildcards
from the start.  From the deepest level up, the branches under one parent whose
share of bad labels doesn't differ significantly from that of their siblings
become one wildcard branch, and so do their subtrees.  A template's purity is
its share of bad labels, smoothed towards its parent's, up to the host's and
that of all hosts; templates that are purely enough bad are rejected, whatever
the single URL looks like.

Labels are given for pages, or made: a URL is labelled bad if it has a listed
word, and good else.  URLs that a rule decides are no labels, since a rule says
nothing about what it doesn't fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Written

# Fixed values: (host, path, verdict) of the rules, and words in URLs of a bad kind.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BAD_WORDS = ("casino", "pills", "bets")
#: Smoothing mass, the largest standardised difference of branches that are merged, and the purity that rejects a template.
MASS, SIGNIFICANT, PURE = 4.0, 1.96, 0.75
#: Levels of a host's tree.
DEPTH = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Wildcards of a segment, by the first pattern that fits it whole; patterns are read alike by Spark and DuckDB.
SEGMENTS = (("^[0-9]+$", "{n}"), ("^[0-9]+[.][a-z]+$", "{n}.{x}"), ("^[0-9a-f]{8,}$", "{h}"), ("^.{20,}$", "{s}"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _segment(x: Column) -> Column:
    out = x
    for pattern, wild in reversed(SEGMENTS):
        out = F.when(x.rlike(pattern), F.lit(wild)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, bad_words: Sequence[str] = BAD_WORDS, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and is_bad_word of every row of `pages` (page_id, url).

    `labels` (page_id, bad 0 or 1), if given, labels the pages that it has (an
    id on several rows is bad if any row is); without it every page is labelled
    by its URL's words.  A null url, or one without ://, has empty host and path;
    it has the template of its host '' and path '' and is judged like any other.
    A very long url is taken whole.  Repeated rows count as often as they come;
    other columns are not read; no row gives none.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    has_word = F.lit(False)
    for word in bad_words:
        has_word = has_word | F.contains(F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER), F.lit(word))
    split = urls.select("page_id", host.alias("host"), path.alias("path"), has_word.alias("is_bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.transform(F.filter(F.split(F.translate("path", UPPER, LOWER), "/"), lambda x: x != ""), _segment)
    segments = [f"s{k}" for k in range(1, DEPTH + 1)]
    rows = split.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("parts", parts).withColumns(
        {s: F.coalesce(F.get("parts", F.lit(k)), F.lit("")) for k, s in enumerate(segments[:-1])}
        | {segments[-1]: F.array_join(F.slice("parts", DEPTH, F.greatest(F.size("parts"), F.lit(1))), "/")}
    ).drop("parts")
    if labels is None:
        rows = rows.withColumn("label", F.col("is_bad").cast("int"))
    else:
        known = labels.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("label_of")).agg(F.max(F.col("bad").cast("int")).alias("label"))
        rows = rows.join(known, F.col("page_id") == F.col("label_of"), "left").drop("label_of")
    label = F.when(F.col("ruled").isNull(), F.col("label"))
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    leaves = Written(rows.groupBy("host", *segments).agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("b")))
    everything = leaves.df.agg(F.sum("n"), F.sum("b")).first()
    base = ((everything[1] or 0) + 1) / ((everything[0] or 0) + 2)
    mean = lambda b, n, prior: (b + prior * MASS) / (n + MASS)
    variance = lambda m, n: m * (1 - m) / (n + MASS + 1)

    for k in range(DEPTH, 0, -1):  # from the deepest branches up
        above = ["host", *segments[: k - 1]]
        child = leaves.df.groupBy(*above, f"s{k}").agg(*sums)
        parent = child.groupBy(*above).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count("*").alias("kids"))
        pool = mean(F.col("all_b"), F.col("all_n"), F.lit(base))
        own, others = mean(F.col("b"), F.col("n"), pool), mean(F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n"), pool)
        apart = F.abs(own - others) / F.sqrt(variance(own, F.col("n")) + variance(others, F.col("all_n") - F.col("n")))
        alike = (F.col("kids") > 1) & (F.col(f"s{k}") != "") & (apart <= SIGNIFICANT)
        branch = child.join(parent, above).select(*above, f"s{k}", F.when(alike, F.lit("*")).otherwise(F.col(f"s{k}")).alias(f"t{k}"))
        leaves = Written(leaves.df.join(branch, [*above, f"s{k}"]))

    templates = [f"t{k}" for k in range(1, DEPTH + 1)]
    of = leaves.df.groupBy("host", *templates).agg(*sums)
    judged = of.select("host", *templates)
    purity = F.lit(base)
    for k in range(DEPTH + 1):
        here = ["host", *templates[:k]]
        judged = judged.join(of.groupBy(*here).agg(F.sum("n").alias(f"n{k}"), F.sum("b").alias(f"b{k}")), here)
        purity = mean(F.col(f"b{k}"), F.col(f"n{k}"), purity)
    judged = judged.select("host", *templates, purity.alias("purity"))
    place = Written(leaves.df.select("host", *segments, *templates).join(judged, ["host", *templates])).df
    out = rows.join(place, ["host", *segments])
    tree = F.concat("host", F.lit("/"), F.array_join(F.filter(F.array(*templates), lambda x: x != ""), "/"))
    method = F.when(F.col("purity") >= PURE, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), tree.alias("template"),
        F.round("purity", 6).alias("purity"), F.col("is_bad").alias("is_bad_word"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for `filter_urls` with labels by words."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest) + " END"
    segment = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{w}'" for p, w in SEGMENTS) + " ELSE x END"
    bad = " OR ".join(f"contains(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '{w}')" for w in BAD_WORDS)
    mean = lambda b, n, prior: f"(({b}) + ({prior}) * {MASS}) / (({n}) + {MASS})"
    variance = lambda m, n: f"({m}) * (1 - ({m})) / (({n}) + {MASS} + 1)"
    parts = ", ".join([*(f"coalesce(parts[{k}], '') AS s{k}" for k in range(1, DEPTH)), f"array_to_string(parts[{DEPTH}:], '/') AS s{DEPTH}"])
    s = [f"s{k}" for k in range(1, DEPTH + 1)]
    t = [f"t{k}" for k in range(1, DEPTH + 1)]
    steps = [
        "a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest_of FROM pages)",
        f"u AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest_of, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest_of, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a)",
        f"q AS (SELECT *, {rule} AS rule, {ruled} AS ruled, ({bad}) AS is_bad, list_transform(list_filter(string_split(translate(path, '{UPPER}', '{LOWER}'), '/'), lambda x: x <> ''), lambda x: {segment}) AS parts FROM u)",
        f"rows AS MATERIALIZED (SELECT * EXCLUDE (parts), {parts} FROM q)",
        f"l{DEPTH + 1} AS MATERIALIZED (SELECT host, {', '.join(s)}, count(*) FILTER (ruled IS NULL) AS n, count(*) FILTER (ruled IS NULL AND is_bad) AS b FROM rows GROUP BY ALL)",
        f"g AS MATERIALIZED (SELECT (coalesce(sum(b), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS base FROM l{DEPTH + 1})",
    ]
    for k in range(DEPTH, 0, -1):
        above = ["host", *s[: k - 1]]
        keys = ", ".join(above)
        own, others = mean("b", "n", "pool"), mean("all_b - b", "all_n - n", "pool")
        steps += [
            f"c{k} AS MATERIALIZED (SELECT {keys}, s{k}, sum(n) AS n, sum(b) AS b FROM l{k + 1} GROUP BY ALL)",
            f"p{k} AS (SELECT {keys}, sum(n) AS all_n, sum(b) AS all_b, count(*) AS kids, {mean('sum(b)', 'sum(n)', '(SELECT base FROM g)')} AS pool FROM c{k} GROUP BY ALL)",
            f"m{k} AS (SELECT {keys}, s{k}, CASE WHEN kids > 1 AND s{k} <> '' AND abs({own} - {others}) / sqrt({variance(own, 'n')} + {variance(others, 'all_n - n')}) <= {SIGNIFICANT} THEN '*' ELSE s{k} END AS t{k} FROM c{k} JOIN p{k} USING ({keys}))",
            f"l{k} AS MATERIALIZED (SELECT * FROM l{k + 1} JOIN m{k} USING ({keys}, s{k}))",
        ]
    steps.append(f"j0 AS MATERIALIZED (SELECT host, {', '.join(t)}, {mean('sum(sum(b)) OVER (PARTITION BY host)', 'sum(sum(n)) OVER (PARTITION BY host)', '(SELECT base FROM g)')} AS purity, sum(n) AS n, sum(b) AS b FROM l1 GROUP BY host, {', '.join(t)})")
    for k in range(1, DEPTH + 1):
        by = ", ".join(["host", *t[:k]])
        steps.append(f"j{k} AS MATERIALIZED (SELECT * REPLACE ({mean(f'sum(b) OVER (PARTITION BY {by})', f'sum(n) OVER (PARTITION BY {by})', 'purity')} AS purity) FROM j{k - 1})")
    steps.append(f"place AS MATERIALIZED (SELECT host, {', '.join(s)}, {', '.join(t)}, purity FROM l1 JOIN (SELECT host, {', '.join(t)}, purity FROM j{DEPTH}) USING (host, {', '.join(t)}))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {PURE} THEN 'block' ELSE 'allow' END) AS verdict,
  host || '/' || array_to_string(list_filter([{', '.join(t)}], lambda x: x <> ''), '/') AS template, round(purity, 6) AS purity, is_bad AS is_bad_word
FROM rows JOIN place USING (host, {', '.join(s)})
"""
