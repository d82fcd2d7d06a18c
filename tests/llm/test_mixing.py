import hashlib

import pytest
from pyspark.sql import functions as F

from relforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, base int, raked string"


def rows():
    out = []
    for k in range(400):
        source, lang = ("web" if k % 3 else "books", "en" if k % 5 else "fr")
        words = 5 + k * 7 % 300
        out.append((k, " ".join(["w"] * words) + (" | x | y" if k % 4 == 0 else ""), source, lang, 1, "x"))
    return [*out, (1000, None, "web", "en", 1, "x"), (1001, "", None, None, 1, "x"), (None, "no id here", "", "fr", 1, "x"), (1002, "w " * 30_000, "web", "en", 1, "x"), (5, "a b", "web", "en", 1, "x")]


def plain(data, targets, tempers, fraction, rounds):
    """The same by plain loops."""
    def topic(text, n):
        return "table" if " | " in text else "shout" if "!!" in text else "noise" if "$$$" in text else "short" if n < 100 else "long" if n >= 1000 else "prose"

    docs = [(i, s or "", g or "", topic(t or "", len((t or "").split())), len((t or "").split())) for i, t, s, g, *_ in data]
    cells: dict = {}
    for _, *cell, n in docs:
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
    total = sum(cells.values())
    want = []
    for d, name in enumerate(mixing.DIMENSIONS):
        share: dict = {}
        for c, n in cells.items():
            share[c[d]] = share.get(c[d], 0) + n / total
        stated = targets.get(name, {})
        free = {v: x ** tempers.get(name, 1.0) for v, x in share.items() if v not in stated}
        want.append({v: stated[v] if v in stated else free[v] * (1 - sum(stated.values())) / sum(free.values()) for v in share})
    raked = {c: n / total for c, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            now: dict = {}
            for c, x in raked.items():
                now[c[d]] = now.get(c[d], 0) + x
            raked = {c: x * want[d][c[d]] / now[c[d]] if now[c[d]] else 0 for c, x in raked.items()}
    ratio = {c: raked[c] / (cells[c] / total) if cells[c] else 0.0 for c in cells}
    scale = fraction
    for _ in range(mixing.SCALINGS):
        scale *= fraction / (sum(n * min(1, ratio[c] * scale) for c, n in cells.items()) / total)
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:8], 16) / 2**32
    return sorted(((i if i is not None else -1, n, round(ratio[tuple(c)], 9), round(min(1, ratio[tuple(c)] * scale), 9), draw(i) < min(1, ratio[tuple(c)] * scale)) for i, *c, n in docs)), want, raked


@pytest.mark.parametrize("targets", [{}, {"lang": {"fr": 0.5}}, {"source": {"books": 0.25, "web": 0.7}, "topic": {"table": 0.3}}])
def test_against_plain_loops(spark, targets):
    data = rows()
    out = mixing.mix(spark.createDataFrame(data, SCHEMA), targets, fraction=0.4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.mix_tokens, round(r.mix_weight, 9), round(r.mix_probability, 9), r.mix_kept) for r in out.collect())
    want, _, _ = plain(data, targets, mixing.TEMPERS, 0.4, mixing.ROUNDS)
    assert got == want


def test_marginals_meet_their_targets(spark):
    data = rows()
    targets = {"lang": {"fr": 0.6, "en": 0.4}}
    out = mixing.mix(spark.createDataFrame(data, SCHEMA), targets, rounds=30)
    total = out.agg(F.sum("mix_tokens")).first()[0]
    got = {r.mix_lang: r.s for r in out.groupBy("mix_lang").agg((F.sum(F.col("mix_tokens") * F.col("mix_weight")) / total).alias("s")).collect()}
    assert got["fr"] == pytest.approx(0.6, abs=1e-3) and got["en"] == pytest.approx(0.4, abs=1e-3)


def test_large_cell_table_is_joined_by_key(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(str, mixing.mix(df).collect())) == want


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None, None, 1, "x"), (2, " ", "a", "b", 1, "x")], SCHEMA)).collect()
    assert [r.mix_kept for r in out] == [False, False]
    assert [r.mix_kept for r in mixing.mix(spark.createDataFrame(rows(), SCHEMA), fraction=1.0).collect()] == [True] * len(rows())


@pytest.mark.parametrize("targets", [{"source": {"web": 0.9, "books": 0.5}}, {"lang": {"xx": 0.1}}, {"lang": {"fr": -0.1}}, {"colour": {"red": 1.0}}, {"source": {"web": 0.2, "books": 0.2, "": 0.2}}])
def test_targets_that_cannot_be_met_are_refused(spark, targets):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows(), SCHEMA), targets)


def test_raking_stops_when_it_has_converged(spark):
    cells = mixing.described(spark.createDataFrame(rows(), SCHEMA)).groupBy(*(f"mix_{d}" for d in mixing.DIMENSIONS)).agg(F.sum("mix_tokens").alias("base"))
    raked, residual = mixing.rake(cells, {"lang": {"fr": 0.6, "en": 0.4}}, mixing.TEMPERS, 200)
    assert residual <= mixing.TOLERANCE
    assert raked.groupBy("mix_lang").agg(F.sum("raked").alias("s")).where("mix_lang = 'fr'").first().s == pytest.approx(0.6, abs=1e-9)
    _, early = mixing.rake(cells, {"lang": {"fr": 0.6, "en": 0.4}}, mixing.TEMPERS, 1)
    assert early > residual


def test_topics_of_the_corpus_itself(spark):
    df = spark.createDataFrame([(1, "a b", "s", "en", "law"), (2, "a b c", "s", "en", "art"), (3, "x", "s", "en", None)], "doc_id long, text string, source string, lang string, subject string")
    out = mixing.mix(df, {"topic": {"law": 0.5}}, topics=[("law", "subject = 'law'"), ("art", "subject = 'art'")])
    assert {r.doc_id: r.mix_topic for r in out.collect()} == {1: "law", 2: "art", 3: mixing.OTHER_TOPIC}


def test_targets_that_take_all_beside_a_value_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b", "s", "en"), (2, "a b", "s", "fr"), (3, "", "s", None)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.mix_weight for r in mixing.mix(df, {"lang": {"en": 0.75, "fr": 0.25}}).collect()}
    assert got == pytest.approx({1: 1.5, 2: 0.5, 3: 0.0})
