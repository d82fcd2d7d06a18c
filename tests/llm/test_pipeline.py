"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest

import corpus_pipeline as p
from relforge.llm import secrets
from relforge.llm.queries import QUERIES

SYLLABLES = {"aa": ["ka", "to", "mi", "re", "su", "lo"], "bb": ["schl", "ung", "eit", "dor", "pf", "ach"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, where = random.Random(11), tmp_path_factory.mktemp("sf")
    docs, items = [], [(k, prose(rng, "aa", 20)) for k in range(4)]
    for k in range(160):
        lang = rng.choice(["aa", "bb"])
        text = prose(rng, lang, rng.randrange(30, 90))
        if k % 10 == 3:  # near copies of the document before
            text = " ".join([*docs[-1][1].split()[:-1], f"other{k}"])
            lang = docs[-1][2]
        if k % 20 == 7:
            text += " " + items[k % 4][1]
        if k % 16 == 5:
            text += f" password=abcdefgh{k:06d} end"
        docs.append((k, text, lang, f"src{min(k % 5, 2)}", len(text)))
    docs += [(500, None, "aa", "src0", 0), (501, "", None, None, 0), (502, "12 34 %", "bb", "src1", 7), (503, "привет как дела сегодня вечером друзья мои хорошие " * 5, None, "src0", 250), (504, docs[9][1], None, "src1", 5), (None, prose(rng, "aa", 40), "aa", "src2", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, items


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def components(rows):
    group = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_stages(spark, corpus):
    where, docs, items = corpus
    table = spark.read.parquet(f"{where}/documents.parquet")
    texts = {i: t for i, t, *_ in docs}

    one = p.identify_language(spark, table, where)
    first = {r.doc_id: r for r in one.collect()}
    assert set(first) == set(texts) - {500, 501, 502, 503} and one.columns == list(p.COLUMNS)
    assert first[504].lang == docs[9][2] and all(first[i].lang == lang for i, _, lang, *_ in docs[:160])

    two = p.drop_near_duplicates(spark, one, where)
    second = {r.doc_id for r in two.collect()}
    rows = [(i, texts[i]) for i in first if i is not None]
    least: dict = {}
    for (i, _), g in zip(rows, components(rows), strict=True):
        least[g] = min(i, least.get(g, i))
    assert second == set(least.values()) | {None} and len(second) < len(first)

    three = p.remove_test_items(spark, two, where)
    third = {r.doc_id for r in three.collect()}
    assert third == {i for i in second if not any(t in texts[i] for _, t in items)} and len(third) < len(second)

    four = p.redact_secrets(spark, three, where)
    fourth = {r.doc_id: r for r in four.collect()}
    assert set(fourth) == third and any("[SECRET]" in r.text for r in fourth.values())
    for r in fourth.values():
        assert "password=" not in r.text and r.text == texts[r.doc_id].replace(texts[r.doc_id][texts[r.doc_id].find("password=") : -4], "[SECRET]") if "password=" in texts[r.doc_id] else r.text == texts[r.doc_id]
        assert "[SECRET]" not in r.text or r.n_chars == len(r.text)

    five = p.mix_sources(spark, four, where)
    fifth = {r.doc_id: r for r in five.collect()}
    assert 0 < len(fifth) < len(fourth) and all(0 < r.probability <= 1 for r in fifth.values())

    assert {r.doc_id for r in p.run(spark, where).collect()} == set(fifth)


def test_stages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_many_ids_are_joined_by_key(spark, corpus, monkeypatch):
    where, *_ = corpus
    table = spark.read.parquet(f"{where}/documents.parquet")
    want = sorted(map(str, p.drop_near_duplicates(spark, table, where).collect()))
    monkeypatch.setattr(p, "BROADCAST_IDS", 0)
    assert sorted(map(str, p.drop_near_duplicates(spark, table, where).collect())) == want


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and len(p.STAGES) == 5
    assert secrets.KINDS[:3] == ("assign", "access", "hex")
