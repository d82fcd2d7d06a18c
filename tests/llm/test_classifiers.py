"""Language, quality and toxicity: held-out accuracy and the odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relforge.llm import langid, quality, toxicity
from relforge.llm.kernels import text_buffers
from relforge.llm.runtime import remainder

SYLLABLES = {"aa": ["ka", "to", "mi", "ré", "su"], "bb": ["schl", "ung", "eit", "über", "dor"], "cc": ["zz", "xq", "ción", "pru", "wy"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [(k, prose(rng, lang, rng.randrange(4, 80)), lang) for k in range(240) for lang in [rng.choice(sorted(SYLLABLES))]]


def identified(spark, rows, model):
    df = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    return {r.doc_id: r for r in langid.identify(df, model).collect()}


def test_language_of_held_out_texts(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    model = langid.train(df.where(remainder(F.col("doc_id"), 4) != 2))
    got = identified(spark, corpus, model)
    held = [(got[i].lang_pred, lang) for i, _, lang in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.98
    assert not any(r.rejected for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    assert len(set(model.language)) == 3 and len(model.language) > 3  # several centroids each


def test_language_of_odd_texts(spark, corpus):
    model = langid.train(spark.createDataFrame([*corpus, (900, None, "aa"), (901, "x", None), (902, "", "bb")], "doc_id long, text string, lang string"))
    rows = [(1, None, None), (2, "", None), (3, "123 %$ \n", "aa"), (4, "k", None), (5, "é", None), (6, "привет как дела сегодня вечером друзья мои хорошие", None), (None, "kato", None), (8, "ka to mi " * 20_000, None), (9, "kato mi", "zz"), (9, "kato mi", "aa")]
    got = identified(spark, rows, model)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (1, 2, 3))
    assert all(got[k].lang_pred in SYLLABLES for k in (4, 5, 6, None, 8, 9))
    assert got[6].rejected and not got[8].rejected and got[8].lang_pred == "aa"


def test_language_without_training_rows_or_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty) is None
    assert identified(spark, [(1, "abc", "x")], None)[1].lang_pred == "und"
    assert langid.identify(empty, None).count() == 0


def test_trigram_counts_are_those_of_a_plain_loop():
    texts = ["Ab cÉ!x", "", "  a", "ab", "über 12 uns"]
    data, offsets = text_buffers(__import__("pyarrow").array(texts))
    got = langid.trigram_counts(data, offsets)
    for k, text in enumerate(texts):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text} ".encode()).lower().replace(b"\xc3\x89", b"\xc3\xa9")
        want = np.zeros(1 << langid.BITS, dtype=int)
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            if b != 32:
                want[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> (32 - langid.BITS)] += 1
        assert (got[k] == want).all()


def quality_corpus():
    rng, docs, labels = random.Random(4), [], []
    for k in range(400):
        words = [prose(rng, "aa", 1) for _ in range(rng.randrange(5, 60))]
        bad = k % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 8 else [f"{w}$$$" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    return docs, labels


def test_quality_of_held_out_texts(spark):
    docs, labels = quality_corpus()
    odd = [(1000, None), (1001, ""), (None, "kato mi"), (1002, "w " * 50_000), (3, docs[3][1])]
    d = spark.createDataFrame([(*r, 0.1) for r in docs + odd], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (1000, None), (3, 1), (77777, 0)], "doc_id long, quality int")
    model = quality.train(d, lab, "quality", remainder(F.col("doc_id"), 3) != 1)
    got = quality.classify(d, model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [by[i].predicted == y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean(held) > 0.97
    assert by[1000].score == by[1001].score
    again = quality.classify(d, quality.train(d.repartition(7), lab, "quality", remainder(F.col("doc_id"), 3) != 1)).collect()
    assert {r.doc_id: r.predicted for r in again} == {r.doc_id: r.predicted for r in got}


def test_ftrl_is_a_plain_loop_over_its_formula():
    rng, learner, z, n = np.random.default_rng(1), quality.Ftrl(8), np.zeros(8), np.zeros(8)
    for _ in range(50):
        at, x, y = rng.choice(8, 3, replace=False), rng.random(3), float(rng.integers(2))
        w = [0 if abs(z[k]) <= quality.L1 else -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2) for k in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for k, wk, xk in zip(at, w, x, strict=True):
            g = (p - y) * xk
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * wk
            n[k] += g * g
        learner.learn(at, x, y)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


def test_quality_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(d, quality.train(d, none, "quality", F.lit(True))).first().score == pytest.approx(0.5)
    assert quality.classify(d.limit(0), quality.train(d, none, "quality", F.lit(True))).count() == 0


def toxic_corpus():
    rng, docs, labels = random.Random(6), [], []
    for k in range(500):
        words = [prose(rng, "aa", 1) for _ in range(rng.randrange(20, 90))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "smurdling", "vexal" + rng.choice(["a", "on", "ira"])]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_texts(spark):
    docs, labels = toxic_corpus()
    odd = [(1000, None), (1001, ""), (None, "grobnik"), (1002, "kato " * 40_000 + "grobnik"), (1003, "gr0bn1k smurdl1ng vexаlon kato"), (1004, "kato mi"), (1004, "kato mi")]
    d = spark.createDataFrame([(*r, "x") for r in docs + odd], "doc_id long, text string, entry string")
    lab = spark.createDataFrame([*labels, (None, 1), (1000, None), (5, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(d, lab, "toxic", remainder(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lexicon).collect()}
    held = [got[i].predicted == y for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean(held) > 0.98
    assert got[1003].predicted == 1 and got[1004].predicted == got[1000].predicted == got[1001].predicted == 0 and got[1000].score == got[1001].score
    assert toxicity.score_toxicity(d.limit(0), lexicon).count() == 0


def brute_matches(text, lexicon):
    out = {}
    for reading in toxicity.readings(text):
        for start in range(len(reading)):
            if start and reading[start - 1].isalpha():
                continue
            for table, whole in ((lexicon.words, True), (lexicon.stems, False)):
                for entry, weight in table.items():
                    end = start + len(entry)
                    if reading[start:end] == entry and not (whole and reading[end : end + 1].isalpha()) and weight > out.get(start, (0, 0))[1]:
                        out[start] = (end, weight)
    shut = [(i, i + len(x)) for r in toxicity.readings(text) for x in lexicon.exceptions for i in range(len(r)) if r.startswith(x, i) and not (i and r[i - 1].isalpha()) and not r[i + len(x) : i + len(x) + 1].isalpha()]
    return sorted((s, e, w) for s, (e, w) in out.items() if not any(a <= s and e <= b for a, b in shut))


def test_matching_is_that_of_a_plain_loop():
    lexicon = toxicity.Lexicon({"trash": 1.0, "clown": 0.8, "clownish": 0.9}, {"idio": 0.7, "clo": 0.2}, ("trash can", "clown fish"))
    automaton = lexicon.automaton()
    rng = random.Random(8)
    parts = ["trash", "trash can", "cans", "clown", "clownish", "fish", "idiot", "1d10t", "ТRАSН", "trаsh", "İx", "cl0wn!", " ", "  ", ".", "x", "$", "é", "clown fish"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))
        assert toxicity.matches(text, automaton) == brute_matches(text, lexicon), text
    assert toxicity.matches("The 1d10t has a trash can.", automaton) == [(4, 8, 0.7)]


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    lexicon = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"), "toxic", F.lit(True))
    assert {r.doc_id: r.n_matches for r in toxicity.score_toxicity(d, lexicon).collect()} == {1: 1, 2: 0}


def test_substitutes_at_any_side_of_a_letter():
    automaton = toxicity.Lexicon(dict.fromkeys(toxicity.SEEDS, 1.0)).automaton()
    for text in ("idio7", "worthle55", "worthle$$", '"5cum"', "c1own", "1oser", "!oser", "(1diot)", "ｓｃｕｍ", "ＳＣＵＭ", "𝐬𝐜𝐮𝐦", "５cum"):
        assert len(toxicity.matches(text, automaton)) == 1, text
    for text in ("trash can!", "5 10 $", "scu 1", "3rd"):
        assert toxicity.matches(text, automaton) == [], text


def test_quality_with_labels_of_one_class(spark):
    d = spark.createDataFrame([(k, f"a b c{k}") for k in range(9)], "doc_id long, text string")
    for value, least, most in ((0, 0.0, 0.2), (1, 0.8, 1.0)):
        labels = spark.createDataFrame([(k, value) for k in range(9)], "doc_id long, quality int")
        rows = quality.classify(d, quality.train(d, labels, "quality", F.lit(True))).collect()
        assert all(least <= r.score <= most and r.predicted == value for r in rows)


def test_language_names_in_any_case_and_many_languages(spark, corpus):
    model = langid.train(spark.createDataFrame(corpus, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "ka to mi", "x", 0.1)], "doc_id long, Text string, LANG_PRED string, Score double")
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "Text", "lang_pred", "score", "rejected"] and got.select("lang_pred").first()[0] == "aa"
    rng = random.Random(1)
    alphabets = {f"l{k:03}": [f"{chr(0x4E00 + 3 * k + j)}{chr(0x5200 + 3 * k + j)}" for j in range(3)] for k in range(300)}
    rows = [(1000 * k + j, " ".join(rng.choice(alphabets[name]) for _ in range(12)), name) for k, name in enumerate(alphabets) for j in range(3)]
    many = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(many.language)) == 300


def test_toxicity_scores_are_those_of_plain_loops(spark):
    docs, labels = toxic_corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(d, lab, "toxic", F.lit(True))
    for r in toxicity.score_toxicity(d, lexicon).collect()[::25]:
        text = dict(docs)[r.doc_id]
        found = brute_matches(text, lexicon)
        raw = sum(w for *_, w in found) / (max(toxicity.LEAST_WORDS, len(text.split(" "))) / toxicity.LEAST_WORDS) ** toxicity.LENGTH_POWER
        assert r.n_matches == len(found) and r.score == pytest.approx(1 / (1 + np.exp(-(lexicon.slope * raw + lexicon.bias))))


def test_long_texts_dense_in_matches_and_exceptions():
    import time

    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.SEEDS, 1.0))
    began = time.perf_counter()
    assert toxicity.matches("trash can " * 100_000, lexicon.automaton()) == []
    assert len(toxicity.matches("trash can trash " * 60_000, lexicon.automaton())) == 60_000
    assert time.perf_counter() - began < 30
