import random
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relforge.llm import context_mixing as cm
from relforge.llm.kernels import text_buffers
from relforge.llm.runtime import remainder


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice(["ka", "to", "mi", "ré", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    docs = [(k, " ".join(rng.choice(words[: rng.randrange(3, 60)]) for _ in range(rng.randrange(1, 120)))) for k in range(150)]
    return [*docs, (500, None), (501, ""), (502, "A a\tB"), (503, "a A b"), (None, "ka to"), (504, docs[0][1]), (505, "new " * 20_000), (7, docs[7][1])]


def scored(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, row int, key string")
    return cm.score_texts(df, remainder(F.col("doc_id"), 7) != 2).collect()


def test_counts_and_base_scores_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(cm, "HEAD", 5)  # so that most words take the joined way
    rows = corpus()
    learned = [t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = scored(spark, rows)
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (len(own), sum(counts[w] > 0 for w in own), n, len(texts[r.doc_id].encode()))
        assert isclose(r.base_score, sum(log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    by = {r.doc_id: r for r in got}
    assert by[0].score == by[504].score and by[500].score == by[501].score < 0
    held = [r for r in got if r.held_out and r.n_tokens < 1000]
    bits = -sum(r.score for r in held) / sum(r.n_bytes + 1 for r in held) * np.log2(10)
    assert bits < 2.6  # 8 without a model


def test_bytes_of_a_context_have_probabilities_that_add_up(spark):
    df = spark.createDataFrame([("ka to mi",), ("ka ka su",)], "text string")
    model, words = cm.train(df)
    contexts = np.array([0, 0x6B6120, 0xFFFF], dtype=np.uint64) << np.uint64(8)
    keys = (contexts[:, None] | np.arange(256, dtype=np.uint64)).ravel()
    total = (10.0 ** model.log10(keys).astype(float)).reshape(3, 256).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-3)
    assert (model.log10(keys) == model.compute(keys)).all()  # from the cache now
    assert model.counts == {"n": 8, "v": 5} and words.df.count() == 5


def test_gram_keys_are_those_of_a_plain_loop():
    texts = ["abc", "", "é\x00x", "longer text"]
    data, offsets = text_buffers(pa.array(texts))
    keys, row = cm.gram_keys(data, offsets)
    want = []
    for k, t in enumerate(texts):
        raw = t.encode() + b"\0"
        want += [(k, int.from_bytes((bytes(cm.ORDERS) + raw[: j + 1])[-cm.ORDERS :], "big")) for j in range(len(raw))]
    assert list(zip(row.tolist(), keys.tolist(), strict=True)) == want


def test_empty_tables(spark):
    assert scored(spark, []) == []
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    r = cm.score_texts(df, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.base_score == 0.0 and r.score < 0


def test_no_contexts_share_counts(spark):
    rng = random.Random(3)
    text = "".join(chr(rng.randrange(32, 127)) for _ in range(200_000))  # far more contexts than 2^18 of two bytes
    model, _ = cm.train(spark.createDataFrame([(text,)], "text string"))
    raw = bytes(cm.ORDERS - 1) + text.encode() + b"\0"
    keys = [int.from_bytes(raw[k : k + cm.ORDERS], "big") for k in range(0, len(text), 20_011)] + [0x4142434445FF]
    counts = Counter()
    for k in range(cm.ORDERS - 1, len(raw)):
        for order in range(cm.ORDERS):
            counts[raw[k - order : k + 1]] += 1
    by_context = {}
    for gram, n in counts.items():
        by_context.setdefault(gram[:-1], []).append((gram[-1], n))
    for key, got in zip(keys, model.compute(np.array(keys, dtype=np.uint64)), strict=True):
        own, want = key.to_bytes(cm.ORDERS, "big"), 0.0
        for bit in range(8):
            gate, came, mixed = 1 << bit | own[-1] >> 8 - bit, own[-1] >> 7 - bit & 1, 0.0
            place = next((k for k in range(cm.ORDERS - 1) if own[-2 - k] in b"\0\t\n\v\f\r "), cm.ORDERS - 1)
            seen = max((order for order in range(cm.ORDERS) if any(b >> 8 - bit == own[-1] >> 8 - bit for b, _ in by_context.get(own[cm.ORDERS - 1 - order : -1], []))), default=0)
            second = cm.GATES + seen * cm.PLACES + place
            for order in range(cm.ORDERS):
                fits = [(b >> 7 - bit & 1, n) for b, n in by_context.get(own[cm.ORDERS - 1 - order : -1], []) if b >> 8 - bit == own[-1] >> 8 - bit]
                n1, n0 = (sum(n for b, n in fits if b == x) for x in (1, 0))
                mixed += (model.weights[gate, order] + model.weights[second, order]) * np.clip(np.log((n1 + cm.DELTA) / (n0 + cm.DELTA)), -9, 9)
            low, part = cm._cells(np.array([mixed]))
            fine = model.refined[gate, low[0]] * (1 - part[0]) + model.refined[gate, low[0] + 1] * part[0]
            p = np.clip((1 / (1 + np.exp(-mixed)) + fine) / 2, 1e-6, 1 - 1e-6)
            want += log10(p if came else 1 - p)
        assert isclose(got, want, rel_tol=1e-5)


def test_joined_grams_score_as_those_sent_to_all_tasks(spark, monkeypatch):
    rows = corpus()
    want = sorted((str(r.doc_id), r.n_bytes, r.score) for r in scored(spark, rows))
    monkeypatch.setattr(cm, "GRAM_HEAD", 40)
    assert sorted((str(r.doc_id), r.n_bytes, r.score) for r in scored(spark, rows)) == want


def test_scores_do_not_depend_on_partitions(spark):
    rows, got = corpus(), []
    for shuffled, split in ((3, 2), (11, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
        try:
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(split)
            out = cm.score_texts(df, remainder(F.col("doc_id"), 7) != 2)
            got.append(sorted((str(r.doc_id), r.n_bytes, r.score) for r in out.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
