import random

import numpy as np

from relforge.llm import decontaminate as d


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_is_that_of_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 20))
        assert d.align(a, b) == plain_alignment(a.tolist(), b.tolist())


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def fixture():
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.randrange(12, 50)))) for k in range(30)]
    docs, held = [], set()
    for k in range(300):
        text = words(rng, rng.randrange(0, 200))
        if k % 6 == 0:
            item = rng.randrange(30)
            copy = items[item][1].split()
            if k % 12 == 0:  # edited: every seventh word another one, one dropped
                copy = [f"e{rng.randrange(100)}" if j % 7 == 3 else w for j, w in enumerate(copy)]
                del copy[len(copy) // 2]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in copy]
            held.add((k, item))
        docs.append((k, " ".join(text)))
    return items, docs, held


def brute(items, docs, least=d.LEAST_SCORE):
    """Every document against every item, aligned whole."""
    import re

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    names: dict = {}
    code = lambda t: np.array([names.setdefault(w, len(names)) for w in split(t)])
    coded = [(i, code(t)) for i, t in items]
    return {(k, i) for k, t in docs for w in [code(t)] for i, own in coded if len(own) and d.align(own, w) / (d.MATCH * len(own)) >= least}


def found(spark, docs, items, **options):
    a = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    return d.contamination(a, b, **options).collect(), d.decontaminate(a, b, **options).collect()


def test_whole_and_edited_copies_against_all_pairs(spark):
    items, docs, held = fixture()
    rows, kept = found(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in rows}
    assert held <= got == brute(items, docs)
    assert {r.doc_id for r in kept} == {k for k, _ in docs} - {k for k, _ in got}


def test_very_common_copies_are_found(spark):
    rng = random.Random(2)
    items = [(1, " ".join(words(rng, 20)) + " the of and"), (2, "the of and " * 2 + " ".join(words(rng, 15)))]
    docs = [(k, items[0][1] + " " + " ".join(words(rng, 5))) for k in range(300)] + [(1000 + k, "the of and " * 40) for k in range(100)] + [(5000, items[1][1])]
    rows, _ = found(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, 1) for k in range(300)} | {(5000, 2)}


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "..."), (4, "one two"), (None, "a b c d e f g h"), (6, "a b c d e f g h"), (6, "a b c d e f g h")]
    docs = [(1, None), (2, ""), (3, "one two"), (4, "x one two y"), (None, "A, b c! d e f g h"), (6, "p q " * 30_000 + "a b c d e f g h")]
    rows, kept = found(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == {(3, 4), (None, None), (None, 6), (6, None), (6, 6)}
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4"]
    assert found(spark, [], items) == ([], [])
    rows, kept = found(spark, docs, [])
    assert rows == [] and len(kept) == len(docs)


def edits(rng, words, rate, kinds):
    """The words with `rate` of them replaced, dropped, or followed by another one."""
    out = []
    for w in words:
        kind = rng.choice(kinds) if rng.random() < rate else ""
        out += {"": [w], "replace": [f"e{rng.randrange(3000)}"], "drop": [], "insert": [w, f"e{rng.randrange(3000)}"]}[kind]
    return out


def test_recall_of_edited_copies_against_all_pairs(spark):
    rng = random.Random(21)
    items = [(k, " ".join(words(rng, rng.randrange(12, 60)))) for k in range(40)]
    docs, rates = [], {}
    for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
        for kinds in (("replace",), ("drop",), ("insert",), ("replace", "drop", "insert")):
            for _ in range(12):
                copy = edits(rng, rng.choice(items)[1].split(), rate, kinds)
                rates[len(docs)] = rate
                docs.append((len(docs), " ".join(words(rng, rng.randrange(60)) + copy + words(rng, rng.randrange(60)))))
    for k, t in items:  # every third word replaced
        rates[len(docs)] = "third"
        docs.append((len(docs), " ".join(f"x{k}" if j % 3 == 2 else w for j, w in enumerate(t.split()))))
    rows, kept = found(spark, docs, items)
    got, want = {(r.doc_id, r.item_id) for r in rows}, brute(items, docs)
    assert got <= want and {r.doc_id for r in kept} == {k for k, _ in docs} - {k for k, _ in got}
    for rate in (0.0, 0.1, 0.2, 0.3, 0.4, "third"):
        own = {p for p in want if rates[p[0]] == rate}
        assert len(own) > 10 and len(own & got) >= 0.98 * len(own), (rate, len(own), len(own & got))


def test_items_and_texts_that_repeat_themselves(spark):
    items = [(1, "a " * 500), (2, " ".join(f"w{k}" for k in range(40)))]
    docs = [(1, "a " * 200_000), (2, "b " * 100_000 + items[1][1]), (3, (items[1][1] + " ") * 2000), (4, "a b " * 1000), (5, None)]
    rows, kept = found(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 2), (3, 2), (4, 1)}  # a text of a b a b scores as 500 matches and gaps between
    assert [r.doc_id for r in kept] == [5]


def test_seeds_are_those_of_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 3, 7, 0, 30)]
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    seed, at = d.seeds_of(np.concatenate(rows), begin)
    places = sorted(at.tolist())
    want = []
    for a, r in zip(begin, rows, strict=False):
        if 0 < len(r) < 3:
            want.append(int(a))
        want += [int(a) + i for i in range(len(r)) for x in (1, 2) for y in (1, 2) if i + x + y < len(r)]
    assert places == sorted(want) and len(set(seed.tolist())) == len(seed)


def test_other_columns_of_any_name_stay(spark):
    a = spark.createDataFrame([(1, "x y z w v", 5, 6), (2, "other words here at all", 7, 8)], "Doc_Id long, Text string, hi int, lo int")
    b = spark.createDataFrame([(1, "x y z w v")], "item_id long, text string")
    assert [tuple(r) for r in d.decontaminate(a, b).collect()] == [(2, "other words here at all", 7, 8)] and d.decontaminate(a, b).columns == a.columns
    assert d.contamination(a, b).select("doc_id", "item_id").collect() == [(1, 1)]
