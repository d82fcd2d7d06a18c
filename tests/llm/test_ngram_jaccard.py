import random
from collections import Counter

import pytest

from relforge.llm import ngram_jaccard as module
from relforge.llm.components import components
from relforge.llm.ngram_jaccard import ngram_jaccard_join

SCHEMA = "doc_id long, text string, n int, prefix string, hi string"


def brute(rows, width=4, num=85, den=100):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)], links[k]) for k in range(len(rows)))


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    return Counter(tuple(r) for r in ngram_jaccard_join(df, **options).collect())


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi pi rho".split()) + str(rng.randrange(40)) for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80), (1, 50)])
def test_against_all_pairs(spark, width, num):
    rng = random.Random(width)
    rows = []
    for g in range(8):
        base = words(rng, rng.randrange(3, 150))
        rows += [(100 * g + k, edited(rng, base, rng.randrange(0, 5))) for k in range(rng.randrange(1, 9))]
    passage = " ".join(words(rng, 60))
    rows += [(2000 + k, passage + " " + " ".join(words(rng, rng.randrange(0, 80)))) for k in range(20)]
    assert joined(spark, rows, width=width, num=num) == brute(rows, width, num)


def test_long_lists_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "LIST_MOST", 4)
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "BLOCK_GRAMS", 700)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(k, edited(rng, base[: rng.randrange(90, 121)], rng.randrange(0, 5))) for k in range(90)]
    rows += [(500 + k, " ".join(words(rng, 50))) for k in range(10)]
    assert joined(spark, rows) == brute(rows)


def test_lists_past_the_bound_and_one_huge_cluster_of_near_copies(spark):
    rng = random.Random(12)
    base = words(rng, 40)
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(module.LIST_MOST + 200)]  # all n-grams but one are in every text
    rows += [(5000 + k, " ".join(words(rng, 30))) for k in range(5)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in ngram_jaccard_join(df).collect()}
    assert all(got[k].component_id == 0 and got[k].n_links == module.LIST_MOST + 199 for k in range(module.LIST_MOST + 200))
    assert all(got[5000 + k].component_id == 5000 + k and got[5000 + k].n_links == 0 for k in range(5))
    assert module.counter_bits(0) == module.COUNTER_BITS and module.counter_bits(10**15) == module.MOST_COUNTER_BITS


def test_nulls_blanks_short_texts_ties_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (None, "one two"), (7, "one two three"), (7, "one two three"), (8, "x" * 100_000)]
    assert joined(spark, rows) == brute(rows)
    rows = [(None, "only nulls here now"), (None, "only nulls here now")]
    assert joined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert joined(spark, []) == Counter()


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: got[k] for k in range(1, 41)} == dict.fromkeys(range(1, 41), 1)
    assert got[149] == 100 and got[202] == 200 and 300 not in got
