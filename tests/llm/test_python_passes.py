"""Each pass of Python in a task is one more worker, whose memory the executor holds for as long as the worker waits for its next task."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from relforge.llm import decontaminate, langid, mpeg_audio, sketch
from relforge.llm.ngram_jaccard import ngram_jaccard_join


def chained(df):
    """The nodes of Python that are fed by others in the same task."""
    found, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if not (name := re.search(r"[A-Za-z]+", line)):
            continue
        above = [x for x in above if x[0] < name.start()]
        if "MapInArrow" in line:
            own = [x[1] for x in above if re.search("MapInArrow|Exchange", x[1])]
            found += bool(own) and "MapInArrow" in own[-1]
        above.append((name.start(), line))
    return found


@pytest.fixture
def passes(monkeypatch):
    """Every table that mapInArrow makes."""
    made, was = [], DataFrame.mapInArrow

    def seen(self, *args, **more):
        made.append(was(self, *args, **more))
        return made[-1]

    monkeypatch.setattr(DataFrame, "mapInArrow", seen)
    return made


def rows():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    items = [(k, prose(20)) for k in range(5)]
    return [(k, f"{prose(30)} {items[k % 5][1] if k % 3 == 0 else ''}") for k in range(60)], items


def test_decontamination_has_one_pass_of_python_in_a_task(spark, passes):
    docs, items = rows()
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in out.collect()} == {k for k in range(60) if k % 3}
    assert len(passes) > 3 and not any(map(chained, passes))


def test_near_duplicates_have_one_pass_of_python_in_a_task(spark, passes):
    docs, _ = rows()
    assert ngram_jaccard_join(spark.createDataFrame([*docs, (60, docs[7][1])], "doc_id long, text string")).where("n_links = 1").count() == 2
    assert len(passes) > 3 and not any(map(chained, passes))


def test_counting_takes_no_second_table():
    rng = np.random.default_rng(1)
    table, values = np.zeros(1 << 22, dtype=np.uint32), rng.integers(0, 1 << 10, 5000).astype(np.uint64) << np.uint64(3)
    tracemalloc.start()
    sketch.add_counts(table, values)
    sketch.add_counts(table, values)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < table.nbytes / 8
    assert (table == 2 * np.bincount(values.astype(np.int64), minlength=len(table))).all()


def test_marks_are_those_of_plain_counts(spark):
    values = [k * k % 97 for k in range(3000)] + [2**62 + 5] * 70
    got = sketch.heavy_bits(spark.createDataFrame([(x,) for x in values], "x long"), lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)]), 12, 40, 0.0)
    assert set(np.flatnonzero(got).tolist()) == {x for x in set(y % 4096 for y in values) if sum(y % 4096 == x for y in values) > 40}


def test_media_have_one_pass_of_python_in_a_task(spark, passes):
    df = spark.createDataFrame([(1, "some text " * 300), (2, ""), (3, None), (3, "é")], "doc_id long, text string")
    got = sorted(map(str, mpeg_audio.media_features(df).collect()))
    assert len(passes) == 1 and not chained(passes[0])
    assert got == sorted(map(str, mpeg_audio.digests(mpeg_audio.read_media(mpeg_audio.encode_texts(df))).collect()))
    assert chained(passes[-1]) == 1


def test_language_training_holds_the_vectors_of_one_language(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choices("abcdefghijklmnop"[n : n + 9], k=6)) for _ in range(12)), f"l{n}") for n in range(5) for k in range(n * 800, n * 800 + 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = langid.train(df)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(model.language) == {f"l{n}" for n in range(5)}
    assert most < 100 << 20  # 4000 texts' vectors at once are 64 MB, and several times that while they are made
