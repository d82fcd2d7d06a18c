"""Operator 9: benchmark decontamination by rare n-gram seeds and local alignment.

A seed is three words of a test item in their order, each at most one word apart
from the next (four seeds begin at each word), so that seeds outlive an edit of
every third word.  Those that the corpus holds far more often than the item's
others are left out.  Documents' seeds pass a bitmap of the items' seeds and are
joined with them by hash, once for all items; a text and an item that share
enough seeds close together are aligned there (Smith-Waterman over words), so
that edited and paraphrased copies score too.

Equal texts are one text from the start, so copies are never joined twice.
Words are runs of letters, digits and bytes above 127; A-Z is folded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, mix64, text_buffers, word_hashes
from .runtime import Written, small_batches
from .sketch import bitmaps, has_bits

#: Words of a seed, and the furthest that one is from the next.
WIDTH, REACH = 3, 2
#: A seed goes if it occurs more often than so many times its item's median seed, and than so many times at all.
TIMES, ALWAYS = 8, 64
#: A text that holds an item shares the seeds that begin at one of so many of the item's words, and one at least.
ONE_OF = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the best possible alignment score.
LEAST_SCORE = 0.5
#: Bits of the bitmaps for each seed, and the least and the most bits in all, as powers of two (the most: 32 MB each).
BITS_A_SEED, LEAST_BITS, MOST_BITS = 6, 20, 28

_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in ((0, 48), (58, 65), (91, 97), (123, 128)):
    _PLAIN[_a:_b] = 32


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end)."""
    hashes, row = word_hashes(_PLAIN[data], offsets)
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))]).astype(np.int64)


def seeds_of(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, index of its first word); a row with fewer words than a seed has its whole sequence as the only one."""
    ends = np.repeat(begin[1:], np.diff(begin))
    seeds, first = [], []
    with np.errstate(over="ignore"):
        for d in range(1, REACH + 1):
            pair = mix64(hashes[: max(len(hashes) - d, 0)] * np.uint64(3) + hashes[d:])
            for e in range(1, REACH + 1):
                n = max(len(hashes) - d - e, 0)
                inside = np.flatnonzero(np.arange(d + e, d + e + n) < ends[:n])
                seeds.append(mix64(pair[inside] * np.uint64(3) + hashes[inside + d + e]))
                first.append(inside)
        size = np.diff(begin)
        short = np.flatnonzero((size > 0) & (size < WIDTH))
        if len(short):
            at = begin[short]
            second = np.where(size[short] > 1, hashes[np.minimum(at + 1, len(hashes) - 1)], np.uint64(0))
            seeds.append(mix64(mix64(hashes[at]) ^ second * np.uint64(5) ^ size[short].astype(np.uint64)))
            first.append(at)
    return np.concatenate(seeds), np.concatenate(first).astype(np.int64)


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The best Smith-Waterman score of two word sequences, with linear gaps."""
    if not len(a) or not len(b):
        return 0
    steps = -GAP * np.arange(len(b) + 1)
    above, best = np.zeros(len(b) + 1, dtype=np.int64), 0
    for word in a:
        row = np.zeros(len(b) + 1, dtype=np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(b == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        above = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        best = max(best, int(above.max()))
    return best


def held(item: np.ndarray, words: np.ndarray, where: np.ndarray, inside: np.ndarray, need: int, least: float) -> tuple[float, int]:
    """(score, seed places) of the item at its best in a text, given the places of shared seeds in both; (0, 0) if it isn't held.

    An alignment of `least` spans less than MATCH * len(item) / least words of
    the text, so seeds further apart than that are looked at apart.  A stretch
    without enough of the item's words can't score and isn't aligned.
    """
    order = np.argsort(where, kind="stable")
    where, inside = where[order], inside[order]
    m = len(item)
    span = math.ceil(m * (1 + MATCH * (1 - min(least, 1.0))))
    cuts = np.flatnonzero(np.diff(where) > span) + 1
    best = (0.0, 0)
    for a, e in zip(np.append(0, cuts).tolist(), np.append(cuts, len(where)).tolist(), strict=True):
        places = len(np.unique(inside[a:e]))
        if places < need:
            continue
        near = words[max(0, int(where[a]) - span) : int(where[e - 1]) + span + WIDTH]
        if MATCH * np.isin(near, item).sum() < least * MATCH * m:
            continue
        score = align(item, near) / (MATCH * m)
        if score >= least and score > best[0]:
            best = (score, places)
    return best


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(9), text)


def _worded(names: list[str], at: int):
    """Batches with the text in column `at` replaced by its word hashes in bytes; texts without words go."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            for a, e in chunks(offsets):
                hashes, begin = _hashed(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                has = np.flatnonzero(np.diff(begin))
                own = pa.array([hashes[begin[k] : begin[k + 1]].tobytes() for k in has], pa.binary())
                yield pa.RecordBatch.from_arrays([own if k == at else c.slice(a, e - a).take(pa.array(has)) for k, c in enumerate(batch.columns)], names=names)

    return run


def _item_seeds(batches):
    for batch in batches:
        for blob, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes = np.frombuffer(blob, dtype=np.uint64)
            seed, place = seeds_of(hashes, np.array([0, len(hashes)]))
            order = np.lexsort((place, seed))
            seed, place = seed[order], place[order]
            first = np.append(True, seed[1:] != seed[:-1])  # an item that repeats itself has each seed once
            seed, place = seed[first], place[first]
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), item)), pa.array(place.astype(np.int32))], names=["seed", "item", "place"])


def contamination(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score (of 1) and seeds (seed places shared), for every document and every test item that it holds.

    `documents` has doc_id and text, `benchmark` item_id and text.  A document
    holds an item if the alignment of some place in it with the item has `least`
    of the score of a full copy.  Null, empty and wordless texts hold nothing
    and are held by nothing; texts and items of fewer than three words match as
    a whole only.  A very long text is looked at whole; only the stretches
    around its seeds are aligned.  Null ids stay null; rows that repeat are each
    reported; other columns are not read; an empty table on either side gives no
    rows.

    Copies of which the seeds tell nothing are lost: those that put two or more
    other words behind every second word of the item.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _found(docs, benchmark, least)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, seeds long")
    hi, lo = _text_key(F.col("text"))
    rows = docs.select("doc_id", hi.alias("hi"), lo.alias("lo"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("item"))
    return rows.join(found, ["hi", "lo"]).join(tests, "item").select("doc_id", "item_id", "score", "seeds")


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame | None:
    """(hi, lo, item, score, seeds) of distinct texts and the items that they hold; None without items."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = benchmark.select(text.alias("text"), F.xxhash64(text).alias("item")).dropDuplicates(["item"])  # equal items are one
    words_of_items = _worded(["words", "item"], 0)
    # What follows in one task is one pass of Python: each pass of its own would be one more worker a core, held after the stage.
    seeds = Written(tests.mapInArrow(lambda batches: _item_seeds(words_of_items(batches)), "seed long, item long, place int")).df
    n = seeds.count()
    if not n:
        return None
    bits = min(max(math.ceil(math.log2(n)) + BITS_A_SEED, LEAST_BITS), MOST_BITS)
    known = spark.sparkContext.broadcast(bitmaps(seeds.select("seed"), bits, (0, 64 - bits)))

    def shared(batches):
        one, two = known.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, e in chunks(offsets):
                hashes, begin = _hashed(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                seed, at = seeds_of(hashes, begin)
                hit = np.flatnonzero(has_bits(one, seed, bits, 0))
                hit = hit[has_bits(two, seed[hit], bits, 64 - bits)]
                if not len(hit):
                    continue
                hit = hit[np.argsort(at[hit], kind="stable")]
                row = np.searchsorted(begin, at[hit], side="right") - 1
                has, starts = np.unique(row, return_index=True)
                ends = pa.array(np.append(starts, len(hit)), pa.int32())
                keys = [c.slice(a, e - a).take(pa.array(has)) for c in batch.columns[1:]]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (seed[hit].view(np.int64), (at[hit] - begin[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*keys, *lists], names=["hi", "lo", "seeds", "places"])

    hi, lo = _text_key(F.col("text"))
    keyed = docs.select("text", hi.alias("hi"), lo.alias("lo"))
    hits = keyed.mapInArrow(shared, "hi long, lo long, seeds array<long>, places array<int>")
    texts = Written(hits.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))).df
    each = texts.select("hi", "lo", "copies", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("hi", "lo", "copies", F.col("x.seeds").alias("seed"), F.col("x.places").alias("at"))

    counts = each.groupBy("seed").agg(F.sum("copies").alias("n"))
    counted = seeds.join(counts, "seed", "left").select("seed", "item", "place", F.coalesce("n", F.lit(0)).alias("n"))
    by_item = counted.groupBy("item").agg(F.percentile("n", F.lit(0.5)).alias("usual"), F.collect_list(F.struct("seed", "place", "n")).alias("x"))
    rare = F.filter("x", lambda x: x["n"] <= F.greatest(F.lit(ALWAYS), TIMES * F.col("usual")))
    need = F.greatest(F.lit(1), F.floor(F.size(F.array_distinct(F.transform(rare, lambda x: x["place"]))) / ONE_OF)).cast("int")
    kept = Written(by_item.select("item", need.alias("need"), F.explode(rare).alias("x")).where("x.n > 0").select("item", "need", "x.seed", "x.place")).df

    both = each.join(kept, "seed").groupBy("hi", "lo", "item", "need").agg(F.collect_list(F.struct("at", "place")).alias("x"), F.count_distinct("place").alias("shared"))
    pairs = Written(both.where("shared >= need").select("hi", "lo", "item", "need", F.col("x.at").alias("at"), F.col("x.place").alias("place"))).df

    wanted_bits = min(max(math.ceil(math.log2(max(pairs.count(), 1))) + BITS_A_SEED, LEAST_BITS), MOST_BITS)
    wanted = spark.sparkContext.broadcast(bitmaps(pairs.select("lo"), wanted_bits, (0,))[0])

    def of_wanted(batches):
        marks = wanted.value
        for batch in batches:
            keep = has_bits(marks, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), wanted_bits, 0)
            if keep.any():
                yield batch.filter(pa.array(keep))

    words_of_texts = _worded(["words", "hi", "lo"], 0)
    few = keyed.mapInArrow(lambda batches: words_of_texts(of_wanted(batches)), "words binary, hi long, lo long")
    words = few.groupBy("hi", "lo").agg(F.first("words").alias("words"))
    own = tests.mapInArrow(words_of_items, "words binary, item long").withColumnRenamed("words", "own")
    ready = pairs.join(words, ["hi", "lo"]).join(own, "item").select("hi", "lo", "item", "own", "words", "at", "place", "need")

    def aligned(batches):
        for batch in batches:
            rows, score, number = [], [], []
            for k, (own, words, at, place, need) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 8)), strict=True)):
                s, p = held(np.frombuffer(own, dtype=np.uint64), np.frombuffer(words, dtype=np.uint64), np.array(at), np.array(place), need, least)
                if p:
                    rows.append(k)
                    score.append(s)
                    number.append(p)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in range(3)), pa.array(score, pa.float64()), pa.array(number, pa.int64())], names=["hi", "lo", "item", "score", "seeds"])

    return Written(ready.mapInArrow(aligned, "hi long, lo long, item long, score double, seeds long")).df


def decontaminate(documents: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `documents`, with all their columns, that hold no test item; see `contamination`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = _found(documents.select(text.alias("text")), benchmark, least)
    if found is None:
        return documents
    gone = found.select("hi", "lo").distinct()
    hi, lo = _text_key(text)
    return documents.join(gone, (hi == gone["hi"]) & (lo == gone["lo"]), "left_anti")
