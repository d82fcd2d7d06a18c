"""Operator 1: n-gram Jaccard join by a blocked sparse document x n-gram product.

A document's set holds the hashes of its distinct word n-grams.  Two documents
link when den * |A and B| >= num * |A or B|.

1. Equal sets are one class from the start, so copies are never paired.
2. A fixed total order of n-grams puts those with a large count (by a counter
   table whose size follows the text's, up to a bound) last.  Two linked sets share an n-gram within the first
   n - ceil(num n / den) + 1 of each ("prefix").
3. Prefixes are inverted.  A list of up to LIST_MOST classes gives its pairs, with how many prefix n-grams they share; pairs whose sizes or shared
   counts rule out the bound go, and so do those whose parity bitmaps differ in
   more places than two linked sets can differ in n-grams.  A longer list gives
   only the edges that tie it together.  Both keep every link inside one
   connected candidate cluster.
4. Clusters are dealt into blocks of bounded size by set size and hash; a block
   pair is a sparse product that accumulates all overlaps and drops pairs below
   the bound.  Blocks whose sizes can't link never meet.  Only a spanning forest
   of each block's links leaves the task, with each class's number of links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import chunks, row_sets, shingle_hashes, text_buffers, word_hashes
from .runtime import Written, small_batches
from .sketch import heavy_bits

#: Counters of the n-gram count table, as powers of two, at least and at most; one for every BYTES_A_COUNTER of text in between.
COUNTER_BITS, MOST_COUNTER_BITS, BYTES_A_COUNTER = 22, 25, 96
#: N-grams counted more often than this (or than thrice the mean counter, if that is more) come last in the order.
LIST_LEAST = 48
#: Lists of at most so many classes are paired in full, whatever the input's size; longer ones tie their classes together.
LIST_MOST = 128
#: Classes, and n-grams in all, in a block of the product (one class at least).
BLOCK, BLOCK_GRAMS = 128, 1 << 21
#: Bits of the filter that keeps sets of unclustered classes from being shuffled.
FILTER_BITS = 23
#: Longs of a set's bitmap: bit k is the parity of the n-grams that fall on k.
MARKS = 8
#: Clustered classes up to which their table is sent to all tasks (some 100 bytes each); a larger one is joined by key.
BROADCAST_CLASSES = 200_000


def _sets(batch: pa.RecordBatch, width: int):
    """(first row, end row, values, offsets) for runs of rows; values are sorted in each row."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
    for a, e in chunks(offsets):
        own = offsets[a : e + 1] - offsets[a]
        hashes, row = word_hashes(data[offsets[a] : offsets[e]], own)
        values, of = shingle_hashes(hashes, row, e - a, width)
        yield a, e, *row_sets(values, of, e - a)


def _digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


def _parities(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x MARKS longs: two sets differ in at least as many n-grams as their bitmaps differ in bits."""
    width = 64 * MARKS
    at = row * width + (values >> np.uint64(7) & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def counter_bits(size: int) -> int:
    """The counters' power of two for so many bytes of text."""
    return min(max(int(math.log2(max(size / BYTES_A_COUNTER, 1))), COUNTER_BITS), MOST_COUNTER_BITS)


def _prefixes(spark, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    def of_batch(batch):
        for _, _, values, _ in _sets(batch, width):
            yield values

    bits = counter_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    marks = heavy_bits(docs.select("text"), of_batch, bits, LIST_LEAST, 3.0)
    heavy_now, mask = spark.sparkContext.broadcast(np.packbits(marks)), np.uint64((1 << bits) - 1)

    def prefix(batches):
        heavy_at = np.unpackbits(heavy_now.value).astype(bool)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, e, values, offsets in _sets(batch, width):
                n = np.diff(offsets)
                row = np.repeat(np.arange(e - a), n)
                heavy = heavy_at[(values & mask).astype(np.int64)]
                order = np.lexsort((heavy, row))
                need = np.where(n > 0, n - -(-num * n // den) + 1, 0)
                first = (np.arange(len(values)) - np.repeat(offsets[:-1], n)) < np.repeat(need, n)
                kept, heavy = values[order][first], heavy[order][first]
                digest = _digests(values, offsets)
                ends = np.concatenate([[0], np.cumsum(need)])
                late = np.bincount(row[first], weights=heavy, minlength=e - a).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, e - a), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(late),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(e - a + 1) * MARKS, pa.int32()), pa.array(_parities(values, row, e - a))),
                    ],
                    names=["doc_id", "n", "hi", "lo", "late", "prefix", "marks"],
                )

    kind = "doc_id long, n long, hi long, lo long, late int, prefix array<long>, marks array<long>"
    return docs.mapInArrow(prefix, kind)


def _pairs(longest: int, num: int, den: int):
    """Pairs and ties of inverted lists that come sorted by token and node."""

    def tied(a, b):
        zero = np.zeros(len(b), dtype=np.int64)
        return np.full(len(b), a), b, zero, zero, zero, zero, zero, np.ones(len(b), dtype=bool)

    def run(batches):
        names = ["a", "b", "na", "nb", "la", "lb", "shared", "tie"]
        held = None  # rows of the last list, which may go on
        hot, center = None, None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            token, node, n, late = rows
            out = []
            if hot is not None:
                same = int(np.argmax(token != hot)) if (token != hot).any() else len(token)
                if same:
                    out.append(tied(center, node[:same]))
                    token, node, n, late = token[same:], node[same:], n[same:], late[same:]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, dtype=np.int64)
            ends = np.append(starts[1:], len(token))
            if len(starts):
                last = starts[-1]
                if len(token) - last > longest:
                    hot, center, held = token[last], node[last], None
                else:
                    held = [token[last:], node[last:], n[last:], late[last:]]
                    starts, ends = starts[:-1], ends[:-1]
            else:
                held = None
            out += _of_lists(starts, ends, node, n, late, longest, num, den, tied)
            yield from _emit(out, names)
        if held is not None:
            token, node, n, late = held
            yield from _emit(_of_lists(np.array([0]), np.array([len(token)]), node, n, late, longest, num, den, tied), names)

    return run


def _of_lists(starts, ends, node, n, late, longest, num, den, tied):
    out, lengths = [], ends - starts
    for k in np.unique(lengths[(lengths > 1) & (lengths <= longest)]):
        at = starts[lengths == k][:, None] + np.arange(k)
        x, y = np.triu_indices(k, 1)
        for part in np.array_split(at, max(1, len(at) * len(x) // 400_000)):
            a, b = part[:, x].ravel(), part[:, y].ravel()
            fits = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (node[a] != node[b])
            a, b = a[fits], b[fits]
            if len(a):
                out.append((node[a], node[b], n[a], n[b], late[a], late[b], np.ones(len(a), dtype=np.int64), np.zeros(len(a), dtype=bool)))
    for k in np.flatnonzero(lengths > longest):
        out.append(tied(node[starts[k]], node[starts[k] + 1 : ends[k]]))
    return out


def _emit(out, names):
    if not out:
        return
    a, b, na, nb, la, lb, shared, tie = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    cols = [a[first], b[first], *(np.maximum.reduceat(x[order], first) for x in (na, nb, la, lb)), np.add.reduceat(shared[order], first)]
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(np.logical_or.reduceat(tie[order], first))], names=names)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrix with itself: how many n-grams each two sets share."""
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    slab = max(256, min(8192, (1 << 22) // max(1, len(sets))))
    for first in range(0, int(common.sum()), slab):
        a, b = np.searchsorted(column, [first, first + slab])
        part = np.zeros((len(sets), slab), dtype=np.float32)
        part[row[a:b], column[a:b] - first] = 1
        total += part @ part.T
    np.fill_diagonal(total, sizes)
    return total.astype(np.int64)


def links_of(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Boolean matrix of links; if both sides are there, only of those between the sides."""
    shared = _overlaps(sets)
    size = np.array([len(x) for x in sets])
    link = den * shared >= num * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(link, False)
    if side.any() and not side.all():
        link &= side[:, None] != side[None, :]
    return link


def _blocks(num: int, den: int):
    """Links of blocks that come sorted by block key: (node, root, links) of a spanning forest and the numbers of links."""

    def of_block(nodes, copies, sides, sets):
        if len(nodes) < 2:
            return
        node, copy, side = np.array(nodes), np.array(copies), np.array(sides, dtype=bool)
        link = links_of([np.frombuffer(x, dtype=np.uint64) for x in sets], side, num, den)
        linked = link.any(axis=1)
        if not linked.any():
            return
        root = np.arange(len(node))
        while True:
            least = np.minimum(root, np.where(link, root[None, :], len(node)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        number = link @ copy
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[linked]), pa.array(node[root[linked]]), pa.array(number[linked].astype(np.int64))], names=["node", "root", "links"]
        )

    def run(batches):
        key, nodes, copies, sides, sets = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for k, node, copy, side, own in zip(keys, *(batch.column(k).to_pylist() for k in (5, 6, 7, 8)), strict=True):
                if k == key and nodes and nodes[-1] == node and sides[-1] == side:
                    continue  # the same row of the input, repeated
                if k != key:
                    yield from of_block(nodes, copies, sides, sets)
                    key, nodes, copies, sides, sets = k, [], [], [], []
                nodes.append(node)
                copies.append(copy)
                sides.append(side)
                sets.append(own)
        yield from of_block(nodes, copies, sides, sets)

    return run


def ngram_jaccard_join(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of `documents` (doc_id long, text string).

    n_shingles: size of the row's set of `width`-word shingles (fewer words: the
    whole sequence is one).  component_id: the least doc_id reachable by links,
    its own included.  n_links: how many other rows it links to.

    Null, empty and blank texts have an empty set, link with nothing and keep
    their doc_id as component_id (null for a null doc_id).  Rows that repeat a
    text, with any doc_id, null included, link to each other; every input row
    gives one result row.  No row gives no row.  Other columns are not read.
    A very long text is one set; a block of the product holds BLOCK_GRAMS
    n-grams, or one set if that has more.
    N-grams and sets are told apart by hashes of 64 and 128 bits.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = Written(_prefixes(spark, docs, width, num, den))
    has = members.df.where("n > 0")
    classes = Written(
        has.groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("late").alias("late"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    lists = (
        classes.df.select(F.explode("prefix").alias("token"), "node", F.col("n").cast("int").alias("n"), "late")
        .repartition("token")
        .sortWithinPartitions("token", "node")
    )
    kind = "a long, b long, na long, nb long, la long, lb long, shared long, tie boolean"
    found = lists.mapInArrow(_pairs(LIST_MOST, num, den), kind).groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("na", "nb", "la", "lb", "tie")), F.sum("shared").alias("shared"))
    rest = lambda n: F.ceil(F.col(n) * num / den) - 1  # noqa: E731  n-grams behind the prefix
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
    candidates = found.where(F.col("tie") | (F.col("shared") + F.least("la", "lb") + F.greatest(rest("na"), rest("nb")) >= need))
    marks_of = lambda side: classes.df.select(F.col("node").alias(side), F.col("marks").alias(f"m{side}"))
    pairs = candidates.where("not tie").select("a", "b", F.col("na") + F.col("nb") - 2 * need).join(marks_of("a"), "a").join(marks_of("b"), "b").toDF("b", "a", "most", "ma", "mb")
    apart = sum((F.bit_count(F.col("ma")[k].bitwiseXOR(F.col("mb")[k])) for k in range(1, MARKS)), F.bit_count(F.col("ma")[0].bitwiseXOR(F.col("mb")[0])))
    edges = pairs.where(apart <= F.col("most")).select("a", "b").unionAll(candidates.where("tie").select("a", "b"))
    cluster = Written(components(edges))

    step = math.log(den / num)
    own = (
        classes.df.drop("prefix", "late", "marks")
        .join(cluster.df, "node")
        .withColumn("size", F.floor(F.log("n") / step).cast("int"))
    )
    per = own.groupBy("root", "size").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    per = per.withColumn("parts", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int"))
    dealt = per.groupBy("root").agg(F.sum("rows").alias("all"), F.sum("grams").alias("all_grams"), F.map_from_entries(F.collect_list(F.struct("size", "parts"))).alias("parts"))
    at = lambda k: F.coalesce(F.col("parts")[F.col("size") + k], F.lit(0))
    block = lambda s, p, t, q, side: F.struct(s.alias("s"), p.cast("int").alias("p"), t.alias("t"), q.cast("int").alias("q"), side.alias("side"))
    size, mine = F.col("size"), F.col("mine")
    several = F.concat(
        F.transform(F.sequence(F.lit(0), at(0) - 1), lambda o: block(size, F.least(o, mine), size, F.greatest(o, mine), mine > o)),
        F.when(at(1) > 0, F.transform(F.sequence(F.lit(0), at(1) - 1), lambda o: block(size, mine, size + 1, o, F.lit(False)))).otherwise(F.array().cast("array<struct<s:int,p:int,t:int,q:int,side:boolean>>")),
        F.when(at(-1) > 0, F.transform(F.sequence(F.lit(0), at(-1) - 1), lambda o: block(size - 1, o, size, mine, F.lit(True)))).otherwise(F.array().cast("array<struct<s:int,p:int,t:int,q:int,side:boolean>>")),
    )
    zero = F.lit(0)
    one = F.array(block(zero, zero, zero, zero, F.lit(False)))
    placed = Written(
        own.join(dealt, "root")
        .withColumn("mine", F.pmod(F.xxhash64("node"), at(0)).cast("int"))
        .select("node", "root", "hi", "lo", "least", "copies", F.when((F.col("all") <= BLOCK) & (F.col("all_grams") <= BLOCK_GRAMS), one).otherwise(several).alias("blocks"))
    )

    def low_of(batch):
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    marks = heavy_bits(placed.df.select("lo"), low_of, FILTER_BITS, 0, 0.0)
    wanted, mask = spark.sparkContext.broadcast(np.packbits(marks)), np.uint64((1 << FILTER_BITS) - 1)

    def whole(batches):
        want = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            ids = batch.column(0)
            for a, e, values, offsets in _sets(batch, width):
                digest = _digests(values, offsets)
                keep = np.flatnonzero(want[(digest[:, 1].view(np.uint64) & mask).astype(np.int64)] & (np.diff(offsets) > 0))
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(a, e - a).take(pa.array(keep)), pa.array(digest[keep, 0]), pa.array(digest[keep, 1]),
                            pa.array([values[offsets[k] : offsets[k + 1]].tobytes() for k in keep], pa.binary()),
                        ],
                        names=["doc_id", "hi", "lo", "own"],
                    )

    sets = docs.mapInArrow(whole, "doc_id long, hi long, lo long, own binary")
    few = placed.df.count() <= BROADCAST_CLASSES
    blocks = (
        sets.alias("s")
        .join((F.broadcast(placed.df) if few else placed.df).alias("c"), (F.col("c.hi") == F.col("s.hi")) & (F.col("c.lo") == F.col("s.lo")) & F.col("c.least").eqNullSafe(F.col("s.doc_id")))
        .select("root", "node", "copies", F.explode("blocks").alias("at"), "own")
        .select("root", "at.s", "at.p", "at.t", "at.q", "node", "copies", "at.side", "own")
        .repartition("root", "s", "p", "t", "q")
        .sortWithinPartitions("root", "s", "p", "t", "q", "side", "node")
    )
    linked = Written(blocks.mapInArrow(_blocks(num, den), "node long, root long, links long"))
    root = components(linked.df.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("root").alias("top"))
    number = linked.df.groupBy("node").agg(F.sum("links").alias("links"))
    slim = classes.df.select("hi", "lo", "node", "least", "copies")
    linked_classes = slim.join(number, "node").join(root, "node")
    tops = linked_classes.groupBy("top").agg(F.min("least").alias("component"))
    of_node = linked_classes.join(tops, "top").select("node", "links", "component")
    result = slim.join(of_node, "node", "left").select(
        "hi", "lo", F.coalesce("component", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = has.select("doc_id", "n", "hi", "lo").join(result, ["hi", "lo"], "left")
    linked_rows = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").cast("long").alias("n_links"))
    empty = members.df.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked_rows.unionAll(empty)
