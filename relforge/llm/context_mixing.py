"""Operator 8: language-model scores by logistic context mixing.

A text is predicted bit by bit.  For each bit there are predictors over the
contexts of 0 to ORDERS - 1 bytes before it; their logits are added up with
weights that two gates choose: the bit's place in its byte, and the longest
context seen before together with the place in the word.  The mix is refined by
an adaptive table of what really came.  Everything is learned from the counts of
all byte n-grams of all training texts: the predictors by adding up, weights by
online updates over the n-grams (each leaving its own occurrence out), the
refinement by adding up what came of each prediction before its update.  The
updates run over n-grams in a mixed order, not along texts,
and the model is frozen when it scores, so a text's score depends on the text
alone.

No two contexts share a count, however many there are: the n-grams are dealt to
tasks by the two bytes before the last, so that whole contexts of two bytes and
more are in one task, where they come sorted and are counted block by block;
shorter ones have 65,536 counts in all.  Weights are learned apart in SLICES
fixed slices of the n-grams and averaged; sums over tasks are whole numbers, so
nothing depends on how the input or the n-grams are split.  A byte's probability
depends on the ORDERS - 1 bytes before it only, so it is computed once for every
distinct n-gram of the documents.  The most frequent n-grams' go to every task;
the others' are joined.

Beside it stands a base score: the unigram probability of the text's words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, text_buffers, word_hashes
from .runtime import Written, remainder, small_batches

ORDERS = 6
DELTA, RATE, BATCH = 0.2, 0.1, 512
#: Parts of the n-grams, by their two-byte contexts, in which weights are learned apart (a power of two).
SLICES = 64
#: Gates: partial bytes, and longest contexts x places in the word.
GATES, PLACES = 256, 8
#: Cells of the refinement for each gate, over logits -8 to 8.
CELLS = 33
#: Words whose counts go to every task; the others' are joined.
HEAD = 1 << 16
#: N-grams whose probabilities go to every task at most; the others' are joined.
GRAM_HEAD = 1 << 20
#: N-grams that a task counts at once, besides the rest of a two-byte context.
BLOCK = 1 << 17
#: Log probabilities, weights, a slice's share and the refinement's sums are whole numbers of these parts, so that the order of adding doesn't matter.
UNIT, SHARE, FINE = 1 << 24, 1 << 20, 1 << 10
_END = np.uint64(0x656E64)
_LEARNED = np.uint64(1 << 8 * ORDERS)
_HEAD_BITS = 21
#: Odd, so that multiplying by it puts the 65,536 two-byte contexts into another order.
_MIX = 40503
_GATHER = 1 << 21


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) for every byte and the end of every text: the byte in the lowest 8 bits, those before it above."""
    rows = len(offsets) - 1
    width = np.diff(offsets) + ORDERS  # ORDERS - 1 zeros before, one behind
    begin = np.concatenate([[0], np.cumsum(width)])
    wide = np.zeros(int(begin[-1]), dtype=np.uint64)
    wide[np.arange(len(data)) + np.repeat(begin[:-1] + ORDERS - 1 - offsets[:-1], np.diff(offsets))] = data
    key = np.zeros(len(wide), dtype=np.uint64)
    for k in range(ORDERS):
        key[k:] |= wide[: len(wide) - k] << np.uint64(8 * k)
    row = np.repeat(np.arange(rows), width)
    use = np.arange(len(wide)) - np.repeat(begin[:-1], width) >= ORDERS - 1
    return key[use], row[use]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True


def _places(keys: np.ndarray) -> np.ndarray:
    """How many bytes lie between the last byte and the white space before it, ORDERS - 1 at most."""
    out = np.full(len(keys), ORDERS - 1)
    for k in range(ORDERS - 1, 0, -1):
        out[_SPACE[(keys >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)]] = k - 1
    return out


def _start() -> np.ndarray:
    """Weights to begin with, for the gates of both kinds: predictors count alike, the longest context seen more, short ones less beside it."""
    out = np.zeros((GATES + ORDERS * PLACES, ORDERS))
    out[:GATES] = 0.3
    for seen in range(1, ORDERS):
        own = out[GATES + seen * PLACES : GATES + (seen + 1) * PLACES]
        own[:, seen] += 0.3
        own[:, 0] -= 0.3
        own[:, 1] -= 0.2 * (seen > 1)
        own[:, 2] -= 0.1 * (seen > 3)
    return out


def _bits(keys: np.ndarray, bit: int) -> np.ndarray:
    return (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(np.float64)


class _Counts:
    """Counts of all contexts of some n-grams (distinct; whole two-byte contexts), with the counts of shorter ones."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: np.ndarray):
        self.keys, self.n, self.places = keys, n, _places(keys)
        self.orders = []  # for each order (9 x entries: how often the byte began with so many of its bits, entry of each key)
        for order in range(ORDERS):
            own = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            if order == 0:
                entry, at, count = np.arange(256, dtype=np.uint64), own.astype(np.int64), low.reshape(256, 256).sum(axis=0)
            elif order == 1:
                entry, at, count = np.arange(1 << 16, dtype=np.uint64), own.astype(np.int64), low
            else:
                entry, at = np.unique(own, return_inverse=True)
                count = np.bincount(at, weights=n, minlength=len(entry))
            total = np.empty((9, len(entry)))
            for bits in range(9):
                head = entry >> np.uint64(8 - bits)
                first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
                total[bits] = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(head))))
            self.orders.append((total, at))

    def inputs(self, at: np.ndarray, bit: int, leave: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(logits of the predictors as orders x keys, both gates, bit that came) for one bit of the keys' lowest bytes, the highest bit first.

        `leave`: each key's own occurrence is left out.
        """
        keys = self.keys[at]
        came = _bits(keys, bit)
        out, seen = np.empty((ORDERS, len(keys))), np.zeros(len(keys), dtype=np.int64)
        for order, (total, entry) in enumerate(self.orders):
            k = entry[at]
            same, both = total[bit + 1][k], total[bit][k]
            other = both - same
            if leave:
                same = np.maximum(same - 1, 0)
            seen[both > leave] = order
            out[order] = np.log((same + DELTA) / (other + DELTA))
        gate = np.uint64(1 << bit) | (keys & np.uint64(255)) >> np.uint64(8 - bit)
        return np.clip(out * (2 * came - 1), -9, 9), gate.astype(np.int64), GATES + seen * PLACES + self.places[at], came


def _mixed(x: np.ndarray, weights: np.ndarray, gate: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.einsum("ok,ko->k", x, weights[gate] + weights[second])


def _blocks(batches, low: np.ndarray):
    """(slice, counts, m) of blocks of a task's n-grams (key, n, m), which come in the order of their mixed contexts and keys.

    A block holds whole contexts of one slice, and ends with the first that ends
    BLOCK n-grams or more from its begin; so blocks depend on the slice alone.
    """
    columns = [np.zeros(0, dtype=np.int64)] * 3
    waiting, size, wanted = [], 0, BLOCK

    def ready(columns, last):
        keys = columns[0].view(np.uint64)
        mixed = ((keys >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(_MIX) & np.uint64(0xFFFF)).astype(np.int64)
        cuts = np.flatnonzero(mixed[1:] != mixed[:-1]) + 1
        part, a = mixed * SLICES >> 16, 0
        while a < len(keys):
            k = np.searchsorted(cuts, a + BLOCK)
            e = min(int(cuts[k]) if k < len(cuts) else len(keys), int(np.searchsorted(part, part[a], "right")))
            if e == len(keys) and not last:
                break
            yield int(part[a]), _Counts(keys[a:e], columns[1][a:e].astype(np.float64), low), columns[2][a:e]
            a = e
        yield a

    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= wanted:
            columns, waiting = [np.concatenate(c) for c in zip(columns, *waiting, strict=True)], []
            for got in ready(columns, False):
                if isinstance(got, int):
                    columns = [c[got:] for c in columns]
                else:
                    yield got
            size = len(columns[0])
            wanted = max(BLOCK, 2 * size)
    columns = [np.concatenate(c) for c in zip(columns, *waiting, strict=True)]
    for got in ready(columns, True):
        if not isinstance(got, int):
            yield got


@dataclass
class Model:
    grams: Written  # key, n (in training texts), m (in all)
    low: np.ndarray  # counts of all two-byte strings
    weights: np.ndarray  # gates of both kinds x orders
    refined: np.ndarray  # GATES x CELLS, probabilities of a 1
    counts: dict[str, int]
    _known: dict[int, float] = field(default_factory=dict)

    def scored(self, grams: DataFrame) -> DataFrame:
        """key, m and log10 of the probability of the key's lowest byte after the others, in parts of UNIT, for n-grams (key, n, m), all those of training among them."""
        held = grams.sparkSession.sparkContext.broadcast((self.low, self.weights, self.refined))

        def run(batches):
            low_counts, weights, refined = held.value
            for _, counts, m in _blocks(batches, low_counts):
                for k in range(0, len(m), 65536):
                    at = np.arange(k, min(k + 65536, len(m)))
                    total = np.zeros(len(at))
                    for bit in range(8):
                        x, gate, second, came = counts.inputs(at, bit, False)
                        mixed = _mixed(x, weights, gate, second)
                        low, part = _cells(mixed)
                        fine = refined[gate, low] * (1 - part) + refined[gate, low + 1] * part
                        p = np.clip((_squash(mixed) + fine) / 2, 1e-6, 1 - 1e-6)
                        total += np.log10(np.where(came == 1, p, 1 - p))
                    whole = np.rint(total * UNIT).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys[at].view(np.int64)), pa.array(m[at]), pa.array(whole)], names=["key", "m", "score"])

        return _dealt(grams.select("key", "n", "m")).mapInArrow(run, "key long, m long, score long")

    def compute(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of the lowest bytes after the others, without those known from before."""
        grams = self.grams.df
        new = grams.sparkSession.createDataFrame([(int(k),) for k in np.unique(keys)], "key long")
        rows = grams.select("key", "n", F.lit(0).cast("long").alias("m")).unionAll(new.select("key", F.lit(0).cast("long"), F.lit(1).cast("long")))
        got = self.scored(rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))).where("m > 0").collect()
        value = {r.key: r.score / UNIT for r in got}
        return np.array([value[int(k)] for k in keys])

    def log10(self, keys: np.ndarray) -> np.ndarray:
        new = np.array([k for k in keys if int(k) not in self._known], dtype=np.uint64)
        if len(new):
            self._known.update(zip(map(int, new), self.compute(new).tolist(), strict=True))
        return np.array([self._known[int(k)] for k in keys])


class _Head:
    """The values of the most frequent n-grams, in two tables by different hashes; an n-gram with no place in either is looked for elsewhere."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self._tables = keys, values, None

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        (self.keys, self.values), self._tables = state, None

    @staticmethod
    def _at(keys: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(factor)) >> np.uint64(64 - _HEAD_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; indexes of the keys without one)."""
        if self._tables is None:
            self._tables, left = [], np.arange(len(self.keys))
            for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                at = self._at(self.keys[left], factor)
                own, value = np.full(1 << _HEAD_BITS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << _HEAD_BITS)
                own[at[::-1]], value[at[::-1]] = self.keys[left][::-1], self.values[left][::-1]  # the first, more frequent one stays
                self._tables.append((factor, own, value))
                left = left[own[at] != self.keys[left]]
        out, missed = np.zeros(len(keys)), np.arange(len(keys))
        for factor, own, value in self._tables:
            at = self._at(keys[missed], factor)
            found = own[at] == keys[missed]
            out[missed[found]] = value[at[found]]
            missed = missed[~found]
        return out, missed


def _head(scored: DataFrame) -> _Head:
    """The most frequent n-grams, GRAM_HEAD at most: those from some frequency on."""
    step = F.floor(F.log2("m") * 16)
    least, n = None, 0
    for r in sorted(scored.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("m").alias("least")).collect(), key=lambda r: -r.step):
        n += r.n
        if n > GRAM_HEAD:
            break
        least = r.least
    def packed(batches):
        for batch in batches:
            blobs = [pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(blobs, names=["key", "m", "score"])

    top = scored.where(F.col("m") >= least if least is not None else F.lit(False)).select("key", "m", "score")
    got = top.mapInArrow(packed, "key binary, m binary, score binary").collect()
    keys, m, score = (np.frombuffer(b"".join(r[k] for r in got), dtype=np.int64) for k in range(3))
    order = np.lexsort((keys, -m))
    return _Head(keys[order].view(np.uint64), score[order].astype(np.float64))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cells(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(mixed, -8, 7.999) + 8) * ((CELLS - 1) / 16)
    low = place.astype(np.int64)
    return low, place - low


def _summed(kind_of_key):
    """Adds up keys of batches' texts in memory and sends each distinct one with its count now and then."""

    def run(batches):
        waiting, n = [], 0

        def send():
            key, count = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            learned = batch.column(1).to_numpy(zero_copy_only=False)
            for a, e in chunks(offsets):
                waiting.append(kind_of_key(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], learned[a:e]))
                n += len(waiting[-1])
                if n >= _GATHER:
                    yield send()
                    waiting, n = [], 0
        if waiting:
            yield send()

    return run


def _word_keys(data, offsets, learned):
    return np.concatenate([word_hashes(data, offsets)[0], np.full(len(offsets) - 1, _END)])


def _marked_grams(data, offsets, learned):
    key, row = gram_keys(data, offsets)
    return key | np.where(learned, _LEARNED, np.uint64(0))[row]


def _summed_keys(texts: DataFrame, kind_of_key) -> DataFrame:
    return texts.mapInArrow(_summed(kind_of_key), "key long, n long")


def _dealt(grams: DataFrame, whole_slices: bool = False) -> DataFrame:
    """The n-grams in tasks that hold all those of a two-byte context, or of a slice, in the order of mixed contexts and keys."""
    mixed = (F.shiftright("key", 8).bitwiseAND(0xFFFF) * _MIX).bitwiseAND(0xFFFF)
    return grams.repartition(F.floor(mixed * SLICES / 65536) if whole_slices else mixed).sortWithinPartitions(mixed, "key")


def _learned(grams: DataFrame, low, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights, by online updates over each slice's n-grams, averaged by the slices' shares of all occurrences (`mass`); and what share of bits were 1 where the mix said so much, for each gate."""
    gates, size = GATES + ORDERS * PLACES, GATES * CELLS

    def learn(batches):
        total, shares, now, own, weights = np.zeros((gates, ORDERS), dtype=np.int64), 0, None, 0.0, None
        seen = np.zeros((2, size), dtype=np.int64)

        def done():
            share = int(own * SHARE / mass)
            return np.rint(weights * UNIT).astype(np.int64) * share, share

        for part, counts, _ in _blocks(batches, low.value):
            if part != now:
                if now is not None:
                    more, share = done()
                    total, shares = total + more, shares + share
                now, own, weights = part, 0.0, _start()
            mixed_up = np.random.default_rng(len(counts.n)).permutation(np.flatnonzero(counts.n))
            own += counts.n.sum()
            for k in range(0, len(mixed_up), BATCH):
                at = mixed_up[k : k + BATCH]
                n = counts.n[at]
                for bit in range(8):
                    x, gate, second, came = counts.inputs(at, bit, True)
                    mixed = _mixed(x, weights, gate, second)
                    cell, part_ = _cells(mixed)
                    upper = np.rint(part_ * n * FINE)
                    place, w = gate * CELLS + cell, n * FINE - upper
                    np.add.at(seen[0], place, w.astype(np.int64))
                    np.add.at(seen[0], place + 1, upper.astype(np.int64))
                    np.add.at(seen[1], place, (w * came).astype(np.int64))
                    np.add.at(seen[1], place + 1, (upper * came).astype(np.int64))
                    error = (came - _squash(mixed)) * n
                    both = np.concatenate([gate, second])
                    times = np.maximum(np.bincount(both, weights=np.tile(n, 2), minlength=gates), 1)
                    for order in range(ORDERS):
                        weights[:, order] += RATE * np.bincount(both, weights=np.tile(error * x[order], 2), minlength=gates) / times
        if now is not None:
            more, share = done()
            cells = np.concatenate([(total + more).ravel(), [shares + share], seen.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "sum"])

    start = np.tile(_squash(np.linspace(-8, 8, CELLS)), GATES)
    if not mass:
        return _start(), start.reshape(GATES, CELLS)
    dealt = _dealt(grams.where("n > 0").select("key", "n", F.lit(0).cast("long").alias("m")), whole_slices=True)
    got = np.zeros(gates * ORDERS + 1 + 2 * size, dtype=np.int64)
    for r in dealt.mapInArrow(learn, "cell long, sum long").groupBy("cell").agg(F.sum("sum").alias("sum")).collect():
        got[r.cell] = r["sum"]
    shares, (every, ones) = int(got[gates * ORDERS]), got[gates * ORDERS + 1 :].reshape(2, size) / FINE
    weights = (got[: gates * ORDERS] / UNIT / shares).reshape(gates, ORDERS) if shares else _start()
    return weights, ((ones + 4 * start) / (every + 4)).reshape(GATES, CELLS)


def train(texts: DataFrame) -> tuple[Model, Written]:
    """The model of all rows of `texts` (text), and the written counts of their words (key, n).

    Where there is a column `learned`, rows in which it isn't true are only
    counted among the n-grams that are to be scored.  Null texts are empty ones.
    Without rows every bit is as likely as not, and no word is known.
    """
    sc = texts.sparkSession.sparkContext
    small_batches(texts.sparkSession)
    learned = F.coalesce("learned", F.lit(False)) if "learned" in texts.columns else F.lit(True)
    texts = texts.select(F.col("text").cast("string").alias("text"), learned.alias("learned"))
    words = Written(_summed_keys(texts.where("learned"), _word_keys).groupBy("key").agg(F.sum("n").alias("n")))
    n, v = words.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mark = int(_LEARNED)
    marked = _summed_keys(texts, _marked_grams)
    grams = Written(marked.groupBy(F.col("key").bitwiseAND(mark - 1).alias("key")).agg(
        F.sum(F.when(F.col("key") >= mark, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m")
    ))
    low = np.zeros(1 << 16)
    for r in grams.df.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).collect():
        low[r.key] = r.n
    held = sc.broadcast(low)
    weights, refined = _learned(grams.df, held, float(low.sum()))
    held.unpersist()
    return Model(grams, low, weights, refined, {"n": int(n), "v": int(v)}), words


def _listed(keys: np.ndarray, of: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Each row's distinct keys, and how often they come."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(keys))).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=rows))]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(keys[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))


def score_texts(documents: DataFrame, training: Column) -> DataFrame:
    """held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes with the doc_id of every row of `documents`.

    Learns from the rows where `training` (on doc_id) holds.  score: the mixing
    model's log10 probability of the text's bytes and its end; base_score: that
    of its words and its end by their counts, one added to each.  Null texts are
    empty ones: their one token is the end.  Equal texts score equally; other
    columns are not read; no row gives no row.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model, words = train(docs.select("text", training.alias("learned")))
    probable = Written(model.scored(model.grams.df))
    model.grams.drop()
    top = words.df.orderBy(F.desc("n"), "key").limit(HEAD).toPandas().sort_values("key")
    keys = top["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((_head(probable.df), keys[order], top["n"].to_numpy(dtype=np.float64)[order]))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "keys", "times", "grams", "gram_times"]

    def run(batches):
        frequent, head, n = held.value
        gain = np.log10(n + 1)
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for a, e in chunks(offsets):
                rows = e - a
                own, bytes_ = offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]
                gram, row = gram_keys(bytes_, own)
                value, missed = frequent.find(gram)
                score = np.bincount(row, weights=value, minlength=rows)
                grams, gram_times = _listed(gram[missed], row[missed], rows)
                word, row = word_hashes(bytes_, own)
                tokens = np.bincount(row, minlength=rows) + 1
                word, row = np.concatenate([word, np.full(rows, _END)]), np.concatenate([row, np.arange(rows)])
                at = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
                known = head[at] == word if len(head) else np.zeros(len(word), dtype=bool)
                base = np.bincount(row[known], weights=gain[at[known]], minlength=rows)
                rare, times = _listed(word[~known], row[~known], rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(a, rows) for k in range(3)), pa.array(tokens, pa.int64()),
                        pa.array(np.bincount(row[known], minlength=rows), pa.int64()), pa.array(base, pa.float64()), pa.array(score.astype(np.int64)),
                        pa.array(np.diff(own), pa.int64()), rare, times, grams, gram_times,
                    ],
                    names=names,
                )

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score long, n_bytes long, keys array<long>, times array<int>, grams array<long>, gram_times array<int>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~training).alias("held_out"), "text")
    scored = Written(numbered.mapInArrow(run, kind))
    rare = scored.df.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    sums = rare.join(words.df, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    few = scored.df.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("key"), F.col("x.gram_times").alias("times"))
    rest = few.join(probable.df.select("key", "score"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("more_score"))
    fixed = float(np.log10(model.counts["n"] + model.counts["v"] + 1))
    return scored.df.drop("keys", "times", "grams", "gram_times").join(sums, "row", "left").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.counts["n"]).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * fixed).alias("base_score"),
        ((F.col("score") + F.coalesce("more_score", F.lit(0))) / UNIT).alias("score"), "n_bytes",
    )


def held_out_training(divisor: int, rest: int) -> Column:
    return remainder(F.col("doc_id"), divisor) != rest
