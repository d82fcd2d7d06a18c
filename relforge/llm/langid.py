"""Operator 4: nearest-centroid language identification.

A text's vector counts its letter trigrams (hashed, upper case folded, anything
but letters a space), damped, weighted by inverse document frequency and scaled
to length 1.  Each language has several centroids, found by spherical k-means.
A text takes the language of the centroid with the largest cosine; where that
is further off than the language's own training texts ever are, it is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, text_buffers
from .runtime import remainder, small_batches
from .sampling import chosen, class_counts

#: Buckets of hashed trigrams, as a power of two.
BITS = 12
#: Training texts in all, and of each language (at least LEAST_PER_LANGUAGE of many languages).
SAMPLE, PER_LANGUAGE, LEAST_PER_LANGUAGE = 4000, 800, 16
CENTROIDS, ROUNDS = 4, 8
#: A language rejects what is below this part of the cosine that all but 1 of 200 of its training texts reach;
#: a text with fewer than FULL different trigrams can't come as close, and its bound falls with the root of their number.
SLACK, TAIL, FULL = 0.5, 0.005, 400
_ROWS = 256

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x 2**BITS counts; each text has a space before and after it."""
    rows = len(offsets) - 1
    wide = np.full(len(data) + rows + 2, 32, dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    wide[place] = _FOLD[data]
    latin = (wide[:-1] == 0xC3) & (wide[1:] >= 0x80) & (wide[1:] <= 0x9E) & (wide[1:] != 0x97)
    wide[1:][latin] += 0x20
    key = wide[:-2].astype(np.uint32) << np.uint32(16) | wide[1:-1].astype(np.uint32) << np.uint32(8) | wide[2:]
    slot = (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    row = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    use = wide[1:-1] != 32
    use &= np.append(np.diff(row) == 0, False)[: len(use)] | (wide[2:] == 32)
    at = row[: len(use)][use] << BITS | slot[use].astype(np.int64)
    return np.bincount(at, minlength=rows << BITS).reshape(rows, 1 << BITS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(norm > 0, norm, 1)[:, None]


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """Rows of trigram counts, sorted, so that their order doesn't depend on how they came."""
    return np.frombuffer(b"".join(sorted(map(zlib.decompress, packed))), dtype=np.uint16).reshape(len(packed), -1)


def has_letter(text: pa.Scalar) -> bool:
    return text.is_valid and any(c.isalpha() for c in text.as_py())


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # each of length 1
    language: list[str]  # of each centroid
    least: np.ndarray  # cosine below which each centroid's language rejects

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, whether it is too low) of each row."""
        cosine = _vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        evidence = np.sqrt(np.minimum(1.0, (counts > 0).sum(axis=1) / FULL))
        return best, top, top < self.least[best] * evidence


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """At most k unit vectors by spherical k-means that starts from the texts furthest from each other."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    start = [unit(x.mean(axis=0))]
    while len(start) < min(k, len(x)):
        start.append(x[(x @ np.array(start).T).max(axis=1).argmin()])
    centers = np.array(start)
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        centers = np.array([unit(x[own == c].mean(axis=0)) if (own == c).any() else centers[c] for c in range(len(centers))])
    used = np.unique((x @ centers.T).argmax(axis=1))
    return centers[used]


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of `labelled` (doc_id, text, lang); None if it has no row with text and lang.

    About `sample` texts are used, or LEAST_PER_LANGUAGE of each language if
    these are more, by a hash of id and text; every language is learned.  Only
    their trigram counts come to the driver, 2**BITS small integers each,
    compressed; they are unpacked and turned into vectors one language at a
    time, so that beside them the driver holds some 64 kB of centroids for each
    language and the vectors of one.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = class_counts(rows.select("lang"), "lang")
    if not counts:
        return None
    per = max(LEAST_PER_LANGUAGE, min(PER_LANGUAGE, sample // len(counts)))
    few = chosen(rows.withColumn("mark", F.xxhash64("doc_id", "text")), "lang", F.col("mark"), counts, per).dropDuplicates(["mark", "lang"])

    def vectors(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, e in _row_chunks(offsets):
                got = np.minimum(trigram_counts(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, e - a), pa.array([zlib.compress(r.tobytes(), 1) for r in got], pa.binary())], names=["lang", "counts"])

    packed: dict[str, list[bytes]] = {}
    for r in few.select("text", "lang").mapInArrow(vectors, "lang string, counts binary").collect():
        packed.setdefault(r[0], []).append(bytes(r[1]))
    if not packed:
        return None
    texts, holding = 0, np.zeros(1 << BITS, dtype=np.int64)
    for own in packed.values():
        texts += len(own)
        holding += (_unpacked(own) > 0).sum(axis=0)
    idf = np.log((1 + texts) / (1 + holding)).astype(np.float32) + 1
    centroids, language, least = [], [], []
    for name in sorted(packed):
        raw = _unpacked(packed.pop(name))
        raw = raw[raw.any(axis=1)]
        own = np.empty(raw.shape, dtype=np.float32)
        for a in range(0, len(raw), _ROWS):
            own[a : a + _ROWS] = _vectors(raw[a : a + _ROWS], idf)
        if not len(own):
            continue
        centers = _centroids(own, CENTROIDS)
        reach = np.quantile((own @ centers.T).max(axis=1), TAIL)
        centroids += list(centers)
        language += [str(name)] * len(centers)
        least += [SLACK * float(reach)] * len(centers)
    if not centroids:
        return None
    return Model(idf, np.array(centroids, dtype=np.float32), language, np.array(least))


def _row_chunks(offsets: np.ndarray):
    for a, e in chunks(offsets):
        for k in range(a, e, _ROWS):
            yield k, min(k + _ROWS, e)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """`documents` with lang_pred, score (cosine, 0 to 1) and rejected; needs a string column text.

    A null text, one without a letter, and any text if nothing was learned get
    'und', score 0 and rejected; a very long text is counted whole.  The text
    alone decides; rows, repeated ones too, and other columns stay; columns with
    those names, in whatever case, are replaced.  No row gives no row.
    """
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    kept = documents.select(*(F.col(f"`{c.replace('`', '``')}`") for c in names))
    at = [c.lower() for c in names].index("text")

    def run(batches):
        m = held.value
        for batch in batches:
            text = batch.column(at)
            data, offsets = text_buffers(text)
            lang, score, out = [], [], []
            for a, e in _row_chunks(offsets):
                own, bytes_ = offsets[a : e + 1] - offsets[a], data[offsets[a] : offsets[e]]
                seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[bytes_])])
                letter = seen[own[1:]] > seen[own[:-1]]
                for k in np.flatnonzero(~letter):
                    letter[k] = has_letter(text[a + k])
                if m is None:
                    letter[:] = False
                    best, cosine, far = np.zeros(e - a, dtype=int), np.zeros(e - a), np.ones(e - a, dtype=bool)
                else:
                    best, cosine, far = m.predict(trigram_counts(bytes_, own))
                for ok, b, c, f in zip(letter.tolist(), best.tolist(), np.clip(cosine, 0, 1).tolist(), far.tolist(), strict=True):
                    lang.append(m.language[b] if ok else "und")
                    score.append(c if ok else 0.0)
                    out.append(not ok or f)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(divisor: int, rest: int):
    return remainder(F.col("doc_id"), divisor) == rest
