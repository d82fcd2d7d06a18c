"""Operator 10: toxicity by a weighted lexicon.

Texts are lower-cased, letters that look like Latin ones become them, and in
further readings digits and marks used as letters do too.  An Aho-Corasick
automaton finds the lexicon's entries (whole words, and stems that begin a
word) in all readings; matches inside an exception phrase don't count.  The
sum of weights, normalised by the text's length, gives a score through a
logistic curve.  Weights and curve are learned from labels.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Written, small_batches
from .sampling import labelled_texts

#: Labelled training texts of each class.
PER_CLASS = 4000
#: Lexicon entries learned at most, and candidates looked at (a bound on what comes to the driver).
ENTRIES, CANDIDATES = 500, 20000
#: Stems have so many letters.
STEM = (4, 8)
#: A learned entry has this log odds ratio at least, is in so many toxic texts of the sample, and comes after so many
#: different words there (copies of one text repeat its rare words, but always in their places).
LEAST_ODDS, LEAST_TEXTS, LEAST_NEIGHBOURS = 3.0, 5, 5
#: A text counts as so many words at least, and its length to this power divides the sum of weights.
LEAST_WORDS, LENGTH_POWER = 50, 0.15

# Letters that look like Latin ones, digits and marks used as letters, and words to begin with.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i", "ӏ": "l", "ⅼ": "l", "ⅰ": "i", "ｏ": "o", "ｅ": "e", "ａ": "a", "ｉ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser", "take out the trash", "stupid simple")


def _compatible() -> dict[str, str]:
    """Characters that NFKC makes one Latin letter (full-width, mathematical, circled ...), and full-width digits and marks."""
    folded = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(128, sys.maxunicode + 1))
    return {c: x.lower() for c, x in folded if len(x) == 1 and x.isascii() and (x.isalpha() or "\uff01" <= c <= "\uff5e")}


_HOMOGLYPHS = str.maketrans(_compatible() | HOMOGLYPHS)
_SUBSTITUTES = str.maketrans(SUBSTITUTES)
#: 1 and ! are used as l too.
_AS_L = str.maketrans(SUBSTITUTES | {"1": "l", "!": "l"})
_MIXED = re.compile(r"[^\W\d_][01345789@$!]|[01345789@$!][^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def readings(text: str) -> list[str]:
    """The folded text, and where a substitute touches a letter, the text with these put back, 1 and ! as i and as l; all of equal length."""
    low = text.lower()
    if len(low) != len(text):  # a few letters get longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    if not low.isascii():
        low = low.translate(_HOMOGLYPHS)
    if _MIXED.search(low):
        put = low.translate(_SUBSTITUTES)
        return [low, put, low.translate(_AS_L)] if "1" in low or "!" in low else [low, put]
    return [low]


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    bias: float = -4.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        entries: dict[str, tuple[float, float, bool]] = {}
        for word in {*self.words, *self.stems, *self.exceptions}:
            entries[word] = (self.words.get(word, 0.0), self.stems.get(word, 0.0), word in self.exceptions)
        for word, (whole, stem, exception) in entries.items():
            out.add_word(word, (len(word), whole, stem, exception))
        if entries:
            out.make_automaton()
        return out


def matches(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in `text`; of those that begin at one place the heaviest."""
    if not len(automaton) or not text:
        return []
    best: dict[int, tuple[int, float]] = {}
    shut: set[tuple[int, int]] = set()
    for reading in readings(text):
        for last, (n, whole, stem, exception) in automaton.iter(reading):
            start, end = last - n + 1, last + 1
            if start and reading[start - 1].isalpha():
                continue
            ends = end == len(reading) or not reading[end].isalpha()
            if exception and ends:
                shut.add((start, end))
            weight = max(whole if ends else 0.0, stem)
            if weight > 0 and weight > best.get(start, (0, 0.0))[1]:
                best[start] = (end, weight)
    spans, out, k, reach = sorted(shut), [], 0, 0
    for start in sorted(best):
        while k < len(spans) and spans[k][0] <= start:
            reach = max(reach, spans[k][1])  # the furthest end of an exception that begins no later
            k += 1
        end, weight = best[start]
        if end > reach:
            out.append((start, end, weight))
    return out


def raw_score(text: str, automaton: ahocorasick.Automaton) -> float:
    """The sum of weights, normalised by the text's length."""
    found = matches(text, automaton)
    if not found:
        return 0.0
    words = max(LEAST_WORDS, text.count(" ") + text.count("\n") + 1)
    return sum(w for _, _, w in found) / (words / LEAST_WORDS) ** LENGTH_POWER


def _candidates(batches):
    """(entry, whole, toxic, before): each entry of a text once, with the word before its first place."""
    for batch in batches:
        rows: list[tuple[str, bool, bool, str]] = []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen: dict[tuple[str, bool], str] = {}
            for reading in readings(text or ""):
                before = ""
                for word in _WORD.findall(reading):
                    if 3 <= len(word) <= 20:
                        seen.setdefault((word, True), before)
                    for k in range(STEM[0], min(STEM[1], len(word)) + 1):
                        seen.setdefault((word[:k], False), before)
                    before = word
            rows += [(entry, whole, y == 1, before) for (entry, whole), before in seen.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.bool_(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["entry", "whole", "toxic", "before"])


def learn(documents: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int = PER_CLASS) -> Lexicon:
    """A lexicon from about per_class documents of each value (0 and 1) of labels' column `label` where `training` holds.

    Entries are counted on the executors; at most CANDIDATES of them, and a sum
    of weights for each sampled text, come to the driver.  Without labelled
    texts of both classes the words in SEEDS weigh 1 each.
    """
    small_batches(documents.sparkSession)
    few, counts = labelled_texts(documents, labels, label, training, per_class)
    few = Written(few.select("text", "label")).df  # read three times
    sizes = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon(dict.fromkeys(SEEDS, 1.0))
    found = few.mapInArrow(_candidates, "entry string, whole boolean, toxic boolean, before string")
    kinds = found.groupBy("entry", "whole", "before").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"))
    seen = kinds.groupBy("entry", "whole").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("long")).alias("neighbours"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    seen = seen.where((F.col("t") >= LEAST_TEXTS) & (F.col("neighbours") >= LEAST_NEIGHBOURS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = seen.orderBy(F.desc("t"), F.desc("odds"), "entry", "whole").limit(CANDIDATES).collect()
    stems = {r.entry: (r.t, r.odds) for r in rows if not r.whole}
    words = {r.entry: (r.t, r.odds) for r in rows if r.whole}
    kept: dict[str, float] = {}
    for stem in sorted(stems, key=len):  # a stem gives way to a longer one in about as many texts, and to a shorter one as telling
        t, odds = stems[stem]
        longer = any(s != stem and s.startswith(stem) and stems[s][0] >= 0.95 * t for s in stems)
        shorter = any(stem[:k] in kept and kept[stem[:k]] >= 0.75 * odds for k in range(STEM[0], len(stem)))
        if not shorter and (not longer or len(stem) == STEM[1]):
            kept[stem] = odds
    whole = {w: o for w, (_, o) in words.items() if not any(w[:k] in kept and kept[w[:k]] >= 0.75 * o for k in range(STEM[0], len(w) + 1))}
    top = sorted([(stems[s][0] * o, s, True, o) for s, o in kept.items()] + [(words[w][0] * o, w, False, o) for w, o in whole.items()], reverse=True)[:ENTRIES]
    heaviest = max((o for *_, o in top), default=1.0)
    lexicon = Lexicon(
        {w: 1.0 for w in SEEDS if w not in words and w not in stems} | {w: o / heaviest for _, w, stem, o in top if not stem},
        {w: o / heaviest for _, w, stem, o in top if stem},
    )
    automaton = few.sparkSession.sparkContext.broadcast(lexicon)

    def sums(batches):
        a = automaton.value.automaton()
        for batch in batches:
            raw = [raw_score(x or "", a) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column(1).cast(pa.float64())], names=["raw", "label"])

    got = few.mapInArrow(sums, "raw double, label double").toPandas()
    x, y = got["raw"].to_numpy(), (got["label"] == 1).to_numpy(dtype=float)
    n1, n0 = sum(n for k, n in counts.items() if k == 1), sum(n for k, n in counts.items() if k == 0)
    weight = np.where(y == 1, n1 / toxic, n0 / clean)
    slope, bias = _logistic(x, y, weight / weight.mean())
    return Lexicon(lexicon.words, lexicon.stems, lexicon.exceptions, slope, bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias of a ridge logistic regression, by Newton's method."""
    m, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -50, 50)))
        gradient = m.T @ (weight * (p - y)) + ridge * len(x) * beta * np.array([1, 0.01])
        hessian = (m * (weight * p * (1 - p))[:, None]).T @ m + ridge * len(x) * np.diag([1, 0.01])
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and n_matches of every row of `documents` (doc_id, text).

    Null and empty texts have no match, and the score of a text without one.
    Equal texts score equally; other columns are not read; no row gives no row.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = held.value
        automaton = lex.automaton()
        for batch in batches:
            score, number = [], []
            for text in batch.column(1):
                text = (text.as_py() if text.is_valid else None) or ""
                found = matches(text, automaton)
                words = max(LEAST_WORDS, text.count(" ") + text.count("\n") + 1)
                raw = sum(w for _, _, w in found) / (words / LEAST_WORDS) ** LENGTH_POWER
                score.append(1 / (1 + math.exp(-max(-500.0, min(500.0, lex.slope * raw + lex.bias)))))
                number.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(number, pa.int64())], names=["doc_id", "score", "predicted", "n_matches"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
