"""Supervised subword embeddings: a quality score for every document.

Words, their character n-grams and word pairs have rows in one hashed table of vectors.  A document
is the mean of the vectors of all of them, and a softmax on it gives the classes'
probabilities.  Vectors and softmax are learned together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents.

As the softmax is linear in the mean, scoring needs one number per table row; a
task adds it up once per distinct word it meets, for many new words at a time:
crc32 is linear, so an n-gram's row is the exclusive or of a number per byte.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanvigil.llm.text import each, fold, utf8

#: Table rows of words with their n-grams, and of word pairs.
BUCKETS, PAIRS = 1 << 17, 1 << 17
#: A pair counts about as much as all features of a word do.
PAIR_WEIGHT = 8
DIMENSIONS = 10
GRAMS = (3, 4)
EPOCHS = 5
RATE = 0.6
#: Labelled documents that the model is learned from, at most: the first by the id's crc32.
SAMPLE = 3_000
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
_REMEMBERED = 100_000
#: Text bytes that are scored together, and new words whose rows are found together.
_GROUP_BYTES, _GROUP_WORDS = 256 << 10, 4096


def word_features(word: bytes) -> list[int]:
    """Table rows of a word: its own and those of its n-grams, edges marked."""
    marked = b"<" + word + b">"
    rows = [zlib.crc32(marked) % BUCKETS]
    for n in GRAMS:
        rows += [zlib.crc32(marked[i : i + n]) % BUCKETS for i in range(len(marked) - n + 1)]
    return rows


def pair_rows(codes: np.ndarray) -> np.ndarray:
    """Table row of each pair of neighbouring words, from the words' codes.

    Pairs of equal words share the last row, so that words never learned from still
    count as repeated.
    """
    x = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x >>= np.uint64(32)
    x &= np.uint64(PAIRS - 1)  # a power of two
    return BUCKETS + np.where(codes[:-1] == codes[1:], PAIRS, x.astype(np.int64))


def document_features(text: bytes, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text with their shares of all its features."""
    words = text.split()
    rows: list[int] = []
    for word in words:
        found = known.get(word)
        if found is None:
            if len(known) >= _REMEMBERED:
                known.clear()
            found = known[word] = word_features(word)
        rows += found
    pairs = pair_rows(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    distinct, counts = np.unique(np.concatenate([np.array(rows, np.int64), np.repeat(pairs, PAIR_WEIGHT)]), return_counts=True)
    return distinct, (counts / max(len(rows) + PAIR_WEIGHT * len(pairs), 1)).astype(np.float32)


class QualityModel:
    """Vectors (table rows), class weights and class biases."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1, 1, (BUCKETS + PAIRS + 1, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        self.weights = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32) / DIMENSIONS
        self.bias = np.zeros(2, np.float32)

    def learn(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> QualityModel:
        rng, known = np.random.default_rng(seed), {}
        features = [document_features(t, known) for t in texts]
        known.clear()
        target = np.eye(2, dtype=np.float32)
        step, steps = 0, max(epochs * len(texts), 1)
        for _ in range(epochs):
            for n in rng.permutation(len(texts)):
                rows, shares = features[n]
                pace = np.float32(rate * (1 - step / steps))
                step += 1
                mean = shares @ self.table[rows]
                logits = mean @ self.weights + self.bias
                chance = np.exp(logits - logits.max())
                error = chance / chance.sum() - target[labels[n]]
                back = self.weights @ error
                self.weights -= pace * np.outer(mean, error)
                self.bias -= pace * np.float32(0.1) * error
                # Shares of one text are small; its rows move by their root so that rare n-grams learn too.
                self.table[rows] -= (pace * np.sqrt(shares))[:, None] * back[None, :]
        return self

    def scalars(self) -> tuple[np.ndarray, float]:
        """Per table row its part of the log odds of class 1, and the odds of no words."""
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def _byte_parts(n: int) -> list[np.ndarray]:
    """Per place in an n-gram what each byte there adds to its crc32."""
    zeros = bytes(n)
    base = zlib.crc32(zeros)
    parts = [np.array([zlib.crc32(zeros[:i] + bytes([b]) + zeros[i + 1 :]) ^ base for b in range(256)], np.uint32) for i in range(n)]
    parts[0] ^= np.uint32(base)
    return parts


_BYTE_PARTS = {n: _byte_parts(n) for n in GRAMS}


def word_sums(words: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the sum of ``parts`` at the rows of ``word_features``, and their number."""
    body = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(body))
    sums = parts[np.array([zlib.crc32(b"<" + word + b">") % BUCKETS for word in words], np.int64)]
    counts = np.ones(len(words), np.int64)
    for n, tables in _BYTE_PARTS.items():
        at = np.flatnonzero(left >= n)
        rows = tables[0][body[at]]
        for i in range(1, n):
            rows ^= tables[i][body[at + i]]
        sums += np.bincount(owner[at], weights=parts[rows & np.uint32(BUCKETS - 1)], minlength=len(words))
        counts += np.maximum(sizes - n + 1, 0)
    return sums, counts


class _Known(dict):
    """Numbers of the words a task has met; ``new`` are those without sums yet."""

    def __init__(self, parts: np.ndarray, start: float):
        self.parts, self.start = parts, start
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.sums, self.counts, self.codes = array("d"), array("q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number

    def places(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        """Scores of texts from the numbers of their words."""
        for i in range(0, len(self.new), _GROUP_WORDS):
            words = self.new[i : i + _GROUP_WORDS]
            sums, counts = word_sums(words, self.parts)
            self.sums.frombytes(sums.tobytes())
            self.counts.frombytes(counts.tobytes())
            self.codes.extend(map(zlib.crc32, words))
        self.new = []
        lengths = np.array([len(at) for at in places], np.int64)
        odds = np.full(len(places), self.start)
        if lengths.any():
            at, owner = np.concatenate(places), np.repeat(np.arange(len(places)), lengths)
            total = np.bincount(owner, np.frombuffer(self.sums)[at], len(places))
            number = np.bincount(owner, np.frombuffer(self.counts, np.int64)[at], len(places))
            inside = owner[1:] == owner[:-1]  # no pair of words from two texts
            pairs = self.parts[pair_rows(np.frombuffer(self.codes, np.uint64)[at])[inside]]
            total += PAIR_WEIGHT * np.bincount(owner[1:][inside], pairs, len(places))
            number += PAIR_WEIGHT * np.maximum(lengths - 1, 0)
            odds += total / np.maximum(number, 1)
        if len(self) > _REMEMBERED:
            self.forget()
        return 1 / (1 + np.exp(-np.clip(odds, -500.0, 500.0)))


def _score(parts: np.ndarray, start: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(parts, start)
        for batch in batches:
            found, places, held = [np.empty(0)], [], 0
            for (text,) in each(batch, 1):
                places.append(known.places(text))
                held += len(text)
                if held >= _GROUP_BYTES:
                    found.append(known.scores(places))
                    places, held = [], 0
            found.append(known.scores(places))
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learn from at most ``sample`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) % FOLDS != HELD_FOLD))
    marks = usable.groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    chosen = F.broadcast(marks.orderBy(fold("_id"), "_id").limit(sample))  # ids and labels of the sample only
    rows = docs.select(F.col(key).alias("_id"), utf8(text).alias("_body")).join(chosen, "_id").select("_id", "_body", "_label")
    found = sorted(((r[0], bytes(r[1]), r[2]) for r in rows.collect()), key=lambda r: r[:2])
    return QualityModel().learn([r[1] for r in found], [r[2] for r in found])


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", model: QualityModel | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``score`` is the probability of class 1; a text without words (or null) gets the
    class share the biases learned.  Labels other than 0 and 1 and null ids are not
    learned from; an id labelled twice counts with its larger label.  Without any
    label every score is near 0.5.  Repeated rows are scored each, null ids stay
    null and are not held out.  An empty table gives an empty result.
    """
    model = model or train(docs, labels, text, key)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        utf8(text).alias("body"),
        F.coalesce(fold(key) % FOLDS == HELD_FOLD, F.lit(False)).alias("held_out"),
    )
    return rows.mapInArrow(_score(*model.scalars()), "doc_id long, held_out boolean, score double, predicted int")
