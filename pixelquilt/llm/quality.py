"""Quality rules: counts of a text, and a calibrated logistic regression over hashed word and character n-grams.

The classifier is fitted on a bounded sample of the labelled rows (TRAIN_ROWS, those with the smallest hash of their
id, whole texts), four fifths for the weights and one fifth for the calibration (a logistic curve on the score).
Scoring is one Arrow pass over whole texts against fixed thresholds.

Features: share of each word, each pair of neighbouring words and each run of four characters (code points) among all of
these in the text, hashed to 2^BITS. They are taken from the one text only and added in its order, so equal texts have
bitwise equal probabilities wherever they stand.

Defined results: NULL texts count as empty (0 words, base_failed); without labels of both classes the verdict is the
base rules' alone; NULL labels or ids are not learned from; labels are joined by id, repeated labels and ids count as rows (of the bound).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Words, as_bytes, documents, mixed, slices, window_hashes

TRAIN_ROWS = 3000       # labelled rows that the classifier is fitted on
BITS = 18
SCALE = 30.0            # of the shares of the features; sets the pace of the fit
KEEP_AT = 0.4           # least calibrated probability of good quality
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
CHARACTERS = 4

_SYMBOL = np.isin(np.arange(256), list(b"[#*$%&|<>]"[1:-1]))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_WORD_START = ((np.arange(256) & 0xC0) != 0x80) & ~_SPACE        # bytes that begin a code point of a word


class Batch:
    """The words and bytes of some texts, laid out one after the other."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        words = Words(self.texts)
        self.n_words, self.hashes, self.owner = words.counts, words.hashes, words.owner
        self.bytes, self.byte_owner = words.bytes, words.byte_owner()       # a space follows each text

    def _per_text(self, mark: np.ndarray) -> np.ndarray:
        return np.bincount(self.byte_owner[mark], minlength=len(self.texts))

    def base_counts(self) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] for t in self.texts]
        return [self.n_words, self._per_text(_WORD_START[self.bytes]), self._per_text(_SYMBOL[self.bytes]),
                np.array([len(x) - len(set(x)) for x in lines], np.int64), self._repeated()]

    def _repeated(self) -> np.ndarray:
        """Words inside windows of WINDOW words that the same text holds at least twice."""
        windows = window_hashes(self.hashes, WINDOW)
        at = np.flatnonzero(self.owner[:len(windows)] == self.owner[len(self.owner) - len(windows):])
        key = mixed(windows[at] ^ mixed(self.owner[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(self.owner) + 1, np.int64)
        edge[at[twice]] += 1
        edge[at[twice] + WINDOW] -= 1
        covered = np.cumsum(edge)[:-1] > 0
        return np.bincount(self.owner[covered], minlength=len(self.texts))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashed feature, its text) of every occurrence, and the number of occurrences per text."""
        shift, n = np.uint64(64 - BITS), len(self.owner)
        pairs = np.flatnonzero(self.owner[:-1] == self.owner[1:]) if n > 1 else np.zeros(0, np.int64)
        double = mixed(self.hashes[pairs] + mixed(self.hashes[pairs + 1])) if n > 1 else self.hashes[:0]
        four, four_owner = self._characters()
        slot = np.concatenate([mixed(self.hashes + np.uint64(3)) >> shift, double >> shift, four >> shift]).astype(np.int32)
        owner = np.concatenate([self.owner, self.owner[pairs], four_owner])
        return slot, owner, np.bincount(owner, minlength=len(self.texts))

    def _characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of CHARACTERS code points inside one text."""
        first = np.flatnonzero((self.bytes & 0xC0) != 0x80)             # the space after each text begins one as well
        size = np.diff(first, append=len(self.bytes)).astype(np.uint64)
        raw = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        point = np.ndarray((len(self.bytes),), "<u4", raw, 0, (1,))[first] & (np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1)
        owner = self.byte_owner[first]
        # a run ends before the space that follows its text
        n = len(first) - CHARACTERS
        at = np.flatnonzero(owner[:n] == owner[CHARACTERS:]) if n > 0 else np.zeros(0, np.int64)
        h = np.zeros(len(at), np.uint64)
        for i in range(CHARACTERS):
            h = (h + point[at + i] + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(h), owner[at]


class Classifier:
    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def scores(self, slot: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(n))
        return SCALE * np.bincount(owner, self.weights[slot], len(n)) / np.maximum(1, n) + self.bias

    def probabilities(self, slot: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(n))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(slot, owner, n) + self.shift, -40, 40)))


def _logistic(index: np.ndarray, owner: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, rounds: int = 30):
    """Weights and bias by gradient steps with per-weight step sizes; fixed order, no randomness."""
    w, g2, bias, b2, n = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8, len(y)
    for _ in range(rounds):
        z = np.bincount(owner, w[index] * value, n) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.bincount(index, err[owner] * value, size) + 1e-6 * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
        b2 += err.sum() ** 2
        bias -= 0.3 * err.sum() / np.sqrt(b2)
    return w, float(bias)


def fit(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Classifier:
    """found: (features, occurrences) of each training row; every fifth row calibrates."""
    test = np.arange(len(y)) % 5 == 4
    if len(set(y[~test].tolist())) < 2:
        return Classifier()

    def joined(part):
        lengths = np.array([len(f) for f, _ in part])
        return np.concatenate([f for f, _ in part]), np.repeat(np.arange(len(part)), lengths), \
            np.concatenate([SCALE * c / max(1, c.sum()) for _, c in part]).astype(np.float32)

    index, owner, value = joined([f for f, t in zip(found, test) if not t])
    w, bias = _logistic(index, owner, value, y[~test].astype(float), 1 << BITS)
    model = Classifier(w.astype(np.float32), bias)
    if len(set(y[test].tolist())) < 2:
        return model
    index, owner, value = joined([f for f, t in zip(found, test) if t])
    scores = np.bincount(owner, w[index] * value, int(test.sum())) + bias
    centre, spread = scores.mean(), max(scores.std(), 1e-6)
    z, goal = (scores - centre) / spread, y[test].astype(float)
    n1, n0 = goal.sum(), (1 - goal).sum()
    goal = np.where(goal > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))       # smoothed goals keep the curve finite
    a, b = 1.0, 0.0
    for _ in range(2000):                                              # descent on two numbers, standardised scores
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.5 * (((p - goal) * z).mean() + 1e-3 * a), b - 0.5 * (p - goal).mean()
    model.slope, model.shift = float(max(a, 1e-3) / spread), float(b - max(a, 1e-3) * centre / spread)
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=256):
        slot, owner, _ = Batch(as_bytes(batch)).features()
        key, n = np.unique(owner.astype(np.int64) << BITS | slot, return_counts=True)
        cut = np.searchsorted(key, np.arange(1, len(batch), dtype=np.int64) << BITS)
        found = [x.astype(np.int32).tobytes() for x in np.split(key & ((1 << BITS) - 1), cut)]
        counts = [x.astype(np.int32).tobytes() for x in np.split(n, cut)]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("good"), pa.array(found, pa.binary()),
                                          pa.array(counts, pa.binary())], ["place", "good", "found", "counts"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Classifier from labels(doc_id, quality) and docs(doc_id, text); at most `rows` labelled rows are read."""
    chosen = (documents(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
              .select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("place"), (F.col("quality") > 0).alias("good"))
              .orderBy("place", "good").limit(rows))                   # at most TRAIN_ROWS rows of three numbers
    sample = (documents(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
              .select("place", "good", "text").mapInArrow(_features_of, "place long, good boolean, found binary, counts binary"))
    bounded = sample.orderBy("place", "good", "found", "counts").limit(rows)                  # an id may stand in many rows
    table = sorted((r["place"], r["good"], bytes(r["found"]), bytes(r["counts"])) for r in bounded.collect())
    return fit([(np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for _, _, f, c in table],
               np.array([g for _, g, _, _ in table], bool))


def judge(docs: DataFrame, model: Classifier, key: str = "doc_id") -> DataFrame:
    """Counts, probability of good quality and verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)            # 2^BITS weights
    kind = dict(docs.dtypes)[key]
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            part = Batch(as_bytes(batch))
            counts, p = part.base_counts(), m.probabilities(*part.features())
            failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > REPEAT_PERCENT * counts[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, [*counts, failed, ~failed & (p >= KEEP_AT), p])],
                                             names)

    return docs.select(key, "text").mapInArrow(
        run, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, probability double")


def judge_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents(docs, "doc_id", "text"), train(docs, labels))
