"""Language identification with bit-sliced Bloom filters over byte n-grams.

Learning counts the 4-grams of every labelled text (lower-cased, digits and punctuation as spaces). A language holds
an n-gram if it uses it at least KEEP times as often, relative to its own n-grams, as the language that uses it most,
so stray foreign passages and wrong labels do not fill the filters. Each language has a Bloom filter with two hashes, as
long as the language with most n-grams needs: SLOTS_PER_GRAM bits for each of them, up to the next power of two, so the
false-positive rate has the same bound (0.05) at every size; the filters lie bit-sliced, one language mask per slot, so one AND of two masks returns all languages that
hold an n-gram. A text's popcount per language, corrected for the filter's false-positive rate, decides.

Only the slot masks reach the driver (one row per slot in use and eight languages), never the n-grams.

Defined results: NULL texts and texts without a letter are `und` with score 0; a text none of whose n-grams is known
gets the language with most learned n-grams and score 0; ties go to the language name first in order; without any
labelled row everything is `und`. lang, source and doc_id are never read in a prediction.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stash
from .text import as_bytes, crc_mod, documents, slices

SLOTS_LOG2 = 20         # of the smallest filter
SLOTS_PER_GRAM = 8
KEEP = 0.125            # least relative use, against the language that uses the n-gram most
LEAST = 2               # least count of an n-gram in a language
WORD_BITS = 8           # languages per mask
LETTER = regex.compile(r"\p{L}")
_BITS = (np.arange(1 << WORD_BITS)[:, None] >> np.arange(WORD_BITS)) & 1
# space for every ASCII byte that is no letter, lower case for A-Z
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of all texts as unsigned 32-bit numbers, the text each one belongs to)."""
    parts = [b"  " + b" ".join(t.translate(_CLASS).split()) + b"  " if t else b"" for t in texts]
    joined = b"".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    code = np.ndarray((max(0, len(joined) - 3),), "<u4", joined, 0, (1,))
    ends = np.cumsum(lengths)
    inside = np.ones(len(code), bool)
    for i in (1, 2, 3):                             # those that run over the end of a text
        at = ends - i
        inside[at[(at >= 0) & (at < len(code))]] = False
    return code[inside], np.repeat(np.arange(len(parts), dtype=np.int32), np.maximum(lengths - 3, 0))


def slots(code: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    x = code.astype(np.uint64)
    shift = np.uint64(64 - log2)
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), \
           (((x + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang: str, kept: int = 0):
        code, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)],
                                          ["lang", "gram", "n"])

    for batch in slices(batches):
        langs, texts = batch.column("lang").to_pylist(), as_bytes(batch)
        for lang in sorted(set(langs)):
            code, n = np.unique(grams([t for t, l in zip(texts, langs) if l == lang])[0], return_counts=True)
            if lang in held:
                old, m = held[lang]
                code, at = np.unique(np.concatenate([old, code]), return_inverse=True)
                n = np.bincount(at, np.concatenate([m, n]), len(code)).astype(np.int64)
            held[lang] = code, n
            if len(code) > 1 << 20:
                yield flush(lang)
    for lang in sorted(held):
        yield flush(lang)


class Filters:
    """The learned languages and their bit-sliced Bloom filters."""

    def __init__(self, languages: list[str], masks: np.ndarray, fallback: str):
        self.languages, self.masks, self.fallback = languages, masks, fallback     # masks: [words, slots]
        self.log2 = masks.shape[1].bit_length() - 1
        self.false_rate = np.array([((masks[i // WORD_BITS] >> np.uint8(i % WORD_BITS)) & 1).mean() ** 2 for i in range(len(languages))])

    def popcounts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, n-grams of each text per language as returned by the filters)."""
        code, owner = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        first, second = slots(code, self.log2)
        hits = []
        for table in self.masks:                    # how often each mask comes back per text, then bits of the masks
            both = table[first] & table[second]
            seen = np.bincount(owner.astype(np.int64) << WORD_BITS | both, minlength=len(texts) << WORD_BITS)
            hits.append(seen.reshape(len(texts), -1) @ _BITS)
        hits = np.concatenate(hits, axis=1)[:, :len(self.languages)] if hits else np.zeros((len(texts), 0))
        return n, hits

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        n, hits = self.popcounts(texts)
        share = (hits - n[:, None] * self.false_rate) / (np.maximum(n, 1)[:, None] * np.maximum(1e-9, 1 - self.false_rate))
        out = []
        for text, row in zip(texts, share):
            if not text or not len(row) or not LETTER.search(text.decode("utf-8", "replace")):
                out.append(("und", 0.0))
            elif row.max() <= 0:
                out.append((self.fallback, 0.0))
            else:
                out.append((self.languages[int(row.argmax())], float(min(1.0, row.max()))))
        return out


def learn(labelled: DataFrame) -> Filters:
    """Filters from labelled(text, lang); rows without text or lang are left out."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = stash(rows.mapInArrow(_count, "lang string, gram long, n long")
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one per language
    if not totals:
        return Filters([], np.zeros((0, 1 << SLOTS_LOG2), np.uint8), "und")
    languages = sorted(totals)
    lookup = counts.sparkSession.createDataFrame(
        [(lang, i, float(totals[lang])) for i, lang in enumerate(languages)], "lang string, i int, total double")
    used = F.col("n") / F.col("total")
    chosen = stash(counts.join(F.broadcast(lookup), "lang").withColumn("use", used)         # one row per language
                   .withColumn("most", F.max("use").over(Window.partitionBy("gram")))
                   .where((F.col("use") >= KEEP * F.col("most")) & (F.col("n") >= LEAST)).select("gram", "i"), "chosen")
    largest = chosen.groupBy("i").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("k")).first()["k"] or 0
    log2 = max(SLOTS_LOG2, (SLOTS_PER_GRAM * largest - 1).bit_length())
    slot_rows = chosen.mapInArrow(lambda batches: _set_bits(batches, log2), "word int, slot int, mask long")
    masks = np.zeros((-(-len(languages) // WORD_BITS), 1 << log2), np.uint8)
    for part in slot_rows.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        word, slot, mask = (c.to_numpy(zero_copy_only=False) for c in part.columns)
        masks[word, slot] = mask
    return Filters(languages, masks, max(languages, key=lambda x: (totals[x], x)))


def _set_bits(batches: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, i = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        both = np.concatenate(slots(code.astype(np.uint32), log2))
        i = np.concatenate([i, i])
        key, at = np.unique(i.astype(np.int64) // WORD_BITS << log2 | both, return_inverse=True)
        mask = np.zeros(len(key), np.int64)
        np.bitwise_or.at(mask, at, np.int64(1) << (i % WORD_BITS).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array((key >> log2).astype(np.int32)), pa.array((key & (1 << log2) - 1).astype(np.int32)),
                                          pa.array(mask)], ["word", "slot", "mask"])


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score of every row, from its text alone."""
    model = docs.sparkSession.sparkContext.broadcast(filters)       # a byte per slot and eight languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = model.value.predict(as_bytes(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in got], pa.string()),
                                              pa.array([b for _, b in got], pa.float64())], [key, "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return documents(docs, "doc_id", "text", "lang").where(crc_mod(F.col("doc_id"), 4) != 2)


def predict_digest(docs: DataFrame) -> DataFrame:
    out = predict(documents(docs, "doc_id", "text"), learn(training_rows(docs)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The documents whose language is identified; those that are `und`, or of whose n-grams the best language holds
    less than `least`, go. Columns as in `docs`."""
    filters = learn(training_rows(docs))
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [a != "und" and b >= least for a, b in model.value.predict(as_bytes(batch))]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
