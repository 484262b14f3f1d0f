"""Importance resampling towards a target distribution over hashed word and word-pair features.

Features of a text are its words and pairs of neighbouring words; the bucket of a feature is its crc32 modulo BUCKETS.
Corpus and target are counted by bucket, the gain of a bucket is the log ratio of the smoothed shares, the weight of a
document is the mean gain of its features, and a Gumbel draw on the weights picks documents without replacement.

No feature string is built or hashed where it occurs. The distinct words of a slice of texts form a dictionary of
delimiter-bounded patterns whose payload is the word's crc32 and its length; one Aho-Corasick scan of the slice emits
the payloads in text order, and the crc32 of a pair is composed from the two neighbouring payloads
(crc(ab) = crc(a) moved by len(b) bytes, xor crc(b)). A dictionary lives as long as its slice (PIECE bytes of text at
most, cut between words), so memory does not grow with the vocabulary or with the longest text, and a lost task is
simply run again. Counts leave a task as at most BUCKETS rows; the gains are BUCKETS numbers.

Defined results: NULL and empty texts have no features and weight 0; a document with fewer than `least` words is scored
and never drawn; an empty target or corpus counts 0 in every bucket; NULL ids hash as an empty id and come last among
ties; repeated rows are separate documents; `resample` keeps the other columns, a column called rank is replaced.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import numbered
from ..session import stash
from .text import as_bytes, documents, slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25            # of the documents with at least LEAST_WORDS words
SEED = 7
PIECE = 1_000_000       # most bytes that one dictionary is built over

_KEPT = [*range(48, 58), *range(97, 123), *range(128, 256)]            # 0-9, a-z and everything beyond ASCII
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_SPACE_CRC = np.uint32(zlib.crc32(b" "))


def _step(c: np.ndarray) -> np.ndarray:
    """The register c after one zero byte, by the reflected polynomial."""
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _move(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Apply a linear map given by its values at the four bytes of a register."""
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def _moves(n: int) -> np.ndarray:
    """Tables that move a register by 0..n-1 zero bytes."""
    out = [np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)]
    while len(out) < n:
        out.append(_step(out[-1]))
    return np.stack(out)


_SHORT = _moves(64)
_DOUBLED = [_SHORT[1]]                                                  # by 1, 2, 4, ... bytes
while len(_DOUBLED) < 32:
    _DOUBLED.append(np.stack([_move(_DOUBLED[-1], row) for row in _DOUBLED[-1]]))


def composed(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of left + right from the crc32 of both and the byte length of the right part."""
    n = np.minimum(size, len(_SHORT) - 1)
    out = _SHORT[n, 0, left & 255] ^ _SHORT[n, 1, left >> 8 & 255] ^ _SHORT[n, 2, left >> 16 & 255] ^ _SHORT[n, 3, left >> 24]
    for length in np.unique(size[size >= len(_SHORT)]):
        at, moved = size == length, left[size == length]
        for bit, table in enumerate(_DOUBLED):
            if int(length) >> bit & 1:
                moved = _move(table, moved)
        out[at] = moved
    return out ^ right


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes cut at spaces; a longer word stays whole."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """crc32, crc32 with a space after it, length and end of every word of `text`, in order, as emitted by the
    automaton over its distinct words."""
    words = sorted(set(text.split()))                                   # neighbours in the trie, neighbours in memory
    if not words:
        return (np.zeros(0, np.uint32),) * 2 + (np.zeros(0, np.int64),) * 2
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(words):
        automaton.add_word(f" {word.decode('latin-1')} ", i)
    automaton.make_automaton()
    emitted = np.fromiter(automaton.iter(f" {text.decode('latin-1')} "), np.dtype((np.int64, 2)))
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = composed(crc, np.full(len(words), _SPACE_CRC), np.ones(len(words), np.int64))
    size, found = np.fromiter(map(len, words), np.int64, len(words)), emitted[:, 1]
    return crc[found], spaced[found], size[found], emitted[:, 0] - 1


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, its text) of every feature, and the number of words of each text."""
    plain = [(t or b"").translate(_PLAIN) for t in texts]
    parts, base = [], 0
    for piece in _pieces(b" ".join([*plain, b""])):
        crc, spaced, size, end = _scan(piece)
        parts.append((crc, spaced, size, end + base))
        base += len(piece)
    crc, spaced, size, end = (np.concatenate(x) for x in zip(*parts))
    # the ends of the texts in the joined line; a word ends at its text's end at the latest
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in plain]) - 1, end)
    pair = np.flatnonzero(owner[:-1] == owner[1:])
    double = composed(spaced[pair], crc[pair + 1], size[pair + 1])
    return (np.concatenate([crc, double]) % BUCKETS, np.concatenate([owner, owner[pair]]),
            np.bincount(owner, minlength=len(texts)))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n of the features of all rows of texts(text); buckets without a feature are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, rows=1000, mb=1):
            n += np.bincount(features(as_bytes(batch))[0], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    found = documents(texts, "text").mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))           # BUCKETS rows a task at most


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of every bucket from the counts of corpus and target, as whole thousandths."""
    s, t = ([0] * BUCKETS for _ in range(2))
    for counts, table in ((s, corpus), (t, target)):
        for r in table.collect():                                       # BUCKETS rows at most
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s)) + BUCKETS, float(sum(t)) + BUCKETS
    return np.array([math.floor(1000 * math.log(float(a + 1) * all_s / (float(b + 1) * all_t))) for a, b in zip(t, s)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *returned: str) -> DataFrame:
    """The `returned` columns of docs(text, ...) + _words, _features, _weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)             # BUCKETS numbers
    kinds = [f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in returned]).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1000, mb=1):
            bucket, owner, words = features(as_bytes(batch))
            n = np.bincount(owner, minlength=len(batch))
            total = np.bincount(owner, shared.value[bucket], len(batch)).astype(np.int64)         # exact below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in returned), *map(pa.array, (words, n, weight))],
                                             [*returned, "_words", "_features", "_weight"])

    wanted = [*returned, *([] if "text" in returned else ["text"])]
    return documents(docs, *wanted).mapInArrow(run, ", ".join([*kinds, "_words long", "_features long", "_weight long"]))


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths from a hash of the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(docs: DataFrame, target: DataFrame, *returned: str, percent: int = PERCENT, least: int = LEAST_WORDS,
           seed: int = SEED) -> DataFrame:
    """The `returned` columns of every row + _features, _weight, _score, _rank (NULL where not drawn).

    returned must hold doc_id; only these columns are sorted, over all tasks."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = stash(weighed(docs, gain, *returned)
                   .withColumn("_score", F.col("_weight") + _noise(F.col("doc_id"), seed)), "scored")
    able = F.col("_words") >= least
    drawn = scored.where(able).count() * percent // 100
    place = numbered(scored.where(able), [F.col("_score").desc(), F.col("doc_id").asc_nulls_last()], "_place")
    first = place.withColumn("_rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")
    return first.unionByName(scored.where(~able).withColumn("_rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """The drawn documents with their columns and rank, best first when ordered by it."""
    kept = [c for c in docs.columns if c != "rank"]
    return (ranked(docs, target, *kept, percent=percent, least=least, seed=seed).where("_rank IS NOT NULL")
            .select(*[F.col(f"`{c}`") for c in kept], F.col("_rank").alias("rank")))


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return ranked(docs, target, "doc_id").select("doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"),
                                                 F.col("_score").alias("score"), F.col("_rank").alias("rank"))


# crc32 byte by byte over a list of bytes, with the 256-entry table computed in the query
SQL = f"""
WITH tbl AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
w AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (
  SELECT kind, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
c AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT g FROM f), tbl),
n AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN c USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT CAST(sum(s) AS DOUBLE) FROM n) + {BUCKETS})
                       / (CAST(s + 1 AS DOUBLE) * ((SELECT CAST(sum(t) AS DOUBLE) FROM n) + {BUCKETS})))) AS v FROM n),
m AS (
  SELECT doc_id, CAST(floor(sum(v) / count(*)) AS BIGINT) AS weight FROM f JOIN c USING (g) JOIN gain USING (bucket)
  WHERE kind = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(len(ws), 0) AS words, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || left(sha256('{SEED}:' || doc_id), 8)) AS BIGINT) + 0.5::DOUBLE)
                                                         / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN m USING (doc_id) WHERE kind = 'd'),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE words >= {LEAST_WORDS})
SELECT doc_id, CAST(greatest(2 * words - 1, 0) AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN r USING (doc_id)"""
