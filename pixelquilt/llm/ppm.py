"""Scoring texts with prediction by partial matching, next to an add-one unigram score over words.

Model. Bytes of the lower-cased text with an end mark; contexts of up to ORDER bytes, padded at the start. Every
learning text counts its (context, byte) pairs; the counts of each order are the levels of a byte-context trie, stored
as sorted arrays. A byte is coded in the longest known context; if it was never seen there, the escape probability
(different followers / (count + different followers)) is paid and the next shorter context is asked, in which the
bytes already ruled out take no part (symbol exclusion); last, all bytes left are alike. The score is the log10
probability of the whole text.

Neither the pairs nor the exact count of every word of the corpus has a bound, so no task holds them all. Texts go
through in batches; a batch keeps its different words (as hashes) and its different (context, byte) pairs once, with
their counts in its learning texts. Words meet by hash range, pairs by the last two bytes of their context, so a share
holds all pairs of its contexts of two and three bytes; the orders below have at most 2^16 and 2^8 pairs, and every task
has them. Counts are summed over all batches; word counts and log probabilities of the pairs go back to the batch. A word
or pair costs one entry per batch, so frequent ones are not hot. Only numbers and the two lowest orders reach the driver.

Defined results: NULL texts are empty and consist of the end alone; without learning texts all counts are 0 and every
byte is equally likely; NULL ids belong to the learning part; repeated rows count as often as they occur.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stash
from .text import Words, as_bytes, crc_mod, documents, mixed, slices

ORDER = 3
BATCH = 1024            # texts of a batch
START, END = b"\xfe" * ORDER, b"\xff"       # bytes that UTF-8 does not have


def codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(every byte with the ORDER bytes before it, as one number; such numbers per text)."""
    parts = [START + (t.lower() if t else b"") + END for t in texts]
    joined = b"".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    all_codes = np.ndarray((max(0, len(joined) - ORDER),), ">u4", joined, 0, (1,))
    inside = np.ones(len(joined), bool)
    ends = np.cumsum(lengths)
    for i in range(1, ORDER + 1):
        inside[ends - i] = False
    return all_codes[inside[:len(all_codes)]].astype(np.uint32), lengths - ORDER


class Trie:
    """Levels of the model, or of all pairs of some contexts: per order the sorted pairs and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.keys = [k for k, _ in levels]
        self.counts = [c for _, c in levels]
        top, n = self.keys[ORDER], self.counts[ORDER].astype(float)
        self.known = np.zeros(0)
        if len(top):
            _, first = np.unique(top >> np.uint32(8), return_index=True)
            size = np.diff(np.append(first, len(top)))
            total = np.add.reduceat(n, first) + size
            self.known = np.log10(n / np.repeat(total, size))        # of the pairs that the longest context holds

    def _escaped(self, code: int) -> float:
        """log10 probability of a byte that the longest context does not hold."""
        symbol, p, out = code & 255, 0.0, np.zeros(256, bool)
        for order in range(ORDER, -1, -1):
            keys = self.keys[order]
            context = (code >> 8) & ((1 << 8 * order) - 1)
            lo, hi = np.searchsorted(keys, np.array([context << 8, (context << 8) | 255], np.uint32), side="left")
            hi += hi < len(keys) and int(keys[hi]) == (context << 8 | 255)
            if lo == hi:
                continue
            followers = (keys[lo:hi] & np.uint32(255)).astype(np.int64)
            left = ~out[followers]
            total, different = float(self.counts[order][lo:hi][left].sum()), int(left.sum())
            if not different:
                continue
            found = np.flatnonzero(followers == symbol)
            if len(found):
                return p + float(np.log10(self.counts[order][lo + found[0]] / (total + different)))
            p += float(np.log10(different / (total + different)))
            out[followers] = True
        return p - float(np.log10(max(1, 256 - int(out.sum()))))

    def worth(self, kinds: np.ndarray) -> np.ndarray:
        """log10 probability of each of some different codes."""
        top = self.keys[ORDER]
        at = np.minimum(np.searchsorted(top, kinds), max(0, len(top) - 1))
        hit = top[at] == kinds if len(top) else np.zeros(len(kinds), bool)
        value = np.zeros(len(kinds))
        value[hit] = self.known[at[hit]]
        for i in np.flatnonzero(~hit):
            value[i] = self._escaped(int(kinds[i]))
        return value


def level(key: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts of an order from those of a higher one."""
    short, at = np.unique(key & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return short.astype(np.uint32), np.bincount(at, n, len(short)).astype(np.int64)


def pairs_of(texts: list[bytes | None], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different codes of the texts, how often the learning texts have each)."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), 128):
        code, length = codes(texts[i:i + 128])
        more, m = np.unique(code.astype(np.uint64) << np.uint64(1) | np.repeat(learned[i:i + 128], length).astype(np.uint64), return_counts=True)
        both, at = np.unique(np.concatenate([key, more]), return_inverse=True)
        key, n = both, np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
    kinds, at = np.unique(key >> np.uint64(1), return_inverse=True)
    return kinds.astype(np.uint32), np.bincount(at, n * (key & np.uint64(1)).astype(np.int64), len(kinds)).astype(np.int64)


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs with a context of one byte."""
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for key, count in zip(*(batch.column(c).to_pylist() for c in ("pairs", "pair_counts"))):
            n += np.bincount(_from_planes(key) & np.uint32(0xFFFF), _from_planes(count), 1 << 16).astype(np.int64)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen])], ["key", "n"])


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: the upper planes are nearly empty and compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def score(docs: DataFrame, learns, key: str = "doc_id") -> DataFrame:
    """key, learned, n_tokens, n_known, train_tokens, base_score, score of every row.

    learns: boolean column, true for the rows that model and counts learn from."""
    rows = docs.select(key, "text", learns.alias("learned"))
    kind = dict(docs.dtypes)[key]
    spark = docs.sparkSession
    ranges = 256
    while ranges < 4 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        ranges *= 2
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def context_part(kinds: np.ndarray) -> np.ndarray:
        """Share of each code: after the word shares, by the last two bytes of the context."""
        return (mixed((kinds >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.uint64)) >> shift).astype(np.int64) + ranges

    def batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=BATCH, mb=4):
            texts = as_bytes(batch)
            words = Words(texts, lower=True)
            kinds, at = np.unique(words.hashes, return_inverse=True)
            learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(at[learned[words.owner]], minlength=len(kinds))
            pairs, pair_counts = pairs_of(texts, learned)
            one = pa.array([0, len(batch)], pa.int32())
            lists = [pa.ListArray.from_arrays(one, c) for c in (batch.column(0), batch.column("text").cast(pa.binary()), pa.array(learned))]
            yield pa.RecordBatch.from_arrays(
                [*lists, *(pa.array([x], pa.binary()) for x in (kinds.tobytes(), counts.astype("<u4").tobytes(), _planes(pairs), _planes(pair_counts))),
                 pa.array([int(learned.sum())]), pa.array([int(words.counts[learned].sum())])],
                ["ids", "texts", "learned", "kinds", "counts", "pairs", "pair_counts", "train_docs", "train_words"])

    shape = (f"ids array<{kind}>, texts array<binary>, learned array<boolean>, kinds binary, counts binary, pairs binary, "
             "pair_counts binary, train_docs long, train_words long")
    held = stash(rows.mapInArrow(batch_rows, shape).withColumn("batch", F.monotonically_increasing_id()), "batches")
    table = held.select("pairs", "pair_counts").mapInArrow(_low, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    first = level(table.column("key").to_numpy().astype(np.uint32), table.column("n").to_numpy(), 1)    # at most 2^16 pairs
    lowest = spark.sparkContext.broadcast([level(*first, 0), first])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, kinds, counts, pairs, pair_counts in zip(*(batch.column(c).to_pylist() for c in ("batch", "kinds", "counts", "pairs", "pair_counts"))):
                hashes, codes_ = np.frombuffer(kinds, np.uint64), _from_planes(pairs)
                for key, n, part in ((hashes, np.frombuffer(counts, "<u4"), (hashes >> shift).astype(np.int64)),
                                     (codes_, _from_planes(pair_counts), context_part(codes_))):
                    order = np.argsort(part, kind="stable")
                    key, n, part = key[order], n[order], part[order]
                    used, begin = np.unique(part, return_index=True)
                    end = np.append(begin[1:], len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(used, pa.int64()), pa.array([b] * len(used), pa.int64()),
                         pa.array([key[i:j].tobytes() for i, j in zip(begin, end)], pa.binary()),
                         pa.array([n[i:j].tobytes() for i, j in zip(begin, end)], pa.binary())], ["part", "batch", "kinds", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        """Per batch of a share: the count of each word, or the log probability of each pair."""
        part = table.column("part")[0].as_py()
        kinds = [np.frombuffer(x.as_py(), np.uint64 if part < ranges else np.uint32) for x in table.column("kinds")]
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        different, at = np.unique(np.concatenate(kinds), return_inverse=True)
        total = np.bincount(at, counts, len(different)).astype(np.int64)
        seen, worth = total > 0, total
        if part >= ranges:
            top = different[seen], total[seen]
            worth = Trie([*lowest.value, level(*top, 2), top]).worth(different)
        ends = np.cumsum([len(k) for k in kinds])
        back = [x.tobytes() for x in np.split(worth[at], ends[:-1])]
        new = int(seen.sum()) if part < ranges else 0
        return pa.table({"batch": pa.array([*table.column("batch").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(back) + 1), pa.int64()),
                         "totals": pa.array([*back, b""], pa.binary()), "different": pa.array([0] * len(back) + [new], pa.int64())})

    met = stash(held.select("batch", "kinds", "counts", "pairs", "pair_counts").mapInArrow(deal, "part long, batch long, kinds binary, counts binary")
                .groupBy("part").applyInArrow(meet, "batch long, part long, totals binary, different long"), "totals")
    sums = held.agg(F.sum("train_docs").alias("d"), F.sum("train_words").alias("w")).first()
    ends, train = sums["d"] or 0, (sums["d"] or 0) + (sums["w"] or 0)
    different = (met.agg(F.sum("different").alias("v")).first()["v"] or 0) + (ends > 0)
    floor = float(np.log10(train + different + 1))
    back = met.where("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                parts = one.column("parts")[0].as_py() or []
                total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p["totals"], "<i8") for p in parts if p["part"] < ranges)])
                texts = one.column("texts")[0].as_py()
                words = Words(texts, lower=True)
                n, owner = words.counts, words.owner
                each = total[np.unique(words.hashes, return_inverse=True)[1]]
                base = np.bincount(owner, np.log10(each + 1.0), len(n)) + np.log10(ends + 1.0) - (n + 1) * floor
                known = np.bincount(owner, each > 0, len(n)).astype(np.int64) + (ends > 0)
                pairs = _from_planes(one.column("pairs")[0].as_py())
                worth = np.zeros(len(pairs))
                worth[np.argsort(context_part(pairs), kind="stable")] = np.concatenate(
                    [np.frombuffer(p["totals"], "<f8") for p in parts if p["part"] >= ranges])
                scores = []
                for i in range(0, len(texts), 128):
                    code, length = codes(texts[i:i + 128])
                    scores.append(np.add.reduceat(worth[np.searchsorted(pairs, code)], np.cumsum(length) - length))
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), one.column("learned").flatten(), pa.array(n + 1), pa.array(known),
                     pa.array([train] * len(n), pa.int64()), pa.array(base), pa.array(np.concatenate(scores))],
                    [key, "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = held.select("batch", "ids", "texts", "learned", "pairs").join(back, "batch", "left")
    return whole.mapInArrow(finish, f"`{key}` {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double")


def score_digest(docs: DataFrame) -> DataFrame:
    out = score(documents(docs, "doc_id", "text"), crc_mod(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
