"""Phrase collocations by the partitioning method: mine shards at a proportionally lowered support, count the union.

The documents are dealt to SHARDS shards by a hash of their id. In a shard that holds the part p of the words of a
language, a phrase is locally frequent with at least p times the support there; a phrase that reaches the support over
all shards is locally frequent in at least one, so the union of the locally frequent phrases misses none, and one
exact count of that union over all documents gives the result. The number of shards is fixed and below the support,
or every phrase would be locally frequent; a shard is not a task but is mined by as many tasks as its rows need.

Mining works on 64-bit hashes of phrases, counted in a task before they are shuffled, word runs of one and two first;
runs of three and four are counted where each pair of words in them may be locally frequent. What may be frequent is
told by a bit table of the hashes, at most MOST_BITS long whatever the input: false hits only add candidates. The last
pass counts the candidates themselves, as text, so neither a false hit nor two phrases with one hash reach the result.

Defined results: NULL and empty texts have no words; a NULL language is `und`; phrases never cross a piece; repeated
rows count as often as they stand there; NULL ids are one shard; no candidates give no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash
from .text import Words, as_bytes, crc_mod, documents, mixed, slices

SUPPORT = 30
LONGEST = 4             # words of a phrase
INSIDE_PERCENT = 80     # of its occurrences that a dropped phrase has inside a longer one
SCALE = 2_000_000       # of the score
FIRST = 2000            # phrases listed of each language
SHARDS = 8
LEAST_BITS, MOST_BITS = 22, 28          # of the tables of hashes, as powers of two
HELD = 4_000_000        # occurrences counted together in a task before they leave it

_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def _language_seed(lang: str) -> np.uint64:
    raw = lang.encode()
    return mixed(np.frombuffer(raw + bytes(-len(raw) % 8), "<u8") + np.uint64(len(raw))).sum(dtype=np.uint64)


class Runs:
    """Runs of 1 to LONGEST words inside the pieces of some texts, as hashes and as places in the bytes."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        words = Words([(t or b"").translate(_PLAIN) for t in texts], lower=True)
        self.words, self.owner, n = words, words.owner, len(words.starts)
        piece = np.cumsum(words.bytes == 10)[words.starts] if n else np.zeros(0, np.int64)
        seeds = {x: _language_seed(x) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64)[self.owner]
        # the number of words from each word to the end of its piece, at most LONGEST
        self.room = np.ones(n, np.int8)
        for k in range(1, LONGEST):
            same = np.zeros(n, bool)
            same[:n - k] = (piece[k:] == piece[:n - k]) & (self.owner[k:] == self.owner[:n - k]) if n > k else False
            self.room += same
        self.hashes, h = [], mixed(words.hashes + seed)
        for k in range(1, LONGEST + 1):
            self.hashes.append(h)
            following = np.zeros(n, np.uint64)
            following[:max(n - k, 0)] = words.hashes[k:]
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + following)

    def at(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.room >= k)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each, and the start and end of every word there."""
        w = self.words
        ends = np.cumsum(w.sizes + 1)
        starts = ends - w.sizes - 1
        keep = np.repeat(w.starts - starts, w.sizes + 1) + np.arange(ends[-1] if len(ends) else 0)
        line = w.bytes[keep].copy()
        line[ends - 1] = 32
        return line, starts, ends - 1


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """A bit table of hashes; two bits each."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in _slots(h, self.bits):
            out &= (self.words[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def _table(found: DataFrame, bits: int) -> Table:
    """found(h) as a bit table: set bits are joined by the executors, one row of 64 bits reaches the driver for each."""
    mask = F.lit((1 << bits) - 1)
    slots = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 64 - bits))).alias("s")
    rows = (found.select(slots).groupBy(F.shiftright("s", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("b")).toArrow())
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return Table(bits, words)


def _inputs(docs: DataFrame) -> DataFrame:
    return documents(docs, "doc_id", "lang", "text").select(
        "text", F.coalesce("lang", F.lit("und")).alias("lang"), crc_mod(F.col("doc_id"), SHARDS).alias("shard"))


def _words_of(inputs: DataFrame) -> DataFrame:
    """lang, shard, n: words of every language in every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1000):
            n = Words([(t or b"").translate(_PLAIN) for t in as_bytes(batch)]).counts
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("shard"), pa.array(n)], ["lang", "shard", "n"])

    return inputs.mapInArrow(run, "lang string, shard int, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n"))


class _Counter:
    """Counts pairs of a hash and a small number until HELD of them are there."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, h: np.ndarray, mark: np.ndarray) -> None:
        self.parts.append((h, mark))
        self.held += len(h)

    def leave(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, mark = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((mark, h))
        h, mark = h[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(h))
        for i in range(0, len(first), 100_000):
            at = first[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(mark[at]), pa.array(n[i:i + 100_000].astype(np.int32))],
                                             ["h", "mark", "n"])


def _locally_frequent(inputs: DataFrame, need: dict, sizes: tuple[int, ...], pairs: Table | None) -> DataFrame:
    """h of the runs of these sizes that are frequent in some shard; need: {(lang, shard): least count there}."""
    context = inputs.sparkSession.sparkContext
    shared, table = context.broadcast(need), context.broadcast(pairs)   # a number a language and shard; a bounded bit table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, least, known = _Counter(), shared.value, table.value
        for batch in slices(batches, rows=1000):
            langs, shards = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
            runs = Runs(as_bytes(batch), langs)
            # what a run needs and its shard as one number
            mark = np.array([least[x] * SHARDS + x[1] for x in zip(langs, shards)], np.int32)[runs.owner]
            for k in sizes:
                at = runs.at(k)
                if known is not None:
                    for i in range(k - 1):
                        at = at[known.holds(runs.hashes[1][at + i])]
                counter.add(runs.hashes[k - 1][at], mark[at])
            if counter.held >= HELD:
                yield from counter.leave()
        yield from counter.leave()

    return (inputs.mapInArrow(run, "h long, mark int, n int").groupBy("h", "mark").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= F.floor(F.col("mark") / SHARDS)).select("h").distinct())


def _counted(inputs: DataFrame, candidates: Table) -> DataFrame:
    """lang, phrase, k, n: exact counts over all documents of every run that the table holds."""
    table = inputs.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in slices(batches, rows=1000, mb=4):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            lang_of = np.array([names.index(x) for x in langs], np.int64)
            runs = Runs(as_bytes(batch), langs)
            line, starts, ends = runs.joined()
            for k in range(1, LONGEST + 1):
                at = runs.at(k)
                h = runs.hashes[k - 1][at]
                hit = known.holds(h)
                at, h = at[hit], h[hit]
                # one entry a hash: runs of one text and language have one; others with the same hash are told apart by bytes
                _, first, group, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                begin, size = starts[at], ends[at + k - 1] - starts[at]
                alike = _same_bytes(line, begin, size, first[group])
                single = np.flatnonzero(~alike)
                n = n - np.bincount(group[single], minlength=len(n))
                rows, n = np.concatenate([first, single]), np.concatenate([n, np.ones(len(single), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names).take(pa.array(lang_of[runs.owner[at[rows]]])), _cut_out(line, begin[rows], size[rows]),
                     pa.array(np.full(len(rows), k, np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])

    return (inputs.mapInArrow(run, "lang string, phrase string, k int, n long")
            .groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")))


def _same_bytes(line: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes at each place equal those at the place numbered `other`."""
    same = size == size[other]
    differs = np.flatnonzero(same & (np.arange(len(begin)) != other))
    a, b, left = begin[differs], begin[other[differs]], size[differs]
    while len(differs):
        equal = line[a] == line[b]
        same[differs[~equal]] = False
        on = equal & (left > 1)
        differs, a, b, left = differs[on], a[on] + 1, b[on] + 1, left[on] - 1
    return same


def _cut_out(line: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes at these places as an array of strings."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = line[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))


def frequent(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n of all runs of up to LONGEST words that occur `support` times; lang, total words)."""
    inputs = _inputs(docs)
    # a row a language and shard, summed by the executors
    words = stash(_words_of(inputs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    per = {(r["lang"], r["shard"]): r["n"] for r in words.collect()}
    total: dict[str, int] = {}
    for (lang, _), n in per.items():
        total[lang] = total.get(lang, 0) + n
    need = {x: max(1, -(-support * n // max(1, total[x[0]]))) for x, n in per.items()}
    bits = min(MOST_BITS, max(LEAST_BITS, sum(total.values()).bit_length() - 1))
    short = stash(_locally_frequent(inputs, need, (1, 2), None), "short")
    pairs = _table(short, bits)
    long = _locally_frequent(inputs, need, tuple(range(3, LONGEST + 1)), pairs)
    candidates = Table(bits, pairs.words | _table(long, bits).words)
    return stash(_counted(inputs, candidates).where(F.col("n") >= support), "frequent"), totals


def _parts(phrase: Column, k: int) -> Column:
    """Contiguous proper parts of two words or more of a phrase of k words."""
    words = F.split(phrase, " ")
    return F.array(*[F.array_join(F.slice(words, i + 1, m), " ") for m in range(2, k) for i in range(k - m + 1)])


def collocations(docs: DataFrame, first: int = FIRST, support: int = SUPPORT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    counts, totals = frequent(docs, support)
    big = "decimal(38,0)"
    longer = reduce(DataFrame.unionByName, [
        counts.where(F.col("k") == k).select("lang", F.explode(F.array_distinct(_parts(F.col("phrase"), k))).alias("phrase"),
                                             F.col("n").alias("inside")) for k in range(3, LONGEST + 1)])
    most = longer.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    kept = (counts.where("k >= 2").join(most.hint("merge"), ["lang", "phrase"], "left")
            .where(F.col("inside").isNull() | (F.col("inside").cast(big) * 100 < F.col("n").cast(big) * INSIDE_PERCENT)))
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), words.alias("_w"),
                       "k").select("lang", "phrase", "a", "cut", F.array_join(F.slice("_w", F.lit(1), F.col("cut")), " ").alias("_l"),
                                   F.array_join(F.slice("_w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_r"))
    # a part of a frequent phrase is frequent, so both joins find their row; hot parts are split by adaptive skew joins
    left = counts.select("lang", F.col("phrase").alias("_l"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_r"), F.col("n").alias("r"))
    scored = (cuts.join(left.hint("merge"), ["lang", "_l"]).join(right.hint("merge"), ["lang", "_r"])
              .withColumn("score", F.expr(f"(CAST(a AS {big}) * {SCALE}) div (CAST(l AS {big}) + CAST(r AS {big}))")))
    best = (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_b"))
            .select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score"))
    line = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    top = best.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= first)
    return top.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


SQL = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM t),
w AS (SELECT lang, id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM p),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM w WINDOW o AS (PARTITION BY lang, id ORDER BY i)),
f AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, 1 AS k, a AS phrase FROM g UNION ALL
    SELECT lang, 2, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL
    SELECT lang, 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL UNION ALL
    SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM g WHERE d IS NOT NULL) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' '))) AS phrase
    FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
c AS (
  SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase)
  WHERE k >= 2 AND (most IS NULL OR CAST(most AS HUGEINT) * 100 < CAST(f.a AS HUGEINT) * {INSIDE_PERCENT})),
cut AS (
  SELECT c.lang, c.phrase, c.a, i, x.a AS l, y.a AS r, (CAST(c.a AS HUGEINT) * {SCALE}) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i, string_split(phrase, ' ') AS ws FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:i], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[i + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank,
       phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN total USING (lang)
QUALIFY rank <= {FIRST}"""
