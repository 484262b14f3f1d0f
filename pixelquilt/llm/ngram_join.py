"""Similarity join of documents on word n-grams (Jaccard), as a grouped prefix join, and the classes of its links.

A document's set holds the hashes of its distinct shingles. All sets are ordered alike: by how often a shingle's
bucket occurs in the corpus (a sketch of fixed size over all documents), then by hash, so rare shingles come first.
Two sets that reach the threshold share a shingle among their first |x| - ceil(t |x|) + 1 (their prefixes).

1. Documents with equal sets are one set; sets with equal prefix and size are one group.
2. Groups meet on prefix shingles. First each group is tried only against the best head of its lists (the group with
   the earliest position), its members against the head's and their own group's first member: links among copies of
   one text come together without all pairs.
3. Then every pair of sets from different components that shares a prefix shingle, or a group, and passes the size,
   position, sketch and overlap bounds, is verified. Pairs inside a component need no check: the result is the components.
4. Verification intersects the whole sets.

Nothing grows on the driver: it sees the sketch (fixed size) and counts. Lists of frequent shingles are cut by a salt.

Defined results: no words or NULL text: empty set, linked with nothing, own id; fewer words than the shingle width: the
whole sequence is the one shingle; repeated rows are equal sets; a NULL id is never the smallest of a class.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash
from .text import Words, as_bytes, documents, mixed, slices, window_hashes

SKETCH_LOG2 = 20
PART = 1 << 14          # sketch counters per row
WORDS = 8               # 64-bit words of a parity sketch
SKETCH = [f"k{i}" for i in range(WORDS)]
LIST = 4096             # about the most groups of one list that are looked at together in the first round


class Sets:
    """Distinct shingles of some texts: hashes (sorted by text, then hash), owner, sizes."""

    def __init__(self, texts: list[bytes | None], width: int):
        words = Words(texts, lower=True)
        n = len(words.hashes)
        runs = window_hashes(words.hashes, width)
        inside = words.owner[:len(runs)] == words.owner[n - len(runs):]
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        first = np.concatenate([[0], np.cumsum(words.counts)[:-1]])
        whole = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            more = words.counts[short] > i
            whole[more] = mixed(whole[more] + words.hashes[first[short[more]] + i] + np.uint64(i + 1))
        owner = np.concatenate([words.owner[:len(runs)][inside], short])
        h = np.concatenate([runs[inside], whole])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = h[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set, the same for equal sets."""
        def total(x):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            return (run[self.ends] - run[self.ends - self.sizes]).view(np.int64)
        return total(mixed(self.hashes + np.uint64(11))), total(mixed(self.hashes ^ np.uint64(0xA5A5A5A5)))


    def parities(self) -> np.ndarray:
        """[texts, WORDS] a parity sketch of each set: every shingle flips one of 64 * WORDS bits. Two sketches differ
        in at most as many bits as the sets differ in shingles, whatever the sets have in common."""
        bits, texts = 64 * WORDS, len(self.sizes)
        flips = np.bincount(self.owner * bits + (self.hashes >> np.uint64(17)).astype(np.int64) % bits, minlength=texts * bits)
        return np.packbits((flips & 1).astype(np.uint8).reshape(texts, bits), axis=1).view("<i8")


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often each shingle bucket occurs over all documents; 2^SKETCH_LOG2 counters whatever the corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(1 << SKETCH_LOG2, np.int64), [], 0
        for batch in slices(batches):
            waiting.append(_buckets(Sets(as_bytes(batch), width).hashes).astype(np.int32))
            n += len(waiting[-1])
            if n > 1 << SKETCH_LOG2:
                total += np.bincount(np.concatenate(waiting), minlength=len(total))
                waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        for i in range(0, len(total), PART):
            if total[i:i + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i:i + PART].astype("<u4").tobytes()])],
                                                 ["at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(c.as_py(), "<u4") for c in table.column("counts")]
        return pa.table({"at": table.column("at")[:1], "counts": [np.sum(parts, axis=0, dtype=np.int64).astype("<u4").tobytes()]})

    # 2^SKETCH_LOG2 / PART groups, one row of each per task
    rows = docs.select("text").mapInArrow(count, "at int, counts binary").groupBy("at").applyInArrow(add, "at int, counts binary")
    out = np.zeros(1 << SKETCH_LOG2, np.uint32)
    for r in rows.collect():
        out[r["at"]:r["at"] + PART] = np.frombuffer(r["counts"], "<u4")
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def records(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n, fingerprint and ordered prefix (as numbers count * 2^40 + hash bits) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)           # 4 MB
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            s = Sets(as_bytes(batch), width)
            f1, f2 = s.fingerprints()
            often = np.minimum(table[_buckets(s.hashes)], (1 << 23) - 1).astype(np.uint64)
            order = np.lexsort((s.hashes, often, s.owner))
            token = (often[order] << np.uint64(40)) | (s.hashes[order] & np.uint64((1 << 40) - 1))
            place = np.arange(len(token)) - np.repeat(s.ends - s.sizes, s.sizes)
            length = np.where(s.sizes > 0, prefix_length(s.sizes, percent), 0)
            kept = place < np.repeat(length, s.sizes)
            token = token[kept].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(token.view(np.uint64) + mixed(place[kept].astype(np.uint64))), dtype=np.uint64)])
            ph = (run_sum[offsets[1:]] - run_sum[offsets[:-1]]).view(np.int64)
            ph2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(token.view(np.uint64) ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
            ph2 = (ph2[offsets[1:]] - ph2[offsets[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, [s.sizes, f1, f2, ph, ph2, *s.parities().T.copy()]), pa.ListArray.from_arrays(offsets, token)],
                ["doc_id", "n", "f1", "f2", "p1", "p2", *SKETCH, "prefix"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, f1 long, f2 long, p1 long, p2 long, "
                                + "".join(f"{k} long, " for k in SKETCH) + "prefix array<long>")


def packed_sets(docs: DataFrame, wanted: np.ndarray, width: int) -> DataFrame:
    """f1, f2, packed: the whole sets of the documents whose id hash is marked in the bitmap `wanted`."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)           # BITMAP bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, set()
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for part in slices([batch.filter(pa.array(keep.astype(bool)))]):
                s = Sets(as_bytes(part), width)
                f1, f2 = s.fingerprints()
                packed = np.split(s.hashes, s.ends[:-1])
                new = []
                for i, k in enumerate(zip(f1.tolist(), f2.tolist())):       # copies with marked ids: once per task
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(f1[new]), pa.array(f2[new]), pa.array([packed[i].tobytes() for i in new], pa.binary())],
                                                 ["f1", "f2", "packed"])

    return (docs.select(_place(F.col("doc_id")).alias("at"), "text").mapInArrow(run, "f1 long, f2 long, packed binary"))


BITMAP = 1 << 27        # bits; 16 MB


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITMAP))


def _bitmap(places: DataFrame) -> np.ndarray:
    """Bitmap of the places (column `at`), BITMAP / 8 bytes; at most BITMAP / PART rows per task are shuffled."""
    rows = (places.select(F.floor(F.col("at") / PART).cast("int").alias("part"), (F.col("at") % PART).cast("int").alias("bit"))
            .groupBy("part", F.floor(F.col("bit") / 32).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits")))
    out = np.zeros(BITMAP // 32, "<u4")
    table = rows.toArrow()
    at = table.column("part").to_numpy().astype(np.int64) * (PART // 32) + table.column("word").to_numpy()
    out[at] = table.column("bits").to_numpy().astype("<u4")
    return out.view(np.uint8)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node it is connected with) of every node of edges(a, b)."""
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stash(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def may_reach(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two sets (column prefixes) leave the threshold possible; x is the smaller set."""
    apart = sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in SKETCH), F.lit(0))
    return (F.col(f"{x}n") * 100 >= F.col(f"{y}n") * percent) & (apart <= F.col(f"{x}n") + F.col(f"{y}n") - 2 * least_common(x, y, percent))


def least_common(x: str, y: str, percent: int) -> Column:
    """Fewest common shingles of two sets that reach the threshold."""
    return F.ceil((F.col(f"{x}n") + F.col(f"{y}n")) * percent / F.lit(100.0 + percent))


def renamed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets reach the threshold."""
    pairs = stash(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = _bitmap(sets.join(ends, "sid", "left_semi").select(_place(F.col("least_doc")).alias("at")))
    if not wanted.any():
        return pairs
    whole = stash(packed_sets(docs, wanted, width), "whole")
    key = sets.select("sid", "f1", "f2")
    named = (pairs.join(key.select(F.col("sid").alias("a"), F.col("f1").alias("a1"), F.col("f2").alias("a2")), "a")
             .join(key.select(F.col("sid").alias("b"), F.col("f1").alias("b1"), F.col("f2").alias("b2")), "b"))
    with_b = named.join(whole.withColumnsRenamed({"packed": "pb"}), (F.col("b1") == F.col("f1")) & (F.col("b2") == F.col("f2"))).drop("f1", "f2", "b1", "b2")
    with_both = with_b.join(whole.withColumnsRenamed({"packed": "pa"}), (F.col("a1") == F.col("f1")) & (F.col("a2") == F.col("f2")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("pa"), batch.column("pb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both.select("a", "b", "pa", "pb").mapInArrow(check, "a long, b long").distinct()


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = documents(docs, "doc_id", "text")
    rows = stash(records(docs, sketch(docs, width), width, percent), "records")
    filled = rows.where("n > 0")
    groups = stash(filled.groupBy("n", "p1", "p2").agg(F.first("prefix").alias("prefix"))
                   .withColumn("gid", F.monotonically_increasing_id()), "groups")
    by_set = filled.groupBy("n", "p1", "p2", "f1", "f2").agg(F.min("doc_id").alias("least_doc"), *(F.first(k).alias(k) for k in SKETCH))
    sets = stash(by_set.join(groups.drop("prefix"), ["n", "p1", "p2"]).drop("p1", "p2")
                 .withColumn("sid", F.monotonically_increasing_id()), "sets")

    # lists of groups by prefix shingle; frequent shingles (their count is in the token) are dealt over several lists
    salts = F.shiftright("token", 40) / F.lit(LIST)
    listed = (groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
              .withColumn("salt", F.pmod(F.xxhash64("gid"), (F.floor(salts) + 1)).cast("int")))
    one = Window.partitionBy("token", "salt")
    head = F.min(F.struct("pos", "n", "gid")).over(one)
    lists = stash(listed.withColumn("head", head["gid"]).withColumn("size", F.count(F.lit(1)).over(one))
                  .where((F.col("size") > 1) | (salts >= 1)).select("token", "gid", "pos", "head"), "lists")

    # first round: a group against the head it shares most with, a set against the first of its group
    firsts = sets.groupBy("gid").agg(F.min("sid").alias("first"))
    best = (lists.where("gid <> head").groupBy("gid", "head").agg(F.count(F.lit(1)).alias("shared"))
            .groupBy("gid").agg(F.max_by("head", F.struct("shared", "head")).alias("other")))
    to_head = (best.join(sets.select("gid", "sid"), "gid").join(firsts.withColumnRenamed("gid", "other"), "other")
               .select(F.col("sid").alias("a"), F.col("first").alias("b")))
    to_own = sets.join(firsts, "gid").where("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    sized = ["sid", "n", *SKETCH]
    tried = (to_head.unionByName(to_own).distinct().join(renamed(sets, "x_", *sized), F.col("a") == F.col("x_sid"))
             .join(renamed(sets, "y_", *sized), F.col("b") == F.col("y_sid"))
             .where(F.when(F.col("x_n") <= F.col("y_n"), may_reach("x_", "y_", percent)).otherwise(may_reach("y_", "x_", percent))).select("a", "b"))
    links = stash(verified(tried, sets, docs, width, percent), "links")

    # second round: what different components still share
    comp = components(links)
    twins = sets.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gid")
    member = sets.join(comp, F.col("sid") == F.col("node"), "left").select("gid", "sid", "n", F.coalesce("comp", "sid").alias("comp"))
    entries = stash(lists.select("token", "gid", F.col("pos").cast("long").alias("pos")).join(member, "gid").drop("gid").unionByName(
        member.join(twins, "gid").select((-1 - F.col("gid")).alias("token"), F.lit(0).cast("long").alias("pos"), "sid", "n", "comp")), "entries")
    open_lists = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    entries = stash(entries.join(open_lists, "token", "left_semi").join(sets.select("sid", *SKETCH), "sid"), "entries")
    fields = ["pos", "sid", "n", "comp", *SKETCH]
    x, y = (entries.select("token", *(F.col(c).alias(p + c) for c in fields)) for p in ("x_", "y_"))
    needed = least_common("x_", "y_", percent)
    room = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    shared = (x.join(y, "token")
              .where((F.col("x_comp") != F.col("y_comp"))
                     & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_sid") < F.col("y_sid"))))
                     & (F.least("x_pos", "y_pos") + room >= needed) & may_reach("x_", "y_", percent)))
    pairs = (shared.groupBy(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"))
             .agg(F.count(F.when(F.col("token") >= 0, 1)).alias("common"), F.min("token").alias("own"),
                  F.max(F.when(F.col("token") >= 0, F.struct("token", room.alias("room"), needed.alias("needed")))).alias("last"))
             .where((F.col("own") < 0) | (F.col("common") - 1 + F.col("last.room") >= F.col("last.needed")))
             .select("a", "b"))
    more = stash(verified(pairs, sets, docs, width, percent), "links")
    final = components(links.unionByName(more)) if more.limit(1).count() else comp

    named = (sets.join(final, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "sid")))
    smallest = named.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    of_set = named.select("f1", "f2", "comp").join(smallest, "comp").drop("comp")
    linked = rows.where("n > 0").select("doc_id", "n", "f1", "f2").join(of_set, ["f1", "f2"]).select("doc_id", "n", "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


def class_digest(docs: DataFrame) -> DataFrame:
    return classes(docs)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity of 0.8 or more. Columns as in
    `docs`. The one with the smallest id stays; of rows with one id, the one with the smallest hash of its text; of
    rows without id, one of each text."""
    kept = (classes(docs, width, percent).where("doc_id IS NOT NULL AND (n_shingles = 0 OR doc_id = component_id)")
            .select(F.col("doc_id").alias("_id")).distinct())
    once = Window.partitionBy("_id").orderBy(F.xxhash64("text"))
    named = docs.join(kept, F.col("doc_id") == F.col("_id")).withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
    return named.drop("_id", "_nth").unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))
