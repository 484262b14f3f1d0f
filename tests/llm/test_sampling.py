"""Importance resampling, k-d shards and phrases against brute force, on small tables and awkward rows."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.llm import importance, kd_shards, phrases
from . import brute

LONG = "Ein langes Wort " * 4000
WORDS = ["the", "cat", "Sat", "on", "mat", "é", "日本", "x1", "ΑΣ", "a-b"]
EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "a", "en", "a"), (4, "the cat sat. On the mat, " * 9, "en", "b"), (5, "the cat sat. On the mat, " * 9, "en", "b"),
        (6, LONG, "de", "a"), (7, "x" * 30_000, "en", None), (8, "\n\t \x00 \x7f", "fr", "b"), (None, "no id here " * 8, "en", "c"), (None, "no id here " * 8, "en", "c"),
        (9, "same id " * 12, "en", "c"), (9, "same id again " * 12, "en", "c"), (10, "tab\tbetween\twords\x0bnext " * 40, None, "c"),
        (11, "".join(chr(0x4E00 + i) for i in range(500)), "zh", "c"), (12, "Über ÜBER über " * 31, "de", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    made = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    for clash in ("shard", "slot", "size", "score", "rank", "bucket", "n", "h", "k", "shard_"):
        made = made.withColumn(clash, F.lit("clash"))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def test_composed_crc():
    rng = random.Random(1)
    for size in [0, 1, 2, 5, 63, 64, 65, 1000, 70_001]:
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(size)
        got = importance.composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert got[0] == zlib.crc32(a + b)


def test_features_in_pieces(monkeypatch):
    texts = [None if t is None else t.encode() for _, t, _, _ in EDGE] + [b"", b" ", b"a b", None]
    whole = importance.features(texts)
    for piece in (1, 7, 5000):
        monkeypatch.setattr(importance, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, importance.features(texts)))


def test_resampling(spark, edge):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choices(WORDS, k=rng.randrange(60)))) for i in range(150)]
    table = edge.select("doc_id", "text", "rank").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")))
    target = ["the cat on the mat", None, "", "日本 é x1 " * 20]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute.importance([(d, t) for d, t, _, _ in EDGE] + rows, target)
    got = importance.resample_digest(table, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = importance.resample(table, wanted).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in drawn) == sorted((r[4], r[0]) for r in want if r[4])
    texts = dict(rows) | {d: t for d, t, _, _ in EDGE if d not in (None, 9)}
    assert all(r["text"] == texts[r["doc_id"]] for r in drawn if r["doc_id"] in texts)
    assert importance.resample_digest(table.limit(0), wanted).count() == 0
    assert importance.resample_digest(table, wanted.limit(0)).count() == len(want)


def _check_shards(rows, shards):
    size = {i: 0 for i in range(shards)}
    slots = {i: [] for i in range(shards)}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    """Near-equal bytes although a third of all rows is one text in one language."""
    rng = random.Random(3)
    rows = [(i, "hot text " * 40, "en", 360) for i in range(200)]
    rows += [(1000 + i, "w " * rng.randrange(400), rng.choice(["en", "de", "fr", None]), None if i % 7 == 0 else rng.randrange(9)) for i in range(400)]
    rows += [(2007, "same row", "en", 1)] * 40 + [(None, "no id", None, None)] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = kd_shards.shard_digest(table, shards).collect()
    assert len(out) == len(rows)
    size = _check_shards(out, shards)
    assert max(size.values()) - min(size.values()) <= 4 * max(len(t) + 1 for _, t, _, _ in rows)
    texts = dict((d, t) for d, t, _, _ in rows)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in out)
    # equal texts with equal metadata are divided by the cuts only
    hot = {r["shard"] for r in out if r["doc_id"] is not None and r["doc_id"] < 200}
    assert len(hot) <= shards and max(hot) - min(hot) == len(hot) - 1
    again = kd_shards.shard_digest(table.repartition(5), shards).where("doc_id >= 1000").collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in out if (r["doc_id"] or 0) >= 1000}


def test_shards_of_awkward_rows(edge):
    out = kd_shards.shard_digest(edge).collect()
    assert len(out) == len(EDGE)
    _check_shards(out, kd_shards.SHARDS)
    assert kd_shards.shard_digest(edge.limit(0)).count() == 0
    assert kd_shards.shard_digest(edge.limit(1)).first()["slot"] == 0


def test_shards_deeper_than_one_expression(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "DEPTH", 2)
    table = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 13).cast("int")).alias("text"), F.lit("en").alias("lang"),
                                    (F.col("id") % 13 * 3).alias("n_chars"))
    size = _check_shards(kd_shards.shard_digest(table, 37).collect(), 37)
    assert max(size.values()) - min(size.values()) <= 6 * 40


def test_shard_files(spark, edge, tmp_path):
    out = kd_shards.write_shards(edge, str(tmp_path / "shards"), 40_000)
    assert out.columns == [c for c in edge.columns if c not in ("shard", "slot")] + ["slot", "shard"]
    total = sum(len((t or "").encode()) + 1 for _, t, _, _ in EDGE)
    assert out.select("shard").distinct().count() <= -(-total // 40_000) and out.count() == len(EDGE)
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, edge.select("doc_id", "text").collect()))


def test_phrases(spark, edge, monkeypatch):
    rng = random.Random(4)
    rows = [(None if i % 9 == 0 else i, rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", " \x0c"])
             for w in rng.choices(WORDS, [9, 7, 5, 5, 3, 2, 2, 1, 1, 1], k=rng.randrange(90)))) for i in range(300)]
    rows += [(5, "en", "one long copied passage. " * 3)] * 40
    plain = [(lang, t) for _, lang, t in rows] + [(lang, t) for _, t, lang, _ in EDGE]
    table = edge.select("doc_id", "lang", "text", "n").unionByName(spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("n", F.lit("clash")))
    want = brute.phrases(plain)
    assert len(want) > 60
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

    def got(t, **options):
        return sorted(tuple(r[c] for c in columns) for r in phrases.collocations(t, **options).collect())
    assert got(table) == want
    # tables full of false hits, counters that leave often and hashes that collide change nothing
    monkeypatch.setattr(phrases, "LEAST_BITS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 8)
    monkeypatch.setattr(phrases, "HELD", 500)
    assert got(table.repartition(3)) == want
    assert got(table, first=3, support=50) == brute.phrases(plain, 50, 3)
    assert got(table.limit(0)) == []


def test_phrase_bytes_decide():
    """Runs with one hash are told apart by their bytes."""
    line = np.frombuffer(b"ab cd ab ce ab", np.uint8)
    begin, size = np.array([0, 6, 3, 9]), np.array([2, 2, 2, 2])
    assert phrases._same_bytes(line, begin, size, np.array([0, 0, 0, 2])).tolist() == [True, True, False, False]
