"""The pipeline stage by stage against plain checks."""
import corpus_pipeline
from pixelquilt.session import stash

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {"input": docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = seen[name] = stash(stage(spark, docs, FOLDER), name)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    rows = {name: sorted(map(tuple, df.select("doc_id", "text").collect())) for name, df in seen.items() if name != "bpe"}
    assert all(any(c.isalpha() for c in t) for _, t in rows["language"])
    classes = brute.classes(rows["language"], 5, 80)
    assert rows["near_dup"] == [r for r in rows["language"] if classes[r[0]][0] == 0 or classes[r[0]][1] == r[0]]
    assert [d for d, _ in rows["pii"]] == [d for d, _ in rows["near_dup"]]
    assert all(sum(brute.pii(t)[:4]) == 0 for _, t in rows["pii"])
    texts = dict(rows["pii"])
    assert all(texts[d] == t for d, t in rows["mix"]) and max(map(rows["mix"].count, rows["mix"])) <= 3
    assert seen["bpe"].count() == len(rows["mix"])
    assert sorted(r["doc_id"] for r in seen["bpe"].collect()) == [d for d, _ in rows["mix"]]
