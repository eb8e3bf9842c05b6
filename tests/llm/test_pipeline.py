"""The pipeline's stages as a whole, against plain Python where SQL can't say it."""

import random
import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SMALL).cache()
        if name != "byte_bpe":
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    texts = {r.doc_id: r for r in before.collect()}
    assert texts
    left = before.select("doc_id", "text")
    for r in left.collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) > 0
    assert before.agg(F.min("n_tokens")).first()[0] > 0
    assert public_tokenizers.PATTERN


def test_near_duplicates_are_linked_from_80_percent(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(15):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([54, 104, 204]))]
        n = len(base) - 4
        texts.append(base)
        # A changed tail of k words replaces k shingles of n: similarities from above 0.85 to below 0.80, and 0.80 itself.
        for k in {n // 20, n // 10, n // 9, n // 9 + 1, n // 8}:
            texts.append(base[: len(base) - k] + [f"t{rng.randint(0, 10**6)}" for _ in range(k)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j, 100 * len(sets[i] & sets[j]), len(sets[i] | sets[j])) for j in range(len(texts)) for i in range(j)]
    assert any(80 * u <= both < 85 * u for _, _, both, u in pairs) and any(0 < both < 80 * u for _, _, both, u in pairs)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j, both, u in pairs:
        if both and both >= 80 * u:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()} == want
    strict = {r.doc_id for r in corpus_pipeline.neardup.near_duplicates(docs).filter("kept").collect()}
    assert strict > want
