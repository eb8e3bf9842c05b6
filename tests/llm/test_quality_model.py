"""The quality model is of all training text: perplexities over several blocks and shards equal those of one model in memory."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser, rolling


@pytest.mark.parametrize("block_tokens", [300, 3_000_000])
def test_perplexities_are_those_of_the_whole_training_half(spark, block_tokens):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randrange(1, 40)))) for i in range(200)]
    rows += [(200, "a", None), (201, "b", ""), (202, None, "never seen words"), (None, "a", "w1 w2"), (5, "b", "w3 w4 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 203)] + [(None, 1)], "doc_id long, quality int")
    p = kneser.KneserNey(block_tokens=block_tokens, min_documents=5, unseen_words=1000)
    train = {r.doc_id for r in labels.filter("quality = 1 AND doc_id IS NOT NULL").filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(2)) == 0).collect()}
    model = kneser.train(spark.createDataFrame([(t,) for i, _, t in rows if i in train], "text string"), p)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        _, v, w = kneser._bigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if raw else (None, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        want.append((i, len(w), 2 ** -model.log2(v, w).mean() if len(w) else None))
    key = lambda r: (r[0] is None, r[0], r[1])
    got = sorted((tuple(r) for r in kneser.quality_classifier(docs, labels, p).select("doc_id", "n_words", "perplexity").collect()), key=key)
    want.sort(key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(g[2] is w[2] is None or abs(g[2] / w[2] - 1) < 1e-9 for g, w in zip(got, want, strict=True))


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a", "w1 w2"), (2, "a", None)], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.doc_id: r for r in kneser.quality_classifier(docs, none).collect()}
    assert abs(found[1].perplexity - 1_000_000) < 1e-3 and found[1].kept and found[2].perplexity is None and not found[2].kept
    assert kneser.quality_classifier(docs.limit(0), none).count() == 0


def test_no_bound_on_training_text():
    assert not [f for f in kneser.KneserNey.__dataclass_fields__ if f.startswith("max_train")]
