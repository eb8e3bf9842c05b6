"""Ranked search against scores of every document in plain Python, over many blocks, waves and groups of queries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    d = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(d), sum(n for _, _, n in d)
    df = Counter(w for _, c, _ in d for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for item, text in items:
        own = set(terms(text))
        scored = []
        for i, c, n in d:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in own if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in search.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()), key=str)


@pytest.mark.parametrize("rows", [1, 20_000])
def test_equals_brute_force_over_blocks_and_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "WAVES", (1, 3))
    monkeypatch.setattr(search, "QUERY_ROWS", rows)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)] + ["Straße", "日本", "É1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(90)]
    docs += [(500 + i, docs[7][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[7][1]), (700, None), (701, ""), (702, " .,- ")]
    items = [(1, docs[7][1]), (2, "w1 W1 w2"), (2, "w1 w2")] if rows == 1 else [(1, docs[7][1]), (2, "w1 W1 w2"), (2, "w1 w2"), (3, None), (4, ""), (5, "nowhere"), (None, "straße STRAßE é1 É1 日本"), (6, "w5")]
    assert found(spark, docs, items) == brute(docs, items)


def test_fewer_documents_than_asked_for_and_other_columns(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("id", "uid", "n", "terms", "block", "item_id", "score")})
    i = spark.createDataFrame([("x", "a"), ("y", "c")], "item_id string, text string").withColumn("item", F.lit(0))
    assert [(r.item_id, r.rank, r.doc_id) for r in search.ranked_search(d, i).collect()] == [("x", 1, 1)]


def test_long_texts_are_cut_at_terms(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 7)
    text = "alpha Beta,gamma--delta " * 9
    assert [w for piece in search.terms_of(text) for w in piece] == [w.encode() for w in terms(text)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """The wanted word is rare in all blocks but one, so that one's scores rule the others out."""
    monkeypatch.setattr(search, "BLOCK", 10)
    monkeypatch.setattr(search, "WAVES", (1, 2))
    asked = []
    whole = search.small_side
    monkeypatch.setattr(search, "small_side", lambda df, n: asked.append(df.count()) or whole(df, n))
    docs = [(i, "rare") for i in range(10)] + [(i, "rare " + "other " * 50) for i in range(10, 200)]
    got = found(spark, docs, [(1, "rare")])
    assert got == brute(docs, [(1, "rare")]) and sum(asked) < 20 / 4
