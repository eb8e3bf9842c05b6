"""Long repeated runs: what is found depends on every level of the doubling."""

import random

from tidemark.llm import lines

SCHEMA = "doc_id long, text string"


def longest(docs):
    """Lines of each document's longest run that an earlier place has, by comparing all places."""
    rows = [(i, [x for x in t.split("\n") if x.strip()]) for i, t in docs]
    places = [(i, at) for i, ls in rows for at in range(len(ls))]
    text = dict(rows)
    best = {i: 0 for i, _ in rows}
    for n, (i, at) in enumerate(places):
        for j, other in places[:n]:
            m = 0
            while at + m < len(text[i]) and other + m < len(text[j]) and text[i][at + m] == text[j][other + m]:
                m += 1
            best[i] = max(best[i], m)
    return best


def corpus():
    rng = random.Random(8)
    passage = [f"line {i} of a passage" for i in range(23)]
    docs = []
    for i in range(14):
        own = [f"own {i} {k}" for k in range(4)]
        start, length = rng.randint(0, 12), rng.randint(1, 11)
        docs.append((i, "\n".join(own[:2] + passage[start : start + length] + own[2:] + [rng.choice("abc") for _ in range(9)])))
    return [*docs, (50, docs[3][1]), (51, "x\nx\nx\nx\nx\nx"), (52, " \n")]


def test_longest_runs_equal_brute_force(spark):
    docs = corpus()
    out = lines.dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    want = longest(docs)
    assert {r.doc_id: r.longest_run for r in out} == want and len({v for v in want.values() if v > 4}) > 3


def test_stopping_the_doubling_early_changes_the_result(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), SCHEMA)
    whole = {r.doc_id: r.longest_run for r in lines.dedup_lines(df).collect()}
    levels = lines.prefix_doubling
    monkeypatch.setattr(lines, "prefix_doubling", lambda seqs: levels(seqs)[:2])
    assert {r.doc_id: r.longest_run for r in lines.dedup_lines(df).collect()} != whole
