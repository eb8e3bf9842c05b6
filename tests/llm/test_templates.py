"""Near-duplicate search in a corpus of one template: every pair is nearly similar enough, pairs of twins are."""

import random

from tidemark.llm import neardup


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_twins_in_a_templated_corpus(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows, texts = [], {}
    for pair in range(150):
        # Places that the pair changes, and a few more that one of the twins does.
        own = rng.sample(range(5, 395), 8)
        for twin in range(2):
            w = list(base)
            for at in own:
                w[at] = f"p{pair}x{at}"
            for at in rng.sample(range(5, 395), 3):
                w[at] = f"p{pair}t{twin}x{at}"
            i = 2 * pair + twin
            texts[i] = shingles(w)
            rows.append((i, " ".join(w)))
    # The truth by brute force over all pairs.
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in texts:
        for j in range(i):
            both = len(texts[i] & texts[j])
            if 100 * both >= 85 * (len(texts[i]) + len(texts[j]) - both):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert links >= 100 and len({root(i) for i in texts}) > 50
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root(i) for i in texts}
