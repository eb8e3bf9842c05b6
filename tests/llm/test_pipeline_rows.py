"""The pipeline's rows, stage by stage and as a whole, against plain Python over documents that try each stage."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _windows(words):
    n = min(13, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_lines(docs):
    """(id, text) after later copies of runs of three lines, or of fewer with over fifty words, are gone."""
    seen, out, done = set(), {}, {}
    for d, t in sorted(set(docs), key=lambda x: x[0]):
        ls = t.split("\n")
        solid = [i for i, x in enumerate(ls) if WORDS.search(x)]
        gone, mine = set(), set()
        for a in range(len(solid)):
            for n in (1, 2, 3):
                run = tuple(ls[i] for i in solid[a : a + n])
                if len(run) == n and (n == 3 or sum(len(WORDS.findall(x)) for x in run) > 50):
                    if run in seen or run in mine:
                        gone |= set(range(solid[a], solid[a + n - 1] + 1))
                    mine.add(run)
        seen |= mine
        # Blank lines between two deleted runs that meet go too.
        cut = sorted(gone & set(solid))
        for x, y in zip(cut, cut[1:], strict=False):
            if solid.index(y) == solid.index(x) + 1 and any(x in r and y in r for r in _meeting(solid, gone)):
                gone |= set(range(x, y))
        done[d, t] = (len(solid), len([i for i in solid if i in gone]), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    for d, t in docs:
        n, removed, text = done[d, t]
        if removed < n or n == 0:
            out.setdefault(d, []).append(text)
    return out


def _meeting(solid, gone):
    run, out = [], []
    for i in solid:
        if i in gone:
            run.append(i)
        elif run:
            out.append(run)
            run = []
    return [*out, run] if run else out


def plain_groups(docs, percent=80):
    """Ids that stay: the least of each group of near duplicates."""
    sets = {}
    for d, t in docs:
        w = [_lower(x) for x in WORDS.findall(t)]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for j, b in enumerate(ids):
        for a in ids[:j]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def plain_contaminated(docs, items):
    windows = set().union(*(_windows(ASCII.findall(_lower(t or ""))) for t in items))
    lengths = {len(w) for w in windows}
    out = set()
    for d, t in docs:
        w = ASCII.findall(_lower(t))
        hit = {q for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for q in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("bcdfghklmnprst") + str(rng.randint(0, 9999))
    line = lambda n: " ".join(word() for _ in range(n))
    text = lambda k: "\n".join(line(rng.randint(6, 14)) for _ in range(k))
    items = [line(30), line(16), line(4), None, ""]
    shared = [text(5), line(60)]
    docs = [(i, text(rng.randint(4, 12))) for i in range(1, 31)]
    docs += [(40 + i, docs[i][1]) for i in range(4)]
    docs += [(50 + i, docs[10 + i][1].replace("\n", " ", 2) + " " + line(2)) for i in range(6)]
    docs += [(60 + i, text(3) + "\n" + shared[i % 2] + "\n" + text(3)) for i in range(6)]
    docs += [(70, text(2) + "\n" + items[0] + "\n" + text(1)), (71, text(60) + "\n" + items[1]), (72, items[1] + " " + line(40)), (73, line(20) + " " + items[2])]
    docs += [(80, None), (81, ""), (82, "too short"), (83, " ".join(["again and again"] * 40)), (1, docs[0][1]), (90, "A" * 3000 + " " + text(4))]
    rows = [(d, t, "en", "web", len(t or "")) for d, t in docs]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("n_chars", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, items


def test_line_stage_rows(spark, folder):
    at, docs, _ = folder
    given = [(d, t) for d, t in docs if t is not None]
    df = spark.createDataFrame([(d, t, "en", "web", 0) for d, t in given], SCHEMA)
    got = {}
    for r in corpus_pipeline.line_stage(spark, df, at).collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got == plain_lines(given)


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, folder):
    at, docs, _ = folder
    given = [(d, t) for d, t in docs if t is not None]
    df = spark.createDataFrame([(d, t, "en", "web", i) for i, (d, t) in enumerate(given)], SCHEMA)
    got = corpus_pipeline.near_duplicate_stage(spark, df, at).collect()
    assert sorted(r.doc_id for r in got) == sorted(plain_groups(given))
    assert [r.n_chars for r in got if r.doc_id == 1] == [0]  # the least of both rows


def test_benchmark_stage_rows(spark, folder):
    at, docs, items = folder
    given = [(d, t) for d, t in docs if t is not None]
    bad = plain_contaminated(given, items)
    assert {70, 72} <= bad and 71 not in bad
    df = spark.createDataFrame([(d, t, "en", "web", 0) for d, t in given], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_stage(spark, df, at).collect()) == sorted(d for d, _ in given if d not in bad)


def test_run_equals_plain_python(spark, folder):
    """Texts of this folder are too few for references, so the quality stage's base rules alone decide."""
    at, docs, items = folder
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    left = []
    for d, t in docs:
        w = WORDS.findall(t or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeated = {q for i, g in enumerate(grams) if grams.count(g) > 1 for q in range(i, i + 8)}
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w):
            left.append((d, t))
    judged = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
    assert judged <= {d for d, _ in left}
    left = [(d, t) for d, t in left if d in judged]
    left = [(d, t) for d, ts in plain_lines(left).items() for t in ts]
    stay = plain_groups(left)
    left = sorted({(d, t) for d, t in left if d in stay})
    bad = plain_contaminated(left, items)
    want = {d: t for d, t in left if d not in bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(got) == set(want)
    for d, t in want.items():
        ids = library.encode_ordinary(t)
        assert got[d].text == t and got[d].n_tokens == len(ids)
        assert np.frombuffer(bytes(got[d].tokens), "<u4").tolist() == ids


def test_stages_take_empty_tables_and_odd_rows(spark, folder):
    at = folder[0]
    odd = [(None, "no id " * 30, None, None, None), (5, None, None, None, None), (6, "", "en", "a", 0), (6, "", "en", "a", 0), (7, "x\n\n\ny", "en", "b", 5)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), at).count() == 0
    df = spark.createDataFrame(odd, SCHEMA)
    ids = lambda f: sorted(str(r.doc_id) for r in f(spark, df, at).collect())
    assert ids(corpus_pipeline.quality_stage) == []
    assert ids(corpus_pipeline.line_stage) == ["5", "6", "6", "7", "None"]
    assert ids(corpus_pipeline.near_duplicate_stage) == ["5", "6", "7", "None"]
    assert ids(corpus_pipeline.benchmark_stage) == ["5", "6", "6", "7", "None"]
    assert ids(corpus_pipeline.token_stage) == ["5", "6", "6", "7", "None"]
