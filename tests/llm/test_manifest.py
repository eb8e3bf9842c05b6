"""The manifest against a tree built in plain Python, over many parts and rounds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def root_of(level: list[str], arity: int) -> str:
    while len(level) > 1:
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0]


def fold(leaf: str, proof) -> str:
    for step in proof:
        leaf = sha(step.before + leaf + step.after)
    return leaf


def expected(rows, arity):
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1])))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subroots = [root_of([x[2] for x in sorted(by[k])], arity) for k in langs]
    return dict(zip(langs, subroots, strict=True)), root_of(subroots, arity)


@pytest.mark.parametrize("arity", [2, 3])
def test_proofs_over_many_parts(spark, monkeypatch, arity):
    monkeypatch.setattr(manifest, "PART_ROWS", 3)
    monkeypatch.setattr(manifest, "FAN", 2)
    rows = [(i, f"text {i}", "en", "a", i) for i in range(37)] + [(i, "x" * i, lang, None, None) for lang in ("de", None, "", "日本", "zz") for i in range(5)] + [(90, "alone", "q", "b", 1)]
    subroots, root = expected(rows, arity)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = manifest.manifest(df, keep=["lang", "text", "source", "n_chars"], arity=arity).withColumn("again", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.leaf == leaf_of(r.doc_id, r.source, r.lang, r.n_chars, r.text)
        assert (r.subroot, r.root) == (subroots[r.lang], root)
        assert r.again == fold(r.leaf, r.proof) == root


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "a", i) for i in range(9)], SCHEMA).withColumn("told", manifest.leaf_hash(F.col("text")))
    out = manifest.manifest(df, keep=["told"])
    assert out.filter(manifest.folded(F.col("told"), F.col("proof")) == F.col("root")).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "same", "en", "a", 1)] * 4 + [(1, "other", "en", "a", 1), (None, None, None, None, None), (None, "", "en", None, 0), (2, "long " * 50_000, "en", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("leaf", "grp", "k0", "uid", "part", "tree", "proof", "no")})
    out = manifest.manifest(df, keep=["grp", "k0"])
    got = out.collect()
    subroots, root = expected(rows, 2)
    assert len(got) == len(rows) and {r.root for r in got} == {root} and {r.subroot for r in got} == set(subroots.values())
    assert all(fold(r.leaf, r.proof) == root and r.grp == r.k0 == "own" for r in got)


def test_a_lone_row_is_its_own_root(spark):
    (r,) = manifest.manifest(spark.createDataFrame([(5, "t", None, None, 1)], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root and r.proof == []


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
