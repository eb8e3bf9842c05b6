"""The queries' own columns, digests included, over all documents of the smallest folder at their default parameters."""

import collections
import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, queries, repeats
from tidemark.llm.queries import tokenizer

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def _rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SMALL).collect()}


def test_op7_columns(spark, docs):
    sets = {}
    for d, t in docs.items():
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORDS.findall(t or "")]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in docs}
    for _ in range(len(docs)):
        old = dict(label)
        for a in docs:
            for b in docs:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    got = _rows(spark, "op7_minhash_near_dedup")
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), label[d], label[d] == d) for d in docs}


def test_op8_base_columns(spark, docs):
    got = _rows(spark, "op8_secret_scan")
    for d, t in docs.items():
        t, spans = t or "", []
        for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = collections.Counter(k for _, k, _ in spans)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex, got[d].base_sha256) == (n[0], n[1], n[2], sha(text.encode()))
        assert set(text.split(",")) - {""} <= set(got[d].spans.split(","))


def test_op9_columns(spark, docs):
    raw = {d: (t or "").encode() for d, t in docs.items()}
    seen = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    got = _rows(spark, "op9_repeated_bytes")
    for d, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), int(gone.sum()), runs, sha(kept))


def test_op10_columns(spark, docs):
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    got = _rows(spark, "op10_byte_level_bpe")
    for d, t in docs.items():
        ids = library.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode_bytes(ids)))


def test_op5_target_ids_equal_a_target_column(spark):
    from tidemark.llm import lm

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    flagged = docs.join(good.withColumn("target", F.lit(True)), "doc_id", "left")
    want = {r.doc_id: r for r in lm.cross_entropy_difference(flagged).collect()}
    got = _rows(spark, "op5_cross_entropy_difference")
    assert set(got) == set(want)
    assert all(np.allclose([got[d].score, got[d].target_loss], [want[d].score, want[d].target_loss], atol=1e-9) for d in want if want[d].score is not None)


def test_op6_thresholds_and_verdicts(spark):
    """From the scores, each language's quantile and what is kept, in plain Python."""
    from tidemark.llm import kneser

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    p = kneser.KneserNey(min_documents=20)
    rows = kneser.quality_classifier(docs, labels, p).join(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")), "doc_id").collect()
    side = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(2))
    held = {r.doc_id for r in labels.filter("quality = 1").filter(side == 1).collect()}
    cells = collections.defaultdict(list)
    for r in rows:
        if r.doc_id in held and r.n_words >= p.min_words:
            for lang in (r.lang, None):
                cells[lang].append(int(np.ceil(np.log2(r.perplexity) * 64)))
    limit = {}
    for lang, found in cells.items():
        found.sort()
        at = next(c for i, c in enumerate(found) if sum(x <= c for x in found) >= p.quantile * len(found))
        limit[lang] = at / 64 + p.slack
    assert len(cells) > 2
    for r in rows:
        mine = limit[r.lang] if len(cells.get(r.lang, ())) >= p.min_documents else limit[None]
        assert abs(np.log2(r.threshold) - mine) < 1e-9
        assert r.kept == (r.n_words > 0 and (r.n_words < p.min_words or np.log2(r.perplexity) <= mine + 1e-12))


def test_a_run_of_fifty_lines_is_one_run(spark):
    run = [f"line {i} of the passage" for i in range(50)]
    texts = ["\n".join(["own a", *run, "own b"]), "\n".join(["other", *run, "end"]), "\n".join(["third", *run[10:40], "end 3"])]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_runs, got[i].longest_run) for i in range(3)] == [(0, 0, 0), (50, 1, 50), (30, 1, 30)]
    assert got[1].text == "other\nend"


def test_runs_are_few_in_a_repetitive_corpus(spark):
    """Aligned contexts that differ at one place each: the runs grow with the differences, not with rows times columns."""
    rng = np.random.default_rng(4)
    p = repeats.Repeats()
    base = rng.integers(97, 123, p.reach + p.length)
    sym = np.tile(base, (400, 1)).astype(np.int16)
    for i in range(400):
        sym[i, rng.integers(0, sym.shape[1])] = 65 + i % 20
    index = repeats.RunIndex(np.zeros(400, np.int64), sym, p)
    assert index.runs < 400 * (p.reach + 1) / 20
    row, first, last = index.marks()
    got = np.zeros((400, p.reach + 1), bool)
    for r, a, b in zip(row, first, last, strict=True):
        got[r, a : b + 1] = True
    for c in range(0, p.reach + 1, 7):
        n = collections.Counter(bytes(x) for x in sym[:, c : c + p.length].astype(np.uint8))
        assert [n[bytes(x)] > 1 for x in sym[:, c : c + p.length].astype(np.uint8)] == got[:, c].tolist()
