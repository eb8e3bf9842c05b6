"""Operators that SQL can't express, against plain Python."""

import base64
import collections
import json
import math
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, kneser, lines, lm, neardup, repeats, secrets
from tidemark.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _near(rng, n, edits):
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(n)]
    for _ in range(edits):
        base[rng.randrange(n)] = f"e{rng.randint(0, 999)}"
    return base


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = _near(rng, rng.randint(40, 150), 0)
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 50)}"
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else "  ".join(t))
    texts += ["a b", "A  b", "a b c", "", texts[0]]
    sets = []
    for t in texts:
        w = [x.lower() for x in WORDS.findall(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


@pytest.mark.parametrize("p", [repeats.Repeats(20, 6, 2000, 50), repeats.Repeats(20, 6, 3, 10)])
def test_repeated_bytes(spark, p):
    rng = random.Random(p.max_group)
    make = lambda n: "".join(rng.choice("abcdé日") for _ in range(n))
    base = [make(80) for _ in range(4)]
    texts = [None, "", "a" * 60, "ab" * 40, make(19), make(20)]
    for _ in range(25):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            t += make(rng.randint(0, 40)) + b[i : i + rng.randint(0, 60)]
        texts.append(t)
    texts += texts[-2:]
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + p.length] for b in raw for i in range(len(b) - p.length + 1))
    want = {}
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - p.length + 1):
            if seen[b[i : i + p.length]] > 1:
                gone[i : i + p.length] = b"\1" * p.length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        want[k] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in repeats.remove_repeats(df, p).collect()}
    assert got == want


def test_bpe_equals_the_library(spark):
    path, pattern = tokenizer()
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["", "a" * 3000, "abc" * 700, "don't  stop\n\n 'S <|endoftext|>", "\0\0x\0", "日本語" * 60, "x" * 47 + "y" * 60]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(400)), "".join(rng.choice("abcdefghij") for _ in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in bpe.encode(df, path, pattern, decoded=True).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(bytes(r.tokens), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == library.decode_bytes(ids)
    again = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in again.collect())


def _der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secrets_base_and_structure(spark):
    b64 = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    jwt = ".".join([b64(json.dumps({"alg": "HS256"}).encode()), b64(b'{"sub":1}'), b64(b"signature")])
    fake = ".".join([b64(b'{"alg": 5}'), b64(b'{"sub":1}'), "abc"])
    key = _der(0x30, b"".join(_der(0x02, bytes([i + 1]) * 20) for i in range(9)))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
    broken = base64.b64encode(key[:-3]).decode()
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))
    texts = [
        f"see {jwt} and {fake}",
        pem,
        f"hex {key.hex()} but {broken}",
        base64.b64encode(blob).decode(),
        "Password: 'abc' api_key=abcdef1 secret:token= zzzzzzzz AKIA" + "A1" * 8 + " deadbeef" * 3 + " " + "0123456789abcdef" * 2,
        "paſſword=abcdefgh toKen=abcdefgh toKen=abcdefgh",
        None,
    ]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {k: [x for x, _, _ in v if x not in ("assign", "hex", "access")] for k, v in found.items()}
    assert kinds == {0: ["jwt"], 1: ["pem"], 2: ["der"], 3: ["sshkey"], 4: [], 5: [], 6: []}
    for i, t in enumerate(texts):
        t = t or ""
        want = []
        for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            want += [("assign", *m.span())] if len(m[2]) >= 6 else []
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in found[i] if s[0] in ("assign", "access", "hex")] == sorted(want, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_are_confirmed_by_structure():
    """Keys whose inner lengths hold are found however they are written; junk behind the right first bytes isn't."""
    size = lambda x: len(x).to_bytes(4, "big") + x
    key = _der(0x30, b"".join(_der(0x02, bytes([i + 1]) * 20) for i in range(9)))
    blob = b"".join(map(size, (b"ssh-ed25519", b"k" * 32)))
    body = b"openssh-key-v1\0" + b"".join(map(size, (b"none", b"none", b""))) + (1).to_bytes(4, "big") + size(blob)
    ssh = body + size(b"abcdabcd" + b"x" * 60)
    kinds = lambda t: [secrets.KINDS[k] for _, _, k in secrets.scan(t) if k > 2]
    text = lambda x: base64.b64encode(x).decode()
    url = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    assert kinds(text(ssh)) == kinds(ssh.hex()) == kinds(blob.hex()) == ["sshkey"]
    for junk in (b"openssh-key-v1\0" + b"junk" * 30, ssh[:-1], ssh + b"\0", body + size(b"abcdabce" + b"x" * 60)):
        assert kinds(text(junk)) == kinds(junk.hex()) == []
    assert kinds(url(key)) == kinds("see\n" + base64.encodebytes(key).decode() + "next words here") == ["der"]
    assert kinds(".".join([url(b'{ "alg": "HS256"}'), url(b'{ "sub":1}'), "abc"])) == ["jwt"]
    armour = "-----BEGIN OPENSSH PRIVATE KEY-----\n{}-----END OPENSSH PRIVATE KEY-----"
    assert kinds(armour.format(base64.encodebytes(ssh).decode())) == ["pem"]
    assert kinds(armour.format(base64.encodebytes(b"openssh-key-v1\0" + b"junk" * 30).decode())) == []


def test_cross_entropy_difference(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary[: 5 + 5 * (k % 5)]) for _ in range(rng.randint(0, 40))) for k in range(40)] + [None, "rare one"]
    target = [k % 3 == 0 for k in range(len(texts))]
    docs = [[w.lower() for w in WORDS.findall(t or "")] for t in texts]
    count = collections.Counter(w for d in docs for w in d)
    p = lm.Bigrams(vocabulary=20, block_tokens=100)
    known = {w for w, _ in sorted(((w, n) for w, n in count.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:20]}
    pairs = [[(a, b) for a, b in zip(["<s>", *x], x, strict=False)] for x in ([w if w in known else "<u>" for w in d] for d in docs)]
    size = len(known) + 2

    def losses(chosen):
        c = collections.Counter(x for ps, ok in zip(pairs, chosen, strict=True) if ok for x in ps)
        left, kinds, word = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in c.items():
            left[a] += n
            kinds[a] += 1
            word[b] += n
        total = sum(word.values())
        one = lambda b: (word[b] + 1) / (total + size)
        return lambda a, b: -math.log2((c[a, b] + kinds[a] * one(b)) / (left[a] + kinds[a]) if left[a] else one(b))

    lt, lb = losses(target), losses([True] * len(texts))
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, target, strict=True))], "doc_id long, text string, target boolean").repartition(3)
    for r in lm.cross_entropy_difference(df, p=p).collect():
        ps = pairs[r.doc_id]
        assert r.n_tokens == len(ps)
        if not ps:
            assert r.score is None
        else:
            assert abs(r.target_loss - sum(lt(*x) for x in ps) / len(ps)) < 1e-9
            assert abs(r.score - sum(lt(*x) - lb(*x) for x in ps) / len(ps)) < 1e-9


def test_kneser_ney_probabilities(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.15)), 40)}" for _ in range(60)) for _ in range(40)]
    p = kneser.KneserNey(unseen_words=1000)
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"), p)
    docs = [["<s>", *WORDS.findall(t)] for t in texts]
    c = collections.Counter(x for d in docs for x in zip(d, d[1:], strict=False))
    d2 = kneser._discounts(collections.Counter(n for n in c.values() if n <= 4))
    a = collections.Counter(b for _, b in c)
    d1 = kneser._discounts(collections.Counter(n for n in a.values() if n <= 4))
    cut = lambda n, d: d[min(n, 3) - 1]
    total, share = sum(a.values()), sum(cut(n, d1) for n in a.values()) / sum(a.values()) / (len(a) + 1000)
    p1 = lambda w: max(a[w] - cut(a[w], d1), 0) / total + share if a[w] else share
    left = collections.Counter()
    aside = collections.Counter()
    for (v, _), n in c.items():
        left[v] += n
        aside[v] += cut(n, d2)

    def prob(v, w):
        if not left[v]:
            return p1(w)
        n = c[v, w]
        return (max(n - cut(n, d2), 0) if n else 0) / left[v] + aside[v] / left[v] * p1(w)

    from tidemark.llm import rolling

    def h(words):
        raw = [w.encode() for w in words]
        s = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return rolling.between(rolling.sums(np.frombuffer(b"".join(raw), np.uint8)), s[:-1], s[1:])

    words = [f"w{i}" for i in range(45)]
    hs = dict(zip(words, h(words), strict=True)) | {"<s>": kneser.START}
    for v in ["<s>", "w0", "w3", "w44"]:
        got = model.log2(np.full(len(words), hs[v], np.uint64), h(words))
        assert np.allclose(2**got, [prob(v, w) for w in words], rtol=1e-9)
    # What the words seen and the unseen ones have adds up to one.
    seen = sorted(a)
    assert abs(sum(prob("w0", w) for w in seen) + 1000 * prob("w0", "never") - 1) < 1e-9


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = kneser.quality_classifier(docs, labels, kneser.KneserNey(seed=1)).join(labels, "doc_id").filter("n_words >= 20")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.5


def _bigram_scores(texts, target, known):
    """(target loss, background loss) a token of each text; words that aren't known are one."""
    docs = [[w.lower() if w.lower() in known else "<u>" for w in WORDS.findall(t)] for t in texts]
    pairs = [list(zip(["<s>", *d], d, strict=False)) for d in docs]
    size, out = len(known) + 2, []
    for chosen in (target, [True] * len(texts)):
        c = collections.Counter(x for ps, ok in zip(pairs, chosen, strict=True) if ok for x in ps)
        left, kinds, word = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in c.items():
            left[a] += n
            kinds[a] += 1
            word[b] += n
        one = {b: (word[b] + 1) / (sum(word.values()) + size) for b in [*known, "<u>"]}
        loss = lambda a, b: -math.log2((c[a, b] + kinds[a] * one[b]) / (left[a] + kinds[a]) if left[a] else one[b])  # noqa: E731, B023
        out.append([sum(loss(*x) for x in ps) / len(ps) for ps in pairs])
    return list(zip(*out, strict=True))


def test_cross_entropy_vocabulary_is_every_repeated_word(spark):
    """More words than the 16,000 that were once the bound, and one of over 64 bytes; all that occur twice are in the model."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(18_000)] + ["z" * 90]
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(2)] + ["once V1 v2", "z" * 90 + " v3 v3 never"]
    target = [True, False, False, True]
    want = _bigram_scores(texts, target, set(words))
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, target, strict=True))], "doc_id long, text string, target boolean").repartition(3)
    got = {r.doc_id: (r.target_loss, r.background_loss) for r in lm.cross_entropy_difference(df, p=lm.Bigrams(block_tokens=5_000)).collect()}
    for i, pair in enumerate(want):
        assert np.allclose(got[i], pair, rtol=0, atol=1e-9)


def test_line_runs_of_over_fifty_words(spark):
    """Repeated runs count by lines or by words: one long line, two half-long ones, and texts of fewer than three lines."""
    rng = random.Random(3)
    passage = lambda n: " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(n))
    pool = [passage(n) for n in (51, 50, 30, 21, 20, 60, 3, 2, 1)]
    texts = [pool[0], "x\n" + pool[0], pool[1], "y\n" + pool[1], None, "", pool[0] + "\n \n" + pool[0]]
    texts += ["\n".join(rng.choice([*pool, f"own {k}", " "]) for _ in range(rng.randint(1, 9))) for k in range(40)]
    solid = [[x for x in (t or "").split("\n") if WORDS.search(x)] for t in texts]
    seen, want = set(), {}
    for k, ls in enumerate(solid):
        gone = set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if (j - i >= 3 or sum(len(WORDS.findall(x)) for x in run) > 50) and run in seen:
                    gone |= set(range(i, j))
            # From here on a run that started at i is an earlier one.
            seen |= {tuple(ls[i:j]) for j in range(i + 1, len(ls) + 1)}
        want[k] = (len(ls), len(gone), [x for i, x in enumerate(ls) if i not in gone])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, [x for x in (r.text or "").split("\n") if WORDS.search(x)]) for r in lines.dedup_lines(df).collect()}
    assert got == want
    assert want[1][1] == 1 and want[3][1] == 0
