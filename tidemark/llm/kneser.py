"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

1. Trusted documents are split in two by a hash of their id. The first half trains, whole.
2. All documents become blocks of tokens (see ``lm``). Each block sends its different bigrams, with how often they occur in
   training documents, to shards by name, and gets their totals; then its words, with what they follow and precede, and gets
   context totals, counts of counts and continuation counts. So no machine holds the model, and it grows with the trusted text.
3. Each block scores its documents by these totals. Discounts are a few sums over the shards.
4. The other half of the trusted documents sets, for each language, the threshold: a quantile of bits per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import lm, rolling
from .common import bucketed, discard, removing_shuffles, small_side, written


@dataclass(frozen=True)
class KneserNey:
    #: Words that a text may hold besides those seen; together they get what the unigram level sets aside.
    unseen_words: int = 1_000_000
    #: A document is kept up to this quantile of its language's trusted documents, plus slack bits per word.
    quantile: float = 0.995
    slack: float = 0.25
    #: Texts of fewer words aren't judged; languages with fewer trusted documents to set a threshold use that of all.
    min_words: int = 20
    min_documents: int = 50
    seed: int = 71
    #: Tokens to a block, and to a shard's share of them.
    block_tokens: int = 3_000_000
    #: Rounds in which bigrams go to their shards, one group of shards after the other: only one round's files are on disk at a time.
    rounds: int = 3


START = np.uint64(0x5354415254)
_GRID = 64


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return rolling.mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _bigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word before, word) as hashes; a text's first word follows START."""
    text, w = rolling.word_hashes(data, starts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    first = np.ones(len(w), bool)
    first[1:] = text[1:] != text[:-1]
    v[first] = START
    return text, v, w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, starts in rolling.chunks(batch.column(0)):
            _, v, w = _bigrams(data, starts)
            both, n = np.unique(np.stack([v, w], axis=1), axis=0, return_counts=True) if len(w) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64)), pa.array(n, pa.int64())], names=["v", "w", "n"])


def _discounts(found: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, most: min(max(x, 0.05), most)
    return clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.9), clip(3 - 4 * y * n4 / n3, 2.85)


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


@dataclass(frozen=True)
class Model:
    """Log2 probabilities of seen bigrams, log2 weights of seen contexts, log2 probabilities of seen words; keys sorted."""

    pairs: np.ndarray
    pair_log: np.ndarray
    contexts: np.ndarray
    context_log: np.ndarray
    words: np.ndarray
    word_log: np.ndarray
    unseen_log: float

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log2(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log2 probability of each word after the word before it."""
        at, seen = self.find(self.words, w)
        lower = np.where(seen, self.word_log[at] if len(self.words) else 0.0, self.unseen_log)
        at, seen = self.find(self.contexts, v)
        lower = lower + np.where(seen, self.context_log[at] if len(self.contexts) else 0.0, 0.0)
        at, seen = self.find(self.pairs, _pair(v, w))
        return np.where(seen, self.pair_log[at] if len(self.pairs) else 0.0, lower)


def _sorted(table: pa.Table, key: np.ndarray, value: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    return key[order], np.log2(table.column(value).to_numpy()[order])


def train(texts: DataFrame, p: KneserNey = KneserNey(), text_col: str = "text") -> Model:
    """The model of ``texts``, which the caller has bounded: its tables come to the driver. ``quality_classifier`` has the same model in shards."""
    counts = written(texts.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(_count, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n")))
    low = lambda d, c: {r[0]: r[1] for r in d.filter(F.col(c) <= 4).groupBy(c).count().collect()}
    d2 = _discounts(low(counts, "n"))
    words = counts.groupBy("w").agg(F.count("*").alias("a"))
    d1 = _discounts(low(words, "a"))
    total = words.agg(F.sum("a").alias("all"), F.sum(_discount(F.col("a"), d1)).alias("aside"), F.count("*").alias("kinds")).first()
    if not total["all"]:
        none, empty = np.zeros(0, np.uint64), np.zeros(0)
        return Model(none, empty, none, empty, none, empty, float(-np.log2(p.unseen_words)))
    share = total["aside"] / total["all"] / (total["kinds"] + p.unseen_words)
    words = words.select("w", (F.greatest(F.col("a") - _discount(F.col("a"), d1), F.lit(0.0)) / float(total["all"]) + share).alias("p1"))
    contexts = counts.groupBy("v").agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d2)).alias("aside")).select("v", "total", (F.col("aside") / F.col("total")).alias("g"))
    pairs = counts.join(contexts, "v").join(words, "w").select("v", "w", (F.greatest(F.col("n") - _discount(F.col("n"), d2), F.lit(0.0)) / F.col("total") + F.col("g") * F.col("p1")).alias("p"))
    key = lambda t, c: t.column(c).to_numpy().view(np.uint64)
    t2, t1, t0 = pairs.toArrow(), contexts.select("v", "g").toArrow(), words.toArrow()
    return Model(*_sorted(t2, _pair(key(t2, "v"), key(t2, "w")), "p"), *_sorted(t1, key(t1, "v"), "g"), *_sorted(t0, key(t0, "w"), "p1"), unseen_log=float(np.log2(share)))


#: What shards add up for a word: the different words before it, its occurrences as a context, and of the bigrams it begins those that occur once, twice, ... and oftener.
_WIDTH, _MOST = 7, 4
_ANSWER = "block long, shard long, payload binary, told array<bigint>"


def _totals(width: int, tell):
    """Group function of a shard: the answers to blocks, and in one row what ``tell`` makes of the totals."""

    def run(asked: pa.Table) -> pa.Table:
        asked, payload, _, totals = lm._merged(asked, width)
        told = [np.asarray(tell(totals), np.int64)] + [np.zeros(0, np.int64)] * (len(payload) - 1)
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "payload": pa.array(payload, pa.binary()), "told": pa.array(told, pa.list_(pa.int64()))})

    return run


def _counts_of_counts(n: np.ndarray) -> list[int]:
    """How many totals are 1, 2, 3 and 4, how many are not 0, and their sum."""
    return [*(int(np.count_nonzero(n == k)) for k in range(1, 5)), int(np.count_nonzero(n)), int(n.sum())]


def _ask_contexts(shards: int):
    """Cogroup function: a block's words to shards. A bigram counts as one kind in the block that has it first."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, c = lm._counted(blocks, answers, 1)
        n, mask = lm._answers(lm._about(answers, "bigrams"), 1, 0, 1)
        kinds = [(mask > 0) & (n == k if k <= _MOST else n > _MOST) for k in range(1, _MOST + 2)]
        values = [c.per_word(c.right, mask > 0), c.per_word(c.left, c.n_target), *(c.per_word(c.left, k) for k in kinds)]
        order = np.argsort(c.words)
        return pa.Table.from_batches([lm._requests(blocks.column("block")[0].as_py(), c.words[order], [v[order] for v in values], shards)])

    return run


def _ask_bigrams(shards: int, only: range):
    """Cogroup function: a block's bigrams, with their counts in training documents, to some of the shards."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, c = lm._counted(blocks, answers, 1)
        return pa.Table.from_batches([lm._requests(blocks.column("block")[0].as_py(), c.names, [c.n_target], shards, only)])

    return run


def _cut(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([n == 1, n == 2], d[:2], d[2])


def _score(d2: tuple[float, float, float], d1: tuple[float, float, float], n_all: int, share: float):
    """Cogroup function: a block, and the totals of its bigrams and words, to (id, n_words, bits)."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, c = lm._counted(blocks, answers, 1)
        (n,), word = lm._answers(lm._about(answers, "bigrams"), 1, 0), lm._answers(lm._about(answers, "contexts"), _WIDTH, *range(_WIDTH))
        loss = np.zeros(0)
        if len(c.n):
            place = np.empty(len(c.words), np.int64)
            place[np.argsort(c.words)] = np.arange(len(c.words))
            a, total, ones, twos, *more = (x[place] for x in word)
            p1 = np.where(a > 0, np.maximum(a - _cut(a, d1), 0.0) / max(n_all, 1) + share, share)
            aside = d2[0] * ones + d2[1] * twos + d2[2] * sum(more)
            weight = np.where(total > 0, aside / np.maximum(total, 1), 1.0)
            own = np.where(n > 0, np.maximum(n - _cut(n, d2), 0.0), 0.0) / np.maximum(total[c.left], 1)
            loss = -np.log2(own + weight[c.left] * p1[c.right])
        bits = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=loss[c.which], minlength=len(sizes)) / np.maximum(sizes, 1)
        return pa.table({"id": blocks.column("ids")[0].values, "n_words": pa.array(sizes), "bits": pa.array(bits, mask=sizes == 0)})

    return run


def _scores(docs: DataFrame, train: DataFrame, p: KneserNey) -> DataFrame:
    """(id, lang, n_words, bits) of ``docs`` (id, lang, text) by the model of those whose id ``train`` has; written."""
    id_type = dict(docs.dtypes)["id"]
    key = f"struct<id:{id_type},lang:string>"
    source = docs.select(F.struct("id", "lang").alias("id"), F.lit(False).alias("target"), "text")
    schema = f"block long, ids array<{key}>, targets array<boolean>, sizes array<int>, words binary, tokens binary, n_all long"
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = bucketed(source.mapInArrow(lm._blocks(None, lm.Bigrams(block_tokens=p.block_tokens)), schema), "block", -(-n_bytes // lm.Bigrams.bucket_bytes))
    shards = max(1, -(-int(blocks.agg(F.sum("n_all")).first()[0] or 0) // p.block_tokens))

    def totals(asked: DataFrame, width: int, about: str, tell) -> DataFrame:
        return written(asked.groupBy("shard").applyInArrow(_totals(width, tell), _ANSWER)).withColumns({"about": F.lit(about), "places": F.lit(None).cast("array<int>")})

    def meet(answers: DataFrame, f, out: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, out)

    def told(answers: DataFrame) -> list[int]:
        """Sums over shards of what they tell, six numbers each."""
        sums = answers.filter(F.size("told") > 0).agg(*(F.sum(F.col("told")[i]) for i in range(6))).first()
        return [int(x or 0) for x in sums]

    chosen = train.select(F.col("id").alias("train_id"))
    found = blocks.select("block", F.posexplode("ids").alias("at", "x")).join(chosen, F.col("x.id") == F.col("train_id"), "left_semi")
    none = {"shard": F.lit(0).cast("long"), "payload": F.lit(None).cast("binary"), "told": F.array().cast("array<bigint>"), "about": F.lit("targets")}
    targets = written(found.groupBy("block").agg(F.collect_list("at").alias("places"))).withColumns(none)
    parts = [totals(meet(targets, _ask_bigrams(shards, range(r, shards, p.rounds)), lm._REQUEST), 1, "bigrams", lambda t: _counts_of_counts(t[0])) for r in range(min(p.rounds, shards))]
    bigrams = parts[0]
    for part in parts[1:]:
        bigrams = bigrams.unionByName(part)
    answers = targets.unionByName(bigrams)
    contexts = totals(meet(answers, _ask_contexts(shards), lm._REQUEST), _WIDTH, "contexts", lambda t: _counts_of_counts(t[0]))
    d2 = _discounts(dict(enumerate(told(bigrams)[:4], 1)))
    *low, kinds, n_all = told(contexts)
    d1 = _discounts(dict(enumerate(low, 1)))
    aside = d1[0] * low[0] + d1[1] * low[1] + d1[2] * (kinds - low[0] - low[1])
    share = aside / n_all / (kinds + p.unseen_words) if n_all else 1 / p.unseen_words
    scored = meet(answers.unionByName(contexts), _score(d2, d1, n_all, share), f"id {key}, n_words long, bits double")
    out = written(scored.select("id.id", "id.lang", "n_words", "bits"))
    discard(targets, *parts, contexts, blocks)
    return out


@removing_shuffles
def quality_classifier(docs: DataFrame, labels: DataFrame, p: KneserNey = KneserNey(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: id, ``n_words``, ``perplexity`` (per word), ``threshold``, ``kept``.

    ``labels`` names the trusted documents (``label_col`` 1). Texts without words have no perplexity and aren't
    kept; texts of fewer than ``min_words`` words are kept unjudged. A null language is a language of its own.
    Where no trusted document can set a threshold, all are kept. Rows that repeat an id get the same result where
    their texts are the same. Other columns are ignored; an empty table gives an empty result.

    Scale: the model is of all training text and lies in shards; texts are read once and not shuffled, only each block's different
    bigrams and words are, and what is known of them. Thresholds come from counts of bits on a grid, combined before they shuffle.
    """
    id_type = dict(docs.dtypes)[id_col]
    side = F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(2))
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast(id_type).alias("id")).filter("id IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))

    scores = _scores(rows, trusted.filter(side == 0), p)

    # Thresholds: the quantile of bits on a grid, for each language and for all together.
    own = scores.filter(F.col("n_words") >= p.min_words).join(trusted.filter(side == 1), "id", "left_semi")
    cells = own.groupBy("lang", F.ceil(F.col("bits") * _GRID).alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.union(cells.groupBy("cell").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string"), "cell", "n"))
    by = Window.partitionBy("lang")
    ranked = cells.withColumns({"upto": F.sum("n").over(by.orderBy("cell")), "all": F.sum("n").over(by)})
    limits = ranked.filter(F.col("upto") >= p.quantile * F.col("all")).groupBy("lang").agg((F.min("cell") / _GRID + p.slack).alias("limit"), F.first("all").alias("all"))
    pooled = limits.filter("lang IS NULL").select(F.col("limit").alias("pooled"))
    some = limits.filter((F.col("lang").isNotNull()) & (F.col("all") >= p.min_documents)).select(F.col("lang").alias("limit_lang"), "limit")
    languages, _ = small_side(some, 100_000)
    everywhere = pooled.first()
    limit = F.coalesce(F.col("limit"), F.lit(everywhere["pooled"] if everywhere else None).cast("double"))
    judged = scores.join(languages, F.col("lang") == F.col("limit_lang"), "left")
    kept = (F.col("n_words") > 0) & ((F.col("n_words") < p.min_words) | limit.isNull() | (F.col("bits") <= limit))
    return judged.select(F.col("id").alias(id_col), "n_words", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), kept.alias("kept"))
