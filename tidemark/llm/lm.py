"""Language-model scoring by cross-entropy difference.

Two bigram models are counted over the same documents with one vocabulary: the target model over trusted
documents, the background model over all. A document's score is its loss per token under the target model less that
under the background model; the lower, the more it reads like the target.

1. Documents are rewritten as blocks of token numbers, some three million to a block. The blocks are a table bucketed by
   block, written once; in what follows only answers travel to them.
2. Every word that occurs ``min_count`` times over all documents is in the vocabulary, however many there are; the
   rest are one unknown word.
3. Each block counts its bigrams, target and all. The model is their sum over blocks.
4. Each block gets the counts of its own bigrams and contexts, and its documents are scored.

Words and bigrams are named by 64-bit hashes. What has to be summed over blocks (words, bigrams, contexts) goes to
shards: a block sends each shard its slice of sorted names with counts, and the shard answers with the totals in
the same order, without names. So no machine holds the vocabulary or the model, a name costs one entry a block
however often it occurs, and the entries are compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import bucketed, lower_ascii, words_of, written


@dataclass(frozen=True)
class Bigrams:
    #: Words in the vocabulary at most, with at most so many bytes each; None takes every word that occurs often enough.
    vocabulary: int | None = None
    word_bytes: int = 64
    min_count: int = 2
    block_tokens: int = 3_000_000
    #: Bytes of text to a bucket of the table of blocks.
    bucket_bytes: int = 16_000_000


#: Names of the start of a text and of unknown words; all others are hashes of words.
START, UNKNOWN, FIRST = 0, 1, 2
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_REQUEST, _ANSWER = "shard long, block long, payload binary", "block long, shard long, payload binary, names long"


def vocabulary(docs: DataFrame, p: Bigrams, text_col: str) -> np.ndarray:
    """Hashes of the ``p.vocabulary`` most common words, sorted. Ties go to the smaller word."""
    words = docs.select(F.explode(words_of(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.filter((F.col("n") >= p.min_count) & (F.octet_length("word") <= p.word_bytes)).orderBy(F.desc("n"), "word").limit(p.vocabulary)
    column = top.select("word").toArrow().column(0).combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint64)
    raw = [w.as_py().encode() for w in column]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    hashes = rolling.between(rolling.sums(np.frombuffer(b"".join(raw), np.uint8)), starts[:-1], starts[1:])
    return np.unique(hashes)


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes as compressed planes of bytes, their count ahead."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def _names(data: bytes) -> np.ndarray:
    """Sorted names from their packed differences."""
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _steps(names: np.ndarray) -> np.ndarray:
    return np.diff(names, prepend=np.uint64(0))


def _block(block: int, ids: pa.Array, targets: pa.Array, sizes: np.ndarray, hashes: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    """One row: documents with their sizes; names of the block's words, sorted; each token's place among them."""
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    row = [pa.array([block], pa.int64()), one(ids), one(targets), one(pa.array(sizes, pa.int32())), pa.array([_pack(_steps(hashes))], pa.binary()), pa.array([_pack(tokens.astype(np.uint32))], pa.binary())]
    return pa.RecordBatch.from_arrays([*row, pa.array([int(sizes.sum())], pa.int64())], names=["block", "ids", "targets", "sizes", "words", "tokens", "n_all"])


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different values, each element's place among them, and counts, in less memory than ``np.unique`` takes."""
    order = np.argsort(x)
    x = x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return x[fresh], which, np.diff(np.append(np.flatnonzero(fresh), len(x)))


def _known(hashes: np.ndarray, tokens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens with all but the known words as UNKNOWN."""
    kept, place, _ = _distinct(np.where(known, hashes, np.uint64(UNKNOWN)))
    return kept, place[tokens]


def _blocks(words: np.ndarray | None, p: Bigrams):
    """Arrow function: (id, target, text) to blocks; with ``words``, all others are UNKNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 24, 0, 0
        parts: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            hashes, tokens, _ = _distinct(np.concatenate([x[3] for x in parts]))
            if words is not None:
                hashes, tokens = _known(hashes, tokens, np.isin(hashes, words))
            return _block(base + made, pa.concat_arrays([x[0] for x in parts]), pa.concat_arrays([x[1] for x in parts]), np.concatenate([x[2] for x in parts]), hashes, tokens)

        for batch in batches:
            for first, last, data, starts in rolling.chunks(batch.column(2)):
                text, h = rolling.word_hashes(data, starts)
                n = last - first
                parts.append((batch.column(0).slice(first, n), batch.column(1).slice(first, n), np.bincount(text, minlength=n), h))
                held += len(h)
                if held >= p.block_tokens:
                    yield block()
                    made, held, parts = made + 1, 0, []
        if parts:
            yield block()

    return run


def _requests(block: int, names: np.ndarray, values: list[np.ndarray], shards: int, only: range | None = None) -> pa.RecordBatch:
    """A block's sorted names and their values, cut into the shards' ranges of names; with ``only``, for these shards alone."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    edges = [0, *np.searchsorted(names, bounds).tolist(), len(names)]
    rows = []
    for i in range(shards) if only is None else only:
        cut = slice(edges[i], edges[i + 1])
        if cut.stop > cut.start:
            rows.append((i, _pack(np.concatenate([_steps(names[cut]).view(np.int64), *(v[cut].astype(np.int64) for v in values)]))))
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(np.full(len(rows), block), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "block", "payload"])


def _merged(asked: pa.Table, width: int) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]:
    """A shard's entries by block, the answer to each block, the shard's different names and their totals; see ``_totals``."""
    asked = asked.sort_by("block")
    parts = [_unpack(x.as_py(), np.int64).reshape(width + 1, -1) for x in asked.column("payload")]
    names = np.concatenate([np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in parts])
    different, inverse, _ = _distinct(names)
    out, totals = np.zeros((width + 1, len(names)), np.int64), np.zeros((width, len(different)), np.int64)
    for j in range(width):
        value = np.concatenate([x[j + 1] for x in parts])
        totals[j] = np.bincount(inverse, weights=value, minlength=len(different))
        out[j] = totals[j][inverse]
        some = np.flatnonzero(value)[::-1]
        first = np.full(len(different), -1)
        first[inverse[some]] = some
        out[width, first[first >= 0]] |= 1 << j
    edges = np.cumsum([0, *(x.shape[1] for x in parts)])
    return asked, [_pack(np.ascontiguousarray(out[:, a:b]).reshape(-1)) for a, b in zip(edges[:-1], edges[1:], strict=True)], different, totals


def _totals(width: int):
    """Group function of a shard: each block's entries answered by totals over blocks and a mask, in the entries' order.

    Bit j of the mask says that the entry is the first of its name whose value j isn't 0. ``names`` is the
    number of different words among the shard's names, in one row.
    """

    def run(asked: pa.Table) -> pa.Table:
        asked, payload, different, _ = _merged(asked, width)
        count = np.zeros(len(payload), np.int64)
        count[0] = np.count_nonzero(different >= FIRST)
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "payload": pa.array(payload, pa.binary()), "names": pa.array(count)})

    return run


def _answers(rows: pa.Table, width: int, *wanted: int) -> list[np.ndarray]:
    """The wanted ones of what the shards answered to a block (totals, then the mask), in the order of its names."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in wanted]
    for x in rows.sort_by("shard").column("payload"):
        part = _unpack(x.as_py(), np.int64).reshape(width + 1, -1)
        for kept, j in zip(parts, wanted, strict=True):
            kept.append(part[j].copy())
    return [np.concatenate(parts.pop(0)) for _ in wanted]


@dataclass
class _Counted:
    """A block's different bigrams: place of the left and right word, counts, and names in ascending order of name."""

    which: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    n_target: np.ndarray
    names: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, target: np.ndarray, sizes: np.ndarray, words: np.ndarray, x: np.ndarray) -> _Counted:
        names = np.append(words, np.uint64(START))
        pair = np.zeros(len(x), np.int64)
        pair[1:] = x[:-1]
        pair[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(names) - 1  # a text's first token follows START
        pair <<= 32
        pair |= x
        del x
        pair, which, n = _distinct(pair)
        n_target = np.bincount(which[np.repeat(target, sizes)], minlength=len(pair))
        left, right = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        del pair
        name = rolling.mix(rolling.mix(names[left] * _LEFT + _RIGHT) + names[right] * _RIGHT)
        order = np.argsort(name)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return cls(place[which], left[order], right[order], n.astype(np.int32)[order], n_target.astype(np.int32)[order], name[order], names)

    def per_word(self, side: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(side, weights=weights, minlength=len(self.words)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [batch.column(n)[i] for n in names]


def _ask_words(shards: int):
    """Arrow function: the words of a block with their counts, to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, tokens in _rows(batches, ("block", "words", "tokens")):
            hashes = _names(words.as_py())
            yield _requests(block.as_py(), hashes, [np.bincount(_unpack(tokens.as_py(), np.uint32), minlength=len(hashes))], shards)

    return run


def _counted(row: pa.RecordBatch | pa.Table, answers: pa.Table, min_count: int) -> tuple[np.ndarray, _Counted]:
    """A block's document sizes and bigrams, its rare words as UNKNOWN by what the shards answered about words."""
    sizes = row.column("sizes")[0].values.to_numpy().astype(np.int64)
    words, tokens = _names(row.column("words")[0].as_py()), _unpack(row.column("tokens")[0].as_py(), np.uint32)
    (n,) = _answers(_about(answers, "words"), 1, 0)
    if len(n):
        words, tokens = _known(words, tokens, n >= min_count)
    target = row.column("targets")[0].values.to_numpy(zero_copy_only=False).astype(bool)
    for places in _about(answers, "targets").column("places"):
        target[places.values.to_numpy()] = True
    return sizes, _Counted.of(target, sizes, words, tokens)


def _about(answers: pa.Table, what: str) -> pa.Table:
    return answers.filter(pc.equal(answers.column("about"), what))


def _ask_bigrams(shards: int, min_count: int):
    """Cogroup function: a block's bigrams with their counts in all and in target documents, to shards."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, c = _counted(blocks, answers, min_count)
        return pa.Table.from_batches([_requests(blocks.column("block")[0].as_py(), c.names, [c.n, c.n_target], shards)])

    return run


def _ask_contexts(shards: int, min_count: int):
    """Cogroup function: a block's words, as the second and as the first of a bigram, to shards. A bigram counts as one kind in one block."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _, c = _counted(blocks, answers, min_count)
        (mask,) = _answers(_about(answers, "bigrams"), 2, 2)
        values = [c.per_word(c.right, c.n), c.per_word(c.right, c.n_target), c.per_word(c.left, c.n), c.per_word(c.left, c.n_target), c.per_word(c.left, mask & 1), c.per_word(c.left, mask >> 1 & 1)]
        order = np.argsort(c.words)
        return pa.Table.from_batches([_requests(blocks.column("block")[0].as_py(), c.words[order], [v[order] for v in values], shards)])

    return run


def _losses(size: int, n_all: int, n_target: int, min_count: int):
    """Cogroup function: a block, and the totals of its bigrams and contexts, to (id, n_tokens, target_loss, background_loss)."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, c = _counted(blocks, answers, min_count)
        pairs, words = _answers(_about(answers, "bigrams"), 2, 0, 1), _answers(_about(answers, "contexts"), 6, *range(6))
        place = np.empty(len(c.words), np.int64)
        place[np.argsort(c.words)] = np.arange(len(c.words))
        mean = {}
        for k, at, tokens in (("all", 0, n_all), ("target", 1, n_target)):
            loss = np.zeros(0)
            if len(c.n):
                word, total, kinds = ((words[at + j])[place] for j in (0, 2, 4))
                word = (word + 1) / (tokens + size)
                # Witten-Bell: a context gives its number of different successors to the word's own share.
                weight = (total + kinds)[c.left]
                loss = -np.log2(np.where(weight > 0, (pairs[at] + kinds[c.left] * word[c.right]) / np.maximum(weight, 1), word[c.right]))
            mean[k] = pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=loss[c.which], minlength=len(sizes)) / np.maximum(sizes, 1), mask=sizes == 0)
        return pa.table({"id": blocks.column("ids")[0].values, "n_tokens": pa.array(sizes), "target_loss": mean["target"], "background_loss": mean["all"]})

    return run


def _targets(blocks: DataFrame, target: str | DataFrame) -> tuple[DataFrame, int]:
    """Places of target documents in each block, as an answer to it, and how many tokens they have."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "targets", "sizes")).alias("at", "x"))
    if isinstance(target, str):
        rows = rows.filter("x.targets")
    else:
        rows = rows.join(target.select(F.col(target.columns[0]).alias("target_id")).distinct(), F.col("x.ids") == F.col("target_id"), "left_semi")
    found = written(rows.groupBy("block").agg(F.collect_list("at").alias("places"), F.sum("x.sizes").alias("n")))
    answer = found.select("block", F.lit(0).cast("long").alias("shard"), F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("names"), F.lit("targets").alias("about"), "places")
    return answer, int(found.agg(F.sum("n")).first()[0] or 0)


def cross_entropy_difference(docs: DataFrame, target: str | DataFrame = "target", p: Bigrams = Bigrams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens``, ``target_loss``, ``background_loss`` (bits a token), ``score`` (their difference).

    ``target`` names a boolean column that marks target documents (null counts as false), or is a table whose first
    column has their ids: then ids are shuffled to the blocks, and texts aren't. Words are what stands
    between white space, A-Z lower-cased. Texts that are null or without words have null losses. Without any
    target document the target model is uniform. Repeated rows count as often as they occur. Other columns
    are ignored; an empty table gives an empty result.

    Scale: texts are read once and not shuffled, nor are the blocks made of them: they are bucketed where they were made.
    Of a block only its different words and bigrams are sent and answered. There are as many shards as blocks' worth
    of tokens, so a shard's entries are about as many as a block's, at any size of the input.
    """
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.col(target), F.lit(False)) if isinstance(target, str) else F.lit(False)).alias("target"), F.col(text_col).alias("text"))
    words = None if p.vocabulary is None else vocabulary(source, p, "text")
    schema = f"block long, ids array<{id_type}>, targets array<boolean>, sizes array<int>, words binary, tokens binary, n_all long"
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = bucketed(source.mapInArrow(_blocks(words, p), schema), "block", -(-n_bytes // p.bucket_bytes))
    n_all = int(blocks.agg(F.sum("n_all")).first()[0] or 0)
    shards = max(1, -(-n_all // p.block_tokens))

    def totals(asked: DataFrame, width: int, about: str) -> DataFrame:
        return written(asked.groupBy("shard").applyInArrow(_totals(width), _ANSWER)).withColumns({"about": F.lit(about), "places": F.lit(None).cast("array<int>")})

    def meet(answers: DataFrame, f: Callable, out: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(f, out)

    targets, n_target = _targets(blocks, target)
    answers = targets
    if words is None:  # else all others are unknown already
        answers = answers.unionByName(totals(blocks.mapInArrow(_ask_words(shards), _REQUEST), 1, "words"))
    answers = answers.unionByName(totals(meet(answers, _ask_bigrams(shards, p.min_count), _REQUEST), 2, "bigrams"))
    contexts = totals(meet(answers, _ask_contexts(shards, p.min_count), _REQUEST), 6, "contexts")
    size = FIRST + int(contexts.agg(F.sum("names")).first()[0] or 0)
    scored = meet(answers.unionByName(contexts), _losses(size, n_all, n_target, p.min_count), f"id {id_type}, n_tokens long, target_loss double, background_loss double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
