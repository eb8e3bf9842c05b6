"""Ranked lexical search of a query set over all documents, with block-max pruning.

1. Forward index: each document's number of terms and, for the terms that queries use, how often it has them. Totals and
   document frequencies come from it, then each term's weight.
2. Documents in order of id are cut into blocks of ``BLOCK`` within range partitions. A block holds its documents' terms
   with what each adds to a score (its impact), and the greatest impact of every term.
3. A query's bound in a block is the sum of its terms' greatest impacts there: no document of the block scores more.
4. Each query sorts blocks by bound and scores documents block after block until bounds drop below the score of its
   last result. A cluster scores blocks side by side, so this goes in waves: the blocks of the highest bounds, the
   next ones whose bound reaches the threshold, then every block left whose bound reaches it. Within a wave, a task raises the
   threshold with what it has found. A bound equal to the threshold is scored, since ties go by id.

Queries go in groups of a bounded size, each over all documents, so vocabulary and weights are bounded in every task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

#: Documents of a block; bytes of text of one group of queries and their number.
BLOCK = 256
QUERY_BYTES, QUERY_ROWS = 16_000_000, 20_000
#: Last ranks, by bound, of the blocks that the first waves score.
WAVES = (4, 32)
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

#: A-Z in lower case; all ASCII characters but letters and digits become spaces.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded size: maximal runs of ASCII letters, digits and other characters beyond ASCII."""
    raw = text.encode() if isinstance(text, str) else text or b""
    data, at = raw.translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass(frozen=True)
class QuerySet:
    """Queries of one group: a number for each term, and each query's distinct terms."""

    vocabulary: dict[bytes, int]
    names: list[int]
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list) -> QuerySet:
        vocabulary: dict[bytes, int] = {}
        names, terms = [], []
        for name, text in rows:
            own = {w for piece in terms_of(text) for w in piece}
            if own:
                names.append(name)
                terms.append(np.array(sorted(vocabulary.setdefault(w, len(vocabulary)) for w in sorted(own)), np.int64))
        return QuerySet(vocabulary, names, terms)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def _forward(vocabulary: dict[bytes, int]) -> Callable:
    """Arrow function: (id, text) to (id, n, terms, tfs); documents without terms have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, terms, tfs = [], [], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary())):
                total, met = 0, []
                for piece in terms_of(raw.as_py()):
                    total += len(piece)
                    met.append(np.array([v for w in piece if (v := vocabulary.get(w)) is not None], np.int64))
                if total:
                    own, times = np.unique(np.concatenate(met), return_counts=True)
                    rows.append(i), n.append(total), terms.append(own), tfs.append(times)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int64())], names=["id", "n", "terms", "tfs"])

    return run


def _frequencies(size: int) -> Callable:
    """Arrow function: (terms) to (term, df) of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some], pa.int64())], names=["term", "df"])

    return run


def _blocks(weights: np.ndarray, n_docs: int, n_terms: int) -> Callable:
    """Arrow function: documents in order to blocks (block, ids, starts, terms, impacts, max_terms, max_impacts)."""

    def block(number: int, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
        m = 100 - 90 + 90 * n * n_docs // n_terms
        impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes)))
        order = np.argsort(terms, kind="stable")
        most, first = np.unique(terms[order], return_index=True)
        highest = np.maximum.reduceat(impacts[order], first) if len(most) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        lists = [_lists([v], k) for v, k in ((starts, pa.int32()), (terms, pa.int32()), (impacts, pa.int64()), (most, pa.int32()), (highest, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole, *lists], names=["block", "ids", "starts", "terms", "impacts", "max_terms", "max_impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            left = t if left is None else pa.concat_tables([left, t])
            while left.num_rows >= BLOCK:
                yield cut(number, left.slice(0, BLOCK))
                number, left = number + 1, left.slice(BLOCK)
        if left is not None and left.num_rows:
            yield cut(number, left)

    def cut(number: int, t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        terms, tfs = one(t["terms"]), one(t["tfs"])
        sizes = np.diff(terms.offsets.to_numpy())
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return block(number, one(t["ids"]), one(t["n"]).to_numpy(), sizes, flat(terms), flat(tfs))

    return run


def _bounds(queries: QuerySet) -> Callable:
    """Arrow function: (block, max_terms, max_impacts) to (query, block, bound)."""
    flat = np.concatenate(queries.terms)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in queries.terms])[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(queries.vocabulary), np.int64)
        for batch in batches:
            for block, terms, impacts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                at = terms.values.to_numpy()
                most[at] = impacts.values.to_numpy()
                bound = np.add.reduceat(most[flat], starts)
                most[at] = 0
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block.as_py()), pa.int64()), pa.array(bound[some], pa.int64())], names=["query", "block", "bound"])

    return run


def _scores(queries: QuerySet, top: int, id_type: pa.DataType) -> Callable:
    """Arrow function: (starts, terms, impacts, ids, asked), asked being (query, threshold) pairs, to the task's best (query, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros(len(queries.vocabulary), bool)
        best: dict[int, list] = {}
        for batch in batches:
            for starts, terms, impacts, ids, asked in zip(*batch.columns, strict=True):
                starts, terms, impacts = (c.values.to_numpy() for c in (starts, terms, impacts))
                for pair in asked.as_py():
                    q = pair["query"]
                    found = best.setdefault(q, [])
                    least = max(pair["least"], 1, found[-1][0] if len(found) == top else 1)
                    member[queries.terms[q]] = True
                    score = np.add.reduceat(np.where(member[terms], impacts, 0), starts) if len(terms) else np.zeros(0, np.int64)
                    member[queries.terms[q]] = False
                    good = np.flatnonzero(score >= least)
                    if len(good):
                        # Documents of a block stand in order of id, so a stable order keeps ties right.
                        good = good[np.argsort(-score[good], kind="stable")[:top]]
                        new = [(int(score[i]), ids.values[int(i)].as_py()) for i in good]
                        best[q] = heapq.nsmallest(top, found + new, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())], names=["query", "id", "score"])

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search(docs: DataFrame, queries: QuerySet, top: int) -> DataFrame | None:
    """(query, id, score, rank) of one group of queries over (id, text)."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)["id"]
    forward = docs.mapInArrow(_forward(queries.vocabulary), f"id {id_type}, n long, terms array<int>, tfs array<long>")
    forward = written(forward.withColumn("uid", F.monotonically_increasing_id()))
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    size = len(queries.vocabulary)
    df = np.zeros(size, np.int64)
    # At most as many rows as the group's vocabulary.
    for r in forward.select("terms").mapInArrow(_frequencies(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    made = f"block long, ids array<{id_type}>, starts array<int>, terms array<int>, impacts array<long>, max_terms array<int>, max_impacts array<long>"
    # Documents without any of the terms can't score.
    ordered = forward.filter(F.size("terms") > 0).repartitionByRange("id", "uid").sortWithinPartitions("id", "uid").select(F.col("id").alias("ids"), "n", "terms", "tfs")
    blocks = written(ordered.mapInArrow(_blocks(weights, n_docs, n_terms), made))
    bounds = written(blocks.select("block", "max_terms", "max_impacts").mapInArrow(_bounds(queries), "query int, block long, bound long"))
    leading = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    lead = written(bounds.withColumn("at", F.row_number().over(leading)).filter(F.col("at") <= WAVES[-1]))

    arrow_type = pa.schema(blocks.limit(0).toArrow().schema).field("ids").type.value_type
    found, least = None, spark.createDataFrame([], "query int, least long")
    for wave in range(len(WAVES) + 1):
        if wave < len(WAVES):
            pairs = lead.filter((F.col("at") > (WAVES[wave - 1] if wave else 0)) & (F.col("at") <= WAVES[wave])).drop("at")
        else:
            pairs = bounds.join(lead.select("query", "block"), ["query", "block"], "left_anti")
        pairs = pairs.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0))).filter(F.col("bound") >= F.col("least"))
        asked = pairs.groupBy("block").agg(F.collect_list(F.struct("query", "least")).alias("asked"))  # a group's queries at most
        asked, _ = small_side(asked, 1_000_000)
        scored = blocks.join(asked, "block").select("starts", "terms", "impacts", "ids", "asked").mapInArrow(_scores(queries, top, arrow_type), f"query int, id {id_type}, score long")
        found = written(_best(scored if found is None else scored.unionByName(found.drop("rank")), top))
        least = found.filter(F.col("rank") == top).select("query", F.col("score").alias("least"))
    return found


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each row of ``items``, highest score first, ties by ascending id, nulls last.

    Only scores above 0 count. Null and empty texts have no terms: such documents count nowhere, such items find nothing.
    Repeated documents are documents of their own, repeated items searches of their own. Texts of any length are read whole.
    Other columns are ignored. Empty tables give an empty result.

    Scale: one pass over the texts for each group of queries; then the forward index alone is sorted and read. Bounds are
    one row for each query and block. Results of a task are ``top`` rows a query.
    """
    spark = docs.sparkSession
    types = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    asked = written(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).withColumn("uid", F.monotonically_increasing_id()))
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-size[0] // QUERY_ROWS), -(-size[1] // QUERY_BYTES))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], f"item {types[1]}, rank int, id {types[0]}, score long")
    for g in range(groups):
        # The rows of one group of queries, bounded above.
        queries = QuerySet.of([(r.uid, r.text) for r in asked.filter(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g).select("uid", "text").collect()])
        found = _search(source, queries, top) if queries.names else None
        if found is not None:
            names = spark.createDataFrame(list(enumerate(queries.names)), "query int, uid long")
            out = out.unionByName(found.join(names, "query").join(asked, "uid").select("item", "rank", "id", "score"))
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
