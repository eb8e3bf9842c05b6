"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees, each a sorted array of long hash strings.

1. Equal vectors are one class, whose ``top + 1`` least ids are kept: copies cost one entry, and none of them is lost.
2. In each tree a class has a string of ``LENGTH`` bits, one for the side of each of the tree's random planes (through the mean of
   all unit vectors) that it is on. A tree is the sorted array of its strings, cut where their first bits differ; what is still
   longer than ``ARRAY`` entries is dealt to parts.
3. A query descends: in each array that shares its first bits it finds, by binary search, how many strings share 1, 2, ...
   more bits with its own, up to the longest match.
4. It ascends in all trees at once: the depth is the greatest at which the trees together hold ``budget`` strings or more.
   All of them are candidates, however many there are; a query whose trees hold fewer is compared with every vector instead.
5. Candidates are dealt to blocks of vectors, where their cosines are computed in double precision; the best go on.

The budget grows as n to the power ``GROWTH``. It is set by the hardest case, directions without any structure: tests hold the recall
against brute force above 0.9.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import dealt, name128, part_of, parts_met, small_side, written

TREES, LENGTH, SEED = 64, 62, 20240811
#: Strings to gather for a query: FACTOR * n ** GROWTH.
FACTOR, GROWTH = 4.0, 0.8
#: Entries of one sorted array, and vectors of one block.
ARRAY, BLOCK = 8192, 4096


def budget(n: int, top: int) -> int:
    """Strings of other classes to gather; a class has one in each tree, so these belong to ``top`` classes at least."""
    return max(math.ceil(FACTOR * n**GROWTH), top * TREES)


def _matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two is taken out first, so that no square overflows and nothing is rounded by it."""
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _sums(dims: int) -> Callable:
    """Arrow function: (vec) to (place, s), the task's sums of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            total += _unit(_matrix(batch.column(0), dims)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total)], names=["place", "s"])

    return run


def _strings(dims: int, mean: np.ndarray, shared: int) -> Callable:
    """Arrow function: (cid, asked, vec) to (tree, prefix, code, cid, asked), one row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        planes = rng.standard_normal((TREES, dims, LENGTH)).astype(np.float32)
        weight = 1 << np.arange(LENGTH - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            x = (_unit(_matrix(batch.column(2), dims)) - mean).astype(np.float32)
            for tree in range(TREES):
                code = (x @ planes[tree] > 0) @ weight
                columns = [pa.array(np.full(len(x), tree, np.int32)), pa.array(code >> (LENGTH - shared)), pa.array(code), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "prefix", "code", "cid", "asked"])

    return run


def _ranges(codes: np.ndarray, own: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share ``depth`` bits with ``own`` begin and end in a sorted array."""
    rest = LENGTH - depth
    first = own >> rest << rest
    return np.searchsorted(codes, first), np.searchsorted(codes, first + (np.int64(1) << rest))


def _descend(shared: int) -> Callable:
    """Arrow function: (codes, queries) to (query, counts): strings that share ``shared``, ``shared`` + 1, ... bits."""
    depths = np.arange(shared, LENGTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, queries in zip(batch.column(0), batch.column(1), strict=True):
                own = queries.values.field("code").to_numpy()
                low, high = _ranges(codes.values.to_numpy(), own[:, None], depths[None, :])
                counts = pa.array((high - low).reshape(-1).astype(np.int64))
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(depths))
                yield pa.RecordBatch.from_arrays([queries.values.field("cid"), pa.ListArray.from_arrays(ends, counts)], names=["query", "counts"])

    return run


def _ascend() -> Callable:
    """Arrow function: (codes, cids, queries), with each query's depth, to (query, found): the classes it shares so many bits with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, cids, queries in zip(*batch.columns, strict=True):
                own, cids = queries.values, cids.values.to_numpy()
                low, high = _ranges(codes.values.to_numpy(), own.field("code").to_numpy(), own.field("depth").to_numpy().astype(np.int64))
                found = np.concatenate([cids[a:b] for a, b in zip(low, high, strict=True)])
                ends = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.field("cid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=["query", "found"])

    return run


def _deal(block: int) -> Callable:
    """Arrow function: a query's candidates of all trees, each once, by block: (query, block, picks)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        found = np.unique(t["found"].combine_chunks().flatten().to_numpy())
        blocks, first = np.unique(found // block, return_index=True)
        ends = pa.array(np.append(first, len(found)).astype(np.int32))
        picks = pa.ListArray.from_arrays(ends, pa.array((found % block).astype(np.int32)))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), picks], names=["query", "block", "picks"])

    return run


def _verify(dims: int, top: int) -> Callable:
    """Arrow function: a block's vectors and the candidates in it to (query, best): (score, members) of the best ``top`` + 1 classes."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("cid").combine_chunks()
        x = _scaled(_matrix(vectors["vec"], dims))
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        members = vectors["members"].combine_chunks()
        # Ties go to the class with the least id, nulls last.
        least = members.values.take(pa.array(members.offsets.to_numpy()[:-1]))
        order = np.empty(len(x), np.int64)
        order[pc.sort_indices(least, null_placement="at_end").to_numpy()] = np.arange(len(x))
        scores, chosen, ends, queries = [], [], [0], []
        for q, vec, picks in zip(asked["query"], _scaled(_matrix(asked["qvec"], dims)) if asked.num_rows else (), asked["picks"], strict=True):
            at = picks.values.to_numpy() if picks.is_valid else np.arange(len(x))
            score = np.einsum("ij,j->i", x[at], vec) / (norms[at] * np.sqrt(np.dot(vec, vec)))
            best = np.lexsort((order[at], -score))[: top + 1]
            scores.append(score[best]), chosen.append(at[best]), queries.append(q.as_py())
            ends.append(ends[-1] + len(best))
        flat = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        best = pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), members.take(pa.array(flat))], names=["score", "members"])
        return pa.Table.from_arrays([pa.array(queries, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)], names=["query", "best"])

    return run


def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, each once, and the number of components: the commonest, of equally common ones the least."""
    x = F.col(vec_col)
    good = rows.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("vec"))
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    good = good.filter(F.col("vec").isNotNull()).filter(~F.coalesce(odd, F.lit(True)) & F.exists("vec", lambda v: v != 0)).withColumn("dims", F.size("vec"))
    size = good.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims = size["dims"] if size else 0
    return good.filter(F.col("dims") == dims).drop("dims"), dims


def classes_of(d: DataFrame, top: int) -> DataFrame:
    """(cid, vec, members, asked, a, b, parts) for each distinct vector: its least ids, whether a query has it, the parts its queries are in."""
    named = d.select("id", "vec", "asked", "name.a", "name.b", "part")
    whole = named.groupBy("a", "b").agg(F.first("vec").alias("vec"), F.max("asked").alias("asked"), parts_met(F.when(F.col("asked"), F.col("part"))))
    order = Window.partitionBy("a", "b").orderBy(F.col("id").asc_nulls_last())
    least = named.select("id", "a", "b").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("least"))
    both = whole.join(least.select("a", "b", F.transform("least", lambda x: x["id"]).alias("members")), ["a", "b"])
    return written(numbered(both, ["a", "b"], "cid").withColumn("cid", F.col("cid") - 1))


def _candidates(classes: DataFrame, dims: int, n: int, top: int) -> DataFrame:
    """(query, block, picks) for every class that a query has; null picks stand for the whole block."""
    want = TREES + budget(n, top)  # a query meets itself in every tree
    shared = max(0, int(math.log2(TREES * n / (4 * want))) if TREES * n > 4 * want else 0)
    mean = np.zeros(dims)
    for r in classes.select("vec").mapInArrow(_sums(dims), "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
        mean[r.place] = r.s / n
    entries = written(classes.select("cid", "asked", "vec").mapInArrow(_strings(dims, mean, shared), "tree int, prefix long, code long, cid long, asked boolean"))

    # An array is cut by the first bits; a longer one is dealt to parts, its queries too.
    sizes, _ = small_side(entries.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") > ARRAY), 1_000_000)
    parts = lambda seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.coalesce(F.ceil(F.col("n") / ARRAY), F.lit(1)))
    placed = entries.join(sizes, ["tree", "prefix"], "left")
    arrays = placed.withColumn("part", parts(1)).groupBy("tree", "prefix", "part").agg(F.sort_array(F.collect_list(F.struct("code", "cid"))).alias("e"))
    arrays = written(arrays.select("tree", "prefix", F.transform("e", lambda x: x["code"]).alias("codes"), F.transform("e", lambda x: x["cid"]).alias("cids")))
    asking = written(placed.filter("asked").withColumn("part", parts(2)).select("tree", "prefix", "part", "cid", "code"))

    def met(queries: DataFrame, *columns: str) -> DataFrame:
        groups = queries.groupBy("tree", "prefix", "part").agg(F.collect_list(F.struct(*[c for c in ("cid", "code", "depth") if c in queries.columns])).alias("queries"))
        return arrays.join(groups.drop("part"), ["tree", "prefix"]).select(*columns, "queries")

    counts = met(asking, "codes").mapInArrow(_descend(shared), "query long, counts array<long>")
    at = range(LENGTH - shared + 1)
    sums = counts.groupBy("query").agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in at))
    depth = F.greatest(*(F.when(F.col(f"c{i}") >= want, F.lit(shared + i)).otherwise(-1) for i in at), F.lit(-1))
    depths = written(sums.select("query", depth.alias("depth")))
    going = asking.join(depths.filter("depth >= 0").withColumnRenamed("query", "cid"), "cid")
    found = met(going, "codes", "cids").mapInArrow(_ascend(), "query long, found array<long>")
    picked = found.groupBy("query").applyInArrow(_deal(BLOCK), "query long, block long, picks array<int>")
    rest = depths.filter("depth < 0").select("query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // BLOCK).cast("long"))).alias("block"), F.lit(None).cast("array<int>").alias("picks"))
    return picked.unionByName(rest)


def nearest(rows: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest rows found for each row that ``is_query`` (over the columns of ``rows``) holds for.

    Rows with the query's own id are not among them. Ties go to the smaller id, nulls last. Vectors that are null, zero, of
    another length than most, or that hold null or non-finite components take no part. Rows that repeat an id and a vector
    count once; an id with several vectors is as many rows, each searched for. Other columns are ignored; an empty table gives an empty result.

    Scale: a vector costs ``TREES`` entries of 20 bytes. No task holds more than an array or a block with the queries that
    meet it, or the candidates of one query. Results of a block are ``top + 1`` classes a query.
    """
    spark, id_type = rows.sparkSession, dict(rows.dtypes)[id_col]
    flagged = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    d, dims = vectors_of(flagged, "id", "vec")
    asked = flagged.filter("asked").select("id").distinct()
    schema = f"query_id {id_type}, rank int, {id_col} {id_type}, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    d = d.withColumns({"name": name128(F.col("vec")), "part": part_of("id")}).dropDuplicates(["id", "name"])
    d = written(d.join(asked.withColumn("asked", F.lit(True)), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    classes = classes_of(d, top)
    n = classes.count()

    picks = _candidates(classes, dims, n, top)
    asked = picks.join(classes.filter("asked").select(F.col("cid").alias("query"), F.col("vec").alias("qvec")), "query")
    blocks = classes.select(F.floor(F.col("cid") / BLOCK).alias("block"), "cid", "vec", "members")
    best = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_verify(dims, top), f"query long, best array<struct<score:double,members:array<{id_type}>>>")
    flat = best.select("query", F.explode("best").alias("b")).select("query", "b.score", F.explode("b.members").alias("id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    flat = flat.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1)
    answers = flat.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("answers"))
    # Queries with one vector share its answers; they are dealt to parts where they are joined with it.
    answers = dealt(answers.join(classes.select(F.col("cid").alias("query"), "a", "b", "parts"), "query"))
    out = d.filter("asked").select("id", "name.a", "name.b", "part").join(answers, ["a", "b", "part"])
    others = F.slice(F.filter("answers", lambda x: ~x["id"].eqNullSafe(F.col("id"))), 1, top)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias(id_col), "x.score")
