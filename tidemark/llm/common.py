"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import discard  # noqa: F401  (operators take it from here)

#: White space as the word rules of this subpackage see it; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: Seed of the second of two 64-bit hashes, which together name a text with 128 bits.
SECOND = 0x5EED


def small_side(df: DataFrame, max_rows: int, max_bytes: int = 64_000_000) -> tuple[DataFrame, bool]:
    """``df`` as a broadcast table if it has at most ``max_rows`` rows and their JSON at most ``max_bytes``, else as it is.

    It is written first, so both sizes are known before a row is fetched, and what made it isn't computed again.
    The second value tells which it was.
    """
    df = written(df)
    size = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    small = size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small


def packed(docs: DataFrame, replaced: list[str], **named: Column) -> DataFrame:
    """``row_`` with all columns of ``docs`` but the replaced ones, and the named columns: no name of a caller's column can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in replaced)).alias("row_"), *(c.alias(n) for n, c in named.items()))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII characters only take the faster general function."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def sliding(d: DataFrame, source: str, n: int, out: str, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``out``: f over every ``n`` consecutive elements of an array, from those over half as many; empty where there are fewer.

    f takes what two runs have, the second some elements further; for most lengths they overlap. Each step is a
    projection of its own, so an array is made once per row.
    """
    length, last, made = 1, source, []
    while length < n:
        step = min(length, n - length)
        x = F.col(last)
        pairs = F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x), F.lit(1))), f)
        last = f"{out}_{length + step}"
        made.append(last)
        d = d.withColumn(last, F.slice(pairs, 1, F.greatest(F.size(x) - step, F.lit(0))))
        length += step
    return d.withColumn(out, F.col(last)).drop(*made)


def hash_grams(d: DataFrame, hashes: str, n: int, out: str) -> DataFrame:
    """Adds ``out``: 64-bit hashes of every ``n`` consecutive words, whose own hashes ``hashes`` has."""
    return sliding(d, hashes, n, out, lambda x, y: F.xxhash64(x, y))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def name128(*cols: Column) -> Column:
    """A 128-bit name of some columns, as a struct of two hashes."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(SECOND), *cols).alias("b"))


#: Parts that the rows of one group are dealt to where they are joined with what is known of their group.
PARTS = 62


def part_of(*cols: str) -> Column:
    """The part of a row, by a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(PARTS)).cast("int")


def _bit(part: Column) -> Column:
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(PARTS))).cast("array<bigint>"), part + 1)


def parts_met(part: Column | str) -> Column:
    """Aggregate of a group: the parts that its rows are in, a bit each, as ``parts``."""
    return F.bit_or(_bit(F.col(part) if isinstance(part, str) else part)).alias("parts")


def dealt(groups: DataFrame) -> DataFrame:
    """A row of the group for each part in ``parts``, as ``part``.

    Rows joined by group and part are spread over the parts, however many of them one group has; a group
    costs no more rows than it has itself.
    """
    met = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.col("parts").bitwiseAND(_bit(i)) != 0)
    return groups.withColumn("part", F.explode(met)).drop("parts")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all machines share. Where none is set, a temporary one, on one machine only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table in the shared folder: its lineage is cut, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` from a table in the shared folder, bucketed by ``key``: what is grouped or joined by it comes to the table, which isn't shuffled."""
    name = f"tidemark_{uuid.uuid4().hex}"
    # 100,000 is as many buckets as Spark allows.
    df.write.bucketBy(min(max(1, buckets), 100_000), key).option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting to remove the shuffle files of a query when it has ended, instead of when the driver's memory is next collected.
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removing_shuffles(f: Callable) -> Callable:
    """An operator of many written steps, called with its table first: each step's shuffle files go when it is written.

    What it returns is computed later, and keeps its files as the session has it.
    """

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(REMOVES_SHUFFLES, None)
        conf.set(REMOVES_SHUFFLES, "true")
        try:
            return f(docs, *args, **kwargs)
        finally:
            if before is None:
                conf.unset(REMOVES_SHUFFLES)
            else:
                conf.set(REMOVES_SHUFFLES, before)

    return run
