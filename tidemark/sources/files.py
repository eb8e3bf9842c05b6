"""File sources and sinks: typed CSV, JSON artifacts, zip members, keyed caches, ordered exports, run records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, shrink: bool = False) -> DataFrame:
    """A CSV file with a header, read by an explicit schema; a byte order mark is skipped, "" and NaN are NULL.

    ``shrink`` stores doubles as floats and longs as ints, for tables that are kept.
    """
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("nanValue", "NaN").csv(path)
    small = {"double": "float", "bigint": "int"}
    out = []
    for name, kind in df.dtypes:
        c = F.when(~F.isnan(name), F.col(name)) if kind in ("double", "float") else F.col(name)
        out.append((c.cast(small[kind]) if shrink and kind in small else c).alias(name))
    return df.select(*out)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document of constants and lookups as one row."""
    return spark.read.option("multiLine", True).json(path)


def zip_members(spark: SparkSession, path: str, depth: int = 2, pattern: str = "*.zip") -> DataFrame:
    """(archive, member, size, sha256) of all members of the archives under a folder, nested archives too, up to ``depth``."""
    import hashlib

    def walk(name: str, data: bytes, left: int) -> Iterator[tuple[str, int, str]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in sorted(z.namelist()):
                if m.endswith("/"):
                    continue
                body = z.read(m)
                yield f"{name}{m}", len(body), hashlib.sha256(body).hexdigest()
                if m.endswith(".zip") and left > 1:
                    yield from walk(f"{name}{m}!", body, left - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *m) for p, c in zip(batch["path"], batch["content"], strict=True) for m in walk("", bytes(c), depth)]
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, size long, sha256 string")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``). Where none is set, one temporary folder for the session, on one machine only, as in tests."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: made once, its lineage cut."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*made: DataFrame) -> None:
    """Deletes the files of tables that ``materialised`` made, once nothing is left to be computed from them."""
    for df in made:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """``df`` as a Parquet table named by a key and its schema: it is computed the first time and read again afterwards.

    The key must name everything that the rows depend on (fold, feature version); a changed schema is another table. A
    table that another writer hasn't finished raises instead of being read in part.
    """
    import hashlib

    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    path = f"{folder}/{key}-{hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_submission(scores: DataFrame, sample: DataFrame, path: str, key: str = "row_id", value: str = "p", order: str = "pos") -> None:
    """Scores as CSV in the order of the sample, range-partitioned: file after file, row after row. Raises if a row has no score."""
    joined = sample.select(key, order).join(scores.select(key, value), key, "left")
    missing = joined.filter(F.col(value).isNull()).limit(1).count()
    if missing:
        raise ValueError("a row of the sample has no score")
    joined.orderBy(order).select(key, value).write.option("header", True).csv(path)


def append_run(record: dict, spark: SparkSession, folder: str) -> None:
    """Adds one run's record to a JSON log; the history is a view over all of them, so nothing is rebuilt."""
    flat = [(record["run"], k, float(v)) for k, v in record.items() if isinstance(v, (int, float)) and k != "run"]
    spark.createDataFrame(flat, "run string, metric string, value double").coalesce(1).write.mode("append").json(folder)


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run string, metric string, value double").json(folder)


def package(df: DataFrame, folder: str) -> DataFrame:
    """Writes a table as a sealed package and returns its manifest: (path, size, sha256) of every file, made by the executors."""
    df.write.parquet(f"{folder}/data")
    return seal(df.sparkSession, f"{folder}/data")


def seal(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def broken_seals(manifest: DataFrame, folder: str) -> DataFrame:
    """Files that are missing, changed or not in the manifest."""
    now = seal(manifest.sparkSession, folder).withColumnRenamed("sha256", "now").drop("size")
    return manifest.join(now, "path", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", "sha256", "now")
