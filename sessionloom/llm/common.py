"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot: there are at most as many such keys as its inverse.
HOT = 1000
_own_dirs: list[str] = []


def _remove_own_dirs() -> None:
    for d in _own_dirs:
        shutil.rmtree(d, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local run (and a test) gets a temporary folder, removed when the driver ends; on a cluster
    it is an error, as executors would write where the driver never looks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="loom-shared-"))
        atexit.register(_remove_own_dirs)
    return _own_dirs[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, the rows are read again, not made again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_hot(rows: DataFrame, by_key: DataFrame, key: str) -> DataFrame:
    """``rows`` inner-joined with ``by_key``, which has one row and the number ``n`` of rows for each key.

    Keys with more than a HOT-th of all rows, at most HOT of them, are broadcast, so that their rows stay where they are; the others are
    joined by shuffle.
    """
    by_key = written(by_key, "join-keys")
    total = by_key.agg(F.sum("n")).first()[0] or 0
    hot, cold = by_key.where(F.col("n") > total // HOT).drop("n"), by_key.where(F.col("n") <= total // HOT).drop("n")
    marked = rows.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key)
    return near.unionByName(marked.where("_hot IS NULL").drop("_hot").join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns of ``df``, cast, in small batches; columns with other names never reach an operator."""
    return text_batches(df).select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded to TEXT_ROWS rows: whole texts may be long, and a batch is in memory on both
    sides several times."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df
