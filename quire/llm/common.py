"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of our own, by application, for local sessions without spark.checkpoint.dir, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. Where that is unset, a local
    session, whose driver is its only executor, gets a folder of its own; on a cluster it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        where = _OWN[context.applicationId]
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what follows survives lost executors and does not recompute df."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.quire_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(docs: DataFrame, **own: Column) -> DataFrame:
    """docs as two structs: row, its columns, and own, further ones. So no name of ours can clash with a column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*[v.alias(k) for k, v in own.items()]).alias("own"))


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of apart() as they were."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text hash (xxhash64 of text) stand in verdict (doc_id, th); nulls match nulls."""
    v = verdict.select("doc_id", "th").distinct().select(F.struct("*").alias("v"))
    rows = apart(docs, doc_id=F.col("doc_id"), th=F.xxhash64("text"))
    return together(rows.join(v, F.col("own.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("own.th") == F.col("v.th")), "left_semi"), docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


#: Characters that separate words: space and tab to carriage return (fixed values).
WORD_SPACE = " \t\n\x0b\x0c\r"


def release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that are no longer used: it does so once their driver-side handles are collected."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
