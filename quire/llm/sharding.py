"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of doc_id and text; pass two reads one
bucket at a time, permutes it by Fisher-Yates under a generator seeded with (seed, bucket), and writes it. A record's
place in the whole order is its bucket's offset plus its place in the bucket; shards are equal ranges of that order, so
the counts of two shards differ by one at most (law `rows`). The order depends on the seed, the rows and the number of
buckets only: rows of a bucket are sorted before they are permuted, so a task that runs again writes the same.

The buckets of a row that makes up more than a HOT-th of all rows are split by where its copies stand in the input; such
copies are alike, so that it does not matter which takes which place. A bucket is a task of its own.

Defined cases: null text is kept as null and counts as no bytes; null doc_id is a value; texts of any length and repeated
rows each take a place, and rows that tie in a bucket are alike; an empty table gives no files and an empty result; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import cut, discard, new_path

#: Bytes of text in a bucket, on average: what one task holds in memory at a time.
BUCKET_BYTES = 12 << 20
OUTPUTS = ("shard", "slot", "_bucket", "_offset", "_rows", "_tie")
#: A row with more copies than this share of all rows has its bucket split; so there are fewer than HOT of these.
HOT = 1000
#: Buckets whose offsets are summed up together first.
BLOCK = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): for i from n - 1 down to 1, swap i with a uniform place up to i."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shard_and_slot(place: np.ndarray, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The first rows % shards shards get one row more than the rest."""
    small, larger = divmod(rows, shards)
    edge = larger * (small + 1)
    late = place >= edge
    shard = np.where(late, larger + (place - edge) // max(small, 1), place // (small + 1))
    start = np.where(late, edge + (shard - larger) * small, shard * (small + 1))
    return shard.astype(np.int32), (place - start).astype(np.int64)


def shuffle_into_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20240, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shuffled records under path (Parquet, a folder per shard) and returns what is read back."""
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUTS)
    tie = F.xxhash64(F.lit(seed), "doc_id", "text")
    alike = cut(docs.groupBy(tie.alias("tie")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("b")), "shard-rows")
    rows, total = alike.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    hot = [r["tie"] for r in alike.where((F.col("n") > 1) & (F.col("n") * HOT > rows)).select("tie").collect()]
    discard(alike)
    buckets = max(1, math.ceil(total / bucket_bytes))
    dealt = F.when(F.col("_tie").isin(hot), F.xxhash64("_tie", F.monotonically_increasing_id())).otherwise(F.col("_tie")) if hot else F.col("_tie")
    scattered = docs.withColumn("_tie", tie).withColumn("_bucket", F.pmod(dealt, F.lit(buckets)).cast("long"))
    counts = cut(scattered.groupBy("_bucket").agg(F.count("*").alias("_rows")).withColumn("_block", F.expr(f"_bucket div {BLOCK}")), "shard-counts")
    before = lambda w: F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("_block").agg(F.sum("_rows").alias("_rows")).select("_block", before(Window.orderBy("_block")).alias("_ahead"))
    within = counts.withColumn("_offset", before(Window.partitionBy("_block").orderBy("_bucket")))
    offsets = cut(within.join(blocks, "_block").select("_bucket", (F.col("_offset") + F.col("_ahead")).alias("_offset"), "_rows"), "shard-offsets")
    discard(counts)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permute(records: pa.Table, place: pa.Table) -> pa.Table:
        n, bucket = records.num_rows, records["_bucket"][0].as_py() if records.num_rows else 0
        if n != (place["_rows"][0].as_py() if place.num_rows else 0):
            raise ValueError(f"bucket {bucket} has {n} rows now and had {place['_rows'].to_pylist()} when they were counted")
        records = records.sort_by([("doc_id", "ascending"), ("_tie", "ascending")]).select(columns)
        records = records.take(pa.array(fisher_yates(n, seed, bucket)))
        at = np.arange(n, dtype=np.int64) + (place["_offset"][0].as_py() if place.num_rows else 0)
        shard, slot = shard_and_slot(at, rows, shards)
        return records.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot))

    own = lambda df: df.repartition(buckets, "_bucket").groupBy("_bucket")
    shuffled = own(scattered).cogroup(own(offsets)).applyInArrow(permute, schema)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    discard(offsets)
    return spark.read.schema(schema).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 20240) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every record, from the shards as written."""
    wide = docs.select("doc_id", "text")
    back = shuffle_into_shards(wide, new_path(docs.sparkSession, "shards"), shards, seed)
    text = F.coalesce("text", F.lit(""))
    return back.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
