"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the shard is the highest of the shards' hashes of the id (so one more shard
only takes rows into itself), and inside the shard a memory-sized bucket is drawn by a second hash over id, text and the
input partition, which spreads copies, repeated ids and repeated rows alike. The number of buckets follows from the bytes
of the whole input, and every bucket is a partition of its own. Pass two shuffles each bucket by Fisher-Yates with a
generator seeded by shard and bucket, after sorting it, so that results do not depend on the order of arrival, and writes
it, with each record's place. Slots are bucket offsets, counted over what was written, plus places, gapless from 0 in each
shard. The same input files and settings give the same order.

Law: ``key`` (id and shard count decide the shard).

Defined results: null text has size 1 and the checksum of no bytes; a null id is a key of its own; repeated rows get a
slot each; an empty table gives no rows. Columns of the input ride along unchanged; names starting with ``_sh_`` are
reserved, and the output columns shard, slot and grown_shard replace input columns of those names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taglog.llm.common import scratch

SHARDS = 8
BUCKET_BYTES = 64 << 20
#: Up to this many buckets their offsets are broadcast (24 bytes each); beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 200_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Highest-random-weight shard of a key."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.array_max(F.array(*(F.struct(F.xxhash64(text, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards))))["s"]


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Both passes: one folder a shard, one file a bucket, with _sh_bucket and _sh_place beside the columns of ``df``."""
    df = df.drop("shard", "slot", "grown_shard")
    total = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    text = F.col(text_col).cast("string")
    scattered = df.withColumn("shard", shard_of(F.col(id_col), shards, seed)).withColumn("_sh_bucket", F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.spark_partition_id(), F.lit(seed + 1)), F.lit(buckets)))
    names, kind = df.columns, {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def shuffled(bucket: pa.Table) -> pa.Table:
        shard, number = bucket.column("shard")[0].as_py(), bucket.column("_sh_bucket")[0].as_py()
        crc = pa.array([zlib.crc32(t.as_buffer()) if t.is_valid else 0 for t in bucket.column(text_col)], pa.int64())
        n = len(bucket)
        # rows of one id and checksum whose texts still differ are ordered by the text
        order = pc.sort_indices(pa.table({"i": bucket.column(id_col), "c": crc, "t": bucket.column(text_col)}), sort_keys=[("i", "ascending"), ("c", "ascending"), ("t", "ascending")])
        rng = np.random.default_rng([seed, shard, number])
        order = order.to_numpy().copy()
        rng.shuffle(order)  # numpy's shuffle is Fisher-Yates
        out = bucket.select(names).take(pa.array(order))
        out = out.append_column("shard", pa.array(np.full(n, shard), pa.int32())).append_column("_sh_bucket", pa.array(np.full(n, number), pa.int64()))
        return out.append_column("_sh_place", pa.array(np.arange(n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole buckets: one, or several if the engine made fewer partitions."""
        by: dict[tuple, list[pa.RecordBatch]] = {}
        for b in batches:
            key = pc.add(pc.multiply(b.column(b.schema.get_field_index("shard")).cast(pa.int64()), buckets), b.column(b.schema.get_field_index("_sh_bucket")))
            for k in pc.unique(key).to_pylist():
                by.setdefault(k, []).append(b.filter(pc.equal(key, k)))
        for k in sorted(by):
            yield from shuffled(pa.Table.from_batches(by.pop(k))).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {kind[c]}" for c in names) + ", shard int, _sh_bucket long, _sh_place long"
    number = (F.col("shard") * F.lit(buckets) + F.col("_sh_bucket")).cast("int")
    scattered.repartitionById(shards * buckets, number).mapInArrow(run, schema).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(like: DataFrame, path: str, shards: int = SHARDS, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """What ``write_shards`` wrote of ``like``, with shard, slot (a row's place in its shard) and grown_shard (its shard if there were one more)."""
    kept = [f for f in like.schema.fields if f.name not in ("shard", "slot", "grown_shard")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", shard int, _sh_bucket long, _sh_place long"
    rows = like.sparkSession.read.schema(schema).parquet(path)
    counts = rows.groupBy("shard", "_sh_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sh_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_sh_offset"))
    if offsets.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    out = rows.join(offsets, ["shard", "_sh_bucket"]).withColumn("slot", F.col("_sh_offset") + F.col("_sh_place"))
    return out.select(*(F.col(f"`{f.name}`") for f in kept), "shard", "slot", shard_of(F.col(id_col), shards + 1, seed).alias("grown_shard"))


def shuffle_into_shards(df: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` written in shards (under the shared checkpoint folder unless a path is given) and read back."""
    path = path or scratch(df.sparkSession, "shards")
    write_shards(df, path, shards, seed, id_col, text_col, bucket_bytes)
    return read_shards(df, path, shards, seed, id_col)


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """The digest form: sizes and checksums of the texts as they were written in their shards."""
    done = shuffle_into_shards(docs.select("doc_id", "text"), **options)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return done.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
