"""Two-pass external shuffle into shards, in SQL functions alone.

Pass 1 writes the records, each with a row number of its own and a seeded hash of it,
to the shared folder; the hash scatters them uniformly over buckets of about
``bucket_bytes``, so that neither a hot source nor repeated rows gather anywhere.
Pass 2 shuffles each bucket: records get their place by hash order, a Fisher-Yates
shuffle (Spark's seeded ``shuffle``) permutes the bucket's places, and the
permutation's entry is the record's slot.  Buckets follow each other, and the whole
permutation is cut into shards whose counts differ by one at most (law ``rows``), so a
bucket meets one or two shards and is written without a third exchange.

Only bucket counts are ordered globally; permutations are integers of one bucket.

Defined results: null text counts as no bytes; repeated and null ids are records like
any other; an empty table gives no rows; fewer rows than shards leave shards empty;
other columns are carried, and the working columns are named ``__*`` so they don't
clash (``shard``, ``slot`` and ``size`` of the input are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

SHARDS, SEED = 24, 20260101
#: A bucket's bytes in memory, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 1024


def shard(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    text_column: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    least_buckets: int = LEAST_BUCKETS,
) -> DataFrame:
    """``df`` with size (UTF-8 bytes of the text plus 8), shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    carried = [c for c in df.columns if c not in ("size", "shard", "slot")]
    size = F.octet_length(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).cast("long") + 8
    scattered = cut(
        df.select(*carried, size.alias("size"), F.monotonically_increasing_id().alias("__row"))
        .withColumn("__hash", F.xxhash64(F.lit(seed), "__row"))
    )
    total = scattered.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    rows, buckets = int(total["n"]), max(least_buckets, -(-int(total["bytes"]) // bucket_bytes))
    bucketed = scattered.withColumn("__bucket", F.pmod("__hash", F.lit(buckets)))

    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .repartition("__bucket")
        .sortWithinPartitions("__bucket")  # a fixed order, so that a retried task draws the same permutations
        .select("__bucket", "__before", F.shuffle(F.sequence(F.lit(0), F.col("__n").cast("int") - 1), F.lit(seed)).alias("__slots"))
    )
    at = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", "__row"))
    placed = (
        bucketed.withColumn("__at", at)
        .join(places, "__bucket")
        .withColumn("__place", F.col("__before") + F.element_at("__slots", F.col("__at")))
    )
    number = F.expr(f"(__place * {shards}) div {max(1, rows)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", number.cast("int"))
        .withColumn("slot", F.col("__place") - first)
        .select(*carried, "size", "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, **options: object) -> None:
    """Shuffle ``df`` and write it to ``path``/shard=N/, rows in slot order within each file.

    A bucket is one task's rows and meets one or two shards; shards' files follow each other by their first slot.
    """
    out = shard(df, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return sharded.select(
        "doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
