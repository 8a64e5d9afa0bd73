"""Operator 4: contiguous shards of near equal bytes by global prefix sums.  DataFrame functions only.

Rows are range-partitioned by (MD5 of the text, doc_id); each partition's totals are summed on their own, the totals'
prefix sums give each partition its offset, and a row's place is that offset plus its running sum inside
the partition.  No task ever orders more than its partition.
Equal texts are neighbours.  A group of equal texts of at most 1 / ``whole`` of a shard's target goes to one shard as a whole;
a larger one, of which there can be only shards * whole, is cut like any other run of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

EXTRA = 8  # bytes that a document takes besides its text


def shard_by_bytes(docs: DataFrame, shards: int = 24, whole: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8; shard i takes the rows whose midpoint, in bytes before them in
    the global order (by MD5 of the text, then doc_id, nulls first), lies in the i-th of equal parts.  slot numbers a shard's rows from 0
    without gaps, in that order.
    law is 'bytes', grown_shard null.  A null text counts as empty (crc32 0) but isn't equal to an empty
    one.  Repeated and null doc_ids keep a row each.  Other columns aren't read.  No rows: no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + EXTRA).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("")).alias("group"),
    )
    rows = stage_table(rows, "rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    # at most shards * whole rows: each holds more than 1 / (shards * whole) of all bytes
    large = groups.where(F.col("bytes") * (shards * whole) > total.scalar()).select("group", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    rows = rows.withColumn("run", F.when(F.col("large"), F.col("doc_id")).otherwise(0))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stage_table(rows.repartitionByRange(n, "group", "run").withColumn("part", F.spark_partition_id()), "parts")
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"))

    inside = Window.partitionBy("part").orderBy("group", "run", "doc_id", "size")
    same = Window.partitionBy("part", "group")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumns({"upto": upto, "rank": F.row_number().over(inside)})
    # a group that stays whole lies in one partition; its midpoint decides for all its rows
    placed = placed.withColumns({"first": F.min(F.col("upto") - F.col("size")).over(same), "end": F.max("upto").over(same)})
    twice = F.when(F.col("large"), 2 * F.col("upto") - F.col("size")).otherwise(F.col("first") + F.col("end"))
    placed = placed.join(F.broadcast(offsets), "part").withColumns({"twice": twice + 2 * F.col("byte0"), "rank": F.col("rank") - 1 + F.col("row0")})
    shard = F.least(F.lit(shards - 1), F.floor(F.col("twice").cast("decimal(38,0)") * shards / (2 * total.scalar())))
    placed = stage_table(placed.select("doc_id", "size", "text_crc32", "rank", shard.cast("int").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("rank0"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("rank0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
