"""Rendezvous hashing of record keys over weighted shards, with gapless places inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import pick, staged


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the lowest ``-ln(u) / weight``, where u in (0, 1) is a hash of key and shard number.

    Only the key and the shards decide. A new shard takes the keys for which it wins and moves no other; a changed
    weight moves keys only to or from that shard. A shard of weight 0 gets nothing; a null key hashes like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")

    def cost(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[cost(i, w) for i, w in enumerate(weights) if w > 0]))["shard"]


def place(rows: DataFrame, group: str, order: Sequence[str], per_task: int = 20_000) -> DataFrame:
    """Add ``slot``, gapless from 0 inside each group.

    A group is cut at random into parts of about ``per_task`` rows, so that no group is sorted by one task and equal
    rows spread too: parts are counted, their counts summed up, and rows numbered inside their part. The random cut is
    written to the shared folder first, so that a lost executor cannot change it.
    """
    total = rows.select(F.lit(1)).count()
    groups = max(1, rows.select(group).distinct().count())
    parts = max(1, -(-total // (groups * per_task)))
    cut = staged(rows.withColumn("__part", (F.rand(7) * parts).cast("int")))
    counts = cut.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__group").orderBy("__of")) - F.col("__n"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    numbered = cut.withColumn("__inside", inside)
    return (numbered.join(before, numbered[group].eqNullSafe(before["__group"]) & (numbered["__part"] == before["__of"]))
            .withColumn("slot", F.col("__before") + F.col("__inside") - 1)
            .drop("__part", "__inside", "__group", "__of", "__n", "__before"))


def assign_shards(records: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards for all records, one row per input row.

    Returns the id, ``size`` (UTF-8 bytes of the text, null counting 0, plus 16), ``text_crc32``, ``shard`` and
    ``slot`` (place in the shard, gapless from 0). Equal ids share a shard, null ids too; empty tables give no rows.
    """
    rows = pick(records, id=id_col, text=F.coalesce(records[text_col].cast("string"), F.lit("")))
    rows = rows.select("id", (F.octet_length("text").cast("long") + 16).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                       shard_of(F.col("id"), weights).alias("shard"))
    return place(rows, "shard", ["id", "text_crc32"]).withColumnRenamed("id", id_col)


def write_shards(records: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", files_per_shard: int = 1) -> str:
    """Write the records as Parquet, one folder per shard; several files per shard share its rows by a hash of the whole row.

    All columns are kept, nulls and null ids too; repeated rows share a file, and an empty table writes no shard.
    """
    out = records.withColumn("shard", shard_of(records[id_col], weights))
    out.repartition(len(weights) * files_per_shard, "shard", F.pmod(F.xxhash64(*records.columns), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
    return path
