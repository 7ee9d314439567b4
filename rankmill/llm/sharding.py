"""Rendezvous hashing: every record goes to the shard with the highest weighted score of (key, shard).

A shard's score for a key depends on these two and its weight alone. A new shard therefore takes records only
into itself, a removed one gives up only its own, and a changed weight moves only the share it is about.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.running import group_rank


def _scored(key: Column, shard: Column, weight: Column) -> Column:
    """weight / -ln(u), u in (0, 1) from the hash of key and shard; the lower shard wins a tie."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return F.struct((weight / -F.ln(unit)).alias("score"), (-shard).alias("minus"))


def shard_of(key: Column, weights: Mapping[int, float] | Sequence[float]) -> Column:
    """The shard number of a key; shards of greater weight get proportionally more keys.

    A null key is a key like any other: all such records go to one shard.
    """
    pairs = sorted(weights.items()) if isinstance(weights, Mapping) else list(enumerate(weights))
    if not pairs or any(w <= 0 for _, w in pairs):
        raise ValueError("at least one shard, and weights above zero")
    shards = F.array(*(F.struct(F.lit(int(s)).alias("s"), F.lit(float(w)).alias("w")) for s, w in pairs))
    best = F.array_max(F.transform(shards, lambda x: _scored(key, x["s"], x["w"])))
    return (-best["minus"]).cast("int")


def shard_records(
    records: DataFrame,
    key: str,
    weights: Mapping[int, float] | Sequence[float],
    order_by: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's number in its shard, from 0 without gaps.

    Slots follow the key, then ``order_by``. Rows equal in both are numbered in any order. An empty table gives
    no rows. Only the rows' own columns move, so pass narrow rows and join texts back by key where needed.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    plain = records.drop("shard", "slot").withColumn("shard", shard_of(F.col(key), weights))
    ranked = group_rank(plain, ["shard"], [F.col(key), *map(F.col, order_by)], "_slot", num_partitions)
    return ranked.withColumn("slot", F.col("_slot") - 1).drop("_slot")


def write_shards(sharded: DataFrame, path: str, num_partitions: int | None = None) -> None:
    """One folder a shard, its files in slot order; a big shard is spread over several tasks and files."""
    partitions = num_partitions or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sharded.repartitionByRange(partitions, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
