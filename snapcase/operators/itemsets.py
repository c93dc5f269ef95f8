"""Combinations of any size (Q05): frequent item sets by group, over vertical bitmaps.

The episodes of a group are dealt to shards of at most ``SHARD`` positions; an item's
episodes in a shard are one bitmap.  A set grows by one item at a time: its bitmap meets
those of the later items of the same shard, and the number of common bits, summed over
shards, is its exact count.  Sets below the threshold grow no further.  A group that holds
most rows has more shards, not larger ones, so every task stays small.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcase.operators.episodes import BOOKING
from snapcase.session import results_path

# Positions of a bitmap as Spark's bitmap functions build them (4 KB).
SHARD = 32_768


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grown(pairs: DataFrame) -> DataFrame:
    """Rows (grp, shard, bucket, items, item, bits, other) to the grown sets with common bits."""
    def meet(batches):
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bits", "other"))
            both = [(np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8)).tobytes()
                    for a, b in zip(left, right)]
            n = [int.from_bytes(b, "little").bit_count() for b in both]
            columns = {c: batch.column(batch.schema.get_field_index(c))
                       for c in ("grp", "shard", "bucket", "items", "item")}
            out = pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(both, pa.binary()), pa.array(n, pa.int64())],
                names=[*columns, "bits", "n"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return pairs.mapInArrow(meet, "grp string, shard long, bucket long, items array<string>, item string, "
                                  "bits binary, n long")


def frequent_itemsets(df: DataFrame, keys: Sequence[str] = BOOKING, item: str = "ChargeGroup",
                      by: str | None = "RaceDescription", anchor: str | None = None,
                      min_count: int = 2) -> DataFrame:
    """Sets of items held together by at least ``min_count`` episodes of a group.

    With ``anchor`` only sets that hold that item.  A NULL group is a group of its own; a
    NULL item is no item.  Output: ``by, items (sorted array), size, episodes``.
    """
    spark, keys = df.sparkSession, list(keys)
    folder = results_path(spark, f"itemsets/{uuid.uuid4().hex}")
    group = F.lit("n") if by is None else F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("n"))
    # One row per episode, its distinct items combined before the only shuffle by episode.
    held = (df.filter(F.col(item).isNotNull())
            .select(*keys, group.alias("grp"), F.col(item).cast("string").alias("item"))
            .groupBy(*keys, "grp").agg(F.collect_set("item").alias("held")))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    if anchor is not None:
        held = held.filter(known & F.array_contains("held", anchor))
    held = _stored(held.select("grp", F.xxhash64(*keys).alias("place"), known.alias("known"), "held"),
                   folder, "held")
    counts = _stored(held.select("grp", F.explode("held").alias("item")).groupBy("grp", "item").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), folder, "counts")
    shards = _stored(held.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / (SHARD // 2)).alias("shards")),
                     folder, "shards")
    # A shard holds a bounded number of episodes, so its numbering is a small window.
    from pyspark.sql import Window
    number = F.row_number().over(Window.partitionBy("grp", "shard").orderBy("place")).cast("long")
    placed = (held.filter("known").join(shards, "grp")
              .withColumn("shard", F.pmod("place", "shards").cast("long"))
              .select("grp", "shard", "place", "held")
              .select("grp", "shard", "held", number.alias("number")))
    # Items stay with their number, so the bitmaps need no other join or shuffle.
    bits = _stored(
        placed.select("grp", "shard", "number", F.explode("held").alias("item"))
        .join(counts.select("grp", "item"), ["grp", "item"], "left_semi")
        .groupBy("grp", "shard", F.bitmap_bucket_number("number").alias("bucket"), "item")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")), folder, "bits")
    start = bits if anchor is None else bits.filter(F.col("item") == anchor)
    # The anchor comes first in its sets, the other items in order.
    sets = start.withColumn("items", F.array("item"))
    if anchor is not None:
        sets = sets.withColumn("item", F.lit(""))
    others = bits.withColumnRenamed("item", "next").withColumnRenamed("bits", "other")
    if anchor is not None:
        others = others.filter(F.col("next") != anchor)
        counts = counts.filter(F.col("item") == anchor)
    found = [counts.select("grp", F.array("item").alias("items"), "n")]
    level = 1
    while True:
        level += 1
        pairs = sets.join(others, ["grp", "shard", "bucket"]).filter("next > item").select(
            "grp", "shard", "bucket", F.concat("items", F.array("next")).alias("items"),
            F.col("next").alias("item"), "bits", "other")
        grown = _stored(_grown(pairs), folder, f"grown-{level}")
        frequent = _stored(grown.groupBy("grp", "items").agg(F.sum("n").alias("n"))
                           .filter(F.col("n") >= min_count), folder, f"frequent-{level}")
        if frequent.isEmpty():
            break
        found.append(frequent)
        sets = grown.drop("n").join(frequent.select("grp", "items"), ["grp", "items"], "left_semi")
    out = found[0]
    for table in found[1:]:
        out = out.unionByName(table)
    name = by or "grp"
    value = F.when(F.col("grp") != "n", F.expr("substring(grp, 2)"))
    return out.select(value.alias(name), F.array_sort("items").alias("items"),
                      F.size("items").alias("size"), F.col("n").cast("long").alias("episodes"))


def combinations_by_race(df: DataFrame, anchor: str = "DRUGS", min_count: int = 2,
                         keys: Sequence[str] = BOOKING, race_col: str = "RaceDescription",
                         group_col: str = "ChargeGroup") -> DataFrame:
    """Combinations of charge groups, of any size, that hold the anchor group, by race (Q05).

    Output: ``race, combination, size, episodes, share`` (of the episodes with the anchor).
    """
    sets = frequent_itemsets(df, keys, group_col, race_col, anchor, min_count)
    alone = sets.filter("size = 1").select(F.col(race_col).alias("r"), F.col("episodes").alias("whole"))
    return (sets.join(alone, F.col(race_col).eqNullSafe(F.col("r")))
            .select(F.col(race_col).alias("race"), F.array_join("items", " + ").alias("combination"),
                    F.col("size").cast("long").alias("size"), "episodes",
                    (F.col("episodes").cast("double") / F.col("whole").cast("double")).alias("share")))
