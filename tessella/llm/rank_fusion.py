"""One ranking from several differently-scaled scores: weighted median of per-score ranks.

Every score of a group is turned into ranks, so neither its unit nor its spread matters. An item's place is the
weighted median of its ranks, then their weighted mean, then its id.

Ranks need an order within a group, and one group may hold a third of all rows. So distinct (group, score name, value)
are range-partitioned over the cluster, numbered within each range, and shifted by the sizes of the ranges before:
no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import materialise


def group_ranks(values: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """keys, value, n: the rank of each distinct value in its keys, 1 the highest, ties sharing the mean of their places.

    values has one row per scored item. Returns keys, value, _rank double, and _size, the number of items of the keys.
    """
    spark = values.sparkSession
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, *keys, F.col(value).desc()).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    of_keys = Window.partitionBy(*keys)  # a row per range of the keys, not per item
    offsets = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_in").over(of_keys.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in").over(of_keys).alias("_size"),
    )
    within = Window.partitionBy(*keys, "_range").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.withColumn("_upto", F.sum("_n").over(within))
    joined = numbered.join(offsets, [*keys, "_range"])
    return joined.select(*keys, value, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_rank"), "_size")


def weighted_median(pairs: Column) -> Column:
    """Of an array of structs (r, w): the smallest r at which half the weight is reached; the mean with the next one where it is just half."""
    ordered = F.array_sort(pairs)
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x["w"]
        return F.struct(
            seen.alias("seen"),
            F.when(a["low"].isNull() & (seen * 2 >= total), x["r"]).otherwise(a["low"]).alias("low"),
            F.when(a["high"].isNull() & (seen * 2 > total), x["r"]).otherwise(a["high"]).alias("high"),
        )

    return F.aggregate(ordered, start, step, lambda a: (a["low"] + F.coalesce(a["high"], a["low"])) / 2)


def rank_fusion(
    scores: DataFrame,
    group: str = "query_id",
    item: str = "chunk_id",
    stage: str = "stage",
    score: str = "score",
    lower_is_better: tuple[str, ...] = ("distance",),
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """One order of the items of each group in which every stage weighs the same, or as weights says.

    Returns group, item, median_rank, mean_rank, n_stages, one row per item. Smaller is better; the id decides what
    is still equal. Other columns of scores are ignored, whatever their names.

    - A repeated row counts once. An item with several scores in a stage keeps its best there.
    - A null or NaN score, like a missing row, means absent from the stage: the item then stands behind all items
      that are present (rank n + 1). A row with a null group, item or stage is left out.
    - Equal scores share the mean of their places. Weights must be positive; stages without one weigh 1.
    - An empty table gives no rows.
    """
    if any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    value = F.col(score).cast("double")
    value = F.when(F.col(stage).isin(*lower_is_better), -value).otherwise(value) if lower_is_better else value
    rows = scores.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(stage).alias("_s"), value.alias("_v"))
    rows = rows.where("_g is not null and _i is not null and _s is not null and _v is not null and not isnan(_v)")
    best = materialise(rows.groupBy("_g", "_s", "_i").agg(F.max("_v").alias("_v")), "scores")
    ranks = group_ranks(best, ["_g", "_s"], "_v")
    placed = best.join(ranks, ["_g", "_s", "_v"]).select("_g", "_i", "_s", "_rank")
    stages = best.groupBy("_g", "_s").agg(F.count("*").alias("_size"))
    stages = stages.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_s", F.col("_size").cast("double")))).alias("_sizes"))
    items = placed.groupBy("_g", "_i").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_rank"))).alias("_ranks"))
    weight = F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv])
    pairs = F.transform(
        F.map_entries("_sizes"),
        lambda e: F.struct(F.coalesce(F.try_element_at(F.col("_ranks"), e["key"]), e["value"] + 1).cast("double").alias("r"), F.coalesce(F.try_element_at(weight, e["key"]), F.lit(1.0)).cast("double").alias("w")),
    )
    paired = items.join(stages, "_g").select("_g", "_i", pairs.alias("_p"), F.size("_ranks").alias("_n"))
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["r"] * x["w"]) / F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["w"])
    return paired.select(F.col("_g").alias(group), F.col("_i").alias(item), weighted_median(F.col("_p")).alias("median_rank"), mean.alias("mean_rank"), F.col("_n").alias("n_stages"))


def ranking(scores: DataFrame, group: str = "query_id", item: str = "chunk_id", **options) -> DataFrame:
    """group, item, place, median_rank, mean_rank, n_stages: the whole order of rank_fusion, places from 1 and without gaps.

    Items are range-partitioned in that order, so a group of any size is numbered in pieces: a place is one within its
    range and the sizes of the group's ranges before.
    """
    fused = rank_fusion(scores, group, item, **options)
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["median_rank", "mean_rank", item]
    ranged = materialise(fused.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "ranking")
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_in"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    return ranged.withColumn("_at", within).join(offsets, [group, "_range"]).select(group, item, (F.col("_before") + F.col("_at")).alias("place"), "median_rank", "mean_rank", "n_stages")


def best_of_groups(scores: DataFrame, group: str = "query_id", item: str = "chunk_id", **options) -> DataFrame:
    """group, item: the first of each group in the order of rank_fusion. The minimum is pre-aggregated, so a hot group costs no more."""
    fused = rank_fusion(scores, group, item, **options)
    first = fused.groupBy(group).agg(F.min(F.struct("median_rank", "mean_rank", F.col(item))).alias("_first"))
    return first.select(group, F.col("_first")[item].alias(item))
