"""Top N items within every group, by a hot-cold split.

Items are reduced to one row per (group, item) with its best score, map-side first. Exact group counts then split the
groups: light ones go to an ordinary window; heavy ones are range-sorted with salts: their score range is cut into
buckets, running bucket counts from the top show which buckets can hold the first N, a window per (group, bucket,
salt) keeps N of each, and a last window sees at most N rows per kept bucket and salt. Ties: by item, ascending.

Defined results: null groups and items, and invalid scores (null, NaN, not within (0, 1]), are left out; repeated rows
count once; groups with fewer than N items keep all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import settle

#: Items from which a group is heavy, and of a salt of a bucket on average if all its scores were in one; score buckets of a heavy group.
HEAVY, BUCKETS = 50_000, 256


def best_scores(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(g, item, score): the best valid score of each item in each group."""
    s = F.col(score)
    return (
        df.where(~F.isnan(s) & (s > 0) & (s <= 1))
        .select(F.col(group).alias("g"), F.col(item).alias("item"), s.alias("score"))
        .where("g is not null and item is not null")
        .groupBy("g", "item").agg(F.max("score").alias("score"))
    )


def _first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, heavy: int = HEAVY) -> DataFrame:
    """(group, item, score, rank): the n best items of each group by their best score."""
    best = settle(best_scores(df, group, item, score))
    hot = best.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= heavy)  # at most (rows / heavy) groups
    light = _first(best.join(hot, "g", "left_anti"), ["g"], n)
    salts = F.ceil(F.col("size") / max(heavy, 1))
    bucketed = best.join(hot, "g").withColumn("bucket", F.floor(F.col("score") * BUCKETS)).withColumn("salt", F.pmod(F.xxhash64("item"), salts)).drop("size")
    above = Window.partitionBy("g").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        bucketed.groupBy("g", "bucket").agg(F.count("*").alias("size"))
        .withColumn("above", F.coalesce(F.sum("size").over(above), F.lit(0)))
        .where(F.col("above") < n).select("g", "bucket")
    )
    salted = _first(bucketed.join(kept, ["g", "bucket"], "left_semi"), ["g", "bucket", "salt"], n)
    hot_top = _first(salted.select("g", "item", "score"), ["g"], n)
    return light.select("g", "item", "score", "rank").unionByName(hot_top.select("g", "item", "score", "rank")).select(
        F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank"
    )
