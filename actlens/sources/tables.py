"""The given tables as the engine's canonical ones.

samples(sample_idx, smiles, n_tokens, chunk); acts(sample_idx, token_idx, feature, value); tokens(sample_idx,
token_idx, token); label_tokens(sample_idx, concept_idx, match_idx, token_idx).

Finite positive activations are stored entries; repeated positions take the greatest value. An impossible or null
molptr is replaced by the number of tokens in the string. Labels take concept names in any case and spacing; repeated
(sample, concept) rows join their matches; a match is its set of tokens, numbered in order of these sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.common import norm, read, strip
from actlens.functions import smiles as S

MAX_TOKENS = 32_767


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    smi = strip(F.col("smiles"))
    n = F.when(F.col("molptr").between(1, MAX_TOKENS), F.col("molptr")).otherwise(F.coalesce(F.size(S.tokens(smi)), F.lit(0)))
    return read(spark, sf_dir, "samples").where("sample_idx is not null").select("sample_idx", smi.alias("smiles"), n.cast("int").alias("n_tokens"), "chunk")


def tokens(samples: DataFrame) -> DataFrame:
    return samples.select("sample_idx", F.posexplode(S.tokens(F.col("smiles"))).alias("token_idx", "token"))


def acts(spark: SparkSession, sf_dir: str, below: float = float("inf"), by: tuple[str, ...] = ("sample_idx", "feature")) -> DataFrame:
    """Clustered by `by`, by default (sample_idx, feature), so that grouping by these needs no further shuffle; by (sample_idx, token_idx), a join with `tokens` needs none either. below: only values under it; by default all finite ones."""
    v = F.col("data").cast("double")
    rows = read(spark, sf_dir, "activations").where(v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < below)).where("sample_idx is not null and token_idx is not null and feature is not null")
    return rows.select("sample_idx", "token_idx", "feature", v.alias("value")).repartition(*by).groupBy("sample_idx", "feature", "token_idx").agg(F.max("value").alias("value"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "concepts")


def matches_of(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(sample_idx, concept_idx, tokens): the distinct matches of label rows (smiles, concept, token_idxs), each a sorted set of tokens."""
    names = concepts.select("concept_idx", norm(F.col("concept")).alias("name"))
    rows = rows.select(F.col("smiles").alias("sample_idx"), norm(F.col("concept")).alias("name"), F.explode("token_idxs").alias("m"))
    match = F.array_sort(F.array_distinct(F.filter("m", lambda t: t.isNotNull())))
    return rows.where("sample_idx is not null").join(names, "name").select("sample_idx", "concept_idx", match.alias("tokens")).where(F.size("tokens") > 0).distinct()


def labels_of(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(sample_idx, concept_idx, match_idx, token_idx)."""
    w = Window.partitionBy("sample_idx", "concept_idx").orderBy("tokens")
    numbered = matches_of(rows, concepts).withColumn("match_idx", F.row_number().over(w) - 1)
    return numbered.select("sample_idx", "concept_idx", "match_idx", F.explode("tokens").alias("token_idx"))


def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_of(read(spark, sf_dir, "eval_data"), concepts(spark, sf_dir))


def range_members(ends: DataFrame) -> DataFrame:
    """(alt_idx, ref_idx) from (ref_idx, end), references numbered from 0 without gaps: reference i owns the variants from the end of i - 1 up to its own; one without variants owns none. An equi-join finds the start, so no range join is needed."""
    before = ends.select((F.col("ref_idx") + 1).alias("ref_idx"), F.col("end").alias("start"))
    rows = ends.join(before, "ref_idx", "left").withColumn("start", F.coalesce("start", F.lit(0))).where(F.col("end") > F.col("start"))
    return rows.select(F.explode(F.sequence("start", F.col("end") - 1)).alias("alt_idx"), "ref_idx")
