"""Nothing that the tables hold is left out of the results named whole."""

import __spark_entry__ as entry

from pyspark.sql import functions as F

from actlens.operators import profile
from actlens.sources import tables

SF = "/root/testdata/sf0.001"


def test_activations_keep_every_finite_positive_value(spark, tmp_path):
    rows = [(1, 0, 7, 1e30), (1, 0, 7, 3.0), (1, 1, 7, 1e12), (1, 2, 7, float("inf")), (1, 3, 7, float("nan")), (1, 4, 7, None), (1, 5, 7, 0.0), (1, 6, 7, -1.0), (2, 0, 8, 0.5)]
    spark.createDataFrame(rows, "sample_idx long, token_idx int, feature int, data double").write.parquet(f"{tmp_path}/activations.parquet")
    got = {(r.sample_idx, r.token_idx, r.feature): r.value for r in tables.acts(spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 7): 1e30, (1, 1, 7): 1e12, (2, 0, 8): 0.5}


def test_whole_maxima_reach_the_largest_value(spark):
    data = spark.read.parquet(f"{SF}/activations.parquet").where("data > 0 and data < double('inf') and sample_idx is not null and token_idx is not null and feature is not null")
    want = {r.feature: round(r.m, 6) for r in data.groupBy("feature").agg({"data": "max"}).toDF("feature", "m").collect()}
    got = {r.feature: r.max_value for r in entry.queries()["latent_max_whole"](spark, SF).collect()}
    assert max(want.values()) >= 1e12 and got == want


def test_64_latents_a_concept(spark):
    pairs = spark.createDataFrame(entry.queries()["fpc_topk_whole"](spark, SF).collect())
    most = {r.concept_idx: r["count"] for r in pairs.groupBy("concept_idx").count().collect()}
    smd = entry.queries()["smd_token_whole"](spark, SF)
    positive = {r.concept_idx: r["count"] for r in smd.where("smd > 0 and not isnan(smd)").groupBy("concept_idx").count().collect()}
    assert max(most.values()) == 64 and all(most[c] >= min(64, n) for c, n in positive.items())
    cells = entry.queries()["cm_fpc_whole"](spark, SF).select("concept_idx", "feature").distinct()
    assert cells.count() == pairs.count()


def test_distribution_of_every_latent(spark):
    every = entry.queries()["act_distribution_whole"](spark, SF).cache()
    assert {r.feature for r in every.select("feature").distinct().collect()} == {r.feature for r in entry.queries()["token_preference_whole"](spark, SF).select("feature").distinct().collect()}
    s, d = spark, SF
    one = profile.distribution(tables.acts(s, d), tables.tokens(tables.samples(s, d)), 1207, "^[cn]$", tables.label_tokens(s, d))
    mine = every.where("feature = 1207").drop("feature")
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, one.withColumn("value", F.round("value", 6)).collect()))
