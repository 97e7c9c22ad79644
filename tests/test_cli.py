import numpy as np
import pytest

from actlens import cli
from actlens.operators import concepts, sae
from actlens.plans import association
from actlens.sources import tables

SF = "/root/testdata/sf0.001"


def _tsv(spark, path):
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, nanValue="NaN")


def test_prefilter_then_scores(spark, tmp_path):
    """Differences written by one call choose the latents of the next, as in one call for both."""
    cli.main(["associate", SF, f"{tmp_path}/smd", "--is-prefilter"])
    smd = _tsv(spark, f"{tmp_path}/smd")
    assert set(smd.columns) == {"conceptIdx", "featureIdx", "smd", "concept", "description"}
    cli.main(["associate", SF, f"{tmp_path}/two", "--fpc-path", f"{tmp_path}/smd", "--score-colname", "smd", "--k", "7", "--thresholds", "0", "0.5"])
    cli.main(["associate", SF, f"{tmp_path}/one", "--k", "7", "--thresholds", "0", "0.5"])
    key = lambda p: sorted(map(str, _tsv(spark, p).collect()))
    assert key(f"{tmp_path}/one") == key(f"{tmp_path}/two") and len(key(f"{tmp_path}/one")) > 10
    with pytest.raises(SystemExit):
        cli.main(["associate", SF, f"{tmp_path}/x", "--is-prefilter", "--fpc-path", f"{tmp_path}/smd"])


def test_named_columns_pooling_and_sampling(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/eval_data.parquet").withColumnsRenamed({"smiles": "mol", "concept": "what", "token_idxs": "where"})
    rows.write.parquet(f"{tmp_path}/labels")
    spark.read.parquet(f"{SF}/concepts.parquet").withColumnsRenamed({"concept_idx": "no", "concept": "what"}).write.csv(f"{tmp_path}/names", sep="\t", header=True)
    named = ["--data-path", f"{tmp_path}/labels", "--label-path", f"{tmp_path}/names", "--sample-colname", "mol", "--concept-colname", "what", "--label-colname", "where", "--index-colname", "no"]
    for extra in (["--use-pooling"], ["--is-sampling", "--fraction-sampling", "0.5", "--seed-sampling", "3"], ["--all-latents"]):
        cli.main(["associate", SF, f"{tmp_path}/a{len(extra)}", *named, *extra])
        cli.main(["associate", SF, f"{tmp_path}/b{len(extra)}", *extra])
        a, b = (sorted(map(str, _tsv(spark, f"{tmp_path}/{c}{len(extra)}").collect())) for c in "ab")
        assert a == b and a
        for c in "ab":
            (tmp_path / f"{c}{len(extra)}").rename(tmp_path / f"{c}{extra[0]}")
    with pytest.raises(ValueError, match="no such columns"):
        cli.main(["associate", SF, f"{tmp_path}/y", "--label-colname", "nope"])


def test_normalize_and_extract(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 6))
    spark.createDataFrame([(i // 4, i % 4, v.tolist()) for i, v in enumerate(x)], "sample_idx long, token_idx int, vec array<double>").write.parquet(f"{tmp_path}/hidden")
    w = sae.sine_weights(6, 9)
    np.savez(f"{tmp_path}/w.npz", **{f"sae.{k}": v for k, v in w.items()})
    cli.main(["normalize", f"{tmp_path}/hidden", f"{tmp_path}/norm", "--weights", f"{tmp_path}/w.npz", "--prefix", "sae."])
    got = sae.weights_from(spark.read.parquet(f"{tmp_path}/norm/weights"))
    top = sae.pre_activations(got, x).max(0)
    assert np.allclose(top[sae.pre_activations(w, x).max(0) > 0], 1)
    cli.main(["extract", f"{tmp_path}/hidden", f"{tmp_path}/acts", "--weights", f"{tmp_path}/norm/weights", "--layer", "3", "--k", "2"])
    acts = spark.read.parquet(f"{tmp_path}/acts")
    assert acts.count() == (sae.keep_top(sae.pre_activations(got, x), 2) > 0).sum() and {r.sae_key for r in acts.collect()} == {"3-9-2"}


def test_activations_are_shuffled_once_for_all_sums(spark):
    """Sums per sample need no exchange beyond the one that clusters the activations."""
    plan = concepts.sums(tables.acts(spark, SF), [0.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert association.differences(tables.acts(spark, SF), tables.samples(spark, SF), tables.label_tokens(spark, SF), 0.3).count() > 0
