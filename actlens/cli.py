"""Command line: associate latents with concepts; extract activations from hidden states; normalize autoencoders."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.common import clear, ship
from actlens.operators import concepts, sae
from actlens.plans import association
from actlens.sources import files, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="actlens")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("associate", help="scores of latents against concepts, as tab-separated text")
    a.add_argument("folder", help="folder with samples, activations, concepts and eval_data as Parquet")
    a.add_argument("out")
    a.add_argument("--data-path", help="label table in Parquet, instead of the folder's eval_data")
    a.add_argument("--label-path", help="tab-separated concepts with index, name and description, instead of the folder's table")
    a.add_argument("--sample-colname", default="smiles", help="of the label table")
    a.add_argument("--concept-colname", default="concept", help="of the label table and of the concepts")
    a.add_argument("--label-colname", default="token_idxs", help="of the label table")
    a.add_argument("--index-colname", default="concept_idx", help="of the concepts")
    a.add_argument("--desc-colname", default="description", help="of the concepts")
    a.add_argument("--thresholds", type=float, nargs="+", default=[0.0])
    a.add_argument("--use-pooling", action="store_true", help="matches of several tokens as units: pooled differences, recall of whole matches")
    a.add_argument("--is-prefilter", action="store_true", help="write the mean differences instead of scores")
    a.add_argument("--fpc-path", help="tab-separated conceptIdx, featureIdx and perhaps a score: latents per concept, as --is-prefilter writes them; without it, they are chosen on the way")
    a.add_argument("--all-latents", action="store_true", help="all latents for every concept, instead of chosen ones")
    a.add_argument("--score-colname", help="score to choose by in --fpc-path; without it, all its pairs count")
    a.add_argument("--score-threshold", type=float, default=0.0)
    a.add_argument("--k", type=int, default=64, help="latents per concept")
    a.add_argument("--is-sampling", action="store_true", help="the mean differences of a share of the samples only")
    a.add_argument("--fraction-sampling", type=float, default=0.2)
    a.add_argument("--seed-sampling", type=int, default=42)
    e = sub.add_parser("extract", help="activations of one or more autoencoders from (sample_idx, token_idx, vec)")
    n = sub.add_parser("normalize", help="an autoencoder whose latents have a maximum of 1 over (sample_idx, token_idx, vec)")
    for c in (e, n):
        c.add_argument("hidden")
        c.add_argument("out")
    e.add_argument("--weights", nargs="+", required=True, help=".npz files with w_enc, w_dec, b_enc, b_pre, or folders of weight tables")
    e.add_argument("--layer", type=int, nargs="+", required=True)
    e.add_argument("--k", type=int, nargs="+", required=True)
    n.add_argument("--weights", required=True)
    n.add_argument("--prefix", default="", help="what stands before the names of a checkpoint's arrays")
    return p


def _weights(spark: SparkSession, path: str, prefix: str = "") -> dict[str, np.ndarray]:
    if not path.endswith(".npz"):
        return sae.weights_from(spark.read.parquet(path))
    w, warnings = sae.load_state(dict(np.load(path)), prefix)
    for x in warnings:
        print("Warning:", x)
    return w


def _labels(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    names = {args.index_colname: "concept_idx", args.concept_colname: "concept"} | ({args.desc_colname: "description"} if args.desc_colname else {})
    dim = spark.read.csv(args.label_path, sep="\t", header=True, inferSchema=True) if args.label_path else tables.concepts(spark, args.folder)
    rows = spark.read.parquet(args.data_path or f"{args.folder}/eval_data.parquet")
    rows = files.rename(rows, {args.sample_colname: "smiles", args.concept_colname: "concept", args.label_colname: "token_idxs"})
    dim = files.rename(dim, names)
    return tables.labels_of(rows, dim), dim if "description" in dim.columns else dim.withColumn("description", F.lit(None).cast("string"))


def _given_pairs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    pairs = spark.read.csv(args.fpc_path, sep="\t", header=True, inferSchema=True, nanValue="NaN")
    pairs = files.rename(pairs, {"conceptIdx": "concept_idx", "featureIdx": "feature"} | ({args.score_colname: "score"} if args.score_colname else {}))
    return concepts.top_features(pairs.withColumn("score", F.col("score").cast("double")), args.k, args.score_threshold) if args.score_colname else pairs.select("concept_idx", "feature").distinct()


def _associate(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.is_prefilter and args.fpc_path:
        raise SystemExit("--fpc-path is not used with --is-prefilter")
    acts, samples = tables.acts(spark, args.folder), tables.samples(spark, args.folder)
    labels, names = _labels(spark, args)
    share = args.fraction_sampling if args.is_sampling else 1.0
    if args.is_prefilter:
        smd = association.differences(acts, samples, labels, share, args.seed_sampling, args.use_pooling)
        out = concepts.names(smd.select(F.col("concept_idx").alias("conceptIdx"), F.col("feature").alias("featureIdx"), F.col("score").alias("smd")), names).orderBy("featureIdx")
    elif args.all_latents:
        cm = concepts.confusion(acts, samples, labels, args.thresholds, None, args.use_pooling)
        out = concepts.names(concepts.scores(cm, args.use_pooling), names).orderBy("featureIdx")
    else:
        fpc = _given_pairs(spark, args) if args.fpc_path else None
        out = association.associate(acts, samples, labels, names, args.thresholds, args.k, args.use_pooling, share, args.seed_sampling, args.use_pooling, fpc)
    files.write_tsv(out, args.out)


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    if not len(args.weights) == len(args.layer) == len(args.k):
        raise SystemExit("--weights, --layer and --k must have the same number of values")
    models = sae.Registry()
    for path, layer, k in zip(args.weights, args.layer, args.k):
        models.add(layer, _weights(spark, path), k)
    acts = models.encode_all(spark.read.parquet(args.hidden), ["sample_idx", "token_idx"], "vec")
    acts.repartition("sample_idx").sortWithinPartitions("sample_idx", "feature").write.partitionBy("sae_key").parquet(args.out)


def _normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    """OUT/max: the maxima by latent; OUT/weights: the scaled weights."""
    w = _weights(spark, args.weights, args.prefix)
    sae.pre_max(spark.read.parquet(args.hidden), "vec", w).write.parquet(f"{args.out}/max")
    top = {r.feature: r.max_value for r in spark.read.parquet(f"{args.out}/max").collect()}  # one number per latent
    scaled, dead = sae.normalized(w, top)
    sae.weights_table(spark, scaled).write.parquet(f"{args.out}/weights")
    print("dead latents:", len(dead))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        {"associate": _associate, "extract": _extract, "normalize": _normalize}[args.command](spark, args)
    finally:
        clear(spark)


if __name__ == "__main__":
    main()
