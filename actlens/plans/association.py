"""Concept association from end to end: prefilter by mean difference, latents per concept, confusion counts, scores, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.common import settle
from actlens.operators import concepts as C


def prefilter(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, k: int, fraction: float = 1.0, seed: int = 42, pooled: bool = False, summed: DataFrame | None = None, on: DataFrame | None = None
) -> DataFrame:
    """fpc(concept_idx, feature, key): the k latents with the highest positive difference per concept, on a fraction of the samples (1: all)."""
    return C.top_features(differences(acts, samples, labels, fraction, seed, pooled, summed, on), k)


def differences(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, fraction: float = 1.0, seed: int = 42, pooled: bool = False, summed: DataFrame | None = None, on: DataFrame | None = None
) -> DataFrame:
    """(concept_idx, feature, score): the mean differences that the prefilter ranks, on a fraction of the samples."""
    if fraction < 1:
        labels = settle(C.sampled(labels, fraction, seed))
        on = on if on is None else on.join(labels.select("sample_idx").distinct(), "sample_idx", "left_semi")
    return C.concept_smd(acts, samples, labels, pooled, summed=summed, on=on).withColumnRenamed("smd", "score")


def associate(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, concepts: DataFrame, thresholds: list[float], k: int = 64, substructure: bool = False, fraction: float = 1.0,
    seed: int = 42, pooled: bool = False, fpc: DataFrame | None = None,
) -> DataFrame:
    """Metrics rows with concept names, in order of latent, concept and threshold. fpc: the latents of each concept, if they are chosen already."""
    cm = chosen_confusion(acts, samples, labels, thresholds, k, substructure, fraction, seed, pooled, fpc)
    return C.names(C.scores(cm, substructure), concepts).orderBy("featureIdx", "conceptIdx", "threshold")


def chosen_confusion(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, thresholds: list[float], k: int = 64, substructure: bool = False, fraction: float = 1.0,
    seed: int = 42, pooled: bool = False, fpc: DataFrame | None = None,
) -> DataFrame:
    """The confusion counts of the latents that the prefilter chooses, or that fpc gives.

    The activations are cleaned and clustered once; both passes read their sums per sample and their rows on concept tokens, which are settled too, so activations are shuffled twice in all.
    """
    acts, samples, labels = settle(acts), settle(samples), settle(labels)
    summed, on = settle(C.sums(acts, thresholds)), settle(C.hits(acts, labels))
    if fpc is None:
        fpc = prefilter(acts, samples, labels, k, fraction, seed, pooled, summed, on)
    return C.confusion(acts, samples, labels, thresholds, settle(fpc), substructure, summed, on)


def best_latents(metrics: DataFrame) -> DataFrame:
    """(conceptIdx, featureIdx, threshold, f1Score): the best row of each concept; ties to the lower latent, then threshold."""
    best = F.max(F.struct("f1Score", (-F.col("featureIdx")).alias("f"), (-F.col("threshold")).alias("t"))).alias("b")
    return metrics.groupBy("conceptIdx").agg(best).select("conceptIdx", (-F.col("b.f")).alias("featureIdx"), (-F.col("b.t")).alias("threshold"), F.col("b.f1Score").alias("f1Score"))
