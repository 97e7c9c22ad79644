"""What a latent does over all samples: density, pooling, bins, token preference, position, distribution.

Zeros are data but not rows: every mean divides by an explicit count. Empty inputs give empty results, but per-latent
results list every latent asked for, dead ones with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import broadcast_if, settle
from actlens.functions import smiles as S

#: Counted tokens up to which the vocabulary is broadcast to the latents.
BROADCAST = 100_000


def fired(acts: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_idx, feature, n_active, n_tokens, max, mean, mean_square) of each latent that fires in a sample; means are over all tokens."""
    n = F.col("n_tokens")
    return (
        acts.groupBy("sample_idx", "feature")
        .agg(F.count("*").alias("n_active"), F.max("value").alias("max_value"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_ss"))
        .join(samples.select("sample_idx", "n_tokens").where("n_tokens > 0"), "sample_idx")
        .select("sample_idx", "feature", "n_active", "n_tokens", "max_value", (F.col("_s") / n).alias("mean_value"), (F.col("_ss") / n).alias("mean_square"))
    )


def pooled_vectors(hidden: DataFrame, sample: str, vec: str) -> DataFrame:
    """(sample, dim, mean, max) of dense vectors over the tokens of a sample, NaN values as NaN; null vectors are no tokens."""
    return hidden.select(sample, F.posexplode(vec).alias("dim", "_x")).groupBy(sample, "dim").agg(F.avg("_x").alias("mean"), F.max("_x").alias("max"))


def density(acts: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Per latent of `features`, over the samples it fires in: n and the distribution of its share of active tokens; nulls if it never fires."""
    d = fired(acts, samples).withColumn("d", F.col("n_active") / F.col("n_tokens"))
    q = d.groupBy("feature").agg(
        F.count("*").alias("n"), F.min("d").alias("min"), F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.max("d").alias("max"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"),
    )
    return features.join(q, "feature", "left").select("feature", "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max", "mean", "std")


def bin_map(acts: DataFrame, bins: list[tuple[float, float]]) -> DataFrame:
    """(sample_idx, feature, bins): bit i is set if a value lies in the half-open bin i; pairs without a hit are left out."""
    if len(bins) > 31:
        raise ValueError("at most 31 bins")
    bit = F.lit(0)
    for i, (lo, hi) in enumerate(bins):
        bit = bit.bitwiseOR(F.when((F.col("value") >= lo) & (F.col("value") < hi), 1 << i).otherwise(0))
    return acts.groupBy("sample_idx", "feature").agg(F.bit_or(bit).alias("bins")).where("bins <> 0")


def on_tokens(acts: DataFrame, tokens: DataFrame) -> DataFrame:
    """acts with the token at each position. Merged, never broadcast: Spark takes exploded tokens for as large as the file of strings that they come from, of which they are many times the size."""
    return acts.join(tokens.hint("merge"), ["sample_idx", "token_idx"])


def token_counts(acts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(feature, token, n): how often a latent fires on a token."""
    return on_tokens(acts, tokens).groupBy("feature", "token").agg(F.count("*").alias("n"))


def global_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("total"))


def token_preference(acts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(feature, token, n, ratio, rank): counts by latent and token, their share of all occurrences of the token, by count descending, then token."""
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "token")
    return token_counts(acts, tokens).join(global_counts(tokens), "token").select("feature", "token", "n", (F.col("n") / F.col("total")).alias("ratio"), F.row_number().over(w).alias("rank"))


def token_preference_inverse(acts: DataFrame, tokens: DataFrame, vocabulary: int = 1_000_000) -> DataFrame:
    """(feature, token, n): tokens on which the latent does not fire, as all occurrences less those where it does; zeros are never expanded. Tokens with none are left out. The result has latents times vocabulary rows: a counted vocabulary above the given one is an error, not a silent explosion."""
    total = settle(global_counts(tokens))
    if (n := total.count()) > vocabulary:
        raise ValueError(f"{n} distinct tokens; raise `vocabulary` if a row for each of them and each latent is meant")
    active = settle(token_counts(acts, tokens))  # read twice below
    dims = active.select("feature").distinct().crossJoin(broadcast_if(total, n, BROADCAST))  # latents times vocabulary, which is the result's size
    return dims.join(active, ["feature", "token"], "left").select("feature", "token", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")


def inverse_samples(acts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(feature, n_mol): samples with at least one token on which the latent is silent."""
    sizes = tokens.groupBy("sample_idx").agg(F.count("*").alias("size"))
    full = (
        on_tokens(acts, tokens).select("sample_idx", "feature").repartition("sample_idx").groupBy("sample_idx", "feature").agg(F.count("*").alias("n"))
        .join(sizes.hint("merge"), "sample_idx").groupBy("feature").agg(F.sum((F.col("n") == F.col("size")).cast("long")).alias("full"))
    )
    return full.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("samples")))).select("feature", (F.col("samples") - F.col("full")).alias("n_mol"))


def preference_summary(acts: DataFrame, tokens: DataFrame, by_role: bool = False) -> DataFrame:
    """(feature, n_mol, classes, simpson_d, pielou): sum of squared shares, and 1 - H/H_max (0 for a single class), over tokens or token roles."""
    kind = S.role(F.col("token")) if by_role else F.col("token")
    by = ["sample_idx", "feature"]
    kinds = on_tokens(acts, tokens).select(*by, kind.alias("kind")).repartition(*by).groupBy(*by, "kind").agg(F.count("*").alias("n"))
    once = (F.row_number().over(Window.partitionBy(*by).orderBy("kind")) == 1).cast("long")  # one kind of each sample counts it
    counts = kinds.withColumn("once", once).groupBy("feature", "kind").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    p = counts.withColumn("p", F.col("n") / total)
    evenness = F.when(F.count("*") > 1, 1 - F.try_divide(-F.sum(F.col("p") * F.ln("p")), F.ln(F.count("*")))).otherwise(0.0)
    return p.groupBy("feature").agg(F.count("*").alias("classes"), F.sum(F.col("p") * F.col("p")).alias("simpson_d"), evenness.alias("pielou"), F.sum("once").alias("n_mol"))


def role_counts(acts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(feature, role, n)."""
    return on_tokens(acts, tokens).groupBy("feature", S.role(F.col("token")).alias("role")).agg(F.count("*").alias("n"))


def positional(acts: DataFrame, samples: DataFrame, least: int = 3) -> DataFrame:
    """(feature, n, length_min, length_median, length_max, length_mean, corr_mean): rank correlation of position and value in each sample with at least `least` active tokens, by the short formula (ties take mean ranks, no tie correction), combined by Fisher's z."""
    by = ["sample_idx", "feature"]
    ranked = acts.select(
        *by,
        F.row_number().over(Window.partitionBy(*by).orderBy("token_idx")).alias("rp"),
        (F.rank().over(Window.partitionBy(*by).orderBy("value")) + (F.count("*").over(Window.partitionBy(*by, "value")) - 1) / 2.0).alias("rv"),
    )
    gap = F.col("rp") - F.col("rv")
    rho = ranked.groupBy(*by).agg(F.count("*").alias("m"), F.sum(gap * gap).alias("dd")).where(F.col("m") >= least)
    rho = rho.withColumn("rho", 1 - 6 * F.col("dd") / (F.col("m") * (F.col("m") * F.col("m") - 1)))
    z = F.atanh(F.greatest(F.lit(-0.99999), F.least(F.lit(0.99999), F.col("rho"))))
    n = F.col("n_tokens").cast("double")
    return rho.join(samples.select("sample_idx", "n_tokens"), "sample_idx").groupBy("feature").agg(
        F.count("*").alias("n"), F.min("n_tokens").alias("length_min"), F.percentile(n, 0.5).alias("length_median"), F.max("n_tokens").alias("length_max"),
        F.avg(n).alias("length_mean"), F.tanh(F.avg(z)).alias("corr_mean"),
    )


def dead(acts: DataFrame, features: DataFrame) -> DataFrame:
    """The latents of `features` that never fire."""
    return features.join(acts.select("feature").distinct(), "feature", "left_anti")


def latent_max(acts: DataFrame) -> DataFrame:
    return acts.groupBy("feature").agg(F.max("value").alias("max_value"))


def distribution(acts: DataFrame, tokens: DataFrame, feature: int | None, pattern: str, labels: DataFrame | None = None) -> DataFrame:
    """([feature, ]sample_idx, token_idx, value, token, group): one latent's activations, or with feature=None those of all, with the feature; group is `labelled` where a label holds the token, else `pattern` where the token matches, else `other`."""
    one = on_tokens(acts if feature is None else acts.where(F.col("feature") == feature), tokens)
    hit = F.lit(False)
    if labels is not None:
        one = one.join(labels.select("sample_idx", "token_idx").distinct().withColumn("_hit", F.lit(True)), ["sample_idx", "token_idx"], "left")
        hit = F.coalesce("_hit", F.lit(False))
    group = F.when(hit, "labelled").when(F.col("token").rlike(pattern), "pattern").otherwise("other")
    return one.select(*(["feature"] if feature is None else []), "sample_idx", "token_idx", "value", "token", group.alias("group"))


def histogram(acts: DataFrame, tokens: DataFrame, width: float, bins: int) -> DataFrame:
    """(role, bucket, n) of activation values by token role; the last bucket is open."""
    bucket = F.least(F.lit(bins - 1), F.floor(F.col("value") / width)).cast("int")
    return on_tokens(acts, tokens).groupBy(S.role(F.col("token")).alias("role"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
