"""Latents against concepts: labels, selection, confusion counts, scores, standardized mean differences.

Labels are rows (sample_idx, concept_idx, match_idx, token_idx). Thresholds are a short list, kept as columns until the
last step, so they multiply no rows before the aggregation. Samples without a label never enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import broadcast_if
from actlens.common import fraction as unit

EPS = 1e-7
#: Counted groups of variants up to which their sizes are broadcast to the latents.
GROUPS = 100_000


def sampled(labels: DataFrame, fraction: float, seed: int = 42, bits: int = 16) -> DataFrame:
    """The labels of exactly floor(fraction * n) of the n samples, those with the smallest digests of sample and seed (ties by sample): the same ones for any partitioning.

    No sort of all samples: they are counted in 2^bits ranges of the digest, and only those of the range that the last one falls into are ranked.
    """
    keys = labels.select("sample_idx").distinct().withColumn("_u", unit(F.col("sample_idx"), F.lit(seed))).withColumn("_k", F.floor(F.col("_u") * 2**bits))
    run = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)  # over at most 2^bits counters
    ranges = keys.groupBy("_k").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(run)).withColumn("_want", F.floor(F.lit(float(fraction)) * F.sum("_c").over(Window.partitionBy())))
    ranges = ranges.where(F.col("_upto") - F.col("_c") < F.col("_want"))
    placed = keys.join(ranges, "_k").withColumn("_r", F.when(F.col("_upto") <= F.col("_want"), 0).otherwise(F.col("_upto") - F.col("_c") - F.col("_want")))
    last = F.row_number().over(Window.partitionBy("_k").orderBy("_u", "sample_idx"))
    kept = placed.where("_r = 0").select("sample_idx").unionByName(placed.where("_r < 0").withColumn("_n", last).where("_n <= -_r").select("sample_idx"))
    return labels.join(kept, "sample_idx", "left_semi")


def counts(labels: DataFrame) -> DataFrame:
    """(samples, concepts, matches): how many samples have a label, how many concepts occur, and how many matches there are."""
    matches = labels.select("sample_idx", "concept_idx", "match_idx").distinct()
    return matches.groupBy("sample_idx", "concept_idx").agg(F.count("*").alias("m")).agg(
        F.count_distinct("sample_idx").alias("samples"), F.count_distinct("concept_idx").alias("concepts"), F.coalesce(F.sum("m"), F.lit(0)).alias("matches")
    )


def packed(labels: DataFrame) -> DataFrame:
    """(sample_idx, concepts): a row per sample, its concepts in order, each with its matches as sorted lists of tokens. A list has as many entries as a sample has labels, which its tokens bound."""
    matches = labels.groupBy("sample_idx", "concept_idx", "match_idx").agg(F.array_sort(F.collect_set("token_idx")).alias("m"))
    each = matches.groupBy("sample_idx", "concept_idx").agg(F.array_sort(F.collect_list(F.struct("match_idx", "m"))).alias("l"))
    concepts = F.array_sort(F.collect_list(F.struct("concept_idx", F.col("l.m").alias("matches"))))
    return each.groupBy("sample_idx").agg(concepts.alias("concepts"))


def top_features(scores: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(concept_idx, feature, key): the k latents of each concept with the highest score above `least`, ties to the lower latent; key counts them from 0 in order of latent."""
    good = scores.where(~F.isnan("score") & (F.col("score") > least))
    rank = F.row_number().over(Window.partitionBy("concept_idx").orderBy(F.desc("score"), "feature"))
    best = good.withColumn("_r", rank).where(F.col("_r") <= k)
    return best.select("concept_idx", "feature", (F.row_number().over(Window.partitionBy("concept_idx").orderBy("feature")) - 1).alias("key"))


def _over(thresholds: list[float]) -> list[Column]:
    return [F.sum((F.col("value") > t).cast("long")).alias(f"_{i}") for i, t in enumerate(thresholds)]


def _sum(prefix: str, n: int, to: str) -> list[Column]:
    return [F.sum(f"{prefix}{i}").alias(f"{to}{i}") for i in range(n)]


def _rows(df: DataFrame, thresholds: list[float], cells) -> DataFrame:
    """One row per threshold from columns numbered by threshold."""
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(c.cast("long").alias(n) for n, c in cells(i))) for i, t in enumerate(thresholds))))
    return df.select("concept_idx", "feature", each.alias("r")).select("concept_idx", "feature", "r.*")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def sums(acts: DataFrame, thresholds: list[float]) -> DataFrame:
    """(sample_idx, feature, x, xx, _0, ...): what a latent does in a sample, as sum, sum of squares, and tokens above each threshold. Acts come clustered by these keys, so this shuffles nothing."""
    v = F.col("value")
    return acts.groupBy("sample_idx", "feature").agg(F.sum(v).alias("x"), F.sum(v * v).alias("xx"), *_over(thresholds))


def hits(acts: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_idx, token_idx, concept_idx, feature, value): the activations on tokens of each concept."""
    return acts.join(labels.select("sample_idx", "concept_idx", "token_idx").distinct(), ["sample_idx", "token_idx"])


def confusion(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, thresholds: list[float], fpc: DataFrame | None = None, substructure: bool = False,
    summed: DataFrame | None = None, on: DataFrame | None = None,
) -> DataFrame:
    """(concept_idx, feature, threshold, tp, fn, fp, tn[, tp_sub, n_sub]) over tokens.

    Without fpc, a latent counts in a sample for the concepts present there, if it fires there at all: its recall is
    optimistic. With fpc(concept_idx, feature), given pairs count over every token of every sample that has one of
    the concepts. tp_sub counts matches all of whose tokens are above the threshold; n_sub all matches of the concept.
    summed and on: sums(acts, thresholds) and hits(acts, labels), where they are there already.
    """
    k = range(len(thresholds))
    if fpc is not None:
        labels = labels.join(fpc.select("concept_idx").distinct(), "concept_idx", "left_semi")
    spots = labels.select("sample_idx", "concept_idx", "token_idx").distinct()
    sizes = samples.select("sample_idx", F.col("n_tokens").cast("long").alias("n"))
    present = spots.groupBy("sample_idx", "concept_idx").agg(F.count("*").alias("np"))
    fires = (sums(acts, thresholds) if summed is None else summed).drop("x", "xx")
    if fpc is None:
        base = present.join(sizes, "sample_idx").join(fires, "sample_idx").groupBy("concept_idx", "feature").agg(F.sum("np").alias("np"), F.sum("n").alias("n"), *_sum("_", len(thresholds), "pp"))
    else:
        universe = present.select("sample_idx").distinct()
        n = universe.join(sizes, "sample_idx").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        pp = fires.join(universe, "sample_idx", "left_semi").groupBy("feature").agg(*_sum("_", len(thresholds), "pp"))
        np_ = present.join(sizes.select("sample_idx"), "sample_idx").groupBy("concept_idx").agg(F.sum("np").alias("np"))
        base = fpc.select("concept_idx", "feature").distinct().join(np_, "concept_idx", "left").join(pp, "feature", "left").crossJoin(F.broadcast(n))  # n is one row
    on = (hits(acts, labels) if on is None else on).join(sizes.select("sample_idx"), "sample_idx", "left_semi")
    if fpc is not None:
        on = on.join(fpc.select("concept_idx", "feature").distinct(), ["concept_idx", "feature"], "left_semi")
    out = base.join(on.groupBy("concept_idx", "feature").agg(*(c.alias(f"tp{i}") for i, c in enumerate(_over(thresholds)))), ["concept_idx", "feature"], "left")
    tp, pp, np_ = (lambda i: _zero(f"tp{i}")), (lambda i: _zero(f"pp{i}")), _zero("np")
    cells = lambda i: [("tp", tp(i)), ("fn", np_ - tp(i)), ("fp", pp(i) - tp(i)), ("tn", F.col("n") - np_ - pp(i) + tp(i))]
    if not substructure:
        return _rows(out, thresholds, cells)
    width = labels.groupBy("sample_idx", "concept_idx", "match_idx").agg(F.count_distinct("token_idx").alias("width"))
    whole = (
        acts.join(labels.distinct(), ["sample_idx", "token_idx"])
        .groupBy("sample_idx", "concept_idx", "match_idx", "feature").agg(*_over(thresholds))
        .join(width, ["sample_idx", "concept_idx", "match_idx"])
        .groupBy("concept_idx", "feature").agg(*(F.sum((F.col(f"_{i}") == F.col("width")).cast("long")).alias(f"sub{i}") for i in k))
    )
    total = width.groupBy("concept_idx").agg(F.count("*").alias("n_sub"))
    out = out.join(whole, ["concept_idx", "feature"], "left").join(total, "concept_idx", "left")
    return _rows(out, thresholds, lambda i: [*cells(i), ("tp_sub", _zero(f"sub{i}")), ("n_sub", _zero("n_sub"))])


def scores(cm: DataFrame, substructure: bool = False, digits: int = 4) -> DataFrame:
    """Metrics rows (conceptIdx, featureIdx, threshold, tPos, fNeg, fPos, tNeg, precision, recall, f1Score, tPosSub) with a positive F1, rounded."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + EPS)
    recall = F.try_divide(F.col("tp_sub").cast("double"), F.col("n_sub")) if substructure else F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    f1 = 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + EPS)
    r = lambda c: F.round(F.col(c), digits)
    return (
        cm.withColumn("p", precision).withColumn("r", recall).withColumn("f1", f1).where("f1 > 0")
        .select(
            F.col("concept_idx").alias("conceptIdx"), F.col("feature").alias("featureIdx"), r("threshold").alias("threshold"),
            F.col("tp").alias("tPos"), F.col("fn").alias("fNeg"), F.col("fp").alias("fPos"), F.col("tn").alias("tNeg"),
            r("p").alias("precision"), r("r").alias("recall"), r("f1").alias("f1Score"), (F.col("tp_sub") if substructure else F.lit(0).cast("long")).alias("tPosSub"),
        )
    )


def _smd(pos: tuple[Column, Column], neg: tuple[Column, Column], n_pos: Column, n_neg: Column, eps: float) -> Column:
    """NaN where a side has no unit; zeros are units."""
    mean = lambda x, n: F.try_divide(x, n)
    pm, nm = mean(pos[0], n_pos), mean(neg[0], n_neg)
    var = (mean(pos[1], n_pos) - pm * pm + mean(neg[1], n_neg) - nm * nm) / 2
    return F.coalesce((pm - nm) / (F.sqrt(F.greatest(var, F.lit(0.0))) + eps), F.lit(float("nan")))


def concept_smd(
    acts: DataFrame, samples: DataFrame, labels: DataFrame, pooled: bool = False, eps: float = 1e-6, summed: DataFrame | None = None, on: DataFrame | None = None
) -> DataFrame:
    """(concept_idx, feature, smd): standardized difference between a latent's activation on concept tokens and on the other tokens of the samples that hold the concept.

    pooled: a positive unit is a match (mean, and mean of squares, inside it); negative are the tokens outside the
    first match. Pairs whose latent never fires in a sample with the concept are left out; their difference is 0.
    summed and on: sums(acts, ...) and hits(acts, labels), where they are there already.
    """
    v = F.col("value")
    sizes = samples.select("sample_idx", F.col("n_tokens").cast("long").alias("n"))
    labels = labels.join(sizes.select("sample_idx"), "sample_idx", "left_semi")
    spots = labels.select("sample_idx", "concept_idx", "token_idx").distinct()
    width = (labels.groupBy("sample_idx", "concept_idx", "match_idx") if pooled else spots.groupBy("sample_idx", "concept_idx")).agg(F.count_distinct("token_idx").alias("w"))
    first = width.where("match_idx = 0") if pooled else width
    n_neg = first.join(sizes, "sample_idx").groupBy("concept_idx").agg(F.sum(F.col("n") - F.col("w")).alias("n_neg"))
    n_pos = width.groupBy("concept_idx").agg((F.count("*") if pooled else F.sum("w")).alias("n_pos"))
    per_sample = (sums(acts, []) if summed is None else summed).select("sample_idx", "feature", "x", "xx")
    tot = first.select("sample_idx", "concept_idx").join(per_sample, "sample_idx").groupBy("concept_idx", "feature").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    if pooled:
        hit = acts.join(labels.distinct(), ["sample_idx", "token_idx"]).join(width, ["sample_idx", "concept_idx", "match_idx"])
        w, one = F.col("w"), F.when(F.col("match_idx") == 0, v).otherwise(0.0)
        pos = hit.groupBy("concept_idx", "feature").agg(F.sum(v / w).alias("px"), F.sum(v * v / w).alias("pxx"), F.sum(one).alias("ox"), F.sum(one * v).alias("oxx"))
    else:
        pos = (hits(acts, labels) if on is None else on.join(sizes.select("sample_idx"), "sample_idx", "left_semi")).groupBy("concept_idx", "feature").agg(F.sum(v).alias("px"), F.sum(v * v).alias("pxx"), F.sum(v).alias("ox"), F.sum(v * v).alias("oxx"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = tot.join(pos, ["concept_idx", "feature"], "left").join(n_pos.join(n_neg, "concept_idx"), "concept_idx")
    smd = _smd((z("px"), z("pxx")), (F.col("x") - z("ox"), F.col("xx") - z("oxx")), F.col("n_pos").cast("double"), F.col("n_neg").cast("double"), eps)
    return both.select("concept_idx", "feature", smd.alias("smd"))


def representation_smd(acts: DataFrame, variants: DataFrame, references: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, grp, smd, ref_hi, alt_hi): a latent's maximum in reference strings against the mean of its maxima in the variants of a group.

    variants(alt_idx, ref_idx, grp); references(ref_idx). Reference moments are over all references; wins compare a
    reference with its own group mean, strictly. Divisions by zero give NaN or infinity.
    """
    top = acts.groupBy("sample_idx", "feature").agg(F.max("value").alias("x"))
    ref = top.join(references, F.col("sample_idx") == F.col("ref_idx")).select("ref_idx", "feature", "x")
    nv = variants.groupBy("ref_idx", "grp").agg(F.count("*").alias("k"))
    alt = top.join(variants, F.col("sample_idx") == F.col("alt_idx")).groupBy("ref_idx", "grp", "feature").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    # pairs where neither side fires add nothing but to the count, which nv has
    pairs = nv.join(ref.withColumnRenamed("x", "rx"), "ref_idx").select("ref_idx", "grp", "feature", "rx")
    both = pairs.join(alt, ["ref_idx", "grp", "feature"], "full").join(nv, ["ref_idx", "grp"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ax, axx = z("x") / F.col("k"), z("xx") / F.col("k")
    sums = both.groupBy("feature", "grp").agg(
        F.sum(ax).alias("ax"), F.sum(axx).alias("axx"), F.sum((z("rx") > ax).cast("long")).alias("ref_hi"), F.sum((ax > z("rx")).cast("long")).alias("alt_hi")
    )
    count = nv.groupBy("grp").agg(F.count("*").cast("double").alias("m"))
    whole = references.agg(F.count("*").cast("double").alias("r"))
    moments = ref.groupBy("feature").agg(F.sum("x").alias("rs"), F.sum(F.col("x") * F.col("x")).alias("rss"))
    groups = nv.select("grp").distinct().count()
    grid = features.crossJoin(broadcast_if(count, groups, GROUPS)).crossJoin(F.broadcast(whole))  # latents times groups, which is the result's size; whole is one row
    out = grid.join(sums, ["feature", "grp"], "left").join(moments, "feature", "left")
    rm, am = z("rs") / F.col("r"), z("ax") / F.col("m")
    sd = F.sqrt(F.greatest(F.lit(0.0), (z("rss") / F.col("r") - rm * rm + z("axx") / F.col("m") - am * am) / 2))
    diff = rm - am
    smd = F.when(sd > 0, diff / F.when(sd > 0, sd)).when(diff > 0, float("inf")).when(diff < 0, float("-inf")).otherwise(float("nan"))
    return out.select("feature", "grp", smd.alias("smd"), F.coalesce("ref_hi", F.lit(0)).alias("ref_hi"), F.coalesce("alt_hi", F.lit(0)).alias("alt_hi"))


def names(df: DataFrame, concepts: DataFrame, column: str = "conceptIdx", strict: bool = True) -> DataFrame:
    """Adds concept and description; an unknown index is an error, or with strict=False leaves nulls."""
    dim = concepts.select(F.col("concept_idx").alias(column), "concept", "description")
    out = df.join(dim, column, "left")
    if strict:
        out = out.withColumn("concept", F.when(F.col("concept").isNull(), F.raise_error(F.concat(F.lit("no concept of index "), F.col(column).cast("string")))).otherwise(F.col("concept")))
    return out
