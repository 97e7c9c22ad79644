"""Per-key results when a few keys hold most records.

Everything rests on value histograms with mergeable counters: the values are reduced once, map-side first, to counts
(key, value, n), and these to (key, bucket, n, total), so the rows of a hot key never meet in one task; only its bounded
histogram does. Totals per key are sums over the histogram. Exact quantiles refine the one bucket that holds the target
rank, BITS more bits of the value a round, until every rank is resolved to one value.

Defined results: null keys are none; null values are skipped; a key without values has null quantiles; an empty
table gives no rows. Values are integers (int or long).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import broadcast_if, norm, settle

#: Bits of the value that a round settles: a histogram has at most 2^BITS buckets a key.
BITS = 4
#: Counted state rows up to which the state of a refinement round is broadcast.
STATE_LIMIT = 200_000
#: Copies of the state, and salts of the data, beyond that.
SALTS = 32


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v, n): mergeable counts of each key's values."""
    return df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).where("k is not null and v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))


def histogram(counts: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """Mergeable counters (keys, bucket, n, total) with bucket = v >> shift."""
    return counts.groupBy(*keys, F.shiftright("v", shift).alias("bucket")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("total"))


def shifts(lo: int, hi: int, bits: int = BITS) -> list[int]:
    """The bits that the buckets of each round leave open, down to 0."""
    first = max(0, max(abs(lo), abs(hi)).bit_length() - bits)
    return [*range(first, 0, -bits), 0]


def _pick(hist: DataFrame, groups: list[str], targets: DataFrame) -> DataFrame:
    """For each target (groups, prob, rank): the bucket where the running count reaches rank, and the rank inside it. A group has at most 2^bits buckets."""
    w = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("cum", F.sum("n").over(w))
    return (
        run.join(targets, groups)
        .where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
        .withColumn("rank", F.col("rank") - F.col("cum") + F.col("n"))
    )


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float], bits: int = BITS) -> DataFrame:
    """(key, prob, value): the exact nearest-rank quantiles (rank ceil(prob * n)) of an integer column per key.

    Each round fixes `bits` more bits of every quantile, over the counts worked out once. Its state has a row per key
    and probability; it is broadcast only if the counted rows are few, else joined on the key with salts, so that no
    task gets a hot key's values.
    """
    counts = settle(value_counts(df, key, value))
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    p = F.explode(F.array(*(F.lit(float(x)) for x in probs)))
    if lo is None:
        return counts.select(F.col("k").alias(key), F.lit(0.0).alias("prob"), F.col("v").alias("value")).limit(0)
    rounds = shifts(lo, hi, bits)
    hist = settle(histogram(counts, ["k"], rounds[0]))
    want = hist.groupBy("k").agg(F.sum("n").alias("total")).select("k", p.alias("prob"), "total")
    want = want.select("k", "prob", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("total"))).cast("long").alias("rank"))
    state = _pick(hist, ["k"], want).select("k", "prob", "rank", "bucket")
    for shift, finer in zip(rounds, rounds[1:]):
        state = settle(state)
        open_ = state.select("k", F.col("bucket").alias("parent")).distinct()
        n = state.count()  # at least as many as the open buckets
        split = counts.withColumn("parent", F.shiftright("v", shift))
        if n <= STATE_LIMIT:
            kept = split.join(broadcast_if(open_, n, STATE_LIMIT), ["k", "parent"], "left_semi")
        else:
            salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            kept = split.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["k", "parent", "salt"], "left_semi")
        hist = histogram(kept, ["k", "parent"], finer)
        state = _pick(hist, ["k", "parent"], state.withColumnRenamed("bucket", "parent")).select("k", "prob", "rank", "bucket")
    return state.select(F.col("k").alias(key), "prob", F.col("bucket").alias("value"))


def wide_quantiles(df: DataFrame, key: str, value: str, probs: list[float], prefix: str) -> DataFrame:
    """(key, prefix_p50, ...): the quantiles as columns."""
    named = (F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"{prefix}_p{round(100 * p)}") for p in probs)
    return exact_quantiles(df, key, value, probs).groupBy(key).agg(*named)


def concept_rows(eval_data: DataFrame) -> DataFrame:
    """(sample_idx, concept, token_idxs, width): rows that have a concept, in lower case, with their number of integers."""
    width = F.aggregate(
        F.coalesce("token_idxs", F.array().cast("array<array<int>>")), F.lit(0).cast("long"),
        lambda n, m: n + F.coalesce(F.size(F.filter(m, lambda t: t.isNotNull())), F.lit(0)),
    )
    c = norm(F.col("concept"))
    return eval_data.where(c != "").select(F.col("smiles").alias("sample_idx"), c.alias("concept"), "token_idxs", width.alias("width"))


def heavy_keys(eval_data: DataFrame, share: float = 0.05) -> DataFrame:
    """(concept, rows, indices): the keys with at least `share` of all rows or of all integers, read off the counters of the row widths' histogram, as the first round of the selection has it."""
    counts = settle(value_counts(concept_rows(eval_data), "concept", "width"))
    top = counts.agg(F.max("v")).first()[0] or 0
    hist = histogram(counts, ["k"], shifts(0, top)[0])
    per_key = hist.groupBy(F.col("k").alias("concept")).agg(F.sum("n").alias("rows"), F.sum("total").alias("indices"))
    rows, indices = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("v"))).first()
    return per_key.where((F.col("rows") >= share * (rows or 0)) | ((F.col("indices") > 0) & (F.col("indices") >= share * (indices or 0))))


def concept_stats(eval_data: DataFrame, probs: list[float] = (0.5, 0.95)) -> DataFrame:
    """(concept, rows, matches, positions, width_p50, width_p95) for every concept.

    rows and matches sum map-side; positions are distinct (sample, token), grouped by that whole key, which spreads a
    hot concept evenly, and then counted map-side per concept; the widths' quantiles come by exact selection.
    """
    rows = concept_rows(eval_data)
    sums = rows.groupBy("concept").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.size(F.filter("token_idxs", lambda m: m.isNotNull())), F.lit(0)).cast("long")).alias("matches"))
    spots = (
        rows.select("concept", "sample_idx", F.explode(F.array_distinct(F.flatten(F.filter("token_idxs", lambda m: m.isNotNull())))).alias("token"))
        .where("token is not null and sample_idx is not null")
        .groupBy("concept", "sample_idx", "token").agg(F.lit(1))
        .groupBy("concept").agg(F.count("*").alias("positions"))
    )
    q = wide_quantiles(rows, "concept", "width", list(probs), "width")
    return sums.join(spots, "concept", "left").join(q, "concept", "left").withColumn("positions", F.coalesce("positions", F.lit(0)))


def concept_quantiles(eval_data: DataFrame, probs: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(concept, sample_p25, ..., token_p25, ...): exact quantiles of the sample numbers of a concept's rows, and of the integers in its matches."""
    rows = concept_rows(eval_data)
    tokens = rows.select("concept", F.explode(F.flatten(F.filter("token_idxs", lambda m: m.isNotNull()))).alias("token"))
    of_samples, of_tokens = wide_quantiles(rows, "concept", "sample_idx", list(probs), "sample"), wide_quantiles(tokens, "concept", "token", list(probs), "token")
    return of_samples.join(of_tokens, "concept", "full")
