"""Mixing sources to target weights, in tokens of a public tokenizer.

Sizes are token counts, summed per source. Weights come by temperature: source token shares p are raised to an exponent
and normalised, and the exponent is bisected. `mix_targets` gives shares outright, which are the weights as far as the
repetition limits allow. What the limits (and sources that are missing) leave of the total goes to the sources that still
have room, by tempered shares: the exponent is bisected to the one nearest to 1, the natural shares, at which no limit is
exceeded; if there is none, sources are filled to their limits and the rest is spread anew. With `entropy` the weights
themselves are tempered shares, of the exponent bisected to that entropy. With fill=False nothing is spread: every
source has its target share of the total or what its limit allows, and the total falls short.

Weights are realised as budgeted block permutations: a source's documents lie in BLOCKS blocks by a hash seeded with
the mix; whole passes over the source fill its budget as often as they fit, blocks in permuted order fill the rest,
and in the last block documents in hash order, as many as keep nearest to the budget. Running sums run over blocks
and inside one block of a source, never over a whole source. Each mix is planned in a task of its own, from one row per
source.

Defined results: sources are compared without outer white space and case; a null or blank source is no source; a null
or non-positive share leaves the source out; a null or negative limit means no repetition at all (0 copies);
target rows of one mix and source add their shares and take the smaller limit; null and empty texts have 0 tokens and
are never chosen; repeated documents are documents each; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import broadcast_if, norm, settle
from actlens.llm.encode import NAME, TOKENIZERS, encode_corpus

#: Blocks of a source; rows of a plan (mixes times sources) up to which it is broadcast to the documents; greatest exponent.
BLOCKS, PLAN_ROWS, SHARPEST = 4096, 100_000, 16.0


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def tempered(p: np.ndarray, t: float) -> np.ndarray:
    """p ** t, normalised; sources of size 0 get 0."""
    out, some = np.zeros(len(p)), np.asarray(p) > 0
    if some.any():
        logs = t * np.log(np.asarray(p)[some])
        out[some] = np.exp(logs - logs.max())
    return out / (out.sum() or 1.0)


def bisect_exponent(ok, good: float, bad: float, steps: int = 50) -> float:
    """The exponent next to `bad`, on the way from `good`, for which ok holds."""
    for _ in range(steps):
        mid = (good + bad) / 2
        good, bad = (mid, bad) if ok(mid) else (good, mid)
    return good


def for_entropy(p: np.ndarray, target: float) -> float:
    """The exponent in [0, SHARPEST] at which the tempered shares have the target entropy, or come nearest."""
    ok = lambda t: entropy(tempered(p, t)) >= target
    return SHARPEST if ok(SHARPEST) else bisect_exponent(ok, 0.0, SHARPEST)


def nearest_fitting(fits, start: float = 1.0) -> float | None:
    """The exponent nearest to start for which fits holds: a grid finds a place, bisection its border; None if no place on the grid fits."""
    if fits(start):
        return start
    grid = [t for t in np.linspace(0, SHARPEST, 257) if fits(t)]
    if not grid:
        return None
    t = min(grid, key=lambda x: abs(x - start))
    return bisect_exponent(fits, t, max(t - SHARPEST / 256, start) if t > start else min(t + SHARPEST / 256, start))


def weights(natural: np.ndarray, share: np.ndarray, cap: np.ndarray, fill: bool = True) -> tuple[np.ndarray, float | None]:
    """The realised weights (in shares of the total, none above its cap), and the exponent of the first spreading; null if nothing was spread or no exponent fits."""
    w, exponent, first = np.minimum(share, cap), None, True
    while fill and (left := 1 - w.sum()) > 1e-9:
        room = (natural > 0) & (w < cap * (1 - 1e-12))
        if not room.any():
            break
        extra = lambda t: left * tempered(np.where(room, natural, 0), t)  # noqa: B023, E731
        t = nearest_fitting(lambda t: bool((w + extra(t) <= cap + 1e-12).all()))  # noqa: B023
        exponent, first = (t if first else exponent), False
        w = np.minimum(w + extra(1.0 if t is None else t), cap)
    return w, exponent


def sized(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source and at least one token."""
    source = norm(F.col("source"))
    docs = documents.where((source != "") & (F.length("text") > 0)).select(F.struct("doc_id", source.alias("source")).alias("key"), "text")
    return encode_corpus(docs, "key", "text", folder, name).select("key.doc_id", "key.source", F.size("ids").cast("long").alias("n_tokens")).where("n_tokens > 0")


def targets(mix_targets: DataFrame) -> DataFrame:
    """(mix_id, source, share, max_repeats), shares adding up to 1 within a mix."""
    rows = (
        mix_targets.where("target_share > 0 and not isnan(target_share) and mix_id is not null")
        .groupBy("mix_id", norm(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.greatest(F.lit(0), F.min(F.coalesce("max_repeats", F.lit(0)))).alias("max_repeats"))
        .where("source != ''")
    )
    return rows.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("mix_id")))


PLAN = "mix_id string, source string, target_share double, max_repeats int, source_tokens long, target_tokens double, budget double, passes int, rest double, weight double, fill_exponent double, entropy_exponent double, tempered_share double"


def plan(sizes: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, fill: bool = True, target_entropy: float | None = None) -> DataFrame:
    """A row per mix and source: the weight that temperature and limits give, its budget as whole passes and a rest, and the exponents."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = targets(mix_targets).join(have, "source", "left").fillna(0, ["source_tokens"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        tokens, share, repeats = (pdf[c].to_numpy(np.float64) for c in ("source_tokens", "share", "max_repeats"))
        known = tokens.sum()
        total = float(known if total_tokens is None else total_tokens)
        natural = tokens / (known or 1.0)
        t = for_entropy(natural, entropy(share) if target_entropy is None else target_entropy)
        mild = tempered(natural, t)
        w, spread = weights(natural, share if target_entropy is None else mild, tokens * repeats / (total or 1.0), fill)
        budget = np.minimum(w * total, tokens * repeats)
        passes = np.floor(budget / np.maximum(tokens, 1.0))
        return pdf[["mix_id", "source"]].assign(
            target_share=share, max_repeats=pdf["max_repeats"].astype(np.int32), source_tokens=pdf["source_tokens"], target_tokens=share * total, budget=budget,
            passes=passes.astype(np.int32), rest=budget - passes * tokens, weight=w, fill_exponent=np.nan if spread is None else spread, entropy_exponent=t, tempered_share=mild,
        )

    out = rows.groupBy("mix_id").applyInPandas(one, PLAN)
    return out.withColumn("fill_exponent", F.nanvl("fill_exponent", F.lit(None)))


def mix(
    documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS, name: str = NAME, fill: bool = True, target_entropy: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix_id, source, doc_id, n_tokens, copies), and the plan it follows. total_tokens: None is the size of the mix's own sources."""
    sizes = settle(sized(documents, folder, name))
    steps = settle(plan(sizes, mix_targets, total_tokens, fill, target_entropy))
    own = steps.where("budget > 0").select("mix_id", "source", "passes", "rest", "max_repeats")
    rows = sizes.join(broadcast_if(own, steps.count(), PLAN_ROWS), "source")
    order = F.xxhash64("doc_id", "n_tokens", "mix_id")
    rows = rows.withColumn("block", F.pmod(order, F.lit(BLOCKS))).withColumn("order", order)
    by_block = Window.partitionBy("mix_id", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("mix_id", "source", "block").agg(F.sum("n_tokens").alias("size")).withColumn("upto", F.sum("size").over(by_block))
    blocks = blocks.select("mix_id", "source", "block", (F.col("upto") - F.col("size")).alias("before"), "upto")
    inside = Window.partitionBy("mix_id", "source", "block").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(blocks, ["mix_id", "source", "block"])
    whole = placed.where("upto <= rest or before >= rest").withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int"))
    cut = placed.where("upto > rest and before < rest").withColumn("cum", F.col("before") + F.sum("n_tokens").over(inside))
    cut = cut.withColumn("extra", ((F.col("cum") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("passes") < F.col("max_repeats"))).cast("int"))
    cols = ["mix_id", "source", "doc_id", "n_tokens", (F.col("passes") + F.col("extra")).alias("copies")]
    return whole.select(*cols).unionByName(cut.select(*cols)).where("copies > 0"), steps


def report(
    documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, folder: str = TOKENIZERS, name: str = NAME, fill: bool = True, target_entropy: float | None = None
) -> DataFrame:
    """(mix_id, source, target_share, weight, actual_share, target_tokens, actual_tokens, shortfall, most_copies, exponents): shortfall is what the limit takes away from the target."""
    chosen, steps = mix(documents, mix_targets, total_tokens, folder, name, fill, target_entropy)
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("most_copies"))
    rows = steps.join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "most_copies"])
    share = F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(Window.partitionBy("mix_id")))
    short = F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("budget"))
    return rows.select(
        "mix_id", "source", "target_share", "weight", share.alias("actual_share"), "target_tokens", "actual_tokens", short.alias("shortfall"),
        "most_copies", "max_repeats", "fill_exponent", "entropy_exponent", "tempered_share",
    )
