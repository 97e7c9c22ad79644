"""Sparse autoencoder mathematics on batches of vectors: numpy inside Arrow batches, weights broadcast once.

Weights: w_enc (dim, latents), w_dec (latents, dim), b_enc (latents), b_pre (dim). A vector is centred, divided by its
sample standard deviation + 1e-5, encoded, and its k greatest pre-activations are kept if positive (ties to the lower
latent). Null vectors give no rows; NaN values count as the least. Decoding keeps the k greatest again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.common import let


def sine_weights(dim: int, latents: int) -> dict[str, np.ndarray]:
    """A deterministic stand-in for trained weights, so that other engines can recompute it."""
    w = np.sin(0.1 * (np.arange(dim)[:, None] * 64 + np.arange(latents)[None, :]))
    return {"w_enc": w, "w_dec": w.T.copy(), "b_enc": np.zeros(latents), "b_pre": np.zeros(dim)}


def layer_norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mu = x.mean(1, keepdims=True)
    std = (x - mu).std(1, ddof=1, keepdims=True)
    return (x - mu) / (std + 1e-5), mu, std


def pre_activations(w: dict, x: np.ndarray) -> np.ndarray:
    return (layer_norm(x)[0] - w["b_pre"]) @ w["w_enc"] + w["b_enc"]


def keep_top(pre: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, if positive; zero elsewhere."""
    order = np.argsort(-np.nan_to_num(pre, nan=-np.inf), axis=1, kind="stable")[:, :k]
    out = np.zeros_like(pre)
    np.put_along_axis(out, order, np.maximum(np.take_along_axis(np.nan_to_num(pre, nan=0.0), order, 1), 0), 1)
    return out


def decode(w: dict, latents: np.ndarray, mu: np.ndarray, std: np.ndarray, k: int) -> np.ndarray:
    return (keep_top(latents, k) @ w["w_dec"] + w["b_pre"]) * std + mu


def _batches(df: DataFrame, keys: list[str], vec: str, schema: str, work) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield work(b[keys], np.stack(b[vec].to_numpy()).astype(np.float64))

    own = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.where(F.col(vec).isNotNull()).select(*keys, vec).mapInPandas(run, f"{own}, {schema}")


def encode(df: DataFrame, keys: list[str], vec: str, w: dict, k: int) -> DataFrame:
    """(keys, feature, value): the latents that fire."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def work(key: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        z = keep_top(pre_activations(shared.value, x), k)
        row, col = np.nonzero(z)
        return key.iloc[row].reset_index(drop=True).assign(feature=col.astype(np.int32), value=z[row, col])

    return _batches(df, keys, vec, "feature int, value double", work)


def reconstruct(df: DataFrame, keys: list[str], vec: str, w: dict, k: int, ablate: dict[int, float] | None = None, scale: bool = False) -> DataFrame:
    """(keys, vec, mse): decoded vectors and their mean squared error against the input. ablate sets (or scales) latents after the first selection; the decoder's own selection then applies, so an added latent may evict the least."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def work(key: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        w = shared.value
        _, mu, std = layer_norm(x)
        z = keep_top(pre_activations(w, x), k)
        for f, v in (ablate or {}).items():
            z[:, f] = z[:, f] * v if scale else v
        y = decode(w, z, mu, std, k)
        return key.reset_index(drop=True).assign(vec=list(y), mse=((y - x) ** 2).mean(1))

    return _batches(df, keys, vec, "vec array<double>, mse double", work)


def normed(vec: Column) -> Column:
    """The layer norm as column expressions, for one vector of doubles."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    scale = lambda y: F.sqrt(total(F.transform(y, lambda x: x * x)) / (F.size(y) - 1)) + 1e-5
    centred = let(total(vec) / F.size(vec), lambda mu: F.transform(vec, lambda x: x - mu))
    return let(centred, lambda y: let(scale(y), lambda s: F.transform(y, lambda x: x / s)))


def top_k_rows(acts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k greatest values of each key among long rows, ties to the lower latent."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), "feature")
    return acts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def pre_max(df: DataFrame, vec: str, w: dict) -> DataFrame:
    """(feature, max_value): each latent's greatest pre-activation over all vectors, whatever its sign: a maximum per Arrow batch, then per latent. No rows without vectors."""
    shared = df.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = None
        for b in batches:
            if len(b):
                pre = pre_activations(shared.value, np.stack(b[vec].to_numpy()).astype(np.float64))
                own = np.where(np.isnan(pre), -np.inf, pre).max(0)
                top = own if top is None else np.maximum(top, own)
        if top is not None:
            yield pd.DataFrame({"feature": np.arange(len(top), dtype=np.int32), "max_value": top})

    return df.where(F.col(vec).isNotNull()).select(vec).mapInPandas(run, "feature int, max_value double").groupBy("feature").agg(F.max("max_value").alias("max_value"))


def normalized(w: dict, top: dict[int, float]) -> tuple[dict, list[int]]:
    """Weights with each latent's activations divided by its maximum, and the latents that count as dead (maximum null or not positive). A maximum of 0, or none, clears the latent; a negative one divides as it is."""
    n = w["b_enc"].size
    m = np.array([top.get(i) or 0.0 for i in range(n)])
    inv = np.where(m != 0, 1 / np.where(m != 0, m, 1), 0.0)
    return {"w_enc": w["w_enc"] * inv, "b_enc": w["b_enc"] * inv, "w_dec": w["w_dec"] * m[:, None], "b_pre": w["b_pre"]}, [int(i) for i in np.flatnonzero(m <= 0)]


SHAPES = {"w_enc": 2, "w_dec": 2, "b_enc": 1, "b_pre": 1}


def load_state(state: dict[str, np.ndarray], prefix: str = "") -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights from a checkpoint's arrays by name, without the prefix that a trainer puts before names; and warnings, for missing and unexpected names, which are no errors."""
    named = {k.removeprefix(prefix): np.asarray(v, np.float64) for k, v in state.items()}
    missing, extra = sorted(set(SHAPES) - set(named)), sorted(set(named) - set(SHAPES))
    return {k: v for k, v in named.items() if k in SHAPES}, [f"missing: {k}" for k in missing] + [f"unexpected: {k}" for k in extra]


def weights_table(spark: SparkSession, w: dict[str, np.ndarray]) -> DataFrame:
    """(name, i, j, w): weights as rows, j null for vectors; for Parquet and SQL."""
    rows = [(k, int(x[0]), int(x[1]) if len(x) > 1 else None, float(v)) for k, a in w.items() for x, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "name string, i int, j int, w double")


def weights_from(table: DataFrame) -> dict[str, np.ndarray]:
    """Weights from their rows: one model's, which must fit the driver as it must each worker."""
    pdf = table.toPandas()
    out = {}
    for name, own in pdf.groupby("name"):
        if SHAPES[name] == 2:
            out[name] = np.zeros((int(own["i"].max()) + 1, int(own["j"].max()) + 1))
            out[name][own["i"].astype(int), own["j"].astype(int)] = own["w"]
        else:
            out[name] = own.sort_values("i")["w"].to_numpy()
    return out


def mean_square(a: Column, b: Column) -> Column:
    """The mean squared difference of two vectors of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def aux_loss(x: Column, recons: Column, aux: Column, coefficient: float = 1 / 32) -> Column:
    """The loss of an auxiliary reconstruction of what the first one leaves; 0 where that is not a number or there is none."""
    loss = coefficient * mean_square(aux, F.zip_with(x, recons, lambda a, b: a - b))
    return F.coalesce(F.nanvl(loss, F.lit(0.0)), F.lit(0.0))


def cross_entropy(logits: Column, token: Column) -> Column:
    """-log softmax(logits)[token]; null for a null token or one outside the logits."""
    top = F.array_max(logits)
    return let(top, lambda m: F.ln(F.aggregate(logits, F.lit(0.0), lambda s, z: s + F.exp(z - m))) + m) - F.get(logits, token)


def validation(rows: DataFrame, sample: str, batch: int) -> DataFrame:
    """(n_samples, n_batches, mse, diff_ce) from token rows (sample, x, recons, logits, recons_logits, token): means over a sample's tokens, over `batch` samples in order of their ids, then over batches, so that a short last batch weighs as much as any."""
    own = rows.groupBy(sample).agg(
        F.avg(mean_square(F.col("x"), F.col("recons"))).alias("mse"),
        (F.avg(cross_entropy(F.col("recons_logits"), F.col("token"))) - F.avg(cross_entropy(F.col("logits"), F.col("token")))).alias("diff_ce"),
    )
    batches = numbered(own, sample).groupBy(F.floor(F.col("_n") / batch).alias("b")).agg(F.count("*").alias("n"), F.avg("mse").alias("mse"), F.avg("diff_ce").alias("diff_ce"))
    return batches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), F.count("*").alias("n_batches"), F.avg("mse").alias("mse"), F.avg("diff_ce").alias("diff_ce"))


def numbered(df: DataFrame, by: str, ranges: int = 128) -> DataFrame:
    """Adds _n, the row's place from 0 in order of a column: approximate quantiles, which merge, cut the rows into ranges of like size; rows are numbered inside their range, behind the counts of those before it."""
    df = df.where(F.col(by).isNotNull())
    bounds = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10_000).alias("_b"))  # one row
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("_k", F.size(F.filter("_b", lambda b: b < F.col(by)))).drop("_b")
    before = F.sum("_c").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    offset = placed.groupBy("_k").agg(F.count("*").alias("_c")).select("_k", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_k").orderBy(by)) - 1
    return placed.withColumn("_i", inside).join(offset, "_k").withColumn("_n", F.col("_i") + F.col("_o")).drop("_k", "_i", "_o")


class Registry:
    """Autoencoders by key layer-latents-k; the key may be left out if there is exactly one."""

    def __init__(self) -> None:
        self.models: dict[str, tuple[dict, int]] = {}

    def add(self, layer: int, w: dict, k: int) -> str:
        key = f"{layer}-{w['b_enc'].size}-{k}"
        self.models[key] = (w, k)
        return key

    def get(self, key: str | None = None) -> tuple[dict, int]:
        if key is None and len(self.models) == 1:
            return next(iter(self.models.values()))
        if key not in self.models:
            raise KeyError(f"no model {key}; loaded: {sorted(self.models)}")
        return self.models[key]

    def encode_all(self, df: DataFrame, keys: list[str], vec: str) -> DataFrame:
        """(sae_key, keys, feature, value) of every model."""
        out = None
        for name, (w, k) in self.models.items():
            one = encode(df, keys, vec, w, k).withColumn("sae_key", F.lit(name))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise KeyError("no model loaded")
        return out
