"""Linear probes over many cells (tasks, feature sets, replicates) at once, and their metrics.

A ridge or logistic fit needs only sums over rows: each cell's Gram matrix, built per Arrow batch and added per cell and
fold, so a cell that holds most rows is no burden for one worker. One pass gives the whole ridge grid with its cross
validation, since the error on a fold is a form of the fold's Gram matrix. The logistic grid takes Newton steps, a pass
each, for all cells, penalties and folds together. Solving is done in tasks, a cell each.

Rows with a null task, label or feature, or a label that is not finite, are left out. Cells with fewer than two training
rows have no model. Feature vectors of a cell have one length, of some hundreds at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import broadcast_if, fraction, norm, settle

#: Cells of a logistic fit whose coefficients are held by the driver at a time; fitted cells up to which they are broadcast to rows; bytes of partial sums that a task holds.
CELLS, BROADCAST_CELLS, HELD = 2_000, 20_000, 1 << 26
#: Penalties of the grids.
GRID = [1e-4, 1e-2, 1.0, 1e2, 1e4]


def probe_rows(dataset: DataFrame, features: DataFrame, strict: bool = False) -> DataFrame:
    """(task, task_type, split, y, x): labelled records with the features of parsable molecules; train is everything but test. strict: an error if a task has labels of both types."""
    x = features.where("isSmilesRDKitParsable = 1 and canon_index is not null").select("canon_index", F.transform("pcds", lambda v: v.cast("double")).alias("x"))
    return labelled(dataset, strict).join(x, "canon_index").drop("canon_index").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def labelled(dataset: DataFrame, strict: bool = False) -> DataFrame:
    """(canon_index, task, task_type, split, y) of the records with a task, a split and a finite label."""
    rows = dataset.select("canon_index", norm(F.col("task")).alias("task"), F.trim("task_type").alias("task_type"), norm(F.col("split")).alias("split"), "y")
    finite = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))
    rows = rows.where(finite & F.col("task").isNotNull() & F.col("split").isNotNull())
    if strict:
        mixed = rows.groupBy("task").agg(F.count_distinct("task_type").alias("kinds")).withColumn("kinds", F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("labels of both types: "), "task"))).otherwise(F.col("kinds")))
        rows = rows.join(mixed.where("kinds = 1"), "task", "left_semi")
    return rows


def split_rows(df: DataFrame, key: str, train: float, seed: int = 0) -> DataFrame:
    """Adds part: train with the given share, the rest half valid and half test, by a digest of key and seed."""
    u = fraction(F.col(key), F.lit(seed))
    return df.withColumn("part", F.when(u < train, "train").when(u < train + (1 - train) / 2, "valid").otherwise("test"))


def method_label(path: Column) -> tuple[Column, Column]:
    """(method, layer) of a feature set's path: Model/Pooling/Layer is the method `Model (Pooling)` of a layer; anything else is a method without layer."""
    part = F.split(path, "/")
    full = F.size(part) == 3
    return F.when(full, F.concat(F.get(part, F.lit(0)), F.lit(" ("), F.get(part, F.lit(1)), F.lit(")"))).otherwise(path), F.when(full, F.get(part, F.lit(2)).try_cast("int"))


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _sums(rows: DataFrame, keys: list[str], work: Callable) -> DataFrame:
    """(keys, part): per cell the sum of the arrays that work(x, y, cell) gives for the cell's rows of a batch."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = lambda: pd.DataFrame([(*c, pickle.dumps(v)) for c, v in total.items()], columns=[*keys, "part"])
        total: dict = {}
        for b in batches:
            for cell, own in b.groupby(keys, dropna=False):
                cell = tuple(None if pd.isna(k) else k for k in cell)
                v = work(np.stack(own["x"].to_numpy()), own["y"].to_numpy(np.float64), cell)
                total[cell] = total[cell] + v if cell in total else v
            if sum(v.nbytes for v in total.values()) > HELD:
                yield out()
                total = {}
        yield out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[keys].iloc[:1].assign(part=[pickle.dumps(sum(map(pickle.loads, pdf["part"])))])

    schema = f"{_kinds(rows, keys)}, part binary"
    return rows.select(*keys, "x", "y").mapInPandas(part, schema).groupBy(*keys).applyInPandas(add, schema)


def _gram(x: np.ndarray, y: np.ndarray, _) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x, y])
    return a.T @ a


def _scaling(gram: np.ndarray, standardize: bool) -> tuple[np.ndarray, np.ndarray]:
    n, d = gram[0, 0], gram.shape[0] - 2
    mu = gram[0, 1 : d + 1] / n
    sd = np.sqrt(np.maximum(np.diag(gram)[1 : d + 1] / n - mu * mu, 0))
    return mu, np.where(sd > 0, sd, 1) if standardize else np.ones(d)


def _asked(standardize, cell: tuple) -> bool:
    return standardize(cell) if callable(standardize) else standardize


def _solve(g: np.ndarray, alpha: float, standardize: bool) -> np.ndarray:
    """Coefficients, intercept first, of the ridge fit whose Gram matrix is g."""
    n, d = g[0, 0], g.shape[0] - 2
    mu, sd = _scaling(g, standardize)
    xx = (g[1 : d + 1, 1 : d + 1] - n * np.outer(mu, mu)) / np.outer(sd, sd)
    xy = (g[1 : d + 1, d + 1] - mu * g[0, d + 1]) / sd
    w = np.linalg.solve(xx + alpha * np.eye(d), xy) / sd
    return np.r_[g[0, d + 1] / n - w @ mu, w]


def _rmse(g: np.ndarray, w: np.ndarray) -> float:
    """The error of coefficients w on the rows behind g."""
    v = np.r_[w, -1.0]
    return float(np.sqrt(max(v @ g @ v, 0.0) / g[0, 0]))


def ridge(rows: DataFrame, keys: list[str], alphas: list[float] = (1.0,), standardize: bool | Callable[[tuple], bool] = True) -> DataFrame:
    """(keys, hp, score, w): per cell the penalty with the least mean error over the folds (ties to the smaller), and the coefficients, intercept first, fitted with it on all rows of the cell.

    rows hold keys, x, y and, for a choice of penalties, fold. Penalties apply to standardized features if asked, for all cells or by cell. Folds without rows, or that leave fewer than two, take no part.
    """
    fold = "fold" if len(alphas) > 1 else "_f"
    grams = _sums(rows.withColumn("_f", F.lit(0)), [*keys, fold], _gram)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(p) for p in pdf["part"]]
        whole, scaled = sum(parts), _asked(standardize, tuple(pdf[keys].iloc[0]))
        out = pdf[keys].iloc[:1]
        if whole[0, 0] < 2:
            return out.iloc[:0].assign(hp=0.0, score=0.0, w=None)
        errors = [[_rmse(p, _solve(whole - p, a, scaled)) for p in parts if whole[0, 0] - p[0, 0] >= 2] for a in alphas] if len(alphas) > 1 else []
        means = [np.mean(e) if e else np.inf for e in errors]
        best = int(np.argmin(means)) if means else 0
        return out.assign(hp=float(alphas[best]), score=-float(means[best]) if means else np.nan, w=[_solve(whole, alphas[best], scaled)])

    return grams.groupBy(*keys).applyInPandas(fit, f"{_kinds(rows, keys)}, hp double, score double, w array<double>")


def logistic(rows: DataFrame, keys: list[str], cs: list[float] = (1.0,), folds: int = 5, standardize: bool | Callable[[tuple], bool] = True, steps: int = 8) -> DataFrame:
    """(keys, hp, score, w): per cell the inverse penalty with the greatest mean area under the curve over the folds (ties to the smaller), and the coefficients, intercept first, fitted with it on all rows; penalty |w|^2 / 2c, by Newton steps."""
    rows = settle(rows.withColumn("fold", F.lit(0)) if len(cs) == 1 else rows)
    grams = settle(_sums(rows, keys, _gram))
    cells = grams.count()
    blocks = max(1, -(-cells // CELLS))
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
    out = [_logistic_block(rows.where(block == i), grams.where(block == i), keys, list(cs), folds if len(cs) > 1 else 0, standardize, steps) for i in range(blocks)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _logistic_block(rows: DataFrame, grams: DataFrame, keys: list[str], cs: list[float], folds: int, standardize, steps: int) -> DataFrame:
    """The fits of at most CELLS cells (roughly, by hash). Of the models of a cell, one per penalty and fold left out, those with fold -1 are fitted on all rows."""
    sc = rows.sparkSession.sparkContext
    models = [(c, f) for c in cs for f in [-1, *range(folds)]]
    cell_of = lambda pdf: tuple(None if pd.isna(k) else k for k in pdf[keys].iloc[0])

    scale = {}
    for r in grams.collect():
        g = pickle.loads(r.part)
        if g[0, 0] >= 2:
            cell = tuple(r[k] for k in keys)
            scale[cell] = _scaling(g, _asked(standardize, cell))
    beta = {cell: np.zeros((len(models), len(mu) + 1)) for cell, (mu, _) in scale.items()}
    plain = rows.withColumn("x", F.concat("x", F.array(F.col("fold").cast("double"))))  # the fold rides along
    def step(shared):
        def work(x: np.ndarray, y: np.ndarray, cell: tuple) -> np.ndarray:
            scale, beta = shared.value
            if cell not in beta:
                return np.zeros(1)
            mu, sd = scale[cell]
            fold, a = x[:, -1], np.column_stack([np.ones(len(x)), (x[:, :-1] - mu) / sd])
            out = []
            for b, (_, f) in zip(beta[cell], models):
                p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
                own = fold != f
                out.append(np.column_stack([(a * (p * (1 - p) * own)[:, None]).T @ a, a.T @ ((y - p) * own)]))
            return np.stack(out)

        def newton(pdf: pd.DataFrame) -> pd.DataFrame:
            cell, beta = cell_of(pdf), shared.value[1]
            if cell not in beta:
                return pdf[keys].iloc[:0].assign(part=b"")
            new = []
            for h, b, (c, _) in zip(pickle.loads(pdf["part"].iloc[0]), beta[cell], models):
                penalty = np.r_[0, np.full(len(b) - 1, 1 / c)]
                new.append(b + np.linalg.solve(h[:, :-1] + np.diag(penalty + 1e-9), h[:, -1] - penalty * b))
            return pdf[keys].iloc[:1].assign(part=[pickle.dumps(np.stack(new))])

        return _sums(plain, keys, work).groupBy(*keys).applyInPandas(newton, f"{_kinds(rows, keys)}, part binary")

    for _ in range(steps):
        beta = {tuple(r[k] for k in keys): pickle.loads(r.part) for r in step(sc.broadcast((scale, beta))).collect()}

    raw = {cell: [np.r_[b[0] - (b[1:] / scale[cell][1]) @ scale[cell][0], b[1:] / scale[cell][1]] for b in bs] for cell, bs in beta.items()}
    table = [(*cell, float(c), int(f), [float(v) for v in w]) for cell, ws in raw.items() for w, (c, f) in zip(ws, models)]
    fitted = rows.sparkSession.createDataFrame(table, f"{_kinds(rows, keys)}, hp double, fold int, w array<double>")
    if not folds:
        return fitted.select(*keys, "hp", F.lit(float("nan")).alias("score"), "w")
    scored = predict(rows, fitted.where("fold >= 0"), [*keys, "fold"])
    auc = classification_metrics(scored, [*keys, "fold", "hp"]).groupBy(*keys, "hp").agg(F.avg("roc_auc").alias("score"))
    first = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "hp")
    best = auc.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return _join(fitted.where("fold = -1").drop("fold"), best, [*keys, "hp"]).select(*keys, "hp", "score", "w")


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join in which null keys are keys; the columns of a, then the others of b."""
    a, b = a.alias("a"), b.alias("b")
    rest = [c for c in b.columns if c not in keys]
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select("a.*", *(f"b.{c}" for c in rest))


def predict(rows: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds score, the linear form of the row's cell, and what else the fit says; rows of cells without a model are left out. The fits are broadcast up to BROADCAST_CELLS counted ones."""
    fitted = settle(fitted)
    score = F.get("w", F.lit(0)) + F.aggregate(F.zip_with("x", F.slice("w", 2, F.size("x")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return _join(rows, broadcast_if(fitted, fitted.count(), BROADCAST_CELLS), keys).withColumn("score", score).drop("w")


def classification_metrics(scored: DataFrame, keys: list[str] = ("task",)) -> DataFrame:
    """(keys, n, accuracy, mcc, roc_auc) of scores above 0 against labels 0 and 1; the area by mean ranks, null with one class only."""
    p, y = (F.col("score") > 0).cast("double"), F.col("y")
    ranked = mean_ranks(scored, list(keys), "score", "_r")
    tp, pp, pos, n = F.sum(p * y), F.sum(p), F.sum(y), F.count("*").cast("double")
    mcc = F.coalesce(F.try_divide(n * tp - pp * pos, F.sqrt(pp * (n - pp) * pos * (n - pos))), F.lit(0.0))
    auc = F.try_divide(F.sum(F.col("_r") * y) - pos * (pos + 1) / 2, pos * (n - pos))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((p == y).cast("double")).alias("accuracy"), mcc.alias("mcc"), auc.alias("roc_auc"))


def regression_metrics(scored: DataFrame, keys: list[str] = ("task",)) -> DataFrame:
    """(keys, n, rmse, spearman)."""
    ranked = mean_ranks(mean_ranks(scored, list(keys), "score", "_a"), list(keys), "y", "_r")
    e = F.col("score") - F.col("y")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("_a", "_r").alias("spearman"))


def mean_ranks(df: DataFrame, groups: list[str], value: str, to: str, buckets: int = 64) -> DataFrame:
    """Adds the mean rank of ties within the group. Values are counted first; approximate quantiles, which merge, cut a group into buckets, so that running counts stay inside one bucket and no task gets a whole group."""
    key = F.struct(*groups).alias("_g")
    counts = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    bounds = counts.groupBy("_g").agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_b"))
    placed = counts.join(bounds, "_g").withColumn("_k", F.size(F.filter("_b", lambda b: b < F.col(value)))).drop("_b")
    upto = Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("_g", "_k").agg(F.sum("_c").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(upto), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_g", "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("_o") + F.sum("_c").over(inside) - (F.col("_c") - 1) / 2.0
    ranks = placed.join(offset, ["_g", "_k"]).select("_g", value, rank.alias(to))
    return df.withColumn("_g", key).join(ranks, ["_g", value]).drop("_g")


def replicate_scores(lists: DataFrame, keys: list[str], rep: str, values: str) -> DataFrame:
    """(keys, idx, mean, std, rank): each list as z-scores (ddof 1), then mean and deviation (ddof 0) over replicates, ranked by mean descending, ties to the lower index."""
    rows = lists.select(*keys, rep, F.posexplode(values).alias("idx", "v"))
    own = Window.partitionBy(*keys, rep)
    z = F.try_divide(F.col("v") - F.avg("v").over(own), F.stddev_samp("v").over(own))
    stats = rows.withColumn("z", z).groupBy(*keys, "idx").agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"))
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), "idx")))


def sweep_rows(labels: DataFrame, features: DataFrame, replicates: int = 3, train: float = 0.8, folds: int = 5) -> DataFrame:
    """(task, task_type, method, layer, rep, part, fold, y, x): every labelled record with every feature set that covers it, in every replicate. features(canon_index, path, x); a replicate splits the molecules anew, and its training part into folds, by digests."""
    method, layer = method_label(F.col("path"))
    sets = features.select("canon_index", method.alias("method"), layer.alias("layer"), "x")
    rows = labels.select("canon_index", "task", "task_type", "y", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    test = fraction(F.col("canon_index"), "rep") >= train
    fold = F.floor(F.lit(folds) * fraction(F.col("canon_index"), F.lit("fold"), "rep")).cast("int")
    rows = rows.withColumn("part", F.when(test, "test").otherwise("train")).withColumn("fold", fold)
    return rows.join(sets, "canon_index").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).drop("canon_index")


def sweep(rows: DataFrame, grid: list[float] = GRID, standardized: tuple[str, ...] = ("PcDs",), steps: int = 6) -> tuple[DataFrame, DataFrame]:
    """(results, fits): per cell (task, method, layer, rep) the chosen penalty with the test metrics of its task's type, and the coefficients. Features of the `standardized` methods are scaled by their training rows."""
    keys = ["task", "method", "layer", "rep"]
    rows = settle(rows)
    fits, results = [], []
    for kind in ("cls", "reg"):
        own = rows.where(F.col("task_type") == kind)
        train = own.where("part = 'train'").select(*keys, "fold", "x", "y")
        scaled = lambda cell: cell[1] in standardized
        fit = settle(logistic(train, keys, grid, standardize=scaled, steps=steps) if kind == "cls" else ridge(train, keys, grid, standardize=scaled))
        scored = predict(own.where("part = 'test'").select(*keys, "x", "y"), fit, keys)
        metrics = classification_metrics(scored, keys) if kind == "cls" else regression_metrics(scored, keys)
        for c in {"accuracy", "mcc", "roc_auc", "rmse", "spearman"} - set(metrics.columns):
            metrics = metrics.withColumn(c, F.lit(None).cast("double"))
        results.append(_join(fit.select(*keys, "hp"), metrics, keys))
        fits.append(fit)
    return results[0].unionByName(results[1]), fits[0].unionByName(fits[1])
