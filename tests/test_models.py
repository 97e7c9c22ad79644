from pathlib import Path

import numpy as np
import pytest

from actlens.common import clear, settle, shared_dir
from actlens.operators import probe as P
from actlens.operators import sae
from actlens.sources import files
from actlens.streaming import incremental


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(1).normal(size=(30, 16))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_encode_decode_ablate(vectors):
    x, df = vectors
    w = sae.sine_weights(16, 24)
    z = sae.keep_top(sae.pre_activations(w, x), 4)
    got = np.zeros_like(z)
    for r in sae.encode(df, ["id"], "vec", w, 4).collect():
        got[r.id, r.feature] = r.value
    assert np.allclose(got, z) and ((z > 0).sum(1) <= 4).all()
    _, mu, std = sae.layer_norm(x)
    assert np.allclose([r.vec for r in sae.reconstruct(df, ["id"], "vec", w, 4).orderBy("id").collect()], sae.decode(w, z, mu, std, 4))
    f = int(np.flatnonzero((z == 0).all(0))[0]) if (z == 0).all(0).any() else 0
    for value in (0.0, -3.0, 50.0):
        y = z.copy()
        y[:, f] = value
        out = np.array([r.vec for r in sae.reconstruct(df, ["id"], "vec", w, 4, {f: value}).orderBy("id").collect()])
        assert np.allclose(out, sae.decode(w, y, mu, std, 4))
    assert np.allclose([r.v for r in df.select(sae.normed(df["vec"]).alias("v"), "id").orderBy("id").collect()], sae.layer_norm(x)[0])


def test_normalized_and_registry(vectors):
    _, df = vectors
    w, dead = sae.normalized(sae.sine_weights(16, 4), {0: 2.0, 1: 0.0, 2: -1.0})
    plain = sae.sine_weights(16, 4)
    assert dead == [1, 2, 3] and not w["w_enc"][:, [1, 3]].any()
    assert np.allclose(w["w_enc"][:, 2], -plain["w_enc"][:, 2]) and np.allclose(w["w_dec"][0], 2 * plain["w_dec"][0])
    x, w = vectors[0], sae.sine_weights(16, 24)
    top = {r.feature: r.max_value for r in sae.pre_max(df.repartition(3), "vec", w).collect()}
    assert np.allclose([top[i] for i in range(24)], sae.pre_activations(w, x).max(0))
    assert sae.pre_max(df.limit(0), "vec", w).count() == 0
    reg = sae.Registry()
    with pytest.raises(KeyError):
        reg.get()
    key = reg.add(3, sae.sine_weights(16, 24), 4)
    assert key == "3-24-4" and reg.get() is reg.get(key)
    reg.add(4, sae.sine_weights(16, 24), 2)
    with pytest.raises(KeyError, match="3-24-4"):
        reg.get("nope")
    assert {r.sae_key for r in reg.encode_all(df, ["id"], "vec").collect()} == {"3-24-4", "4-24-2"}


def test_probes(spark):
    r = np.random.default_rng(2)
    rows = []
    for task, n in (("a", 300), ("b", 40), ("lonely", 1)):
        x = r.normal(size=(n, 3))
        y = x @ [1.0, -2.0, 0.5] + 0.3
        rows += [(task, float(v), list(map(float, row))) for v, row in zip(y, x)]
    df = spark.createDataFrame(rows, "task string, y double, x array<double>")
    w = P.ridge(df, ["task"], [1e-9])
    own = {r.task: r.w for r in w.collect()}
    assert set(own) == {"a", "b"} and np.allclose(own["a"], [0.3, 1, -2, 0.5], atol=1e-6)
    m = {x.task: x for x in P.regression_metrics(P.predict(df, w, ["task"])).collect()}
    assert m["a"].rmse < 1e-6 and m["a"].spearman == pytest.approx(1)
    cls = df.selectExpr("task", "cast(y > 0 as double) as y", "x")
    c = {x.task: x for x in P.classification_metrics(P.predict(cls, P.logistic(cls, ["task"], [10.0]), ["task"])).collect()}
    assert c["a"].accuracy > 0.95 and c["a"].roc_auc > 0.99 and c["a"].mcc > 0.9
    parts = {x.part: x["count"] for x in P.split_rows(spark.range(2000), "id", 0.8).groupBy("part").count().collect()}
    assert abs(parts["train"] - 1600) < 80 and abs(parts["valid"] - 200) < 60


def test_cross_validated_probes(spark, monkeypatch):
    """Against fits of each fold in plain numpy; and in blocks of cells as at once."""
    r = np.random.default_rng(4)
    rows = []
    for task, layer, n in (("a", 1, 120), ("a", None, 90), ("b", 1, 100)):
        x = r.normal(size=(n, 4))
        y = x @ r.normal(size=4) + r.normal(size=n) * 2
        rows += [(task, layer, int(f), float(v), list(map(float, row))) for v, row, f in zip(y, x, r.integers(0, 5, n))]
    df = spark.createDataFrame(rows, "task string, layer int, fold int, y double, x array<double>").repartition(3)
    cell = lambda t, k: [np.array(v) for v in zip(*((f, y, x) for a, b, f, y, x in rows if (a, b) == (t, k)))]
    for got in P.ridge(df, ["task", "layer"], P.GRID, standardize=False).collect():
        fold, y, x = cell(got.task, got.layer)

        def fit(keep, alpha, x=x, y=y):
            a, mu = x[keep] - x[keep].mean(0), x[keep].mean(0)
            w = np.linalg.solve(a.T @ a + alpha * np.eye(4), a.T @ (y[keep] - y[keep].mean()))
            return np.r_[y[keep].mean() - w @ mu, w]

        def error(alpha, fold=fold, x=x, y=y, fit=fit):
            return np.mean([np.sqrt(np.mean((np.c_[np.ones((fold == f).sum()), x[fold == f]] @ fit(fold != f, alpha) - y[fold == f]) ** 2)) for f in range(5)])

        best = min(P.GRID, key=error)
        assert got.hp == best and got.score == pytest.approx(-error(best)) and np.allclose(got.w, fit(fold >= 0, best))
    cls = df.selectExpr("task", "layer", "fold", "cast(y > 0 as double) as y", "x")
    once = {(g.task, g.layer): (g.hp, g.score, tuple(g.w)) for g in P.logistic(cls, ["task", "layer"], [0.01, 1.0], steps=6).collect()}
    monkeypatch.setattr(P, "CELLS", 1)
    parts = {(g.task, g.layer): (g.hp, g.score, tuple(g.w)) for g in P.logistic(cls, ["task", "layer"], [0.01, 1.0], steps=6).collect()}
    assert set(once) == {("a", 1), ("a", None), ("b", 1)} == set(parts)
    for k in once:
        assert once[k][0] == parts[k][0] and np.allclose(once[k][2], parts[k][2]) and 0.5 < once[k][1] <= 1
    with pytest.raises(Exception, match="both types"):
        mixed = spark.createDataFrame([(1, "t", "cls", "train", 1.0), (2, "T ", "reg", "train", 0.5)], "canon_index long, task string, task_type string, split string, y double")
        P.labelled(mixed, strict=True).collect()


def test_losses(spark):
    r = np.random.default_rng(5)
    rows = [(int(i // 3) * 7, *(r.normal(size=6).tolist() for _ in range(4)), int(r.integers(0, 6))) for i in range(33)]
    df = spark.createDataFrame(rows, "sample long, x array<double>, recons array<double>, logits array<double>, recons_logits array<double>, token int")
    ce = lambda z, t: np.log(np.exp(z).sum()) - z[t]
    own: dict = {}
    for s, x, y, a, b, t in rows:
        own.setdefault(s, []).append((np.mean((np.array(x) - y) ** 2), ce(np.array(b), t) - ce(np.array(a), t)))
    means = [np.mean(own[s], axis=0) for s in sorted(own)]
    batches = [np.mean(means[i : i + 4], axis=0) for i in range(0, 11, 4)]
    got = sae.validation(df, "sample", 4).first()
    assert (got.n_samples, got.n_batches) == (11, 3) and np.allclose([got.mse, got.diff_ce], np.mean(batches, axis=0))
    assert sae.validation(df.limit(0), "sample", 4).first().n_samples == 0
    places = {x.k: x["_n"] for x in sae.numbered(spark.createDataFrame([(int(v),) for v in r.permutation(500) ** 2], "k long"), "k", 7).collect()}
    assert places == {v * v: v for v in range(500)}
    far = [*range(99), 10**17]  # one outlier must not put all others in one range
    assert {x.k: x["_n"] for x in sae.numbered(spark.createDataFrame([(v,) for v in far], "k long"), "k", 7).collect()} == {v: i for i, v in enumerate(far)}


def test_weights_as_tables(spark):
    w = sae.sine_weights(3, 5)
    back = sae.weights_from(sae.weights_table(spark, w))
    assert all(np.allclose(back[k], w[k]) for k in w)
    got, warnings = sae.load_state({"sae.w_enc": w["w_enc"], "sae.other": w["b_pre"], "b_enc": w["b_enc"]}, "sae.")
    assert set(got) == {"w_enc", "b_enc"} and warnings == ["missing: b_pre", "missing: w_dec", "unexpected: other"]


def test_method_labels(spark):
    df = spark.createDataFrame([("SAE/mean/3",), ("PcDs",), (None,)], "p string")
    method, layer = P.method_label(df["p"])
    assert [tuple(r) for r in df.select(method, layer).collect()] == [("SAE (mean)", 3), ("PcDs", None), (None, None)]


def test_mean_ranks(spark):
    r = np.random.default_rng(3)
    v = np.round(np.exp(r.normal(0, 4, 2000)), 1)
    g = r.choice(["hot", "hot", "cold"], 2000)
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)] + [("one", 1.0)], "task string, v double")
    got = P.mean_ranks(df, ["task"], "v", "rank").collect()
    assert len(got) == 2001
    for k in ("hot", "cold"):
        own = np.sort(v[g == k])
        assert all(x["rank"] == (np.searchsorted(own, x.v) + 1 + np.searchsorted(own, x.v, "right")) / 2 for x in got if x.task == k)


def test_replicates(spark):
    df = spark.createDataFrame([("k", 1, [1.0, 2.0, 6.0]), ("k", 2, [0.0, 4.0, 5.0]), ("k", 3, [2.0, 2.0, 2.0])], "k string, rep int, v array<double>")
    z = lambda v: (np.array(v) - np.mean(v)) / np.std(v, ddof=1)
    both = np.array([z([1, 2, 6]), z([0, 4, 5])])
    got = P.replicate_scores(df, ["k"], "rep", "v").orderBy("idx").collect()
    assert np.allclose([r["mean"] for r in got], both.mean(0)) and np.allclose([r["std"] for r in got], both.std(0)) and [r["rank"] for r in got] == [3, 2, 1]


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("C\nCC\nC\n")
    lines = files.sample_lines(spark, f"{tmp_path}/s.txt")
    assert sorted(map(tuple, lines.collect())) == [(0, "C"), (1, "CC"), (2, "C")]
    (tmp_path / "many").mkdir()
    texts = [f"{i}" * (i % 50) + ("\r" if i % 7 == 0 else "") for i in range(3000)]
    for k, (a, z) in enumerate(((0, 100), (100, 2500), (2500, 3000))):
        (tmp_path / "many" / f"part{k}.txt").write_bytes("".join(x + "\n" for x in texts[a:z]).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert [r.smiles for r in files.sample_lines(spark, f"{tmp_path}/many").orderBy("sample_idx").collect()] == texts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bins = spark.createDataFrame([(1, 2, 3), (0, 5, 1)], "sample_idx long, feature int, bins int")
    files.write_bins(bins, f"{tmp_path}/bins")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/bins").collect())) == [(0, 5, 1), (1, 2, 3)]
    assert sorted(map(tuple, files.distinct_lines(lines).collect())) == [("C", 2), ("CC", 1)]
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "conceptIdx int, smd double")
    files.write_tsv(df, f"{tmp_path}/t")
    assert [r.conceptIdx for r in files.read_tsv(spark, f"{tmp_path}/t", "conceptIdx int, smd double").where("isnan(smd)").collect()] == [2]
    assert not files.write_if_any(df.limit(0), f"{tmp_path}/none") and files.write_if_any(df, f"{tmp_path}/some")
    names = spark.createDataFrame([("chunk_012.h5", "3-3072-128"), (None, None), ("none", "x")], "n string, k string")
    assert [tuple(r) for r in names.select(files.chunk_number(names["n"]), files.key_parts(names["k"])).collect()] == [(12, (3, 3072, 128)), (None, (None, None, None)), (None, (None, None, None))]
    (tmp_path / "c.json").write_text('{"C": 3, "N": 1}')
    assert sorted(map(tuple, files.token_counts_json(spark, f"{tmp_path}/c.json").collect())) == [("C", 3), ("N", 1)]
    with pytest.raises(ValueError, match="no such columns"):
        files.rename(df, {"nope": "x"})
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("settled-*"))
    assert settle(df).count() == 2
    own = set(folder.glob("settled-*")) - before
    clear(spark)
    assert own and not any(p.exists() for p in own)


def test_stream(spark, tmp_path):
    acts = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "feature int, value double")
    acts.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {r.feature: r for r in incremental.combined(spark.read.parquet(f"{tmp_path}/out")).collect()}
    for f in range(3):
        v = [float(i) for i in range(30) if i % 3 == f]
        assert got[f].n == 10 and got[f]["mean"] == pytest.approx(np.mean(v)) and got[f]["std"] == pytest.approx(np.std(v)) and got[f].most == max(v)
