"""Against dense brute force on random sparse matrices."""

import math
import random

import numpy as np
import pytest

from actlens.operators import concepts as C
from actlens.operators import profile as L
from actlens.plans import association

THR = [0.0, 0.5, -1.0]


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    n_tok = [r.randint(1, 8) for _ in range(40)]
    dense = {s: np.array([[r.choice([0, 0, 0, 0.5, r.random() * 2]) if f != 3 else 0.0 for f in range(6)] for _ in range(n)]) for s, n in enumerate(n_tok)}
    labels = {}
    for s, n in enumerate(n_tok[:34]):
        for c in range(5):
            if r.random() < 0.4:
                labels[s, c] = [sorted(r.sample(range(n), r.randint(1, min(3, n)))) for _ in range(r.randint(1, 2))]
    acts = spark.createDataFrame([(s, t, f, float(v)) for s, m in dense.items() for (t, f), v in np.ndenumerate(m) if v > 0], "sample_idx long, token_idx int, feature int, value double")
    samples = spark.createDataFrame([(s, "C", n) for s, n in enumerate(n_tok)], "sample_idx long, smiles string, n_tokens int")
    lab = spark.createDataFrame([(s, c, i, t) for (s, c), ms in labels.items() for i, m in enumerate(ms) for t in m], "sample_idx long, concept_idx int, match_idx int, token_idx int")
    return dense, labels, acts, samples, lab


def _cells(dense, labels, pairs, universe, fires):
    out = {}
    for c, f in pairs:
        for thr in THR:
            tp = fn = fp = tn = sub = 0
            for s in universe(c):
                x = dense[s][:, f]
                if fires and not (x > 0).any():
                    continue
                pred = (x > thr) & (x > 0)
                truth = np.zeros(len(x), bool)
                truth[[t for m in labels.get((s, c), []) for t in m]] = True
                tp, fn, fp, tn = tp + (pred & truth).sum(), fn + (~pred & truth).sum(), fp + (pred & ~truth).sum(), tn + (~pred & ~truth).sum()
            for s in dense:
                x = dense[s][:, f]
                sub += sum(all(x[t] > thr and x[t] > 0 for t in m) for m in labels.get((s, c), []))
            out[c, f, thr] = (int(tp), int(fn), int(fp), int(tn), int(sub), sum(len(ms) for (_, k), ms in labels.items() if k == c))
    return out


def _got(df):
    return {(r.concept_idx, r.feature, r.threshold): (r.tp, r.fn, r.fp, r.tn, r.tp_sub, r.n_sub) for r in df.collect()}


def test_all_latents(world):
    dense, labels, acts, samples, lab = world
    has = lambda c: [s for s in dense if (s, c) in labels]
    pairs = [(c, f) for c in range(5) for f in range(6) if any((dense[s][:, f] > 0).any() for s in has(c))]
    assert _got(C.confusion(acts, samples, lab, THR, substructure=True)) == _cells(dense, labels, pairs, has, True)


def test_given_pairs(spark, world):
    dense, labels, acts, samples, lab = world
    pairs = [(0, 0), (0, 3), (2, 1), (2, 2)]
    fpc = spark.createDataFrame(pairs, "concept_idx int, feature int")
    universe = [s for s in dense if (s, 0) in labels or (s, 2) in labels]
    assert _got(C.confusion(acts, samples, lab, THR, fpc, True)) == _cells(dense, labels, pairs, lambda c: universe, False)


@pytest.mark.parametrize("pooled", [False, True])
def test_mean_difference(world, pooled):
    dense, labels, acts, samples, lab = world
    got = {(r.concept_idx, r.feature): r.smd for r in C.concept_smd(acts, samples, lab, pooled).collect()}
    for c in range(5):
        for f in range(6):
            pos, pos2, neg = [], [], []
            for (s, k), ms in labels.items():
                if k != c:
                    continue
                x = dense[s][:, f]
                out = set(ms[0]) if pooled else {t for m in ms for t in m}
                neg += [x[t] for t in range(len(x)) if t not in out]
                units = ms if pooled else [[t] for t in out]
                pos += [x[u].mean() for u in units]
                pos2 += [(x[u] ** 2).mean() for u in units]
            if (c, f) not in got:
                assert not any(pos) and not any(neg)
                continue
            if not pos or not neg:
                assert math.isnan(got[c, f])
                continue
            var = (np.mean(pos2) - np.mean(pos) ** 2 + np.var(neg)) / 2
            assert got[c, f] == pytest.approx((np.mean(pos) - np.mean(neg)) / (math.sqrt(max(var, 0)) + 1e-6), abs=1e-6)


def test_scores_and_association(spark, world):
    dense, labels, acts, samples, lab = world
    names = spark.createDataFrame([(c, f"c{c}", None) for c in range(5)], "concept_idx int, concept string, description string")
    out = association.associate(acts, samples, lab, names, [0.0], 2).collect()
    assert out and all(r.f1Score > 0 and r.concept == f"c{r.conceptIdx}" for r in out)
    for r in out:
        assert r.precision == pytest.approx(r.tPos / (r.tPos + r.fPos + 1e-7), abs=1e-4) and r.recall == pytest.approx(r.tPos / (r.tPos + r.fNeg + 1e-7), abs=1e-4)
    with pytest.raises(Exception, match="no concept of index"):
        association.associate(acts, samples, lab, names.where("concept_idx < 0"), [0.0], 2).collect()
    empty = C.confusion(acts, samples, lab.limit(0), THR)
    assert C.scores(empty).count() == 0 and "f1Score" in C.scores(empty).columns


def test_top_features_ties_and_nan(spark):
    df = spark.createDataFrame([(0, f, s) for f, s in ((5, 1.0), (2, 1.0), (9, float("nan")), (1, 0.5), (7, -1.0))], "concept_idx int, feature int, score double")
    assert [tuple(r) for r in C.top_features(df, 2).orderBy("key").collect()] == [(0, 2, 0), (0, 5, 1)]
    assert [r.feature for r in C.top_features(df, 9).orderBy("key").collect()] == [1, 2, 5]


def test_profiles(spark, world):
    dense, _, acts, samples, _ = world
    feats = spark.range(7).selectExpr("cast(id as int) as feature")
    got = {r.feature: r for r in L.density(acts, samples, feats).collect()}
    for f in range(6):
        d = [(m[:, f] > 0).mean() for m in dense.values() if (m[:, f] > 0).any()]
        if not d:
            assert got[f].n is None
            continue
        assert got[f].n == len(d) and got[f].median == pytest.approx(np.median(d)) and got[f].std == pytest.approx(np.std(d))
    assert sorted(r.feature for r in L.dead(acts, feats).collect()) == [3, 6]
    bins = {(r.sample_idx, r.feature): r.bins for r in L.bin_map(acts, [(0.0, 0.5), (0.5, 1.0)]).collect()}
    for s, m in dense.items():
        for f in range(6):
            x = m[:, f][m[:, f] > 0]
            assert bins.get((s, f), 0) == (1 * ((x >= 0) & (x < 0.5)).any() | 2 * ((x >= 0.5) & (x < 1)).any())
    rho = {r.feature: r.corr_mean for r in L.positional(acts, samples).collect()}
    for f in range(6):
        zs = []
        for m in dense.values():
            v = m[:, f][m[:, f] > 0]
            if len(v) >= 3:
                rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
                p = 1 - 6 * ((np.arange(1, len(v) + 1) - rank) ** 2).sum() / (len(v) * (len(v) ** 2 - 1))
                zs.append(np.arctanh(np.clip(p, -0.99999, 0.99999)))
        assert (f in rho) == bool(zs) and (not zs or rho[f] == pytest.approx(np.tanh(np.mean(zs))))


def test_a_large_vocabulary_is_no_silent_explosion(spark, world):
    _, _, acts, _, _ = world
    tokens = spark.createDataFrame([(0, 0, "C"), (0, 1, "N")], "sample_idx long, token_idx int, token string")
    assert L.token_preference_inverse(acts, tokens, 2).count() >= 0
    with pytest.raises(ValueError, match="distinct tokens"):
        L.token_preference_inverse(acts, tokens, 1)


def test_exact_sample_and_packed_labels(spark, world):
    _, labels, _, _, lab = world
    n = len({s for s, _ in labels})
    for f in (0.0, 0.2, 0.5, 1.0):
        got = {r.sample_idx for r in C.sampled(lab, f, seed=7, bits=2).collect()}
        assert len(got) == int(f * n) and got == {r.sample_idx for r in C.sampled(lab.repartition(5), f, seed=7).collect()}
    own = {r.sample_idx: [(c.concept_idx, c.matches) for c in r.concepts] for r in C.packed(lab).collect()}
    want: dict = {}
    for (s, c), ms in sorted(labels.items()):
        want.setdefault(s, []).append((c, ms))
    assert own == want
    r = C.counts(lab).first()
    assert (r.samples, r.concepts, r.matches) == (n, 5, sum(map(len, labels.values()))) and tuple(C.counts(lab.limit(0)).first()) == (0, 0, 0)
    dense = spark.createDataFrame([(1, [1.0, -2.0]), (1, [3.0, 0.0]), (2, [5.0, 5.0]), (2, None)], "s long, v array<double>")
    assert sorted(map(tuple, L.pooled_vectors(dense, "s", "v").collect())) == [(1, 0, 2.0, 3.0), (1, 1, -1.0, 0.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]


def test_empty_tables(spark, world):
    _, _, acts, samples, lab = world
    none = acts.limit(0)
    feats = spark.range(2).selectExpr("cast(id as int) as feature")
    tokens = spark.createDataFrame([], "sample_idx long, token_idx int, token string")
    assert [r.n for r in L.density(none, samples, feats).collect()] == [None, None]
    for df in (L.token_preference(none, tokens), L.token_preference_inverse(none, tokens), L.preference_summary(none, tokens), L.positional(none, samples), L.histogram(none, tokens, 1.0, 3), C.concept_smd(none, samples, lab), C.confusion(none, samples, lab, THR)):
        assert df.count() == 0
