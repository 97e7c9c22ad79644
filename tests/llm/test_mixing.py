import math

import numpy as np
import pytest

from actlens.llm import mixing as M
from actlens.llm.encode import encoding

DOCS = "doc_id long, source string, text string, copies int"
MIX = "mix_id string, source string, target_share double, max_repeats int"


def _docs(spark):
    rows = [(i, ["Big ", "big\t", "BIG"][i % 3], "word " * (20 + i % 17), 0) for i in range(600)] + [(1000 + i, "small", f"tiny {i} " * 5, 0) for i in range(30)]
    rows += [(2000, None, "no source", 0), (2001, " ", "blank", 0), (2002, "big", None, 0), (2003, "big", "", 0), (2004, "other", "left out", 0), (1000, "small", "tiny 0 " * 5, 0)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_shares_limits_and_shortfall(spark):
    rows, df = _docs(spark)
    targets = spark.createDataFrame([("even", "big", 2.0, 3), ("even", "SMALL ", 2.0, 3), ("even", "missing", None, 3), ("few", "big", 0.9, 1), ("few", "small", 0.1, 100), ("gone", "nowhere", 1.0, 2), ("none", "big", 1.0, None)], MIX)
    size = lambda t: len(encoding()[0].encode_ordinary(t or ""))
    small = sum(size(t) for _, s, t, _ in rows if s == "small")
    big = sum(size(t) for _, s, t, _ in rows if (s or "").strip().lower() == "big")
    total = 8000
    chosen = [tuple(r) for r in M.mix(df, targets, total, fill=False)[0].collect()]
    assert all(r[4] <= {"even": 3, "few": 100}[r[0]] for r in chosen) and not [r for r in chosen if r[0] in ("gone", "none")]
    rep = {(r.mix_id, r.source): r for r in M.report(df, targets, total, fill=False).collect()}
    assert rep["even", "small"].actual_tokens == 3 * small and math.isclose(rep["even", "small"].shortfall, 4000 - 3 * small)
    assert abs(rep["even", "big"].actual_tokens - 4000) < 40 and rep["even", "big"].shortfall == 0
    assert math.isclose(rep["few", "big"].shortfall, max(0, 7200 - big)) and abs(rep["few", "small"].actual_tokens - 800) < 40
    assert rep["gone", "nowhere"].actual_tokens == 0 and rep["gone", "nowhere"].shortfall == total
    assert rep["none", "big"].most_copies == 0
    own = [r for r in chosen if r[0] == "few" and r[1] == "small"]
    assert max(r[4] for r in own) - min([r[4] for r in own] if len(own) == 31 else [0]) <= 1


def test_the_rest_is_spread_by_temperature(spark):
    """Targets where no limit binds; else the others take the rest, and no more than they may."""
    rows, df = _docs(spark)
    docs = df.union(spark.createDataFrame([(5000 + i, "mid", "middle " * 30, 0) for i in range(100)], DOCS))
    targets = spark.createDataFrame(
        [("free", "big", 0.5, 9), ("free", "mid", 0.4, 9), ("free", "small", 0.1, 9), ("tight", "big", 0.2, 9), ("tight", "mid", 0.3, 1), ("tight", "small", 0.5, 1), ("tight", "gone", 0.2, 9), ("over", "small", 1.0, 2)], MIX
    )
    total = 6000
    rep = {(r.mix_id, r.source): r for r in M.report(docs, targets, total).collect()}
    for s, share in (("big", 0.5), ("mid", 0.4), ("small", 0.1)):
        r = rep["free", s]
        assert r.weight == pytest.approx(share) and r.fill_exponent is None and r.shortfall == 0 and abs(r.actual_share - share) < 0.01
    tight = {s: rep["tight", s] for s in ("big", "mid", "small", "gone")}
    assert sum(r.weight for r in tight.values()) == pytest.approx(1) and tight["gone"].weight == 0 and tight["gone"].shortfall == pytest.approx(1000)
    small = tight["small"]
    assert small.most_copies == 1 and small.actual_tokens == small.weight * total and small.shortfall == pytest.approx(0.5 / 1.2 * total - small.actual_tokens)
    assert tight["big"].weight > 0.2 / 1.2 and tight["mid"].weight >= 0.3 / 1.2 - 1e-9 and tight["big"].fill_exponent is not None
    assert abs(sum(r.actual_tokens for r in tight.values()) - total) < 60
    assert rep["over", "small"].most_copies == 2 and rep["over", "small"].shortfall > 0
    even = M.report(docs, targets.where("mix_id = 'free'"), total, target_entropy=math.log(3)).collect()
    assert all(r.weight == pytest.approx(1 / 3, abs=1e-3) and r.entropy_exponent == pytest.approx(0, abs=1e-3) for r in even)


def test_weights():
    p, s = np.array([0.6, 0.3, 0.1]), np.array([0.2, 0.2, 0.6])
    w, t = M.weights(p, s, np.array([9.0, 9.0, 0.1]))
    assert w == pytest.approx([0.2 + 0.5 * 2 / 3, 0.2 + 0.5 / 3, 0.1]) and t == 1.0
    w, t = M.weights(p, s, np.array([0.45, 9.0, 0.1]))  # natural shares would give the first too much: cooled to the limit
    assert w == pytest.approx([0.45, 0.45, 0.1]) and 0 <= t < 1 and M.tempered(p[:2], t)[0] == pytest.approx(0.5, abs=1e-3)
    w, t = M.weights(p, s, np.array([0.3, 0.25, 0.1]))
    assert w == pytest.approx([0.3, 0.25, 0.1]) and t is None
    assert M.weights(p, s, np.array([9.0, 9.0, 0.1]), fill=False)[0] == pytest.approx([0.2, 0.2, 0.1])


def test_temperature():
    p = np.array([0.7, 0.2, 0.1])
    assert M.tempered(p, 1.0) == pytest.approx(p) and M.tempered(p, 0.0) == pytest.approx([1 / 3] * 3)
    t = M.for_entropy(p, 1.0)
    assert M.entropy(M.tempered(p, t)) == pytest.approx(1.0)
    assert M.tempered(np.array([0.5, 0.0, 0.5]), 0.3) == pytest.approx([0.5, 0, 0.5]) and len(M.tempered(np.array([]), 1.0)) == 0
    assert M.for_entropy(p, math.log(3)) == pytest.approx(0.0, abs=1e-6)


def test_empty(spark):
    _, df = _docs(spark)
    targets = spark.createDataFrame([("a", "big", 1.0, 1)], MIX)
    assert M.mix(df.limit(0), targets)[0].count() == 0 and M.report(df.limit(0), targets).count() == 1
    assert M.mix(df, targets.limit(0))[0].count() == 0 and M.report(df, targets.limit(0)).count() == 0
