import random

from actlens.llm import top_n as T

SCHEMA = "conceptIdx int, featureIdx int, f1Score double, score string"


def _brute(rows, n):
    best = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and 0 < s <= 1:
            best[g, i] = max(best.get((g, i), 0), s)
    out = set()
    for g in {g for g, _ in best}:
        own = sorted(((-s, i) for (x, i), s in best.items() if x == g))[:n]
        out |= {(g, i, -s, k + 1) for k, (s, i) in enumerate(own)}
    return out


def test_hot_and_cold(spark):
    r = random.Random(2)
    nan = float("nan")
    rows = [(r.choice([0, 0, 0, 1, 2, None]), r.choice([None, *range(400)]), r.choice([None, nan, -1.0, 0.0, 1.0, 1.5, 0.5, 0.5, r.random(), 1e-300]), "x") for _ in range(4000)] + [(9, 1, 0.3, "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for heavy in (1, 200, 10**9):
        for n in (1, 10, 1000):
            got = [tuple(x) for x in T.top_n(df, "conceptIdx", "featureIdx", "f1Score", n, heavy).collect()]
            assert len(got) == len(set(got)) and set(got) == _brute(rows, n)


def test_empty(spark):
    assert T.top_n(spark.createDataFrame([], SCHEMA), "conceptIdx", "featureIdx", "f1Score", 3).count() == 0
