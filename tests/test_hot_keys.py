import math
import random

from pyspark.sql import functions as F

from actlens.operators import hot_keys as H

SCHEMA = "smiles long, concept string, token_idxs array<array<int>>, extra int"


def _rank(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


def test_quantiles_by_refinement(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.6 else r.choice("abc"), r.choice([r.randint(-5, 5), r.randint(-(10**12), 10**15), 7])) for _ in range(3000)] + [(None, 1), ("n", None), ("one", -(2**62))]
    df = spark.createDataFrame(rows, "k string, v long")
    for limit in (H.STATE_LIMIT, 0):
        old, H.STATE_LIMIT = H.STATE_LIMIT, limit
        try:
            got = {(x.k, x.prob): x.value for x in H.exact_quantiles(df, "k", "v", [0.0, 0.3, 0.5, 1.0], bits=7).collect()}
        finally:
            H.STATE_LIMIT = old
        keys = {k for k, v in rows if k and v is not None}
        assert got == {(k, p): _rank([v for x, v in rows if x == k and v is not None], p) for k in keys for p in (0.0, 0.3, 0.5, 1.0)}


def test_concepts(spark):
    rows = [
        (1, " Hot\t", [[1, 2], [2]], 0), (1, "hot", [[1, 2], [2]], 0), (2, "HOT", None, 0), (3, "hot", [], 0), (None, "hot", [[9]], 0),
        (4, "wide", [list(range(200)), None, [None, 3]], 0), (5, None, [[1] * 500], 0), (6, "  ", [[1]], 0), *[(7, f"c{i}", [], 0) for i in range(60)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.concept for r in H.heavy_keys(df).collect()} == {"hot", "wide"}
    got = {r.concept: (r.rows, r.matches, r.positions, r.width_p50) for r in H.concept_stats(df).collect()}
    assert got["hot"] == (5, 5, 2, 1) and got["wide"] == (1, 2, 200, 201) and got["c3"] == (1, 0, 0, 0)


def test_quantiles_of_given_tables_take_rounds(spark):
    """The registered queries refine: more than one round for widths, samples and tokens."""
    rows = H.concept_rows(spark.read.parquet("/root/testdata/sf0.001/eval_data.parquet"))
    widths, samples = (rows.agg(F.min(c), F.max(c)).first() for c in ("width", "sample_idx"))
    assert len(H.shifts(*widths)) >= 2 and len(H.shifts(*samples)) >= 2 and H.shifts(-70, 300, 4) == [5, 1, 0] and H.shifts(0, 3) == [0]
    got = {r.concept: r for r in H.wide_quantiles(rows, "concept", "sample_idx", [0.5], "s").collect()}
    for c, ids in rows.where("sample_idx is not null").groupBy("concept").agg(F.collect_list("sample_idx")).collect():
        assert got[c].s_p50 == _rank(ids, 0.5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.heavy_keys(df).count() == 0 and H.concept_stats(df).count() == 0 and H.concept_quantiles(df).count() == 0
