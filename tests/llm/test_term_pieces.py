"""Terms that share a prefix longer than any that routes are merged in several tasks."""

import pickle

from actlens.llm import term_counts as T

SCHEMA = "run_id long, feature int, token array<string>, token_Count array<long>, token_Global_Ratio array<double>, written_at timestamp"


def test_a_shared_long_prefix_is_cut_into_pieces(spark):
    prefix = "x" * (T.DEPTH + 50)
    blob = pickle.dumps({prefix + str(i): [1, 1, None, None] for i in range(1000)})
    routed = spark.createDataFrame([("x", blob, 1000)] * 2 + [("y", pickle.dumps({"y": [1, 1, None, None]}), 1)], "route string, subtrie binary, terms long")
    held: dict = {}
    for r in T._pieces(routed, 100).collect():
        held.setdefault((r.route, r.piece), []).append(set(pickle.loads(r.subtrie)))
    assert len(held) == 21 and all(sum(map(len, boxes)) <= 200 for boxes in held.values())
    inner = [set.union(*boxes) for (route, _), boxes in held.items() if route == "x"]
    assert sum(map(len, inner)) == len(set.union(*inner)) == 1000


def test_counts_stay_whole(spark):
    terms = ["y" * 300 + str(i % 700) for i in range(900)] + ["y" * 300, "z"]
    rows = [(1, f, terms, [1] * len(terms), None, None) for f in range(3)]
    got = {r.token: (r.total, r.records) for r in T.term_counts(spark.createDataFrame(rows, SCHEMA), piece=100).collect()}
    assert got == {t: (3 * terms.count(t), 3) for t in terms}
