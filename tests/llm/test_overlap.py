import itertools
import random
import re

from pyspark.sql import functions as F

from actlens.functions.smiles import TOKEN
from actlens.llm import overlap as O

SCHEMA = "record_id long, smiles string, canon_index long, task string, split string, source string, letters int"


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def _brute(rows):
    out = set()
    norm = lambda x: None if x is None else x.strip().lower()
    for a, b in itertools.product(rows, rows):
        if None in (a[0], b[0]) or norm(a[3]) is None or norm(a[3]) != norm(b[3]) or norm(a[4]) != "train" or norm(b[4]) not in ("test", "valid"):
            continue
        ta, tb = (re.findall(TOKEN, x[1].strip()) if x[1] else [] for x in (a, b))
        if a[2] is not None and a[2] == b[2] or ta and tb and _distance(ta, tb) <= 3:
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def _check(spark, rows, meet=O.MEET):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in O.pairs(df, meet).collect()]
    want = _brute(rows)
    assert len(got) == len(set(got))
    assert set(got) == want
    if len({r[0] for r in rows}) == len(rows):  # no record stands twice: the report counts what the pairs are
        by_id = {r[0]: r for r in rows}
        pairs: dict = {}
        for a, b in want:
            e = by_id[a] if (by_id[a][4] or "").strip().lower() != "train" else by_id[b]
            own = pairs.setdefault((e[4].strip().lower(), e[5]), {})
            own[e[0]] = own.get(e[0], 0) + 1
        assert {(r.split, r.source): (r.pairs, r.records) for r in O.report(df).collect()} == {k: (sum(v.values()), len(v)) for k, v in pairs.items()}


def test_random_edits(spark):
    r = random.Random(3)
    toks = ["C", "c", "N", "[C@H]", "[C@@H]", "Br", "%10", "1", "(", ")", "=", "[Na+]"]
    base = [[r.choice(toks) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 12, 30]))] for _ in range(12)]
    rows = []
    for i in range(260):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(t))
            op = r.randint(0, 2)
            t[k : k + (op > 0)] = [r.choice(toks)] if op < 2 else []
        rows.append((i, r.choice(["", " ", "\t"]) + "".join(t), r.choice([None, None, None, r.randint(0, 40)]), r.choice(["A", "a ", "b", None]), r.choice(["train", "Train\t", "test", "valid", None]), "s"))
    old = O.BROADCAST_ROWS, O.BROADCAST_PAIRS
    for limits, meet in ((old, O.MEET), ((0, 0), 1), (old, 1), ((0, 0), O.MEET)):  # meet 1: every key cut into parts
        O.BROADCAST_ROWS, O.BROADCAST_PAIRS = limits
        _check(spark, rows, meet)
    O.BROADCAST_ROWS, O.BROADCAST_PAIRS = old


def test_defined_cases(spark):
    rows = [
        (1, None, None, "t", "train", None), (2, None, None, "t", "test", None), (3, "", 5, "t", "train", None), (4, "??!", 5, "t", "valid", None), (5, "zz", 6, "t", "test", "x"),
        (None, "CCCCCC", 7, "t", "train", None), (6, "CCCCCC", 7, "t", "test", None), (7, "C" * 700, None, "t", "train", None), (8, "C" * 702 + "N", None, "t", "test", None), (9, "CCCCCC", 7, "u", "train", None), (10, "CCCCCC", 7, None, "train", None),
    ]
    _check(spark, rows)
    report = O.report(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    assert sorted((r.split, r.source, r.pairs, r.records) for r in report) == [("test", None, 1, 1), ("valid", None, 1, 1)]


def test_repeats_and_empty(spark):
    rows = [(i, "CCNCCO", 1, "t", "train" if i % 2 else "test", "s") for i in range(20)]
    _check(spark, rows + rows[:5])
    _check(spark, [])


def test_containment(spark):
    rows = [(1, "CCNCCOCC", None, "t", "train", "s"), (2, "CCNCCOCCC", None, "t", "test", "s"), (3, "NN", None, "t", "train", "s"), (4, "NNO", None, "t", "valid", "s"), (5, "CCNCCOCC", None, "t", "train", "s")]
    got = {(r.train_record, r.eval_record): (r.containment, r.distance) for r in O.containment(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()}
    assert got == {(1, 2): (4 / 5, 1), (3, 4): (0.0, 1)}


def test_letters_that_collide(spark):
    """Two tokens with one letter in common are still two tokens."""
    words = [f"[{i}C]" for i in range(400)]
    codes: dict = {}
    for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", O._letter(F.col("t")).alias("c")).collect():
        codes.setdefault(r.c, []).append(r.t)
    a, b = next((v[:2] for v in codes.values() if len(v) > 1), words[:2])
    _check(spark, [(1, (a + "C") * 6, None, "t", "train", "s"), (2, (b + "C") * 6, None, "t", "test", "s"), (3, (b + "C") * 2 + (a + "C") * 4, None, "t", "test", "s")])
