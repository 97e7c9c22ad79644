import datetime as dt
import pickle
import random

from actlens.llm import term_counts as T

SCHEMA = "run_id long, feature int, token array<string>, token_Count array<long>, token_Global_Ratio array<double>, written_at timestamp, mark string"
DAY = dt.datetime(2025, 1, 1)


def _brute(rows):
    last = {}
    for r in rows:
        if r[:2] not in last or r[5] > last[r[:2]][5]:
            last[r[:2]] = r
    out, n = {}, 0
    for _, _, ts, cs, gs, *_ in last.values():
        own = {}
        for i, t in enumerate(ts or []):
            if t is None or not t.strip():
                continue
            c = own.setdefault(t.strip(), [0, []])
            c[0] += (cs[i] if cs and i < len(cs) else None) or 0
            if gs and i < len(gs) and gs[i] is not None:
                c[1].append(gs[i])
        n += bool(own)
        for t, (c, g) in own.items():
            x = out.setdefault(t, [0, 0, []])
            x[0], x[1], x[2] = x[0] + c, x[1] + 1, x[2] + g
    mark = lambda c, k: "rare" if k < 3 or c < 5 else "common" if 2 * k > n else None
    return {t: (c, k, min(g, default=None), max(g, default=None), mark(c, k)) for t, (c, k, g) in out.items()}


def _check(spark, rows, **params):
    got = T.term_counts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **params).collect()
    assert len({r.token for r in got}) == len(got)
    assert {r.token: (r.total, r.records, r.lowest, r.highest, r.mark) for r in got} == _brute(rows)


def test_tries_of_any_shape(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 9))) if r.random() < 0.8 else r.choice([None, " ", "\t", "é中", " a\t", "a" * 300, "\0", "a\0"])
    rows = []
    for i in range(150):
        ts = [word() for _ in range(r.randint(0, 12))]
        cs = [r.choice([None, r.randint(0, 9)]) for _ in ts]
        rows.append((r.choice([None, 1, 2]), i % 60, r.choice([ts, ts, None]), cs[: len(cs) - r.randint(0, 1)] if cs else cs, r.choice([None, [r.random() for _ in ts]]), DAY + dt.timedelta(seconds=i)))
    _check(spark, rows)
    for burst, routed, routes, flush, piece in ((3, 5, 1000, 40, 20), (1, 1, 5, 10**6, 3), (1, 0, 10**6, 7, 10**6)):
        _check(spark, rows, burst=burst, routed=routed, routes=routes, flush=flush, piece=piece)


def test_trie_alone():
    r = random.Random(1)
    terms = ["".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(2000)] + ["https://" + "x" * r.choice([500, 501, 20]) + str(r.randint(0, 300)) for _ in range(900)]
    for burst in (1, 2, 4, 32):
        trie = T.BurstTrie(burst)
        want: dict = {}
        for t in terms:
            trie.add(t, [2, 1, None, None])
            want[t] = want.get(t, 0) + 2
        parts = list(trie.parts())
        got = [(p + s, c[0]) for p, _, box, _ in parts if box for s, c in box.items()]
        assert dict(got) == want and len(got) == trie.terms == len(want)
        assert all(len(box) <= burst for _, _, box, _ in parts if box)
        inner = {p: n for p, _, box, n in parts if box is None}
        assert inner and all(n == sum(t.startswith(p) for t in want) for p, n in inner.items())


def test_routing_spreads_the_given_terms(spark):
    """The table's terms really burst, and no merge holds more than a bounded number of entries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four tasks, as at scale
    try:
        parts = T.subtries(spark.read.parquet("/root/testdata/sf0.1/token_preference.parquet"))
        prefixes = T.routing_prefixes(parts)
        groups = T.merge_groups(parts, prefixes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(prefixes) > 8 and len({g.route for g in groups}) > 50
    assert max(len(pickle.loads(g.subtrie)) for g in groups) <= T.ROUTED


def test_names_of_subtrees():
    of = T.Routing({"ab", "abc", "x"}).of
    assert [of(t) for t in ("ab", "abd", "abc", "abcd", "abcde", "a", "ac", "x", "xyz", "q")] == ["ab", "abd", "abc", "abcd", "abcd", "a", "a", "x", "xy", "q"]


def test_empty(spark):
    _check(spark, [])
