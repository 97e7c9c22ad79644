import random

import numpy as np
import pytest

from actlens.llm import gru
from actlens.llm import language as L

PY, SQL = L.LANGUAGES.index("python"), L.LANGUAGES.index("sql")


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.init(3, 4, 1, 2).items()}
    x, y, w = r.integers(0, 5, (6, 3)), r.integers(0, 3, (6, 3)), r.random((6, 3))
    _, g = gru.gradients(p, x, y, w)
    for k in p:
        for _ in range(4):
            i = tuple(r.integers(0, d if d < 200 else 5) for d in p[k].shape)
            old, e = p[k][i], 1e-5
            p[k][i] = old + e
            up = gru.gradients(p, x, y, w)[0]
            p[k][i] = old - e
            down = gru.gradients(p, x, y, w)[0]
            p[k][i] = old
            assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-4, abs=1e-8)


def test_windows_change_nothing():
    """Sums per line don't depend on which texts are run together, and long texts are labelled to their end."""
    p = gru.init(len(L.LANGUAGES), 8, 2)
    texts = [b"", b"\n\n", b"one line", b"a\nb\n" * 400, "é\n中".encode(), b"x" * 5000]
    together = L.line_scores(p, texts)
    for t, (sums, n) in zip(texts, together):
        alone = L.line_scores(p, [t])[0]
        assert np.array_equal(n, alone[1]) and np.allclose(sums, alone[0], atol=1e-3)
        assert n.sum() == sum(c not in b" \t\r\n\v\f" for c in t) and len(n) == t.count(b"\n") + 1


def _score(langs, sure=1.0):
    n = np.array([0 if x is None else 20 for x in langs])
    sums = np.full((len(langs), len(L.LANGUAGES)), -3.0) * n[:, None]
    for i, x in enumerate(langs):
        if x is not None:
            sums[i, x] = -3.0 * n[i] * (1 - sure)
    return sums, n


def _strong(langs):
    n = np.full(len(langs), 20)
    sums = np.full((len(langs), len(L.LANGUAGES)), L.FLOOR) * n[:, None]
    sums[np.arange(len(langs)), langs] = 0
    return sums, n


def test_segments():
    langs = [PY] * 4 + [None] + [SQL] * 3 + [PY] * 3
    lines = [b"import a", b"b = 1", b"c = 2", b'x = """', b"", b"select 1", b"from t", b"where u", b'"""', b"d = 3", b"e = 4"]
    segs = L.segments(*_score(langs), L.marks(lines))
    assert [(a, b, x) for a, b, x, _ in segs] == [(1, 4, PY), (6, 8, SQL), (9, 11, PY)] and all(0 < c <= 1 for *_, c in segs)
    assert L.segments(*_score([None, None]), np.zeros(2, np.int8)) == []
    one = L.segments(*_score([PY, PY, SQL, PY, PY]), np.zeros(5, np.int8))
    assert [(a, b, x) for a, b, x, _ in one] == [(1, 5, PY)]
    # without any mark: a line at the end, two lines inside, and no switch behind a comment of the language
    plain = np.zeros(6, np.int8)
    found = lambda langs, mark=plain: [(a, b, x) for a, b, x, _ in L.segments(*_strong(langs), mark)]
    assert found([PY] * 5 + [SQL]) == [(1, 5, PY), (6, 6, SQL)] and found([PY] * 2 + [SQL] * 2 + [PY] * 2) == [(1, 2, PY), (3, 4, SQL), (5, 6, PY)]
    hash_, dashes = plain.copy(), plain.copy()
    hash_[4], dashes[4] = 4, 7
    assert found([PY] * 5 + [SQL], hash_) == [(1, 6, PY)] and found([PY] * 5 + [SQL], dashes) == [(1, 5, PY), (6, 6, SQL)]


def test_marks():
    lines = [b"# note", b"```sql", b"select", b"```", b"cat <<'EOF'", b"EOF x", b"EOF", b"<script type=x>", b"f();", b"</script>", b"`", b"never closed", b"  go on", b"}"]
    assert L.marks(lines).tolist() == [4, 1, 3, 2, 1, 3, 2, 1, 3, 2, 0, 0, 5, 5]


def test_unclosed_words_cost_no_time():
    import time

    lines = [f"cout <<word{i}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")).encode() for i in range(8000)]
    began = time.perf_counter()
    assert not (L.marks(lines) == 3).any() and time.perf_counter() - began < 0.5


def _documents(n, seed):
    r = random.Random(seed)
    w = lambda: r.choice(["alpha", "bond", "carbon", "delta", "edge"])
    py = lambda: f"def {w()}_{w()}({w()}):\n    for {w()} in range({r.randint(1, 99)}):\n        print(\"{w()}\", {w()})\n    return {w()}\n"
    sql = lambda: f"SELECT {w()}, COUNT(*) AS {w()}\nFROM {w()}\nWHERE {w()} > {r.randint(1, 99)}\nGROUP BY {w()};\n"
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            a, b = "".join(py() for _ in range(3)), "".join(sql() for _ in range(3))
            text = f'{a}QUERY = """\n{b}"""\n{py()}'
            rows.append((i, text, "python", [(1, "python"), (a.count("\n") + 2, "sql"), (a.count("\n") + b.count("\n") + 2, "python")]))
        else:
            lang, make = ("python", py) if kind < 0.55 else ("sql", sql)
            label = lang if r.random() < 0.9 else r.choice([None, "java", " ?", "sql" if lang == "python" else "python"])
            rows.append((i, "".join(make() for _ in range(r.randint(2, 6))), label, [(1, lang)]))
    return rows


def test_end_to_end(spark):
    rows = _documents(260, 1)
    more = [(1000, None, "sql", []), (1001, " \n\t", "sql", []), (1002, "\n\n  " + rows[0][1], None, [(f + 2, x) for f, x in rows[0][3]]), (0, rows[0][1], rows[0][2], rows[0][3])]
    df = spark.createDataFrame([(i, t, y, "extra") for i, t, y, _ in rows + more], "doc_id long, text string, lang string, segments string")
    weights = L.train(df, rounds=(2, 1), steps=40, per_language=100)
    got = [tuple(r) for r in L.found(df, weights).collect()]
    want = [(i, f, x) for i, _, y, segs in rows + more for f, x in segs if len(segs) > 1 or (y or "").strip().lower() != x]
    hits = len(set(got) & set(want))
    assert hits / len(set(want)) > 0.9 and hits / len(set(got)) > 0.9
    whole = L.identify(df, weights)
    assert whole.count() == len(rows) + len(more) and {r.language for r in whole.where("doc_id in (1000, 1001)").collect()} == {None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.train(df)
    assert L.identify(df, gru.init(len(L.LANGUAGES), L.HIDDEN, 0)).count() == 0
