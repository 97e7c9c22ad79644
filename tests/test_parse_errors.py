import csv
import io
import random
import re

import pytest

from actlens.operators import parse_errors as P

SCHEMA = "line_id long, file_name string, line_no int, raw string, reason string"
GOOD = "1,CC(=O)O,2,task,cls,train,1"

CASES = [
    ("dataset_1.csv", GOOD, None),
    ("dataset_1.csv", GOOD + "\r", None),
    ("dataset_1.csv", GOOD + "\r\r", "value"),
    ("dataset_1.csv", '1,CC,2,"task, with ""quotes""\nand a line",cls,train,1', None),
    ("dataset_1.csv", '1,CC,2,"task,cls,train,1', "quoting"),
    ("dataset_1.csv", '1,CC,2,ta"sk,cls,train,1', "quoting"),
    ("dataset_1.csv", '1,CC,2,"task"x,cls,train,1', "quoting"),
    ("dataset_1.csv", '1,"CC",2,"task",cls,train,"1"', None),
    ("dataset_1.csv", '1,CC,2,"",cls,train,1', "value"),
    ("dataset_1.csv", "", "column_count"),
    ("dataset_1.csv", None, "column_count"),
    ("dataset_1.csv", GOOD + ",", "column_count"),
    ("dataset_1.csv", "1,CC,2,task,cls,train", "column_count"),
    ("dataset_1.csv", "1x,CC,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,C(C,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,C)C(,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,C1CC,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,C%10CC%10,2,task,cls,train,1", None),
    ("dataset_1.csv", "1,C%10CC1,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,[C(]C,2,task,cls,train,1", None),
    ("dataset_1.csv", "1,CXC,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1, CC,2,task,cls,train,1", "value"),
    ("dataset_1.csv", "1,CC,2, \t,cls,train,1", "value"),
    ("dataset_1.csv", "1,CC,2,t,cls,Train,1", "value"),
    ("dataset_1.csv", "1,CC,2,t,cls,train,0.5", "value"),
    ("dataset_1.csv", "1,CC,2,t,reg,train,-0.5e+3", None),
    ("dataset_1.csv", "1,CC,2,t,reg,train,.5", "value"),
    ("dataset_1.csv", "1,CC,2,t,reg,train,1\n", "value"),
    ("dataset_1.csv", "1234567890123456789,CC,2,t,reg,train,1", "value"),
    ("dataset_1.csv", "1,\x01a\x01b,2,t,cls,train,1", "value"),
    ("dataset_1.csv", '1,CC,2,"a\x01b\x01a",cls,train,1', None),
    ("dataset_1.tsv", GOOD.replace(",", "\t"), None),
    ("features_1.tsv", "1\t1\t0.5\t1e3\t-2", None),
    ("features_1.csv", "1,2,0.5,1e3,-2", "value"),
    ("features_1.csv", '1,"1",0.5,"1e3",-2', None),
    ("features_1.csv", "1,1,0.5,nan,-2", "value"),
    ("other.csv", "1,1", "file_kind"),
    ("dataset_1.csv", "1," + "C(C)" * 30_000 + ",2,task,cls,train,1", None),
    ("dataset_1.csv", '1,CC,2,"' + '""' * 50_000 + '",cls,train,1', None),
]


def test_cases(spark):
    rows = [(i, f, 2, raw, want) for i, (f, raw, want) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, (-1, "dataset_1.csv", 1, "header", None), (-2, "dataset_1.csv", None, "x", None)], SCHEMA)
    got = {r.line_id: r.reason for r in P.rejects(df).collect()}
    assert got == {i: want for i, *_, want in rows if want}
    valid = {r.line_id for r in P.strict_load(df, "dataset").collect()} | {r.line_id for r in P.strict_load(df, "features").collect()}
    assert valid == {i for i, *_, want in rows if not want}


def test_values_and_repeats(spark):
    df = spark.createDataFrame([(1, "dataset.csv", 2, '7,CC,3,"a ""b"", c",reg,test,1.5', None)] * 2 + [(None, "dataset.csv", 3, GOOD, None), (None, "dataset.csv", 4, "x", None)], SCHEMA)
    rows = P.strict_load(df, "dataset").where("line_id = 1").collect()
    assert [(r.record_id, r.task, r.y) for r in rows] == [(7, 'a "b", c', 1.5)] * 2
    assert [(r.line_id, r.line_no, r.reason) for r in P.rejects(df).collect()] == [(None, 4, "column_count")]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.rejects(df).count() == 0 and P.strict_load(df, "features").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_quoting_against_a_scanner(spark, seed):
    """Fields as a character by character scanner has them."""
    r = random.Random(seed)

    def scan(s, d):
        fields, i = [], 0
        while True:
            if s[i : i + 1] == '"':
                out, i = "", i + 1
                while True:
                    if i >= len(s):
                        return None
                    if s[i] == '"':
                        if s[i + 1 : i + 2] == '"':
                            out, i = out + '"', i + 2
                            continue
                        i += 1
                        break
                    out, i = out + s[i], i + 1
                if i < len(s) and s[i] != d:
                    return None
            else:
                m = re.compile(f"[^{d}]*").match(s, i)
                out, i = m.group(), m.end()
                if '"' in out:
                    return None
            fields.append(out)
            if i >= len(s):
                return fields
            i += 1

    texts = ["".join(r.choice('"",,a\n') for _ in range(r.randint(0, 9))) for _ in range(300)]
    df = P._lines(spark.createDataFrame([(i, "dataset.csv", 2, t, None) for i, t in enumerate(texts)], SCHEMA))
    ok, f = P._quoting_ok(df["_cut"], df["_d"]), P._fields(df["_cut"], df["_d"])
    got = {x.line_id: x.f if x.ok else None for x in df.select("line_id", ok.alias("ok"), f.alias("f")).collect()}
    assert got == {i: scan(t, ",") for i, t in enumerate(texts)}
    assert csv.reader(io.StringIO("a")) is not None
