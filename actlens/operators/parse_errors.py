"""Rows that fail to parse: strict load, anti-join on record offsets, diagnosis of the remainder.

A line's offset is its line_id and a hash of file name, line number and text. The strict loader keeps a line only if
its quoting, its number of fields and every value conform, and gives typed rows. Subtracting the offsets of the loaded
rows from those of all lines (offsets only are shuffled, no texts) leaves the rejects. These are joined back to their
lines, by broadcast if their counted number allows, and only they are diagnosed.

Quoting needs no backtracking pattern: the line is cut at its quote marks, so the pieces at even places lie outside
quotes. The line is well formed if the number of pieces is odd and each outside piece touches the quotes next to it
with a delimiter (an empty one is an escaped quote). Linear for texts of any length.

Defined results: a null raw is an empty line (`column_count`); null line_no or line 1 is no record; file names that
are neither `dataset*` nor `features*` give reason `file_kind`; repeated lines are judged each; an empty table gives
empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.common import broadcast_if, settle, strip
from actlens.functions import smiles as S

# Columns of the two kinds of delivered files, and what their values must look like.
DATASET = ["record_id", "smiles", "canon_index", "task", "task_type", "split", "y"]
FEATURES = ["canon_index", "isSmilesRDKitParsable", "logp", "molwt", "tpsa"]
NUMBER = r"\A-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
INDEX = r"\A[0-9]{1,18}\z"

ESC, SEP = "\x01a", "\x01b"

#: Counted rejects up to which their offsets are broadcast to the lines.
BROADCAST_ROWS = 500_000
OFFSET = ["line_id", "_raw"]


def _body(raw: Column) -> Column:
    raw = F.coalesce(raw, F.lit(""))
    return F.when(F.endswith(raw, F.lit("\r")), F.left(raw, F.length(raw) - 1)).otherwise(raw)


def _records(raw: DataFrame) -> DataFrame:
    """The records among the lines, with their offset, kind and delimiter."""
    return (
        raw.where("line_no > 1")
        .select("line_id", "file_name", "line_no", F.xxhash64("file_name", "line_no", "raw").alias("_raw"), "raw")
        .withColumn("_kind", F.when(F.startswith("file_name", F.lit("dataset")), "dataset").when(F.startswith("file_name", F.lit("features")), "features"))
        .withColumn("_d", F.when(F.endswith("file_name", F.lit(".tsv")), "\t").otherwise(","))
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: a generator of one row, behind which filters stay, where they would else work the value out again each."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(raw: DataFrame) -> DataFrame:
    """The records with their body cut at quotes."""
    return _once(_records(raw), "_cut", F.split(_body(F.col("raw")), '"', -1)).drop("raw")


def _quoting_ok(cut: Column, d: Column) -> Column:
    n = F.size(cut)
    touches = lambda s, i: (i % 2 == 1) | (s == "") | (((i == 0) | F.startswith(s, d)) & ((i == n - 1) | F.endswith(s, d)))
    return (n % 2 == 1) & F.forall(F.transform(cut, touches), lambda ok: ok)


def _fields(cut: Column, d: Column) -> Column:
    """The unquoted fields of a well-formed line; delimiters outside quotes become a mark that no escaped text holds."""
    safe = lambda s: F.replace(s, F.lit("\x01"), F.lit(ESC))
    marked = F.array_join(F.transform(cut, lambda s, i: F.when(i % 2 == 1, safe(s)).otherwise(F.replace(safe(s), d, F.lit(SEP)))), '"')
    plain = lambda f: F.replace(f, F.lit(ESC), F.lit("\x01"))
    unquote = lambda f: F.when(F.startswith(f, F.lit('"')), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.split(marked, SEP, -1), lambda f: plain(unquote(f)))


def _dataset_ok(f: Column) -> Column:
    """All but the molecule string."""
    return (
        F.get(f, F.lit(0)).rlike(INDEX) & F.get(f, F.lit(2)).rlike(INDEX) & (F.get(f, F.lit(1)) != "")
        & (strip(F.get(f, F.lit(3))) != "") & F.get(f, F.lit(4)).isin("cls", "reg") & F.get(f, F.lit(5)).isin("train", "valid", "test")
        & F.when(F.get(f, F.lit(4)) == "cls", F.get(f, F.lit(6)).isin("0", "1")).otherwise(F.get(f, F.lit(6)).rlike(NUMBER))
    )


def _features_ok(f: Column) -> Column:
    return F.get(f, F.lit(0)).rlike(INDEX) & F.get(f, F.lit(1)).isin("0", "1") & F.get(f, F.lit(2)).rlike(NUMBER) & F.get(f, F.lit(3)).rlike(NUMBER) & F.get(f, F.lit(4)).rlike(NUMBER)


def strict_load(raw: DataFrame, kind: str) -> DataFrame:
    """The conforming lines of one kind of file as typed rows, with their offsets and `_raw` (a hash of the line)."""
    cols, ok = (DATASET, _dataset_ok) if kind == "dataset" else (FEATURES, _features_ok)
    types = {"record_id": "long", "canon_index": "long", "y": "double", "isSmilesRDKitParsable": "int", "logp": "double", "molwt": "double", "tpsa": "double"}
    f, t = F.col("_f"), F.col("_t")
    rows = _lines(raw).where(F.col("_kind") == kind).where(_quoting_ok(F.col("_cut"), F.col("_d")))
    rows = _once(rows, "_f", _fields(F.col("_cut"), F.col("_d"))).where(F.size("_f") == len(cols)).where(ok(f))
    if kind == "dataset":
        smiles = F.get(f, F.lit(1))
        rows = _once(rows, "_t", S.tokens(smiles)).where((F.array_join(t, "") == smiles) & S.balanced(t) & S.rings_closed(t))
    return rows.select("line_id", "file_name", "line_no", "_raw", *(F.get(f, F.lit(i)).try_cast(types.get(c, "string")).alias(c) for i, c in enumerate(cols)))


def rejects(raw: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, reason) of each record that the strict load leaves behind."""
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in OFFSET]
    loaded = strict_load(raw, "dataset").select(*OFFSET).unionByName(strict_load(raw, "features").select(*OFFSET))
    left = settle(_records(raw).select(*OFFSET).alias("a").join(loaded.alias("b"), same("a", "b"), "left_anti"))
    lines = _lines(raw).alias("a").join(broadcast_if(left.distinct(), left.count(), BROADCAST_ROWS).alias("b"), same("a", "b"), "left_semi")
    width = F.when(F.col("_kind") == "dataset", len(DATASET)).otherwise(len(FEATURES))
    return lines.select(
        "line_id", "file_name", "line_no",
        F.when(F.col("_kind").isNull(), "file_kind")
        .when(~_quoting_ok(F.col("_cut"), F.col("_d")), "quoting")
        .when(F.size(_fields(F.col("_cut"), F.col("_d"))) != width, "column_count")
        .otherwise("value").alias("reason"),
    )
