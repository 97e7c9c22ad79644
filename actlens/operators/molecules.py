"""Tokens and structure of molecule strings, as rows. All by column expressions and windows inside one string.

Strings whose branches do not balance keep what can be paired; a null or empty string gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import fraction, let
from actlens.functions import smiles as S


def token_rows(samples: DataFrame) -> DataFrame:
    """(sample_idx, token_idx, token, role)."""
    return samples.select("sample_idx", F.posexplode(S.tokens(F.col("smiles"))).alias("token_idx", "token")).withColumn("role", S.role(F.col("token")))


def _in_order():
    return Window.partitionBy("sample_idx").orderBy("token_idx")


def atom_map(samples: DataFrame) -> DataFrame:
    """(sample_idx, atom_idx, token_idx): the n-th token that names an atom."""
    rows = token_rows(samples).where(F.col("token").rlike(S.ATOM))
    return rows.select("sample_idx", (F.row_number().over(_in_order()) - 1).alias("atom_idx"), "token_idx")


def mask_enum(samples: DataFrame, mask: str = "[MASK]", exclude: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """(sample_idx, token_idx, token, masked): the string with one token replaced, for each token in [start, end) that the pattern doesn't exclude."""
    toks = S.tokens(F.col("smiles"))
    rows = samples.select("sample_idx", toks.alias("_t"), F.posexplode(toks).alias("token_idx", "token")).where(F.col("token_idx") >= start)
    if end is not None:
        rows = rows.where(F.col("token_idx") < end)
    if exclude:
        rows = rows.where(~F.col("token").rlike(exclude))
    i = F.col("token_idx")
    masked = F.concat(F.array_join(F.slice("_t", F.lit(1), i), ""), F.lit(mask), F.array_join(F.slice("_t", i + 2, F.size("_t")), ""))
    return rows.select("sample_idx", "token_idx", "token", masked.alias("masked"))


def _depth(rows: DataFrame) -> DataFrame:
    """Adds depth, the number of branches open after the token; a closing token without an open branch changes nothing."""
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    upto = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum(step).over(upto))
    return run.withColumn("depth", F.col("_run") - F.least(F.lit(0), F.min("_run").over(upto))).drop("_run")


def _depths(rows: DataFrame) -> DataFrame:
    """Branch tokens with the depth they open or close and what follows at that depth."""
    before = F.lag("depth", 1, 0).over(_in_order())
    b = _depth(rows).withColumn("depth", F.when(F.col("token") == "(", F.col("depth")).otherwise(before)).where(F.col("token").isin("(", ")") & (F.col("depth") > 0))
    return b.withColumn("close", F.lead(F.struct("token", "token_idx")).over(Window.partitionBy("sample_idx", "depth").orderBy("token_idx")))


def syntax_pairs(samples: DataFrame) -> DataFrame:
    """(sample_idx, kind, token, open_idx, close_idx): matching branch tokens, and ring tokens from opening to closing."""
    rows = token_rows(samples)
    branch = _depths(rows).where("token = '(' and close.token = ')'").select("sample_idx", F.lit("branch").alias("kind"), F.lit("(").alias("token"), F.col("token_idx").alias("open_idx"), F.col("close.token_idx").alias("close_idx"))
    at = Window.partitionBy("sample_idx", "token").orderBy("token_idx")
    rings = rows.where("role = 'Ring'").select("*", F.row_number().over(at).alias("n"), F.lead("token_idx").over(at).alias("close_idx"))
    ring = rings.where("n % 2 = 1 and close_idx is not null").select("sample_idx", F.lit("ring").alias("kind"), "token", F.col("token_idx").alias("open_idx"), "close_idx")
    return branch.unionByName(ring)


def branches(samples: DataFrame) -> DataFrame:
    """(sample_idx, depth, open_idx, close_idx, tokens, atoms): each closed branch with the places of its own tokens and atoms, without those of branches inside it; the main chain is depth 0, from the first token to the last. Tokens of a branch that is never closed are in no row."""
    rows = _depth(token_rows(samples))
    at = Window.partitionBy("sample_idx", "depth").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, 0)
    # a token belongs to the last branch opened at its depth
    placed = rows.withColumn("open_idx", F.last(F.when(F.col("token") == "(", F.col("token_idx")), ignorenulls=True).over(at))
    placed = placed.withColumn("open_idx", F.when(F.col("depth") > 0, F.col("open_idx"))).where(~F.col("token").isin("(", ")"))
    ids = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("token_idx"))))
    own = placed.groupBy("sample_idx", "depth", "open_idx").agg(ids(F.lit(True)).alias("tokens"), ids(F.col("token").rlike(S.ATOM)).alias("atoms"))
    pairs = _depths(token_rows(samples)).where("token = '(' and close.token = ')'").select("sample_idx", "depth", F.col("token_idx").alias("open_idx"), F.col("close.token_idx").alias("close_idx"))
    inner = pairs.join(own.where("open_idx is not null").select("sample_idx", "open_idx", "tokens", "atoms"), ["sample_idx", "open_idx"], "left")
    main = rows.groupBy("sample_idx").agg(F.max("token_idx").alias("close_idx")).select("sample_idx", F.lit(0).alias("depth"), F.lit(0).alias("open_idx"), "close_idx")
    main = main.join(own.where("open_idx is null").select("sample_idx", "tokens", "atoms"), "sample_idx", "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<int>")).alias(c)
    cols = ["sample_idx", F.col("depth").cast("int").alias("depth"), "open_idx", "close_idx", some("tokens"), some("atoms")]
    return main.select(*cols).unionByName(inner.select(*cols))


def bond_atoms(samples: DataFrame) -> DataFrame:
    """(sample_idx, token_idx, token, left_idx, right_idx): each bond token with the nearest atom before it and the atom after it; if the next token closes a ring, the right atom is the one before that ring's opening."""
    rows = token_rows(samples).withColumn("atom_idx", F.when(F.col("token").rlike(S.ATOM), F.col("token_idx")))
    before, after = _in_order().rowsBetween(Window.unboundedPreceding, -1), _in_order().rowsBetween(1, Window.unboundedFollowing)
    ring = Window.partitionBy("sample_idx", "token").orderBy("token_idx")
    full = rows.select(
        "*", F.last("atom_idx", ignorenulls=True).over(before).alias("left_idx"), F.first("atom_idx", ignorenulls=True).over(after).alias("next_atom"),
        F.when(F.col("role") == "Ring", F.row_number().over(ring)).alias("nth"),
    )
    full = full.withColumn("opened_at", F.lag("left_idx").over(ring))
    full = full.withColumn("next", F.lead(F.struct("role", "nth", "opened_at")).over(_in_order()))
    right = F.when((F.col("next.role") == "Ring") & (F.col("next.nth") % 2 == 0), F.col("next.opened_at")).otherwise(F.col("next_atom"))
    return full.where("role = 'Bond'").select("sample_idx", "token_idx", "token", "left_idx", right.alias("right_idx"))


def pattern_labels(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(sample_idx, concept, token_idx): tokens that match a concept's pattern; the native stand-in for substructure labels."""
    rows = token_rows(samples)
    names = F.explode(F.array(*(F.when(F.col("token").rlike(p), F.lit(c)) for c, p in patterns.items())))
    return rows.select("sample_idx", names.alias("concept"), "token_idx").where("concept is not null")


# Kinds of errors, what may be put in for an aromatic atom, and bond and branch tokens.
ERRORS = ["rings", "parentheses", "aromaticity", "syntax", "valence"]
FOR_AROMATIC = [["[nH]"], ["n", "(", "C", ")"], ["o"], ["s"], ["c", "(", "=", "O", ")"], ["c", "(", "=", "N", ")"], ["C"], ["N"], ["c", "c"], ["c", "n"], ["n", "c"], ["n", "n"]]
BONDS, MARKS = ["-", "=", "#"], ["-", "=", "#", "(", ")"]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _pick(values: Column, u: Column) -> Column:
    """The value at a place chosen by u in [0, 1); null if there is none."""
    return let(values, lambda v: F.get(v, F.floor(u * F.size(v)).cast("int")))


def _places(t: Column, ok) -> Column:
    return F.filter(F.transform(t, lambda x, i: F.when(ok(x), i)), lambda i: i.isNotNull())


def _splice(t: Column, at: Column, n: Column | int, new: Column) -> Column:
    """The tokens with n of them, from `at` on, replaced; null where `at` is."""
    n = F.lit(n) if isinstance(n, int) else n
    return let(at, lambda i: F.concat(F.slice(t, F.lit(1), i), new, F.slice(t, i + n + 1, F.size(t))))


def _ring(t: Column, s: Column, u: list[Column]) -> Column:
    name = lambda n: F.when(n < 10, n.cast("string")).otherwise(F.concat(F.lit("%"), n.cast("string")))
    more = lambda rings: F.concat(rings, F.array(name(F.size(rings) + 1)))
    number = lambda ring: F.regexp_replace(ring, "%", "").cast("int")
    near = lambda ring: F.when(number(ring) == 1, F.lit("2")).otherwise(name(number(ring) + F.when(u[3] < 0.5, -1).otherwise(1)))
    without = lambda all_, k: F.concat(F.slice(all_, F.lit(1), k - 1), F.slice(all_, k + 1, F.size(all_)))
    other = lambda rings, ring: _pick(let(more(rings), lambda m: without(m, F.array_position(m, ring).cast("int"))), u[3])
    back = lambda rings, ring: F.when(u[2] < 0.25, F.array(near(ring))).when(u[2] < 0.5, F.array(other(rings, ring))).otherwise(F.array().cast("array<string>"))
    odd = lambda at: F.filter(at, lambda x, i: i % 2 == 0)

    def of(rings: Column, ring: Column) -> Column:
        at = _places(t, lambda x: x == ring)
        return F.when(s < 0.6, _splice(t, _pick(at, u[1]), 1, back(rings, ring))).otherwise(_splice(t, _pick(let(at, odd), u[1]), 0, F.array(ring)))

    def some(rings: Column) -> Column:
        anywhere = _splice(t, F.floor(u[0] * F.size(t)).cast("int"), 1, F.array(_pick(more(rings), u[1])))
        return F.when((s < 0.8) & (F.size(rings) > 0), let(_pick(rings, u[0]), lambda ring: of(rings, ring))).otherwise(anywhere)

    return let(F.array_sort(F.array_distinct(F.filter(t, lambda x: x.rlike(S.RING)))), some)


def _parentheses(t: Column, s: Column, u: list[Column]) -> Column:
    opens, closes = _places(t, lambda x: x == "("), _places(t, lambda x: x == ")")
    swap = lambda o, c: F.when(o.isNotNull() & c.isNotNull(), F.transform(t, lambda x, i: F.when(i == o, ")").when(i == c, "(").otherwise(x)))
    swapped = let(_pick(opens, u[0]), lambda o: let(_pick(closes, u[1]), lambda c: swap(o, c)))
    return (
        F.when(s < 0.2, _splice(t, F.floor(u[0] * F.size(t)).cast("int") + 1, 0, F.array(_pick(_texts(["(", ")"]), u[1]))))
        .when(s < 0.4, _splice(t, _pick(_places(t, lambda x: x.isin("(", ")")), u[0]), 1, F.array().cast("array<string>")))
        .when(s < 0.6, swapped)
        .when(s < 0.8, _splice(t, _pick(opens, u[0]), 1, _texts([")"])))
        .otherwise(_splice(t, _pick(closes, u[0]), 1, _texts(["("])))
    )


def _aromaticity(t: Column, s: Column, u: list[Column]) -> Column:
    plain, one, two = _places(t, lambda x: x.isin("C", "N", "O", "S", "P", "B")), _places(t, lambda x: x.isin("c", "n")), _places(t, lambda x: x.isin("[nH]", "o", "s"))
    lower = _places(t, lambda x: x.rlike("[a-z]") & ~x.rlike("[A-Z]"))
    c_or_n = F.array(_pick(_texts(["c", "n"]), u[1]))
    return (
        F.when(s < 0.2, let(_pick(plain, u[0]), lambda i: _splice(t, i, 1, F.array(F.lower(F.get(t, i))))))
        .when(s < 0.4, _splice(t, _pick(one, u[0]), 1, _pick(F.array(*map(_texts, FOR_AROMATIC)), u[1])))
        .when(s < 0.6, _splice(t, _pick(lower, u[0]) + F.floor(u[2] * 2).cast("int"), 0, c_or_n))
        .when(s < 0.8, _splice(t, _pick(two, u[0]), 1, c_or_n))
        .otherwise(_splice(t, _pick(one, u[0]), 1, F.array().cast("array<string>")))
    )


def _closed(t: Column) -> Column:
    """The closed branches as (open, close), in order of closing."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<o:int,c:int>>").alias("pairs"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        last = F.struct(F.element_at(a["open"], -1).alias("o"), a["i"].alias("c"))
        closes = (x == ")") & (F.size(a["open"]) > 0)
        opened = F.when(x == "(", F.concat(a["open"], F.array(a["i"]))).when(closes, F.slice(a["open"], F.lit(1), F.size(a["open"]) - 1)).otherwise(a["open"])
        return F.struct(opened.alias("open"), F.when(closes, F.concat(a["pairs"], F.array(last))).otherwise(a["pairs"]).alias("pairs"), (a["i"] + 1).alias("i"))

    return F.aggregate(t, start, step)["pairs"]


def _syntax(t: Column, s: Column, u: list[Column]) -> Column:
    bond, mark = F.array(_pick(_texts(BONDS), u[1])), F.array(_pick(_texts(MARKS), u[1]))
    nothing = F.array().cast("array<string>")
    seen = lambda i: F.size(F.filter(F.slice(t, F.lit(1), i), lambda y: y == F.get(t, i)))
    ring_opens = F.filter(_places(t, lambda x: x.rlike(S.RING)), lambda i: seen(i) % 2 == 0)
    last = lambda first: F.element_at(F.concat(F.array(F.lit(-1)), F.filter(_places(t, lambda x: x.isin("(", ")")), lambda i: i < first)), -1)
    after = lambda near: F.when((near >= 0) & (F.get(t, near) == "(") & (u[0] >= 0.5), near + 1).otherwise(0)
    long = lambda first, k: F.when((F.size(t) - first + k) / F.size(t) >= 0.25, _splice(t, k, first - k, nothing))
    cut = let(F.array_position(t, F.lit("1")).cast("int") - 1, lambda first: F.when(first >= 0, let(let(last(first), after), lambda k: long(first, k))))
    rest = lambda pair: _splice(t, pair["o"] + 1, pair["c"] - pair["o"] - 1, nothing)
    filler = lambda pair: F.when(u[1] < 0.5, F.array(_pick(F.concat(_texts(BONDS), F.filter(rest(pair), lambda x: x.rlike(S.RING))), u[2]))).otherwise(nothing)
    return (
        F.when(s < 0.1, F.concat(mark, t)).when(s < 0.2, F.concat(t, mark))
        .when(s < 0.3, _splice(t, _pick(_places(t, lambda x: x.isin(*BONDS)), u[0]) + F.floor(u[2] * 2).cast("int"), 0, bond))
        .when(s < 0.4, _splice(t, _pick(ring_opens, u[0]), 0, bond))
        .when(s < 0.6, _splice(t, _pick(_places(t, lambda x: x == "("), u[0]), 0, F.when(s < 0.5, bond).otherwise(_texts(["("]))))
        .when(s < 0.8, cut)
        .otherwise(let(_pick(_closed(t), u[0]), lambda pair: _splice(t, pair["o"] + 1, pair["c"] - pair["o"] - 1, filler(pair))))
    )


def _valence(t: Column, s: Column, u: list[Column]) -> Column:
    """A native stand-in without a toolkit: the bond after a plain aliphatic atom is raised, where an atom or a double bond follows."""
    follows = F.filter(_places(t, lambda x: x.isin("C", "N", "O", "S", "P")), lambda i: F.get(t, i + 1).rlike(r"\A(?:=|[BCNOSPFI]|Br|Cl)\z"))
    raised = lambda i: F.when(F.get(t, i) == "=", _splice(t, i, 1, _texts(["#"]))).otherwise(_splice(t, i, 0, F.array(_pick(_texts(["=", "#"]), u[1]))))
    return let(_pick(follows, u[0]) + 1, raised)


def corrupt(samples: DataFrame, n: int = 1, error: list[str] | str = "all", seed: int = 0) -> DataFrame:
    """(sample_idx, error, error_smiles): each string broken by n edits of each kind of error, one on the other, each chosen by digests of string, seed, kind and round: the same for any partitioning. An edit for which a string has no place leaves it as it is; characters that belong to no token are lost; strings without a token give no rows."""
    kinds = ERRORS if error == "all" else [error] if isinstance(error, str) else error
    if not isinstance(kinds, list):
        raise TypeError("error: a list or a kind, or 'all'")
    if bad := [k for k in kinds if k not in ERRORS]:
        raise ValueError(f"no such kinds: {bad}; there are {['all', *ERRORS]}")
    if not kinds:
        raise ValueError("no kind of error given")
    rows = samples.select("sample_idx", "smiles", S.tokens(F.col("smiles")).alias("t")).where(F.size("t") > 0).select("*", F.explode(_texts(kinds)).alias("error"))
    edit = {"rings": _ring, "parentheses": _parentheses, "aromaticity": _aromaticity, "syntax": _syntax, "valence": _valence}
    for i in range(n):
        draws = [F.get("_u", F.lit(j)) for j in range(1, 5)]
        # generators of one row, behind which a value is not worked out again wherever it is used
        rows = rows.select("*", F.explode(F.array(F.array(*(fraction("smiles", F.lit(seed), "error", F.lit(i), F.lit(j)) for j in range(5))))).alias("_u"))
        new = F.lit(None)
        for kind in kinds:
            new = F.when(F.col("error") == kind, edit[kind](F.col("t"), F.get("_u", F.lit(0)), draws)).otherwise(new)
        rows = rows.select("sample_idx", "smiles", "error", F.explode(F.array(F.coalesce(new, "t"))).alias("t"))
    return rows.select("sample_idx", "error", F.array_join("t", "").alias("error_smiles"))
