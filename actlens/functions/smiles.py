"""Line-notation molecule strings: tokens, roles, structure checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grammar of TESTDATA.md and the role patterns.
TOKEN = r"\[[^\]]+\]|%[0-9]{2}|Br|Cl|[BCNOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]"
BRANCH = r"\A[()]\z"
RING = r"\A(?:%[0-9]{2}|[0-9])\z"
BOND = r"\A[\-=#$\\/]\z"
ATOM = r"[a-zA-Z*]"


def tokens(smiles: Column) -> Column:
    """The tokens from left to right; other characters belong to none. Null stays null."""
    return F.regexp_extract_all(smiles, F.lit(TOKEN), F.lit(0))


def only_tokens(smiles: Column) -> Column:
    """Whether the text is one or more tokens and nothing else."""
    return (F.length(smiles) > 0) & (F.regexp_replace(smiles, TOKEN, "") == "")


def balanced(toks: Column) -> Column:
    """Whether the branch tokens open and close in order."""
    step = lambda d, t: F.when(d < 0, d).when(t == "(", d + 1).when(t == ")", d - 1).otherwise(d)
    return F.aggregate(toks, F.lit(0), step) == 0


def rings_closed(toks: Column) -> Column:
    """Whether every ring token occurs an even number of times."""
    rings = F.filter(toks, lambda t: t.rlike(RING))
    return F.forall(F.array_distinct(rings), lambda r: F.size(F.filter(rings, lambda x: x == r)) % 2 == 0)


def role(token: Column) -> Column:
    """Branch, Ring, Bond, Disconnection or, by default, Atom."""
    return (
        F.when(token.isNull(), F.lit(None))
        .when(token.rlike(BRANCH), "Branch")
        .when(token.rlike(RING), "Ring")
        .when(token.rlike(BOND), "Bond")
        .when(token == ".", "Disconnection")
        .otherwise("Atom")
    )
