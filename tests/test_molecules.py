import re

import pytest

from actlens.functions import smiles as S
from actlens.operators import molecules as M
from actlens.sources import tables as T

STRINGS = ["CC(=O)Oc1ccccc1C(=O)O", "C[C@@H](N)C(=O)O.Cl", "C%12CC%12Br", r"F/C=C\F", "CC(=O", "CC)O", "C1CC", "", None, "C(C(N)C)(O)S", "((C))", "C1CC=1O"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "sample_idx long, smiles string")


def _tokens(s):
    return re.findall(S.TOKEN, s or "")


def test_tokens_roles_atoms(samples):
    got = {(r.sample_idx, r.token_idx): (r.token, r.role) for r in M.token_rows(samples).collect()}
    want = {(i, k): t for i, s in enumerate(STRINGS) for k, t in enumerate(_tokens(s))}
    assert {k: v[0] for k, v in got.items()} == want
    role = lambda t: "Branch" if t in "()" else "Ring" if re.fullmatch("%..|[0-9]", t) else "Bond" if t in "-=#$\\/" else "Disconnection" if t == "." else "Atom"
    assert all(v[1] == role(v[0]) for v in got.values())
    atoms = {(r.sample_idx, r.atom_idx): r.token_idx for r in M.atom_map(samples).collect()}
    assert atoms == {(i, n): k for i, s in enumerate(STRINGS) for n, k in enumerate(k for k, t in enumerate(_tokens(s)) if re.search(S.ATOM, t))}


def test_masks(samples):
    got = {(r.sample_idx, r.token_idx): r.masked for r in M.mask_enum(samples, exclude=S.BRANCH, start=1, end=6).collect()}
    want = {}
    for i, s in enumerate(STRINGS):
        t = _tokens(s)
        want |= {(i, k): "".join(t[:k] + ["[MASK]"] + t[k + 1 :]) for k in range(1, min(6, len(t))) if t[k] not in "()"}
    assert got == want


def _pairs(t):
    out, stack, rings = set(), [], {}
    for k, x in enumerate(t):
        if x == "(":
            stack.append(k)
        elif x == ")" and stack:
            out.add(("branch", "(", stack.pop(), k))
        elif re.fullmatch("%..|[0-9]", x):
            if x in rings:
                out.add(("ring", x, rings.pop(x), k))
            else:
                rings[x] = k
    return out


def test_pairs_of_balanced_strings(samples):
    got: dict = {}
    for r in M.syntax_pairs(samples).collect():
        got.setdefault(r.sample_idx, set()).add((r.kind, r.token, r.open_idx, r.close_idx))
    for i, s in enumerate(STRINGS):
        assert got.get(i, set()) == _pairs(_tokens(s)), s


def test_branches(samples):
    """As a stack has them: a closing token without an open branch counts for nothing, and an unclosed branch is none."""
    got = {}
    for r in M.branches(samples).collect():
        got.setdefault(r.sample_idx, []).append((r.depth, r.open_idx, r.close_idx, r.tokens, r.atoms))
    for i, s in enumerate(STRINGS):
        t = _tokens(s)
        if not t:
            assert i not in got
            continue
        stack, main, want = [], [], []
        for k, x in enumerate(t):
            if x == "(":
                stack.append((k, []))
            elif x == ")":
                if stack:
                    o, own = stack.pop()
                    want.append((len(stack) + 1, o, k, own))
            else:
                (stack[-1][1] if stack else main).append(k)
        want.append((0, 0, len(t) - 1, main))
        assert sorted(got[i]) == sorted((*w, [k for k in w[3] if re.search(S.ATOM, t[k])]) for w in want), s


def test_bonds(samples):
    got = {(r.sample_idx, r.token_idx): (r.left_idx, r.right_idx) for r in M.bond_atoms(samples).collect()}
    assert got[0, 3] == (1, 4) and got[3, 1] == (0, 2) and got[3, 3] == (2, 4)
    assert got[11, 4] == (3, 0)  # the bond that closes ring 1 ends at the atom before its opening


def test_corruption(spark, samples):
    key = lambda rows: sorted(map(tuple, rows))
    a = M.corrupt(samples, n=2).collect()
    assert key(a) == key(M.corrupt(samples.repartition(3), n=2).collect())
    with_tokens = [i for i, s in enumerate(STRINGS) if _tokens(s)]
    assert {(r.sample_idx, r.error) for r in a} == {(i, k) for i in with_tokens for k in M.ERRORS}
    many = spark.createDataFrame([(i, "CC(=O)Oc1ccccc1C(N)=O", i) for i in range(400)], "sample_idx long, smiles string, seed int")
    kinds: dict = {}
    for seed in range(25):
        for r in M.corrupt(many.limit(1), seed=seed).collect():
            kinds.setdefault(r.error, set()).add(r.error_smiles)
    base = "CC(=O)Oc1ccccc1C(N)=O"
    swapped = {x for x in kinds["parentheses"] if sorted(x) == sorted(base) and x != base}
    assert all(len(v) > 1 for v in kinds.values()) and swapped  # a swap keeps the number of either token
    assert "1ccccc1C(N)=O" in kinds["syntax"] and "CC(=O)Oc1ccccc1C()=O" in kinds["syntax"]  # cut before the first ring, and an emptied branch
    assert {r.error for r in M.corrupt(samples, error="rings").collect()} == {"rings"}
    with pytest.raises(ValueError):
        M.corrupt(samples, error=["no such"])
    with pytest.raises(ValueError):
        M.corrupt(samples, error="no such")
    with pytest.raises(TypeError):
        M.corrupt(samples, error=3)


def test_ranges(spark):
    ends = spark.createDataFrame([(0, 2), (1, 2), (2, 5)], "ref_idx long, end long")
    assert sorted(map(tuple, T.range_members(ends).collect())) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
