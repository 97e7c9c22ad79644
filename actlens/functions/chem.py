"""Chemistry that needs rdkit, and language models that need torch: optional, in Arrow batches. Not tested where the packages are missing; each call then says so."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions.smiles import ATOM, TOKEN


def need(package: str):
    try:
        return importlib.import_module(package)
    except ImportError as e:
        raise RuntimeError(f"this needs the package {package}, which is not installed") from e


def parsable(smiles: Column) -> Column:
    """Whether the toolkit parses the string; null for null."""
    need("rdkit")

    @F.pandas_udf("boolean")
    def ok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chem = need("rdkit.Chem")
        for b in batches:
            yield b.map(lambda s: None if s is None else chem.MolFromSmiles(s) is not None)

    return ok(smiles)


def fingerprint(smiles: Column, radius: int, bits: int = 2048) -> Column:
    """Circular fingerprint bits; zeros for strings that don't parse."""
    need("rdkit")

    @F.pandas_udf("array<tinyint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chem, make = need("rdkit.Chem"), need("rdkit.Chem.rdFingerprintGenerator").GetMorganGenerator(radius=radius, fpSize=bits)
        for b in batches:
            mols = [chem.MolFromSmiles(s) if s else None for s in b]
            yield pd.Series([np.zeros(bits, np.int8) if m is None else make.GetFingerprintAsNumPy(m).astype(np.int8) for m in mols])

    return of(smiles)


def substructure_labels(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(sample_idx, concept, token_idxs): every match of each pattern, atoms given as token positions; strings that don't parse give none."""
    need("rdkit")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        chem = need("rdkit.Chem")
        asked = {c: chem.MolFromSmarts(p) for c, p in patterns.items()}
        for b in batches:
            out = []
            for i, s in zip(b["sample_idx"], b["smiles"]):
                mol = chem.MolFromSmiles(s) if s else None
                if mol is None:
                    continue
                at = [k for k, t in enumerate(re.findall(TOKEN, s)) if re.search(ATOM, t)]
                for c, q in asked.items():
                    if hits := mol.GetSubstructMatches(q, useChirality=True):
                        out.append((i, c, [sorted(at[a] for a in h) for h in hits]))
            yield pd.DataFrame(out, columns=["sample_idx", "concept", "token_idxs"])

    return samples.select("sample_idx", "smiles").mapInPandas(work, "sample_idx long, concept string, token_idxs array<array<int>>")


def variants(samples: DataFrame, n: int, reps: int) -> DataFrame:
    """(sample_idx, variant, smiles): up to n distinct other spellings of each molecule from reps tries."""
    if reps < n:
        raise ValueError("reps must be at least n")
    need("rdkit")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chem = need("rdkit.Chem")
        for b in batches:
            out = []
            for i, s in zip(b["sample_idx"], b["smiles"]):
                mol = chem.MolFromSmiles(s) if s else None
                tries = chem.MolToRandomSmilesVect(mol, reps, randomSeed=int(i) % 2**31) if mol is not None else []
                out += [(i, k, v) for k, v in enumerate([v for v in dict.fromkeys(tries) if v != s][:n])]
            yield pd.DataFrame(out, columns=["sample_idx", "variant", "smiles"])

    return samples.select("sample_idx", "smiles").mapInPandas(work, "sample_idx long, variant int, smiles string")


class HiddenStateProvider(Protocol):
    """What a language model must offer: hidden(texts) gives one (tokens, dim) array per text and layer. Its output, written as rows (sample_idx, token_idx, layer, vec), feeds the autoencoder operators."""

    def hidden(self, texts: list[str], layers: list[int]) -> list[dict[int, np.ndarray]]: ...


def hidden_states(samples: DataFrame, provider: HiddenStateProvider, layers: list[int]) -> DataFrame:
    """(sample_idx, token_idx, layer, vec) from a provider that workers can unpickle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, by_layer in zip(b["sample_idx"], provider.hidden(list(b["smiles"]), layers)):
                for layer, x in by_layer.items():
                    yield pd.DataFrame({"sample_idx": i, "token_idx": np.arange(len(x)), "layer": layer, "vec": list(x.astype(np.float64))})

    return samples.where("smiles is not null").select("sample_idx", "smiles").mapInPandas(work, "sample_idx long, token_idx int, layer int, vec array<double>")
