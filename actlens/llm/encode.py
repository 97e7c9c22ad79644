"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts up to LONG characters are encoded in Arrow batches. A longer text is cut, in the same pass over the corpus, into
pieces at places where the tokenizer's own pattern always cuts, so pieces are encoded in parallel by many tasks and
their ids concatenated. A stretch that the pattern does not split (base64, minified code, long runs of white space) is
halved again and again into leaves of LEAF bytes; the leaves are encoded in parallel, and a tree joins them: around each
join a growing window is encoded anew until its first token agrees with the left side's and its last token with the
right side's at the same bytes. Byte-level BPE is decided by adjacent tokens, so the joined ids then equal those of the
whole stretch.

Defined results: an empty and a null text give an empty list; special tokens in a text are ordinary text; every row
gives a row, repeated ids too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.common import spread

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters from which a text is cut; characters of a piece; bytes of a leaf of an unsplit stretch.
LONG, PIECE, LEAF = 32_768, 16_384, 8_192

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def encoding(folder: str = TOKENIZERS, name: str = NAME):
    """(with the splitting pattern, without it): one word of any length per text."""
    import tiktoken

    if not hasattr(tiktoken.Encoding, "_encode_single_piece"):
        raise RuntimeError("this version of tiktoken cannot encode the bytes of one word")
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tuple(tiktoken.Encoding(f"{name}-{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for i, p in enumerate((PATTERN, r"[\s\S]+")))


@lru_cache
def _cuts():
    import regex

    return regex.compile(PATTERN), regex.compile(r"(?<=\S)(?= \S)|(?<=\S\n)(?=\S)")


def _bpe(enc, word: bytes) -> list[int]:
    """The merges alone, on the bytes of one unsplit word (of at most some LEAF bytes)."""
    return enc._encode_single_piece(word)


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The ids of the joined bytes, from those of both sides."""
    if not left or not right:
        return left + right
    size = enc.decode_single_token_bytes
    k = 4
    while True:
        a, b = left[max(0, len(left) - k) :], right[:k]
        window = _bpe(enc, b"".join(map(size, a + b)))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def encode_word(enc, word: bytes, leaf: int = LEAF) -> list[int]:
    """The ids of one unsplit word, by halving it down to leaves and joining these as a tree."""
    parts = [_bpe(enc, word[i : i + leaf]) for i in range(0, len(word), leaf)]
    return join_all(enc, parts)


def join_all(enc, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def stretches(text: str, leaf: int = LEAF) -> Iterator[tuple[bool, str]]:
    """(whether it is one word, text): long words, the white space words before them (whose extent the long word decided), and all else."""
    start, space = 0, None
    for m in _cuts()[0].finditer(text):
        if m.end() - m.start() > leaf // 4:  # may exceed a leaf in bytes
            end = m.start() if space is None else space[0]
            if start < end:
                yield False, text[start:end]
            for i, j in itertools.pairwise([*space, m.start()] if space else []):
                yield True, text[i:j]
            yield True, m.group()
            start, space = m.end(), None
        else:
            space = [*(space or []), m.start()] if m.group().isspace() else None
    if start < len(text):
        yield False, text[start:]


def encode_text(text: str, folder: str = TOKENIZERS, name: str = NAME, leaf: int = LEAF) -> list[int]:
    """Ids of a text; words longer than a leaf go through the tree."""
    whole, bare = encoding(folder, name)
    if len(text) <= leaf // 4:  # no word can exceed a leaf
        return whole.encode_ordinary(text)
    ids: list[int] = []
    for word, t in stretches(text, leaf):
        ids += encode_word(bare, t.encode(), leaf) if word else whole.encode_ordinary(t)
    return ids


def pieces(text: str, piece: int = PIECE, leaf: int = LEAF) -> Iterator[tuple[bool, bytes]]:
    """(whether it is a leaf of an unsplit word, bytes): cuts a long text where the pattern always cuts; words beyond a leaf become leaves."""
    safe = _cuts()[1]
    at, end = 0, len(text)
    while at < end:
        m = safe.search(text, at + piece) if end - at > piece else None
        stop = m.start() if m else end
        for word, t in stretches(text[at:stop], leaf):
            data = t.encode()
            if not word:
                yield False, data
                continue
            for i in range(0, len(data), leaf):
                yield True, data[i : i + leaf]
            yield False, b""  # ends the word
        at = stop


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, long: int = LONG) -> DataFrame:
    """(key, ids) of every row."""
    rows = spread(docs.select(F.col(key), F.col(text).alias("_t")))
    size = F.coalesce(F.length("_t"), F.lit(0))

    @F.pandas_udf("array<int>")
    def short_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([np.array(encode_text(t, folder, name) if t else [], dtype=np.int32) for t in b], dtype=object)

    short = rows.where(size <= long).select(key, short_ids.asNondeterministic()("_t").alias("ids"))  # nondeterministic: a filter on ids must not run it twice

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, copies, k, t in zip(b["_row"], b["copies"], b[key], b["_t"]):
                cuts = ((row, copies, k, i, leaf, data) for i, (leaf, data) in enumerate(pieces(t)))
                for chunk in itertools.batched(cuts, 64):
                    yield pd.DataFrame(chunk, columns=["_row", "copies", key, "no", "leaf", "data"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, bare = encoding(folder, name)
        for b in batches:
            ids = [_bpe(bare, d) if leaf else whole.encode_ordinary(d.decode()) if d else [] for leaf, d in zip(b["leaf"], b["data"])]
            yield b.drop(columns="data").assign(ids=[np.array(x, dtype=np.int32) for x in ids])

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        bare = encoding(folder, name)[1]
        pdf = pdf.sort_values("no")
        ids: list = []
        word: list = []
        for leaf, part in zip(pdf["leaf"], pdf["ids"]):
            if leaf:
                word.append(part.tolist())
            else:
                ids += join_all(bare, word) + part.tolist()
                word = []
        n = int(pdf["copies"].iloc[0])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * n, "ids": [np.array(ids, dtype=np.int32)] * n})

    kind = docs.schema[key].dataType.simpleString()
    # equal rows are cut once and come out as often as they stand
    held = rows.where(size > long).groupBy(key, "_t").agg(F.count("*").alias("copies")).withColumn("_row", F.sha2("_t", 256))
    parts = (
        held.mapInPandas(cut, f"_row string, copies long, {key} {kind}, no int, leaf boolean, data binary")
        .repartition(F.xxhash64("_row", "no"))
        .mapInPandas(encode, f"_row string, copies long, {key} {kind}, no int, leaf boolean, ids array<int>")
    )
    return short.unionByName(parts.groupBy("_row", key).applyInPandas(assemble, f"{key} {kind}, ids array<int>"))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, n_tokens)."""
    return encode_corpus(docs, key, text, folder, name).select(key, F.size("ids").cast("long").alias("n_tokens"))
