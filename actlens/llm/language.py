"""Language of each document and of each segment of a mixed one.

A bidirectional gated recurrent network over bytes (gru.py), trained here on a bounded sample of labelled documents,
labels every position of every text. Positions pool to lines, lines to segments by the best sequence of languages
(lines that open or close a block tell where switches are likely), and segments to document probabilities.

Training runs in tasks, not on the driver: WORKERS shards of the sample each train for a round, and their weights are
averaged. First the network learns from short windows of what lies outside marked blocks, each position labelled with
its document's own label, which is wrong for some documents; then it labels the sample, documents that contradict their
label are left out, and the network learns on.

Windows cover whole texts, overlap by CONTEXT bytes on both sides, and hold bytes of one text only; only line sums are
kept, so a text of any length needs little memory.

Defined results: null and blank texts have no segment and a null language; a label is compared without outer white
space and case, and null or unknown labels are wrong; lines end with LF, and CR is white space; blank lines belong to
no segment's first line; repeated rows give each their result; with no labelled document at all, ValueError.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.common import norm, settle, spread, strip
from actlens.llm import gru

# The twelve languages of TESTDATA.md.
LANGUAGES = ["python", "javascript", "java", "c", "go", "rust", "sql", "shell", "html", "css", "markdown", "text"]

#: Prose inside another language belongs to it.
PROSE = LANGUAGES.index("text")

#: Labelled documents per language in the sample, and bytes taken of each; both bound what training sees.
SAMPLE, SAMPLE_BYTES = 500, 8_192
#: Size of the network; shards, rounds of both phases, steps a round, windows a step, bytes a window, rates at the start.
HIDDEN, WORKERS, ROUNDS, STEPS, BATCH, WINDOW, RATE, SEED = 32, 6, (4, 3), 90, 40, 128, (0.01, 0.005), 7
#: Bytes of a window that count, and bytes of context on either side; windows run together.
CORE, CONTEXT, TOGETHER = 2048, 96, 256
#: A line's weight is that of at most so many bytes; floor of a position's log probability.
LINE, FLOOR = 12.0, -5.0
#: Log odds that a marked block must have for another language than that around it; those of a switch elsewhere, and where it is unlikely; weight of a marking or comment line's own bytes.
BLOCK, SWITCH, UNLIKELY, MARKED = 8.0, 50.0, 150.0, 0.4

# Lines that open a block in another language (fences, tags, here documents, raw strings); comment lines; lines that go on.
_KIND = re.compile(rb"\s*(?:(#(?!include|define|if|endif|!))|(//)|(--)|(/\*|\*)|(<!--))|[ \t]+\S|[})\]]")
_COMMENTS = {4: ("python", "shell"), 6: ("javascript", "java", "c", "go", "rust"), 7: ("sql",), 8: ("javascript", "java", "c", "go", "rust", "css", "sql"), 9: ("html", "markdown")}
_MAY_OPEN = re.compile(rb"[`~]|\"\"\"|'''|<<|<s|<S|#\"")
_OPENS = re.compile(
    rb"""^(?P<fence>```|~~~)|<(?P<tag>script|style)\b[^>]*>$|<<[-~]?\s*['"]?(?P<word>[A-Za-z_]+)['"]?\s*$|r(?P<hashes>#+)"$""", re.I
)

#: Hashes that are told apart in the marks of a raw string.
MOST_HASHES = 8

_WHITE = np.zeros(gru.PAD + 1, bool)
#: Of lines by their mark.
_WEIGHT = np.array([1.0, MARKED, MARKED, 1.0, MARKED, 1.0, MARKED, MARKED, MARKED, MARKED])
#: What leaving each language costs behind a line of each mark.
_LEAVE = np.full((10, len(LANGUAGES)), SWITCH)
_LEAVE[1:3] = UNLIKELY
for _mark, _of in _COMMENTS.items():
    _LEAVE[_mark, [LANGUAGES.index(x) for x in _of]] = UNLIKELY
_WHITE[[9, 10, 11, 12, 13, 32, gru.PAD]] = True


def line_scores(p: dict, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (sums, n): log probabilities summed over the bytes that aren't white space, and their number, per line."""
    lengths = [len(t) for t in texts]
    lines = [t.count(b"\n") + 1 for t in texts]
    line_at = np.r_[0, np.cumsum(lines)]
    sums, n = np.zeros((line_at[-1], len(LANGUAGES)), np.float64), np.zeros(line_at[-1], np.int64)
    # line feeds before each window of a text
    before = [np.r_[0, np.cumsum([t.count(b"\n", a, a + CORE) for a in range(0, len(t), CORE)])] for t in texts]
    # windows with what stands around them, within their text; those of like length run together
    jobs = [(min(a + CORE + CONTEXT, size) - max(0, a - CONTEXT), i, a) for i, size in enumerate(lengths) for a in range(0, size, CORE)]
    jobs.sort(reverse=True)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    k = gru.span(p)
    for first in range(0, len(jobs), TOGETHER):
        part = jobs[first : first + TOGETHER]
        long = -(-part[0][0] // k) * k  # whole steps
        x = np.full((long, len(part)), gru.PAD, np.int16)
        line = np.full((long, len(part)), -1, np.int64)
        for j, (size, i, a) in enumerate(part):
            lo = max(0, a - CONTEXT)
            x[:size, j] = data[i][lo : lo + size]
            own = data[i][a : a + CORE]
            feeds = own == 10
            line[a - lo : a - lo + len(own), j] = line_at[i] + before[i][a // CORE] + np.cumsum(feeds) - feeds
        y = np.maximum(gru.log_probs(p, x), FLOOR)
        line = line.reshape(long // k, k, len(part))
        good = (line >= 0) & ~_WHITE[x].reshape(line.shape)
        # steps within one line count at once, the bytes of others each
        once = line[:, 0] == line[:, -1]
        each = good & ~once[:, None]
        some = np.flatnonzero((once & good.any(1)).T)
        if len(some):
            at, c = line[:, 0].T.ravel()[some], good.sum(1).T.ravel()[some]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            np.add.at(sums, at[start], np.add.reduceat(y.transpose(1, 0, 2).reshape(-1, y.shape[-1])[some] * c[:, None], start, axis=0))
            np.add.at(n, at[start], np.add.reduceat(c, start))
        step, place, column = np.nonzero(each)
        at = line[step, place, column]
        np.add.at(sums, at, y[step, column])
        np.add.at(n, at, 1)
    return [(sums[a:b], n[a:b]) for a, b in zip(line_at, line_at[1:])]


def marks(lines: list[bytes]) -> np.ndarray:
    """1 for a line that opens a block, 3 for the lines in it, 2 for the one that closes it; of the others, 4 and 6 to 9 for what may be a comment, by its sign, 5 for lines that go on with something (indented, or a closing bracket), 0 for the rest. Time is linear in the lines: what closes a block is found in an index of them."""
    out = np.array([0 if not (m := _KIND.match(x)) else (5, 4, 6, 7, 8, 9)[m.lastindex or 0] for x in lines], np.int8)
    may = [i for i, x in enumerate(lines) if _MAY_OPEN.search(x)]
    if not may:
        return out
    lines = [x.strip() for x in lines]
    index: dict[tuple, list[int]] = {}
    i = 0
    for opened in may:
        if opened < i or (way := _opening(lines[opened])) is None:
            continue
        i = opened + 1
        closed = _next(index, lines, way, i)
        if closed is not None:
            out[opened + 1 : closed] = 3
            out[opened], out[closed], i = 1, 2, closed + 1
    return out


def _next(index: dict[tuple, list[int]], lines: list[bytes], way: tuple[str, bytes], i: int) -> int | None:
    """The first line from i on that closes a block opened that way."""
    kind, mark = way
    if kind == "word" and ("words", b"") not in index:  # all lines by their text, once
        index["words", b""] = []
        for j, x in enumerate(lines):
            index.setdefault(("word", x), []).append(j)
    if kind == "hashes":
        mark = mark[:MOST_HASHES]
    if (kind, mark) not in index:
        index[kind, mark] = [] if kind == "word" else [j for j, x in enumerate(lines) if _closes(x, kind, mark)]
    at = index[kind, mark]
    k = bisect.bisect_left(at, i)
    return at[k] if k < len(at) else None


def _opening(line: bytes) -> tuple[str, bytes] | None:
    for quote in (b'"""', b"'''", b"`"):
        if line.count(quote) % 2 and not line.startswith(b"```"):
            return "quote", quote
    m = _OPENS.search(line)
    return m and (m.lastgroup, m.group(m.lastgroup).lower() if m.lastgroup == "tag" else m.group(m.lastgroup))


def _closes(line: bytes, way: str, mark: bytes) -> bool:
    if way == "quote":
        return line.count(mark) % 2 == 1
    if way == "tag":
        return b"</" + mark in line.lower()
    if way == "hashes":
        return b'"' + mark in line
    return line == mark if way == "word" else line.startswith(mark)


def _path(score: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The best language of each line, where a switch costs SWITCH log odds, and UNLIKELY ones behind a comment of the language that is left, which goes with the code after it, next to marks, and before a line that goes on with something."""
    best = score.argmax(1)
    if (best == best[0]).all():
        return best
    after = kind[1:]
    cost = np.where(((after == 1) | (after == 2) | (after == 5))[:, None], UNLIKELY, _LEAVE[kind[:-1]])
    v, own = score[0].copy(), np.arange(len(LANGUAGES))
    back = np.empty(score.shape, np.int8)
    for t in range(1, len(score)):
        left = v - cost[t - 1]
        top = left.argmax()
        stay = v >= left[top]
        back[t] = np.where(stay, own, top)
        v = np.where(stay, v, left[top]) + score[t]
    path = np.empty(len(score), np.int64)
    path[-1] = v.argmax()
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _starts(inside: np.ndarray) -> np.ndarray:
    """Where a stretch of true values begins."""
    return np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))


def segments(sums: np.ndarray, n: np.ndarray, mark: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first line, last line, language, confidence) of each segment, lines from 1. The lines outside marked blocks form the best sequence of languages; a marked block is of the one language that suits it best, if by more than BLOCK, else of that around it. Blank lines take no part."""
    at = np.flatnonzero(n)
    if not len(at):
        return []
    kind = mark[at]
    weight = np.minimum(n[at], LINE) * _WEIGHT[kind]
    score = sums[at] / n[at, None] * weight[:, None]
    inside = kind == 3
    path = np.empty(len(at), np.int64)
    path[~inside] = _path(score[~inside], kind[~inside])
    starts = _starts(inside)
    for a in starts if len(starts) else ():
        z = a + int(np.argmin(np.append(inside[a:], False)))
        total, around = score[a:z].sum(0), path[a - 1]
        lang = total.argmax()
        path[a:z] = lang if lang != PROSE and total[lang] > total[around] + BLOCK else around
    cut = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    out = []
    for a, b in zip(cut, cut[1:]):
        mean = score[a:b].sum(0) / weight[a:b].sum()
        q = np.exp(mean - mean.max())
        out.append((int(at[a]) + 1, int(at[b - 1]) + 1, int(path[a]), float(q[path[a]] / q.sum())))
    return out


def pieces(text: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, bytes]]]:
    """The lines' marks, and (line numbers from 0, text) of what lies outside marked blocks, then of each block: the network reads each alone, so that neither colours the other."""
    lines = text.split(b"\n")
    mark = marks(lines)
    inside = mark == 3
    if not inside.any():
        return mark, [(np.arange(len(lines)), text)]
    first = np.zeros(len(lines), np.int64)
    first[_starts(inside)] = 1
    group = np.where(inside, np.cumsum(first), 0)
    at = [np.flatnonzero(group == k) for k in range(group.max() + 1)]
    return mark, [(x, b"\n".join([lines[i] for i in x])) for x in at]


def label_lines(p: dict, texts: list[bytes]) -> list[tuple[list[tuple[int, int, int, float]], np.ndarray]]:
    """(segments, bytes per line) of each text."""
    cut = [pieces(t) for t in texts]
    scored = iter(line_scores(p, [t for _, own in cut for _, t in own]))
    out = []
    for mark, own in cut:
        sums, n = np.zeros((len(mark), len(LANGUAGES))), np.zeros(len(mark), np.int64)
        for at, _ in own:
            sums[at], n[at] = next(scored) if len(at) else (next(scored)[0][:0], 0)
        out.append((segments(sums, n, mark), n))
    return out


def main_language(segs: list, n: np.ndarray) -> tuple[int, float]:
    """The language of most bytes, and its segments' confidence weighted by bytes."""
    size: dict[int, list[float]] = {}
    for a, b, lang, conf in segs:
        m = float(n[a - 1 : b].sum())
        s = size.setdefault(lang, [0.0, 0.0])
        s[0] += m
        s[1] += m * conf
    lang = max(size, key=lambda x: size[x][0])
    return lang, size[lang][1] / size[lang][0]


def _learn(state: dict, texts: list[np.ndarray], labels: list[int], steps: int, rates: tuple[float, float], seed: int) -> dict:
    """Adam on windows drawn evenly over the languages, around the start of a line; every position has its text's label."""
    r = np.random.default_rng(seed)
    starts: list[list[tuple[int, int]]] = [[] for _ in LANGUAGES]
    for i, (t, y) in enumerate(zip(texts, labels)):
        starts[y] += [(i, int(a)) for a in np.r_[0, np.flatnonzero(t == 10) + 1] if a < len(t)]
    have = [s for s in starts if s]
    p, adam = state["p"], gru.Adam(state["p"])
    adam.m, adam.v, adam.t = state["m"], state["v"], state["t"]
    for step in range(steps if have else 0):
        x = np.full((WINDOW, BATCH), gru.PAD, np.int64)
        y = np.zeros((WINDOW, BATCH), np.int64)
        for j in range(BATCH):
            s = have[r.integers(len(have))]
            i, a = s[r.integers(len(s))]
            a = 0 if r.random() < 0.15 else a  # a text's start counts more often than one line of many
            a -= int(r.integers(0, WINDOW // 2))  # what comes before, or nothing at a text's start
            own = slice(max(0, a), min(len(texts[i]), a + WINDOW))
            x[own.start - a : own.stop - a, j], y[:, j] = texts[i][own], labels[i]
        _, g = gru.gradients(p, x, y, (~_WHITE[x]).astype(np.float32))
        adam.step(p, g, rates[0] + (rates[1] - rates[0]) * step / steps)
    return {"p": p, "m": adam.m, "v": adam.v, "t": adam.t}


def _mean(states: list[dict]) -> dict:
    return {k: {n: np.mean([s[k][n] for s in states], axis=0, dtype=np.float32) for n in states[0][k]} for k in "pmv"} | {"t": max(s["t"] for s in states)}


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(text, label): at most per_language different texts of each language, those with the smallest hashes; a threshold on the hash keeps the ranking small, and copies count once. Of a text longer than SAMPLE_BYTES characters, a stretch from a place chosen by its hash."""
    label = F.array_position(F.array(*map(F.lit, LANGUAGES)), norm(F.col("lang"))) - 1
    hashed = docs.where(strip(F.col("text")) != "").select(label.cast("int").alias("label"), F.xxhash64("text").alias("h"), "text").where("label >= 0")
    keep = hashed.select("label", "h").distinct().groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.least(F.lit(1.0), F.lit(2.0 * per_language + 50) / F.col("n")))
    least = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.col("share")
    few = hashed.join(F.broadcast(keep), "label").where(F.col("h") <= least)  # a row per language
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES + 1)) + 1
    few = few.select("label", "h", F.substring("text", start.cast("int"), F.lit(SAMPLE_BYTES)).alias("text")).groupBy("label", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.encode("text", "utf-8").alias("text"), "label")


def _shards(data: DataFrame) -> DataFrame:
    """In WORKERS partitions by the text, so that what a shard learns from doesn't depend on files or cores."""
    return data.repartition(WORKERS, F.xxhash64("text"))


def _round(data: DataFrame, state: dict, steps: int, rates: tuple[float, float], seed: int) -> dict:
    """One round: every shard trains from the same state; the mean of the results."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((bytes(t), int(y)) for b in batches for t, y in zip(b["text"], b["label"]))
        texts, labels = [np.frombuffer(pieces(t)[1][0][1], np.uint8) for t, _ in rows], [y for _, y in rows]
        own = {k: {n: x.copy() for n, x in state[k].items()} for k in "pmv"} | {"t": state["t"]}
        yield pd.DataFrame({"state": [pickle.dumps(_learn(own, texts, labels, steps, rates, seed))] if rows else []})

    return _mean([pickle.loads(r.state) for r in _shards(data).mapInPandas(work, "state binary").collect()])


def _variants(text: bytes) -> Iterator[bytes]:
    """The text, and, of every third by its bytes, one with other white space, as reformatted copies have it."""
    yield text
    k = sum(text) % 12
    if k < 4:
        yield text.replace(*((b"    ", b"\t"), (b"  ", b"\t"), (b" ", b"  "), (b"\n", b"\r\n"))[k])


def _with_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(v, y) for t, y in zip(b["text"], b["label"]) for v in _variants(bytes(t))], columns=["text", "label"])


def _agreeing(p: dict):
    """Keeps the texts that the network finds to be of their label outside marked blocks."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outer = [pieces(bytes(t))[1][0][1] for t in b["text"]]
            found = [{x for _, _, x, _ in segs} for segs, _ in label_lines(p, outer)]
            yield b[[f == {y} for f, y in zip(found, b["label"])]]

    return keep


def train(docs: DataFrame, rounds: tuple[int, int] = ROUNDS, steps: int = STEPS, per_language: int = SAMPLE) -> dict:
    """The network's weights."""
    schema = "text binary, label int"
    data = settle(_shards(sample(docs, per_language)).mapInPandas(_with_variants, schema))
    if data.isEmpty():
        raise ValueError("no document has a known language label")
    p = gru.init(len(LANGUAGES), HIDDEN, SEED)
    state = {"p": p, "m": {k: np.zeros_like(x) for k, x in p.items()}, "v": {k: np.zeros_like(x) for k, x in p.items()}, "t": 0}
    for phase, n in enumerate(rounds):
        if phase:
            data = settle(_shards(data).mapInPandas(_agreeing(state["p"]), schema))
            if data.isEmpty():
                break
        for i in range(n):
            rate = lambda x: RATE[phase] * (1 - 0.9 * x / n)  # noqa: B023, E731
            state = _round(data, state, steps, (rate(i), rate(i + 1)), SEED + 100 * phase + i)
    return state["p"]


def identify(docs: DataFrame, weights: dict, key: str = "doc_id") -> DataFrame:
    """(key, lang, language, confidence, segments): the given label, the language of most bytes, and the segments (first_line, last_line, lang, confidence)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.iloc[k : k + 500]
                out = []
                for id_, label, (segs, n) in zip(b[key], b["lang"], label_lines(shared.value, [(t or "").encode() for t in b["text"]])):
                    lang, conf = main_language(segs, n) if segs else (None, None)
                    out.append((id_, label, None if lang is None else LANGUAGES[lang], conf, [(a, z, LANGUAGES[x], c) for a, z, x, c in segs]))
                yield pd.DataFrame(out, columns=[key, "lang", "language", "confidence", "segments"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, "lang", "text")).mapInPandas(
        work, f"{key} {kind}, lang string, language string, confidence double, segments array<struct<first_line: int, last_line: int, lang: string, confidence: double>>"
    )


def found(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """(doc_id, first_line, lang): the segments of mixed documents, and the one segment of each document whose label isn't its language."""
    rows = identify(docs, weights or train(docs))
    wrong = (F.size("segments") > 1) | ((F.size("segments") == 1) & (F.coalesce(norm(F.col("lang")), F.lit("")) != F.col("language")))
    return rows.where(wrong).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.first_line", "s.lang")
